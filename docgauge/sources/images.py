"""Page images as pixels: digests, rewrites and tiles of PNG files.

Sizes are changed as imaging libraries commonly do it: by a bicubic kernel
that widens when shrinking, in fixed point, along rows and then columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.geometry import tile_ratios
from docgauge.sinks.reports import append_records

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Height × width × 3 array of an 8-bit PNG that isn't interlaced."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in _CHANNELS:
        raise ValueError("unsupported PNG")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    rows = np.zeros((height + 1, (width + 1) * channels), np.int32)
    for y in range(height):
        line = raw[y, 1:].astype(np.int32)
        up, out = rows[y], rows[y + 1]
        method = raw[y, 0]
        if method == 0:
            out[channels:] = line
        elif method == 2:
            out[channels:] = (line + up[channels:]) & 255
        else:
            for x in range(channels, len(out)):
                a, b, c = out[x - channels], up[x], up[x - channels]
                if method == 1:
                    add = a
                elif method == 3:
                    add = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if pa <= pb and pa <= pc else b if pb <= pc else c
                out[x] = (line[x - channels] + add) & 255
    pixels = rows[1:, channels:].reshape(height, width, channels).astype(np.uint8)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    if channels < 3:
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return pixels[:, :, :3]


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pixel_digest(pixels: np.ndarray) -> str:
    """Digest of the RGB bytes and the size, whatever the file's encoding."""
    height, width, _ = pixels.shape
    return hashlib.sha256(pixels.tobytes() + f"{width}x{height}".encode()).hexdigest()


def white_like(pixels: np.ndarray) -> np.ndarray:
    return np.full_like(pixels, 255)


# Fixed values of the common bicubic kernel: its sharpness, and the bits of its weights.
_SHARP, _BITS = -0.5, 22


def _kernel(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near = ((_SHARP + 2) * x - (_SHARP + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * _SHARP
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _weights(old: int, new: int) -> np.ndarray:
    """The weights, in fixed point, of each old place in each new one."""
    scale = old / new
    wide = max(1.0, scale)
    centre = (np.arange(new) + 0.5) * scale
    first = np.maximum(0, (centre - 2 * wide + 0.5).astype(int))
    last = np.minimum(old, (centre + 2 * wide + 0.5).astype(int))
    at = np.arange(old)
    raw = _kernel((at[None, :] - centre[:, None] + 0.5) / wide)
    raw = np.where((at[None, :] >= first[:, None]) & (at[None, :] < last[:, None]), raw, 0.0)
    raw /= raw.sum(axis=1, keepdims=True)
    return np.trunc(raw * (1 << _BITS) + np.copysign(0.5, raw)).astype(np.int64)


def _resized_rows(pixels: np.ndarray, width: int) -> np.ndarray:
    weights = _weights(pixels.shape[1], width)
    summed = np.einsum("hxc,wx->hwc", pixels.astype(np.int64), weights) + (1 << (_BITS - 1))
    return np.clip(summed >> _BITS, 0, 255).astype(np.uint8)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size; a side that stays is left alone."""
    if pixels.shape[1] != width:
        pixels = _resized_rows(pixels, width)
    if pixels.shape[0] != height:
        pixels = _resized_rows(pixels.transpose(1, 0, 2), height).transpose(1, 0, 2)
    return np.ascontiguousarray(pixels)


def half_detail(pixels: np.ndarray) -> np.ndarray:
    """The image shrunk to half its sides, at least 1 pixel, and brought back to its size."""
    height, width, _ = pixels.shape
    return resized(resized(pixels, max(1, width // 2), max(1, height // 2)), width, height)


#: What can be done to an image; the size stays.
PERTURBATIONS = {"clean": np.copy, "half_detail": half_detail, "white": white_like}


def perturbed(data: bytes, kind: str) -> tuple[bytes, dict[str, object]]:
    """The changed PNG, and what was done: sizes and the digests of both files.  An unknown kind raises."""
    if kind not in PERTURBATIONS:
        raise ValueError(f"unknown perturbation {kind!r}; expected one of {sorted(PERTURBATIONS)}")
    pixels = decode_png(data)
    out = PERTURBATIONS[kind](pixels)
    files = [encode_png(x) for x in (pixels, out)]
    size = [pixels.shape[1], pixels.shape[0]]
    digests = [hashlib.sha256(x).hexdigest() for x in files]
    return files[1], {"perturbation_id": kind, "original_size": size, "pre_model_size": [out.shape[1], out.shape[0]], "source_rgb_png_sha256": digests[0], "transformed_rgb_png_sha256": digests[1]}


def tile_shape(width: int, height: int, most: int, size: int = 448) -> tuple[int, int]:
    """(columns, rows) of the nearest aspect ratio; see :func:`docgauge.functions.geometry.tile_grid`."""
    best, gap = (1, 1), float("inf")
    for columns, rows in tile_ratios(most):
        off = abs(width / height - columns / rows)
        if off < gap or (off == gap and width * height > 0.5 * size * size * columns * rows):
            best, gap = (columns, rows), off
    return best


def tiles(pixels: np.ndarray, most: int, size: int = 448, *, thumbnail: bool = True) -> list[np.ndarray]:
    """Square tiles of an image, row by row, and a thumbnail if there are several."""
    height, width, _ = pixels.shape
    columns, rows = tile_shape(width, height, most, size)
    grid = resized(pixels, columns * size, rows * size)
    cut = [grid[r * size : (r + 1) * size, c * size : (c + 1) * size] for r in range(rows) for c in range(columns)]
    return [*cut, resized(pixels, size, size)] if thumbnail and len(cut) > 1 else cut


def image_tiles(images: DataFrame, key: str, content: str, most: int, size: int = 448) -> DataFrame:
    """(key, tile, png, rgb_digest): the tiles of each PNG, one row each.

    Null and unreadable images have none.
    """
    kind = images.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch[key], batch[content]):
                pixels = _readable(data)
                if pixels is not None:
                    found = tiles(pixels, most, size)
                    yield pd.DataFrame({key: [name] * len(found), "tile": range(len(found)), "png": [encode_png(t) for t in found], "rgb_digest": [pixel_digest(t) for t in found]})

    return images.select(key, content).mapInPandas(cut, f"`{key}` {kind}, tile int, png binary, rgb_digest string")


def _readable(data) -> np.ndarray | None:
    try:
        return decode_png(bytes(data))
    except (ValueError, TypeError, zlib.error, struct.error):
        return None


def png_size(content: Column) -> Column:
    """struct(width, height) from the head of a PNG, without decoding it; null for other bytes."""
    head = F.hex(F.substring(content, 1, 24))
    side = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    return F.when(head.startswith(_SIGNATURE.hex().upper()) & (F.length(head) == 48), F.struct(side(33).alias("width"), side(41).alias("height")))


def audited_images(examples: DataFrame, files: DataFrame, path: str, png: str, rgb: str) -> DataFrame:
    """``examples`` with ``image_state``: ok, missing, corrupt, mismatch or repaired_ok.

    ``files`` has path and content.  A file whose bytes are not those expected
    but whose pixels are is as good as repaired: its own digest is in
    ``actual_png``.  Where nothing is expected a readable file is ok.
    """
    read = files.select(F.col("path").alias(path), F.sha2("content", 256).alias("actual_png"), rgb_digest(F.col("content")).alias("__rgb"))
    same_png, same_rgb = F.col(png) == F.col("actual_png"), F.col(rgb) == F.col("__rgb")
    state = (
        F.when(F.col("actual_png").isNull(), "missing")
        .when(F.col("__rgb").isNull(), "corrupt")
        .when(F.coalesce(same_png, F.lit(False)) | (F.col(png).isNull() & F.col(rgb).isNull()), "ok")
        .when(F.coalesce(same_rgb, F.lit(False)), "repaired_ok")
        .otherwise("mismatch")
    )
    return examples.join(read, path, "left").withColumn("image_state", state).drop("__rgb")


def materialise(images: DataFrame, key: str, content: str, store: str) -> None:
    """Appends to ``store`` the images it lacks, as RGB PNGs with their digests.

    An image is there if the store has its key with the same pixels, so a job
    that was cut off goes on where it stopped, and changed pixels are added.
    Null and unreadable images are left out.
    """
    kind = images.schema[key].dataType.simpleString()

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch[key], batch[content]):
                if (pixels := _readable(data)) is not None:
                    png = encode_png(pixels)
                    rows.append((name, pixel_digest(pixels), hashlib.sha256(png).hexdigest(), png))
            yield pd.DataFrame(rows, columns=[key, "rgb_digest", "png_sha256", "png"])

    made = images.select(key, content).mapInPandas(rewrite, f"`{key}` {kind}, rgb_digest string, png_sha256 string, png binary")
    append_records(made, store, [key, "rgb_digest"], order=["png_sha256"])


def rgb_digest(content: Column) -> Column:
    """Pixel digest of PNG bytes; null for null or unreadable ones."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data):
            pixels = _readable(data)
            return None if pixels is None else pixel_digest(pixels)

        for batch in batches:
            yield batch.map(one).astype(object)

    return digest(content)
