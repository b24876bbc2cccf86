"""Items of varying length in containers of fixed capacity, balanced by cost.

The cost of an item is linear plus quadratic in its tokens, as attention's is.
Items, longest first, go to the open container of the lowest cost that still
has room; at the end thin containers are emptied into the gaps of others, as
long as none becomes dearer than the dearest is.  Items are spread over shards
of bounded size by the bits of a hash, and shards are packed independently, so
the work grows in proportion to the items.  The number of shards is a power of
two: as the items double each shard falls into two, and no other item moves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of an item of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Pieces in a shard, roughly.  A shard wastes at most part of a container
#: more than one run over all items would.
SHARD_PIECES = 5_000


def cost_of(tokens: Column) -> Column:
    return F.lit(LINEAR) * tokens + F.lit(QUADRATIC) * tokens * tokens


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; ``sizes`` are descending and at most ``capacity``."""
    n = len(sizes)
    placed = np.full(n, -1)
    full = int(np.searchsorted(-sizes, -capacity, side="right"))
    placed[:full] = np.arange(full)
    loose = sizes[full:]
    if not len(loose):
        return placed
    cost = LINEAR * loose + QUADRATIC * loose.astype(float) ** 2
    room = np.zeros(len(loose), dtype=np.int64)
    load = np.full(len(loose), np.inf)
    opened = max(1, -(-int(loose.sum()) // capacity))
    opened = min(opened, len(loose))
    room[:opened], load[:opened] = capacity, 0.0
    home = np.empty(len(loose), dtype=np.int64)
    for i, size in enumerate(loose):
        fits = np.where(room[:opened] >= size, load[:opened], np.inf)
        k = int(fits.argmin())
        if fits[k] == np.inf:
            k = opened
            room[k], load[k] = capacity, 0.0
            opened += 1
        room[k] -= size
        load[k] += cost[i]
        home[i] = k
    _empty_thin(loose, cost, home, room, load, opened, capacity)
    placed[full:] = full + np.unique(home, return_inverse=True)[1]
    return placed


def _empty_thin(sizes: np.ndarray, cost: np.ndarray, home: np.ndarray, room: np.ndarray, load: np.ndarray, opened: int, capacity: int) -> None:
    """Dissolves containers, the emptiest first, while all their items fit into gaps of others.

    An item goes to the cheapest container with room, or, where that fails, to
    the tightest gap; none becomes dearer than the dearest was before.
    """
    least = -(-int(sizes.sum()) // capacity)
    dearest = load[:opened].max()
    order = np.argsort(-room[:opened], kind="stable")
    members: dict[int, list[int]] = {}
    for i, k in enumerate(home):
        members.setdefault(int(k), []).append(i)
    room[opened:] = -1
    left = opened
    for k in map(int, order):
        if left <= least:
            return
        for by in (load, room):
            saved, moved = (room.copy(), load.copy()), []
            room[k] = -1
            for i in members.get(k, []):
                open_ = (room[:opened] >= sizes[i]) & (load[:opened] + cost[i] <= dearest)
                gaps = np.where(open_, by[:opened], np.inf)
                t = int(gaps.argmin())
                if gaps[t] == np.inf:
                    break
                room[t] -= sizes[i]
                load[t] += cost[i]
                moved.append((i, t))
            else:
                for i, t in moved:
                    home[i] = t
                    members[t].append(i)
                members[k], load[k] = [], np.inf
                left -= 1
                break
            room[:], load[:] = saved


def pack_items(items: DataFrame, item: str, tokens: str, windows: list[tuple[str, int]], *, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The container of each piece of each item, for every (name, capacity) of ``windows``.

    Columns: window_name, shard, container (unique within window and shard),
    the item, piece, token_from, tokens.  Items above the capacity are cut
    into pieces of exactly the capacity and a rest; no other item is divided.
    Items with null or no tokens take no room and are left out.  The order of
    items of equal length is that of ``item``; an empty table gives no rows.
    """
    kept = items.where(F.col(tokens) > 0).select(item, F.col(tokens).cast("long").alias("size"))
    listed = F.array(*[F.struct(F.lit(name).alias("window_name"), F.lit(int(c)).cast("long").alias("capacity")) for name, c in windows])
    wide = kept.select("*", F.explode(listed).alias("w")).select(item, "size", "w.*")
    cut_at = F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div capacity"))
    pieces = wide.select("window_name", "capacity", item, "size", F.explode(cut_at).alias("piece")).select(
        "window_name", "capacity", item, F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity")).alias("token_from"),
        F.least("capacity", F.col("size") - F.col("piece") * F.col("capacity")).alias("tokens"),
    )
    bits = max(0, math.ceil(math.log2(max(1, kept.count()) / shard_pieces)))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(item, "piece"), F.lit(1 << bits)).cast("int"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", item, "piece"], ascending=[False, True, True], kind="stable")
        group["container"] = pack(group["tokens"].to_numpy(), int(group["capacity"].iloc[0]))
        return group[["window_name", "shard", "container", item, "piece", "token_from", "tokens"]]

    kind = items.schema[item].dataType.simpleString()
    return pieces.groupBy("window_name", "shard").applyInPandas(fill, f"window_name string, shard int, container long, `{item}` {kind}, piece int, token_from long, tokens long")
