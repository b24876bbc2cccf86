"""Digests that bind results to their inputs."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Mapping
from types import ModuleType

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(*columns: Column) -> Column:
    """Digest of a row's values; nulls differ from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def json_digest(fields: Mapping[str, Column]) -> Column:
    """Digest of a row's fields as compact JSON with sorted keys; null fields are written, as null.

    For strings, booleans and integers it equals :func:`canonical_json_digest`
    of the same values without a newline.
    """
    parts: list[Column] = []
    for name in sorted(fields):
        # an array of one value is written with the value's own JSON
        written = F.regexp_replace(F.to_json(F.array(fields[name])), r"^\[|\]$", "")
        parts.append(F.concat(F.lit(json.dumps(name) + ":"), F.when(fields[name].isNull(), "null").otherwise(written)))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


#: Fields of the settings that decide an inference (fixed values).
INFERENCE_FIELDS = (
    "model_id", "model_revision", "manifest_content_sha256", "instruction", "max_new_tokens", "do_sample", "prefer_bf16", "seed", "config_path", "config_sha256",
    "resolved_dtype", "processor_settings", "software", "inference_source_hashes", "adapter_dir", "adapter_config_sha256", "adapter_weights_sha256", "train_update", "perturbation",
)
#: Versions of what is digested (fixed values).
INFERENCE_SCHEMA, SCORING_SCHEMA = "inference_v2", "scoring_v2"
#: Those fields that may be left out.
OPTIONAL_FIELDS = ("adapter_dir", "adapter_config_sha256", "adapter_weights_sha256", "train_update", "perturbation")


def inference_fingerprint(**settings: object) -> dict:
    """The settings of an inference with their digest; an unknown or a missing field raises.

    Fields that may be left out are null then, and count all the same.
    """
    unknown = sorted(set(settings) - set(INFERENCE_FIELDS))
    missing = [f for f in INFERENCE_FIELDS if f not in settings and f not in OPTIONAL_FIELDS]
    if unknown or missing:
        raise ValueError(f"unknown fields {unknown}, missing fields {missing}")
    return fingerprint({**{f: settings.get(f) for f in INFERENCE_FIELDS}, "fingerprint_schema": INFERENCE_SCHEMA})


def scoring_provenance(primary: str, answers_sha256: str, scorer_sha256: str) -> dict:
    """What a score depends on beside the predictions."""
    return {"primary_metric": primary, "answer_sidecar_sha256": answers_sha256, "scorer_source_sha256": scorer_sha256, "scoring_schema": SCORING_SCHEMA}


def source_digest(*modules: ModuleType) -> str:
    """Digest of the source of modules, such as those that score, in the order given."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def canonical_json_digest(document: Mapping, *, drop: tuple[str, ...] = (), newline: bool = True, ascii_only: bool = False) -> str:
    """Driver side: digest of compact JSON with sorted keys, less the fields in ``drop``."""
    kept = {k: v for k, v in document.items() if k not in drop}
    body = json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only) + ("\n" if newline else "")
    return hashlib.sha256(body.encode()).hexdigest()


def verified(document: Mapping, field: str = "manifest_sha256", *, raw: bytes | None = None) -> dict[str, object]:
    """Whether a document's stored digest is that of its content; ``raw`` are the bytes of its file."""
    stored, actual = document.get(field), canonical_json_digest(document, drop=(field,))
    return {"ok": stored == actual, "stored": stored, "actual": actual, "raw": None if raw is None else hashlib.sha256(raw).hexdigest()}


def fingerprint(settings: Mapping) -> dict:
    """The settings of a run with their digest."""
    return {**settings, "run_fingerprint_sha256": canonical_json_digest(settings, newline=False)}


def hashed(seed: str | int, *parts: Column) -> Column:
    """Seeded digest by which rows are shuffled the same way everywhere."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hashed_index(digest: Column, size: Column) -> Column:
    """A number below ``size`` from a digest's first 60 bits."""
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)
