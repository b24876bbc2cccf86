"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE in tiktoken's format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(raw: bytes):
    """The encoding of a vocabulary file, built once for each Python process."""
    import tiktoken

    held = sys.modules.setdefault("_docgauge_encodings", type(sys)("_docgauge_encodings"))
    name = hashlib.sha256(raw).hexdigest()
    if not hasattr(held, name):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        setattr(held, name, tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return getattr(held, name)


def token_counts(texts: DataFrame, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``texts`` with ``tokens`` in place of the column ``text``.

    Whole texts are encoded; strings of special tokens are ordinary text.
    Null and empty texts have 0 tokens.  The vocabulary file is read on the
    driver and broadcast: its size does not depend on the data.
    """
    raw = texts.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = [c for c in texts.columns if c != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(raw.value).encode_ordinary
        for batch in batches:
            batch["tokens"] = [len(encode(t)) if t else 0 for t in batch[text]]
            yield batch[[*names, "tokens"]]

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.select(*names, F.col(text)).mapInPandas(count, f"{kinds}{', ' if kinds else ''}tokens long")
