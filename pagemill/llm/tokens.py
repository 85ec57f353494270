"""Public tokenizers for Arrow batches: the vocabulary file is read once by the driver and broadcast (under 1 MB)."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the byte-level vocabulary lies; every operator takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BUILT: dict[int, tuple] = {}


def encoder(raw: bytes):
    """``(encoding, bytes per token id)``, built once in each Python worker."""
    key = hash(raw)
    if key not in _BUILT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _BUILT[key] = (tiktoken.Encoding("pagemill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _BUILT[key]


def shared_vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of each text; null for a null text, 0 for an empty one."""
    raw = shared_vocabulary(df.sparkSession, path)

    def run(batches):
        encoding, _ = encoder(raw.value)
        for b in batches:
            yield b.assign(**{name: [None if t is None else len(encoding.encode_ordinary(t)) for t in b[text]]}).astype({name: "Int64"}).drop(columns=[text])

    kept = [f for f in df.schema.fields if f.name != text]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` bigint"
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).mapInPandas(run, ddl)
