"""Oversized texts to pieces under a token limit by content-defined chunking.

A rolling hash over the bytes gives landmarks that depend on nothing but the bytes just before them. A cut is a landmark
snapped to the nearest natural boundary between the least and the greatest size, so an edit moves only the cuts near
it. Consecutive pieces share a given number of tokens.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tokens import VOCABULARY, encoder, shared_vocabulary
from pagemill.session import broadcast_if_small

WINDOW = 16
_GEAR = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
#: Natural ends by strength: paragraph, line, sentence, clause or word.
_CLOSING = "(?:[\"')\\]]|”|’|）)*"
_ENDS = (
    (4, re.compile(rb"\r?\n[ \t]*\r?\n\s*")),
    (3, re.compile(rb"\r?\n")),
    (2, re.compile(f"[.!?;]{_CLOSING}(?=\\s)|(?:。|！|？|；){_CLOSING}".encode())),
    (1, re.compile(r"(?<!\s)(?=\s)|，|、|：".encode())),
)


def landmarks(data: np.ndarray, bits: int) -> np.ndarray:
    """Positions after whose last ``WINDOW`` bytes the rolling hash has ``bits`` leading zeros."""
    mapped = _GEAR[data]
    h = np.zeros(len(data), dtype=np.uint64)
    for k in range(min(WINDOW, len(data))):
        h[k:] += mapped[: len(data) - k] << np.uint64(k)
    return np.flatnonzero((h << np.uint64(64 - 48)) >> np.uint64(64 - bits) == 0) + 1


def natural_ends(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of natural ends, ascending, and their strengths (the strongest where several fall together)."""
    strength: dict[int, int] = {}
    for level, pattern in reversed(_ENDS):
        for m in pattern.finditer(raw):
            strength[m.end()] = level
    at = np.array(sorted(strength), dtype=np.int64)
    return at, np.array([strength[p] for p in at], dtype=np.int8)


def split_text(text: str, raw_vocabulary: bytes, max_tokens: int, overlap_tokens: int, least_share: float = 0.5) -> list[tuple[int, int, int, int]]:
    """``(start, end, core start, tokens)`` of each piece, in code points; one piece if the text fits.

    Every piece has at most ``max_tokens`` tokens when it is tokenized by itself. Its core starts where the one before
    ends; before the core lie ``overlap_tokens`` tokens of the piece before (up to three more where a token begins
    within a character). An overlap of the limit or more is cut to half of the limit.
    """
    encoding, lengths = encoder(raw_vocabulary)
    ids = encoding.encode_ordinary(text)
    if len(ids) <= max_tokens:
        return [(0, len(text), 0, len(ids))]
    max_tokens = max(int(max_tokens), 4)
    overlap = max(0, min(int(overlap_tokens), max_tokens // 2))
    raw = text.encode("utf-8")
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths[np.array(ids)])])  # byte position of each token, and the end
    heads = np.concatenate([(data & 0xC0) != 0x80, [True]])  # bytes that begin a character
    chars = np.concatenate([[0], np.cumsum(heads[:-1])])  # code points before each byte
    clean = heads[starts]  # tokens that begin with a character
    ends, strength = natural_ends(raw)
    end_token = np.searchsorted(starts, ends)
    exact = starts[np.minimum(end_token, len(starts) - 1)] == ends  # boundaries between tokens only
    end_token, strength = end_token[exact], strength[exact]
    total = len(ids)
    bits = max(2, int(np.log2(max_tokens * 3 / 8)))
    marks = np.unique(np.searchsorted(starts, landmarks(data, bits)))

    def clean_at(token: int, least: int) -> int:
        """The nearest token at or before ``token``, from ``least`` on, that begins with a character, else the next one."""
        at = token
        while at > least and not clean[at]:
            at -= 1
        while at < total and not clean[at]:
            at += 1
        return at

    def cut(core: int, low: int, high: int) -> int:
        inside = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, side="right")]
        aim = int(inside[0]) if len(inside) else high
        a, b = np.searchsorted(end_token, low), np.searchsorted(end_token, high, side="right")
        near, level = end_token[a:b], strength[a:b]
        reach = max(8, (high - low) // 4)
        for wanted, far in ((4, reach), (3, reach), (2, high), (1, high)):
            at = near[(level >= wanted) & (np.abs(near - aim) <= far)]
            if len(at):
                return int(at[np.argmin(np.abs(at - aim))])
        return clean_at(aim, core + 1)

    pieces, core = [], 0
    while core < total:
        first = core if core == 0 else clean_at(core - overlap, 0)
        room = max_tokens - (core - first)
        high = min(total, core + room)
        while True:
            end = total if high >= total else cut(core, min(core + max(1, int(room * least_share)), high), high)
            end = clean_at(max(end, core + 1), core + 1)
            part = raw[starts[first] : starts[end]].decode("utf-8", "ignore")
            n = len(encoding.encode_ordinary(part))
            lower = max(core + 1, min(high, end) - max(1, n - max_tokens))
            if n <= max_tokens or clean_at(lower, core + 1) >= end:
                break
            high = lower
        pieces.append((int(chars[starts[first]]), int(chars[starts[end]]), int(chars[starts[core]]), n))
        core = end
    return pieces


def split_documents(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts over their source's limit: ``key, piece_no, n_pieces, start_char, core_char, end_char, n_tokens, text``.

    A byte-level token has at least one byte, so texts of no more bytes than the limit are not tokenized at all; the
    rest goes to Python in Arrow batches, without any shuffle.

    Defined results: null and empty texts, and sources without a limit (or a null one), are not cut; several limits of
    a source count as the least one; texts without natural boundaries are cut at landmarks or at the limit; the
    pieces' cores put together are the text; repeated keys are cut row by row; other columns do not matter.
    """
    raw = shared_vocabulary(documents.sparkSession, path)
    per_source = limits.where(F.col("source").isNotNull() & (F.col("max_tokens") > 0)).groupBy(F.col("source").alias("__source")).agg(F.min(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))).alias("__limit"))
    per_source = broadcast_if_small(per_source, per_source.count())
    wide = (
        documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(source).alias("__source"))
        .join(per_source, "__source").where(F.octet_length("__text") > F.col("__limit.max_tokens"))
        .select("__key", "__text", F.col("__limit.max_tokens").alias("__max"), F.col("__limit.overlap_tokens").alias("__overlap"))
    )

    def run(batches):
        vocabulary = raw.value
        for b in batches:
            out = []
            for k, t, most, overlap in b.itertuples(index=False):
                pieces = split_text(t, vocabulary, most, overlap)
                if len(pieces) > 1:
                    out += [(k, i, len(pieces), s, c, e, n, t[s:e]) for i, (s, e, c, n) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["k", "piece_no", "n_pieces", "start_char", "core_char", "end_char", "n_tokens", "text"])

    kind = documents.schema[key].dataType.simpleString()
    return wide.mapInPandas(run, f"k {kind}, piece_no int, n_pieces int, start_char int, core_char int, end_char int, n_tokens int, text string").withColumnRenamed("k", key)
