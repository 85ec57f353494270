"""Passages of held-out items in a corpus, by latent semantic retrieval.

Texts become streams of folded words and single Chinese characters. A distributed randomised SVD of TF-IDF passages
gives a latent space; overlapping windows of every document are compared there with windows of the items, and pairs
above a low cosine are checked for a common run of words, or for a long common subsequence and the item's answers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.lookalike import TABLES
from pagemill.session import materialize, partitions_for

_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(TABLES["text"]) if c < 0x10000) + "\u0300-\u036f]")
_WORD = re.compile(r"[a-zà-ɏ0-9]+|[一-鿿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Kind:
    """How passages of one language are cut: a shared run has ``run`` tokens, windows are two blocks of ``run``."""

    name: str
    run: int
    han: int  # 1: windows of Chinese characters, 0: of words


KINDS = (Kind("en", 12, 0), Kind("zh", 20, 1))


@dataclass(frozen=True)
class Settings:
    """Fixed sizes of the method; none of them changes with the data.

    ``features``: TF-IDF columns (hashed words); ``rank``: latent dimensions; ``fit_passages``: the bound of the hash
    sample of passages on which the SVD is fitted (every passage is indexed and searched); ``cosine``: candidates.
    """

    features: int = 8192
    rank: int = 64
    oversample: int = 8
    fit_passages: int = 16_000
    cosine: float = 0.45
    paraphrase_cosine: float = 0.8
    paraphrase_share: float = 0.75
    items_per_block: int = 4_000
    bytes_per_block: int = 16_000_000


def words(text: str) -> list[str]:
    """Folded words, numbers and single Chinese characters; case, signs, tags, accents' form and line breaks are gone."""
    if not text.isascii() and (_ODD.search(text) or max(text) > "\uffff"):
        text = unicodedata.normalize("NFC", text.translate(TABLES["text"]))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


class _Codes(dict):
    """Word to a 32-bit code whose lowest bit says whether it is a Chinese character."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        code = max(2, xxhash.xxh32_intdigest(word) & 0xFFFFFFFE) | ("一" <= word <= "鿿")
        self[word] = code
        return code


_CODES = _Codes()


def encode(text: str) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, words(text)), dtype=np.uint32)


def token_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tok``: the coded words of each text, once for all later passes."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"k": b["__k"], "tok": [encode(t).tobytes() for t in b["__t"]]})

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    return materialize(rows.mapInPandas(run, f"k {kind}, tok binary"), "words")


def _columns(tok: np.ndarray, features: int) -> np.ndarray:
    return ((tok >> np.uint32(1)) % np.uint32(features)).astype(np.int64)


def _padded(table: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``table`` with a row of zeros at its end, and the row of each token; the zeros between texts get that row."""
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), dtype=table.dtype)]), np.where(tok == 0, len(table), _columns(tok, len(table)))


def document_frequencies(tokens: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """Documents per column and documents in all, over every document; one row per column and task is shuffled."""

    def run(batches):
        counts, n = np.zeros(features, dtype=np.int64), 0
        for b in batches:
            for raw in b["tok"]:
                counts[np.unique(_columns(np.frombuffer(raw, dtype=np.uint32), features))] += 1
                n += 1
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"c": np.append(used, -1), "n": np.append(counts[used], n)})

    found = tokens.select("tok").mapInPandas(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(features, dtype=np.int64)
    body = found[found["c"] >= 0]
    df[body["c"].to_numpy(dtype=np.int64)] = body["n"].to_numpy(dtype=np.int64)
    return df, int(found.loc[found["c"] < 0, "n"].sum())


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Many texts as one array with zeros between, so that no window or run reaches from one into the next.

    Returns the array and the start of each text; starts are multiples of every window step.
    """
    step = math.lcm(*(k.run for k in KINDS))
    gap = 2 * max(k.run for k in KINDS)
    room = np.array([-(-(len(t) + gap) // step) * step for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(room)])
    whole = np.zeros(int(begins[-1]), dtype=np.uint32)
    for t, at in zip(texts, begins.tolist()):
        whole[at : at + len(t)] = t
    return whole, begins[:-1]


def laid_out_batches(raws, tokens_at_once: int = 400_000):
    """Slices of a column of coded texts, laid out: ``(first, array, begins)``."""
    texts, first, size = [], 0, 0
    for i, raw in enumerate(raws):
        texts.append(np.frombuffer(raw, dtype=np.uint32))
        size += len(texts[-1]) + 60
        if size >= tokens_at_once:
            yield first, *laid_out(texts)
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, *laid_out(texts)


def _windows(tok: np.ndarray, kind: Kind) -> np.ndarray:
    """First tokens of the windows of ``2 * run`` tokens with at least ``run`` tokens of the kind."""
    n, block = len(tok), kind.run
    if not n:
        return np.zeros(0, dtype=np.int64)
    starts = np.arange(0, n, block)
    same = ((tok & np.uint32(1)) == kind.han) & (tok != 0)
    in_block = np.add.reduceat(same, starts, dtype=np.int64)
    return starts[(in_block + np.append(in_block[1:], 0) >= block) & (tok[starts] != 0)]


def _projected(tok: np.ndarray, starts: np.ndarray, block: int, table: np.ndarray) -> np.ndarray:
    """Sums of ``table`` rows over the windows of two blocks that begin at ``starts``, as rows of unit length."""
    rows, columns = _padded(table, np.append(tok, np.zeros(2 * block - len(tok) % block, dtype=tok.dtype)))
    columns = columns.reshape(-1, block)
    first = starts // block
    needed = np.unique(np.concatenate([first, first + 1]))
    sums = np.empty((len(needed), table.shape[1]), dtype=np.float32)
    for i in range(0, len(needed), 512):  # never more than this at once
        picked = columns[needed[i : i + 512]]
        total = rows[picked[:, 0]]
        for j in range(1, block):
            total += rows[picked[:, j]]
        sums[i : i + 512] = total
    out = sums[np.searchsorted(needed, first)] + sums[np.searchsorted(needed, first + 1)]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def _gram_product(tok: np.ndarray, starts: np.ndarray, length: int, idf: np.ndarray, q: np.ndarray, into: np.ndarray) -> None:
    """Adds ``X' X q`` of the unit-length TF-IDF windows of one text to ``into``."""
    for i in range(0, len(starts), 4096):
        at = starts[i : i + 4096][:, None] + np.arange(length)[None, :]
        here = np.minimum(at, len(tok) - 1)
        cols = _columns(tok, len(idf))[here]
        x = np.where((at < len(tok)) & (tok[here] != 0), idf[cols], 0).astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        y = np.einsum("nl,nlk->nk", x, q[cols], optimize=True)
        order = np.argsort(cols, axis=None, kind="stable")
        sorted_cols = cols.ravel()[order]
        firsts = np.flatnonzero(np.concatenate([[True], sorted_cols[1:] != sorted_cols[:-1]]))
        rows = order // length
        contributions = x.ravel()[order][:, None] * y[rows]
        into[sorted_cols[firsts]] += np.add.reduceat(contributions, firsts, axis=0)


def latent_space(tokens: DataFrame, items: list[np.ndarray], idf: np.ndarray, n_documents: int, s: Settings) -> np.ndarray:
    """``features x rank``: right singular vectors of the TF-IDF passages, times the weights of the columns.

    Randomised SVD with one power step: two distributed passes give ``X'X`` times a thin matrix, of which every task
    sends one block per 1,024 columns; only the thin matrix itself (features x rank) reaches the driver.
    """
    spark = tokens.sparkSession
    thin = s.rank + s.oversample
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((s.features, thin)))[0].astype(np.float32)
    # a bounded hash sample: about fit_passages windows, at an average of eight windows a document
    wanted = max(1, s.fit_passages // 8)
    share = min(1.0, wanted / max(n_documents, 1))
    sample = tokens.where(F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("tok")
    sample = materialize(sample.repartition(partitions_for(spark, min(n_documents, wanted), 10**9)), "svd-sample")

    def product(q: np.ndarray) -> np.ndarray:
        shared, block = spark.sparkContext.broadcast((q, idf.astype(np.float32))), 1024

        def run(batches):
            q, weights = shared.value
            into = np.zeros_like(q)
            for b in batches:
                for _, tok, _ in laid_out_batches(b["tok"]):
                    for kind in KINDS:
                        _gram_product(tok, _windows(tok, kind), 2 * kind.run, weights, q, into)
            yield pd.DataFrame({"part": range(0, len(into), block), "m": [into[i : i + block].tobytes() for i in range(0, len(into), block)]})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(m, dtype=np.float32).astype(np.float64) for m in group["m"])
            return pd.DataFrame({"part": [group["part"].iloc[0]], "m": [total.astype(np.float32).tobytes()]})

        parts = sample.mapInPandas(run, "part int, m binary").groupBy("part").applyInPandas(add, "part int, m binary").toPandas().sort_values("part")
        z = np.concatenate([np.frombuffer(m, dtype=np.float32) for m in parts["m"]]).reshape(q.shape).copy()
        for tok in items:
            for kind in KINDS:
                _gram_product(tok, _windows(tok, kind), 2 * kind.run, idf.astype(np.float32), q, z)
        shared.destroy()
        return z

    q = np.linalg.qr(product(q))[0].astype(np.float32)
    z = product(q)
    values, vectors = np.linalg.eigh(q.T @ z)
    v = q @ vectors[:, np.argsort(values)[::-1][: s.rank]]
    return (idf[:, None] * v).astype(np.float32)


def _run_hashes(tok: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of each run of ``run`` tokens."""
    n = len(tok) - run + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(run):
        h = h * np.uint64(1099511628211) + tok[k : k + len(h)].astype(np.uint64)
    return h ^ (h >> np.uint64(31))


@dataclass
class _Query:
    """What a task needs of the items of one kind: windows in latent space, runs, tokens and answers."""

    owners: np.ndarray  # index of the item of each window
    latent: np.ndarray
    keys: np.ndarray  # sorted hashes of (item, run)
    ids: list
    tokens: list[np.ndarray]
    answers: list[list[np.ndarray]]


def _keyed(hashes: np.ndarray, item: np.ndarray | int) -> np.ndarray:
    return hashes ^ (np.atleast_1d(np.asarray(item, dtype=np.uint64)) + np.uint64(1)) * _MIX


_ANSWER = re.compile(r"(?:^|[\s(])[A-H][).:：]\s*(.+?)(?=\s+[A-H][).:：]|\n|$)")


def _queries(items: list[tuple], table: np.ndarray) -> dict[str, _Query]:
    out = {}
    for kind in KINDS:
        owners, latent, keys, ids, toks, answers = [], [], [], [], [], []
        for item_id, text, _, tok in (x for x in items if x[2] == kind.name):
            if len(tok) < kind.run:
                continue
            i = len(ids)
            ids.append(item_id)
            toks.append(tok)
            answers.append([encode(a) for a in _ANSWER.findall(text)])
            starts = np.arange(0, max(len(tok) - kind.run, 1), kind.run)
            latent.append(_projected(tok, starts, kind.run, table))
            owners += [i] * len(starts)
            keys.append(_keyed(_run_hashes(tok, kind.run), i))
        if ids:
            out[kind.name] = _Query(np.array(owners), np.concatenate(latent), np.unique(np.concatenate(keys)), ids, toks, answers)
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for i, t in enumerate(a.tolist()):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b.tolist():
        u = v & places.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _holds(tok: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(tok):
        return False
    return bool(np.lib.stride_tricks.sliding_window_view(tok, len(part)).__eq__(part).all(axis=1).any())


def _search(tok: np.ndarray, begins: np.ndarray, kind: Kind, query: _Query, table: np.ndarray, s: Settings, paraphrases: bool) -> dict[tuple[int, int], tuple]:
    """What passages of laid-out texts show: ``(text, item)`` to ``(verbatim, cosine, share of the subsequence, answer)``."""
    found: dict[tuple[int, int], tuple] = {}
    starts = _windows(tok, kind)
    if not len(starts):
        return found
    hashes = _run_hashes(tok, kind.run)
    text_of = np.searchsorted(begins, starts, side="right") - 1
    vectors = _projected(tok, starts, kind.run, table)
    latent = np.ascontiguousarray(query.latent.T)
    for at in range(0, len(starts), 384):
        cosines = vectors[at : at + 384] @ latent
        w, q = np.divmod(np.flatnonzero(cosines >= s.cosine), cosines.shape[1])
        if not len(w):
            continue
        pair = np.unique(w * len(query.ids) + query.owners[q])
        w, item = pair // len(query.ids) + at, pair % len(query.ids)
        places = starts[w][:, None] + np.arange(kind.run + 1)[None, :]  # every run within the window
        inside = places < len(hashes)
        keys = _keyed(hashes[np.minimum(places, len(hashes) - 1)], item[:, None])
        spot = np.minimum(np.searchsorted(query.keys, keys), len(query.keys) - 1)
        verbatim = ((query.keys[spot] == keys) & inside).any(axis=1)
        for t, i in zip(text_of[w[verbatim]].tolist(), item[verbatim].tolist()):
            found[t, i] = (True, 1.0, 1.0, False)
        if paraphrases:
            for r, c in zip(*(x.tolist() for x in np.nonzero(cosines >= s.paraphrase_cosine))):
                t, i, begin = int(text_of[at + r]), int(query.owners[c]), int(starts[at + r])
                old = found.get((t, i), (False, 0.0, 0.0, False))
                passage = tok[begin : begin + 2 * kind.run]
                passage = passage[passage != 0]
                if old[0] or not len(passage):
                    continue
                share = common_subsequence(passage, query.tokens[i]) / len(passage)
                if share >= s.paraphrase_share and (share, float(cosines[r, c])) > (old[2], old[1]):
                    around = tok[max(int(begins[t]), begin - 200) : begin + 200]
                    found[t, i] = (False, float(cosines[r, c]), share, any(_holds(around, x) for x in query.answers[i]))
    return found


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", paraphrases: bool = False, settings: Settings = Settings()) -> DataFrame:
    """``item_key, key, kind, cosine, common_share, answer_found`` of each item and document that share a passage.

    ``kind`` is ``verbatim`` for a common run (12 words of an English item, 20 characters of a Chinese one), else, if
    asked for, ``paraphrase``: a passage of high cosine most of whose words, in their order, are in the item.

    Items are a stated query set; they are searched in blocks of bounded number and bytes, one after the other, against all
    windows of all documents. Documents are never joined with each other or shuffled: the words are written once, then
    follow a pass for document frequencies, the SVD on a hash sample of documents and of all items, and one pass a block.

    Defined results: null keys, null or empty texts and texts shorter than a run give no row; items of other languages
    are read as English unless most of their words are Chinese characters; repeated documents are reported under each
    id, a repeated id and item once; an empty side gives no rows; other columns do not matter.
    """
    spark = documents.sparkSession
    key_kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"item {item_kind}, doc {key_kind}, kind string, cosine double, common_share double, answer_found boolean"
    asked = items.where(F.col(item_key).isNotNull() & (F.length(text) > 0)).select(F.col(item_key).alias("i"), F.col(text).alias("t")).distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(math.ceil(size["n"] / settings.items_per_block), math.ceil(size["bytes"] / settings.bytes_per_block))
    block_of = F.pmod(F.xxhash64("i"), F.lit(max(n_blocks, 1)))
    tokens = token_table(documents, key, text)
    df, n = document_frequencies(tokens, settings.features)
    idf = np.log1p(n / np.maximum(df, 1)).astype(np.float32)
    found = spark.createDataFrame([], schema)
    if n and n_blocks:
        # the items' part of the fit is a hash sample of all of them, as large as one block
        sampled = asked.where(F.pmod(F.xxhash64(F.lit(3), "i"), F.lit(n_blocks)) == 0).orderBy("i").collect()
        table = latent_space(tokens, [encode(r["t"]) for r in sampled], idf, n, settings)
        for block in range(n_blocks):  # one block of items is held at a time
            coded = [(r["i"], r["t"], encode(r["t"])) for r in asked.where(block_of == block).orderBy("i", "t").collect()]
            listed = [(i, t, "zh" if len(tok) and (tok & np.uint32(1)).mean() > 0.5 else "en", tok) for i, t, tok in coded]
            found = found.unionByName(_search_block(spark, tokens, table, _queries(listed, table), settings, paraphrases, schema))
    return found.distinct().select(F.col("item").alias(item_key), F.col("doc").alias(key), "kind", "cosine", "common_share", "answer_found")


def _search_block(spark: SparkSession, tokens: DataFrame, table: np.ndarray, queries: dict[str, _Query], s: Settings, paraphrases: bool, schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast((table, queries))

    def run(batches):
        table, queries = shared.value
        for b in batches:
            out = []
            ids = b["k"].tolist()
            for first, tok, begins in laid_out_batches(b["tok"]):
                for kind in KINDS:
                    if kind.name in queries:
                        query = queries[kind.name]
                        for (t, i), (verbatim, cosine, share, answer) in _search(tok, begins, kind, query, table, s, paraphrases).items():
                            out.append((query.ids[i], ids[first + t], "verbatim" if verbatim else "paraphrase", cosine, share, answer))
            yield pd.DataFrame(out, columns=["item", "doc", "kind", "cosine", "common_share", "answer_found"])

    found = materialize(tokens.mapInPandas(run, schema), "leaks")
    shared.destroy()
    return found
