"""Text from scanned pages to continuous readable text.

Corpus statistics come from one pass over all texts. Misread words meet their correction candidates through an inverted
join on character q-grams of look-alike skeletons and boosted trees rank them; boosted trees over line pairs decide
which word parts join over a line end and which lines are page numbers and running headers. Chinese characters are judged by their
neighbours. Decisions are made for distinct words, pairs, headers and contexts, then applied to every text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import scan_lines as lines
from pagemill.llm.boosting import Boosted
from pagemill.session import materialize

#: Documented bound of the labelled rows on which each classifier is fitted.
TRAINING_ROWS = 6_000
#: Decisions are broadcast up to so many bytes of their keys and values; more are joined.
BROADCAST_BYTES = 32_000_000


def statistics(texts: DataFrame) -> DataFrame:
    """``kind, key, n`` over all texts; each task sends its own sums."""

    def run(batches):
        for b in batches:
            total: Counter = Counter()
            for t in b["text"]:
                total.update(lines.observe(t))
            yield pd.DataFrame([(k, key, n) for (k, key), n in total.items()], columns=["kind", "key", "n"])

    counted = texts.select("text").mapInPandas(run, "kind string, key string, n long")
    return materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "scan-statistics")


def _shaped(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            both = [lines.shapes(w) for w in b["word"]]
            yield b.assign(single=[x for x, _ in both], merged=[y for _, y in both])

    return words.mapInPandas(run, "word string, n long, single string, merged string")


def _qgrams(skeleton: Column, side: str) -> Column:
    """Positional q-grams of half a skeleton's length, with the length of the shorter of two skeletons that may meet.

    Of two skeletons at most one edit apart, the shorter of length n, either the first n / 2 characters or the last
    n - n / 2 are the same: so every such pair shares a q-gram, and a list holds only words that share half their letters.
    """
    def halves(n: Column) -> list[Column]:
        first = F.floor(n / 2).cast("int")
        sign = lambda name: F.concat(F.lit(side + name), n.cast("string"), F.lit(":"))
        return [F.concat(sign("p"), F.left(skeleton, first)), F.concat(sign("s"), F.right(skeleton, n - first))]

    return F.array(*halves(F.length(skeleton)), *halves(F.greatest(F.length(skeleton) - 1, F.lit(0))))


def candidates(words: DataFrame, ratio: float = 3.0) -> DataFrame:
    """``word, target, n, n_target`` for words whose skeletons are at most one edit apart, the target more frequent.

    Words meet in inverted lists of long positional q-grams (:func:`_qgrams`), so no pair is lost and lists stay short.
    """
    shaped = materialize(_shaped(words), "scan-words")
    kept = shaped.select("word", "n", "single", "merged", F.explode(F.array_distinct(F.concat(_qgrams(F.col("single"), "1"), _qgrams(F.col("merged"), "2")))).alias("g"))
    left = kept.select("g", "word", "n", F.col("single").alias("s1"), F.col("merged").alias("m1"))
    right = kept.where(~F.col("word").rlike(r"[0-9@$|]")).select("g", F.col("word").alias("target"), F.col("n").alias("n_target"), F.col("single").alias("s2"), F.col("merged").alias("m2"))
    signs = F.col("word").rlike(r"[a-z][0-9@$|]|[0-9@$|][a-z]")  # no printed word looks so, however rare its target
    met = left.join(right, "g").where((F.col("n_target") >= ratio * F.col("n")) | signs).where("word <> target AND length(target) > 1")
    near = met.where((F.levenshtein("s1", "s2") <= 1) | (F.levenshtein("m1", "m2") <= 1)).select("word", "n", "target", "n_target").distinct()

    def priced(batches):
        for b in batches:
            yield b.assign(cost=[confusion_cost(w, t) for w, t in zip(b["word"], b["target"])])

    return near.mapInPandas(priced, "word string, n long, target string, n_target long, cost double")


def confusion_cost(word: str, target: str) -> float:
    """Least cost of turning ``word`` into ``target``: 1 for each known confusion, 4 for any other edit, at most 9."""
    n, m = len(word), len(target)
    table = _CONFUSED
    inf = 99.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here >= 9:
                continue
            if i < n and j < m:
                step = 0.0 if word[i] == target[j] else 4.0
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + step)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + 4)
                for wrong, right in table.get(word[i], ()):
                    if word.startswith(wrong, i) and target.startswith(right, j):
                        a, b = i + len(wrong), j + len(right)
                        d[a][b] = min(d[a][b], here + 1)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + 4)
    return min(d[n][m], 9.0)


_CONFUSED: dict[str, list[tuple[str, str]]] = {}
for _wrong, _right in lines.CONFUSIONS:
    _CONFUSED.setdefault(_wrong[0], []).append((_wrong, _right))


def _pair_features(word, n, target, n_target, cost, stem) -> list[float]:
    signs = sum(c.isdigit() or c in "@$|" for c in word)
    return [np.log(n), np.log(n_target), np.log(n_target / n), min(len(word), 12), cost, signs, np.log1p(stem), float(len(word) - len(target)), float(word[0] == target[0]), float(word[-1] == target[-1]), cost / max(len(word), 1)]


def _corrupted(word: str, rng) -> str | None:
    """``word`` with one or two known confusions, as a recogniser would read it."""
    out = word
    for _ in range(1 + (len(word) > 6 and rng.random() < 0.25)):
        spots = [(i, w, r) for w, r in lines.CONFUSIONS for i in range(len(out)) if out.startswith(r, i)]
        if not spots:
            return None
        i, wrong, right = spots[rng.integers(len(spots))]
        out = out[:i] + wrong + out[i + len(right) :]
    return out if out != word else None


def word_ranker(words: pd.DataFrame, pairs: pd.DataFrame, seed: int = 3) -> Boosted:
    """Fitted on confusions put into frequent words against pairs of words that are both at home in the corpus.

    ``words`` and ``pairs`` are bounded samples. The at-home ones are thinned to small counts, so the model learns more than counts.
    """
    rng = np.random.default_rng(seed)
    x, y = [], []
    known = dict(zip(words["word"], words["n"]))

    def stem(w: str) -> int:
        parts = [w[k:] for k in range(1, 6) if len(w) - k >= 4] + [w[:-k] for k in range(1, 6) if len(w) - k >= 4]
        return max((known.get(p, 0) for p in parts), default=0)

    clean = [(w, n) for w, n in known.items() if n >= 3 and w.isalpha() and len(w) > 1]
    for w, n in clean[: TRAINING_ROWS // 4]:
        for _ in range(2):
            bad = _corrupted(w, rng)
            if bad and bad not in known:
                x.append(_pair_features(bad, int(rng.integers(1, 4)) * (1 + rng.poisson(n * 0.003 * rng.random())), w, n, confusion_cost(bad, w), stem(bad)))
                y.append(1)
    for word, n, target, n_target, cost, stem_n in pairs.itertuples(index=False):
        if cost >= 4 or (n >= 3 and word.isalpha() and n_target / n < 8):
            x.append(_pair_features(word, n, target, n_target, cost, stem_n))
            x.append(_pair_features(word, max(1, min(n, 1 + rng.poisson(1.5))), target, n_target, cost, stem_n))
            y += [0, 0]
    return Boosted().fit(np.array(x, dtype=np.float64).reshape(len(x), -1) if x else np.zeros((0, 11)), np.array(y))


def corrections(stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``kind='w', key, value``: misread words with the candidate the ranker puts first."""
    words = stats.where("kind = 'w'").select(F.col("key").alias("word"), "n")
    met = candidates(words)
    splits = F.array_distinct(F.flatten(F.array(*[F.when(F.length("word") - k >= 4, F.array(F.expr(f"substring(word, {k + 1})"), F.expr(f"substring(word, 1, length(word) - {k})"))).otherwise(F.array().cast("array<string>")) for k in range(1, 6)])))
    parts = met.select("word").distinct().select("word", F.explode(splits).alias("part"))
    stems = parts.join(words.select(F.col("word").alias("part"), F.col("n").alias("stem")), "part").groupBy("word").agg(F.max("stem").alias("stem"))
    pairs = materialize(met.join(stems, "word", "left").select("word", "n", "target", "n_target", "cost", F.coalesce("stem", F.lit(0)).alias("stem")), "scan-pairs")
    # both samples are by hash and bounded
    sample_words = words.where("n >= 3").orderBy(F.xxhash64("word")).limit(TRAINING_ROWS).toPandas()
    sample_pairs = pairs.orderBy(F.xxhash64("word", "target")).limit(TRAINING_ROWS).toPandas()
    shared = stats.sparkSession.sparkContext.broadcast(word_ranker(sample_words, sample_pairs))

    def score(batches):
        for b in batches:
            x = [_pair_features(*row) for row in b[["word", "n", "target", "n_target", "cost", "stem"]].itertuples(index=False)]
            yield b.assign(p=shared.value.probability(np.array(x).reshape(len(x), -1)) if x else [])[["word", "target", "n_target", "p"]]

    # only what known confusions explain is replaced; the other pairs taught the ranker what is no confusion
    scored = pairs.where("cost < 4").mapInPandas(score, "word string, target string, n_target long, p double").where(F.col("p") >= threshold)
    best = materialize(scored.groupBy("word").agg(F.max_by("target", F.struct("p", "n_target", "target")).alias("value")), "scan-best")
    # a misread word may have led to another misread one, and that to the printed word
    onward = best.select(F.col("word").alias("value"), F.col("value").alias("onward"))
    best = best.join(onward, "value", "left").select("word", F.when(F.col("onward") != F.col("word"), F.col("onward")).otherwise(F.col("value")).alias("value"))
    return best.select(F.lit("w").alias("kind"), F.col("word").alias("key"), "value")


def _join_features(left: str, right: str, whole: int, n_left: int, n_right: int) -> list[float]:
    return [np.log1p(whole), np.log1p(n_left), np.log1p(n_right), len(left), len(right), float(right.isalpha()), float(whole > n_left), float(whole > n_right)]


def joins(stats: DataFrame) -> DataFrame:
    """``kind='j', key, value='1'``: word parts at a line end that are one word.

    Fitted on frequent words cut at random places against pairs of whole words and words with a hyphen of their own.
    """
    words = stats.where("kind = 'w'").select("key", "n")
    ends = stats.where("kind = 'j'").select("key", F.split("key", "\t").alias("p")).select("key", F.col("p")[0].alias("l"), F.col("p")[1].alias("r"))
    count_of = lambda name: words.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"))
    known = (
        ends.withColumn("w", F.concat("l", "r")).join(count_of("w"), "w", "left").join(count_of("l"), "l", "left").join(count_of("r"), "r", "left")
        .select("key", "l", "r", *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in "wlr"])
    )
    sample = words.where("n >= 3").orderBy(F.xxhash64("key")).limit(TRAINING_ROWS).toPandas()
    rng = np.random.default_rng(9)
    n_of = dict(zip(sample["key"], sample["n"]))
    x, y = [], []
    listed = [w for w in n_of if w.isalpha() and len(w) >= 2]
    for w in (w for w in listed if len(w) >= 5):
        k = int(rng.integers(2, len(w) - 1))
        whole = 0 if rng.random() < 0.35 else n_of[w]  # words that occur nowhere else are cut too
        x.append(_join_features(w[:k], w[k:], whole, n_of.get(w[:k], 0), n_of.get(w[k:], 0)))
        y.append(1)
    for _ in range(min(len(listed), TRAINING_ROWS // 2)):
        a, b = listed[rng.integers(len(listed))], listed[rng.integers(len(listed))]
        x.append(_join_features(a, b, n_of.get(a + b, 0), n_of[a], n_of[b]))
        y.append(0)
    model = Boosted(trees=40).fit(np.array(x, dtype=np.float64).reshape(len(x), 8), np.array(y))
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        for b in batches:
            x = [_join_features(*row) for row in b[["l", "r", "n_w", "n_l", "n_r"]].itertuples(index=False)]
            yes = shared.value.probability(np.array(x, dtype=np.float64)) >= 0.5 if x else np.zeros(0, dtype=bool)
            yield pd.DataFrame({"kind": "j", "key": b["key"][yes], "value": "1"})

    return known.mapInPandas(decide, "kind string, key string, value string")


def titles(stats: DataFrame) -> DataFrame:
    """``kind='t', key, value``: how often each core stands with number, unit or bar, without, and as a whole text.

    Cores seen but once, without any of these, are no evidence and left out.
    """
    count = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    cores = stats.where("kind IN ('a', 'b', 's')").groupBy("key").agg(count("a"), count("b"), count("s")).where("a > 0 OR b > 1")
    return cores.select(F.lit("t").alias("kind"), "key", F.concat_ws(",", "a", "b", "s").alias("value"))


#: Layouts of page numbers and running headers in print; n a page number, m a number of pages, t a title.
LATIN_COUNTS = ("{n}", "— {n} —", "- {n} -", "[{n}]", "· {n} ·", "p. {n}", "Page {n}", "page {n} of {m}", "{n} / {m}", "{n}.", "{r}")
HAN_COUNTS = ("{n}", "第 {n} 页", "— {n} —")
LATIN_TITLES = ("{t}", "{t}", "{T}", "{n}   {t}", "{t}   {n}", "Unit {n} · {t}")
HAN_TITLES = ("{t}", "{t}", "{n}   {t}", "{t}   {n}", "{t} 第{n}单元")


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def line_sample(texts: DataFrame) -> DataFrame:
    """``before, line, after``: a hash sample of at most ``TRAINING_ROWS`` lines with their neighbours."""
    cut = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: F.trim(x) != "")
    rows = texts.select(F.transform(F.array(cut), lambda ls: F.transform(ls, lambda x, i: F.struct(F.get(ls, i - 1).alias("before"), x.alias("line"), F.get(ls, i + 1).alias("after"))))[0].alias("ls"))
    placed = rows.select(F.posexplode("ls").alias("at", "x")).select("at", "x.*")
    return placed.orderBy(F.xxhash64("before", "line", "after"), "at").limit(TRAINING_ROWS).select("before", "line", "after")


def furniture_model(sample: list[tuple], evidence: dict[str, tuple[int, int, int]], seed: int = 17) -> Boosted:
    """Boosted trees over line pairs: furniture planted between the lines of the sample against those lines themselves.

    Page numbers are printed in the usual layouts, titles are those of sampled lines that the corpus has with a number, unit
    or bar; both may be misread, and a title's evidence is hidden in part. Sampled lines that look like furniture
    themselves, or have such evidence, are left out: nobody has labelled them.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    known = lambda cores: tuple(map(min, zip(*(evidence.get(c, (0, 0, 0)) for c in cores)))) if cores else (0, 0, 0)
    x, y, plain, found = [], [], [], ([], [])
    for before, line, after in sample:
        facts = lines.facts_of(line)
        seen = known(facts[2])
        if seen[0] >= 2:
            found["一" <= line.strip()[:1] <= "鿿"].append(line.strip())
        if facts[0] or facts[1] or seen[0]:
            continue
        plain.append((before, line, after))
        x.append(lines.line_features(before, line, after, facts, seen))
        y.append(0)
    for before, line, after in plain[: TRAINING_ROWS // 2]:
        place = rng.random()
        around = (None, None) if place < 0.4 else (before, line) if place < 0.7 else (line, after)
        n = int(rng.integers(1, 10 ** int(rng.integers(1, 5))))
        han = rng.random() < 0.4
        if found[han] and rng.random() < 0.5:
            title = pick(found[han])
            a, b, s = known(lines.facts_of(title)[2])
            s *= rng.random() < 0.6  # or it never was a whole text
            adorned = lines.facts_of(title)[1]  # such a line stands as it is
            printed = title if adorned else pick(HAN_TITLES if han else LATIN_TITLES).format(n=n, t=title, T=title.upper())
            if rng.random() < 0.2 and b >= 4 and not adorned:  # seen without number, unit or bar only, but often
                seen = (0, b, s)
            else:  # of a title as frequent, or of a rarer one
                part = float(max(a, 2)) ** -rng.random()
                seen = (max(2, int(a * part)), int(np.ceil(b * part)) * int(rng.random() < 0.8), int(np.ceil(s * part)))
        else:
            printed, seen = pick(HAN_COUNTS if han else LATIN_COUNTS).format(n=n, m=n + int(rng.integers(0, 900)), r=_roman(n % 150 + 1)), (0, 0, 0)
            if rng.random() < 0.2:
                printed = printed.replace("1", "l").replace("0", "O")
        facts = lines.facts_of(printed)
        x.append(lines.line_features(*around[:1], printed, around[1], facts, seen if facts[2] else (0, 0, 0)))
        y.append(1)
    return Boosted(trees=60).fit(np.array(x, dtype=np.float64).reshape(len(x), -1) if x else np.zeros((0, 1)), np.array(y))


def furniture(texts: DataFrame, found: DataFrame) -> Boosted:
    """The classifier of line pairs, fitted on a bounded sample of the texts' lines with the evidence of the whole corpus."""
    sample = [tuple(None if v is None else lines.tidy(v) for v in r) for r in line_sample(texts).collect()]
    cores = sorted({c for _, line, _ in sample for c in lines.title_cores(line)[1]})
    asked = texts.sparkSession.createDataFrame([(c,) for c in cores], "key string")
    evidence = {r["key"]: tuple(map(int, r["value"].split(","))) for r in found.where("kind = 't'").join(F.broadcast(asked), "key", "left_semi").collect()}
    return furniture_model(sample, evidence)


def contexts(stats: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``kind='h', key, value``: Chinese characters that their neighbours take for a look-alike of theirs.

    The candidates of a context are those with a look-alike in the middle; boosted trees over the counts of the
    context and of both character pairs rank them, fitted on frequent contexts with a look-alike put in.
    """
    seen = stats.where("kind = 'h'").select("key", "n")
    group = F.create_map(*[x for c, g in lines._GROUP_OF.items() for x in (F.lit(c), F.lit(g))])
    parts = seen.select("key", "n", F.substring("key", 1, 1).alias("p"), F.substring("key", 2, 1).alias("c"), F.substring("key", 3, 1).alias("q"))
    alternatives = parts.withColumn("alt", F.explode(F.split(group[F.col("c")], ""))).where("alt <> c AND alt <> ''")
    lefts = parts.groupBy("p", "c").agg(F.sum("n").alias("n"))
    rights = parts.groupBy("c", "q").agg(F.sum("n").alias("n"))
    unigram = parts.groupBy("c").agg(F.sum("n").alias("n"))
    whole = parts.select("p", F.col("c").alias("alt"), "q", F.col("n").alias("n_alt"))
    known = (
        alternatives.join(lefts.select("p", "c", F.col("n").alias("l")), ["p", "c"], "left").join(rights.select("c", "q", F.col("n").alias("r")), ["c", "q"], "left")
        .join(lefts.select("p", F.col("c").alias("alt"), F.col("n").alias("la")), ["p", "alt"], "left").join(rights.select(F.col("c").alias("alt"), "q", F.col("n").alias("ra")), ["alt", "q"], "left")
        .join(whole, ["p", "alt", "q"], "left").join(unigram.select("c", F.col("n").alias("u")), "c", "left").join(unigram.select(F.col("c").alias("alt"), F.col("n").alias("ua")), "alt", "left")
        .select("key", "alt", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_alt", "l", "r", "la", "ra", "u", "ua")])
    )
    known = materialize(known, "scan-contexts")

    def features(n, n_alt, l, r, la, ra, u, ua):  # noqa: E741
        lg = lambda a, b: np.log((a + 0.5) / (b + 0.5))
        return [lg(n_alt, n), lg(la, l), lg(ra, r), max(lg(la, l), lg(ra, r)), min(lg(la, l), lg(ra, r)), lg(la * ra, max(l * r, 1)), lg(ua, u), np.log1p(n_alt), np.log1p(max(la, ra))]

    sample = known.orderBy(F.xxhash64("key", "alt")).limit(TRAINING_ROWS).toPandas()
    rng = np.random.default_rng(23)
    x, y = [], []
    for _, _, n, n_alt, l, r, la, ra, u, ua in sample.itertuples(index=False):  # noqa: E741
        if n >= 3 and (l >= la or r >= ra):  # at home where it stands
            x.append(features(max(1, min(n, rng.poisson(2))), n_alt, l, r, la, ra, u, ua))
            y.append(0)
            # the look-alike read in its place: rare there, and so are both of its pairs
            k = int(rng.integers(1, 4)) * (1 + rng.poisson(n * 0.004 * rng.random()))
            if u >= 20:
                rate = 0.001 + 0.02 * rng.random()
                hidden = rng.random()  # the true context, and one of its pairs, may occur nowhere else
                ll, rr = (0 if 0.1 < hidden < 0.3 else l), (0 if 0.3 < hidden < 0.5 else r)
                x.append(features(k, 0 if hidden < 0.5 else n, k + min(la, rng.poisson(rate * l + 0.2)), k + min(ra, rng.poisson(rate * r + 0.2)), ll, rr, max(ua, k), u))
                y.append(1)
    model = Boosted(trees=50).fit(np.array(x, dtype=np.float64).reshape(len(x), 9), np.array(y))
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        for b in batches:
            x = [features(*row) for row in b[["n", "n_alt", "l", "r", "la", "ra", "u", "ua"]].itertuples(index=False)]
            p = shared.value.probability(np.array(x, dtype=np.float64)) if x else np.zeros(0)
            yield pd.DataFrame({"key": b["key"], "alt": b["alt"], "n_alt": b["n_alt"], "p": p})

    scored = known.mapInPandas(decide, "key string, alt string, n_alt long, p double").where(F.col("p") >= threshold)
    return scored.groupBy("key").agg(F.max_by("alt", F.struct("p", "n_alt", "alt")).alias("value")).select(F.lit("h").alias("kind"), "key", "value")


def decisions(texts: DataFrame) -> DataFrame:
    """``kind, key, value`` for all distinct words, word parts, headers and contexts of the texts."""
    stats = statistics(texts)
    return materialize(corrections(stats).unionByName(joins(stats)).unionByName(titles(stats)).unionByName(contexts(stats)), "scan-decisions")


def _answers(own) -> dict[tuple[str, str], str]:
    return {(k, key): v for k, key, v in (x.split("\u0001") for x in ([] if own is None else own))}


def _asking(model: Boosted):
    """From a table of decisions to a function that answers :func:`scan_lines.repair`; equal line features are judged once."""
    judged: dict[tuple, bool] = {}

    def asking(table: dict):
        def answer(kind: str, key):
            if kind != "f":
                return table.get((kind, key))
            if key not in judged:
                judged[key] = model.one(key) >= 0.5
            return judged[key]

        return answer

    return asking


def repair_texts(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key, text, repaired, n_joined, n_furniture, n_replaced`` of every row.

    Defined results: null texts give no row; an empty text stays empty; a text that is only a header or page number
    becomes empty; texts of any length are repaired whole; repeated rows give one result each; an empty table gives none;
    other columns do not matter.
    """
    spark = rows.sparkSession
    source = rows.where(F.col(text).isNotNull()).select(*[F.col(k) for k in key], F.col(text).alias("text"))
    found = decisions(source)
    judge = spark.sparkContext.broadcast(furniture(source, found))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key) + ", text string, repaired string, n_joined int, n_furniture int, n_replaced int"
    columns = [*key, "text", "repaired", "n_joined", "n_furniture", "n_replaced"]
    size = found.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({(r["kind"], r["key"]): r["value"] for r in found.collect()})

        def run(batches):
            look = _asking(judge.value)(shared.value)
            for b in batches:
                out = [lines.repair(t, look) for t in b["text"]]
                b[["repaired", "n_joined", "n_furniture", "n_replaced"]] = pd.DataFrame(out, index=b.index, columns=columns[-4:])
                yield b[columns]

        return source.mapInPandas(run, schema)

    # more decisions than may be broadcast: each row fetches its own by joins. A decision may lead to further questions
    # (a joined word, a header's core after correction, neighbours over a line end), so rows with new answers ask again
    placed = materialize(source.withColumn("__row", F.expr("uuid()")), "scan-rows")

    def ask(batches):
        asking = _asking(judge.value)
        for b in batches:
            out = []
            for r, t, own in zip(b["__row"], b["text"], b["__own"]):
                table = _answers(own)
                out += [(r, kind, k) for kind, k in lines.keys_of(t, asking(table)) if (kind, k) not in table]
            yield pd.DataFrame(out, columns=["__row", "kind", "key"])

    own = spark.createDataFrame([], "__row string, __own array<string>")
    todo, answers = placed.select("__row", "text", F.lit(None).cast("array<string>").alias("__own")), None
    while True:
        asked = todo.mapInPandas(ask, "__row string, kind string, key string")
        new = materialize(asked.join(found, ["kind", "key"]).select("__row", F.concat_ws("\u0001", "kind", "key", "value").alias("answer")), "scan-answers")
        if new.isEmpty():
            break
        answers = new if answers is None else answers.unionByName(new)
        own = answers.groupBy("__row").agg(F.collect_list("answer").alias("__own"))
        todo = placed.select("__row", "text").join(own, "__row").join(new.select("__row").distinct(), "__row", "left_semi")

    def apply(batches):
        asking = _asking(judge.value)
        for b in batches:
            out = [lines.repair(t, asking(_answers(own))) for t, own in zip(b["text"], b["__own"])]
            b[["repaired", "n_joined", "n_furniture", "n_replaced"]] = pd.DataFrame(out, index=b.index, columns=columns[-4:])
            yield b[columns]

    return placed.join(own, "__row", "left").drop("__row").mapInPandas(apply, schema)
