"""Freely entered values to the entries of a canonical list.

Distinct values are normalised and cut into parts, candidates come from an inverted index of character n-grams, the
score is a cosine of IDF-weighted n-grams, and a value is accepted above a threshold and with a margin to the next
entry. Most n-grams do not keep the order of their letters, so letters that changed places still score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import materialize

UNMATCHED = "UNMATCHED"

#: Words and signs that join the parts of a compound entry; fixed values.
_CONNECTIVES = r"(?:\b(?:and|or)\b|[&+]|(?<=[一-鿿])[和或与及](?=[一-鿿]))"


def normalised(value: Column) -> Column:
    """Full-width forms narrowed, camel case split, lower case, every run of other signs one blank."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　 "
    narrow = "".join(chr(0x21 + i) for i in range(94)) + "  "
    x = F.translate(value, wide, narrow)
    x = F.regexp_replace(x, "[­​-‏⁠﻿]", "")
    x = F.regexp_replace(x, r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ")
    x = F.regexp_replace(F.lower(x), _CONNECTIVES, " ")
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def parts(value: Column) -> Column:
    """The whole value first, then its pieces: inside and outside brackets, beside a dash or colon, by script."""
    whole = normalised(value)
    by_script = F.regexp_replace(F.regexp_replace(value, r"([一-鿿])[^一-鿿A-Za-z]*([A-Za-z])", "$1)$2"), r"([A-Za-z])[^一-鿿A-Za-z]*([一-鿿])", "$1)$2")
    pieces = F.split(by_script, r"[()\[\]<>（）【】:：]|\s[-–—]+\s")
    cleaned = F.array_distinct(F.filter(F.transform(pieces, normalised), lambda p: p != ""))
    return F.when(F.size(cleaned) > 1, F.concat(F.array(whole), cleaned)).otherwise(F.array(whole))


def grams(text: Column) -> Column:
    """Padded pairs as they stand, and pairs, pairs with one character between and triples in the order of the alphabet.

    Parts of at most three characters have their single characters too.
    """

    def cut(chars: Column) -> Column:
        n = F.size(chars)
        at = lambda i: F.get(chars, i)
        pair = lambda a, b, sign: F.concat(F.least(a, b), F.lit(sign), F.greatest(a, b))
        ordered = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(at(i), at(i + 1), F.lit("\u0001")))
        twos = F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(at(i), at(i + 1), ""))
        skips = F.transform(F.sequence(F.lit(0), n - 3), lambda i: pair(at(i), at(i + 2), "_"))
        threes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.array_join(F.array_sort(F.array(at(i), at(i + 1), at(i + 2))), ""))
        ones = F.when(n <= 5, F.slice(chars, 2, n - 2)).otherwise(F.array().cast("array<string>"))
        return F.concat(ordered, twos, skips, threes, ones)

    # characters are taken from an array: positions in a string cost as much as the string is long
    chars = F.filter(F.split(F.concat(F.lit("^"), F.regexp_replace(text, " ", ""), F.lit("$")), ""), lambda c: c != "")
    return F.transform(F.array(chars), lambda c: F.when(F.size(c) > 2, cut(c)).otherwise(F.array().cast("array<string>")))[0]


def _counted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, gram, tf``."""
    return df.select(*keys, F.explode(grams(F.col(text))).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def inverted_index(reference: DataFrame) -> DataFrame:
    """``list, gram, code, form, idf, rw, n``: the n-grams of all forms of all entries with unit-length weights."""
    labels = sorted(c for c in reference.columns if c.startswith("label_"))
    forms = (
        reference.where("code IS NOT NULL")
        .select(F.col("list_name").alias("list"), "code", F.explode(F.array(*[F.col(c) for c in ["code", *labels]])).alias("f"))
        .select("list", "code", normalised(F.col("f")).alias("form")).where("form <> ''").distinct()
    )
    weights = materialize(_counted(forms, ["list", "code", "form"], "form"), "label-forms")
    per_list = weights.groupBy("list").agg(F.count_distinct("code", "form").alias("n"))
    idf = weights.groupBy("list", "gram").agg(F.count("*").alias("df")).join(per_list, "list").select("list", "gram", "n", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    weighed = weights.join(idf, ["list", "gram"]).withColumn("w", F.sqrt("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("list", "code", "form")))
    return materialize(weighed.select("list", "gram", "code", "form", "idf", (F.col("w") / norm).alias("rw"), "n"), "label-index")


def map_to_list(values: DataFrame, reference: DataFrame, list_col: str = "list_name", value_col: str = "value", threshold: float = 0.34, margin: float = 0.005) -> DataFrame:
    """``list_col, value_col, code, score`` for each distinct value; ``code`` is ``UNMATCHED`` if none is meant.

    ``values`` has ``list_col`` and ``value_col``; ``reference`` has ``list_name, code`` and ``label_*`` columns, all
    of them surface forms of the code. Deduplication combines before its shuffle, so a value that holds a third of
    all rows costs one row per task; everything after works on distinct values.

    Candidates: the most frequent n-grams of a part are not looked up as long as their weight stays under
    ``threshold - margin`` of the part's; an entry that shares only those cannot reach the threshold, so none is lost.
    The score is the greater of the cosine of the whole value and the mean over its parts.

    Defined results: null values give no row; a value of blanks or signs only is ``UNMATCHED``; with an empty
    reference everything is; a value that is exactly a code gets that code; two entries within ``margin`` of each
    other, and so every tie, leave a value ``UNMATCHED``; other columns of either table do not matter.
    """
    index = inverted_index(reference)
    distinct = values.where(F.col(value_col).isNotNull()).select(F.col(list_col).alias("list"), F.col(value_col).alias("value")).distinct()
    # rows of n-grams carry a digest of their value, not the value: it may be very long
    distinct = materialize(distinct.withColumn("id", F.sha2("value", 256)), "label-values")
    pieces = distinct.select("list", "id", F.posexplode(parts(F.col("value"))).alias("no", "part"), (F.size(parts(F.col("value"))) - 1).alias("n_parts"))
    counted = _counted(pieces, ["list", "id", "no", "n_parts"], "part")
    # grams the list does not have weigh as much as the rarest ones it has
    known = index.groupBy("list", "gram").agg(F.first("idf").alias("idf"))
    rarest = index.groupBy("list").agg(F.log(1 + F.first("n")).alias("rarest"))
    weighed = counted.join(known, ["list", "gram"], "left").join(rarest, "list", "left").withColumn("w", F.sqrt("tf") * F.coalesce("idf", "rarest", F.lit(1.0)))
    part = Window.partitionBy("list", "id", "no")
    frequent = part.orderBy(F.coalesce("idf", "rarest", F.lit(1.0)), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    square = F.col("w") * F.col("w")
    ranked = weighed.select("list", "id", "no", "n_parts", "gram", F.col("idf").isNotNull().alias("listed"), "w", F.sum(square).over(part).alias("all"), F.sum(square).over(frequent).alias("upto"))
    least = max(threshold - margin, 0.0)
    own = materialize(ranked.where("listed").select("list", "id", "no", "n_parts", "gram", (F.col("w") / F.sqrt("all")).alias("v"), (F.col("upto") > F.lit(least * least) * F.col("all")).alias("looked_up")), "label-grams")
    candidates = own.where("looked_up").join(index.select("list", "gram", "code"), ["list", "gram"]).select("list", "id", "code").distinct()
    hits = own.join(candidates, ["list", "id"]).join(index.select("list", "gram", "code", "form", "rw"), ["list", "gram", "code"])
    cosines = hits.groupBy("list", "id", "code", "no", "n_parts", "form").agg(F.sum(F.col("v") * F.col("rw")).alias("cos"))
    best = cosines.groupBy("list", "id", "code", "no", "n_parts").agg(F.max("cos").alias("cos"))
    scored = best.groupBy("list", "id", "code").agg(F.greatest(F.max(F.when(F.col("no") == 0, F.col("cos"))), F.sum(F.when(F.col("no") > 0, F.col("cos"))) / F.greatest(F.max("n_parts"), F.lit(1))).alias("score"))
    place = F.row_number().over(Window.partitionBy("list", "id").orderBy(F.desc("score"), "code"))
    two = scored.withColumn("place", place).where("place <= 2").groupBy("list", "id").agg(F.max("score").alias("score"), F.min_by("code", "place").alias("code"), F.min("score").alias("next"), F.count("*").alias("n"))
    clear = (F.col("score") >= threshold) & ((F.col("n") == 1) | (F.col("score") - F.col("next") >= margin))
    return (
        distinct.join(two.select("list", "id", F.when(clear, F.col("code")).alias("code"), "score"), ["list", "id"], "left")
        .select(F.col("list").alias(list_col), F.col("value").alias(value_col), F.coalesce("code", F.lit(UNMATCHED)).alias("code"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )
