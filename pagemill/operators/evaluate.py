"""Scores of predictions against truth: multiset overlap, field accuracy, aggregates over layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import comparable, has_text


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def multiset_f1(predicted: DataFrame, truth: DataFrame, group: list[str], item: str) -> DataFrame:
    """``group, tp, fp, fn, precision, recall, f1, exact`` of the multisets of ``item`` (compared squeezed, caseless).

    The common part of two multisets is the sum of the lesser counts, so both sides are united and counted once; a hot
    item is one row per task. Precision and recall of nothing are 1, F1 is 0 only if both are 0.
    """
    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(*[F.col(g) for g in group], comparable(F.col(item)).alias("__item"), F.lit(side).alias("__side"))

    counts = tagged(predicted, 0).unionByName(tagged(truth, 1)).groupBy(*group, "__item").agg(F.count_if(F.col("__side") == 0).alias("p"), F.count_if(F.col("__side") == 1).alias("t"))
    total = counts.groupBy(*group).agg(F.sum(F.least("p", "t")).alias("tp"), F.sum("p").alias("p"), F.sum("t").alias("t")).withColumns({"fp": F.col("p") - F.col("tp"), "fn": F.col("t") - F.col("tp")})
    precision, recall = _ratio(F.col("tp"), F.col("p"), 1.0), _ratio(F.col("tp"), F.col("t"), 1.0)
    scored = total.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.withColumn("f1", f1).select(*group, "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"))


def field_accuracy(predicted: DataFrame, truth: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """``field, n_truth, n_equal, accuracy`` over truth values that are not empty.

    Of several rows with one key the one with the greatest ``order`` counts on either side; rows without a counterpart
    count as unequal.
    """
    def last(df: DataFrame, prefix: str) -> DataFrame:
        row = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
        return df.groupBy(*key).agg(F.max_by(row, F.struct(F.col(order), F.xxhash64(row))).alias(prefix))

    both = last(truth, "t").join(last(predicted, "p"), key, "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").alias("t"), F.col(f"p.{f}").alias("p")) for f in fields])
    rows = both.select(F.explode(pairs).alias("x")).select("x.*").where(has_text(F.col("t")))
    return rows.groupBy("field").agg(F.count("*").alias("n_truth"), F.count_if(comparable(F.col("t")) == comparable(F.col("p"))).alias("n_equal")).withColumn("accuracy", F.round(F.col("n_equal") / F.col("n_truth"), 6))


def worst_of(scores: DataFrame, layer: str = "layer", score: str = "f1", exact: str = "exact") -> DataFrame:
    """Per layer the least score and whether every page is exact."""
    return scores.groupBy(layer).agg(F.count("*").alias("n_pages"), F.min(score).alias("least"), F.bool_and(exact).alias("all_exact"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(df: DataFrame, group: str, tags: str, required: list[str]) -> DataFrame:
    """Per group the required tags that none of its rows has."""
    seen = df.groupBy(group).agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce(tags, F.array().cast("array<string>"))))).alias("seen"))
    return seen.select(group, F.size("seen").alias("n_tags"), F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "seen")), ",").alias("missing"))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, side`` of keys on one side only, both ways by anti joins."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))
