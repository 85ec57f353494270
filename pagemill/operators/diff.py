"""Differences between two copies of a dataset, in one grouping of the tagged union of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A compared field; ``rule`` is SQL over ``{c}`` giving the value that is compared."""

    name: str
    rule: str = "{c}"


#: Null and blank are equal and outer blanks do not count.
TEXT = "nullif(regexp_replace({c}, '^\\\\s+|\\\\s+$', ''), '')"
#: As TEXT, and the letter case does not count either.
CASELESS = "lower(nullif(regexp_replace({c}, '^\\\\s+|\\\\s+$', ''), ''))"


def compare_copies(left: DataFrame, right: DataFrame, key: str, fields: list[Field], latest_by: str | None = None, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """One row per key that differs: ``key, missing_in, differences``.

    ``missing_in`` is the name of the side that lacks the key, else null; ``differences`` is an array of
    ``struct<field, left_value, right_value>`` in the order of ``fields``.

    Both sides are tagged, united and grouped once by the key. The aggregation keeps one struct per side and combines
    before the shuffle, so a key with a third of all rows costs one row per task. The comparison is a generated
    higher-order SQL expression over the two structs.

    Defined results: rows with a null key cannot be matched and are left out; of several rows with one key on a
    side the greatest ``latest_by`` stands (null is the oldest), ties are settled by a content hash; null equals
    null; NaN equals NaN; an empty side makes every key of the other one missing; other columns do not matter,
    whatever their names; a field that a side lacks is an error.
    """
    for side, df in zip(names, (left, right)):
        lacking = [f.name for f in fields if f.name not in df.columns]
        if key not in df.columns or lacking:
            raise ValueError(f"{side} lacks {lacking or key}")

    def tagged(df: DataFrame, side: int) -> DataFrame:
        values = [F.expr(f.rule.format(c=f"`{f.name}`")).alias(f.name) for f in fields]
        at = F.col(f"`{latest_by}`") if latest_by else F.lit(None).cast("timestamp")
        return df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("__pm_key"), F.lit(side).alias("__pm_side"), at.alias("__pm_at"), F.struct(*values).alias("__pm_row"))

    both = tagged(left, 0).unionByName(tagged(right, 1))
    rank = "struct(__pm_at, xxhash64(__pm_row))"
    grouped = both.groupBy("__pm_key").agg(
        F.expr(f"max_by(__pm_row, {rank}) FILTER (WHERE __pm_side = 0)").alias("l"),
        F.expr(f"max_by(__pm_row, {rank}) FILTER (WHERE __pm_side = 1)").alias("r"),
    )
    compared = ", ".join(
        f"named_struct('field', '{f.name}', 'left_value', cast(l.`{f.name}` as string), 'right_value', cast(r.`{f.name}` as string), 'differs', NOT (l.`{f.name}` <=> r.`{f.name}`))" for f in fields
    )
    differences = f"transform(filter(array({compared}), x -> x.differs), x -> named_struct('field', x.field, 'left_value', x.left_value, 'right_value', x.right_value))"
    return (
        grouped.withColumn("missing_in", F.expr(f"CASE WHEN l IS NULL THEN '{names[0]}' WHEN r IS NULL THEN '{names[1]}' END"))
        .withColumn("differences", F.expr(f"CASE WHEN missing_in IS NULL THEN {differences} ELSE cast(array() as array<struct<field:string,left_value:string,right_value:string>>) END"))
        .where("missing_in IS NOT NULL OR size(differences) > 0")
        .select(F.col("__pm_key").alias(key), "missing_in", "differences")
    )


def difference_rows(compared: DataFrame, key: str) -> DataFrame:
    """``compare_copies`` as rows ``key, difference, left_value, right_value``; a missing row is ``missing_in_<side>``."""
    missing = F.struct(F.concat(F.lit("missing_in_"), F.col("missing_in")).alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"))
    rows = F.when(F.col("missing_in").isNotNull(), F.array(missing)).otherwise(F.col("differences"))
    return compared.select(F.col(f"`{key}`"), F.explode(rows).alias("d")).select(F.col(f"`{key}`"), F.col("d.field").alias("difference"), "d.left_value", "d.right_value")
