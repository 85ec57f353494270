import pytest
from pyspark.sql import functions as F

from pagemill.operators import diff

FIELDS = [diff.Field("a"), diff.Field("b", diff.TEXT), diff.Field("c", diff.CASELESS)]
SCHEMA = "id string, a int, b string, c string, at timestamp_ntz, l string, __extra string"


def frame(spark, rows):
    df = spark.createDataFrame([(*r[:4], r[4], "x", "y") for r in rows], SCHEMA.replace("at timestamp_ntz", "at string"))
    return df.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumnRenamed("__extra", "r")


def found(spark, left, right):
    out = diff.compare_copies(frame(spark, left), frame(spark, right), "id", FIELDS, "at", ("left", "right"))
    return {(r["id"], r["difference"]) for r in diff.difference_rows(out, "id").collect()}


def test_missing_and_fields(spark):
    left = [("1", 1, "x", "AB", "2025-01-01"), ("2", 1, "x", "ab", "2025-01-01"), ("3", None, " ", None, "2025-01-01")]
    right = [("1", 2, " x ", "ab ", "2025-01-01"), ("3", None, None, "", "2025-01-01"), ("4", 1, "x", "q", "2025-01-01")]
    assert found(spark, left, right) == {("1", "a"), ("2", "missing_in_right"), ("4", "missing_in_left")}


def test_latest_ties_and_null_keys(spark):
    left = [("1", 1, "old", "x", "2025-01-01"), ("1", 1, "new", "x", "2025-02-01"), ("1", 9, "none", "x", None), (None, 1, "x", "x", "2025-01-01"), ("2", 1, "s", "x", "2025-01-01"), ("2", 1, "s", "x", "2025-01-01")]
    right = [("1", 1, "new", "x", "2025-01-05"), ("2", 1, "s", "x", "2025-01-01")]
    assert found(spark, left, right) == set()
    tie = [("1", 1, "p", "x", "2025-01-01"), ("1", 2, "q", "x", "2025-01-01")]
    assert found(spark, tie, tie[::-1]) == set()


def test_empty_tables_long_text_and_lacking_fields(spark):
    row = [("1", 1, "x" * 200_000, "x", "2025-01-01")]
    assert found(spark, row, []) == {("1", "missing_in_right")}
    assert found(spark, [], []) == set()
    assert found(spark, row, row) == set()
    with pytest.raises(ValueError):
        diff.compare_copies(frame(spark, row).drop("b"), frame(spark, row), "id", FIELDS)
