"""Streams of state changes: one claim per task, the latest state per run, counts per window with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Which state may follow which; fixed values.
FOLLOWS = {None: {"READY"}, "READY": {"QUEUED"}, "QUEUED": {"STARTING"}, "STARTING": {"RUNNING", "QUEUE_FAILED"}, "RUNNING": {"COMPLETED", "REVIEW_REQUIRED", "FAILED", "OCR_REQUIRED"},
           "REVIEW_REQUIRED": {"QUEUED"}, "OCR_REQUIRED": {"QUEUED"}, "QUEUE_FAILED": {"QUEUED"}, "FAILED": {"QUEUED"}}


def claims(events: DataFrame, task: str, at: str, lateness: str = "1 day") -> DataFrame:
    """The first delivery of each task; repeated deliveries within ``lateness`` are dropped."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([task])


def latest_states(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The latest row per key, for batches and, in update mode, for streams."""
    return events.groupBy(key).agg(F.max_by(F.struct(at, *columns), F.struct(at, F.xxhash64(*columns))).alias("s")).select(key, "s.*")


def window_counts(events: DataFrame, at: str, by: str, width: str, lateness: str) -> DataFrame:
    """Counts per window and kind; rows later than ``lateness`` do not count any more."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def state_machine(events: DataFrame, key: str = "run_id", state: str = "state", at: str = "at") -> DataFrame:
    """Each state change with whether it may follow the state before; custom state per key for streams."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], current: GroupState) -> Iterator[pd.DataFrame]:
        now = current.get[0] if current.exists else None
        out = []
        for s in pd.concat(list(batches)).sort_values(at)[state]:
            allowed = s in FOLLOWS.get(now, set())
            out.append((keys[0], now, s, allowed))
            now = s if allowed else now
        current.update((now,))
        yield pd.DataFrame(out, columns=[key, "before", "after", "allowed"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, before string, after string, allowed boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def carried(df: DataFrame, group: str, chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` of its group so far, this row included, in the order of chunk and ``order``.

    Two levels: within each chunk, then over one summary a chunk, so a group with a third of all rows is sorted chunk by
    chunk in many tasks. Chunks must follow the order. Null groups and chunks are groups and chunks of their own.
    """
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = df.withColumn(name, F.last(value, ignorenulls=True).over(within))
    ends = here.groupBy(F.col(group).alias("__g"), F.col(chunk).alias("__c")).agg(F.max_by(name, F.struct(*order)).alias("__last"))
    earlier = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("__g", "__c", F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    joined = here.join(before, F.col(group).eqNullSafe(F.col("__g")) & F.col(chunk).eqNullSafe(F.col("__c")))
    return joined.withColumn(name, F.coalesce(name, "__before")).drop("__g", "__c", "__before")
