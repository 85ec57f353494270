"""Session helpers: building a session for tests, table access, materialisation in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made and set, and removed
    when the driver ends; on a cluster a folder of one machine could not be read by the others, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    The lineage is cut by files that every executor can read again, so the loss of executors costs nothing but
    the tasks they were running. The tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized() -> None:
    """Removes all tables that :func:`materialize` wrote in this process."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            jvm = spark._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; the folder belongs to the cluster then
            pass


atexit.register(drop_materialized)


@contextlib.contextmanager
def intermediate_tables():
    """Within it intermediate tables may be written; those are removed at its end. Read or write the results before.

    A session that runs many queries uses one block a query, so the shared folder holds the tables of one query at most.
    """
    outer, _TABLES[:] = list(_TABLES), []
    try:
        yield
    finally:
        drop_materialized()
        _TABLES[:] = outer


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint only if its counted number of rows is within ``limit``; else as it is."""
    return F.broadcast(df) if rows <= limit else df


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """A number of partitions that grows with the rows, never under the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_partition))


def latest(df: DataFrame, key: str | list[str], ordering: str, *columns: str) -> DataFrame:
    """The row with the greatest ``ordering`` of each key; ``columns`` default to all others.

    One shuffle with map-side combination: a key that holds a third of all rows sends one row per task.
    Null keys are left out; a null ordering counts as the oldest; among equal orderings the row with the
    greatest content hash stands, so repeated rows and ties give the same row on every run.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (columns or df.columns) if c not in keys and c != ordering]
    row = F.struct(*[F.col(f"`{c}`") for c in [ordering, *rest]])
    rank = F.struct(F.col(f"`{ordering}`"), F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0))
    kept = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    found = kept.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, rank).alias("__pm_row"))
    return found.select(*[F.col(f"`{k}`") for k in keys], "__pm_row.*")
