import json
import math

import pytest
from pyspark.sql import functions as F

from pagemill.sources import files, sinks
from pagemill.streaming import runs


def test_recognised_lines(spark):
    rows = [("p", "1", "0", "0", "0", "0", "0", "0", "1000", "500", "-1", None), ("p", "5", "1", "1", "1", "2", "300", "50", "100", "50", "96", "engine"), ("p", "5", "1", "1", "1", "1", "100", "50", "150", "100", "98", "vocabulary"), ("p", "5", "1", "1", "2", "1", "1", "1", "1", "1", "-1", "x"), ("p", "4", "1", "1", "1", "0", "0", "0", "0", "0", "x", "y")]
    names = ["level", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
    df = spark.createDataFrame(rows, "page string, " + ", ".join(f"{n} string" for n in names))
    got = files.recognised_lines(df, ["page"]).collect()
    assert len(got) == 1 and got[0]["text"] == "vocabulary engine" and math.isclose(got[0]["confidence"], 0.97)
    assert tuple(got[0]["bbox"]) == (0.1, 0.1, 0.4, 0.3, "normalized")


def test_native_blocks_bold_and_policy(spark):
    raw = spark.createDataFrame([("p", 100.0, 100.0, [(0.0, 0.0, 50.0, 10.0, "a"), (0.0, 0.0, 1.0, 1.0, " "), (90.0, 90.0, 120.0, 99.0, "b")])], "page_id string, width double, height double, raw array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    assert [(r["reading_order"], r["text"], r["bbox"]["x2"]) for r in files.native_blocks(raw).orderBy("reading_order").collect()] == [(0, "a", 0.5), (2, "b", 1.0)]
    spans = spark.createDataFrame([([[("con", "X-Bold", 0), ("trast", "X", 16), (" ", "X", 0)], [("a", "X", 0)]],)], "s array<array<struct<text:string,font:string,flags:int>>>")
    assert spans.select(files.bold_lines(F.col("s")).alias("b")).first()["b"] == ["contrast"]
    pages = spark.createDataFrame([("a", False, 10.0, 10.0), ("b", True, 1.0, 1.0), ("c", False, 1e9, 1e9), ("d", False, None, None)], "document string, encrypted boolean, width double, height double")
    assert {r["document"]: r["reason"] for r in files.page_policy(pages, 10, 1e6).collect()} == {"a": None, "b": "encrypted", "c": "page_too_large", "d": "no_pages"}
    poly = spark.createDataFrame([([(10.0, 20.0), (30.0, 5.0)],)], "p array<struct<x:double,y:double>>")
    assert tuple(poly.select(files.polygon_box(F.col("p"), F.lit(100.0), F.lit(100.0)).alias("b")).first()["b"]) == (0.1, 0.05, 0.3, 0.2, "normalized")


def test_folders_artifacts_snapshots(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"x": 1}))
    assert [tuple(r) for r in files.json_folder(spark, str(tmp_path / "j"), "x int").collect()] == [(1, "a.json")]
    accepted, rejected = files.binary_artifacts(spark, str(tmp_path / "j"), 1000)
    assert accepted.count() == 1 and rejected.count() == 0
    decoded = files.decode_pages(accepted, lambda b: [{"page_number": i, "text": b.decode()[:i]} for i in (1, 2)], "page_number int, text string")
    assert [r["text"] for r in decoded.orderBy("page_number").collect()] == ["{", '{"']
    digest, path = sinks.put_artifact(spark, str(tmp_path / "cas"), b"abc", "txt")
    assert sinks.put_artifact(spark, str(tmp_path / "cas"), b"abc", "txt") == (digest, path)
    df = spark.range(10).selectExpr("cast(id AS string) AS id", "'r' AS record")
    sinks.snapshot(df, str(tmp_path / "snap"))
    assert sinks.restore(spark, str(tmp_path / "snap")).count() == 10
    next((tmp_path / "snap" / "data").glob("*.parquet")).unlink()
    with pytest.raises(ValueError):
        sinks.restore(spark, str(tmp_path / "snap"))
    sinks.write_json_lines(df, str(tmp_path / "lines"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 10
    assert sinks.workbook(df) == sinks.workbook(df.repartition(1)) and sinks.workbook(df)[:2] == b"PK"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = [("t1", "r1", "READY", "2025-01-01 00:00:00"), ("t1", "r1", "READY", "2025-01-01 00:01:00"), ("t2", "r1", "QUEUED", "2025-01-01 00:02:00"), ("t3", "r1", "COMPLETED", "2025-01-01 00:03:00"), ("t4", "r1", "STARTING", "2025-01-01 00:04:00")]
    spark.createDataFrame(rows, "task string, run_id string, state string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("task string, run_id string, state string, at timestamp").parquet(source)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(runs.claims(stream(), "task", "at"), "claims", "append")) == 4
    latest = run(runs.latest_states(stream(), "run_id", "at", "state"), "latest", "complete")
    assert [r["state"] for r in latest] == ["STARTING"]
    machine = run(runs.state_machine(stream()), "machine", "append")
    assert [(r["after"], r["allowed"]) for r in machine] == [("READY", True), ("READY", False), ("QUEUED", True), ("COMPLETED", False), ("STARTING", True)]
