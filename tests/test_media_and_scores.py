from pagemill.operators import evaluate, gold, media

MEDIA = "media_id string, page_id string, bbox struct<x1:double,y1:double,x2:double,y2:double>, separators array<double>, previous_entry string, previous_order int"
BLOCKS = "page_id string, block_id string, x1 double, y1 double, x2 double, y2 double, kinds array<string>, starts_entry boolean, entry_ids array<string>, entry_orders array<int>"


def decide(spark, blocks, rules, box=(0.1, 0.4, 0.5, 0.5), previous=(None, None)):
    m = spark.createDataFrame([("m", "p", box, rules, *previous)], MEDIA)
    b = spark.createDataFrame([("p", f"b{i}", *x) for i, x in enumerate(blocks)], BLOCKS)
    return media.associate(m, b).first()


def block(y1, y2, entries=(), starts=False, kinds=("BODY_TEXT",), x=(0.1, 0.9), orders=None):
    return (x[0], y1, x[1], y2, list(kinds), starts, list(entries), list(orders if orders is not None else range(1, len(entries) + 1)))


def test_association(spark):
    above, below = block(0.2, 0.3, ["e1"], True, orders=[1]), block(0.6, 0.7, ["e2"], True, orders=[2])
    d = decide(spark, [above, below], [0.55])
    assert (d["role"], d["entry_id"], d["reason"], d["warnings"]) == ("ENTRY_ILLUSTRATION", "e1", "ENTRY_BAND", [])
    d = decide(spark, [above, below], [0.35, 0.55])
    assert d["warnings"] == ["separator_between_entry_text_and_media"] and d["candidates"] == ["e1", "e2"] and d["confidence"] == 0.5
    assert decide(spark, [above, below], [])["warnings"] == ["no_separator_rules_on_page", "no_separator_before_next_entry"]
    assert decide(spark, [], [], box=(0.0, 0.0, 1.0, 0.9))["reason"] == "FULL_PAGE_IMAGE"
    assert decide(spark, [block(0.1, 0.2, kinds=["WORD_LIST_HEADER"])], [0.3])["reason"] == "WORD_LIST_HEADER_RESOURCE"
    assert decide(spark, [], [0.9])["warnings"] == ["no_preceding_entry"]
    d = decide(spark, [], [0.9], previous=("e0", 4))
    assert (d["entry_id"], d["status"]) == ("e0", "AUTO_VERIFIED")
    assert decide(spark, [], [0.2], previous=("e0", 4))["warnings"] == ["separator_above_media_at_page_top"]
    d = decide(spark, [block(0.6, 0.7, ["e1"])], [0.9])
    assert d["entry_id"] == "e1"
    assert decide(spark, [block(0.6, 0.7, ["e1"])], [0.55])["warnings"] == ["separator_inside_entry"]
    assert decide(spark, [above, block(0.6, 0.7, ["e3"])], [0.9])["warnings"] == ["media_between_different_entries"]
    assert decide(spark, [above, block(0.6, 0.7)], [0.9])["warnings"] == ["non_entry_text_below_media"]
    assert "owner_is_not_the_entry_preceding_next_headword" in decide(spark, [above, block(0.6, 0.7, ["e9"], True, orders=[9])], [0.55])["warnings"]
    assert "text_overlaps_media" in decide(spark, [above, block(0.4, 0.5)], [0.9])["warnings"]
    columns = [block(0.2, 0.3, ["e1"], True, x=(0.1, 0.4), orders=[1]), block(0.2, 0.3, ["e5"], True, x=(0.6, 0.9), orders=[5])]
    assert "multi_column_layout" in decide(spark, columns, [0.9])["warnings"]


def test_previous_page_is_exactly_one_before(spark):
    df = spark.createDataFrame([("d", 1, "a", 1), ("d", 1, "b", 2), ("d", 2, "c", 3), ("d", 4, "e", 4)], "document string, page_number int, entry_id string, entry_order int")
    assert {(r["page_number"], r["previous_entry"]) for r in media.last_entry_of_previous_page(df).collect()} == {(1, None), (2, "b"), (4, None)}


def test_scores(spark):
    p = spark.createDataFrame([("s", "A "), ("s", "a"), ("s", "x"), ("t", "q")], "g string, v string")
    t = spark.createDataFrame([("s", "a"), ("s", "b")], "g string, v string")
    got = {r["g"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in evaluate.multiset_f1(p, t, ["g"], "v").collect()}
    assert got == {"s": (1, 2, 1, 0.333333, 0.5, 0.4), "t": (0, 1, 0, 0.0, 1.0, 0.0)}
    a = spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("n", "", 1)], "k string, f string, o int")
    b = spark.createDataFrame([("k", "Y", 1)], "k string, f string, o int")
    assert [tuple(r) for r in evaluate.field_accuracy(b, a, ["k"], ["f"], "o").collect()] == [("f", 1, 1, 1.0)]
    assert {tuple(r) for r in evaluate.set_difference(p.select("g"), t.select("g"), ["g"]).collect()} == {("t", "left")}


def test_digest_does_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("'r' AS g", "cast(id AS string) AS k")
    from pyspark.sql import functions as F

    one = gold.set_digest(df.repartition(1), ["g"], "k", F.sha2("k", 256)).first()
    many = gold.set_digest(df.repartition(7), ["g"], "k", F.sha2("k", 256)).first()
    assert one == many and one["n_rows"] == 1000
    releases = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "processing_run_id string, version int, sha256 string")
    assert gold.next_release(releases, "r", "c") == 3 and gold.next_release(releases, "r", "a") is None and gold.next_release(releases, "q", "a") == 1
