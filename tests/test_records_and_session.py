import json

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.operators import gold, parse, segment


def test_dispatch(spark):
    texts = {
        "book": "medication* [ˌmedɪˈkeɪʃn]\nn. 药；药物\n记 词根记忆", "bare": "attack\nn./v. 进攻；抨击", "line": "record /ˈrekɔːd/ n./v. 记录；录制", "word": "abandon", "headless": "12 [x] y\nn. z", "none": "?? 12", "empty": " \n ", "null": None,
    }
    df = spark.createDataFrame(list(texts.items()), "id string, text string").select("id", parse.dispatched(F.col("text")).alias("p"))
    got = {r["id"]: r["p"] for r in df.collect()}
    assert {k: (p["parser"], p["failure"], p["lemma"]) for k, p in got.items()} == {
        "book": ("book", None, "medication"), "bare": ("book", None, "attack"), "line": ("line", None, "record"), "word": ("line", None, "abandon"), "headless": (None, "NO_HEADWORD", None), "none": (None, "NO_KNOWN_FORMAT", None),
        "empty": (None, "EMPTY_TEXT", None), "null": (None, "EMPTY_TEXT", None)}
    assert got["line"]["ipas"] == ["ˈrekɔːd"] and got["line"]["senses"][0]["definition"] == "记录；录制" and got["book"]["fields"][0]["type"] == "MEMORY_NOTE" and got["word"]["senses"] == []


def test_gold_dataset(spark):
    v = spark.createDataFrame(
        [("v1", "e1", "r", "medication", "x", "ˌmed", "n.", "old", "en", "AUTO"), ("v2", None, "r", "word", "x", None, None, None, None, None), ("v3", "gone", "r", "w", "x", None, "v.", "to go", "en", None)],
        "vocabulary_entry_id string, source_entry_id string, processing_run_id string, lemma string, display_form string, ipa string, part_of_speech string, definition string, language string, machine_verification_status string")
    e = spark.createDataFrame([("e1", [3, 4], "medication* [ˌmedɪˈkeɪʃn]\nn. 药\nv. 治\n例 one\n例 two\n记 note")], "source_entry_id string, source_pages array<int>, raw_text string")
    m = spark.createDataFrame([("v1", 2, "bb", "ROLE"), ("v1", 1, "aa", None)], "vocabulary_entry_id string, media_order int, sha256 string, media_role string")
    got = {r["id"]: json.loads(r["record"]) for r in gold.gold_dataset(v, e, m).collect()}
    assert [s["part_of_speech"] for s in got["v1"]["senses"]] == ["n.", "v."] and got["v1"]["source_fields"] == {"EXAMPLE": ["one", "two"], "MEMORY_NOTE": ["note"]}
    assert [x["sha256"] for x in got["v1"]["source_media"]] == ["aa", "bb"] and got["v1"]["source_pages"] == [3, 4]
    assert got["v2"]["senses"] == [] and got["v2"]["source_fields"] == {} and got["v2"]["language"] is None
    assert got["v3"]["senses"] == [{"definitions": ["to go"], "part_of_speech": "v."}]
    assert gold.gold_dataset(v.limit(0), e, m).count() == 0


def test_segmentation_carries_its_state_over_pages(spark):
    """Each page begins in the state the one before leaves: other sections, preview tables, entries that go on."""
    head, table, other, words = "alpha [æ]", "词根/词缀预习表", "一 雅思", "Word List 2"
    pages = [[head, "n. one"], ["still one"], [table, "cell"], ["cell again"], ["beta [b]"], ["of beta", other], ["hidden [h]"], ["still hidden"], [words, "after list"], ["gamma [g]", "end"]]
    rows = [("r", f"p{i}", i, f"b{i}", 0, "\n".join(ls), None) for i, ls in enumerate(pages)]
    rows += [(run, "p0", 0, "x", 0, "plain n. 一行\nmore", None) for run in ("q", None)] + [("r", None, None, None, None, "tail", None)]
    df = spark.createDataFrame(rows, "processing_run_id string, page_id string, page_number int, source_block_id string, reading_order int, raw_text string, bold_lines array<string>")
    got = segment.entries(segment.segment_lines(segment.ordered_lines(df)))
    found = {(r["run"], r["entry_order"]): (r["lemma"], r["raw_text"], r["source_pages"], r["word_list"]) for r in got.collect()}
    assert found["r", 1] == ("alpha", "alpha [æ]\nn. one\nstill one", [0, 1], None)
    assert found["r", 2] == ("beta", "beta [b]\nof beta", [4, 5], None)
    assert found["r", 3] == ("gamma", "gamma [g]\nend\ntail", [9], 2)
    assert found["q", 1][:2] == ("plain", "plain n. 一行\nmore") and found[None, 1][0] == "plain" and len(found) == 5


def test_intermediate_tables_are_removed(spark, tmp_path):
    df = spark.range(5)
    with session.intermediate_tables():
        kept = session.materialize(df, "inner")
        files = kept.inputFiles()
        assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
