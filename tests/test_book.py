import random

from pyspark.sql import functions as F

from pagemill.functions import grammar as G
from pagemill.functions import text as X
from pagemill.operators import parse, segment


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.squeezed(F.lit("　 a \t b\n"))) == "a b"
    assert one(spark, X.lines(F.lit("a\r\n b \x0b\n c"))) == ["a", "b", "c"]
    assert one(spark, X.joined(F.lit("一"), F.lit("b"))) == "一b"
    assert one(spark, X.joined(F.lit("a"), F.lit("b"))) == "a b"
    assert one(spark, X.effective_text(F.lit("r"), F.lit("DISCARD"), F.lit("c"))) == ""
    assert one(spark, X.effective_text(F.lit("r"), F.lit("ACCEPT"), F.lit("c"))) == "c"
    assert one(spark, X.effective_text(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("c"))) == ""
    assert one(spark, X.whole_number(F.lit("x"))) == 0 and one(spark, X.number(F.lit("x"))) == -1.0
    assert one(spark, X.is_digest(F.lit("a" * 64))) and not one(spark, X.is_digest(F.lit(None).cast("string")))
    assert one(spark, X.label_escaped(F.lit('a"\\\n'))) == 'a\\"\\\\\\n'
    assert one(spark, X.canonical_json(b=F.lit(None).cast("int"), a=F.lit("é"))) == '{"a":"é","b":null}'
    assert X.path_within("/r", "a/b") == "/r/a/b"
    for bad in ("../x", "/etc"):
        try:
            X.path_within("/r", bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_line_classes(spark):
    cases = {
        "": "EMPTY", "word  list 12": "WORD_LIST_HEADER", "词根/词缀预习表": "PREVIEW_TABLE_HEADER", "一 雅思必备": "NON_ENTRY_SECTION_HEADER", "Index": "NON_ENTRY_SECTION_HEADER", "well-known* [nəʊn]": "ENTRY_HEAD",
        "缀": "PREVIEW_TABLE", "例 x": "ENTRY_FIELD", "例x": "BODY_TEXT", "735": "PAGE_NUMBER", "音频": "DECORATION", "reading": "BODY_TEXT"}
    df = spark.createDataFrame([(k,) for k in cases], "line string").select("line", G.line_class(F.col("line")).alias("k"))
    assert {r["line"]: r["k"] for r in df.collect()} == cases


BLOCKS = "processing_run_id string, page_id string, page_number int, source_block_id string, reading_order int, raw_text string, bold_lines array<string>"


def segmented(spark, rows):
    found = segment.entries(segment.segment_lines(segment.ordered_lines(spark.createDataFrame(rows, BLOCKS))))
    return [(r["lemma"], r["raw_text"], r["block_ids"], r["source_pages"], r["confidence"], r["word_list"], r["starred"]) for r in found.orderBy("run", "entry_order").collect()]


def test_segment_cases(spark):
    lines = ["Word List 1", "medication* [ˌmedɪ]", "n. 药；药物", "搭 x", "12", "identify [aɪ]", "v. 认出", "词根/词缀预习表", "synthetic adj. 合成的", "一 雅思", "schedule [ˈʃe]"]
    got = segmented(spark, [("r", f"p{i // 4}", i // 4 + 1, f"b{i:02}", i, t, None) for i, t in enumerate(lines)])
    assert [(g[0], g[1], g[3], g[5], g[6]) for g in got] == [("medication", "medication* [ˌmedɪ]\nn. 药；药物\n搭 x", [1], 1, True), ("identify", "identify [aɪ]\nv. 认出", [2], 1, False)]
    bold = [("r", "p", 1, "b1", 0, "tunnel [ˈtʌ]\nx", None), ("r", "p", 1, "b2", 1, "contrast\n[ˈkɒn] n. 对比", ["contrast"]), ("r", "p", 1, "b3", None, "reading", [])]
    assert [(g[0], g[4]) for g in segmented(spark, bold)] == [("tunnel", 0.98), ("contrast", 0.97)]
    plain = [("r", "p", 1, "b1", 0, "CONTENTS\nabandon /əˈb/ v. to leave\nmore", None)]
    assert [(g[0], g[4]) for g in segmented(spark, plain)] == [("CONTENTS", 0.8)]
    assert segmented(spark, []) == []


def model(kinds):
    """A sequential reader of line classes, written as such."""
    entries, current, outside, preview = [], None, False, False
    heads = "H" in kinds
    for i, k in enumerate(kinds):
        if k in "WN":
            current, preview, outside = None, False, k == "N"
        elif outside:
            continue
        elif k == "P":
            current, preview = None, True
        elif k in "HB":
            preview, current = False, [i]
            entries.append(current)
        elif preview or k == "#":
            continue
        elif current is not None:
            current.append(i)
        elif k == "L" and not heads:
            current = [i]
            entries.append(current)
    return entries


def test_segment_against_sequential_model(spark):
    text = {"W": "Word List 1", "N": "INDEX", "P": "词根/词缀预习表", "H": "head [x]", "B": "bold", "#": "12", "L": "legacy", "T": "。"}
    rng = random.Random(4)
    rows, wanted = [], {}
    for run in range(40):
        kinds = "".join(rng.choice("WNPHB##LLTTT" if run % 2 else "WNPB#LLTT") for _ in range(30))
        wanted[f"r{run:02}"] = model(kinds)
        rows += [(f"r{run:02}", f"p{i // 3}", i // 3, f"b{i:03}", i % 3, text[k], ["bold"]) for i, k in enumerate(kinds)]
    got = segment.segment_lines(segment.ordered_lines(spark.createDataFrame(rows, BLOCKS))).collect()
    for run, entries in wanted.items():
        found = {}
        for r in got:
            if r["run"] == run:
                found.setdefault(tuple(r["entry_key"]), []).append(int(r["block_id"][1:]))
        assert sorted(sorted(v) for v in found.values()) == entries, run


def parsed(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(parse.parsed(F.col("t")).alias("p")).first()["p"]


def test_parser(spark):
    p = parsed(spark, "identify* [aɪ]\nv./n. 认出，\n识别\nn. 第二\n[pl.] 配件\n例\nfirst line\nsecond\n例 other\n记 助\n12\n派 x")
    assert (p["lemma"], p["starred"], p["ipa"]) == ("identify", True, "aɪ")
    assert [tuple(s) for s in p["senses"]] == [("v./n.", "认出，识别"), ("n.", "第二[pl.] 配件")]
    assert [tuple(f) for f in p["fields"]] == [("EXAMPLE", "first line second"), ("EXAMPLE", "other"), ("MEMORY_NOTE", "助"), ("DERIVATIVE", "x")]
    p = parsed(spark, "contrast\n[ˈkɒn] n. 对比\n[kənˈ]\nv. 对照")
    assert p["ipas"] == ["ˈkɒn", "kənˈ"] and p["ipa"] == "ˈkɒn" and len(p["senses"]) == 2
    p = parsed(spark, "word [w] n. a\nloose")
    assert [tuple(s) for s in p["senses"]] == [("n.", "a loose")]
    assert parsed(spark, "12 x") is None and parsed(spark, "") is None
    line = spark.createDataFrame([("abandon /əˈb/ v. to leave",), ("12",)], "t string").select(parse.parsed_line(F.col("t")).alias("p")).collect()
    assert tuple(line[0]["p"]) == ("abandon", "əˈb", "v.", "to leave") and line[1]["p"] is None


def test_islands(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), ("a", None), ("b", 7)], "g string, page_number int")
    assert {tuple(r) for r in segment.page_islands(df, "g").collect()} == {("a", 1, 2, 2), ("a", 5, 5, 1), ("b", 7, 7, 1)}
