import json

from pagemill.operators import shred

BLOCK = {"source_block_id": "b1", "text": "t", "bbox": {"x1": 0.1}}
ENTRY = {"source_entry_id": "e1", "lemma": "x"}
WORD = {"vocabulary_entry_id": "v1", "source_entry_id": "e1"}


def rows(spark, payloads):
    df = spark.createDataFrame([(p, t) for p, t in payloads], "payload string, at string")
    return {tuple(r) for r in shred.children(shred.node_table(shred.latest_pages(shred.shred_json(df, "payload", "at")))).collect()}


WANTED = {("s1", "block", "b1", "s1"), ("s1", "entry", "e1", "s1"), ("s1", "vocabulary", "v1", "e1")}


def test_shapes(spark):
    plain = {"sample_id": "s1", "blocks": [BLOCK, BLOCK], "entries": [ENTRY], "vocabulary": [WORD]}
    shapes = [
        plain,
        {"page": plain},
        {"meta": {"v": 1}, "data": {"page": plain}},
        {"sampleId": "s1", "blocks": [{"sourceBlockId": "b1"}], "entries": [{"sourceEntryId": "e1"}], "vocabulary": [{"vocabularyEntryId": "v1", "sourceEntryId": "e1"}]},
        {**plain, "blocks": {"b1": {"text": "t"}}, "entries": ENTRY},
        {**plain, "blocks": json.dumps([BLOCK])},
        {"sample_id": "s1", "blocks": [BLOCK], "entries": [{**ENTRY, "vocabulary": [{"vocabulary_entry_id": "v1"}]}]},
    ]
    for shape in shapes:
        assert rows(spark, [(json.dumps(shape), "1")]) == WANTED, shape


def test_links_nulls_latest_unreadable(spark):
    dangling = {"sample_id": "s1", "blocks": None, "entries": [], "vocabulary": [WORD, {"vocabulary_entry_id": "v2", "source_entry_id": None}, {"vocabulary_entry_id": None}, None]}
    got = rows(spark, [(json.dumps(dangling), "2"), (json.dumps({"sample_id": "s1", "blocks": [BLOCK]}), "1"), ('{"sample_id": "s1", "blo', "3"), (None, "4"), ("[]", "5"), ('{"sample_id": null}', "6")])
    assert got == {("s1", "vocabulary", "v1", ""), ("s1", "vocabulary", "v2", "")}
    assert rows(spark, []) == set()


def test_typed_pages_and_labels(spark):
    schema = "sample_id string, at string, blocks array<struct<source_block_id string, text string>>, entries array<struct<source_entry_id string>>, vocabulary array<struct<vocabulary_entry_id string, source_entry_id string>>, nodes string, ordering int"
    df = spark.createDataFrame([("s", "1", [("b", "x" * 100_000), None], [("e",)], [("v", "e"), ("w", "?")], "n", 1), (None, "1", None, None, None, "n", 1), ("empty", "1", None, [], None, "n", 1)], schema)
    nodes = shred.node_table(shred.latest_pages(shred.shred_typed(df, "at")))
    assert {(r["path"], r["dewey"], r["parent_dewey"], r["id"], r["parent_id"]) for r in nodes.collect()} == {
        ("blocks", "0.0.0", "0", "b", "s"), ("entries", "0.1.0", "0", "e", "s"), ("vocabulary", "0.2.0", "0", "v", "e"), ("vocabulary", "0.2.1", "0", "w", "")}
    table = shred.flat_tables(nodes, {"blocks": "source_block_id string, text string"})["blocks"]
    assert [len(r["text"]) for r in table.collect()] == [100_000]


def test_deep_json_does_not_crash():
    assert shred.json_nodes("[" * 100_000, "sample_id") == (None, [])
    assert shred.json_nodes('{"a": 1}', "sample_id") == (None, [])


def test_pages_against_plain_loops(spark, tiny):
    import re

    import pandas as pd

    from pagemill.plans.copies_and_nesting import p5_found

    def snake(x):
        if isinstance(x, dict):
            return {re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", k).lower(): snake(v) for k, v in x.items()}
        return [snake(v) for v in x] if isinstance(x, list) else x

    def listed(v, name):
        v = snake(json.loads(v)) if isinstance(v, str) else v
        if isinstance(v, dict):
            return [v] if name in v else [{**x, name: k} for k, x in v.items()]
        return [x for x in (v if v is not None else []) if x]

    pages = []
    for r in pd.read_parquet(f"{tiny}/gold_pages.parquet").to_dict("records"):
        pages.append((r["sample_id"], r["received_at"], *[listed(r[c], "") for c in ("blocks", "entries", "vocabulary")]))
    for r in pd.read_parquet(f"{tiny}/page_payloads.parquet").to_dict("records"):
        try:
            page = snake(json.loads(r["payload"]))
        except ValueError:
            continue
        page = page.get("page") or (page.get("data") or {}).get("page") or page
        b, e, v = (listed(page.get(c), i) for c, i in (("blocks", "source_block_id"), ("entries", "source_entry_id"), ("vocabulary", "vocabulary_entry_id")))
        v += [{**w, "source_entry_id": w.get("source_entry_id") or x["source_entry_id"]} for x in e for w in x.get("vocabulary") or []]
        pages.append((page["sample_id"], r["received_at"], b, e, v))
    latest = {}
    for p in sorted(pages, key=lambda p: p[1]):
        latest[p[0]] = p
    wanted = set()
    for s, _, b, e, v in latest.values():
        ids = {x["source_entry_id"] for x in e}
        wanted |= {(s, "block", x["source_block_id"], s) for x in b} | {(s, "entry", x["source_entry_id"], s) for x in e}
        wanted |= {(s, "vocabulary", x["vocabulary_entry_id"], x["source_entry_id"] if x.get("source_entry_id") in ids else "") for x in v}
    assert {tuple(r) for r in p5_found(spark, tiny).collect()} == wanted


def test_all_blocks_of_both_tables(spark, tiny):
    from pagemill.plans import copies_and_nesting as plans

    table = plans.QUERIES["p5_all_blocks"](spark, tiny).collect()
    gold = {tuple(r) for r in plans.p5_blocks(spark, tiny).collect()}
    columns = ("page_id", "dewey", "parent_id", "source_block_id", "text", "block_type", "reading_order", "confidence")
    assert gold < {tuple(r[c] for c in columns) for r in table}
    found = {(r["sample_id"], r["child_id"], r["parent_id"]) for r in plans.p5_found(spark, tiny).where("child_kind = 'block'").collect()}
    assert {(r["page_id"], r["source_block_id"], r["parent_id"]) for r in table} == found
    assert {r["bbox_unit"] for r in table} == {"normalized", None} and all(r["source_engine"] for r in table)


def test_page_and_entry_tables(spark, tiny):
    import pandas as pd

    from pagemill.plans import copies_and_nesting as plans

    fields = ["annotation_schema_version", "document_sha256", "page_number", "layout_tags", "review_status", "reviewer_id", "page_image_sha256", "review_notes"]
    latest = {}
    for table in ("gold_pages", "page_payloads"):
        for r in pd.read_parquet(f"{tiny}/{table}.parquet").to_dict("records"):
            try:
                page = r if table == "gold_pages" else json.loads(r["payload"])
            except ValueError:
                continue
            page = page.get("page") or (page.get("data") or {}).get("page") or page
            page = {shred._snake(k): v for k, v in page.items()}
            if r["received_at"] >= latest.get(page["sample_id"], (r["received_at"],))[0]:
                latest[page["sample_id"]] = (r["received_at"], page)
    plain = lambda v: list(v) if hasattr(v, "tolist") or isinstance(v, list) else None if v is None or v != v else v
    wanted = {s: [plain(p.get(f)) for f in fields] for s, (_, p) in latest.items()}
    assert {r["page_id"]: [r[f] for f in fields] for r in plans.QUERIES["p5_pages"](spark, tiny).collect()} == wanted

    table = plans.QUERIES["p5_entries"](spark, tiny).collect()
    found = {(r["sample_id"], r["child_id"], r["parent_id"]) for r in plans.p5_found(spark, tiny).where("child_kind = 'entry'").collect()}
    assert {(r["page_id"], r["source_entry_id"], r["parent_id"]) for r in table} == found
    assert all(r["lemma"] and r["raw_text"] and r["source_pages"] for r in table)


def test_root_nodes_and_lone_values(spark):
    page = {"sampleId": "s", "pageNumber": 4, "layoutTags": "NORMAL", "reviewNotes": ["[x", "y"], "entries": [{"source_entry_id": "e", "source_pages": 7}, {"source_entry_id": "f", "source_pages": [7, 8]}, {"source_entry_id": "g"}]}
    df = spark.createDataFrame([(json.dumps({"data": page}), "1")], "payload string, at string")
    pages = shred.latest_pages(shred.shred_json(df, "payload", "at"))
    nodes = shred.root_nodes(pages).unionByName(shred.node_table(pages))
    tables = shred.flat_tables(nodes, {"pages": "page_number int, layout_tags array<string>, review_notes array<string>", "entries": "source_entry_id string, source_pages array<int>"})
    assert [tuple(r) for r in tables["pages"].collect()] == [("s", "0", None, "s", None, 4, ["NORMAL"], ["[x", "y"])]
    assert {(r["parent_dewey"], r["source_entry_id"], tuple(r["source_pages"] or ())) for r in tables["entries"].collect()} == {("0", "e", (7,)), ("0", "f", (7, 8)), ("0", "g", ())}


DEEP = {"sample_id": "s", "page_number": 3, "media": [{"sha": "a"}], "blocks": [{"source_block_id": "b", "bbox": {"x1": 0.5}, "lines": [{"text": "one", "words": [{"w": "o", "marks": {"all": [{"m": 1}]}}, {"w": "p"}]}, {"text": "two"}]}]}
NODES = {
    ("blocks", "0.0.0", "0", "b", "s"), ("media", "0.media.0", "0", None, "s"), ("blocks.lines", "0.0.0.lines.0", "0.0.0", None, "b"), ("blocks.lines", "0.0.0.lines.1", "0.0.0", None, "b"),
    ("blocks.lines.words", "0.0.0.lines.0.words.0", "0.0.0.lines.0", None, ""), ("blocks.lines.words", "0.0.0.lines.0.words.1", "0.0.0.lines.0", None, ""), ("blocks.lines.words.marks/all", "0.0.0.lines.0.words.0.marks/all.0", "0.0.0.lines.0.words.0", None, ""),
}


def test_any_depth_and_discovered_fields(spark):
    raw = shred.shred_json(spark.createDataFrame([(json.dumps(DEEP), "1")], "payload string, at string"), "payload", "at")
    typed = spark.createDataFrame([(json.dumps(DEEP), "1")], "payload string, at string").selectExpr(
        "from_json(payload, 'sample_id string, page_number int, media array<struct<sha:string>>, blocks array<struct<source_block_id:string, bbox:struct<x1:double>, lines:array<struct<text:string, words:array<struct<w:string, marks:struct<`all`:array<struct<m:int>>>>>>>>>') AS p", "at").select("p.*", "at")
    for pages in (raw, shred.shred_typed(typed, "at")):
        pages = shred.latest_pages(pages)
        nodes = shred.node_table(pages)
        assert {(r["path"], r["dewey"], r["parent_dewey"], r["id"], r["parent_id"]) for r in nodes.collect()} == NODES
        tables = shred.flat_tables(shred.root_nodes(pages).unionByName(nodes))
        assert set(tables) == {"pages"} | {n[0] for n in NODES}
        assert tables["pages"].first()["page_number"] == 3 and tables["blocks"].first()["bbox"]["x1"] == 0.5
        assert sorted(r["w"] for r in tables["blocks.lines.words"].collect()) == ["o", "p"] and tables["blocks.lines.words.marks/all"].first()["m"] == 1


def test_payload_states(spark):
    df = spark.createDataFrame([(p,) for p in ('{"sample_id": "s"}', '{"sampleId": null}', "[]", '{"a', None, "[" * 100_000)], "payload string")
    assert {r["state"]: r["n"] for r in shred.payload_states(df, "payload").collect()} == {"read": 1, "no_page": 2, "unreadable": 2, "null": 1}
    assert shred.payload_states(df.limit(0), "payload").count() == 0
