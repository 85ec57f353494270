"""Queries of the two general problems: differences between two copies, deeply nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import diff, shred
from pagemill.session import read

MEDIA_FIELDS = [diff.Field("media_order"), diff.Field("sha256", diff.CASELESS), diff.Field("media_role", diff.TEXT), diff.Field("lemma", diff.TEXT)]


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlay, prediction = read(spark, sf_dir, "media_overlay"), read(spark, sf_dir, "media_prediction")
    return diff.compare_copies(overlay, prediction, "source_media_id", MEDIA_FIELDS, "exported_at", ("overlay", "prediction"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media rows absent on one side and every differing field."""
    return diff.difference_rows(_media(spark, sf_dir), "source_media_id").select("source_media_id", "difference")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with both values of each differing field."""
    return diff.difference_rows(_media(spark, sf_dir), "source_media_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = shred.shred_typed(read(spark, sf_dir, "gold_pages"), "received_at")
    raw = shred.shred_json(read(spark, sf_dir, "page_payloads"), "payload", "received_at")
    return shred.latest_pages(typed.unionByName(raw))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct child of the latest delivery of each page with its parent."""
    return shred.children(shred.node_table(_pages(spark, sf_dir)))


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat page table: the latest delivery of each page of both tables with its own fields."""
    ddl = "annotation_schema_version string, document_sha256 string, page_number int, layout_tags array<string>, review_status string, reviewer_id string, page_image_sha256 string, review_notes array<string>"
    return shred.flat_tables(shred.root_nodes(_pages(spark, sf_dir)), {"pages": ddl})["pages"].drop("parent_dewey", "node_id", "parent_id")


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat entry table of both tables with labels and parent links."""
    ddl = "source_entry_id string, lemma string, raw_text string, entry_order int, segmentation_confidence double, continuation_type string, source_pages array<int>"
    return shred.flat_tables(shred.node_table(_pages(spark, sf_dir)), {"entries": ddl})["entries"]


def p5_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat vocabulary table with labels and parent links."""
    ddl = "vocabulary_entry_id string, source_entry_id string, lemma string, display_form string, ipa string, part_of_speech string, definition string, machine_verification_status string"
    return shred.flat_tables(shred.node_table(_pages(spark, sf_dir)), {"vocabulary": ddl})["vocabulary"]


def p5_all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat block table of the latest delivery of each page of both tables, with every field of a block."""
    ddl = "source_block_id string, text string, raw_text string, block_type string, reading_order int, bbox struct<x1:double,y1:double,x2:double,y2:double,unit:string>, confidence double, source_engine string"
    table = shred.flat_tables(shred.node_table(_pages(spark, sf_dir)), {"blocks": ddl})["blocks"]
    box = [F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2", "unit")]
    return table.select("page_id", "dewey", "parent_id", "source_block_id", "text", "raw_text", "block_type", "reading_order", *box, "confidence", "source_engine")


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the flat block table that SQL can check: only pages that come as nested columns. See p5_all_blocks for the whole."""
    ddl = "source_block_id string, text string, block_type string, reading_order int, confidence double"
    pages = shred.latest_pages(shred.shred_typed(read(spark, sf_dir, "gold_pages"), "received_at"))
    return shred.flat_tables(shred.node_table(pages), {"blocks": ddl})["blocks"].select("page_id", "dewey", "parent_id", "source_block_id", "text", "block_type", "reading_order", "confidence")


def p5_payload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payloads were read, hold no page, or cannot be read."""
    return shred.payload_states(read(spark, sf_dir, "page_payloads"), "payload")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the latest pages: rows and pages of each schema path, as found in the data."""
    pages = _pages(spark, sf_dir)
    nodes = shred.root_nodes(pages).unionByName(shred.node_table(pages))
    return nodes.groupBy("path").agg(F.count("*").alias("n_nodes"), F.count_distinct("page_id").alias("n_pages"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_pages": p5_pages, "p5_entries": p5_entries, "p5_vocabulary": p5_vocabulary, "p5_all_blocks": p5_all_blocks, "p5_blocks": p5_blocks, "p5_payload_states": p5_payload_states, "p5_paths": p5_paths}

_MEDIA_SQL = r"""
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_media_id ORDER BY exported_at DESC) AS n FROM media_overlay) WHERE n = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_media_id ORDER BY exported_at DESC) AS n FROM media_prediction) WHERE n = 1),
j AS (SELECT o.source_media_id AS oid, p.source_media_id AS pid,
  CAST(o.media_order AS VARCHAR) AS o1, CAST(p.media_order AS VARCHAR) AS p1,
  lower(nullif(trim(o.sha256), '')) AS o2, lower(nullif(trim(p.sha256), '')) AS p2,
  nullif(trim(o.media_role), '') AS o3, nullif(trim(p.media_role), '') AS p3,
  nullif(trim(o.lemma), '') AS o4, nullif(trim(p.lemma), '') AS p4
  FROM o FULL JOIN p ON o.source_media_id = p.source_media_id),
d AS (
  SELECT oid AS source_media_id, 'missing_in_prediction' AS difference, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM j WHERE pid IS NULL
  UNION ALL SELECT pid, 'missing_in_overlay', NULL, NULL FROM j WHERE oid IS NULL
  UNION ALL SELECT oid, 'media_order', o1, p1 FROM j WHERE oid = pid AND o1 IS DISTINCT FROM p1
  UNION ALL SELECT oid, 'sha256', o2, p2 FROM j WHERE oid = pid AND o2 IS DISTINCT FROM p2
  UNION ALL SELECT oid, 'media_role', o3, p3 FROM j WHERE oid = pid AND o3 IS DISTINCT FROM p3
  UNION ALL SELECT oid, 'lemma', o4, p4 FROM j WHERE oid = pid AND o4 IS DISTINCT FROM p4)
"""

_GOLD_BLOCKS_SQL = """
WITH g AS (SELECT * FROM (SELECT sample_id, blocks, row_number() OVER (PARTITION BY sample_id ORDER BY received_at DESC) AS n FROM gold_pages) WHERE n = 1),
b AS (SELECT sample_id, unnest(blocks) AS b, unnest(range(len(blocks))) AS i FROM g)
SELECT sample_id AS page_id, '0.0.' || i AS dewey, sample_id AS parent_id, b.source_block_id AS source_block_id, b.text AS text, b.block_type AS block_type,
  b.reading_order AS reading_order, b.confidence AS confidence FROM b WHERE b IS NOT NULL
"""

def _elements(kind: str, col: str, ids: tuple[str, str]) -> str:
    """The objects of a collection in whatever form: a list, one object, objects by their id; with their places."""
    snake, camel = ids
    own = f"coalesce(x->>'$.{snake}', x->>'$.{camel}')"
    single = f"(json_exists({col}, '$.{snake}') OR json_exists({col}, '$.{camel}'))"
    return f"""{kind}_x AS (SELECT n, unnest(json_extract({col}, '$[*]')) AS x, NULL AS k, generate_subscripts(json_extract({col}, '$[*]'), 1) - 1 AS i FROM dec WHERE json_type({col}) = 'ARRAY'
 UNION ALL SELECT n, {col}, NULL, 0 FROM dec WHERE json_type({col}) = 'OBJECT' AND {single}
 UNION ALL SELECT n, json_extract({col}, '$."' || k || '"'), k, i FROM (SELECT n, {col}, unnest(json_keys({col})) AS k, generate_subscripts(json_keys({col}), 1) - 1 AS i FROM dec WHERE json_type({col}) = 'OBJECT' AND NOT {single})),
{kind} AS (SELECT n, x, i, coalesce({own}, k) AS id FROM {kind}_x WHERE json_type(x) = 'OBJECT')"""


def _text(*names: str) -> str:
    return "coalesce(" + ", ".join(f"x->>'$.{n}'" for n in names) + ")"


#: Each form of a payload spelled out, instead of a walk through the tree.
_NODES_SQL = f"""
WITH raw AS (SELECT CAST(payload AS JSON) AS j, received_at FROM page_payloads WHERE json_valid(payload)),
pg AS (SELECT coalesce(j->'$.data.page', j->'$.page', j) AS p, received_at FROM raw),
js AS (SELECT coalesce(p->>'$.sample_id', p->>'$.sampleId') AS sample_id, received_at, p FROM pg),
del AS (SELECT sample_id, received_at, p, NULL AS g FROM js WHERE sample_id IS NOT NULL UNION ALL SELECT sample_id, received_at, NULL, {{'b': blocks, 'e': entries, 'v': vocabulary}} FROM gold_pages),
las AS (SELECT *, row_number() OVER () AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY received_at DESC) AS rn FROM del) WHERE rn = 1),
dec AS (SELECT n, CASE WHEN json_type(p->'$.blocks') = 'VARCHAR' THEN CAST(p->>'$.blocks' AS JSON) ELSE p->'$.blocks' END AS b, CASE WHEN json_type(p->'$.entries') = 'VARCHAR' THEN CAST(p->>'$.entries' AS JSON) ELSE p->'$.entries' END AS e,
 CASE WHEN json_type(p->'$.vocabulary') = 'VARCHAR' THEN CAST(p->>'$.vocabulary' AS JSON) ELSE p->'$.vocabulary' END AS v FROM las WHERE p IS NOT NULL),
{_elements('bl', 'b', ('source_block_id', 'sourceBlockId'))},
{_elements('en', 'e', ('source_entry_id', 'sourceEntryId'))},
{_elements('vo', 'v', ('vocabulary_entry_id', 'vocabularyEntryId'))},
nest AS (SELECT n, id AS owner, i AS o, unnest(json_extract(x, '$.vocabulary[*]')) AS x, generate_subscripts(json_extract(x, '$.vocabulary[*]'), 1) - 1 AS i FROM en WHERE json_type(x->'$.vocabulary') = 'ARRAY'),
gb AS (SELECT n, unnest(to_json(g.b)->'$[*]') AS x, generate_subscripts(to_json(g.b)->'$[*]', 1) - 1 AS i FROM las WHERE g.b IS NOT NULL), ge AS (SELECT n, unnest(to_json(g.e)->'$[*]') AS x, generate_subscripts(to_json(g.e)->'$[*]', 1) - 1 AS i FROM las WHERE g.e IS NOT NULL),
gv AS (SELECT n, unnest(to_json(g.v)->'$[*]') AS x, generate_subscripts(to_json(g.v)->'$[*]', 1) - 1 AS i FROM las WHERE g.v IS NOT NULL),
ch AS (SELECT n, 'block' AS kind, id, NULL AS link, x, '0.0.' || i AS dewey FROM bl UNION ALL SELECT n, 'entry', id, NULL, x, '0.1.' || i FROM en UNION ALL SELECT n, 'vocabulary', id, {_text('source_entry_id', 'sourceEntryId')}, x, '0.2.' || i FROM vo
 UNION ALL SELECT n, 'vocabulary', {_text('vocabulary_entry_id', 'vocabularyEntryId')}, coalesce({_text('source_entry_id', 'sourceEntryId')}, owner), x, '0.1.' || o || '.2.' || i FROM nest
 UNION ALL SELECT n, 'block', x->>'$.source_block_id', NULL, x, '0.0.' || i FROM gb WHERE json_type(x) = 'OBJECT' UNION ALL SELECT n, 'entry', x->>'$.source_entry_id', NULL, x, '0.1.' || i FROM ge WHERE json_type(x) = 'OBJECT'
 UNION ALL SELECT n, 'vocabulary', x->>'$.vocabulary_entry_id', x->>'$.source_entry_id', x, '0.2.' || i FROM gv WHERE json_type(x) = 'OBJECT'),
nd AS (SELECT sample_id, kind, ch.id, x, dewey, regexp_replace(dewey, '\\.[^.]+\\.[^.]+$', '') AS parent_dewey, CASE WHEN kind <> 'vocabulary' THEN sample_id WHEN EXISTS (SELECT 1 FROM ch o WHERE o.n = ch.n AND o.kind = 'entry' AND o.id = ch.link) THEN ch.link ELSE '' END AS parent_id
 FROM ch JOIN las ON las.n = ch.n)
"""
_CAMEL = {c: "".join(w if k == 0 else w.capitalize() for k, w in enumerate(c.split("_"))) for c in (
    "source_entry_id", "vocabulary_entry_id", "source_block_id", "lemma", "display_form", "ipa", "part_of_speech", "definition", "machine_verification_status", "raw_text", "entry_order", "segmentation_confidence", "continuation_type", "text", "block_type", "reading_order", "confidence", "source_engine")}


def _fields(*names: str, **types: str) -> str:
    return ", ".join(f"CAST({_text(n, _CAMEL[n])} AS {types.get(n, 'VARCHAR')}) AS {n}" for n in names)


SQL = {
    "p2_found": _MEDIA_SQL + "SELECT source_media_id, difference FROM d",
    "p2_report": _MEDIA_SQL + "SELECT * FROM d",
    "p5_blocks": _GOLD_BLOCKS_SQL,
    "p5_found": _NODES_SQL + "SELECT DISTINCT sample_id, kind AS child_kind, id AS child_id, parent_id FROM nd WHERE id IS NOT NULL",
    "p5_vocabulary": _NODES_SQL + "SELECT sample_id AS page_id, dewey, parent_dewey, id AS node_id, parent_id, " + _fields("vocabulary_entry_id", "source_entry_id", "lemma", "display_form", "ipa", "part_of_speech", "definition", "machine_verification_status") + " FROM nd WHERE kind = 'vocabulary'",
    "p5_all_blocks": _NODES_SQL + "SELECT sample_id AS page_id, dewey, parent_id, " + _fields("text", "raw_text", "block_type", "reading_order", "confidence", "source_engine", reading_order="INT", confidence="DOUBLE") + ", id AS source_block_id, "
    + ", ".join(f"CAST(x->>'$.bbox.{c}' AS {'VARCHAR' if c == 'unit' else 'DOUBLE'}) AS bbox_{c}" for c in ("x1", "y1", "x2", "y2", "unit")) + " FROM nd WHERE kind = 'block'",
    "p5_payload_states": "SELECT CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'unreadable' WHEN coalesce(payload->>'$.data.page.sample_id', payload->>'$.data.page.sampleId', payload->>'$.page.sample_id', payload->>'$.page.sampleId', payload->>'$.sample_id', payload->>'$.sampleId') IS NULL THEN 'no_page' ELSE 'read' END AS state, count(*) AS n FROM page_payloads GROUP BY 1",
    "p5_paths": _NODES_SQL + "SELECT CASE kind WHEN 'block' THEN 'blocks' WHEN 'entry' THEN 'entries' ELSE kind END AS path, count(*) AS n_nodes, count(DISTINCT sample_id) AS n_pages FROM nd GROUP BY 1 UNION ALL SELECT 'pages', count(*), count(*) FROM las",
}
