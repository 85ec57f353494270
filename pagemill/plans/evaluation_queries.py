"""Queries of evaluation, layout, published datasets and the driver's star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import evaluate, gold, media, segment
from pagemill.plans.book_queries import _LATEST, _ENTRY_LINES, blocks, entries, vocabulary
from pagemill.session import latest, read
from pagemill.sources import sinks
from pagemill.streaming import runs


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "media_overlay"), "source_media_id", "exported_at")


def _prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "media_prediction"), "source_media_id", "exported_at")


def media_lemma_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the multiset score of predicted media lemmas against the overlay."""
    return evaluate.multiset_f1(_prediction(spark, sf_dir).where("lemma IS NOT NULL"), _overlay(spark, sf_dir).where("lemma IS NOT NULL"), ["sample_id"], "lemma")


def media_worst_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score over pages of two layers: lemmas and roles."""
    p, o = _prediction(spark, sf_dir), _overlay(spark, sf_dir)
    layers = [evaluate.multiset_f1(p, o, ["sample_id"], c).withColumn("layer", F.lit(c)) for c in ("lemma", "media_role")]
    return evaluate.worst_of(layers[0].unionByName(layers[1]))


def media_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the predicted fields where the overlay has a value."""
    return evaluate.field_accuracy(_prediction(spark, sf_dir), _overlay(spark, sf_dir), ["source_media_id"], ["media_order", "sha256", "media_role", "lemma"], "exported_at")


def media_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the overlay per role in one pass."""
    return _overlay(spark, sf_dir).groupBy("media_role").agg(
        F.count("*").alias("n_media"), F.count_distinct("document_sha256", "page_number").alias("n_pages"), F.count_if(F.expr("coalesce(lemma, '') = ''")).alias("n_without_lemma"),
        F.count_if(F.expr("NOT coalesce(rlike(sha256, '^[0-9a-f]{64}$'), false)")).alias("n_bad_digest"), F.count_if(F.col("human_decision") == "CORRECT_ASSOCIATION").alias("n_corrected"), F.max("width").alias("widest"))


def media_order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose media are not numbered 1 to n."""
    g = _overlay(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("n"), F.min("media_order").alias("first"), F.max("media_order").alias("last"), F.count_distinct("media_order").alias("n_orders"))
    return g.where("first <> 1 OR last <> n OR n_orders <> n")


def duplicate_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas that several vocabulary rows of a run have."""
    return evaluate.duplicates(vocabulary(spark, sf_dir).where("lemma IS NOT NULL"), ["processing_run_id", "lemma"])


REQUIRED_TAGS = ["BOUNDARY_ENTRY", "CROSS_PAGE", "NORMAL", "PREVIEW_TABLE", "WORD_LIST_HEADER"]


def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the required layout tags that none of its pages has."""
    pages = latest(read(spark, sf_dir, "gold_pages"), "sample_id", "received_at", "document_sha256", "layout_tags")
    return evaluate.coverage(pages, "document_sha256", "layout_tags", REQUIRED_TAGS)


def page_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with media in the overlay only or in the prediction only."""
    return evaluate.set_difference(read(spark, sf_dir, "media_overlay"), read(spark, sf_dir, "media_prediction"), ["sample_id"])


def common_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiset of lemmas that both copies have."""
    a = _overlay(spark, sf_dir).select("lemma").where("lemma IS NOT NULL")
    return a.intersectAll(_prediction(spark, sf_dir).select("lemma").where("lemma IS NOT NULL")).groupBy("lemma").agg(F.count("*").alias("n"))


def gold_record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical record of each vocabulary entry, by its hash."""
    return gold.gold_records(vocabulary(spark, sf_dir), entries(spark, sf_dir)).select("id", "lemma", F.get_json_object("record", "$.source_pages").alias("pages"), F.get_json_object("record", "$.senses[0].part_of_speech").alias("pos"), F.json_array_length(F.get_json_object("record", "$.source_fields")).alias("n_fields"))


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat form of the dataset."""
    return gold.table_rows(vocabulary(spark, sf_dir), entries(spark, sf_dir))


def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash per run over its vocabulary."""
    v = vocabulary(spark, sf_dir)
    return gold.set_digest(v, ["processing_run_id"], "vocabulary_entry_id", F.sha2(F.concat_ws("\n", "lemma", F.coalesce("definition", F.lit(""))), 256))


def header_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each heading and page number the nearest blocks above and below, and what it overlaps."""
    b = blocks(spark, sf_dir).where("bbox IS NOT NULL").select("page_id", F.col("source_block_id").alias("block_id"), "block_type", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")
    regions = b.where("block_type <> 'TEXT'").withColumnRenamed("block_id", "region_id")
    return media.neighbours(regions, b.where("block_type = 'TEXT'"))


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with blocks next to each other, the blocks read less than surely being set as a second column."""
    b = blocks(spark, sf_dir).where("bbox IS NOT NULL").select("page_id", F.col("source_block_id").alias("block_id"), "confidence", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")
    moved = F.col("confidence") < 0.8
    b = b.withColumns({"x1": F.when(moved, 1 + F.col("x1")).otherwise(F.col("x1")), "x2": F.when(moved, 1 + F.col("x2")).otherwise(F.col("x2")), "y1": F.when(moved, F.col("y1") - 0.04).otherwise(F.col("y1")), "y2": F.when(moved, F.col("y2") - 0.04).otherwise(F.col("y2"))})
    return media.side_by_side_pages(b)


def previous_page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each page and of exactly the page before."""
    pages = entries(spark, sf_dir).select(F.col("document_version_id").alias("document"), F.explode("source_pages").alias("page_number"), F.col("source_entry_id").alias("entry_id"), "entry_order")
    distinct_orders = pages.groupBy("document", "page_number", "entry_order").agg(F.max("entry_id").alias("entry_id"))
    return media.last_entry_of_previous_page(distinct_orders)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per status as metric lines."""
    counts = vocabulary(spark, sf_dir).groupBy("machine_verification_status").agg(F.count("*").alias("n"))
    return sinks.metric_lines(counts, "vocabulary_entries", ["machine_verification_status"])


def entry_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty entries in order of creation."""
    return entries(spark, sf_dir).orderBy(F.desc("created_at"), "source_entry_id").offset(50).limit(50).select("source_entry_id", "lemma", "created_at")


def preflight_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market segment and brand: orders, distinct parts and quantity, over a chain of joins."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("c_mktsegment", "p_brand").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts"), F.sum("l_quantity").cast("bigint").alias("quantity"))


def unsold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in no line item of fifty."""
    return read(spark, sf_dir, "part").join(read(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_brand")


def user_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    e = read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return runs.latest_states(e, "user_id", "at", "event_type").select("user_id", F.col("at.event_id").alias("event_id"), "event_type")


def user_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days on which a user was active."""
    e = read(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"))
    return segment.page_islands(e, "user_id", "day")


def user_carried_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase or signup before or at each event, carried forward per user."""
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    mark = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_id"))
    return runs.carried(e, "user_id", "day", ["ts", "event_id"], mark, "marked_by").select("event_id", "user_id", "marked_by")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    e = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return runs.window_counts(e, "at", "event_type", "1 hour", "1 day").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


_MEDIA = """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_media_id ORDER BY exported_at DESC) AS n FROM media_overlay) WHERE n = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_media_id ORDER BY exported_at DESC) AS n FROM media_prediction) WHERE n = 1)"""


def _f1(item: str, where: str = "true") -> str:
    norm = f"lower(trim(regexp_replace(coalesce({item}, ''), '[\\s\\p{{Z}}]+', ' ', 'g')))"
    return f"""SELECT sample_id, tp, np - tp AS fp, nt - tp AS fn, round(CASE WHEN np = 0 THEN 1 ELSE tp / np END, 6) AS precision, round(CASE WHEN nt = 0 THEN 1 ELSE tp / nt END, 6) AS recall,
 round(CASE WHEN tp = 0 AND np > 0 AND nt > 0 THEN 0 WHEN np + nt = 0 THEN 1 ELSE coalesce(2 * (CASE WHEN np = 0 THEN 1 ELSE tp / np END) * (CASE WHEN nt = 0 THEN 1 ELSE tp / nt END) / nullif((CASE WHEN np = 0 THEN 1 ELSE tp / np END) + (CASE WHEN nt = 0 THEN 1 ELSE tp / nt END), 0), 0) END, 6) AS f1, np = tp AND nt = tp AS exact
 FROM (SELECT s.sample_id, (SELECT count(*) FROM p WHERE p.sample_id = s.sample_id AND {where}) AS np, (SELECT count(*) FROM o WHERE o.sample_id = s.sample_id AND {where}) AS nt, coalesce(t.tp, 0) AS tp
 FROM (SELECT sample_id FROM o WHERE {where} UNION SELECT sample_id FROM p WHERE {where}) s LEFT JOIN (SELECT sample_id, count(*) AS tp FROM (SELECT sample_id, {norm} FROM p WHERE {where} INTERSECT ALL SELECT sample_id, {norm} FROM o WHERE {where}) GROUP BY 1) t ON s.sample_id = t.sample_id)"""


QUERIES = {f.__name__: f for f in (
    media_lemma_f1, media_worst_layer, media_field_accuracy, media_metrics, media_order_gaps, duplicate_lemmas, tag_coverage, page_set_difference, common_lemmas, gold_record_digests, gold_table, run_digests,
    header_neighbours, side_by_side, previous_page_entries, status_counts, entry_page_two, preflight_chain, unsold_parts, user_latest_state, user_islands, user_carried_type, hourly_counts,
)}

_TAG_LIST = ", ".join(f"'{t}'" for t in REQUIRED_TAGS)
SQL = {
    "media_lemma_f1": _MEDIA + _f1("lemma", "lemma IS NOT NULL"),
    "media_worst_layer": _MEDIA + f", l AS (SELECT 'lemma' AS layer, * FROM ({_f1('lemma')}) UNION ALL SELECT 'media_role', * FROM ({_f1('media_role')})) SELECT layer, count(*) AS n_pages, min(f1) AS least, bool_and(exact) AS all_exact FROM l GROUP BY 1",
    "media_field_accuracy": _MEDIA + ", j AS (SELECT o.*, p.source_media_id AS pid, p.media_order AS p1, p.sha256 AS p2, p.media_role AS p3, p.lemma AS p4 FROM o LEFT JOIN p ON o.source_media_id = p.source_media_id), x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS t, CAST(p{i} AS VARCHAR) AS q FROM j" for i, c in enumerate(("media_order", "sha256", "media_role", "lemma"), 1))
    + ") SELECT field, count(*) AS n_truth, count(*) FILTER (lower(trim(t)) = lower(trim(coalesce(q, '')))) AS n_equal, round(count(*) FILTER (lower(trim(t)) = lower(trim(coalesce(q, '')))) / count(*), 6) AS accuracy FROM x WHERE trim(coalesce(t, '')) <> '' GROUP BY 1",
    "media_metrics": _MEDIA + "SELECT media_role, count(*) AS n_media, count(DISTINCT (document_sha256, page_number)) AS n_pages, count(*) FILTER (coalesce(lemma, '') = '') AS n_without_lemma, count(*) FILTER (NOT coalesce(regexp_matches(sha256, '^[0-9a-f]{64}$'), false)) AS n_bad_digest, count(*) FILTER (human_decision = 'CORRECT_ASSOCIATION') AS n_corrected, max(width) AS widest FROM o GROUP BY 1",
    "media_order_gaps": _MEDIA + "SELECT sample_id, count(*) AS n, min(media_order) AS first, max(media_order) AS last, count(DISTINCT media_order) AS n_orders FROM o GROUP BY 1 HAVING min(media_order) <> 1 OR max(media_order) <> count(*) OR count(DISTINCT media_order) <> count(*)",
    "duplicate_lemmas": _LATEST + "SELECT processing_run_id, lemma, count(*) AS n FROM voc WHERE lemma IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "tag_coverage": f"""WITH g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY received_at DESC) AS n FROM gold_pages) WHERE n = 1), t AS (SELECT document_sha256, unnest(layout_tags) AS tag FROM g), d AS (SELECT DISTINCT document_sha256 FROM g)
 SELECT d.document_sha256, CAST((SELECT count(DISTINCT coalesce(tag, '?')) FROM t WHERE t.document_sha256 = d.document_sha256) AS INT) AS n_tags, coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT unnest([{_TAG_LIST}]) AS r) WHERE r NOT IN (SELECT tag FROM t WHERE t.document_sha256 = d.document_sha256 AND tag IS NOT NULL)), '') AS missing FROM d""",
    "page_set_difference": "SELECT sample_id, 'left' AS side FROM (SELECT sample_id FROM media_overlay EXCEPT SELECT sample_id FROM media_prediction) UNION ALL SELECT sample_id, 'right' FROM (SELECT sample_id FROM media_prediction EXCEPT SELECT sample_id FROM media_overlay)",
    "common_lemmas": _MEDIA + "SELECT lemma, count(*) AS n FROM (SELECT lemma FROM o WHERE lemma IS NOT NULL INTERSECT ALL SELECT lemma FROM p WHERE lemma IS NOT NULL) GROUP BY 1",
    "gold_record_digests": _LATEST + _ENTRY_LINES + ", nf AS (SELECT source_entry_id, count(*) AS n FROM fld GROUP BY 1) SELECT vocabulary_entry_id AS id, voc.lemma, '[' || coalesce(array_to_string(ent.source_pages, ','), '') || ']' AS pages, part_of_speech AS pos, CAST(coalesce(nf.n, 0) AS INT) AS n_fields FROM voc LEFT JOIN ent ON voc.source_entry_id = ent.source_entry_id LEFT JOIN nf ON nf.source_entry_id = ent.source_entry_id",
    "gold_table": _LATEST + "SELECT vocabulary_entry_id AS id, voc.lemma, language, machine_verification_status AS status, ipa, part_of_speech, definition, voc.source_entry_id, array_to_string(ent.source_pages, ' | ') AS source_pages FROM voc LEFT JOIN ent ON voc.source_entry_id = ent.source_entry_id",
    "run_digests": _LATEST + """, d AS (SELECT processing_run_id, sha256(vocabulary_entry_id)[1:4] AS b, vocabulary_entry_id AS k, sha256(concat_ws(chr(10), lemma, coalesce(definition, ''))) AS d FROM voc),
 i AS (SELECT processing_run_id, b, sha256(string_agg(d, chr(10) ORDER BY k)) AS d, count(*) AS n FROM d GROUP BY 1, 2), h AS (SELECT processing_run_id, b[1:2] AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d, sum(n) AS n FROM i GROUP BY 1, b[1:2])
 SELECT processing_run_id, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n_rows FROM h GROUP BY 1""",
    "header_neighbours": _LATEST + """, b AS (SELECT page_id, source_block_id AS id, block_type, bbox.x1 AS x1, bbox.y1 AS y1, bbox.x2 AS x2, bbox.y2 AS y2, (bbox.y1 + bbox.y2) / 2 AS m FROM blk WHERE bbox IS NOT NULL), r AS (SELECT * FROM b WHERE block_type <> 'TEXT'), t AS (SELECT * FROM b WHERE block_type = 'TEXT')
 SELECT r.page_id, r.id AS region_id, (SELECT t.id FROM t WHERE t.page_id = r.page_id AND t.m < r.y1 ORDER BY t.y2 DESC, t.id DESC LIMIT 1) AS above_id, (SELECT t.id FROM t WHERE t.page_id = r.page_id AND t.m > r.y2 ORDER BY t.y1, t.id LIMIT 1) AS below_id,
 (SELECT count(*) FROM t WHERE t.page_id = r.page_id AND t.m >= r.y1 AND t.m <= r.y2 AND t.x1 < r.x2 AND t.x2 > r.x1) AS n_overlapping FROM r""",
    "side_by_side": _LATEST + """, b0 AS (SELECT *, coalesce(confidence < 0.8, false) AS mv FROM blk WHERE bbox IS NOT NULL AND bbox.y2 > bbox.y1),
 b AS (SELECT page_id, source_block_id AS id, CASE WHEN mv THEN 1 + bbox.x1 ELSE bbox.x1 END AS x1, CASE WHEN mv THEN bbox.y1 - 0.04 ELSE bbox.y1 END AS y1, CASE WHEN mv THEN 1 + bbox.x2 ELSE bbox.x2 END AS x2, CASE WHEN mv THEN bbox.y2 - 0.04 ELSE bbox.y2 END AS y2 FROM b0)
 SELECT DISTINCT a.page_id FROM b a JOIN b ON a.page_id = b.page_id AND a.x2 <= b.x1 WHERE least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0.5 * least(a.y2 - a.y1, b.y2 - b.y1)""",
    "previous_page_entries": _LATEST + """, e AS (SELECT document_version_id AS document, unnest(source_pages) AS page_number, source_entry_id, entry_order FROM ent), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document, page_number ORDER BY entry_order DESC NULLS LAST, source_entry_id DESC) AS n FROM e WHERE entry_order IS NOT NULL) WHERE n = 1)
 SELECT l.document, l.page_number, l.source_entry_id AS last_entry, q.source_entry_id AS previous_entry FROM l LEFT JOIN l q ON l.document = q.document AND q.page_number = l.page_number - 1""",
    "status_counts": _LATEST + "SELECT 'vocabulary_entries{machine_verification_status=\"' || coalesce(machine_verification_status, '') || '\"} ' || count(*) AS line FROM voc GROUP BY machine_verification_status",
    "entry_page_two": _LATEST + "SELECT source_entry_id, lemma, created_at FROM ent ORDER BY created_at DESC, source_entry_id LIMIT 50 OFFSET 50",
    "preflight_chain": "SELECT c_mktsegment, p_brand, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "unsold_parts": "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)",
    "user_latest_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "user_islands": """WITH d AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS day FROM events), s AS (SELECT *, CASE WHEN lag(day) OVER (PARTITION BY user_id ORDER BY day) = day - 1 THEN 0 ELSE 1 END AS st FROM d), i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY day) AS isl FROM s)
 SELECT user_id, min(day) AS first_page, max(day) AS last_page, count(*) AS n_pages FROM i GROUP BY user_id, isl""",
    "user_carried_type": "SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS marked_by FROM events",
    "hourly_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
