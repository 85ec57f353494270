"""Queries of pages, media and checks between tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import evaluate, gold, media, parse, store
from pagemill.plans.book_queries import _ENTRY_LINES, _LATEST, _LINES, _ONE_LINE, _SPLIT, _squeeze, _strip, blocks, entries, resolutions, vocabulary
from pagemill.plans.evaluation_queries import _overlay, _prediction
from pagemill.session import latest, read
from pagemill.sources import files

#: Heads printed as surely as this have a rule above them in the derived layouts.
_RULED = 0.95


def _gold(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(read(spark, sf_dir, "gold_pages"), "sample_id", "received_at", *columns)


def media_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry each picture belongs to, or why none is decided.

    Pictures are derived from the blocks: one in every gap between two blocks of a page, one above the first block, and
    one over the whole page; rules lie above the heads that were read surely.
    """
    b = blocks(spark, sf_dir).where("bbox IS NOT NULL")
    layout = store.page_layout(b, entries(spark, sf_dir))
    sure = b.select(F.col("source_block_id").alias("block_id"), "confidence")
    rules = layout.join(sure, "block_id").where(F.col("starts_entry") & (F.col("confidence") >= _RULED)).groupBy("page_id").agg(F.array_sort(F.collect_set(F.col("y1") - 0.01)).alias("separators"))
    below = F.lead("y1").over(Window.partitionBy("page_id").orderBy("y1", "block_id"))
    box = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    gaps = layout.withColumn("below", below).where("below > y2").select(F.concat(F.lit("gap:"), "block_id").alias("media_id"), "page_id", box(F.lit(0.4), F.col("y2"), F.lit(0.6), F.col("below")).alias("bbox"))
    tops = layout.groupBy("page_id").agg(F.min("y1").alias("y")).select(F.concat(F.lit("top:"), "page_id").alias("media_id"), "page_id", box(F.lit(0.4), F.lit(0.0), F.lit(0.6), F.col("y")).alias("bbox"))
    whole = layout.select("page_id").distinct().select(F.concat(F.lit("page:"), "page_id").alias("media_id"), "page_id", box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"))
    held = layout.select("page_id", F.explode(F.arrays_zip("entry_orders", "entry_ids")).alias("e"))
    last = held.groupBy("page_id").agg(F.max(F.struct(F.col("e.entry_orders").alias("o"), F.col("e.entry_ids").alias("i"))).alias("last"))
    numbered = b.groupBy("page_id").agg(F.max(F.struct("document_version_id", "page_number")).alias("p")).select("page_id", "p.*")
    before = numbered.join(last, "page_id").groupBy("document_version_id", (F.col("page_number") + 1).alias("page_number")).agg(F.max("last").alias("last"))
    previous = numbered.join(before, ["document_version_id", "page_number"]).select("page_id", F.col("last.i").alias("previous_entry"), F.col("last.o").alias("previous_order"))
    found = media.associate(gaps.unionByName(tops).unionByName(whole).join(rules, "page_id", "left").join(previous, "page_id", "left"), layout)
    return found.withColumns({"warnings": F.array_join("warnings", ","), "candidates": F.array_join("candidates", ",")})


def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together again from the words of the blocks, as a recogniser delivers them: one row a word, all strings."""
    b = blocks(spark, sf_dir).where("bbox IS NOT NULL").select("page_id", F.coalesce("reading_order", F.lit(0)).alias("ro"), "confidence", "bbox", F.split(F.coalesce("raw_text", F.lit("")), " ").alias("ws"))
    w = b.select("page_id", "ro", "confidence", "bbox", F.posexplode("ws").alias("i", "text"))
    px = lambda c: F.round(F.col(c) * 1000).cast("int").cast("string")
    words = w.select(
        "page_id", F.lit("5").alias("level"), F.lit("1").alias("page_num"), F.col("ro").cast("string").alias("block_num"), F.lit("1").alias("par_num"), F.lit("x").alias("line_num"), F.col("i").cast("string").alias("word_num"),
        (F.round(F.col("bbox.x1") * 1000).cast("int") + 10 * F.col("i")).cast("string").alias("left"), px("bbox.y1").alias("top"), F.lit("9").alias("width"), F.lit("12").alias("height"),
        F.coalesce(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("?")).alias("conf"), "text")
    found = files.recognised_lines(words, ["page_id"])
    return found.select("page_id", "block_num", "line_num", "text", *[F.round(f"bbox.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("confidence", 6).alias("confidence"))


def native_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the pages' own text layer in points: order by place, empty blocks keep theirs, boxes clamped."""
    b = blocks(spark, sf_dir).where("bbox IS NOT NULL")
    one = F.struct("reading_order", "source_block_id", (F.col("bbox.x1") * 600).alias("x0"), (F.col("bbox.y1") * 800).alias("y0"), (F.col("bbox.x2") * 700).alias("x1"), (F.col("bbox.y2") * 800).alias("y1"), F.coalesce("raw_text", F.lit(" ")).alias("text"))
    raw = b.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("raw")).withColumns({"width": F.lit(500.0), "height": F.lit(800.0)})
    return files.native_blocks(raw).select("page_id", "reading_order", F.sha2("text", 256).alias("text_digest"), *[F.round(f"bbox.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")], "confidence")


def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the blocks given as polygons of four points that lie a little aslant."""
    b = blocks(spark, sf_dir).where("bbox IS NOT NULL")
    point = lambda x, y: F.struct((F.col(f"bbox.{x}") * 1000).alias("x"), (F.col(f"bbox.{y}") * 1400).alias("y"))
    box = files.polygon_box(F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")), F.lit(900.0), F.lit(1400.0))
    return b.select("source_block_id", *[F.round(box[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def bold_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each block that are bold on its page."""
    b = blocks(spark, sf_dir)
    page = b.select("page_id", F.explode("bold_lines").alias("l")).groupBy("page_id").agg(F.array_sort(F.collect_set("l")).alias("page_bold"))
    bold = files.block_bold_lines(F.coalesce("raw_text", F.lit("")), F.col("page_bold"))
    return b.join(page, "page_id").select("source_block_id", F.array_join(bold, "|").alias("bold")).where("bold <> ''")


def structured_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source entry by the parser its text asks for, with the reason if none reads it."""
    p = entries(spark, sf_dir).select("source_entry_id", parse.dispatched(F.col("raw_text")).alias("p"))
    return p.select("source_entry_id", "p.parser", "p.failure", "p.lemma", F.size("p.ipas").alias("n_ipas"), F.size("p.senses").alias("n_senses"), F.size("p.fields").alias("n_fields"))


def structured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by the parser their form asks for."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.explode(X.lines(F.col("text"))).alias("line"))
    p = d.select(parse.dispatched(F.col("line")).alias("p"))
    return p.groupBy(F.coalesce("p.parser", F.lit("none")).alias("parser"), F.coalesce("p.failure", F.lit("")).alias("failure")).agg(F.count("*").alias("n"), F.count_if(F.size("p.ipas") > 0).alias("n_with_ipa"), F.count_if(F.size("p.senses") > 0).alias("n_with_sense"))


def pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcription of an entry in order."""
    return parse.pronunciations_table(entries(spark, sf_dir), "source_entry_id", "raw_text")


def _tagged_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of the overlay with the vocabulary entries of their lemma."""
    o = _overlay(spark, sf_dir).where("lemma IS NOT NULL").select(X.comparable(F.col("lemma")).alias("k"), "media_order", "sha256", "media_role")
    return vocabulary(spark, sf_dir).where("lemma IS NOT NULL").select("vocabulary_entry_id", X.comparable(F.col("lemma")).alias("k")).join(o, "k").drop("k")


def gold_dataset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each published record by hash and length."""
    g = gold.gold_dataset(vocabulary(spark, sf_dir), entries(spark, sf_dir), _tagged_media(spark, sf_dir))
    return g.select("id", F.sha2("record", 256).alias("digest"), F.octet_length("record").alias("n_bytes"))


def gold_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published set of each run: records, media and bytes."""
    g = gold.gold_dataset(vocabulary(spark, sf_dir), entries(spark, sf_dir), _tagged_media(spark, sf_dir))
    n = F.json_array_length(F.get_json_object("record", "$.source_media"))
    return g.groupBy("run").agg(F.count("*").alias("record_count"), F.sum(n).cast("long").alias("source_media_count"), F.sum(F.octet_length("record")).alias("n_bytes"))


def missing_lemma_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary whose lemma no provenance record with a block of the entry's pages stands for."""
    p = parse.provenance(entries(spark, sf_dir), "source_entry_id", "block_ids", "raw_text").where("field_path = 'lemma' AND source_block_id IS NOT NULL")
    real = p.join(blocks(spark, sf_dir).where("page_id IS NOT NULL").select("source_block_id"), "source_block_id", "left_semi").select("source_entry_id")
    return vocabulary(spark, sf_dir).join(real, "source_entry_id", "left_anti").select("vocabulary_entry_id", F.lit("MISSING_LEMMA_PROVENANCE").alias("issue"))


def render_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the overlay whose image differs from the prediction's, or that one side does not know; null equals null."""
    one = lambda df, name: df.groupBy("document_sha256", "page_number").agg(F.max("page_image_sha256").alias(name))
    o, p = one(_overlay(spark, sf_dir), "expected"), one(_prediction(spark, sf_dir), "found").withColumn("known", F.lit(True))
    j = o.join(p, ["document_sha256", "page_number"], "left")
    return j.where(F.col("known").isNull() | ~F.col("expected").eqNullSafe(F.col("found"))).select("document_sha256", "page_number", F.when(F.col("known").isNull(), "missing").otherwise("differs").alias("reason"))


def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay and prediction pages one to one: pages on one side only, and pages that several samples claim."""
    one = lambda df, name: df.groupBy("document_sha256", "page_number").agg(F.count_distinct("sample_id").alias(name))
    j = one(_overlay(spark, sf_dir), "l").join(one(_prediction(spark, sf_dir), "r"), ["document_sha256", "page_number"], "full_outer")
    problem = F.when(F.col("r").isNull(), "overlay_only").when(F.col("l").isNull(), "prediction_only").when((F.col("l") > 1) | (F.col("r") > 1), "not_unique")
    return j.select("document_sha256", "page_number", problem.alias("problem")).where("problem IS NOT NULL")


def overlay_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pages, overlay and prediction by sample: what lacks, what differs, and overlays of no text page."""
    g = _gold(spark, sf_dir, "document_sha256", "page_number").select("sample_id", F.struct("document_sha256", "page_number").alias("g"))
    one = lambda df, name: df.groupBy("sample_id").agg(F.max(F.struct("document_sha256", "page_number")).alias(name))
    o, p = one(_overlay(spark, sf_dir), "o"), one(_prediction(spark, sf_dir), "p")
    state = F.when(F.col("o").isNull(), "media_annotation_missing").when(~F.col("o").eqNullSafe(F.col("g")), "differs_from_text").when(F.col("p").isNull(), "prediction_missing").otherwise("complete")
    known = g.join(o, "sample_id", "left").join(p, "sample_id", "left").select("sample_id", state.alias("state"))
    return known.unionByName(o.join(g, "sample_id", "left_anti").select("sample_id", F.lit("not_a_text_page").alias("state")))


def uncovered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with pages of which no block was read surely."""
    verified = blocks(spark, sf_dir).where("confidence >= 0.99").select("page_number").distinct()
    return store.outside(entries(spark, sf_dir).where("source_pages IS NOT NULL"), "source_pages", verified, "page_number", "source_entry_id").select("source_entry_id", F.array_join(F.transform("outside", lambda p: p.cast("string")), ",").alias("pages"))


def media_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a document's media in one pass: pages, detected, kept, bound, excluded, verified, broken, open."""
    o, p = _overlay(spark, sf_dir), _prediction(spark, sf_dir).select("source_media_id", F.col("sha256").alias("p_sha256"), F.lit(True).alias("detected"))
    lemmas = vocabulary(spark, sf_dir).where("lemma IS NOT NULL").select(F.col("lemma").alias("v_lemma")).distinct()
    heads = entries(spark, sf_dir).where("lemma IS NOT NULL").select(F.col("lemma").alias("e_lemma")).distinct()
    j = o.join(p, "source_media_id", "left").join(lemmas, F.col("lemma") == F.col("v_lemma"), "left").join(heads, F.col("lemma") == F.col("e_lemma"), "left")
    bound, role = F.expr("coalesce(trim(lemma), '') <> ''"), F.col("media_role")
    entry = role == "ENTRY_ILLUSTRATION"
    digest, other = X.is_digest(F.lower(F.trim("sha256"))), X.is_digest(F.lower(F.trim("p_sha256")))
    verified = F.col("human_decision").isNotNull()
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    return j.groupBy("document_sha256").agg(
        F.count_distinct("page_number").alias("total_pages"), F.count_distinct(F.when(F.col("detected"), F.col("page_number"))).alias("pages_scanned"), F.count_distinct(F.when(bound, F.col("page_number"))).alias("pages_with_media"),
        count(F.col("detected"), "media_detected"), count(digest, "media_extracted"), F.count("*").alias("media_persisted"), count(entry & F.col("e_lemma").isNotNull(), "associated_with_source_entry"),
        count(entry & F.col("v_lemma").isNotNull(), "associated_with_vocabulary_entry"), count(role == "NON_VOCABULARY", "excluded_non_vocabulary"), count(~verified, "auto_verified"), count(verified, "human_verified"),
        count(entry & ~bound, "unbound_media"), count((role == "UNRESOLVED") | role.isNull(), "unresolved_media"), count(F.col("detected").isNull(), "missing_media"), count(F.col("detected") & ~other, "missing_artifact"),
        count(~digest, "missing_sha256"), count(digest & other & (F.lower(F.trim("sha256")) != F.lower(F.trim("p_sha256"))), "broken_artifact"), count(entry & bound & F.col("e_lemma").isNull(), "broken_provenance"),
        count(F.col("review_status") != "HUMAN_VERIFIED", "open_media_reviews"))


def combined_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of the prediction against the overlay, put in one row: worst scores and whether all is exact."""
    p, o = _prediction(spark, sf_dir), _overlay(spark, sf_dir)

    def layer(column: str, name: str) -> DataFrame:
        s = evaluate.multiset_f1(p.withColumn("v", F.col(column).cast("string")), o.withColumn("v", F.col(column).cast("string")), ["sample_id"], "v")
        return s.agg(F.min("f1").alias(f"{name}_f1"), F.bool_and("exact").alias(f"{name}_exact"))

    one = layer("media_order", "order").crossJoin(layer("sha256", "bytes")).crossJoin(layer("lemma", "lemma"))  # one row each
    exact = F.col("order_exact") & F.col("bytes_exact") & F.col("lemma_exact")
    return one.withColumn("status", F.when(exact, "PASS").otherwise("FAIL"))


def new_source_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a second run over all entries adds to those of the entries on one page: what is there stays."""
    f = parse.fields_table(entries(spark, sf_dir), "source_entry_id", "raw_text")
    old = parse.fields_table(entries(spark, sf_dir).where("size(source_pages) = 1"), "source_entry_id", "raw_text")
    return store.insert_absent(old, f, ["source_entry_id", "field_type", "field_order"]).select("source_entry_id", "field_type", "field_order")


def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version the next release of each run gets, every day with new rows having been one."""
    v = vocabulary(spark, sf_dir).groupBy("processing_run_id").agg(F.count_distinct(F.col("created_at").cast("date")).alias("v"))
    runs = blocks(spark, sf_dir).select("processing_run_id").distinct()
    return runs.join(v, "processing_run_id", "left").select("processing_run_id", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"))


def redacted_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit queue without any text: ids, pages, reasons and how much was left out."""
    q = store.audit_queue(blocks(spark, sf_dir), entries(spark, sf_dir))
    return q.select("kind", "row_id", F.size("pages").alias("n_pages"), "reason", F.length("excerpt").alias("n_hidden"))


def public_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media as they are shown: trimmed texts or null, the file's name by its hash, no reviewer."""
    name = F.when(X.is_digest(F.lower(F.trim("sha256"))), F.concat(F.left(F.lower(F.trim("sha256")), F.lit(2)), F.lit("/"), F.lower(F.trim("sha256"))))
    return _overlay(spark, sf_dir).select("source_media_id", "page_number", "media_order", X.blank_to_null(F.col("lemma")).alias("lemma"), X.blank_to_null(F.col("media_role")).alias("media_role"), name.alias("object_key"), "width", "height")


def reviews_with_status(spark: SparkSession, sf_dir: str, status: str | None = "accept") -> DataFrame:
    """Reviews of one status, whatever its letter case; of all without one."""
    r = resolutions(spark, sf_dir)
    return (r if status is None else r.where(F.upper("decision") == status.upper())).select("resolution_id", "decision", X.blank_to_null(F.col("notes")).alias("notes"))


def layout_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a page from its text, blocks, columns, phonetic letters, table marks and images."""
    b = blocks(spark, sf_dir).withColumn("t", F.coalesce("raw_text", F.lit("")))
    letters = "ˈˌːəɪʊɔɜʌæɑʃʒθðŋɡɒ"
    images = _overlay(spark, sf_dir).groupBy("page_number").agg(F.count("*").alias("n_images"))
    signals = F.size(F.split("t", r"词根|词缀|含义|Word List")) - 1
    p = b.groupBy("page_id").agg(
        F.max("page_number").alias("page_number"), F.sum(F.length("t")).alias("n_chars"), F.count("*").alias("n_blocks"), F.sum(F.length("t") - F.length(F.translate("t", letters, ""))).alias("n_ipa"), F.sum(signals).alias("n_signals"),
        F.bool_or(F.col("t").contains("索引") | F.col("t").contains("Index")).alias("index"), F.bool_or(F.col("t").contains("Word List")).alias("list"), F.count_if(F.col("bbox.x2") < 0.5).alias("n_left"), F.count_if(F.col("bbox.x1") > 0.45).alias("n_right"))
    p = p.join(images, "page_number", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    tag = lambda name, test: F.when(test, F.lit(name))
    tags = F.array_compact(F.array(
        tag("DOUBLE_COLUMN", (F.col("n_left") >= 2) & (F.col("n_right") >= 2)), tag("IMAGE", F.col("n_images") > 0), tag("INDEX", F.col("index")), tag("IPA_DENSE", F.col("n_ipa") >= 20), tag("NORMAL", (F.col("n_chars") >= 500) & (F.col("n_blocks") >= 5)),
        tag("OCR_HARD", (F.col("n_chars") <= 50) & (F.col("n_images") > 0)), tag("SPECIAL_LAYOUT", F.col("list") | (F.col("n_signals") >= 3)), tag("TABLE", F.col("n_signals") >= 2),
    ))
    return p.select("page_id", F.array_join(tags, ",").alias("tags"))


QUERIES = {f.__name__: f for f in (
    media_decisions, recognised_lines, native_page_blocks, polygon_boxes, bold_block_lines, structured_entries, structured_lines, pronunciations, gold_dataset_digests, gold_datasets, missing_lemma_provenance, render_mismatches,
    page_identity, overlay_coverage, uncovered_entries, media_counters, combined_benchmark, new_source_fields, next_versions, redacted_queue, public_media, reviews_with_status, layout_tags,
)}

_MEDIA = """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_media_id ORDER BY exported_at DESC) AS n FROM media_overlay) WHERE n = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_media_id ORDER BY exported_at DESC) AS n FROM media_prediction) WHERE n = 1)"""
_BLANKS = r"'^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$'"
_IS_DIGEST = "coalesce(regexp_matches({c}, '^[0-9a-f]{{64}}$'), false)"
_SHA, _P_SHA = "lower(trim(o.sha256))", "lower(trim(p.sha256))"

#: Every picture against every block of its page, with the rules spelled out one by one.
_DECISIONS = (
    _LATEST
    + _LINES
    + f""", kd AS (SELECT source_block_id, list(DISTINCT k0) AS kinds FROM cls GROUP BY 1),
lk AS (SELECT source_entry_id, entry_order, unnest(block_ids) AS b, generate_subscripts(block_ids, 1) AS i FROM ent),
ow AS (SELECT b, bool_or(i = 1) AS st, list(source_entry_id ORDER BY entry_order NULLS FIRST, source_entry_id, i) AS ids, list(entry_order ORDER BY entry_order NULLS FIRST, source_entry_id, i) AS ords FROM lk GROUP BY 1),
lay AS (SELECT blk.page_id, document_version_id, page_number, confidence, blk.source_block_id AS id, bbox.x1 AS x1, bbox.y1 AS y1, bbox.x2 AS x2, bbox.y2 AS y2, kinds, coalesce(st, false) AS st, coalesce(ids, []) AS ids, coalesce(ords, []) AS ords
  FROM blk JOIN kd ON kd.source_block_id = blk.source_block_id LEFT JOIN ow ON ow.b = blk.source_block_id WHERE bbox IS NOT NULL),
rl AS (SELECT page_id, list(DISTINCT y1 - 0.01) AS seps FROM lay WHERE st AND confidence >= {_RULED} GROUP BY 1),
gp AS (SELECT *, lead(y1) OVER (PARTITION BY page_id ORDER BY y1, id) AS nx FROM lay),
md AS (SELECT 'gap:' || id AS media_id, page_id, 0.4::DOUBLE AS mx1, y2 AS my1, 0.6::DOUBLE AS mx2, nx AS my2 FROM gp WHERE nx > y2
  UNION ALL SELECT 'top:' || page_id, page_id, 0.4, 0, 0.6, min(y1) FROM lay GROUP BY page_id UNION ALL SELECT 'page:' || page_id, page_id, 0, 0, 1, 1 FROM lay GROUP BY page_id),
hl AS (SELECT page_id, unnest(ids) AS e, unnest(ords) AS r FROM lay),
ls AS (SELECT page_id, max((r, e)) FILTER (r IS NOT NULL) AS top FROM hl GROUP BY 1),
nb AS (SELECT page_id, max((document_version_id, page_number)) AS dp FROM blk WHERE bbox IS NOT NULL GROUP BY 1),
nb2 AS (SELECT nb.page_id, dp[1] AS d, dp[2] AS n, top FROM nb LEFT JOIN ls ON ls.page_id = nb.page_id),
pv AS (SELECT a.page_id, max(b.top) AS top FROM nb2 a JOIN nb2 b ON a.d = b.d AND b.n = a.n - 1 WHERE b.top IS NOT NULL GROUP BY 1),
rb AS (SELECT * FROM lay WHERE len(list_filter(kinds, lambda k: k NOT IN ('PAGE_NUMBER', 'DECORATION', 'EMPTY'))) > 0),
ab AS (SELECT media_id, r.id, r.y2, r.ids, r.ords, row_number() OVER (PARTITION BY media_id ORDER BY r.y2 DESC, r.id DESC) AS n FROM md JOIN rb r ON r.page_id = md.page_id WHERE (r.y1 + r.y2) / 2 < my1 AND len(r.ids) > 0),
be AS (SELECT media_id, r.id, r.y1, r.ids, r.ords, r.st, row_number() OVER (PARTITION BY media_id ORDER BY r.y1, r.id) AS n FROM md JOIN rb r ON r.page_id = md.page_id WHERE (r.y1 + r.y2) / 2 > my2),
ct AS (SELECT media_id, count(*) FILTER ((r.y1 + r.y2) / 2 >= my1 AND (r.y1 + r.y2) / 2 <= my2 AND r.x1 < mx2 AND r.x2 > mx1) AS n_over, count(*) FILTER ((r.y1 + r.y2) / 2 < my1 AND list_contains(r.kinds, 'WORD_LIST_HEADER')) AS n_head FROM md JOIN rb r ON r.page_id = md.page_id GROUP BY 1),
co AS (SELECT DISTINCT l.page_id FROM rb l JOIN rb r ON l.page_id = r.page_id AND l.x2 <= r.x1 AND l.y2 > l.y1 AND r.y2 > r.y1 AND len(l.ids) > 0 AND len(r.ids) > 0 WHERE least(l.y2, r.y2) - greatest(l.y1, r.y1) > 0.5 * least(l.y2 - l.y1, r.y2 - r.y1)),
j AS (SELECT md.*, coalesce(rl.seps, []) AS seps, pv.top[2] AS pe, pv.top[1] AS po, ab.id IS NOT NULL AS ha, ab.y2 AS ay2, ab.ids[-1] AS ae, ab.ords[-1] AS ao, be.id IS NOT NULL AS hb, be.y1 AS by1, be.ids[1] AS b1, be.ords[1] AS bo, coalesce(be.st, false) AS bs,
  coalesce(n_over, 0) AS n_over, coalesce(n_head, 0) AS n_head, co.page_id IS NOT NULL AS cols
  FROM md LEFT JOIN rl ON rl.page_id = md.page_id LEFT JOIN pv ON pv.page_id = md.page_id LEFT JOIN ab ON ab.media_id = md.media_id AND ab.n = 1 LEFT JOIN be ON be.media_id = md.media_id AND be.n = 1 LEFT JOIN ct ON ct.media_id = md.media_id LEFT JOIN co ON co.page_id = md.page_id),
k AS (SELECT *, hb AND b1 IS NOT NULL AND NOT bs AS cont FROM j),
q AS (SELECT *, NOT ha AND NOT cont AS top, CASE WHEN ha THEN ae WHEN cont THEN b1 ELSE pe END AS ow, CASE WHEN ha THEN ao WHEN cont THEN bo ELSE po END AS oo,
  len(list_filter(seps, lambda r: r >= coalesce(ay2, 9) - 0.002 AND r <= my1 + 0.002)) > 0 AS r_up, len(list_filter(seps, lambda r: r >= 0 - 0.002 AND r <= my1 + 0.002)) > 0 AS r_top, len(list_filter(seps, lambda r: r >= my2 - 0.002 AND r <= coalesce(by1, -9) + 0.002)) > 0 AS r_dn FROM k),
v AS (SELECT *, hb AND b1 IS NOT NULL AND NOT bs AND ow IS DISTINCT FROM b1 AS oth FROM q),
w AS (SELECT *, list_filter([CASE WHEN n_over > 0 THEN 'text_overlaps_media' END, CASE WHEN len(seps) = 0 THEN 'no_separator_rules_on_page' END, CASE WHEN cols THEN 'multi_column_layout' END, CASE WHEN ha AND r_up THEN 'separator_between_entry_text_and_media' END,
  CASE WHEN top AND r_top THEN 'separator_above_media_at_page_top' END, CASE WHEN top AND ow IS NULL THEN 'no_preceding_entry' END, CASE WHEN hb AND bs AND NOT r_dn THEN 'no_separator_before_next_entry' END,
  CASE WHEN hb AND bs AND ow IS NOT NULL AND b1 IS NOT NULL AND coalesce(bo, 0) - coalesce(oo, 0) <> 1 THEN 'owner_is_not_the_entry_preceding_next_headword' END, CASE WHEN oth THEN 'media_between_different_entries' END,
  CASE WHEN cont AND r_dn THEN 'separator_inside_entry' END, CASE WHEN hb AND NOT bs AND b1 IS NULL THEN 'non_entry_text_below_media' END], lambda x: x IS NOT NULL) AS ws,
  list_filter([ow, CASE WHEN (hb AND bs AND b1 IS DISTINCT FROM ow) OR (oth AND b1 IS DISTINCT FROM ow) THEN b1 END], lambda x: x IS NOT NULL) AS cand, (mx2 - mx1) * (my2 - my1) >= 0.85 AS full_page, NOT ha AND n_head > 0 AS hdr FROM v)
SELECT media_id, CASE WHEN full_page OR hdr THEN 'NON_VOCABULARY' WHEN len(ws) = 0 AND ow IS NOT NULL THEN 'ENTRY_ILLUSTRATION' ELSE 'UNRESOLVED' END AS role, CASE WHEN NOT full_page AND NOT hdr AND len(ws) = 0 THEN ow END AS entry_id,
 CAST(CASE WHEN full_page THEN 1.0 WHEN hdr THEN 0.99 WHEN len(ws) = 0 AND ow IS NOT NULL THEN 0.98 WHEN ow IS NOT NULL THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN full_page OR hdr OR (len(ws) = 0 AND ow IS NOT NULL) THEN 'AUTO_VERIFIED' ELSE 'REVIEW_REQUIRED' END AS status,
 CASE WHEN full_page THEN 'FULL_PAGE_IMAGE' WHEN hdr THEN 'WORD_LIST_HEADER_RESOURCE' WHEN len(ws) = 0 AND ow IS NOT NULL THEN 'ENTRY_BAND' WHEN ow IS NOT NULL THEN 'LAYOUT_SIGNALS_DISAGREE' ELSE 'NO_ENTRY_CONTEXT' END AS reason,
 CASE WHEN full_page OR hdr THEN '' ELSE array_to_string(ws, ',') END AS warnings, CASE WHEN full_page OR hdr THEN '' ELSE array_to_string(cand, ',') END AS candidates FROM w"""
)
_BOX_WORDS = """, b AS (SELECT page_id, coalesce(reading_order, 0) AS ro, confidence, bbox, unnest(string_split(coalesce(raw_text, ''), ' ')) AS t, generate_subscripts(string_split(coalesce(raw_text, ''), ' '), 1) - 1 AS i FROM blk WHERE bbox IS NOT NULL),
w AS (SELECT page_id, ro, i, trim(t, ' ') AS t, CAST(round(bbox.x1 * 1000) AS INT) + 10 * i AS l, CAST(round(bbox.y1 * 1000) AS INT) AS y, coalesce(round(confidence * 100), -1) AS c FROM b),
s AS (SELECT page_id, max(l + 9) AS pw, max(y + 12) AS ph FROM w GROUP BY 1)
SELECT w.page_id, CAST(ro AS INT) AS block_num, 0 AS line_num, string_agg(t, ' ' ORDER BY i, t) AS text, round(least(1, greatest(0, min(l) / any_value(pw))), 6) AS x1, round(least(1, greatest(0, min(y) / any_value(ph))), 6) AS y1,
 round(least(1, greatest(0, max(l + 9) / any_value(pw))), 6) AS x2, round(least(1, greatest(0, max(y + 12) / any_value(ph))), 6) AS y2, round(avg(c) / 100, 6) AS confidence FROM w JOIN s ON s.page_id = w.page_id WHERE c >= 0 AND t <> '' GROUP BY w.page_id, ro"""
_DISPATCH = r"""regexp_matches({s}, '^[A-Za-z][A-Za-z''’-]{{1,63}}( /[^/]+/)?( (?:n|v|vt|vi|adj|adv|prep|conj|pron|det|excl)\.(?:/(?:n|v|vt|vi|adj|adv|prep|conj|pron|det|excl)\.)*)?( .+)?$')"""
_HEAD = r"^[A-Za-z][A-Za-z''’-]*\*? \[[^\]]+\]"
_SENSE = r"^(n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\."
_BARE = r"^[A-Za-z][A-Za-z''’-]*\*?$"
_RECORDS = (
    _LATEST
    + _ENTRY_LINES
    + _MEDIA
    + f""", m AS (SELECT vocabulary_entry_id, list({{'media_order': media_order, 'media_role': media_role, 'sha256': sha256}} ORDER BY media_order NULLS FIRST, media_role NULLS FIRST, sha256 NULLS FIRST) AS media
  FROM voc JOIN o ON lower({_squeeze('voc.lemma')}) = lower({_squeeze('o.lemma')}) GROUP BY 1),"""
    + """
sn AS (SELECT source_entry_id, list({'definitions': CASE WHEN definition IS NULL THEN [] ELSE [definition] END, 'part_of_speech': part_of_speech} ORDER BY n) AS senses FROM sen GROUP BY 1),
ft AS (SELECT source_entry_id, CASE mark WHEN '记' THEN 'MEMORY_NOTE' WHEN '搭' THEN 'COLLOCATION' WHEN '例' THEN 'EXAMPLE' WHEN '派' THEN 'DERIVATIVE' WHEN '同' THEN 'SYNONYM' ELSE 'ANTONYM' END AS ty, list(text ORDER BY n) AS ts FROM fld GROUP BY 1, 2),
fm AS (SELECT source_entry_id, '{' || string_agg('"' || ty || '":' || to_json(ts), ',' ORDER BY ty) || '}' AS fields FROM ft GROUP BY 1),
rec AS (SELECT processing_run_id AS run, vocabulary_entry_id AS id, len(coalesce(media, [])) AS n_media, '{"id":' || to_json(vocabulary_entry_id) || ',"language":' || coalesce(CAST(to_json(language) AS VARCHAR), 'null') || ',"lemma":' || coalesce(CAST(to_json(voc.lemma) AS VARCHAR), 'null')
  || ',"pronunciations":' || CASE WHEN ipa IS NULL THEN '[]' ELSE '[{"dialect":null,"ipa":' || to_json(ipa) || '}]' END
  || ',"senses":' || CASE WHEN senses IS NOT NULL THEN CAST(to_json(senses) AS VARCHAR) WHEN definition IS NULL AND part_of_speech IS NULL THEN '[]' ELSE '[{"definitions":' || CASE WHEN definition IS NULL THEN '[]' ELSE '[' || to_json(definition) || ']' END || ',"part_of_speech":' || coalesce(CAST(to_json(part_of_speech) AS VARCHAR), 'null') || '}]' END
  || ',"source_entry_id":' || coalesce(CAST(to_json(voc.source_entry_id) AS VARCHAR), 'null') || ',"source_fields":' || coalesce(fields, '{}') || ',"source_media":' || coalesce(CAST(to_json(media) AS VARCHAR), '[]') || ',"source_pages":' || coalesce(CAST(to_json(source_pages) AS VARCHAR), '[]')
  || ',"verification_status":' || coalesce(CAST(to_json(machine_verification_status) AS VARCHAR), 'null') || '}' AS record
  FROM (SELECT vocabulary_entry_id, processing_run_id, source_entry_id, lemma, ipa, part_of_speech, definition, language, machine_verification_status FROM voc) voc LEFT JOIN (SELECT source_entry_id, source_pages FROM ent) e ON e.source_entry_id = voc.source_entry_id
  LEFT JOIN m USING (vocabulary_entry_id) LEFT JOIN sn ON sn.source_entry_id = voc.source_entry_id LEFT JOIN fm ON fm.source_entry_id = voc.source_entry_id)
"""
)

SQL = {
    "media_decisions": _DECISIONS,
    "recognised_lines": _LATEST + _BOX_WORDS,
    "native_page_blocks": _LATEST + """, b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY reading_order NULLS FIRST, source_block_id) - 1 AS n FROM blk WHERE bbox IS NOT NULL)
 SELECT page_id, CAST(n AS INT) AS reading_order, sha256(raw_text) AS text_digest, round(least(1, greatest(0, bbox.x1 * 600 / 500)), 6) AS x1, round(least(1, greatest(0, bbox.y1 * 800 / 800)), 6) AS y1, round(least(1, greatest(0, bbox.x2 * 700 / 500)), 6) AS x2,
 round(least(1, greatest(0, bbox.y2 * 800 / 800)), 6) AS y2, 1.0::DOUBLE AS confidence FROM b WHERE trim(coalesce(raw_text, ''), ' ') <> ''""",
    "polygon_boxes": _LATEST + "SELECT source_block_id, round(least(1, bbox.x1 * 1000 / 900), 6) AS x1, round(least(1, bbox.y1 * 1400 / 1400), 6) AS y1, round(least(1, bbox.x2 * 1000 / 900), 6) AS x2, round(least(1, bbox.y2 * 1400 / 1400), 6) AS y2 FROM blk WHERE bbox IS NOT NULL",
    "bold_block_lines": _LATEST + _LINES + """, pb AS (SELECT DISTINCT page_id, unnest(bold_lines) AS l FROM blk) SELECT source_block_id, string_agg(s, '|' ORDER BY i) AS bold FROM ln WHERE EXISTS (SELECT 1 FROM pb WHERE pb.page_id = ln.page_id AND pb.l = ln.s) GROUP BY 1""",
    "structured_entries": _LATEST + _ENTRY_LINES + f""", h0 AS (SELECT source_entry_id, max(i) AS n, max(h) AS h, string_agg(s, ' ' ORDER BY i) AS whole FROM el2 GROUP BY 1),
 c AS (SELECT ent.source_entry_id, n, h, {_squeeze("coalesce(ent.raw_text, '')")} AS s, (contains(h, '[') AND contains(h, ']')) OR (n > 1 AND regexp_matches(h, '{_BARE}')) AS book, regexp_matches(h, '{_HEAD}') OR regexp_matches(h, '{_BARE}') AS headed FROM ent LEFT JOIN h0 ON h0.source_entry_id = ent.source_entry_id),
 d AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN book AND headed THEN 'book' WHEN book THEN NULL WHEN {_DISPATCH.format(s='s')} THEN 'line' END AS parser FROM c)
 SELECT d.source_entry_id, parser, CASE WHEN parser IS NOT NULL THEN NULL WHEN n IS NULL THEN 'EMPTY_TEXT' WHEN book THEN 'NO_HEADWORD' ELSE 'NO_KNOWN_FORMAT' END AS failure, CASE WHEN parser IS NOT NULL THEN regexp_extract(CASE parser WHEN 'book' THEN h ELSE s END, '^([A-Za-z][A-Za-z''’-]*)', 1) END AS lemma,
 CAST(CASE parser WHEN 'book' THEN CASE WHEN regexp_matches(h, '{_HEAD}') THEN 1 ELSE 0 END + (SELECT count(*) FROM un2 WHERE isipa AND un2.source_entry_id = d.source_entry_id) WHEN 'line' THEN CASE WHEN regexp_extract(s, {_ONE_LINE}, 2) <> '' THEN 1 ELSE 0 END ELSE 0 END AS INT) AS n_ipas,
 CAST(CASE parser WHEN 'book' THEN (SELECT count(*) FROM sen WHERE sen.source_entry_id = d.source_entry_id) WHEN 'line' THEN CASE WHEN regexp_extract(s, {_ONE_LINE}, 3) <> '' OR regexp_extract(s, {_ONE_LINE}, 4) <> '' THEN 1 ELSE 0 END ELSE 0 END AS INT) AS n_senses,
 CAST(CASE parser WHEN 'book' THEN (SELECT count(*) FROM fld WHERE fld.source_entry_id = d.source_entry_id) ELSE 0 END AS INT) AS n_fields FROM d""",
    "structured_lines": f"""WITH l AS (SELECT unnest(string_split_regex(text, {_SPLIT})) AS raw FROM documents), s AS (SELECT {_strip('raw')} AS line, {_squeeze('raw')} AS s FROM l WHERE {_strip('raw')} <> ''),
 d AS (SELECT *, contains(line, '[') AND contains(line, ']') AS book, regexp_matches(s, '{_HEAD}') AS headed, {_DISPATCH.format(s='s')} AS one, trim(regexp_replace(s, '{_HEAD}', '')) AS body FROM s),
 e AS (SELECT *, regexp_extract(body, '^\\[[^\\]]+\\]\\s*(.*)$', 1) AS rest FROM d),
 f AS (SELECT *, CASE WHEN regexp_matches(body, '^\\[[^\\]]+\\]') AND (rest = '' OR regexp_matches(rest, '{_SENSE}')) THEN rest ELSE body END AS r FROM e),
 g AS (SELECT CASE WHEN book AND headed THEN 'book' WHEN NOT book AND one THEN 'line' ELSE 'none' END AS parser, CASE WHEN book AND NOT headed THEN 'NO_HEADWORD' WHEN NOT book AND NOT one THEN 'NO_KNOWN_FORMAT' ELSE '' END AS failure,
 CASE WHEN book THEN headed WHEN one THEN regexp_extract(s, {_ONE_LINE}, 2) <> '' ELSE false END AS ipa, CASE WHEN book THEN headed AND regexp_matches(r, '{_SENSE}') WHEN one THEN regexp_extract(s, {_ONE_LINE}, 3) <> '' OR regexp_extract(s, {_ONE_LINE}, 4) <> '' ELSE false END AS sense FROM f)
 SELECT parser, failure, count(*) AS n, count(*) FILTER (ipa) AS n_with_ipa, count(*) FILTER (sense) AS n_with_sense FROM g GROUP BY 1, 2""",
    "pronunciations": _LATEST + _ENTRY_LINES + """, a AS (SELECT source_entry_id, 0 AS i, regexp_extract(h, '\\[([^\\]]+)\\]', 1) AS ipa FROM el WHERE i = 1 AND regexp_matches(h, '^[A-Za-z][A-Za-z''’-]*\\*? \\[[^\\]]+\\]') UNION ALL SELECT source_entry_id, i, regexp_extract(t, '^\\[([^\\]]+)\\]', 1) FROM un2 WHERE isipa)
 SELECT source_entry_id, CAST(row_number() OVER (PARTITION BY source_entry_id ORDER BY i) AS INT) AS pronunciation_order, ipa FROM a""",
    "gold_dataset_digests": _RECORDS + "SELECT id, sha256(record) AS digest, CAST(strlen(record) AS INT) AS n_bytes FROM rec",
    "gold_datasets": _RECORDS + "SELECT run, count(*) AS record_count, CAST(sum(n_media) AS BIGINT) AS source_media_count, CAST(sum(strlen(record)) AS BIGINT) AS n_bytes FROM rec GROUP BY 1",
    "missing_lemma_provenance": _LATEST + _ENTRY_LINES + """, f AS (SELECT DISTINCT el.source_entry_id FROM el JOIN ent ON ent.source_entry_id = el.source_entry_id WHERE ent.block_ids[1] IN (SELECT source_block_id FROM blk WHERE page_id IS NOT NULL))
 SELECT vocabulary_entry_id, 'MISSING_LEMMA_PROVENANCE' AS issue FROM voc WHERE source_entry_id IS NULL OR source_entry_id NOT IN (SELECT source_entry_id FROM f)""",
    "render_mismatches": "WITH x AS (SELECT 1)" + _MEDIA + """, a AS (SELECT document_sha256, page_number, max(page_image_sha256) AS e FROM o GROUP BY 1, 2), b AS (SELECT document_sha256, page_number, max(page_image_sha256) AS f FROM p GROUP BY 1, 2)
 SELECT a.document_sha256, a.page_number, CASE WHEN b.document_sha256 IS NULL THEN 'missing' ELSE 'differs' END AS reason FROM a LEFT JOIN b ON a.document_sha256 = b.document_sha256 AND a.page_number = b.page_number WHERE b.document_sha256 IS NULL OR e IS DISTINCT FROM f""",
    "page_identity": "WITH x AS (SELECT 1)" + _MEDIA + """, a AS (SELECT document_sha256, page_number, count(DISTINCT sample_id) AS l FROM o GROUP BY 1, 2), b AS (SELECT document_sha256, page_number, count(DISTINCT sample_id) AS r FROM p GROUP BY 1, 2)
 SELECT coalesce(a.document_sha256, b.document_sha256) AS document_sha256, coalesce(a.page_number, b.page_number) AS page_number, CASE WHEN r IS NULL THEN 'overlay_only' WHEN l IS NULL THEN 'prediction_only' ELSE 'not_unique' END AS problem
 FROM a FULL JOIN b ON a.document_sha256 = b.document_sha256 AND a.page_number = b.page_number WHERE r IS NULL OR l IS NULL OR r > 1 OR l > 1""",
    "overlay_coverage": "WITH x AS (SELECT 1)" + _MEDIA + """, g AS (SELECT sample_id, document_sha256 AS d, page_number AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY received_at DESC) AS rn FROM gold_pages) WHERE rn = 1),
 a AS (SELECT sample_id, max({'d': document_sha256, 'n': page_number}) AS k FROM o GROUP BY 1), b AS (SELECT DISTINCT sample_id FROM p)
 SELECT g.sample_id, CASE WHEN a.sample_id IS NULL THEN 'media_annotation_missing' WHEN k.d IS DISTINCT FROM g.d OR k.n IS DISTINCT FROM g.n THEN 'differs_from_text' WHEN b.sample_id IS NULL THEN 'prediction_missing' ELSE 'complete' END AS state FROM g LEFT JOIN a ON a.sample_id = g.sample_id LEFT JOIN b ON b.sample_id = g.sample_id
 UNION ALL SELECT sample_id, 'not_a_text_page' FROM a WHERE sample_id NOT IN (SELECT sample_id FROM g)""",
    "uncovered_entries": _LATEST + """, v AS (SELECT DISTINCT page_number FROM blk WHERE confidence >= 0.99 AND page_number IS NOT NULL), x AS (SELECT DISTINCT source_entry_id, unnest(source_pages) AS n FROM ent)
 SELECT source_entry_id, string_agg(n, ',' ORDER BY n) AS pages FROM x WHERE n NOT IN (SELECT page_number FROM v) GROUP BY 1""",
    "media_counters": _LATEST + _MEDIA + f""", j AS (SELECT o.document_sha256 AS d, o.page_number AS n, o.media_role AS r, coalesce(trim(o.lemma), '') <> '' AS bd, p.source_media_id IS NOT NULL AS det, {_IS_DIGEST.format(c=_SHA)} AS dg, {_IS_DIGEST.format(c=_P_SHA)} AS pd, {_SHA} AS a, {_P_SHA} AS b,
 o.lemma IN (SELECT lemma FROM ent WHERE lemma IS NOT NULL) AS he, o.lemma IN (SELECT lemma FROM voc WHERE lemma IS NOT NULL) AS hv, o.human_decision IS NOT NULL AS ver, o.review_status AS st FROM o LEFT JOIN p ON p.source_media_id = o.source_media_id)
 SELECT d AS document_sha256, count(DISTINCT n) AS total_pages, count(DISTINCT CASE WHEN det THEN n END) AS pages_scanned, count(DISTINCT CASE WHEN bd THEN n END) AS pages_with_media, count(*) FILTER (det) AS media_detected, count(*) FILTER (dg) AS media_extracted, count(*) AS media_persisted,
 count(*) FILTER (r = 'ENTRY_ILLUSTRATION' AND he) AS associated_with_source_entry, count(*) FILTER (r = 'ENTRY_ILLUSTRATION' AND hv) AS associated_with_vocabulary_entry, count(*) FILTER (r = 'NON_VOCABULARY') AS excluded_non_vocabulary, count(*) FILTER (NOT ver) AS auto_verified, count(*) FILTER (ver) AS human_verified,
 count(*) FILTER (r = 'ENTRY_ILLUSTRATION' AND NOT bd) AS unbound_media, count(*) FILTER (r IS NULL OR r = 'UNRESOLVED') AS unresolved_media, count(*) FILTER (NOT det) AS missing_media, count(*) FILTER (det AND NOT pd) AS missing_artifact, count(*) FILTER (NOT dg) AS missing_sha256,
 count(*) FILTER (dg AND pd AND a <> b) AS broken_artifact, count(*) FILTER (r = 'ENTRY_ILLUSTRATION' AND bd AND NOT coalesce(he, false)) AS broken_provenance, count(*) FILTER (st <> 'HUMAN_VERIFIED') AS open_media_reviews FROM j GROUP BY 1""",
    "new_source_fields": _LATEST + _ENTRY_LINES + """, n AS (SELECT source_entry_id FROM ent WHERE len(source_pages) = 1) SELECT source_entry_id, CASE mark WHEN '记' THEN 'MEMORY_NOTE' WHEN '搭' THEN 'COLLOCATION' WHEN '例' THEN 'EXAMPLE' WHEN '派' THEN 'DERIVATIVE' WHEN '同' THEN 'SYNONYM' ELSE 'ANTONYM' END AS field_type,
 CAST(n AS INT) AS field_order FROM fld WHERE source_entry_id NOT IN (SELECT source_entry_id FROM n)""",
    "next_versions": _LATEST + "SELECT b.processing_run_id, CAST(coalesce((SELECT count(DISTINCT CAST(created_at AS DATE)) FROM voc WHERE voc.processing_run_id = b.processing_run_id), 0) + 1 AS INT) AS version FROM (SELECT DISTINCT processing_run_id FROM blk) b",
    "redacted_queue": _LATEST + f"""SELECT 'block' AS kind, source_block_id AS row_id, 1 AS n_pages, 'low_confidence' AS reason, CAST(least(240, length(coalesce(raw_text, ''))) AS INT) AS n_hidden FROM blk WHERE source_engine <> 'pymupdf-native' AND coalesce(confidence, 0) < 0.85
 UNION ALL SELECT 'entry', source_entry_id, CAST(len(source_pages) AS INT), 'cross_page', CAST(least(240, length(raw_text)) AS INT) FROM ent WHERE len(source_pages) > 1
 UNION ALL SELECT 'entry', source_entry_id, CAST(coalesce(len(source_pages), -1) AS INT), 'no_headword', CAST(least(240, length(coalesce(raw_text, ''))) AS INT) FROM ent WHERE NOT coalesce(regexp_matches({_squeeze('raw_text')}, '{_HEAD}') OR regexp_matches(trim(regexp_extract(raw_text, '^[\\s\\p{{Z}}]*([^\\n\\r]*)', 1)), '{_BARE}'), false)""",
    "public_media": "WITH x AS (SELECT 1)" + _MEDIA + f""" SELECT source_media_id, page_number, media_order, nullif({_strip('lemma')}, '') AS lemma, nullif({_strip('media_role')}, '') AS media_role, CASE WHEN {_IS_DIGEST.format(c='lower(trim(sha256))')} THEN lower(trim(sha256))[1:2] || '/' || lower(trim(sha256)) END AS object_key, width, height FROM o""",
    "reviews_with_status": _LATEST + f"SELECT resolution_id, decision, nullif({_strip('notes')}, '') AS notes FROM res WHERE upper(decision) = 'ACCEPT'",
    "layout_tags": _LATEST + _MEDIA + """, im AS (SELECT page_number, count(*) AS ni FROM o GROUP BY 1), b AS (SELECT *, coalesce(raw_text, '') AS t FROM blk),
 g AS (SELECT page_id, max(b.page_number) AS page_number, sum(length(t)) AS nc, count(*) AS nb, sum(length(t) - length(regexp_replace(t, '[ˈˌːəɪʊɔɜʌæɑʃʒθðŋɡɒ]', '', 'g'))) AS na, sum(len(regexp_extract_all(t, '词根|词缀|含义|Word List'))) AS ns, bool_or(contains(t, '索引') OR contains(t, 'Index')) AS ix, bool_or(contains(t, 'Word List')) AS wl,
 count(*) FILTER (bbox.x2 < 0.5) AS nl, count(*) FILTER (bbox.x1 > 0.45) AS nr FROM b GROUP BY 1), h AS (SELECT g.*, coalesce(ni, 0) AS ni FROM g LEFT JOIN im ON im.page_number = g.page_number)
 SELECT page_id, concat_ws(',', CASE WHEN nl >= 2 AND nr >= 2 THEN 'DOUBLE_COLUMN' END, CASE WHEN ni > 0 THEN 'IMAGE' END, CASE WHEN ix THEN 'INDEX' END, CASE WHEN na >= 20 THEN 'IPA_DENSE' END, CASE WHEN nc >= 500 AND nb >= 5 THEN 'NORMAL' END, CASE WHEN nc <= 50 AND ni > 0 THEN 'OCR_HARD' END,
 CASE WHEN wl OR ns >= 3 THEN 'SPECIAL_LAYOUT' END, CASE WHEN ns >= 2 THEN 'TABLE' END) AS tags FROM h""",
}


def _score(item: str) -> str:
    norm = f"lower(trim(regexp_replace(coalesce(CAST({item} AS VARCHAR), ''), '[\\s\\p{{Z}}]+', ' ', 'g')))"
    return f"""(SELECT min(f) AS f, bool_and(t = a AND t = b) AS e FROM (SELECT *, CASE WHEN t = 0 AND a > 0 AND b > 0 THEN 0 WHEN a = 0 OR b = 0 THEN CASE WHEN a = b THEN 1 ELSE 0 END ELSE round(2 * (t / a) * (t / b) / (t / a + t / b), 6) END AS f FROM (
 SELECT s.sample_id, (SELECT count(*) FROM p WHERE p.sample_id = s.sample_id) AS a, (SELECT count(*) FROM o WHERE o.sample_id = s.sample_id) AS b, coalesce(c.t, 0) AS t FROM (SELECT sample_id FROM o UNION SELECT sample_id FROM p) s
 LEFT JOIN (SELECT sample_id, count(*) AS t FROM (SELECT sample_id, {norm} FROM p INTERSECT ALL SELECT sample_id, {norm} FROM o) GROUP BY 1) c ON c.sample_id = s.sample_id)))"""


SQL["combined_benchmark"] = "WITH x AS (SELECT 1)" + _MEDIA + f""" SELECT a.f AS order_f1, a.e AS order_exact, b.f AS bytes_f1, b.e AS bytes_exact, c.f AS lemma_f1, c.e AS lemma_exact, CASE WHEN a.e AND b.e AND c.e THEN 'PASS' ELSE 'FAIL' END AS status
 FROM {_score('media_order')} a, {_score('sha256')} b, {_score('lemma')} c"""
