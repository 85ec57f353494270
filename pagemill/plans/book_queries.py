"""Queries of the book pipeline: lines, entries, canonical fields, provenance, review routing, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import grammar as G
from pagemill.functions import text as X
from pagemill.operators import parse, segment, store
from pagemill.session import latest, read

IPA_LETTERS = "ˈˌːəɪʊɔɜʌæɑʃʒθðŋɡɒ"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "source_blocks"), "source_block_id", "received_at")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "source_entries"), "source_entry_id", "received_at")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "vocabulary_entries"), "vocabulary_entry_id", "received_at")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "review_resolutions"), "resolution_id", "received_at")


def text_layer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts per document version, those with a text layer, and the mode that follows from the ratio."""
    d = read(spark, sf_dir, "documents").select("document_version_id", (F.length(X.stripped(F.coalesce("text", F.lit("")))) >= 20).alias("layer"))
    g = d.groupBy("document_version_id").agg(F.count("*").alias("n_texts"), F.count_if("layer").alias("n_with_layer"))
    mode = F.when(F.col("n_with_layer") == F.col("n_texts"), "NATIVE_TEXT").when(F.col("n_with_layer") == 0, "SCANNED").otherwise("HYBRID")
    return g.withColumn("coverage", F.round(F.try_divide("n_with_layer", "n_texts"), 6)).withColumn("mode", mode)


def squeezed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct comparable forms of the block texts with their counts and hashes."""
    t = X.comparable(F.col("raw_text"))
    return blocks(spark, sf_dir).groupBy(t.alias("t")).agg(F.count("*").alias("n")).select(F.sha2("t", 256).alias("digest"), F.length("t").alias("n_chars"), "n")


def line_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per class and source engine."""
    source = blocks(spark, sf_dir).select("source_engine", F.explode(X.lines(F.coalesce("raw_text", F.lit("")))).alias("line"))
    kind = G.line_class(F.col("line"))
    return source.groupBy("source_engine", kind.alias("line_class")).agg(F.count("*").alias("n_lines"), F.round(F.avg(G.confidence_of(kind)), 6).alias("confidence"))


def _entries_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.entries(segment.segment_lines(segment.ordered_lines(blocks(spark, sf_dir))))


def segmented_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every run from its blocks."""
    found = _entries_found(spark, sf_dir)
    return found.select("run", "entry_order", "lemma", "starred", F.sha2("raw_text", 256).alias("text_digest"), "confidence", "word_list", F.size("block_ids").alias("n_blocks"), F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"), "cross_page")


def entry_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and their blocks in order."""
    return segment.entry_links(_entries_found(spark, sf_dir))


def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: entries, links, entries over several pages, starred ones, mean confidence."""
    e = _entries_found(spark, sf_dir)
    return e.groupBy("run").agg(
        F.count("*").alias("n_entries"), F.sum(F.size("block_ids")).cast("bigint").alias("n_links"), F.count_if("cross_page").alias("n_cross_page"), F.count_if("starred").alias("n_starred"), F.round(F.avg("confidence"), 6).alias("confidence"))


def parsed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma, star, first transcription and numbers of parts of each entry's text."""
    p = entries(spark, sf_dir).select("source_entry_id", parse.parsed(F.col("raw_text")).alias("p")).where("p IS NOT NULL")
    return p.select("source_entry_id", "p.lemma", "p.starred", "p.ipa", F.size("p.ipas").alias("n_ipas"), F.size("p.senses").alias("n_senses"), F.size("p.fields").alias("n_fields"))


def entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked fields of each entry."""
    return parse.fields_table(entries(spark, sf_dir), "source_entry_id", "raw_text")


def entry_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The senses of each entry."""
    return parse.senses_table(entries(spark, sf_dir), "source_entry_id", "raw_text")


def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fields per entry and path kind, with the first block as their source."""
    p = parse.provenance(entries(spark, sf_dir), "source_entry_id", "block_ids", "raw_text")
    return p.groupBy(F.substring_index("field_path", ".", 1).alias("path")).agg(F.count("*").alias("n_fields"), F.count("source_block_id").alias("n_with_block"), F.count_distinct("source_entry_id").alias("n_entries"))


def one_line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines that are an entry written on one line."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    p = d.select("doc_id", (F.col("pos") + 1).alias("line_no"), parse.parsed_line(F.col("line")).alias("p")).where("p IS NOT NULL")
    return p.select("doc_id", "line_no", "p.lemma", "p.pos", "p.definition")


def effective_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry texts after review: the last decision of each entry discards it, corrects it or leaves it."""
    last = latest(resolutions(spark, sf_dir).where("source_entry_id IS NOT NULL"), "source_entry_id", "resolved_at", "decision", "corrected_text")
    e = entries(spark, sf_dir).select("source_entry_id", "raw_text").join(last.drop("resolved_at"), "source_entry_id", "left")
    t = X.effective_text(F.col("raw_text"), F.col("decision"), F.col("corrected_text"))
    return e.select("source_entry_id", "decision", F.sha2(t, 256).alias("text_digest"), F.length(t).alias("n_chars"))


def low_confidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of recognised text with no or low confidence that no entry with an accepted or discarding review covers."""
    reviewed = resolutions(spark, sf_dir).where("decision IN ('ACCEPT', 'DISCARD') AND source_entry_id IS NOT NULL").select("source_entry_id").distinct()
    covered = entries(spark, sf_dir).join(reviewed, "source_entry_id", "left_semi").select(F.explode("block_ids").alias("source_block_id")).distinct()
    low = blocks(spark, sf_dir).where("source_engine <> 'pymupdf-native' AND (confidence IS NULL OR confidence < 0.85)")
    return low.join(covered, "source_block_id", "left_anti").select("source_block_id", "page_id", "confidence")


def review_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest decision of each review task."""
    r = latest(resolutions(spark, sf_dir), "review_task_id", "resolved_at", "resolution_id", "decision", "reviewer_id")
    return r.select("review_task_id", "resolution_id", "decision", "reviewer_id")


def review_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the entry they speak of and its first block's page, where there are any."""
    e = entries(spark, sf_dir).select("source_entry_id", F.col("lemma").alias("entry_lemma"), F.get("block_ids", F.lit(0)).alias("source_block_id"))
    b = blocks(spark, sf_dir).select("source_block_id", "page_number")
    return resolutions(spark, sf_dir).select("resolution_id", "decision", "source_entry_id").join(e, "source_entry_id", "left").join(b, "source_block_id", "left").select("resolution_id", "decision", "entry_lemma", "page_number")


def unlinked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead nowhere once the entries over several pages and the blocks without a confidence are withdrawn.

    Vocabulary without its entry, entries with a block that is not there, reviews likewise.
    """
    e, b = entries(spark, sf_dir).where("size(source_pages) = 1"), blocks(spark, sf_dir).where("confidence IS NOT NULL")
    ids = e.select("source_entry_id")
    v = vocabulary(spark, sf_dir).join(ids, "source_entry_id", "left_anti").select(F.lit("vocabulary").alias("kind"), F.col("vocabulary_entry_id").alias("row_id"))
    links = e.select("source_entry_id", F.explode("block_ids").alias("source_block_id"))
    n = links.join(b.select("source_block_id"), "source_block_id", "left_anti").select(F.lit("entry").alias("kind"), F.col("source_entry_id").alias("row_id")).distinct()
    r = resolutions(spark, sf_dir).where("source_entry_id IS NOT NULL").join(ids, "source_entry_id", "left_anti").select(F.lit("review").alias("kind"), F.col("resolution_id").alias("row_id"))
    return v.unionByName(n).unionByName(r)


def representation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: blocks, pages with text, blocks whose box is not valid, empty blocks."""
    return blocks(spark, sf_dir).groupBy("processing_run_id").agg(
        F.count("*").alias("n_blocks"), F.count_distinct("page_id").alias("n_pages"), F.count_distinct(F.when(X.has_text(F.col("raw_text")), F.col("page_id"))).alias("n_pages_with_text"),
        F.count_if(~X.valid_box(F.col("bbox"))).alias("n_bad_boxes"), F.count_if(~X.has_text(F.col("raw_text"))).alias("n_empty"), F.round(F.avg("confidence"), 4).alias("confidence"))


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of vocabulary rows: lemma, transcription and missing parts, one row each."""
    v = vocabulary(spark, sf_dir)
    issue = lambda name, test: F.when(test, F.lit(name))
    found = F.array_compact(F.array(
        issue("INVALID_LEMMA", ~F.coalesce(F.col("lemma").rlike("^[A-Za-z][A-Za-z'’-]{0,511}$"), F.lit(False))),
        issue("INVALID_IPA", F.col("ipa").rlike(r"[0-9<>={}\\]")), issue("MISSING_SENSE", ~X.has_text(F.col("part_of_speech"))), issue("MISSING_DEFINITION", ~X.has_text(F.col("definition"))),
    ))
    return v.select("vocabulary_entry_id", F.explode(found).alias("issue"))


def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous page ranges of each document version."""
    return segment.page_islands(blocks(spark, sf_dir), "document_version_id")


def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: text length, blocks, phonetic letters, blocks in the left and right half, layout tags that follow."""
    b = blocks(spark, sf_dir).withColumn("t", F.coalesce("raw_text", F.lit("")))
    marks = F.length("t") - F.length(F.translate("t", IPA_LETTERS, ""))
    p = b.groupBy("page_id").agg(
        F.sum(F.length("t")).alias("text_length"), F.count("*").alias("n_blocks"), F.sum(marks).alias("n_phonetic"),
        F.count_if(F.col("bbox.x2") < 0.5).alias("n_left"), F.count_if(F.col("bbox.x1") > 0.45).alias("n_right"), F.count_if(F.col("source_engine") != "pymupdf-native").alias("n_recognised"))
    tag = lambda name, test: F.when(test, F.lit(name))
    tags = F.array_sort(F.array_compact(F.array(
        tag("DOUBLE_COLUMN", (F.col("n_left") >= 2) & (F.col("n_right") >= 2)), tag("IPA_DENSE", F.col("n_phonetic") >= 100), tag("SPARSE", F.col("text_length") < 200),
        tag("SCANNED", F.col("n_recognised") > 0), tag("NORMAL", (F.col("text_length") >= 200) & (F.col("n_recognised") == 0)),
    )))
    return p.withColumn("tags", F.array_join(tags, ","))


def sample_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for a sample: the best of each tag, then the most diverse of the rest, 30 in all."""
    from pyspark.sql import Window

    p = page_profile(spark, sf_dir).withColumn("tag_list", F.split("tags", ","))
    by_tag = p.select("page_id", "n_phonetic", "n_blocks", F.explode("tag_list").alias("tag")).where("tag <> ''")
    first = by_tag.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n_phonetic"), F.desc("n_blocks"), "page_id"))).where("n = 1")
    best = first.select("page_id", F.lit(0).alias("phase")).distinct()
    rest = p.join(best, "page_id", "left_anti").select("page_id", F.lit(1).alias("phase"), F.size("tag_list").alias("d"), "n_phonetic")
    top = best.join(p.select("page_id", F.size("tag_list").alias("d"), "n_phonetic"), "page_id").select("page_id", "phase", "d", "n_phonetic")
    return top.unionByName(rest).orderBy("phase", F.desc("d"), F.desc("n_phonetic"), "page_id").limit(30).select("page_id", "phase")


def audit_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure blocks, entries over several pages and entries without a headword, with excerpts."""
    q = store.audit_queue(blocks(spark, sf_dir), entries(spark, sf_dir))
    return q.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


def page_review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, entries and review flags of each page's nested document."""
    p = store.page_documents(blocks(spark, sf_dir), entries(spark, sf_dir))
    return p.select("document_version_id", "page_number", F.size("blocks").alias("n_blocks"), F.size("entries").alias("n_entries"), F.array_join("flags", ",").alias("flags"))


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their line classes and the entries they hold."""
    p = store.page_layout(blocks(spark, sf_dir), entries(spark, sf_dir))
    return p.select("page_id", "block_id", F.array_join(F.array_sort("kinds"), ",").alias("kinds"), "starts_entry", F.size("entry_ids").alias("n_entries"), F.get("entry_ids", F.lit(0)).alias("first_entry"))


def pages_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose native text is missing or too short."""
    b = blocks(spark, sf_dir)
    return store.pages_to_recognise(b.select("page_id").distinct(), b.where("source_engine = 'pymupdf-native'"))


_LATEST = """
WITH blk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_block_id ORDER BY received_at DESC) AS rn FROM source_blocks) WHERE rn = 1),
ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_entry_id ORDER BY received_at DESC) AS rn FROM source_entries) WHERE rn = 1),
voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vocabulary_entry_id ORDER BY received_at DESC) AS rn FROM vocabulary_entries) WHERE rn = 1),
res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY received_at DESC) AS rn FROM review_resolutions) WHERE rn = 1)
"""
_W = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_W}+', ' ', 'g'))"


_ONE_LINE = r"'^([A-Za-z][A-Za-z''’-]{1,63})(?: /([^/]+)/)?(?: ((?:n|v|vt|vi|adj|adv|prep|conj|pron|det|excl)\.(?:/(?:n|v|vt|vi|adj|adv|prep|conj|pron|det|excl)\.)*))?(?: (.+))?$'"
_SPLIT = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'"
_CLASS = """CASE WHEN s = '' THEN 'EMPTY' WHEN regexp_matches(s, '^(?i)word list \\d+$') THEN 'WORD_LIST_HEADER' WHEN s = '词根/词缀预习表' THEN 'PREVIEW_TABLE_HEADER'
 WHEN regexp_matches(s, '^[一二三四五六七八九十]+ 雅思') OR upper(s) = 'INDEX' THEN 'NON_ENTRY_SECTION_HEADER' WHEN regexp_matches(s, '^[A-Za-z][A-Za-z''’-]*\\*? \\[[^\\]]+\\]') THEN 'ENTRY_HEAD'
 WHEN s IN ('词根/词', '缀', '含义', '例词及释义') THEN 'PREVIEW_TABLE' WHEN regexp_matches(s, '^[记搭例派同反]( |$)') THEN 'ENTRY_FIELD' WHEN regexp_matches(s, '^\\d{1,4}$') THEN 'PAGE_NUMBER'
 WHEN s IN ('音频', '影视剧场景') THEN 'DECORATION' ELSE 'BODY_TEXT' END"""
_LINES = f""", ln0 AS (SELECT processing_run_id AS run, page_id, page_number, source_block_id, coalesce(reading_order, 0) AS ro, source_engine, bold_lines,
  unnest(string_split_regex(coalesce(raw_text, ''), {_SPLIT})) AS raw, generate_subscripts(string_split_regex(coalesce(raw_text, ''), {_SPLIT}), 1) AS i FROM blk),
ln AS (SELECT *, {_strip('raw')} AS line, {_squeeze('raw')} AS s FROM ln0 WHERE {_strip('raw')} <> ''),
cl AS (SELECT *, {_CLASS} AS k0 FROM ln),
cls AS (SELECT *, CASE WHEN k0 IN ('BODY_TEXT', 'PREVIEW_TABLE') AND regexp_matches(s, '^[A-Za-z][A-Za-z''’-]*\\*?$') AND coalesce(list_contains(bold_lines, s), false) THEN 'BARE_HEAD' ELSE k0 END AS k,
  row_number() OVER (PARTITION BY run ORDER BY page_number NULLS LAST, page_id, ro, source_block_id, i) AS q FROM cl)
"""
#: The automaton with plain windows per run; the Spark side carries its state in two levels.
_SEGMENTS = (
    _LINES
    + """, a AS (SELECT *, coalesce(last_value(CASE k WHEN 'WORD_LIST_HEADER' THEN 0 WHEN 'NON_ENTRY_SECTION_HEADER' THEN 1 END IGNORE NULLS) OVER w, 0) AS ne,
  last_value(CASE WHEN k = 'WORD_LIST_HEADER' THEN CAST(regexp_extract(s, '(\\d+)$', 1) AS INT) END IGNORE NULLS) OVER w AS wl,
  max(CASE WHEN k = 'ENTRY_HEAD' THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS hh FROM cls WINDOW w AS (PARTITION BY run ORDER BY q ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, ne = 0 AND k NOT IN ('WORD_LIST_HEADER', 'NON_ENTRY_SECTION_HEADER') AS live, k IN ('ENTRY_HEAD', 'BARE_HEAD') AS head FROM a),
c AS (SELECT *, coalesce(last_value(CASE WHEN k IN ('WORD_LIST_HEADER', 'NON_ENTRY_SECTION_HEADER') THEN 0 WHEN live AND k = 'PREVIEW_TABLE_HEADER' THEN 1 WHEN live AND head THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY run ORDER BY q ROWS UNBOUNDED PRECEDING), 0) AS pv FROM b),
d AS (SELECT *, live AND pv = 0 AND k NOT IN ('PREVIEW_TABLE_HEADER', 'PAGE_NUMBER', 'DECORATION', 'EMPTY') AS keep,
  sum(CASE WHEN k IN ('WORD_LIST_HEADER', 'NON_ENTRY_SECTION_HEADER') OR (live AND k = 'PREVIEW_TABLE_HEADER') THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY q ROWS UNBOUNDED PRECEDING) AS sec FROM c),
e AS (SELECT *, min(CASE WHEN keep AND head THEN q END) OVER (PARTITION BY run, sec) AS fh,
  keep AND hh = 0 AND regexp_matches(s, '^[A-Za-z][A-Za-z''’-]{1,63}( /[^/]+/)?( (?:n|v|vt|vi|adj|adv|prep|conj|pron|det|excl)\\.(?:/(?:n|v|vt|vi|adj|adv|prep|conj|pron|det|excl)\\.)*)?( .+)?$') AS leg FROM d),
f AS (SELECT *, min(CASE WHEN leg AND (fh IS NULL OR q < fh) THEN q END) OVER (PARTITION BY run, sec) AS fl FROM e),
g AS (SELECT *, max(CASE WHEN keep AND head THEN q WHEN q = fl THEN q END) OVER (PARTITION BY run, sec ORDER BY q ROWS UNBOUNDED PRECEDING) AS entry FROM f),
m AS (SELECT * FROM g WHERE keep AND entry IS NOT NULL),
ord AS (SELECT run, entry, row_number() OVER (PARTITION BY run ORDER BY entry) AS entry_order FROM (SELECT DISTINCT run, entry FROM m)),
seg AS (SELECT m.*, o.entry_order FROM m JOIN ord o ON m.run = o.run AND m.entry = o.entry),
link AS (SELECT run, entry_order, source_block_id, min(q) AS q FROM seg GROUP BY ALL),
pg AS (SELECT run, entry_order, page_number, min(q) AS q FROM seg WHERE page_number IS NOT NULL GROUP BY ALL)
"""
)
_ENTRY_LINES = f""", el0 AS (SELECT source_entry_id, unnest(string_split_regex(raw_text, {_SPLIT})) AS raw, generate_subscripts(string_split_regex(raw_text, {_SPLIT}), 1) AS i FROM ent),
el1 AS (SELECT source_entry_id, {_squeeze('raw')} AS s, row_number() OVER (PARTITION BY source_entry_id ORDER BY i) AS i FROM el0 WHERE {_strip('raw')} <> ''),
el2 AS (SELECT *, {_CLASS} AS k, first_value(s) OVER (PARTITION BY source_entry_id ORDER BY i) AS h FROM el1),
el AS (SELECT * FROM el2 WHERE regexp_matches(h, '^[A-Za-z][A-Za-z''’-]*\\*? \\[[^\\]]+\\]') OR regexp_matches(h, '^[A-Za-z][A-Za-z''’-]*\\*?$')),
body AS (SELECT *, CASE WHEN i = 1 THEN trim(regexp_replace(s, '^[A-Za-z][A-Za-z''’-]*\\*?( \\[[^\\]]+\\])?', '')) ELSE s END AS t,
  last_value(CASE WHEN i > 1 AND k = 'ENTRY_FIELD' THEN s[1] END IGNORE NULLS) OVER (PARTITION BY source_entry_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS mark FROM el),
fl AS (SELECT *, k = 'ENTRY_FIELD' AS opens FROM body WHERE i > 1 AND mark IS NOT NULL AND k NOT IN ('WORD_LIST_HEADER', 'PREVIEW_TABLE_HEADER', 'PREVIEW_TABLE', 'PAGE_NUMBER', 'DECORATION')),
fl2 AS (SELECT *, CASE WHEN opens THEN trim(s[2:]) ELSE s END AS part FROM fl),
fl3 AS (SELECT *, greatest(1, sum(CASE WHEN opens AND part <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY source_entry_id, mark ORDER BY i ROWS UNBOUNDED PRECEDING)) AS n FROM fl2 WHERE part <> ''),
fld AS (SELECT source_entry_id, mark, n, string_agg(part, ' ' ORDER BY i) AS text FROM fl3 GROUP BY ALL),
un AS (SELECT * FROM body WHERE mark IS NULL AND t <> '' AND (i = 1 OR k NOT IN ('WORD_LIST_HEADER', 'PREVIEW_TABLE_HEADER', 'PREVIEW_TABLE', 'PAGE_NUMBER', 'DECORATION'))),
un2 AS (SELECT *, regexp_matches(t, '^\\[[^\\]]+\\]') AND (regexp_extract(t, '^\\[[^\\]]+\\]\\s*(.*)$', 1) = '' OR regexp_matches(regexp_extract(t, '^\\[[^\\]]+\\]\\s*(.*)$', 1), '^(n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\\.')) AS isipa FROM un),
un3 AS (SELECT *, CASE WHEN isipa THEN regexp_extract(t, '^\\[[^\\]]+\\]\\s*(.*)$', 1) ELSE t END AS r FROM un2),
un4 AS (SELECT *, regexp_matches(r, '^(n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\\.') AS pos FROM un3 WHERE r <> ''),
un5 AS (SELECT *, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER (PARTITION BY source_entry_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n,
  CASE WHEN pos THEN trim(regexp_replace(r, '^(?:n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\\.(?:/(?:n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\\.)*', '')) ELSE r END AS d FROM un4),
un6 AS (SELECT *, lag(d) OVER (PARTITION BY source_entry_id, n ORDER BY i) AS before FROM un5 WHERE n > 0),
sen AS (SELECT source_entry_id, n, max(CASE WHEN pos THEN regexp_extract(r, '^((?:n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\\.(?:/(?:n|v|vt|vi|adj|adv|prep|conj|pron|num|art)\\.)*)', 1) END) AS part_of_speech,
  string_agg(CASE WHEN before IS NULL OR before = '' OR regexp_matches(before, '[\\x{{3400}}-\\x{{9fff}}，。；：！？、（）【】《》“”‘’]$') OR regexp_matches(d, '^[\\x{{3400}}-\\x{{9fff}}，。；：！？、（）【】《》“”‘’]') THEN '' ELSE ' ' END || d, '' ORDER BY i) AS definition FROM un6 GROUP BY ALL)
"""
_FIELD_NAMES = "CASE mark WHEN '记' THEN 'MEMORY_NOTE' WHEN '搭' THEN 'COLLOCATION' WHEN '例' THEN 'EXAMPLE' WHEN '派' THEN 'DERIVATIVE' WHEN '同' THEN 'SYNONYM' ELSE 'ANTONYM' END"
_PROFILE = _LATEST + f""", pp AS (SELECT page_id, CAST(sum(length(coalesce(raw_text, ''))) AS BIGINT) AS text_length, count(*) AS n_blocks,
  CAST(sum(length(coalesce(raw_text, '')) - length(regexp_replace(coalesce(raw_text, ''), '[{IPA_LETTERS}]', '', 'g'))) AS BIGINT) AS n_phonetic, count(*) FILTER (bbox.x2 < 0.5) AS n_left, count(*) FILTER (bbox.x1 > 0.45) AS n_right,
  count(*) FILTER (source_engine <> 'pymupdf-native') AS n_recognised FROM blk GROUP BY page_id),
pt AS (SELECT *, list_sort(list_filter([CASE WHEN n_left >= 2 AND n_right >= 2 THEN 'DOUBLE_COLUMN' END, CASE WHEN n_phonetic >= 100 THEN 'IPA_DENSE' END, CASE WHEN text_length < 200 THEN 'SPARSE' END,
  CASE WHEN n_recognised > 0 THEN 'SCANNED' END, CASE WHEN text_length >= 200 AND n_recognised = 0 THEN 'NORMAL' END], lambda x: x IS NOT NULL)) AS tl FROM pp)
"""  # fmt: skip

QUERIES = {f.__name__: f for f in (
    text_layer_profile, squeezed_texts, line_class_counts, segmented_entries, entry_links, segmentation_metrics, parsed_heads, entry_fields, entry_senses, field_provenance, one_line_entries, effective_texts,
    audit_queue, page_review_flags, page_layout, pages_without_text, low_confidence_blocks, review_latest_state, review_detail, unlinked_rows, representation_metrics, validation_issues, page_islands, page_profile, sample_selection,
)}

SQL = {
    "text_layer_profile": f"""SELECT document_version_id, n_texts, n_with_layer, round(n_with_layer / n_texts, 6) AS coverage, CASE WHEN n_with_layer = n_texts THEN 'NATIVE_TEXT' WHEN n_with_layer = 0 THEN 'SCANNED' ELSE 'HYBRID' END AS mode
 FROM (SELECT document_version_id, count(*) AS n_texts, count(*) FILTER (length({_strip("coalesce(text, '')")}) >= 20) AS n_with_layer FROM documents GROUP BY 1)""",
    "squeezed_texts": _LATEST + f"SELECT sha256(t) AS digest, length(t) AS n_chars, count(*) AS n FROM (SELECT lower({_squeeze(chr(99) + 'oalesce(raw_text, ' + chr(39) * 2 + ')')}) AS t FROM blk) GROUP BY t",
    "line_class_counts": _LATEST + _LINES + "SELECT source_engine, k0 AS line_class, count(*) AS n_lines, round(avg(CASE k0 WHEN 'EMPTY' THEN 1.0 WHEN 'WORD_LIST_HEADER' THEN 0.99 WHEN 'PREVIEW_TABLE_HEADER' THEN 0.99 WHEN 'NON_ENTRY_SECTION_HEADER' THEN 0.99 WHEN 'ENTRY_HEAD' THEN 0.98 WHEN 'PREVIEW_TABLE' THEN 0.95 WHEN 'ENTRY_FIELD' THEN 0.96 WHEN 'PAGE_NUMBER' THEN 0.98 WHEN 'DECORATION' THEN 0.98 ELSE 0.6 END), 6) AS confidence FROM cls GROUP BY 1, 2",
    "segmented_entries": _LATEST + _SEGMENTS + """SELECT seg.run AS run, CAST(seg.entry_order AS INT) AS entry_order, regexp_extract(min_by(s, q), '^([A-Za-z][A-Za-z''’-]*)', 1) AS lemma, regexp_matches(min_by(s, q), '^[A-Za-z][A-Za-z''’-]*\\*') AND min_by(head, q) AS starred,
 sha256(string_agg(line, chr(10) ORDER BY q)) AS text_digest, CAST(CASE min_by(k, q) WHEN 'ENTRY_HEAD' THEN 0.98 WHEN 'BARE_HEAD' THEN 0.97 ELSE 0.8 END AS DOUBLE) AS confidence, min_by(wl, q) AS word_list, count(DISTINCT source_block_id) AS n_blocks,
 coalesce((SELECT string_agg(page_number, ',' ORDER BY pg.q) FROM pg WHERE pg.run = seg.run AND pg.entry_order = seg.entry_order), '') AS pages, count(DISTINCT page_number) > 1 AS cross_page FROM seg GROUP BY seg.run, seg.entry_order""",
    "entry_links": _LATEST + _SEGMENTS + "SELECT run, CAST(entry_order AS INT) AS entry_order, CAST(row_number() OVER (PARTITION BY run, entry_order ORDER BY q) AS INT) AS block_order, source_block_id AS block_id FROM link",
    "segmentation_metrics": _LATEST + _SEGMENTS + """, z AS (SELECT run, entry_order, min_by(k, q) AS k, count(DISTINCT source_block_id) AS nb, count(DISTINCT page_number) AS np, regexp_matches(min_by(s, q), '^[A-Za-z][A-Za-z''’-]*\\*') AND min_by(head, q) AS st FROM seg GROUP BY 1, 2)
 SELECT run, count(*) AS n_entries, CAST(sum(nb) AS BIGINT) AS n_links, count(*) FILTER (np > 1) AS n_cross_page, count(*) FILTER (st) AS n_starred, round(avg(CASE k WHEN 'ENTRY_HEAD' THEN 0.98 WHEN 'BARE_HEAD' THEN 0.97 ELSE 0.8 END), 6) AS confidence FROM z GROUP BY 1""",
    "parsed_heads": _LATEST + _ENTRY_LINES + """SELECT e.source_entry_id, regexp_extract(h, '^([A-Za-z][A-Za-z''’-]*)', 1) AS lemma, regexp_matches(h, '^[A-Za-z][A-Za-z''’-]*\\*') AS starred,
 coalesce(nullif(regexp_extract(h, '^[A-Za-z][A-Za-z''’-]*\\*? \\[([^\\]]+)\\]', 1), ''), (SELECT regexp_extract(min_by(t, i), '^\\[([^\\]]+)\\]', 1) FROM un2 WHERE isipa AND un2.source_entry_id = e.source_entry_id)) AS ipa,
 CAST(CASE WHEN regexp_matches(h, ' \\[[^\\]]+\\]') THEN 1 ELSE 0 END + (SELECT count(*) FROM un2 WHERE isipa AND un2.source_entry_id = e.source_entry_id) AS INT) AS n_ipas,
 CAST((SELECT count(*) FROM sen WHERE sen.source_entry_id = e.source_entry_id) AS INT) AS n_senses, CAST((SELECT count(*) FROM fld WHERE fld.source_entry_id = e.source_entry_id) AS INT) AS n_fields FROM el e WHERE i = 1""",
    "entry_fields": _LATEST + _ENTRY_LINES + f"SELECT source_entry_id, {_FIELD_NAMES} AS field_type, CAST(n AS INT) AS field_order, text, CASE WHEN mark = '记' THEN 'zh' END AS language FROM fld",
    "entry_senses": _LATEST + _ENTRY_LINES + "SELECT source_entry_id, CAST(n AS INT) AS sense_order, part_of_speech, definition FROM sen",
    "field_provenance": _LATEST + _ENTRY_LINES + """, fp AS (SELECT source_entry_id, 'lemma' AS path FROM el WHERE i = 1 UNION ALL SELECT source_entry_id, 'pronunciations' FROM el WHERE i = 1 AND regexp_matches(h, '^[A-Za-z][A-Za-z''’-]*\\*? \\[[^\\]]+\\]')
 UNION ALL SELECT source_entry_id, 'pronunciations' FROM un2 WHERE isipa UNION ALL SELECT source_entry_id, 'senses' FROM sen UNION ALL SELECT source_entry_id, 'fields' FROM fld)
 SELECT path, count(*) AS n_fields, count(ent.block_ids[1]) AS n_with_block, count(DISTINCT fp.source_entry_id) AS n_entries FROM fp JOIN ent ON fp.source_entry_id = ent.source_entry_id GROUP BY 1""",
    "one_line_entries": f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, {_SPLIT})) AS raw, generate_subscripts(string_split_regex(text, {_SPLIT}), 1) AS i FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, {_squeeze('raw')} AS s FROM l WHERE {_strip('raw')} <> '')
 SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(regexp_extract(s, {_ONE_LINE}, 1)) AS lemma, nullif(trim(regexp_extract(s, {_ONE_LINE}, 3)), '') AS pos, nullif(trim(regexp_extract(s, {_ONE_LINE}, 4)), '') AS definition FROM s WHERE regexp_matches(s, {_ONE_LINE})""",
    "effective_texts": _LATEST + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_entry_id ORDER BY resolved_at DESC) AS r2 FROM res WHERE source_entry_id IS NOT NULL) WHERE r2 = 1),
 t AS (SELECT ent.source_entry_id, l.decision, CASE WHEN l.decision = 'DISCARD' THEN '' WHEN l.decision = 'ACCEPT' AND length(coalesce(l.corrected_text, '')) > 0 THEN l.corrected_text ELSE coalesce(ent.raw_text, '') END AS t FROM ent LEFT JOIN l ON ent.source_entry_id = l.source_entry_id)
 SELECT source_entry_id, decision, sha256(t) AS text_digest, length(t) AS n_chars FROM t""",
    "low_confidence_blocks": _LATEST + """SELECT source_block_id, page_id, confidence FROM blk WHERE source_engine <> 'pymupdf-native' AND (confidence IS NULL OR confidence < 0.85)
 AND NOT EXISTS (SELECT 1 FROM ent JOIN res ON ent.source_entry_id = res.source_entry_id WHERE res.decision IN ('ACCEPT', 'DISCARD') AND list_contains(ent.block_ids, blk.source_block_id))""",
    "audit_queue": _LATEST + f"""SELECT 'block' AS kind, source_block_id AS row_id, CAST(page_number AS VARCHAR) AS pages, 'low_confidence' AS reason, coalesce(raw_text, '')[1:240] AS excerpt FROM blk WHERE source_engine <> 'pymupdf-native' AND coalesce(confidence, 0) < 0.85
 UNION ALL SELECT 'entry', source_entry_id, array_to_string(source_pages, ','), 'cross_page', raw_text[1:240] FROM ent WHERE len(source_pages) > 1
 UNION ALL SELECT 'entry', source_entry_id, array_to_string(source_pages, ','), 'no_headword', coalesce(raw_text, '')[1:240] FROM ent WHERE NOT coalesce(regexp_matches(trim(regexp_replace(raw_text, '{_W}+', ' ', 'g')), '^[A-Za-z][A-Za-z''’-]*\\*? \\[[^\\]]+\\]')
   OR regexp_matches(trim(regexp_extract(raw_text, '^{_W}*([^\\n\\r]*)', 1)), '^[A-Za-z][A-Za-z''’-]*\\*?$'), false)""",
    "page_review_flags": _LATEST + """, b AS (SELECT document_version_id, page_number, count(*) AS nb, bool_or(coalesce(confidence, 0) < 0.85) AS lb FROM blk GROUP BY 1, 2), x AS (SELECT document_version_id, unnest(source_pages) AS page_number, segmentation_confidence AS c, len(source_pages) AS np FROM ent),
 e AS (SELECT document_version_id, page_number, count(*) AS ne, bool_or(coalesce(c, 0) < 0.85) AS le, bool_or(np > 1) AS cp FROM x GROUP BY 1, 2)
 SELECT coalesce(b.document_version_id, e.document_version_id) AS document_version_id, coalesce(b.page_number, e.page_number) AS page_number, CAST(coalesce(nb, 0) AS INT) AS n_blocks, CAST(coalesce(ne, 0) AS INT) AS n_entries,
 concat_ws(',', CASE WHEN nb IS NULL THEN 'no_blocks' END, CASE WHEN lb THEN 'low_confidence_block' END, CASE WHEN ne IS NULL THEN 'no_entries' END, CASE WHEN le THEN 'low_confidence_entry' END, CASE WHEN cp THEN 'cross_page_entry' END) AS flags
 FROM b FULL JOIN e ON b.document_version_id = e.document_version_id AND b.page_number = e.page_number""",
    "page_layout": _LATEST + _LINES + """, k AS (SELECT source_block_id, string_agg(DISTINCT k0, ',' ORDER BY k0) AS kinds FROM cls GROUP BY 1), l AS (SELECT source_entry_id, entry_order, unnest(block_ids) AS b, generate_subscripts(block_ids, 1) AS i FROM ent),
 o AS (SELECT b, count(*) AS n, bool_or(i = 1) AS st, min_by(source_entry_id, (entry_order, source_entry_id)) AS fe FROM l GROUP BY 1) SELECT page_id, blk.source_block_id AS block_id, kinds, coalesce(st, false) AS starts_entry, CAST(coalesce(n, 0) AS INT) AS n_entries, fe AS first_entry
 FROM blk JOIN k ON blk.source_block_id = k.source_block_id LEFT JOIN o ON o.b = blk.source_block_id""",
    "pages_without_text": _LATEST + f"SELECT DISTINCT page_id FROM blk WHERE page_id NOT IN (SELECT page_id FROM blk WHERE source_engine = 'pymupdf-native' GROUP BY 1 HAVING sum(length({_strip(chr(99) + 'oalesce(raw_text, ' + chr(39) * 2 + ')')})) >= 20)",
    "review_latest_state": _LATEST + "SELECT review_task_id, arg_max(resolution_id, resolved_at) AS resolution_id, arg_max(decision, resolved_at) AS decision, arg_max(reviewer_id, resolved_at) AS reviewer_id FROM res WHERE review_task_id IS NOT NULL GROUP BY 1",
    "review_detail": _LATEST + "SELECT r.resolution_id, r.decision, e.lemma AS entry_lemma, b.page_number FROM res r LEFT JOIN ent e ON r.source_entry_id = e.source_entry_id LEFT JOIN blk b ON e.block_ids[1] = b.source_block_id",
    "unlinked_rows": _LATEST + """, en AS (SELECT * FROM ent WHERE len(source_pages) = 1), bk AS (SELECT * FROM blk WHERE confidence IS NOT NULL)
 SELECT 'vocabulary' AS kind, vocabulary_entry_id AS row_id FROM voc WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.source_entry_id = voc.source_entry_id)
 UNION ALL SELECT DISTINCT 'entry', source_entry_id FROM (SELECT source_entry_id, unnest(block_ids) AS b FROM en) WHERE b NOT IN (SELECT source_block_id FROM bk)
 UNION ALL SELECT 'review', resolution_id FROM res WHERE source_entry_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM en WHERE en.source_entry_id = res.source_entry_id)""",
    "representation_metrics": _LATEST + f"""SELECT processing_run_id, count(*) AS n_blocks, count(DISTINCT page_id) AS n_pages, count(DISTINCT CASE WHEN {_strip("coalesce(raw_text, '')")} <> '' THEN page_id END) AS n_pages_with_text,
 count(*) FILTER (NOT coalesce(bbox.unit = 'normalized' AND bbox.x1 BETWEEN 0 AND bbox.x2 AND bbox.x2 <= 1 AND bbox.y1 BETWEEN 0 AND bbox.y2 AND bbox.y2 <= 1, false)) AS n_bad_boxes, count(*) FILTER ({_strip("coalesce(raw_text, '')")} = '') AS n_empty, round(avg(confidence), 4) AS confidence FROM blk GROUP BY 1""",
    "validation_issues": _LATEST + f"""SELECT vocabulary_entry_id, 'INVALID_LEMMA' AS issue FROM voc WHERE NOT coalesce(regexp_matches(lemma, '^[A-Za-z][A-Za-z''’-]{{0,511}}$'), false) UNION ALL SELECT vocabulary_entry_id, 'INVALID_IPA' FROM voc WHERE regexp_matches(ipa, '[0-9<>={{}}\\\\]')
 UNION ALL SELECT vocabulary_entry_id, 'MISSING_SENSE' FROM voc WHERE {_strip("coalesce(part_of_speech, '')")} = '' UNION ALL SELECT vocabulary_entry_id, 'MISSING_DEFINITION' FROM voc WHERE {_strip("coalesce(definition, '')")} = ''""",
    "page_islands": _LATEST + """, p AS (SELECT DISTINCT document_version_id, page_number FROM blk WHERE page_number IS NOT NULL), s AS (SELECT *, CASE WHEN lag(page_number) OVER w = page_number - 1 THEN 0 ELSE 1 END AS st FROM p WINDOW w AS (PARTITION BY document_version_id ORDER BY page_number)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY document_version_id ORDER BY page_number) AS isl FROM s) SELECT document_version_id, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages FROM i GROUP BY document_version_id, isl""",
    "page_profile": _PROFILE + "SELECT * EXCLUDE (tl), array_to_string(tl, ',') AS tags FROM pt",
    "sample_selection": _PROFILE + """, bt AS (SELECT page_id, row_number() OVER (PARTITION BY tag ORDER BY n_phonetic DESC, n_blocks DESC, page_id) AS n FROM (SELECT page_id, n_phonetic, n_blocks, unnest(tl) AS tag FROM pt)), b AS (SELECT DISTINCT page_id FROM bt WHERE n = 1),
 a AS (SELECT page_id, CASE WHEN page_id IN (SELECT page_id FROM b) THEN 0 ELSE 1 END AS phase, greatest(len(tl), 1) AS d, n_phonetic FROM pt) SELECT page_id, phase FROM a ORDER BY phase, d DESC, n_phonetic DESC, page_id LIMIT 30""",
}
