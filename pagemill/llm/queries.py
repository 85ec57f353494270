"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import labels, leaks, lookalike, mix, scan, split
from pagemill.session import latest, materialize, read


def _entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``list_name, row_id, value`` of the latest rows that hold a value."""
    pos = latest(read(spark, sf_dir, "vocabulary_entries"), "vocabulary_entry_id", "received_at", "part_of_speech")
    cls = latest(read(spark, sf_dir, "review_resolutions"), "resolution_id", "received_at", "classification")
    return (
        pos.select(F.lit("part_of_speech").alias("list_name"), F.col("vocabulary_entry_id").alias("row_id"), F.col("part_of_speech").alias("value"))
        .unionByName(cls.select(F.lit("classification").alias("list_name"), F.col("resolution_id").alias("row_id"), F.col("classification").alias("value")))
        .where("value IS NOT NULL")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value is not exactly a code, with the code meant or UNMATCHED."""
    reference = read(spark, sf_dir, "label_reference")
    rows = _entered(spark, sf_dir)
    codes = reference.where("code IS NOT NULL").select("list_name", F.col("code").alias("value")).distinct()
    free = rows.join(codes, ["list_name", "value"], "left_anti")
    mapped = labels.map_to_list(free, reference)
    return free.join(mapped, ["list_name", "value"]).select(F.col("list_name").alias("field_name"), "row_id", "code")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct entered value with its code, score and number of rows."""
    reference = read(spark, sf_dir, "label_reference")
    counted = _entered(spark, sf_dir).groupBy("list_name", "value").agg(F.count("*").alias("n_rows"))
    mapped = labels.map_to_list(counted, reference)
    return counted.join(mapped, ["list_name", "value"]).select("list_name", "value", "code", F.round("score", 4).alias("score"), "n_rows")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_name, row_id, text`` of the latest rows of the three tables of scanned text."""
    parts = [
        latest(read(spark, sf_dir, table), key, "received_at", text).select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.col(text).alias("text"))
        for table, key, text in (("source_blocks", "source_block_id", "text"), ("source_entries", "source_entry_id", "raw_text"), ("vocabulary_entries", "vocabulary_entry_id", "definition"))
    ]
    return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text IS NOT NULL"), "scanned")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds divided words, misread characters, headers or page numbers."""
    return p3_repaired(spark, sf_dir).where("n_joined + n_furniture + n_replaced > 0").select("table_name", "row_id")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its text as printed."""
    return scan.repair_texts(_scanned(spark, sf_dir), ["table_name", "row_id"])


def _vocabulary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_name, vocabulary_entry_id, profile, text`` of the latest vocabulary rows."""
    rows = latest(read(spark, sf_dir, "vocabulary_entries"), "vocabulary_entry_id", "received_at", "lemma", "ipa", "definition")
    field = lambda name, profile: F.struct(F.lit(name).alias("field_name"), F.lit(profile).alias("profile"), F.col(name).alias("text"))
    fields = F.array(field("lemma", "lemma"), field("ipa", "ipa"), field("definition", "text"))
    return rows.select("vocabulary_entry_id", F.explode(fields).alias("f")).select("vocabulary_entry_id", "f.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are not in house form."""
    return p4_house_form(spark, sf_dir).select("field_name", "vocabulary_entry_id")


def p4_house_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the text as it is and in house form."""
    return lookalike.house_form(_vocabulary_fields(spark, sf_dir), ["field_name", "vocabulary_entry_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item word for word, with the item."""
    return leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with reworded passages, the share of common words and whether an answer is near."""
    found = leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), paraphrases=True)
    return found.withColumn("cosine", F.round("cosine", 3)).withColumn("common_share", F.round("common_share", 3))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set in order of ``slot, position``."""
    return mix.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    report = mix.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]
    return report.withColumn("share", F.round("share", 6))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to be cut."""
    return _split(spark, sf_dir).where("piece_no = 0").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the documents to be cut."""
    return _split(spark, sf_dir)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "size_limits"))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_house_form": p4_house_form, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mixture": p7_mixture, "p7_report": p7_report,
    "p8_found": p8_found, "p8_pieces": p8_pieces,
}


def _sql_fold(c: str) -> str:
    """The look-alike table as SQL: one-to-one characters by translate, ligatures by replace, the rest of accents composed."""
    table = {chr(k): v for k, v in lookalike.TABLES["text"].items() if k < 0x10000 and "'" not in (chr(k) + v)}
    singles = {k: v for k, v in table.items() if len(v) == 1}
    gone = "".join(k for k, v in table.items() if v == "")
    out = f"translate({c}, '{''.join(singles)}', '{''.join(singles.values())}')"
    for k, v in table.items():
        if len(v) > 1 and 0xFB00 <= ord(k) < 0xFB07:
            out = f"replace({out}, '{k}', '{v}')"
    return f"nfc_normalize(regexp_replace({out}, '[{gone}]', '', 'g'))"


_P4_SQL = r"""
WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vocabulary_entry_id ORDER BY received_at DESC) AS n FROM vocabulary_entries) WHERE n = 1)
SELECT 'lemma' AS field_name, vocabulary_entry_id FROM v WHERE regexp_matches(lemma, '[^ -~À-ɏ]|^ | $') OR lemma <> nfc_normalize(lemma)
UNION ALL SELECT 'ipa', vocabulary_entry_id FROM v WHERE regexp_matches(ipa, '[^a-fh-zˈˌːɡəɑæʃθðŋɪʊɔɜʌʒɒɛ]')
UNION ALL SELECT 'definition', vocabulary_entry_id FROM v WHERE regexp_matches(definition, '[^ -~\r\nÀ-ɏ\x{4e00}-\x{9fff}，；：（）！？。、—·¬…]|^\s|\s$') OR definition <> nfc_normalize(definition)
"""

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _sql_plain(c: str) -> str:
    narrow = f"translate({c}, '{_WIDE}', '{_NARROW}')"
    return f"regexp_replace(regexp_replace(lower({narrow}), '\\b(and|or)\\b', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


#: By edit distance with transpositions instead of n-grams: whole values, and their Latin, Chinese, bracketed and labelled parts.
_P1_SQL = f"""
WITH v AS (SELECT 'part_of_speech' AS field_name, vocabulary_entry_id AS row_id, part_of_speech AS value FROM (SELECT *, row_number() OVER (PARTITION BY vocabulary_entry_id ORDER BY received_at DESC) AS n FROM vocabulary_entries) WHERE n = 1
 UNION ALL SELECT 'classification', resolution_id, classification FROM (SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY received_at DESC) AS n FROM review_resolutions) WHERE n = 1),
f AS (SELECT * FROM v WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM label_reference r WHERE r.list_name = v.field_name AND r.code = v.value)),
d AS (SELECT DISTINCT field_name, value FROM f),
s AS (SELECT field_name, value, {_sql_plain("unnest([value, regexp_replace(value, '[^A-Za-z/. ]+', '', 'g'), regexp_replace(value, '[^一-龥/]+', '', 'g'), regexp_extract(value, '^([^(:]+)', 1), regexp_extract(value, '[(:] *([^)]+)', 1)])")} AS part FROM d),
r AS (SELECT list_name, code, {_sql_plain("unnest([code, label_en, label_zh])")} AS form FROM label_reference),
m AS (SELECT s.field_name, s.value, r.code, min(damerau_levenshtein(part, form) / greatest(length(part), length(form))) AS far FROM s JOIN r ON s.field_name = r.list_name WHERE part <> '' GROUP BY ALL),
b AS (SELECT field_name, value, min_by(code, far) AS code, min(far) AS far FROM m GROUP BY ALL)
SELECT f.field_name, f.row_id, CASE WHEN b.far <= 0.37 THEN b.code ELSE 'UNMATCHED' END AS code FROM f LEFT JOIN b ON f.field_name = b.field_name AND f.value = b.value
"""

#: Every run of 12 words or 20 characters of the items against every run of the documents.
_P6_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower({_sql_fold('text')}), '[a-zà-ɏ0-9]+|[\x{{4e00}}-\x{{9fff}}]') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, CASE lang WHEN 'en' THEN 12 ELSE 20 END AS k, regexp_extract_all(lower({_sql_fold('text')}), '[a-zà-ɏ0-9]+|[\x{{4e00}}-\x{{9fff}}]') AS t FROM eval_items),
ir AS (SELECT item_id, k, array_to_string(t[p:p + k - 1], ' ') AS r FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS p FROM i)),
dr AS (SELECT doc_id, k, array_to_string(t[p:p + k - 1], ' ') AS r FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS p FROM w, (SELECT unnest([12, 20]) AS k)))
SELECT DISTINCT item_id, doc_id FROM ir JOIN dr ON ir.k = dr.k AND ir.r = dr.r
"""

#: By counting words, signs and characters instead of tokens: no text lies between 0.7 and 1.8 of its limit.
_P8_SQL = r"""
WITH l AS (SELECT source, min(max_tokens) AS most FROM size_limits WHERE source IS NOT NULL AND max_tokens > 0 GROUP BY 1),
e AS (SELECT doc_id, most, 1.2 * len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]')) + 2 * len(regexp_extract_all(text, '[^\x00-\x7f]')) AS n FROM documents JOIN l ON documents.source = l.source WHERE text IS NOT NULL)
SELECT DISTINCT doc_id FROM e WHERE n > most
"""

SQL: dict[str, str] = {"p1_found": _P1_SQL, "p4_found": _P4_SQL, "p6_found": _P6_SQL, "p8_found": _P8_SQL}
