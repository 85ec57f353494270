"""The published dataset: nested records, canonical serialisations, content hashes, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import canonical_json
from pagemill.operators import parse


def gold_records(vocabulary: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, lemma, record``: one canonical JSON record per vocabulary entry, with the fields of its source entry.

    Marked fields are parsed inside each source row, so the only shuffle is the join of vocabulary and entries.
    """
    e = entries.select("source_entry_id", "source_pages", "starred", "word_list", parse.parsed(F.col("raw_text")).alias("p"))
    j = vocabulary.select("vocabulary_entry_id", "source_entry_id", "lemma", "display_form", "ipa", "part_of_speech", "definition", "language", "machine_verification_status").join(e, "source_entry_id", "left")
    sense = F.struct(F.array_compact(F.array("definition")).alias("definitions"), F.col("part_of_speech"))
    record = canonical_json(
        id=F.col("vocabulary_entry_id"), lemma=F.col("lemma"), language=F.col("language"), verification_status=F.col("machine_verification_status"), source_entry_id=F.col("source_entry_id"),
        pronunciations=F.array_compact(F.array("ipa")), senses=F.array(sense), source_pages=F.coalesce("source_pages", F.expr("cast(array() as array<int>)")),
        source_fields=F.coalesce(F.transform("p.fields", lambda f: F.struct(f["text"].alias("text"), f["type"].alias("type"))), F.expr("cast(array() as array<struct<text:string,type:string>>)")),
    )
    return j.select(F.col("vocabulary_entry_id").alias("id"), "lemma", record.alias("record"))


def gold_dataset(vocabulary: DataFrame, entries: DataFrame, media: DataFrame) -> DataFrame:
    """``run, id, record``: the nested published form: pronunciations, senses in order, fields by type, pages and media.

    ``media``: ``vocabulary_entry_id, media_order, sha256, media_role``. A run with nothing to publish has no rows. Senses and fields
    are those of the source entry; where it has no sense, the vocabulary's own definition stands. The record is canonical
    JSON: names in alphabetical order, nulls kept, no blanks.
    """
    e = entries.select("source_entry_id", "source_pages", parse.dispatched(F.col("raw_text")).alias("p"))
    m = media.groupBy("vocabulary_entry_id").agg(F.array_sort(F.collect_list(F.struct("media_order", "media_role", "sha256"))).alias("media"))
    j = vocabulary.join(e, "source_entry_id", "left").join(m, "vocabulary_entry_id", "left")
    none = lambda t: F.expr(f"cast(array() as {t})")
    own = F.when(F.col("definition").isNotNull() | F.col("part_of_speech").isNotNull(), F.array(F.struct(F.array_compact(F.array("definition")).alias("definitions"), F.col("part_of_speech")))).otherwise(none("array<struct<definitions:array<string>,part_of_speech:string>>"))
    read = F.transform("p.senses", lambda s: F.struct(F.array_compact(F.array(s["definition"])).alias("definitions"), s["pos"].alias("part_of_speech")))
    types = F.array_sort(F.array_distinct(F.transform("p.fields", lambda f: f["type"])))
    by_type = F.map_from_entries(F.transform(types, lambda t: F.struct(t.alias("t"), F.transform(F.filter("p.fields", lambda f: f["type"] == t), lambda f: f["text"]).alias("v"))))
    record = canonical_json(
        id=F.col("vocabulary_entry_id"), language=F.col("language"), lemma=F.col("lemma"), pronunciations=F.transform(F.array_compact(F.array("ipa")), lambda i: F.struct(F.lit(None).cast("string").alias("dialect"), i.alias("ipa"))),
        senses=F.when(F.size("p.senses") > 0, read).otherwise(own), source_entry_id=F.col("source_entry_id"), source_fields=F.coalesce(by_type, F.expr("cast(map() as map<string,array<string>>)")),
        source_media=F.coalesce("media", none("array<struct<media_order:int,media_role:string,sha256:string>>")), source_pages=F.coalesce("source_pages", none("array<int>")), verification_status=F.col("machine_verification_status"),
    )
    return j.select(F.col("processing_run_id").alias("run"), F.col("vocabulary_entry_id").alias("id"), record.alias("record"))


#: Columns of the table form, in order; fixed values.
TABLE_COLUMNS = ("id", "lemma", "language", "status", "ipa", "part_of_speech", "definition", "source_entry_id", "source_pages")


def table_rows(vocabulary: DataFrame, entries: DataFrame) -> DataFrame:
    """The flat form: lists joined by a bar between blanks."""
    j = vocabulary.join(entries.select("source_entry_id", "source_pages"), "source_entry_id", "left")
    return j.select(
        F.col("vocabulary_entry_id").alias("id"), "lemma", "language", F.col("machine_verification_status").alias("status"), "ipa", "part_of_speech", "definition", "source_entry_id",
        F.array_join(F.transform("source_pages", lambda p: p.cast("string")), " | ").alias("source_pages"))


def set_digest(rows: DataFrame, group: list[str], key: str, digest: Column, levels: int = 2) -> DataFrame:
    """One SHA-256 per group over its rows' digests in the order of their keys' hashes, as a tree.

    Leaves are the buckets of keys whose hash begins with the same ``2 * levels`` digits, 65,536 of them, so a group of 10^9
    rows has some 15,000 rows a leaf; every level above hashes the digests of at most 256 nodes in their order. No group is
    collected as a whole, and the result does not depend on partitioning or on the size of the group.
    """
    bucket = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2 * levels)
    d = rows.select(*group, bucket.alias("__b"), F.struct(F.col(key).cast("string").alias("k"), digest.alias("d")).alias("__x"), F.lit(1).cast("long").alias("__n"))
    for width in (*range(2 * levels, 0, -2), 0):
        listed = F.transform(F.array_sort(F.collect_list("__x")), lambda x: x["d"])
        d = d.groupBy(*group, F.left("__b", F.lit(width)).alias("__b")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("d"), F.sum("__n").alias("__n"))
        d = d.select(*group, "__b", F.struct(F.col("__b").alias("k"), "d").alias("__x"), "__n")
    return d.select(*group, F.col("__x.d").alias("digest"), F.col("__n").alias("n_rows"))


def next_release(releases: DataFrame, run: str, digest: str) -> int | None:
    """The version a new release gets; None if the same content was released before."""
    found = releases.where(F.col("processing_run_id") == run).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"), F.coalesce(F.max(F.col("sha256") == digest), F.lit(False)).alias("known")).first()
    return None if found["known"] else int(found["v"]) + 1
