"""Tables of a run: idempotent writes, routing of pages, page layouts, nested page documents, audit queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import grammar as G
from pagemill.functions import text as X


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys ``existing`` does not have; repeated new keys once."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def replace_runs(df: DataFrame, path: str, sealed: DataFrame | None = None, run: str = "processing_run_id") -> None:
    """Writes the partitions of the runs in ``df`` anew and leaves all other runs alone; sealed runs are not touched."""
    kept = df if sealed is None else df.join(sealed.select(run), run, "left_anti")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def pages_to_recognise(pages: DataFrame, native: DataFrame, least_chars: int = 20) -> DataFrame:
    """Pages whose native text is too short or missing."""
    rich = native.groupBy("page_id").agg(F.sum(F.length(X.stripped(F.coalesce("raw_text", F.lit(""))))).alias("n")).where(F.col("n") >= least_chars)
    return pages.join(rich, "page_id", "left_anti")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Both have the same rows, each as often."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def outside(rows: DataFrame, values: str, allowed: DataFrame, allowed_value: str, key: str) -> DataFrame:
    """Keys whose array has values that are not allowed, with those values: the ones that are no subset."""
    found = rows.select(key, F.explode(values).alias("v")).join(allowed.select(F.col(allowed_value).alias("v")).distinct(), "v", "left_anti")
    return found.groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("outside"))


def page_layout(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, block_id, x1, y1, x2, y2, kinds, starts_entry, entry_ids, entry_orders``: what media association needs.

    Blocks without lines are left out; a block starts an entry if it is the entry's first.
    """
    links = entries.select("source_entry_id", "entry_order", F.posexplode("block_ids").alias("pos", "source_block_id"))
    owned = links.groupBy("source_block_id").agg(F.array_sort(F.collect_list(F.struct("entry_order", "source_entry_id", "pos"))).alias("es"))
    kinds = F.array_distinct(F.transform(X.lines(F.coalesce("raw_text", F.lit(""))), lambda x: G.line_class(x)))
    b = blocks.withColumn("kinds", kinds).where(F.size("kinds") > 0).join(owned, "source_block_id", "left")
    es = F.coalesce("es", F.expr("cast(array() as array<struct<entry_order:int,source_entry_id:string,pos:int>>)"))
    return b.select(
        "page_id", F.col("source_block_id").alias("block_id"), "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "kinds", F.exists(es, lambda e: e["pos"] == 0).alias("starts_entry"),
        F.transform(es, lambda e: e["source_entry_id"]).alias("entry_ids"), F.transform(es, lambda e: e["entry_order"]).alias("entry_orders"))


def review_flags(blocks: Column, entries: Column) -> Column:
    """What a reviewer should look at on a page: no blocks, unsure blocks, unsure or crossing entries, entries without text."""
    flag = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(
        flag("no_blocks", F.size(blocks) == 0), flag("low_confidence_block", F.exists(blocks, lambda b: F.coalesce(b["confidence"], F.lit(0.0)) < 0.85)), flag("no_entries", F.size(entries) == 0),
        flag("low_confidence_entry", F.exists(entries, lambda e: F.coalesce(e["segmentation_confidence"], F.lit(0.0)) < 0.85)), flag("cross_page_entry", F.exists(entries, lambda e: F.size(e["source_pages"]) > 1)),
    ))


def page_documents(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """One nested document per page of a version: its blocks and entries in order, and what to review."""
    b = blocks.groupBy("document_version_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "source_block_id", "raw_text", "confidence"))).alias("blocks"))
    e = entries.select("document_version_id", F.explode("source_pages").alias("page_number"), F.struct("entry_order", "source_entry_id", "lemma", "segmentation_confidence", "source_pages").alias("e"))
    e = e.groupBy("document_version_id", "page_number").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    both = b.join(e, ["document_version_id", "page_number"], "full_outer")
    none = lambda c: F.coalesce(F.col(c), F.expr(f"cast(array() as {both.schema[c].dataType.simpleString()})"))
    both = both.withColumn("blocks", none("blocks")).withColumn("entries", none("entries"))
    return both.withColumn("flags", review_flags(F.col("blocks"), F.col("entries")))


def audit_queue(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Everything of a book that a person should see: ``kind, row_id, pages, reason, excerpt``."""
    low = blocks.where("source_engine <> 'pymupdf-native' AND coalesce(confidence, 0) < 0.85").select(
        F.lit("block").alias("kind"), F.col("source_block_id").alias("row_id"), F.array("page_number").alias("pages"), F.lit("low_confidence").alias("reason"), X.excerpt(F.coalesce("raw_text", F.lit(""))).alias("excerpt"))
    crossing = entries.where("size(source_pages) > 1").select(F.lit("entry").alias("kind"), F.col("source_entry_id").alias("row_id"), F.col("source_pages").alias("pages"), F.lit("cross_page").alias("reason"), X.excerpt(F.col("raw_text")).alias("excerpt"))
    headless = entries.where(G.head_parts(F.get(X.lines(F.coalesce("raw_text", F.lit(""))), F.lit(0))).isNull()).select(F.lit("entry").alias("kind"), F.col("source_entry_id").alias("row_id"), F.col("source_pages").alias("pages"), F.lit("no_headword").alias("reason"), X.excerpt(F.coalesce("raw_text", F.lit(""))).alias("excerpt"))
    return low.unionByName(crossing).unionByName(headless)
