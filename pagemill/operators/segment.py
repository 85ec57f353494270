"""Ordered lines to entries: the segmentation automaton as carried-forward values.

What a sequential reader would remember is always "the last of something", so each piece of state is a running last
non-null value. It is computed in two levels, within pages and over page summaries, so no run, however long, has
its lines or entries sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import grammar as G
from pagemill.functions.text import lines, squeezed
from pagemill.session import materialize

ORDER = ("reading_order", "block_id", "line_no")


def ordered_lines(blocks: DataFrame, text: Column | None = None) -> DataFrame:
    """``run, page_id, page_number, block_id, reading_order, line_no, line, bold_lines`` of all non-blank lines.

    ``blocks`` has ``processing_run_id, page_id, page_number, source_block_id, reading_order, raw_text, bold_lines``.
    """
    source = blocks.select(
        F.col("processing_run_id").alias("run"), "page_id", "page_number", F.col("source_block_id").alias("block_id"), F.coalesce("reading_order", F.lit(0)).alias("reading_order"),
        (F.col("raw_text") if text is None else text).alias("__text"), "bold_lines",
    )
    return source.select("run", "page_id", "page_number", "block_id", "reading_order", "bold_lines", F.posexplode(lines(F.coalesce("__text", F.lit("")))).alias("line_no", "line"))


def _page_key(*parts: Column) -> Column:
    """One string for a page of a run; null parts count as a value of their own."""
    return F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts])


def _last(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window)


def segment_lines(ordered: DataFrame, g: G.Grammar = G.BOOK) -> DataFrame:
    """The lines of ``ordered`` that belong to an entry, with ``entry_key``, the place of the entry's first line.

    A head starts an entry; headers of word lists, of preview tables and of other sections end one; preview tables,
    other sections, page numbers and decorations belong to none. In a run without any transcribed head, the first
    plain headword line of a section starts its only entry.

    One pass: within each page the state is carried for every state in which the page may begin (inside or outside the word
    lists, inside or outside a preview table), the summaries of the pages are put in a row per run, and the lines take
    what holds for their page. Lines are shuffled once, by page.
    """
    kind = G.line_class(F.col("line"), g)
    df = ordered.withColumn("kind", kind)
    df = df.withColumn("kind", F.when(F.col("kind").isin("BODY_TEXT", "PREVIEW_TABLE") & G.is_bare_head(F.col("line"), F.col("bold_lines"), g), "BARE_HEAD").otherwise(F.col("kind"))).drop("bold_lines")
    place = F.struct(F.coalesce("page_number", F.lit(2**31 - 1)).alias("p"), F.col("page_id").alias("i"), F.col("reading_order").alias("r"), F.col("block_id").alias("b"), F.col("line_no").alias("l"))
    word_list, other = F.col("kind") == "WORD_LIST_HEADER", F.col("kind") == "NON_ENTRY_SECTION_HEADER"
    marker = word_list | other
    preview, head = F.col("kind") == "PREVIEW_TABLE_HEADER", F.col("kind").isin("ENTRY_HEAD", "BARE_HEAD")
    belongs = ~F.col("kind").isin("PREVIEW_TABLE_HEADER", "PAGE_NUMBER", "DECORATION", "EMPTY")
    here = Window.partitionBy("page").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"place": place, "page": _page_key(F.col("run"), F.col("page_number"), F.col("page_id"))})
    df = df.withColumns({"out": _last(F.when(word_list, 0).when(other, 1), here), "list": _last(F.when(word_list, G.word_list_number(F.col("line"), g)), here)})
    live = lambda begins_outside: (F.coalesce("out", F.lit(begins_outside)) == 0) & ~marker
    shown = lambda o: _last(F.when(marker, 0).when(live(o) & preview, 1).when(live(o) & head, 0), here)
    df = df.withColumns({"pre0": shown(0), "pre1": shown(1)})

    def kept(o: int, begins_in_preview: Column) -> Column:
        return live(o) & (F.coalesce(f"pre{o}", begins_in_preview) == 0) & belongs

    def event(o: int, p: int) -> Column:
        """The last event so far: the end of a section, or a head."""
        ends = marker | (live(o) & preview)
        return _last(F.when(ends, F.struct(F.lit(False).alias("started"), F.col("place"))).when(kept(o, F.lit(p)) & head, F.struct(F.lit(True).alias("started"), F.col("place"))), here)

    df = df.withColumns({"ev00": event(0, 0), "ev01": event(0, 1), "ev1": event(1, 0)})
    states = ["out", "list", "pre0", "pre1", "ev00", "ev01", "ev1"]
    ending = F.struct(*[F.col(c) for c in ORDER])
    pages = df.groupBy("page").agg(
        F.first("run").alias("run"), F.first("page_number").alias("page_number"), F.first("page_id").alias("page_id"), F.max((F.col("kind") == "ENTRY_HEAD").cast("int")).alias("heads"), *[F.max_by(c, ending).alias(c) for c in states])
    earlier = Window.partitionBy("run").orderBy(F.col("page_number").asc_nulls_last(), "page_id").rowsBetween(Window.unboundedPreceding, -1)
    was_out, was_shown = F.coalesce("out_in", F.lit(0)), F.coalesce("pre_in", F.lit(0))
    chosen = F.when(was_out == 1, F.col("ev1")).when(was_shown == 1, F.col("ev01")).otherwise(F.col("ev00"))
    pages = pages.withColumns({"out_in": _last(F.col("out"), earlier), "list_in": _last(F.col("list"), earlier), "has_heads": F.max("heads").over(Window.partitionBy("run"))})
    pages = pages.withColumn("pre_in", _last(F.when(was_out == 1, F.col("pre1")).otherwise(F.col("pre0")), earlier))
    pages = pages.withColumn("ev_in", _last(chosen, earlier)).select("page", "out_in", "list_in", "pre_in", "ev_in", "has_heads")
    df = df.join(pages, "page").withColumn("event", F.coalesce(chosen, F.col("ev_in"))).withColumn("word_list", F.coalesce("list", "list_in"))
    df = df.where(F.when(was_out == 1, kept(1, was_shown)).otherwise(kept(0, was_shown)))
    columns = ["run", "page_id", "page_number", "block_id", "reading_order", "line_no", "line", "kind", "word_list", "place"]
    started = F.coalesce(F.col("event.started"), F.lit(False))
    df = materialize(df.select(*columns, "has_heads", F.when(started, F.col("event.place")).alias("entry_key"), F.when(~F.col("event.started"), F.col("event.place")).alias("section")), "segmented-lines")
    sure = df.where("entry_key IS NOT NULL").select(*columns, "entry_key", F.lit(None).cast("double").alias("plain"))
    # runs without heads only
    idle = df.where("entry_key IS NULL AND has_heads = 0")
    first = idle.where(squeezed(F.col("line")).rlike(g.one_line)).groupBy(F.col("run").alias("__r"), F.col("section").alias("__s")).agg(F.min("place").alias("first"))
    plain = idle.join(first, F.col("run").eqNullSafe(F.col("__r")) & F.col("section").eqNullSafe(F.col("__s"))).where(F.col("place") >= F.col("first"))
    return sure.unionByName(plain.select(*columns, F.col("first").alias("entry_key"), F.lit(0.80).alias("plain")))


def entries(segmented: DataFrame, g: G.Grammar = G.BOOK) -> DataFrame:
    """One row per entry: ``run, entry_order, lemma, starred, raw_text, confidence, word_list, block_ids, source_pages, cross_page``.

    Entries are numbered within their page and pages by a prefix sum of their counts, so the entries of a run are never
    sorted in one task. The text of an entry is one value of the result and is put together in one row.
    """
    line = F.struct("place", "line", "block_id", "page_number", "kind", "word_list", "plain")
    grouped = segmented.groupBy("run", "entry_key").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    first = F.col("ls")[0]
    parts = G.head_parts(first["line"], g)
    legacy = F.regexp_extract(squeezed(first["line"]), g.one_line, 1)
    found = grouped.select(
        "run", "entry_key", F.when(first["plain"].isNotNull(), legacy).otherwise(parts["lemma"]).alias("lemma"),
        F.when(first["plain"].isNotNull(), F.lit(False)).otherwise(parts["starred"]).alias("starred"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("raw_text"),
        F.coalesce(first["plain"], F.when(first["kind"] == "BARE_HEAD", 0.97).otherwise(0.98)).alias("confidence"),
        first["word_list"].alias("word_list"),
        F.array_distinct(F.transform("ls", lambda x: x["block_id"])).alias("block_ids"),
        F.array_distinct(F.filter(F.transform("ls", lambda x: x["page_number"]), lambda x: x.isNotNull())).alias("source_pages"),
    ).withColumn("cross_page", F.size("source_pages") > 1)
    # numbers come from the keys alone: one row per entry, counted by page
    keys = segmented.select("run", "entry_key").distinct().withColumn("page", _page_key(F.col("run"), F.col("entry_key.p"), F.col("entry_key.i")))
    on_page = keys.groupBy("page").agg(F.first("run").alias("run"), F.first("entry_key.p").alias("p"), F.first("entry_key.i").alias("i"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("p", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("page").orderBy("entry_key"))
    found = found.withColumn("page", _page_key(F.col("run"), F.col("entry_key.p"), F.col("entry_key.i"))).withColumn("within", within)
    return found.join(on_page.select("page", before.alias("before")), "page").select("run", (F.col("before") + F.col("within")).cast("int").alias("entry_order"), *found.columns[2:-2])


def entry_links(found: DataFrame) -> DataFrame:
    """``run, entry_order, block_order, block_id``: the bridge between entries and blocks."""
    return found.select("run", "entry_order", F.posexplode("block_ids").alias("pos", "block_id")).select("run", "entry_order", (F.col("pos") + 1).alias("block_order"), "block_id")


def page_islands(pages: DataFrame, group: str, page: str = "page_number") -> DataFrame:
    """Contiguous page numbers of a group: ``group, first_page, last_page, n_pages``."""
    distinct = pages.where(F.col(page).isNotNull()).select(group, F.col(page).alias("__p")).distinct()
    island = F.col("__p") - F.row_number().over(Window.partitionBy(group).orderBy("__p"))
    return distinct.withColumn("__i", island).groupBy(group, "__i").agg(F.min("__p").alias("first_page"), F.max("__p").alias("last_page"), F.count("*").alias("n_pages")).drop("__i")
