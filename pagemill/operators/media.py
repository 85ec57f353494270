"""Regions on a page and the text around them: nearest neighbours, bands, overlaps, and the entry a picture belongs to.

Everything is a join on the page with range predicates and one aggregation per region; no page is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerance of rules, least area of a full page, share of the shorter block that side-by-side blocks overlap; fixed values.
EPSILON, FULL_PAGE, SIDE_BY_SIDE = 0.002, 0.85, 0.5
IGNORED_KINDS = ("PAGE_NUMBER", "DECORATION", "EMPTY")


def neighbours(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each region with its nearest block above and below on the page and the number of blocks it overlaps.

    ``regions``: ``page_id, region_id, x1, y1, x2, y2``; ``blocks``: ``page_id, block_id, x1, y1, x2, y2``. A block is above or below
    by its middle. Equal distances are settled by the id.
    """
    r = regions.select("page_id", "region_id", *[F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")])
    b = blocks.select("page_id", "block_id", "x1", "y1", "x2", "y2")
    j = r.join(b, "page_id", "left").withColumn("middle", (F.col("y1") + F.col("y2")) / 2)
    above, below = F.col("middle") < F.col("ry1"), F.col("middle") > F.col("ry2")
    overlaps = ~above & ~below & (F.col("x1") < F.col("rx2")) & (F.col("x2") > F.col("rx1"))
    return j.groupBy("page_id", "region_id").agg(
        F.max_by("block_id", F.when(above, F.struct("y2", "block_id"))).alias("above_id"), F.min_by("block_id", F.when(below, F.struct("y1", "block_id"))).alias("below_id"), F.count_if(overlaps).alias("n_overlapping"))


def rule_between(separators: Column, upper: Column, lower: Column) -> Column:
    """A horizontal rule lies between two heights, within the tolerance."""
    return F.exists(F.coalesce(separators, F.expr("cast(array() as array<double>)")), lambda r: (r >= upper - EPSILON) & (r <= lower + EPSILON))


def side_by_side_pages(blocks: DataFrame) -> DataFrame:
    """Pages on which two blocks stand next to each other: apart in x, overlapping in y by over half of the shorter.

    Blocks meet in horizontal bands; only bands with blocks apart in x give pairs.
    """
    b = blocks.where("y2 > y1").select("page_id", "block_id", "x1", "y1", "x2", "y2")
    bands = b.withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") * 50), F.floor(F.col("y2") * 50))))
    apart = bands.groupBy("page_id", "band").agg(F.min("x2").alias("least"), F.max("x1").alias("most")).where("least <= most").select("page_id", "band")
    some = bands.join(apart, ["page_id", "band"], "left_semi")
    left = some.select("page_id", "band", *[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")])
    both = left.join(some, ["page_id", "band"]).where("lx2 <= x1")
    overlap = F.least("ly2", "y2") - F.greatest("ly1", "y1")
    shorter = F.least(F.col("ly2") - F.col("ly1"), F.col("y2") - F.col("y1"))
    return both.where(overlap > SIDE_BY_SIDE * shorter).select("page_id").distinct()


def last_entry_of_previous_page(pages: DataFrame) -> DataFrame:
    """``document, page_number, previous_entry``: the last entry of exactly the page before; a gap gives none.

    ``pages``: ``document, page_number, entry_id, entry_order``.
    """
    last = pages.groupBy("document", "page_number").agg(F.max_by("entry_id", "entry_order").alias("last_entry"))
    before = last.select("document", (F.col("page_number") + 1).alias("page_number"), F.col("last_entry").alias("previous_entry"))
    return last.join(before, ["document", "page_number"], "left").select("document", "page_number", "last_entry", "previous_entry")


def associate(media: DataFrame, blocks: DataFrame) -> DataFrame:
    """The entry each picture belongs to, or why none is decided.

    ``media``: ``media_id, page_id, bbox, separators array<double>, previous_entry, previous_order``. ``blocks``: ``page_id, block_id,
    x1, y1, x2, y2, kinds array<string>, starts_entry boolean, entry_ids array<string>, entry_orders array<int>``.
    Result: ``media_id, role, entry_id, confidence, status, reason, warnings, candidates``.
    """
    real = blocks.where(F.size(F.array_except("kinds", F.array(*[F.lit(k) for k in IGNORED_KINDS]))) > 0)
    m = media.select("media_id", "page_id", "separators", "previous_entry", "previous_order", *[F.col(f"bbox.{c}").cast("double").alias(f"m{c}") for c in ("x1", "y1", "x2", "y2")])
    block = F.struct("y1", "y2", "starts_entry", "entry_ids", "entry_orders")
    j = m.join(real, "page_id", "left").withColumn("middle", (F.col("y1") + F.col("y2")) / 2)
    above, below = F.col("middle") < F.col("my1"), F.col("middle") > F.col("my2")
    has_entry = F.size(F.coalesce("entry_ids", F.expr("cast(array() as array<string>)"))) > 0
    overlaps = ~above & ~below & (F.col("x1") < F.col("mx2")) & (F.col("x2") > F.col("mx1"))
    near = j.groupBy("media_id", "page_id", "separators", "previous_entry", "previous_order", "mx1", "my1", "mx2", "my2").agg(
        F.max_by(block, F.when(above & has_entry, F.struct("y2", "block_id"))).alias("a"), F.min_by(block, F.when(below, F.struct("y1", "block_id"))).alias("b"),
        F.count_if(overlaps).alias("n_over"), F.count_if(above & F.array_contains("kinds", "WORD_LIST_HEADER")).alias("n_headers"))
    columns = side_by_side_pages(real.where(has_entry)).withColumn("__columns", F.lit(True))
    d = near.join(columns, "page_id", "left")
    has_b, starts = F.col("b").isNotNull(), F.coalesce(F.col("b.starts_entry"), F.lit(False))
    b_first, b_order = F.get("b.entry_ids", F.lit(0)), F.get("b.entry_orders", F.lit(0))
    continues = has_b & b_first.isNotNull() & ~starts
    top = F.col("a").isNull() & ~continues
    owner = F.when(F.col("a").isNotNull(), F.element_at("a.entry_ids", -1)).when(continues, b_first).otherwise(F.col("previous_entry"))
    owner_order = F.when(F.col("a").isNotNull(), F.element_at("a.entry_orders", -1)).when(continues, b_order).otherwise(F.col("previous_order"))
    d = d.withColumns({"owner": owner, "owner_order": owner_order})
    rule = lambda upper, lower: rule_between(F.col("separators"), upper, lower)
    w = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    other = has_b & b_first.isNotNull() & ~starts & ~F.col("owner").eqNullSafe(b_first)
    warnings = F.array_compact(F.array(
        w("text_overlaps_media", F.col("n_over") > 0), w("no_separator_rules_on_page", F.size(F.coalesce("separators", F.expr("cast(array() as array<double>)"))) == 0), w("multi_column_layout", F.col("__columns")),
        w("separator_between_entry_text_and_media", F.col("a").isNotNull() & rule(F.col("a.y2"), F.col("my1"))),
        w("separator_above_media_at_page_top", top & rule(F.lit(0.0), F.col("my1"))), w("no_preceding_entry", top & F.col("owner").isNull()),
        w("no_separator_before_next_entry", has_b & starts & ~rule(F.col("my2"), F.col("b.y1"))),
        w("owner_is_not_the_entry_preceding_next_headword", has_b & starts & F.col("owner").isNotNull() & b_first.isNotNull() & (F.coalesce(b_order, F.lit(0)) - F.coalesce("owner_order", F.lit(0)) != 1)),
        w("media_between_different_entries", other), w("separator_inside_entry", continues & rule(F.col("my2"), F.col("b.y1"))), w("non_entry_text_below_media", has_b & ~starts & b_first.isNull()),
    ))
    follower = F.when(has_b & starts, b_first).when(other, b_first)
    candidates = F.array_distinct(F.array_compact(F.array(F.col("owner"), follower)))
    full = (F.col("mx2") - F.col("mx1")) * (F.col("my2") - F.col("my1")) >= FULL_PAGE
    header = F.col("a").isNull() & (F.col("n_headers") > 0)
    bound = (F.size("warnings") == 0) & F.col("owner").isNotNull()
    pick = lambda f, h, b, o, n: F.when(full, f).when(header, h).when(bound, b).when(F.col("owner").isNotNull(), o).otherwise(n)
    none = F.expr("cast(array() as array<string>)")
    d = d.withColumns({"warnings": warnings, "candidates": candidates})
    return d.select(
        "media_id", pick(F.lit("NON_VOCABULARY"), F.lit("NON_VOCABULARY"), F.lit("ENTRY_ILLUSTRATION"), F.lit("UNRESOLVED"), F.lit("UNRESOLVED")).alias("role"),
        F.when(~full & ~header & bound, F.col("owner")).alias("entry_id"), pick(F.lit(1.0), F.lit(0.99), F.lit(0.98), F.lit(0.5), F.lit(0.0)).alias("confidence"),
        pick(F.lit("AUTO_VERIFIED"), F.lit("AUTO_VERIFIED"), F.lit("AUTO_VERIFIED"), F.lit("REVIEW_REQUIRED"), F.lit("REVIEW_REQUIRED")).alias("status"),
        pick(F.lit("FULL_PAGE_IMAGE"), F.lit("WORD_LIST_HEADER_RESOURCE"), F.lit("ENTRY_BAND"), F.lit("LAYOUT_SIGNALS_DISAGREE"), F.lit("NO_ENTRY_CONTEXT")).alias("reason"),
        F.when(full | header, none).otherwise(F.col("warnings")).alias("warnings"), F.when(full | header, none).otherwise(F.col("candidates")).alias("candidates"))


def reading_rank(media: DataFrame) -> DataFrame:
    """``media_order`` of the pictures of a page: from top to bottom, then left to right, rounded to two digits."""
    order = Window.partitionBy("page_id").orderBy(F.round("y1", 2), F.round("x1", 2), "media_id")
    return media.withColumn("media_order", F.row_number().over(order))


def rules_of(lines: DataFrame) -> DataFrame:
    """Horizontal rules of each page: wider than half of it and thinner than three points; distinct heights, sorted."""
    wide = (F.col("x2") - F.col("x1") > 0.5 * F.col("page_width")) & (F.col("y2") - F.col("y1") < 3)
    return lines.groupBy("page_id").agg(F.array_sort(F.collect_set(F.when(wide, F.round((F.col("y1") + F.col("y2")) / 2 / F.col("page_height"), 4)))).alias("separators"))
