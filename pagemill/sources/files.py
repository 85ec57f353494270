"""Sources: JSON folders, binary files, recogniser output, and plug-ins for page decoders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import clamped, number, whole_number


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON documents of a folder with their file names; a document that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def binary_artifacts(spark: SparkSession, path: str, most_bytes: int, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` files with ``path, byte_size, sha256``; larger ones than ``most_bytes`` are rejected unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    accepted = files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")
    return accepted, files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("byte_size"))


def page_policy(pages: DataFrame, most_pages: int, most_pixels: float) -> DataFrame:
    """``document, accepted, reason`` from ``document, encrypted, width, height`` per page: encryption, number and size of pages."""
    g = pages.groupBy("document").agg(F.count("width").alias("n"), F.max("encrypted").alias("e"), F.max(F.col("width") * F.col("height")).alias("px"), F.count_if(F.isnan("width") | F.isnan("height")).alias("bad"))
    reason = F.when(F.col("e"), "encrypted").when(F.col("n") == 0, "no_pages").when(F.col("n") > most_pages, "too_many_pages").when((F.col("bad") > 0) | (F.col("px") > most_pixels), "page_too_large")
    return g.select("document", reason.isNull().alias("accepted"), reason.alias("reason"))


def decode_pages(artifacts: DataFrame, decoder: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Pages of binary artifacts by a plug-in: bytes to a list of rows (page_number, blocks, ...) of ``schema``."""

    def run(batches):
        for b in batches:
            rows = [{"sha256": s, **row} for s, content in zip(b["sha256"], b["content"]) for row in decoder(bytes(content))]
            yield pd.DataFrame(rows)

    return artifacts.select("sha256", "content").mapInPandas(run, f"sha256 string, {schema}")


TSV = "level string, page_num string, block_num string, par_num string, line_num string, word_num string, left string, top string, width string, height string, conf string, text string"


def recognised_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Lines from a recogniser's word table (columns of ``TSV`` as strings, plus the page keys).

    Words of level 5 with text and a confidence of 0 or more; text in word order, box by extremes over the page's size
    (of its level-1 row, else the greatest extent), confidence the mean over 100.
    """
    n = lambda c: whole_number(F.col(c))
    w = words.select(*page, *[n(c).alias(c) for c in ("level", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")], number(F.col("conf")).alias("conf"), "text")
    size = w.groupBy(*page).agg(
        F.coalesce(F.max(F.when(F.col("level") == 1, F.col("width"))), F.max(F.col("left") + F.col("width"))).alias("pw"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("height"))), F.max(F.col("top") + F.col("height"))).alias("ph"))
    real = w.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    lines = real.groupBy(*page, "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.min("left").alias("l"), F.min("top").alias("t"),
        F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"), (F.avg("conf") / 100).alias("confidence"))
    j = lines.join(size, page)
    edge = lambda v, whole: clamped(F.try_divide(F.col(v), F.col(whole)))
    box = F.struct(edge("l", "pw").alias("x1"), edge("t", "ph").alias("y1"), edge("r", "pw").alias("x2"), edge("b", "ph").alias("y2"), F.lit("normalized").alias("unit"))
    return j.select(*page, "block_num", "par_num", "line_num", "text", box.alias("bbox"), "confidence")


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """The box around ``array<struct<x, y>>``, normalised."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(clamped(F.array_min(xs) / width).alias("x1"), clamped(F.array_min(ys) / height).alias("y1"), clamped(F.array_max(xs) / width).alias("x2"), clamped(F.array_max(ys) / height).alias("y2"), F.lit("normalized").alias("unit"))


def native_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of a page's raw text blocks: order index by place (empty blocks keep theirs but are left out), box clamped.

    ``pages``: ``page_id, width, height, raw array<struct<x0, y0, x1, y1, text>>``.
    """
    b = pages.select("page_id", "width", "height", F.posexplode("raw").alias("reading_order", "b"))
    box = F.struct(clamped(F.col("b.x0") / F.col("width")).alias("x1"), clamped(F.col("b.y0") / F.col("height")).alias("y1"), clamped(F.col("b.x1") / F.col("width")).alias("x2"), clamped(F.col("b.y1") / F.col("height")).alias("y2"), F.lit("normalized").alias("unit"))
    return b.where(F.trim(F.col("b.text")) != "").select("page_id", "reading_order", F.col("b.text").alias("text"), box.alias("bbox"), F.lit(1.0).alias("confidence"))


def bold_lines(spans: Column) -> Column:
    """Texts of lines all of whose non-blank spans are bold, by font name or flag 16. ``array<array<struct<text, font, flags>>>``."""
    solid = lambda line: F.filter(line, lambda s: F.trim(s["text"]) != "")
    bold = lambda s: F.lower(s["font"]).contains("bold") | (s["flags"].bitwiseAND(16) != 0)
    kept = F.filter(spans, lambda line: (F.size(solid(line)) > 0) & F.forall(solid(line), bold))
    return F.transform(kept, lambda line: F.trim(F.regexp_replace(F.array_join(F.transform(line, lambda s: s["text"]), ""), r"(?U)\s+", " ")))


def block_bold_lines(text: Column, page_bold: Column) -> Column:
    """The lines of a block that are bold on its page, in order, repeated ones too."""
    from pagemill.functions.text import lines, squeezed

    return F.filter(F.transform(lines(text), squeezed), lambda x: F.array_contains(page_bold, x))
