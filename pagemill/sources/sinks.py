"""Sinks: canonical JSON lines, CSV, workbooks, content-addressed files, snapshots with a manifest."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(records: DataFrame, path: str, key: str = "id", record: str = "record") -> None:
    """One canonical record a line, range-partitioned by key: files in order, order within files."""
    records.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(F.col(record).alias("value")).write.mode("errorifexists").text(path)


def write_csv(rows: DataFrame, path: str, key: str = "id") -> None:
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def workbook(rows: DataFrame, most_rows: int = 1_000_000) -> bytes:
    """A workbook of one sheet with the same bytes for the same rows; for tables within a sheet's own limit only."""
    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError("more rows than a sheet holds")
    cells = lambda values: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values)
    body = io.StringIO()
    body.write(f"<row>{cells(rows.columns)}</row>")
    for r in rows.toLocalIterator():
        body.write(f"<row>{cells(r)}</row>")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body.getvalue()}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + parts[name])
    return out.getvalue()


def put_artifact(spark: SparkSession, folder: str, content: bytes, suffix: str) -> tuple[str, str]:
    """Writes ``content`` under its own hash; the same content twice is one file, other content under the name an error."""
    digest = hashlib.sha256(content).hexdigest()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{digest[:2]}/{digest}.{suffix}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        found = spark.read.format("binaryFile").load(path.toString()).select(F.sha2("content", 256)).first()[0]
        if found != digest:
            raise ValueError(f"{path} holds other content")
    else:
        stream = fs.create(path, False)
        stream.write(bytearray(content))
        stream.close()
    return digest, path.toString()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``key, byte_size, sha256`` of every file of a folder; the key is the path below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index("path", re.sub(r"^\w+:/*", "/", path).rstrip("/") + "/", -1)
    return files.select(below.alias("key"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def snapshot(df: DataFrame, path: str) -> None:
    """The table and beside it a manifest of its files."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    manifest(df.sparkSession, f"{path}/data").write.parquet(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The table of a snapshot; an error if any file differs from the manifest, is missing or is new."""
    expected, found = spark.read.parquet(f"{path}/manifest"), manifest(spark, f"{path}/data")
    if not expected.exceptAll(found).isEmpty() or not found.exceptAll(expected).isEmpty():
        raise ValueError(f"the files of {path} differ from their manifest")
    return spark.read.parquet(f"{path}/data")


def metric_lines(counts: DataFrame, metric: str, labels: list[str], value: str = "n") -> DataFrame:
    """Counts as lines of the text exposition format."""
    from pagemill.functions.text import label_escaped

    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), label_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels])
    return counts.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
