"""Files: filings, ragged CSV, edit logs."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..model import EDITS, GRID


def decode_bytes(data: bytes) -> str:
    """UTF-8 or UTF-16 by their marks, plain UTF-8, otherwise Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def decoded(df: DataFrame, content_col: str = "content", to: str = "html") -> DataFrame:
    """``df`` with bytes turned into text; valid UTF-8 stays in the JVM's fast path."""
    schema = df.drop(content_col).withColumn(to, F.lit("")).schema
    at = df.columns.index(content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c for k, c in enumerate(batch.columns) if k != at]
            text = pa.array([None if b is None else decode_bytes(b) for b in batch.column(at).to_pylist()], pa.string())
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, text], names=[*names, to])

    return df.mapInArrow(run, schema)


def _folder(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    """Files of a folder as binaryFile rows; folder names are never read as partitions."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if recursive or "*" in path:
        return raw
    folder, root = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), path.split(":", 1)[-1].rstrip("/")
    return raw.where(folder.endswith(root) | F.col("path").endswith(root))


def read_filings(spark: SparkSession, path: str, glob: str = "*.htm*", recursive: bool = False) -> DataFrame:
    """(doc_id, html): one row a file, the encoding found out."""
    raw = _folder(spark, path, glob, recursive)
    return decoded(raw.select(F.col("path").alias("doc_id"), "content"))


def list_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path) of the CSV files below a folder, sorted."""
    return _folder(spark, path, "*.csv", recursive).select("path").orderBy("path")


def count_csv(spark: SparkSession, path: str) -> int:
    return list_csv(spark, path).count()


def parse_csv(text: str | None) -> list[list[str]]:
    """Records of a CSV text, ragged as they are; lines without a field don't count."""
    return [r for r in csv.reader(io.StringIO(text or "", newline="")) if r]


def csv_grids(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, grid) of whole CSV texts, all cells strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = pa.array([parse_csv(t) for t in batch.column(1).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.record_batch([batch.column(0), grids], names=["doc_id", "grid"])

    return texts.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id string, grid {GRID}")


def read_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(doc_id, grid): every CSV below ``path`` as strings, the first line an ordinary row."""
    raw = _folder(spark, path, "*.csv", recursive)
    return csv_grids(decoded(raw.select("path", "content"), to="text"))


def with_header(grids: DataFrame) -> DataFrame:
    """The first row as header; names stay positional and may repeat."""
    rows = F.size("grid")
    body = F.when(rows > 1, F.slice("grid", F.lit(2), rows)).otherwise(F.array().cast(GRID))
    return grids.withColumn("header", F.coalesce(F.get("grid", F.lit(0)), F.array().cast("array<string>"))).withColumn("grid", body)


@udtf(returnType="row int, col int, value string")
class CsvCells:
    """SQL: ``FROM files, LATERAL csv_cells(text)``."""

    def eval(self, text: str):
        for r, record in enumerate(parse_csv(text)):
            for c, value in enumerate(record):
                yield r, c, value


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edit instructions of JSON logs with their file and place; ``details`` that is no object stays in details_text."""
    text = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path).withColumn("log", F.col("_metadata.file_path"))
    item = "array<struct<fileName:string,tableIndex:bigint,action:string,range:string,details:string>>"
    rows = text.select("log", F.posexplode(F.from_json("value", item)).alias("seq", "x"))
    details = EDITS.split("details ", 1)[1]
    return rows.select("log", F.col("seq").cast("long").alias("seq"), "x.fileName", "x.tableIndex", "x.action", "x.range", F.from_json("x.details", details).alias("details"), F.when(~F.coalesce(F.col("x.details"), F.lit("{")).startswith("{"), F.col("x.details")).alias("details_text"))


def resolve_files(names: DataFrame, paths: DataFrame) -> DataFrame:
    """(fileName, path): the file of that name, else the first by path whose name starts with its stem.

    Names are few, but paths may be many: candidates meet on the first
    characters of the stem, not all with all.
    """
    base = F.substring_index("path", "/", -1)
    files = paths.select("path", base.alias("base"))
    want = names.select("fileName").distinct().withColumn("stem", F.regexp_replace("fileName", r"\.csv$", "")).where(F.length("stem") > 0)
    exact = want.join(files, want.fileName == files.base).select("fileName", "path", F.lit(0).alias("kind"))
    lengths = F.explode(F.sequence(F.lit(1), F.length("base")))
    loose = files.where(F.col("base").endswith(".csv")).withColumn("n", lengths).withColumn("stem", F.expr("left(base, n)"))
    near = want.join(loose, "stem").select("fileName", "path", F.lit(1).alias("kind"))
    best = F.row_number().over(Window.partitionBy("fileName").orderBy("kind", "path"))
    return exact.union(near).withColumn("k", best).where("k = 1").select("fileName", "path")


def log_folder(path: Column) -> Column:
    """The last _ token of a log's stem: the folder its results go to."""
    return F.regexp_extract(path, r"([^_/]*)\.json$", 1)
