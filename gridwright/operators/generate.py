"""Deterministic synthetic data: random edit logs and styled HTML, from seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDITS, let
from . import render

#: The six actions of a random log.
ACTIONS = ["edit", "remove_row", "remove_col", "add_row", "add_col", "merge"]


def draw(n: Column | int, seed: int, *keys: Column | str) -> Column:
    """A number 0 .. n-1 that depends on the seed and the keys alone."""
    n = F.lit(n) if isinstance(n, int) else n
    key = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.greatest(n.cast("long"), F.lit(1)))


def random_edits(spark: SparkSession, dims: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` instructions over tables ``dims`` (tableIndex from 1, fileName, rows, cols).

    Indexes are drawn against the tables as they are, not as edited; rows from 1
    to rows-1 (0 in a single row), amounts 1 to 3 rows or 1 to 2 columns.
    """
    count = dims.count()
    if not count:
        return spark.createDataFrame([], EDITS)
    ops = spark.range(n).select(F.col("id").alias("seq"), (draw(count, seed, F.col("id"), F.lit("t")) + 1).alias("tableIndex"))
    df = ops.join(dims.withColumn("tableIndex", F.col("tableIndex").cast("long")), "tableIndex")
    d = lambda size, tag: draw(size, seed, F.col("seq"), F.lit(tag))
    row = F.when(F.col("rows") > 1, d(F.col("rows") - 1, "r") + 1).otherwise(0)
    col = d(F.col("cols"), "c")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), d(len(ACTIONS), "a").cast("int") + 1)
    number = d(100000, "v").cast("string")
    letters = F.substring(F.translate(F.md5(F.col("seq").cast("string")), "0123456789", "ghijklmnop"), 1, 6)
    value = F.when(d(10, "n") < 2, F.lit(None)).when(d(3, "k") == 0, number).when(d(3, "k") == 1, F.concat(number, F.lit("."), d(100, "f").cast("string"))).otherwise(letters)
    is_edit, is_row = F.col("action") == "edit", F.col("action").endswith("_row")
    most = F.when(is_row, F.least(F.lit(3), F.col("rows"))).otherwise(F.least(F.lit(2), F.col("cols")))
    by_row = d(2, "m") == 0
    index = F.when(F.col("action") == "merge", F.when(by_row, d(F.greatest(F.col("rows") - 1, F.lit(1)), "i")).otherwise(d(F.greatest(F.col("cols") - 1, F.lit(1)), "i"))).when(is_row, row).otherwise(col)
    df = df.withColumn("action", action)
    details = F.struct(
        F.when(is_edit, row).cast("long").alias("row"), F.when(is_edit, col).cast("long").alias("col"), F.lit(None).cast("string").alias("oldVal"), F.when(is_edit, value).alias("newVal"),
        F.when(~is_edit, index).cast("long").alias("index"), F.when(~is_edit & (F.col("action") != "merge"), d(most, "q") + 1).cast("long").alias("amount"), F.when(F.col("action") == "merge", by_row).alias("isRow"),
    )
    return df.select("seq", "fileName", "tableIndex", "action", F.lit(None).cast("string").alias("range"), details.alias("details"))


def random_logs(spark: SparkSession, dims: DataFrame, logs: int = 50, each: int = 50, seed: int = 0) -> DataFrame:
    """``logs`` lists of ``each`` instructions: those of ``random_edits``, with log and a seq that begins anew."""
    log, seq = F.floor(F.col("seq") / each), F.col("seq") % each
    return random_edits(spark, dims, logs * each, seed).withColumns({"log": log, "seq": seq})


def random_html(grids: DataFrame, seed: int = 0, name_col: str = "doc_id") -> DataFrame:
    """``grids`` with html, drawn by name and seed: look, line ends, glue and spare columns, widths, rules."""
    d = lambda n, tag: draw(n, seed, F.col(name_col), F.lit(tag))
    made = F.col("grid")
    made = F.when(d(2, "glue") == 0, F.transform(made, lambda r: render.glue_columns(r, (d(3, "g") + 2).cast("int")))).otherwise(made)
    for k in range(2):  # none, one or two spare columns
        made = let(made, lambda g, k=k: F.when(d(3, "s") > k, F.transform(g, lambda r: render.spare_column(r, d(F.size(r) + 1, f"p{k}").cast("int")))).otherwise(g))
    look, lines = d(len(render.LOOKS), "l").cast("int"), d(3, "n").cast("int")
    return grids.withColumn("html", render.table_html(made, F.col(name_col), look, widths=d(2, "w") == 0, lines=lines, rules=d(2, "z") == 0))


def split_cells(grid: Column) -> Column:
    """A grid as filings show it: currency, percent and closing signs in cells of their own, an empty spacer column.

    Each value cell becomes three: sign, number, closing sign; the label stays.
    """

    def three(v: Column) -> Column:
        negative = v.startswith("(")
        close = F.when(negative, ")").when(v.endswith("%"), "%").otherwise("")
        body = F.regexp_replace(v, r"[)%]$", "")
        return F.array(F.when(v.rlike(r"^\(?[0-9]"), F.lit("$")).otherwise(""), body, close)

    spacer = lambda r: F.concat(F.slice(r, 1, 1), F.array(F.lit("")), F.flatten(F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), three)))
    return F.transform(grid, spacer)


