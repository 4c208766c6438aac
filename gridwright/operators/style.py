"""Style-aware extraction: emphasis, indentation levels, footnote continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import rows as R
from ..model import at, let, upto, width
from .clean import drop_empty_cols, drop_empty_rows, fill


def styled_text(cell: Column, markdown: bool = True) -> Column:
    """Text of a styled cell struct: tightened, case applied, with stars in Markdown."""
    text = C.digit_commas(C.tighten_paren(cell["text"]))
    text = C.clean_space(text)
    cased = C.transform_text(text, cell["transform"])
    return F.when(cell["plain"], text).otherwise(C.emphasise(cased, cell["bold"], cell["italic"]) if markdown else cased)


def indent_levels(points: Column) -> Column:
    """Rank of each indent among the distinct ones of a column, from 0; all 0 if they are alike."""
    known = F.array_sort(F.array_distinct(F.filter(points, lambda p: p.isNotNull())))
    return let(known, lambda k: F.transform(points, lambda p: F.when(p.isNull() | (F.size(k) < 2), 0).otherwise(F.array_position(k, p).cast("int") - 1)))


def level_prefix(level: Column, markdown: bool = True) -> Column:
    return F.repeat(F.lit("&nbsp;&nbsp;" if markdown else " "), level * 2)


def column_levels(points: Column) -> Column:
    """Levels of a grid of indents (null: no say), column by column, as a grid."""

    def levels(columns: Column) -> Column:
        return F.transform(points, lambda row, i: F.transform(row, lambda p, j: F.get(F.get(columns, j), i)))

    by_column = F.transform(upto(width(points)), lambda j: indent_levels(F.transform(points, lambda r: F.get(r, j))))
    return let(by_column, levels)


def styled_grids(tables: DataFrame, output: str = "markdown") -> DataFrame:
    """(doc_id, tid, grid) from html_tables' styled cells: one text grid a table.

    Spanning cells repeat over their columns and their rows don't decide whether
    a column is empty; indents become levels; glue rules mind the stars.
    """
    md = output == "markdown"
    styled = F.col("styled")
    ones = F.transform(styled, lambda r: F.flatten(F.transform(r, lambda c: F.array_repeat(styled_text(c, md), F.when(c["plain"], 1).otherwise(F.greatest(c["colspan"], F.lit(1)))))))
    dents = F.transform(styled, lambda r: F.flatten(F.transform(r, lambda c: F.array_repeat(F.when(~c["plain"] & (c["text"] != ""), c["indent"]), F.when(c["plain"], 1).otherwise(F.greatest(c["colspan"], F.lit(1)))))))
    df = tables.select("doc_id", "tid", ones.alias("grid"), dents.alias("dents"), F.transform(styled, lambda r: ~F.exists(r, lambda c: ~c["plain"] & (c["colspan"] > 1))).alias("judged"))
    df = df.withColumn("levels", column_levels(F.col("dents")))
    df = df.withColumn("grid", fill(F.zip_with("grid", "levels", lambda r, l: F.zip_with(r, l, lambda v, n: F.concat(level_prefix(F.coalesce(n, F.lit(0)), md), v)))))
    df = _without_empty(df)
    df = df.withColumn("grid", F.transform("grid", R.glue_emphasis))
    return _without_empty(df).select("doc_id", "tid", "grid")


def _without_empty(df: DataFrame) -> DataFrame:
    any_judged = F.exists("judged", lambda x: x)
    df = df.withColumn("grid", F.when(any_judged, drop_empty_cols(F.col("grid"), judged=F.col("judged"))).otherwise(F.col("grid")))
    df = df.withColumn("judged", F.filter(F.zip_with("grid", "judged", lambda r, ok: F.when(F.exists(r, lambda v: v != ""), ok)), lambda x: x.isNotNull()))
    return df.withColumn("grid", drop_empty_rows(F.col("grid")))


def join_footnotes(grids: DataFrame) -> DataFrame:
    """One-row tables that begin with ``(x)`` become rows of the table before."""
    note = (F.size("grid") == 1) & F.regexp_replace(at(F.get(F.col("grid"), 0), 0), r"[*\s]|&nbsp;", "").rlike(r"^\(.\)")
    along = Window.partitionBy("doc_id").orderBy("tid").rowsBetween(Window.unboundedPreceding, 0)
    df = grids.withColumn("_group", F.sum(F.when(note, 0).otherwise(1)).over(along))
    ordered = F.array_sort(F.collect_list(F.struct("tid", "grid")))
    return df.groupBy("doc_id", "_group").agg(F.min("tid").alias("tid"), F.flatten(F.transform(ordered, lambda x: x["grid"])).alias("grid")).drop("_group")
