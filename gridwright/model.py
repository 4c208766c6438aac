"""Shapes of the data and conversions between them.

A table is one row ``(doc_id, tid, grid)``: rows of string cells, never typed by
guess.  All rules work inside that row, so cleaning never shuffles.  ``cells`` is
the exploded form for relational questions, ``rows`` lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = "array<array<string>>"
STYLE = "struct<text:string,plain:boolean,bold:boolean,italic:boolean,transform:string,align:string,indent:double,colspan:int>"
TABLES = f"doc_id string, tid int, grid {GRID}, styled array<array<{STYLE}>>"
ELEMENTS = "doc_id string, pos int, page int, category string, tag string, text string, has_links boolean, tid int"
DETAILS = "struct<row:bigint,col:bigint,oldVal:string,newVal:string,index:bigint,amount:bigint,isRow:boolean>"
EDITS = f"seq bigint, fileName string, tableIndex bigint, action string, range string, details {DETAILS}"


def to_rows(grids: DataFrame) -> DataFrame:
    """One row a table row: everything but grid, plus row and cells."""
    keep = [c for c in grids.columns if c != "grid"]
    return grids.select(*keep, F.posexplode("grid").alias("row", "cells"))


def to_cells(grids: DataFrame) -> DataFrame:
    """One row a cell: everything but grid, plus row, col and value."""
    rows = to_rows(grids)
    return rows.select(*[c for c in rows.columns if c != "cells"], F.posexplode("cells").alias("col", "value"))


def from_rows(rows: DataFrame, *keys: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("row", "cells")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda r: r["cells"]).alias("grid"))


def from_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Grids of cells (keys, row, col, value); a missing cell isn't filled, order is by row and col."""
    line = F.array_sort(F.collect_list(F.struct("col", "value")))
    rows = cells.groupBy(*keys, "row").agg(F.transform(line, lambda x: F.coalesce(x["value"], F.lit(""))).alias("cells"))
    return from_rows(rows, *keys)


def width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


def at(row: Column, i: Column | int) -> Column:
    """Cell i of a row, empty where the row is shorter."""
    return F.coalesce(F.get(row, F.lit(i) if isinstance(i, int) else i), F.lit(""))


def upto(n: Column, first: int = 0) -> Column:
    """first .. n-1 as an array, empty where there are none (sequence() would count down)."""
    return F.when(n > first, F.sequence(F.lit(first), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns replaced by values that no later step takes apart.

    Filters would otherwise be pushed below a chain of projections with every
    grid rule copied into them again and again; a generator stops that and stays
    in one stage.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in values]
    made = df.select(*keep, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_settled"))
    return made.select(*[F.col("_settled").getField(c).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns], *[F.col("_settled").getField(c).alias(c) for c in values if c not in df.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys in many parts, four a core at least.

    Where a row takes far more time or memory than its bytes show, parts by
    bytes, as files and adaptive plans make them, are few and heavy.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
