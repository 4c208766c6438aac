"""Cleaning of whole grids.  Every rule is a column expression over one row's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import rows as R
from ..model import at, let, settle, upto, width


def _pick(grid: Column, columns: Column) -> Column:
    return F.transform(grid, lambda r: F.transform(columns, lambda j: at(r, j)))


def drop_empty_cols(grid: Column, first_row: int = 0, judged: Column | None = None) -> Column:
    """Columns without a value go; rows before ``first_row`` and rows not ``judged`` have no say."""

    def full(j: Column) -> Column:
        if judged is not None:
            return F.exists(F.zip_with(grid, judged, lambda r, ok: ok & (at(r, j) != "")), lambda x: x)
        rows = grid if not first_row else F.slice(grid, F.lit(first_row + 1), F.greatest(F.size(grid), F.lit(1)))
        return F.exists(rows, lambda r: at(r, j) != "")

    return let(F.filter(upto(width(grid)), full), lambda keep: _pick(grid, keep))


def drop_empty_rows(grid: Column) -> Column:
    return F.filter(grid, lambda r: F.exists(r, lambda v: F.coalesce(v, F.lit("")) != ""))


def fill(grid: Column) -> Column:
    """Nulls as empty cells, short rows filled up: rectangular."""
    return let(width(grid), lambda n: F.transform(grid, lambda r: F.transform(upto(n), lambda j: at(r, j))))


def big_enough(grid: Column) -> Column:
    return (F.size(grid) >= 2) & (width(grid) >= 2)


def data_offset(grid: Column) -> Column:
    """Where values begin, judged by the last row: 1 after a label, else behind the first value."""
    last = F.coalesce(F.try_element_at(grid, F.lit(-1)), F.array().cast("array<string>"))
    first = F.array_min(F.filter(upto(F.size(last), 1), lambda j: at(last, j) != ""))
    return F.when(at(last, 0) != "", 1).otherwise(F.coalesce(first + 1, F.lit(0)))


def spread_headers(grid: Column, offset: Column) -> Column:
    """Header spreading on the first row and on the second and third where they have no label."""
    return F.transform(grid, lambda r, i: F.when((i < 3) & ((i == 0) | (at(r, 0) == "")), R.spread_header(r, offset)).otherwise(r))


def drop_body_empty_cols(grid: Column) -> Column:
    """Columns empty from the fourth row on go, where there are more than three rows."""
    return F.when(F.size(grid) > 3, drop_empty_cols(grid, 3)).otherwise(grid)


def title_rows(grid: Column) -> Column:
    """Number of leading title rows: one cell with a value, without the word 'ended'."""

    def is_title(r: Column) -> Column:
        full = F.filter(r, lambda v: F.coalesce(v, F.lit("")) != "")
        return (F.size(full) == 1) & ~F.lower(F.get(full, F.lit(0))).contains("ended")

    other = F.array_min(F.filter(F.transform(grid, lambda r, i: F.when(is_title(r), None).otherwise(i)), lambda x: x.isNotNull()))
    return F.coalesce(other, F.size(grid))


def sweep_rows(grids: DataFrame, grid_col: str = "grid") -> DataFrame:
    """Grids with all rows swept, and dash ranges carried on to the rows above.

    Each row is swept once, which marks the cells it joins by a lone dash; only
    grids with such a mark look at their other rows.
    """
    g = F.col(grid_col)
    df = settle(grids, _last=F.coalesce(F.try_element_at(g, F.lit(-1)), F.array().cast("array<string>")), **{grid_col: F.transform(g, lambda r: R.sweep(r, mark=True))})
    marked = F.exists(g, lambda r: F.exists(r, lambda v: v.contains(R.JOINED)))
    return settle(df, **{grid_col: F.when(marked, carry_upward(g, F.col("_last"))).otherwise(g)}).select(*[F.col(f"`{c}`") for c in grids.columns])


def carry_upward(grid: Column, raw_last: Column) -> Column:
    """Where a row's cells were joined by a dash below a gap, the rows above join theirs too, up to row 1.

    A range starts two columns or more to the right of the last one.  The first
    row looks at the last one, as it came, for its gap, and has no row above.
    """
    bare = F.transform(grid, lambda line: F.transform(line, lambda v: F.replace(v, F.lit(R.JOINED), F.lit(""))))
    gaps = lambda line: F.filter(upto(F.size(line), 1), lambda j: at(line, j - 1).contains(R.JOINED))
    marks = F.flatten(F.transform(grid, lambda line, r: F.transform(gaps(line), lambda j: F.struct(r.alias("row"), j.alias("gap")))))

    def carry(acc: Column, mark: Column) -> Column:
        rows, row, gap = acc["grid"], mark["row"], mark["gap"]

        def join(line: Column, i: Column, top: Column) -> Column:
            cells = F.transform(line, lambda v, j: F.when(j == gap - 1, F.concat(v, F.lit("- "), at(line, gap + 1))).when(j.between(gap, gap + 1), "").otherwise(v))
            return F.when((i > top) & (i < row), cells).otherwise(line)

        stops = F.filter(upto(row, 1), lambda i: (at(F.get(rows, i), gap) != "") | (at(F.get(rows, i), gap + 1) == ""))
        joined = let(F.coalesce(F.array_max(stops), F.lit(0)), lambda top: F.transform(rows, lambda line, i: join(line, i, top)))
        before = F.when(row > 0, F.get(rows, row - 1)).otherwise(raw_last)
        return F.when((at(before, gap) == "") & (acc["right"] < gap - 1), F.struct(joined.alias("grid"), gap.alias("right"))).otherwise(acc)

    return F.aggregate(marks, F.struct(bare.alias("grid"), F.lit(1).alias("right")), carry, lambda acc: acc["grid"])


def clean_filing(grids: DataFrame, grid_col: str = "grid") -> DataFrame:
    """Grids of a filing as clean tables; those smaller than 2 x 2 go.

    Empty columns and rows go, the row sweep glues and merges, headers spread
    over their columns, columns with an empty body go.
    """
    g = F.col(grid_col)
    df = settle(grids.where(big_enough(g)), **{grid_col: drop_empty_cols(fill(g))})
    df = sweep_rows(settle(df, **{grid_col: drop_empty_rows(g)}), grid_col)
    df = settle(df, _offset=data_offset(g), **{grid_col: drop_empty_cols(g)}).where(big_enough(g))
    df = settle(df, **{grid_col: spread_headers(g, F.col("_offset"))}).drop("_offset")
    df = settle(df, **{grid_col: drop_body_empty_cols(g)})
    return df.withColumn(grid_col, F.transform(g, lambda r: F.transform(r, C.collapse_spaces)))


def clean_markdown(grids: DataFrame, grid_col: str = "grid", titles_col: str = "titles") -> DataFrame:
    """Grids for rendering: titles taken off, values moved left, headers spread."""
    g, n = F.col(grid_col), F.col("_n")
    df = settle(grids.where(big_enough(g)), **{grid_col: drop_empty_rows(drop_empty_cols(fill(g)))})
    df = settle(df, _n=title_rows(g))
    df = settle(df, **{titles_col: F.transform(F.slice(g, F.lit(1), n), lambda r: F.get(F.filter(r, lambda v: v != ""), F.lit(0))), grid_col: F.slice(g, n + 1, F.greatest(F.size(g) - n, F.lit(0)))}).drop("_n")
    df = settle(df, **{grid_col: drop_empty_rows(drop_empty_cols(g))})
    df = settle(df, **{grid_col: F.transform(g, lambda r: R.glue_percent(R.glue_paren(F.transform(r, lambda v, i: F.when(i > 0, C.strip_dollar(v)).otherwise(v)))))})
    # Offset 1 for the first row and for leading rows without a label, 0 after a labelled one.
    df = settle(df, _first=F.array_min(F.filter(F.transform(g, lambda r, i: F.when((i > 0) & (at(r, 0) != ""), i)), lambda x: x.isNotNull())))
    df = settle(df, **{grid_col: F.transform(g, lambda r, i: R.left_compact(r, F.when(i < F.coalesce("_first", F.lit(1 << 30)), 1).otherwise(0)))}).drop("_first")
    df = settle(df, **{grid_col: drop_empty_cols(g)}).where(big_enough(g))
    return df.withColumn(grid_col, spread_headers(g, F.lit(1)))
