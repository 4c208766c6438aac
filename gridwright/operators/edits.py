"""Replay of ordered edit instructions on grids.

A target is ``(fileName, header, grid)``; instructions fold over it in order.
Row indexes of the log count the header as row 0, except in merges, which count
data rows from 0.  What is out of range is skipped and told in ``status``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..model import GRID, at, spread, upto

STRINGS = "array<string>"
STATE = ("header", "grid", "applied", "skipped", "mismatched")


def _cut(a: Column, start: Column, n: Column, kind: str) -> Column:
    """An array without ``n`` items from ``start``."""
    start, n = F.greatest(start, F.lit(0)), F.greatest(n, F.lit(0))
    return F.when(start >= F.size(a), a).otherwise(F.concat(_slice(a, F.lit(0), start, kind), _slice(a, start + n, F.size(a), kind)))


def _slice(a: Column, start: Column, end: Column, kind: str) -> Column:
    return F.when(end > start, F.slice(a, start.cast("int") + 1, (end - start).cast("int"))).otherwise(F.array().cast(kind))


def _insert(a: Column, where: Column, items: Column, kind: str) -> Column:
    where = F.least(F.greatest(where, F.lit(0)), F.size(a))
    return F.concat(_slice(a, F.lit(0), where, kind), items, _slice(a, where, F.size(a), kind))


def edit_cell(header: Column, grid: Column, row: Column, col: Column, value: Column) -> tuple[Column, Column]:
    """Set a cell; row 0 is the header; a null value empties it."""
    value = F.coalesce(value, F.lit(""))
    put = lambda r: F.transform(r, lambda v, j: F.when(j == col, value).otherwise(v))
    return F.when(row == 0, put(header)).otherwise(header), F.transform(grid, lambda r, i: F.when(i == row - 1, put(r)).otherwise(r))


def remove_rows(grid: Column, index: Column, amount: Column) -> Column:
    return _cut(grid, index - 1, amount, GRID)


def remove_cols(header: Column, grid: Column, index: Column, amount: Column) -> tuple[Column, Column]:
    return _cut(header, index, amount, STRINGS), F.transform(grid, lambda r: _cut(r, index, amount, STRINGS))


def add_cols(header: Column, grid: Column, index: Column, amount: Column) -> tuple[Column, Column]:
    blank = F.array_repeat(F.lit(""), amount.cast("int"))
    return _insert(header, index, blank, STRINGS), F.transform(grid, lambda r: _insert(r, index, blank, STRINGS))


def add_rows(header: Column, grid: Column, index: Column, amount: Column) -> Column:
    blank = F.array_repeat(F.array_repeat(F.lit(""), F.size(header)), amount.cast("int"))
    return _insert(grid, index - 1, blank, GRID)


def merge_rows(grid: Column, index: Column) -> Column:
    """Data rows index and index+1 become one, cells joined without a sign between."""
    able = (index >= 0) & (index + 1 < F.size(grid))
    one = F.zip_with(F.get(grid, index.cast("int")), F.get(grid, index.cast("int") + 1), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(able, F.concat(_slice(grid, F.lit(0), index, GRID), F.array(one), _slice(grid, index + 2, F.size(grid), GRID))).otherwise(grid)


def merge_cols(header: Column, grid: Column, index: Column) -> tuple[Column, Column]:
    """Columns index and index+1 become one: cells joined by a space if both hold something, names by _."""

    def one(r: Column, sign: str) -> Column:
        a, b = at(r, index.cast("int")), at(r, index.cast("int") + 1)
        both = F.when((a != "") & (b != ""), F.concat(a, F.lit(sign), b)).otherwise(F.concat(a, b))
        able = (index >= 0) & (index + 1 < F.size(r))
        return F.when(able, F.concat(_slice(r, F.lit(0), index, STRINGS), F.array(both), _slice(r, index + 2, F.size(r), STRINGS))).otherwise(r)

    return one(header, "_"), F.transform(grid, lambda r: one(r, " "))


def _step(acc: Column, e: Column) -> Column:
    d, action = e["details"], e["action"]
    header, grid = acc["header"], acc["grid"]
    rows, cols = F.size(grid), F.size(header)
    index = F.coalesce(d["index"], F.when(action.endswith("row"), d["row"]).otherwise(d["col"])).cast("int")
    amount = F.greatest(F.coalesce(d["amount"], F.lit(1)), F.lit(0)).cast("int")
    row, col = d["row"].cast("int"), d["col"].cast("int")
    eh, eg = edit_cell(header, grid, row, col, d["newVal"])
    rh, rg = remove_cols(header, grid, index, amount)
    ah, ag = add_cols(header, grid, index, amount)
    mh, mg = merge_cols(header, grid, index)
    by_row = F.coalesce(d["isRow"], F.lit(False))
    now = F.when(row == 0, at(header, col)).otherwise(at(F.get(grid, row - 1), col))
    editing = (action == "edit") & row.between(0, rows) & col.between(0, cols - 1)
    mismatched = acc["mismatched"] + F.coalesce((editing & (d["oldVal"] != now)).cast("int"), F.lit(0))
    cases = [
        (editing, eh, eg),
        ((action == "remove_row") & (index >= 0) & (index <= rows), header, remove_rows(grid, index, amount)),
        ((action == "remove_col") & index.between(0, cols - 1), rh, rg),
        ((action == "add_col") & (index >= 0), ah, ag),
        ((action == "add_row") & (index >= 0), header, add_rows(header, grid, index, amount)),
        ((action == "merge") & by_row & index.between(0, rows - 2), header, merge_rows(grid, index)),
        ((action == "merge") & ~by_row & index.between(0, cols - 2), mh, mg),
    ]
    new = None
    for test, h, g in cases:
        value = F.struct(h.alias("header"), g.alias("grid"), (acc["applied"] + 1).alias("applied"), acc["skipped"].alias("skipped"), mismatched.alias("mismatched"))
        test = F.coalesce(test, F.lit(False))
        new = F.when(test, value) if new is None else new.when(test, value)
    return new.otherwise(F.struct(header.alias("header"), grid.alias("grid"), acc["applied"].alias("applied"), (acc["skipped"] + 1).alias("skipped"), mismatched.alias("mismatched")))


def replay(targets: DataFrame, edits: DataFrame, name_col: str = "fileName") -> DataFrame:
    """``targets`` (name, header, grid) after their instructions, with applied, skipped and mismatched counts.

    One shuffle by file name, into many parts so that a task sorts few files at a
    time; each target folds its own instructions log by log
    (where ``edits`` has a log) and in order of seq.  An edit is applied even if
    the cell doesn't hold the old value it names; such are counted as mismatched.
    Instructions without a file name are left out; targets without any stay as
    they are.
    """
    order = F.struct(*(["log"] if "log" in edits.columns else []), "seq", "action", "details")
    steps = spread(edits.where(F.col(name_col).isNotNull()), name_col).groupBy(name_col).agg(F.array_sort(F.collect_list(order)).alias("_edits"))
    df = spread(targets, name_col).join(steps, name_col, "left")
    width = F.size("header")
    filled = F.transform("grid", lambda r: F.transform(upto(width), lambda j: at(r, j)))
    start = F.struct(F.col("header"), filled.alias("grid"), F.lit(0).alias("applied"), F.lit(0).alias("skipped"), F.lit(0).alias("mismatched"))
    done = F.aggregate(F.coalesce("_edits", F.array().cast(steps.schema["_edits"].dataType)), start, _step)
    return df.withColumn("_done", done).select(*[c for c in targets.columns if c not in ("header", "grid")], "_done.*")


def status(applied: Column, skipped: Column) -> Column:
    return F.when(skipped == 0, "ok").when(applied == 0, "skipped").otherwise("partial")


def in_range(grid: Column, rng: Column, change) -> Column:
    """Cells of a half-open range (struct r0, r1, c0, c1) changed, the others as they are."""
    return F.transform(grid, lambda r, i: F.transform(r, lambda v, j: F.when((i >= rng["r0"]) & (i < rng["r1"]) & (j >= rng["c0"]) & (j < rng["c1"]), change(v)).otherwise(v)))


def bold_range(grid: Column, rng: Column) -> Column:
    return in_range(grid, rng, C.toggle_bold)


def indent_range(grid: Column, rng: Column) -> Column:
    return in_range(grid, rng, lambda v: F.concat(F.repeat(F.lit(" "), F.lit(4)), v))


def cut_range(grid: Column, rng: Column) -> Column:
    return in_range(grid, rng, lambda v: F.lit(""))


def copy_range(grid: Column, rng: Column) -> Column:
    rows = F.slice(grid, rng["r0"] + 1, rng["r1"] - rng["r0"])
    return F.transform(rows, lambda r: F.slice(r, rng["c0"] + 1, rng["c1"] - rng["c0"]))


def paste_range(grid: Column, rng: Column, clip: Column) -> Column:
    """``clip`` laid onto the range's top left corner, clipped to the range and the grid."""

    def cell(v: Column, i: Column, j: Column) -> Column:
        inside = (i >= rng["r0"]) & (i < rng["r1"]) & (j >= rng["c0"]) & (j < rng["c1"])
        new = F.get(F.get(clip, i - rng["r0"]), j - rng["c0"])
        return F.when(inside & (i >= rng["r0"]) & (j >= rng["c0"]), F.coalesce(F.when(inside, new), v)).otherwise(v)

    return F.transform(grid, lambda r, i: F.transform(r, lambda v, j: cell(v, i, j)))


def draw_tables(tables: DataFrame, seen: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """``n`` tables (doc_id, tid) not yet seen, in a seeded order."""
    return tables.join(seen, ["doc_id", "tid"], "left_anti").orderBy(F.md5(F.concat_ws(":", "doc_id", "tid", F.lit(seed))), "doc_id", "tid").limit(n)
