"""Rules along one row of cells, as left folds, and distances between rows and grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import at, let, upto
from . import cells as C


def _fold(row: Column, step) -> Column:
    """Fold over cells 1..; ``step(row, c)`` gives the row after cell c."""
    return F.aggregate(upto(F.size(row), 1), row, lambda acc, c: step(acc, c))


def _with(acc: Column, c: Column, left: Column, cell: Column, tail: Column) -> Column:
    """The row with cells c-1, c and all after c replaced."""
    return F.concat(F.slice(acc, F.lit(1), F.greatest(c - 1, F.lit(0))), F.array(left, cell), tail)


def _tail(acc: Column, c: Column) -> Column:
    return F.when(c + 1 < F.size(acc), F.slice(acc, c + 2, F.size(acc))).otherwise(F.array().cast("array<string>"))


def _rest(tail: Column) -> Column:
    return F.when(F.size(tail) > 1, F.slice(tail, F.lit(2), F.size(tail))).otherwise(F.array().cast("array<string>"))


def _glue_where(row: Column, test, change=lambda v: v) -> Column:
    """Cells that ``test`` accepts move to the end of their left neighbour."""

    def step(acc: Column, c: Column) -> Column:
        def put(v: Column) -> Column:
            hit = test(v)
            return _with(acc, c, F.when(hit, F.concat(at(acc, c - 1), v)).otherwise(at(acc, c - 1)), F.when(hit, "").otherwise(v), _tail(acc, c))

        return let(change(at(acc, c)), put)

    return _fold(row, step)


def glue_paren(row: Column) -> Column:
    return _glue_where(row, lambda v: v.startswith(")"))


def glue_percent(row: Column) -> Column:
    return _glue_where(row, lambda v: v.startswith("%"))


def glue_footnote(row: Column) -> Column:
    return _glue_where(row, C.starts_footnote)


def trailing_dash(row: Column) -> Column:
    n = F.size(row)
    return F.when((n > 1) & (at(row, n - 1) == C.DASH), F.concat(F.slice(row, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(at(row, n - 2), F.lit(C.DASH)), F.lit("")))).otherwise(row)


def merge_dash(row: Column) -> Column:
    """``a | - | b`` becomes ``a - b`` in the first of the three."""

    def step(acc: Column, c: Column) -> Column:
        hit = (at(acc, c) == C.DASH) & (c + 1 < F.size(acc))
        joined = F.concat(at(acc, c - 1), F.lit(" - "), at(acc, c + 1))
        return F.when(hit, _with(acc, c, joined, F.lit(""), F.concat(F.array(F.lit("")), _rest(_tail(acc, c))))).otherwise(acc)

    return _fold(row, step)


def shift_enumerator(row: Column) -> Column:
    """A cell like ``a)`` takes in its right neighbour; what follows moves left."""

    def step(acc: Column, c: Column) -> Column:
        hit = C.starts_enumerator(at(acc, c)) & ~C.starts_footnote(at(acc, c)) & (c + 1 < F.size(acc))
        joined = F.concat(at(acc, c), F.lit(" "), at(acc, c + 1))
        return F.when(hit, _with(acc, c, at(acc, c - 1), joined, F.concat(_rest(_tail(acc, c)), F.array(F.lit(""))))).otherwise(acc)

    return _fold(row, step)


#: Stands where a sweep has joined two cells by a lone dash; no text of a document holds it.
JOINED = "\0"
#: What some rule of a sweep needs in a cell, anywhere in a text of cells by lines.
SWEPT = r"(?m)[$)%(,–]|\.0$"


def sweep(row: Column, mark: bool = False) -> Column:
    """All rules of the filing cleaner along one row, in their order within each cell.

    Dash ranges that reach upward need the rows above (see operators.clean);
    ``mark`` leaves JOINED in the cells that took in a dash and what follows it.
    Cells in which no rule can find what it needs are passed over, rows of
    nothing else stay as they are.
    """
    none = F.array().cast("array<string>")

    def step(acc: Column, c: Column) -> Column:
        has_next = c + 1 < F.size(acc)

        def dashed(v: Column) -> Column:
            """(left, cell, tail) after the glue and dash rules."""
            glued, dash = v.startswith(")") | v.startswith("%"), v == C.DASH
            left = at(acc, c - 1)
            tail = _tail(acc, c)
            return F.struct(
                F.when(glued | (dash & ~has_next), F.concat(left, v)).when(dash, F.concat(left, F.lit(JOINED + " - " if mark else " - "), at(acc, c + 1))).otherwise(left).alias("left"),
                F.when(glued | dash, "").otherwise(C.drop_thousands(C.tighten_paren(C.strip_dot_zero(v)))).alias("cell"),
                F.when(dash & has_next, F.concat(F.array(F.lit("")), _rest(tail))).otherwise(tail).alias("tail"),
            )

        def noted(x: Column) -> Column:
            note = C.starts_footnote(x["cell"])
            enum = ~note & C.starts_enumerator(x["cell"]) & has_next
            left = F.when(note, F.concat(x["left"], x["cell"])).otherwise(x["left"])
            cell = F.when(note, "").when(enum, F.concat(x["cell"], F.lit(" "), F.coalesce(F.get(x["tail"], F.lit(0)), F.lit("")))).otherwise(x["cell"])
            return _with(acc, c, left, cell, F.when(enum, F.concat(_rest(x["tail"]), F.array(F.lit("")))).otherwise(F.coalesce(x["tail"], none)))

        return F.when(at(acc, c).rlike(SWEPT), let(let(C.strip_dollar(at(acc, c)), dashed), noted)).otherwise(acc)

    # A null, which a sweep makes empty, reads as a cell to sweep.
    filled = F.when(F.size(row) > 1, F.transform(row, lambda v: F.coalesce(v, F.lit("")))).otherwise(row)
    return F.when(F.array_join(row, "\n", "$").rlike(SWEPT), _fold(filled, step)).otherwise(row)


def left_compact(row: Column, offset: Column) -> Column:
    """Cells from ``offset`` on that aren't empty move left, .0 endings go, the rest is blank."""
    full = F.transform(F.filter(F.slice(row, offset + 1, F.greatest(F.size(row) - offset, F.lit(0))), lambda v: v != ""), C.strip_dot_zero)
    return F.concat(F.slice(row, F.lit(1), offset), full, F.array_repeat(F.lit(""), F.size(row) - offset - F.size(full)))


def spread_header(row: Column, offset: Column) -> Column:
    """Cells from ``offset`` on take the row's values in equal shares of the columns.

    With offset 0 the first column looks one place before the first value and so
    takes the last.
    """
    n = F.size(row)
    values = F.filter(F.slice(row, offset + 1, F.greatest(n - offset, F.lit(0))), lambda v: v != "")

    def spread(vals: Column) -> Column:
        def cell(v: Column, c: Column) -> Column:
            k = F.floor((c - 1) * F.size(vals) / (n - 1)).cast("int")
            return F.when((c < offset) | (F.size(vals) == 0), v).otherwise(F.get(vals, F.when(k < 0, k + F.size(vals)).otherwise(k)))

        return F.transform(row, cell)

    return F.when(n > 1, let(values, spread)).otherwise(row)


def glue_emphasis(row: Column) -> Column:
    """Parenthesis, footnote and dash rules where cells may carry emphasis stars."""
    bare = lambda v: F.trim(F.btrim(v, F.lit("*")))

    def close(acc: Column, c: Column) -> Column:
        left, v = at(acc, c - 1), at(acc, c)
        stars = F.regexp_extract(left, r"(\**)$", 1)
        paren = F.btrim(v, F.lit("*")) == ")"
        note = bare(v).rlike(r"^\(.\)")
        to = F.when(paren, F.concat(F.regexp_replace(left, r"\*+$", ""), F.regexp_replace(v, r"^\*+", ""))).when(note, F.concat(F.regexp_replace(left, r"\*+$", ""), bare(v), stars)).otherwise(left)
        return _with(acc, c, to, F.when(paren | note, "").otherwise(v), _tail(acc, c))

    def dash(acc: Column, c: Column) -> Column:
        hit = (F.btrim(at(acc, c), F.lit("*")) == C.DASH) & (c + 1 < F.size(acc))
        joined = F.concat(F.regexp_replace(at(acc, c - 1), r"\*+$", ""), F.lit(C.DASH), F.regexp_replace(at(acc, c + 1), r"^\*+", ""))
        return F.when(hit, _with(acc, c, F.lit(""), F.lit(""), F.concat(F.array(joined), _rest(_tail(acc, c))))).otherwise(acc)

    return _fold(_fold(row, close), dash)


def expand_colspan(values: Column, spans: Column) -> Column:
    """Each value as often as it spans columns."""
    return F.flatten(F.zip_with(values, spans, lambda v, n: F.array_repeat(v, F.greatest(n, F.lit(1)))))


def cell_distance(a: Column, b: Column, ignore_comma: bool = False) -> Column:
    """Unit-cost edit distance of two rows, by whole cells."""
    return _edit_distance(a, b, lambda x, y: F.when(C.same_cell(x, y, ignore_comma), 0).otherwise(1))


def grid_distance(a: Column, b: Column, ignore_comma: bool = False) -> Column:
    """Edit distance of two grids: a row inserted or deleted costs 1, a changed one its cell distance."""
    return F.when(a == b, 0).otherwise(_edit_distance(a, b, lambda x, y: cell_distance(x, y, ignore_comma)))


def _edit_distance(a: Column, b: Column, cost) -> Column:
    """Dynamic programme with two rolling rows; the running row is built left to right."""
    first = F.concat(F.array(F.lit(0)), F.transform(b, lambda _, j: j + 1))

    def next_row(state: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.least(F.element_at(acc, -1) + 1, F.get(state["row"], j + 1) + 1, F.get(state["row"], j) + cost(x, F.get(b, j)))
            return F.concat(acc, F.array(best))

        row = F.aggregate(upto(F.size(b)), F.array(state["i"] + 1), cell)
        return F.struct((state["i"] + 1).alias("i"), row.alias("row"))

    return F.aggregate(a, F.struct(F.lit(0).alias("i"), first.alias("row")), next_row, lambda s: F.element_at(s["row"], -1))
