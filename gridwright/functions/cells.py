"""Rules for one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"
NBSP = " "


def strip_dollar(v: Column) -> Column:
    return F.replace(v, F.lit("$"), F.lit(""))


def strip_dot_zero(v: Column) -> Column:
    """A cell that ends in .0 loses every .0."""
    return F.when(F.right(v, F.lit(2)) == ".0", F.replace(v, F.lit(".0"), F.lit(""))).otherwise(v)


def tighten_paren(v: Column) -> Column:
    return F.replace(v, F.lit("( "), F.lit("("))


def drop_thousands(v: Column) -> Column:
    """Commas go where only digits remain beside parentheses and commas."""
    return F.when(F.regexp_replace(v, "[(),]", "").rlike(r"^\d+$"), F.replace(v, F.lit(","), F.lit(""))).otherwise(v)


def digit_commas(v: Column) -> Column:
    """Commas between digits go, wherever they are."""
    return F.regexp_replace(v, r"(?<=\d),(?=\d)", "")


def clean_space(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"[\s\x{a0}]+", " "))


def collapse_spaces(v: Column) -> Column:
    return F.regexp_replace(F.replace(v, F.lit("&nbsp;"), F.lit(" ")), " +", " ")


def shown_spaces(v: Column) -> Column:
    """Leading spaces of a line as no-break spaces."""
    lead = F.length(F.regexp_extract(v, "^( *)", 1))
    return F.concat(F.repeat(F.lit(NBSP), lead), F.substring(v, lead + 1, F.length(v)))


def starts_footnote(v: Column) -> Column:
    return v.rlike(r"^\([\p{L}\p{N}_]\)")


def starts_enumerator(v: Column) -> Column:
    return v.rlike(r"^[\p{L}\p{N}_]\)")


def transform_text(v: Column, how: Column) -> Column:
    return F.when(how == "uppercase", F.upper(v)).when(how == "lowercase", F.lower(v)).otherwise(v)


def emphasise(v: Column, bold: Column, italic: Column) -> Column:
    """Markdown stars around a cell that isn't empty."""
    strong = F.when((v != "") & bold, F.concat(F.lit("**"), v, F.lit("**"))).otherwise(v)
    return F.when((v != "") & italic, F.concat(F.lit("*"), strong, F.lit("*"))).otherwise(strong)


def toggle_bold(v: Column) -> Column:
    return F.when(v.rlike(r"(?s)^<b>.*</b>$"), F.regexp_replace(v, r"(?s)^<b>(.*)</b>$", "$1")).otherwise(F.concat(F.lit("<b>"), v, F.lit("</b>")))


def css_value(style: Column, attribute: str) -> Column:
    """Value of the first declaration that mentions ``attribute``; '' if none does."""
    return F.trim(F.regexp_extract(style, rf"(?:^|;)[^;:]*{attribute}[^;:]*:([^;]*)", 1))


def css_points(style: Column, attribute: str) -> Column:
    """Last pt figure of the first declaration that mentions ``attribute``; -1 if none does."""
    declared = F.regexp_extract(style, rf"(?:^|;)([^;]*{attribute}[^;]*)", 1)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(declared, F.lit(r"([\d.]+)pt"), F.lit(1)), F.lit(-1)).cast("double"), F.lit(-1.0))


def same_cell(a: Column, b: Column, ignore_comma: bool = False) -> Column:
    if not ignore_comma:
        return a == b
    number = r"^[0-9.,]+$"
    return (a == b) | (a.rlike(number) & b.rlike(number) & (F.replace(a, F.lit(","), F.lit("")) == F.replace(b, F.lit(","), F.lit(""))))


def csv_field(v: Column) -> Column:
    """A CSV field, quoted where it must be."""
    return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def html_text(v: Column) -> Column:
    return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cell_range(text: Column) -> Column:
    """Half-open ``[r0:r1, c0:c1]`` as a struct of four ints, null where it isn't one."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(n) == 4, F.struct(n[0].alias("r0"), n[1].alias("r1"), n[2].alias("c0"), n[3].alias("c1")))
