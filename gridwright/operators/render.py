"""Grids as CSV, Markdown and HTML, and the writers for them."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..model import at, let, upto, width

#: The six looks of generated tables, (name, table style, header style).
LOOKS = [
    ("plain", "border-collapse:collapse", "font-weight:bold"),
    ("boxed", "border:1px solid #000;border-collapse:collapse", "border:1px solid #000"),
    ("ruled", "border-top:2px solid #000;border-bottom:2px solid #000", "border-bottom:1px solid #000"),
    ("zebra", "border-collapse:collapse;background:#fff", "background:#cceeff"),
    ("serif", "font-family:Times New Roman;font-size:10pt", "font-style:italic"),
    ("small", "font-family:Arial;font-size:8pt", "text-transform:uppercase"),
]


def csv_text(grid: Column) -> Column:
    """CSV lines without index, header line or trailing newline."""
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda v: C.csv_field(F.coalesce(v, F.lit("")))), ",")), "\n")


def markdown_text(grid: Column) -> Column:
    """A pipe table with numbered header and rows."""
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    n = width(grid)
    head = bar(F.concat(F.array(F.lit("")), F.transform(upto(n), lambda j: j.cast("string"))))
    rule = F.concat(F.lit("|:---|"), F.repeat(F.lit(":---|"), n))
    body = F.transform(grid, lambda r, i: bar(F.concat(F.array(i.cast("string")), F.transform(upto(n), lambda j: F.replace(at(r, j), F.lit("|"), F.lit(r"\|"))))))
    return F.array_join(F.concat(F.array(head, rule), body), "\n")


def titled_markdown(titles: Column, tid: Column, grid: Column) -> Column:
    lead = F.when(F.size(titles) > 0, F.concat(F.array_join(titles, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(lead, F.lit('<markdown tid="'), tid.cast("string"), F.lit('">\n'), markdown_text(grid), F.lit("\n</markdown>"))


def newline_html(v: Column, how: Column) -> Column:
    """Line ends in a cell: left, as <br>, or an empty paragraph for a blank line."""
    return F.when(how == 1, F.replace(v, F.lit("\n"), F.lit("<br>"))).when(how == 2, F.replace(v, F.lit("\n\n"), F.lit("<p>&nbsp;</p>"))).otherwise(v)


def glue_columns(row: Column, every: Column, header: bool = False) -> Column:
    """A no-break-space column after every ``every`` columns; its header is a space."""
    filler = F.lit(" " if header else C.NBSP)
    return F.flatten(F.transform(row, lambda v, j: F.when((j + 1) % every == 0, F.array(v, filler)).otherwise(F.array(v))))


def spare_column(row: Column, place: Column) -> Column:
    place = F.least(place, F.size(row))
    none = F.array().cast("array<string>")
    head = F.when(place > 0, F.slice(row, F.lit(1), place)).otherwise(none)
    rest = F.when(place < F.size(row), F.slice(row, place + 1, F.size(row))).otherwise(none)
    return F.concat(head, F.array(F.lit(C.NBSP)), rest)


def column_widths(grid: Column) -> Column:
    """Percent of each column: 3 parts blank, 8 all numbers, 35 text; one decimal."""
    number = lambda v: F.replace(F.replace(v, F.lit(","), F.lit("")), F.lit("%"), F.lit("")).try_cast("double").isNotNull()

    def parts(j: Column) -> Column:
        values = F.filter(F.transform(grid, lambda r: F.trim(F.replace(at(r, j), F.lit(C.NBSP), F.lit(" ")))), lambda v: v != "")
        return F.when(F.size(values) == 0, 3).when(F.forall(values, number), 8).otherwise(35)

    return let(F.transform(upto(width(grid)), parts), lambda p: F.transform(p, lambda x: F.round(x * 100.0 / F.aggregate(p, F.lit(0), lambda a, b: a + b), 1)))


def total_rule(v: Column) -> Column:
    """Underlined where a cell speaks of a total."""
    return F.when(v.rlike(r"(?i)\b(total|subtotal|net)\b"), F.concat(F.lit("<u>"), v, F.lit("</u>"))).otherwise(v)


def ruled(row: Column) -> Column:
    """The style of a row with rules: black below a row that speaks of a total, else none to be seen."""
    total = F.exists(row, lambda v: v.rlike(r"(?i)\b(total|subtotal|net)\b"))
    return F.concat(F.lit(' style="border-bottom:0.75pt solid '), F.when(total, "#000").otherwise("transparent"), F.lit('"'))


def table_html(grid: Column, caption: Column | None = None, look: Column | None = None, widths: bool | Column = False, lines: Column | None = None, rules: bool | Column = False) -> Column:
    """A table element: the first row th, the others td; cells are escaped.

    ``lines`` tells what becomes of line ends (``newline_html``), ``widths`` and
    ``rules`` whether there are column widths and row rules.
    """
    k = F.lit(0) if look is None else look
    style = F.element_at(F.array(*[F.lit(s) for _, s, _ in LOOKS]), k + 1)
    head = F.element_at(F.array(*[F.lit(h) for _, _, h in LOOKS]), k + 1)
    if lines is not None:
        style = F.concat(style, F.when(lines > 0, ";white-space:pre-line").otherwise(""))
    text = lambda v: C.html_text(F.coalesce(v, F.lit(""))) if lines is None else newline_html(C.html_text(F.coalesce(v, F.lit(""))), lines)
    rule = (lambda r: F.lit("")) if rules is False else (lambda r: F.when(F.lit(rules) if rules is True else rules, ruled(r)).otherwise(""))
    row = lambda r, tag, attr: F.concat(F.lit("<tr"), rule(r), F.lit(">"), F.array_join(F.transform(r, lambda v: F.concat(F.lit(f"<{tag}"), attr, F.lit(">"), text(v), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    rows = F.transform(grid, lambda r, i: F.when(i == 0, row(r, "th", F.concat(F.lit(' style="'), head, F.lit('"')))).otherwise(row(r, "td", F.lit(""))))
    cap = F.lit("") if caption is None else F.concat(F.lit("<caption>"), C.html_text(caption), F.lit("</caption>"))
    cols = F.lit("")
    if widths is not False:
        cols = F.concat(F.lit("<colgroup>"), F.array_join(F.transform(column_widths(grid), lambda w: F.concat(F.lit('<col style="width:'), w.cast("decimal(5,1)").cast("string"), F.lit('%">'))), ""), F.lit("</colgroup>"))
        cols = F.when(F.lit(True) if widths is True else widths, cols).otherwise("")
    return F.concat(F.lit('<table style="'), style, F.lit('">'), cap, cols, F.array_join(rows, ""), F.lit("</table>"))


PAGE_HEAD, PAGE_END = "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>", "</body></html>"


def document_html(parts: DataFrame, group: str, order: str = "path", html: str = "html") -> DataFrame:
    """One document a group of tables, in order: (group, html)."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, html))), lambda x: x[html]), "\n")
    page = F.concat(F.lit(PAGE_HEAD + "\n"), whole, F.lit("\n" + PAGE_END))
    return parts.groupBy(group).agg(page.alias("html"))


def write_document(parts: DataFrame, path: str, order: str = "path", html: str = "html") -> None:
    """All tables as one document, cut into part files in order: no task holds more than its share."""
    ends = parts.sparkSession.createDataFrame([(0, PAGE_HEAD), (2, PAGE_END)], "_k int, value string")
    rows = parts.select(F.lit(1).alias("_k"), F.col(html).alias("value"), F.col(order).cast("string").alias("_o"))
    rows.unionByName(ends, allowMissingColumns=True).orderBy("_k", "_o").select("value").write.mode("overwrite").text(path)


def response_json(tables: DataFrame) -> DataFrame:
    """(doc_id, body): {csv_tables, table_map} as JSON, tables in order behind a 0."""
    ordered = F.array_sort(F.collect_list(F.struct("tid", csv_text(F.col("grid")).alias("csv"))))
    body = F.struct(F.transform(ordered, lambda x: x["csv"]).alias("csv_tables"), F.array_prepend(F.transform(ordered, lambda x: x["tid"]), 0).alias("table_map"))
    return tables.groupBy("doc_id").agg(F.to_json(body).alias("body"))


def edits_json(edits: DataFrame, by: str = "fileName") -> DataFrame:
    """(fileName, body): a file's instructions, or a log's, as one JSON array, in order."""
    item = F.struct("seq", "fileName", "tableIndex", "action", "range", "details")
    ordered = F.array_sort(F.collect_list(item))
    bare = F.transform(ordered, lambda x: F.struct(x["fileName"].alias("fileName"), x["tableIndex"].alias("tableIndex"), x["action"].alias("action"), x["range"].alias("range"), x["details"].alias("details")))
    return edits.groupBy(by).agg(F.to_json(bare, {"ignoreNullFields": "false"}).alias("body"))


def write_texts(df: DataFrame, path: str, text_col: str, *keys: str, mode: str = "overwrite") -> None:
    """One folder a key combination with its text, through Spark's text writer."""
    df.select(*keys, F.col(text_col).alias("value")).write.mode(mode).partitionBy(*keys).text(path)


def write_csv(grids: DataFrame, path: str, *keys: str) -> None:
    write_texts(grids.withColumn("_csv", csv_text(F.col("grid"))), path, "_csv", *keys)


def write_markdown(grids: DataFrame, path: str, *keys: str) -> None:
    write_texts(grids.withColumn("_md", markdown_text(F.col("grid"))), path, "_md", *keys)


def edited_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.csv$", ""), F.lit("_edited.csv"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def zip_bytes(texts: DataFrame, name_col: str, text_col: str, most: int = 1000) -> bytes:
    """A zip of up to ``most`` small texts, made on the driver for a download."""
    rows = texts.select(name_col, text_col).orderBy(name_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} texts: write them with write_texts instead")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in rows:
            z.writestr(name, text or "")
    return out.getvalue()
