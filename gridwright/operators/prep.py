"""Preparation of filing HTML and of its element stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import clean_space

FORM_10K, FORM_10Q = "10-K", "10-Q"


#: A form's name as filings write it: spaces, entities or tags may stand before the number.
_GAP = r"(?=[\s\x{a0}&<])[\s\x{a0}]*+(?:(?:&nbsp;|&#160;|&#xa0;|<[^>]*>)[\s\x{a0}]*+)*+"
_NAMED = rf"(?i)\bform{_GAP}10(?:-|\x{{2010}}|\x{{2011}}|&#8208;|&#8209;)([kq])(?![a-z])"


def form_of(html: Column) -> Column:
    """10-K by a <10k> tag, else the form that the text behind the ix:header block names first, else 10-Q.

    The whole text is read.  Quarterly reports refer to the last Form 10-K, so
    what counts is the first name, that of the cover.
    """
    text = drop_header_blocks(F.coalesce(html, F.lit("")))
    named = F.lower(F.regexp_extract(text, _NAMED, 1))
    return F.when(F.lower(text).contains("<10k") | (named == "k"), FORM_10K).otherwise(FORM_10Q)


def paragraph_indent(points: Column) -> Column:
    """Spaces for a margin-left in points: four for each 12 beyond the first 12."""
    n = F.floor((points - 12) / 12) * 4
    return F.repeat(F.lit(" "), F.when(points < 12, 0).otherwise(n).cast("int"))


def division_indent(points: Column) -> Column:
    """Spaces for a text-indent in points: four for each 6.75."""
    return F.repeat(F.lit(" "), (F.floor(points / 6.75) * 4).cast("int"))


def drop_header_blocks(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<ix:header.*?</ix:header>", "")


def unwrap_inline(html: Column) -> Column:
    """ix:nonNumeric and ix:continuation tags go, what they hold stays."""
    return F.regexp_replace(html, r"(?i)</?ix:(?:nonNumeric|continuation)(?:\s[^>]*)?>", "")


def clip_document(html: Column) -> Column:
    """From the first <html to the first </html>; the whole text where they are missing."""
    found = F.regexp_extract(html, r"(?is)(<html.*?</html>)", 1)
    return F.when(found == "", html).otherwise(found)


def prepare(html: Column) -> Column:
    return clip_document(unwrap_inline(drop_header_blocks(html)))


def skip_contents(elements: DataFrame) -> DataFrame:
    """Elements behind the table of contents, with has_toc.

    Only documents of more than five pages have one: it ends at the last mention
    of a signature (or else an exhibit) on the first of seven pages with either.
    """
    key = F.replace(F.lower("text"), F.lit(" "), F.lit(""))
    hit = lambda word: F.when(F.col("category") == "Table", key.contains(word)).otherwise(F.substring(key, 1, 20).contains(word))
    pages = elements.groupBy("doc_id", "page").agg(F.max(F.when(hit("signature"), F.col("pos"))).alias("s"), F.max(F.when(hit("exhibit"), F.col("pos"))).alias("e"))
    last = pages.groupBy("doc_id").agg((F.max("page") + 1).alias("n"), F.min_by(F.coalesce("s", "e"), F.when(F.coalesce("s", "e").isNotNull() & (F.col("page") <= 6), F.col("page"))).alias("cut"))
    cut = F.when(F.col("n") > 5, F.col("cut"))
    return elements.join(last, "doc_id").withColumn("has_toc", cut.isNotNull()).where(F.coalesce(F.col("pos") > cut, F.lit(True))).drop("n", "cut")


def anchors(elements: DataFrame, every: int = 6) -> DataFrame:
    """(doc_id, pos, anchor, words): every sixth element whose text is unique, by its first ten words."""
    once = F.count("*").over(Window.partitionBy("doc_id", "text")) == 1
    words = F.array_join(F.slice(F.split("text", " "), 1, 10), " ")
    picked = elements.withColumn("_once", once).where(F.col("_once") & (F.col("pos") % every == 0))
    return picked.select("doc_id", "pos", F.concat(F.lit("tag"), F.col("pos")).alias("anchor"), words.alias("words"))


def has_value(grid: Column) -> Column:
    """Whether any cell holds something: an empty table isn't worth a number."""
    return F.exists(grid, lambda r: F.exists(r, lambda v: clean_space(v) != ""))


def dom_id(tid: Column) -> Column:
    return F.concat(F.lit("table-"), tid - 1)


def table_map(tids: Column) -> Column:
    """Table numbers in order behind a leading 0."""
    return F.array_prepend(F.array_sort(tids), 0)


def table_lines(text: Column) -> Column:
    """``tid,<html>`` lines of a text as an array of (tid, html); other lines don't count."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\d+,"))
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ",", 1).cast("int").alias("tid"), F.regexp_replace(x, r"^\d+,", "").alias("html")))
