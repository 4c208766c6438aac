"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``ratio`` of the host's pages have
it.  Counts cover all pages; the boilerplate lines of a host number at most
(lines a page) / ratio, so one array a host holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, stash


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _with_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def boilerplate(pages: DataFrame, text_col: str, host_col: str, ratio: float, min_pages: int, copies_once: bool = False) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines on more than ``ratio`` of a host's pages.

    With ``copies_once`` a host's pages are its distinct texts, in both counts.
    """
    host, text = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col)
    own = F.array_distinct(F.transform(F.filter(_lines(text), _with_word), _hash)).alias("own")
    rows = pages.select(host, own)
    if copies_once:  # line hashes, not texts, meet by digest
        texts = pages.select(host, F.xxhash64(text).alias("digest"), own)
        rows = stash(texts.groupBy("host", "digest").agg(F.first("own").alias("own")).drop("digest"), "distinct-lines")
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = rows.select("host", F.explode("own").alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages")).select("host", "line_hash", "pages", "host_pages")


def drop_boilerplate(pages: DataFrame, text_col: str = "text", host_col: str = "host", ratio: float = 0.02, min_pages: int = 5, dropped_col: str | None = None, broadcast_bytes: int = 16 << 20, copies_once: bool = False) -> DataFrame:
    """``pages`` without the lines that too large a share of their host's pages has.

    Lines are split at \\n and compared without outer white space; lines without
    a word are never counted and stay.  A null host counts as the host ''; a null
    text stays null; repeated rows count as pages each, or with ``copies_once``
    equal texts of a host as one page, so that a copied document isn't taken for
    boilerplate; a text of which every line goes becomes empty and its row stays.
    ``min_pages`` keeps lines of small hosts.  An empty table stays empty.
    ``dropped_col``, if given, gets the number of lines dropped; if ``pages`` has
    a column of that name, the new one's gets a ``_``.

    Boilerplate of up to ``broadcast_bytes`` bytes, host names counted, is
    broadcast; beyond that, hosts are joined by a shuffle with the same result.
    """
    host, bad, drop, own, hit = free_name(pages, "_host", "_bad", "_lines", "_own", "_hit")
    found = stash(boilerplate(pages, text_col, host_col, ratio, min_pages, copies_once), "boilerplate")
    by_host = found.groupBy(F.col("host").alias(host)).agg(F.sort_array(F.collect_list("line_hash")).alias(bad))
    size = by_host.agg(F.coalesce(F.sum(F.size(bad) * 8 + F.octet_length(host) + 64), F.lit(0)).alias("b")).first()["b"]
    if size <= broadcast_bytes:
        by_host = F.broadcast(by_host)
    text = F.col(f"`{text_col}`")
    joined = pages.withColumn(host, F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))).join(by_host, host, "left")
    # A hash set a page finds the few lines that go; a page's lines are then looked up among these alone.
    joined = joined.withColumn(own, F.when(F.col(bad).isNotNull(), F.transform(_lines(text), _hash)))
    joined = joined.withColumn(hit, F.array_intersect(own, bad))
    kept = joined.withColumn(drop, F.when(F.size(hit) > 0, F.filter(_lines(text), lambda x, i: ~F.array_contains(hit, F.get(own, i)))))
    out = [F.when(F.col(drop).isNull(), text).otherwise(F.array_join(drop, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    if dropped_col:
        out.append(F.when(F.col(drop).isNull(), 0).otherwise(F.size(_lines(text)) - F.size(drop)).alias(free_name(pages, dropped_col)[0]))
    return kept.select(*out)


def page_lines(html: Column) -> Column:
    """The text of an HTML page, one line a block: scripts, styles, comments and tags go; null stays null."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|tr|table|article|section|header|footer|title|body|head|html)(?:\s[^<>]*)?/?>", "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, r"<[^<>]*>", ""), r"[ \t\r]+", " ")
    return F.btrim(F.regexp_replace(plain, r" ?\n[ \n]*", "\n"), F.lit(SPACES))


def page_host(url: Column) -> Column:
    """The host of an address in lower case; '' for null and for what is no address."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
