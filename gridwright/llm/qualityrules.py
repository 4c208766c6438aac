"""Quality rules with cross-document line frequency.

Base rules look at one text.  The cross-document rule hashes normalised lines,
counts the distinct documents of each host that have a line, removes lines above
the limit and rejects documents of which too little is left.  Built-in
functions only; nothing but counts and hashes is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, stash, words_of

SYMBOLS = r"[#*$%&|<>]"


def _repeat_words(hashes: Column, n: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more, from the words' hashes."""
    starts = F.sequence(F.lit(0), n - width)
    window = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, width)))
    return F.when(n < width, F.array().cast("array<bigint>")).otherwise(window)


def measured(docs: DataFrame, text_col: str = "text", width: int = 8) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), by whole texts.

    A null text has no words.  Each step is a projection over the one before,
    so the word array, its hashes and their windows are made once a row.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    q, kept_lines = free_name(docs, "_q", "_lines")
    df = docs.withColumn(q, F.struct(words_of(text).alias("w")))
    df = df.withColumn(q, F.struct(F.size(f"{q}.w").alias("n"), F.aggregate(f"{q}.w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("chars"), F.transform(f"{q}.w", lambda w: F.xxhash64(w)).alias("h")))
    df = df.withColumn(q, F.struct(f"{q}.n", f"{q}.chars", _repeat_words(F.col(f"{q}.h"), F.col(f"{q}.n"), width).alias("win")))
    again = F.size(f"{q}.win") > F.size(F.array_distinct(f"{q}.win"))
    numbered = F.when(again, F.array_sort(F.transform(f"{q}.win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn(q, F.struct(f"{q}.n", f"{q}.chars", numbered.alias("win")))
    win = F.col(f"{q}.win")
    # Neighbours in the sorted windows: equal hashes mark both places as covered.
    last = F.size(win)
    shifted = F.when(win.isNotNull(), F.zip_with(F.slice(win, 1, last - 1), F.slice(win, 2, last - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    df = df.withColumn(q, F.struct(f"{q}.n", f"{q}.chars", F.sort_array(F.array_distinct(F.flatten(shifted))).alias("at")))
    at = F.col(f"{q}.at")
    gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(width)))
    covered = F.when(at.isNull() | (F.size(at) == 0), 0).otherwise(F.aggregate(gaps, F.lit(0), lambda a, b: a + b) + width)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return (
        df.withColumn("n_words", F.col(f"{q}.n").cast("long"))
        .withColumn("word_chars", F.col(f"{q}.chars"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn(kept_lines, lines)
        .withColumn("n_dup_lines", (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long"))
        .drop(q, kept_lines)
    )


def _normal(line: Column) -> Column:
    """A line for comparison: lower case, digits as 0, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(SPACES))), r"[\x20\x09-\x0D]+", " "), r"[0-9]+", "0")


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _hashes(lines: Column) -> Column:
    """Hashes of lines for comparison."""
    return F.transform(lines, lambda x: F.xxhash64(_normal(x)))


def common_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """(host, lines): hashes of the lines that ``min_docs`` or more distinct texts of a host have, and more than ``max_share`` of them.

    Exact copies count once, so a copied document isn't taken for boilerplate.  A
    host has at most (lines a text) / ``max_share`` such lines.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("digest"), F.array_distinct(_hashes(_lines(text))).alias("lines"))
    texts = stash(own.groupBy("host", "digest").agg(F.first("lines").alias("lines")), "line-hashes")
    totals = texts.groupBy("host").agg(F.count("*").alias("texts"))
    seen = texts.select("host", F.explode("lines").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    common = seen.join(totals, "host").where(F.col("n") > max_share * F.col("texts"))
    return stash(common.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("lines")), "common-lines")


def judged(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat: int = 30, min_docs: int = 20, max_share: float = 0.02, min_left: float = 0.3, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Every row of ``docs`` without its common lines, and the struct ``quality`` of the counts and verdicts.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` % of
    them in repeated 8-word windows.  A document is depleted if, without common
    lines (see ``common_lines``), it has under ``min_words`` words or under
    ``min_left`` of its words; kept is neither failed nor depleted.  Counts are of
    the whole text as it came.  Null texts have no words, fail and stay null; a
    null host is the host ''; repeated rows are each returned; an empty table gives
    an empty result.  If ``docs`` has a column quality, the struct's name gets a ``_``.
    Common lines of up to ``broadcast_bytes`` bytes, host names counted, are
    broadcast; beyond that, hosts are joined by a shuffle with the same result.
    """
    host, bad, q, hit, quality = free_name(docs, "_host", "_bad", "_m", "_hit", "quality")
    common = common_lines(docs, text_col, host_col, min_docs, max_share).select(F.col("host").alias(host), F.col("lines").alias(bad))
    size = common.agg(F.coalesce(F.sum(F.size(bad) * 8 + F.octet_length(host) + 64), F.lit(0)).alias("b")).first()["b"]
    text = F.col(f"`{text_col}`")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), text.alias("text"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias(host))
    df = measured(own, "text").join(F.broadcast(common) if size <= broadcast_bytes else common, host, "left")
    # The few common lines of a row are found by a hash set; its lines are looked up among these alone.
    df = df.withColumn(q, F.when(F.col(bad).isNotNull(), _hashes(_lines(F.col("text"))))).withColumn(hit, F.array_intersect(q, bad))
    gone = F.filter(_lines(F.col("text")), lambda x, i: F.array_contains(hit, F.get(q, i)))
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + F.size(words_of(x)))
    df = df.withColumn("lost", F.when(F.size(hit) > 0, lost).otherwise(0))
    df = df.withColumn("n_words_left", F.col("n_words") - F.col("lost"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (F.col("lost") > 0) & ((F.col("n_words_left") < min_words) | (F.col("n_words_left") < min_left * F.col("n_words")))
    verdict = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_words_left")
    stays = F.filter(F.split("text", "\n", -1), lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains(hit, F.xxhash64(_normal(x))))
    cleaned = F.when(F.col("lost") > 0, F.array_join(stays, "\n")).otherwise(F.col("text"))
    return df.select(*[cleaned.alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns], verdict.alias(quality))


def drop_failed(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their common lines; columns are those of ``docs``, odd rows as in ``judged``."""
    done = judged(docs, **limits)
    return done.where(F.col(done.columns[-1]).getField("kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def rules(docs: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """(doc_id, the counts and verdicts of ``judged``) for every row; a null id stays null."""
    done = judged(docs, **limits)
    return done.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(done.columns[-1]).alias("q")).select("doc_id", "q.*")
