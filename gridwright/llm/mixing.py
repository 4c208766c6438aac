"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected from 0 (all sources alike) to 1 (as they come), or
beyond for an entropy, so that the mix meets an entropy or a repetition limit.  Weights times a token
budget give each source a quota, taken from an endless stream of epochs: each
epoch of a source is a keyed permutation of its blocks, each block a keyed
permutation of its rows.  A quota is thus some whole epochs and the start of
one more, and whether a row is in it depends on the row's own keys and the
place of the cut alone.  Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD_GAP, free_name, stash

#: Rows a block holds on average; blocks are what windows run over.
BLOCK = 256
#: Exponents that one pass over the sources tries: bisection, five halvings at a time.
FAN = 32
#: Largest exponent: 1 takes sources as they come, more makes large ones larger yet, for an entropy below theirs.
STEEPEST = 8.0


@dataclass(frozen=True)
class Mix:
    """max_repeats or target_entropy (nats) sets the exponent; budget_tokens None: as
    many as let every row be taken at least once."""

    max_repeats: float | None = 1.5
    target_entropy: float | None = None
    budget_tokens: int | None = None
    seed: int = 0


def tokens_of(text: Column) -> Column:
    """Words of a text: the size that shares and budgets count."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(WORD_GAP)) + 1).cast("long")


def key_of(*parts: Column) -> Column:
    """A 60-bit keyed order, from MD5 so that other engines can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _weights(sources: DataFrame, exponent: float) -> DataFrame:
    """``sources`` (source, tokens, rows, _all) with weight, the normalised power of the share."""
    power = F.when(F.col("tokens") > 0, F.pow(F.try_divide("tokens", "_all"), F.lit(exponent))).otherwise(0.0)
    return sources.withColumn("_power", power).crossJoin(F.broadcast(sources.agg(F.sum(power).alias("_sum")))).withColumn("weight", F.coalesce(F.try_divide("_power", "_sum"), F.lit(0.0))).drop("_power", "_sum")


def bisect_exponent(sources: DataFrame, mix: Mix) -> float:
    """The smallest exponent within the repetition limit, or the largest that still has the entropy.

    Each pass evaluates FAN exponents over the source table in one aggregate, so
    only sums reach the driver, however many sources there are.
    """
    lo, hi = 0.0, 1.0 if mix.target_entropy is None else STEEPEST
    share = F.try_divide("tokens", "_all")
    tried = F.explode(F.sequence(F.lit(0), F.lit(FAN)))
    while hi - lo > 1e-7:
        step = (hi - lo) / FAN
        power = F.pow(share, F.col("_x"))
        sums = (
            sources.where("tokens > 0")
            .withColumn("_k", tried)
            .withColumn("_x", F.lit(lo) + F.col("_k") * F.lit(step))
            .groupBy("_k")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("zlog"), F.max(power / F.col("tokens")).alias("most"), F.min(power / F.col("tokens")).alias("least"), F.max("_all").alias("all"))
            .orderBy("_k")
            .collect()
        )
        if not sums:
            return 1.0

        def within(r) -> bool:
            if mix.target_entropy is not None:  # falls with the exponent: within while it is low
                return math.log(r["z"]) - r["zlog"] / r["z"] < mix.target_entropy
            budget = mix.budget_tokens if mix.budget_tokens is not None else r["z"] / r["least"]
            return r["most"] / r["z"] * budget <= (mix.max_repeats or math.inf) * (1 + 1e-12)

        first = next((r["_k"] for r in sums if within(r)), None)
        if first is None:  # no exponent meets it
            return hi
        if first == 0:
            return lo
        lo, hi = lo + (first - 1) * step, lo + first * step
    return min(1.0, math.ceil(hi * 1e6) / 1e6) if mix.target_entropy is None else math.floor(lo * 1e6) / 1e6  # on the side that meets the limit


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: weight, quota, full epochs, blocks, and the keys where the last epoch is cut.

    ``rows`` (read several times: a stashed table) has source, tokens, rowkey.
    """
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = stash(totals.coalesce(8), "sources")
    totals = totals.crossJoin(F.broadcast(totals.agg(F.sum("tokens").alias("_all"))))
    exponent = bisect_exponent(totals, mix)
    weighted = _weights(totals, exponent)
    if mix.budget_tokens is None:
        budget = weighted.where("tokens > 0").agg(F.max(F.try_divide("tokens", "weight")).alias("b"))
        weighted = weighted.crossJoin(F.broadcast(budget)).withColumn("quota", F.floor(F.coalesce("b", F.lit(0.0)) * F.col("weight") + 1e-6).cast("long")).drop("b")
    else:
        weighted = weighted.withColumn("quota", F.floor(F.col("weight") * F.lit(float(mix.budget_tokens)) + 1e-6).cast("long"))
    epochs = F.when(F.col("tokens") == 0, 1).otherwise(F.floor(F.try_divide("quota", "tokens"))).cast("long")
    weighted = weighted.withColumn("full_epochs", epochs).withColumn("rest", F.when(F.col("tokens") == 0, 0).otherwise(F.col("quota") - F.col("tokens") * F.col("full_epochs")))
    weighted = stash(weighted.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long")).withColumn("exponent", F.lit(exponent)).drop("_all"), "quotas")
    # The cut: first the block, then the row, at which the running size passes the rest.
    keyed = with_keys(rows.join(_small(weighted.select("source", "blocks", "full_epochs", "rest")), "source"), F.col("full_epochs"), mix.seed)
    sizes = keyed.groupBy("source", "block", "block_key", "rest").agg(F.sum("tokens").alias("n"))
    # Running sums of block sizes in two levels, so no window holds a source's blocks at once.
    sizes = stash(sizes.withColumn("band", F.shiftright("block_key", 48)), "blocks")
    band = sizes.groupBy("source", "band").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    band = band.select("source", "band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("band_start"))
    inside = Window.partitionBy("source", "band").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("band_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = sizes.join(band, ["source", "band"]).withColumn("start", start)
    cut = placed.where("start <= rest and start + n > rest").select("source", "block", F.col("block_key").alias("cut_block_key"), F.col("block").alias("cut_block"), (F.col("rest") - F.col("start")).alias("room"))
    last = keyed.select("source", "block", "row_key", "tokens").join(_small(cut), ["source", "block"])
    last = last.groupBy("source", "row_key", "room").agg(F.sum("tokens").alias("tokens"))  # repeated rows are one
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("row_key").rangeBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", run).where("upto <= room").groupBy("source").agg(F.max("row_key").alias("cut_row_key"))
    ends = cut.select("source", "cut_block_key", "cut_block").join(last, "source", "left")
    return stash(weighted.join(ends, "source", "left"), "mix-plan")


def with_keys(rows: DataFrame, epoch: Column, seed: int) -> DataFrame:
    block = F.pmod(key_of(F.lit(seed), F.col("rowkey")), F.greatest(F.col("blocks"), F.lit(1)))
    out = rows.withColumn("block", block)
    return out.withColumn("block_key", key_of(F.lit(seed), F.lit("b"), F.col("source"), F.col("block"), epoch)).withColumn("row_key", key_of(F.lit(seed), F.lit("r"), F.col("rowkey"), epoch))


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast ``df`` if it has few rows and short sources; otherwise Spark joins it by a shuffle."""
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= most and size["bytes"] <= 64 * most else df


def mixed(docs: DataFrame, mix: Mix = Mix(), source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keys: bool = False) -> DataFrame:
    """``docs`` with each row as often as its source's quota takes it.

    Sizes are words; a null or wordless text has size 0 and is taken once an
    epoch; a null source is the source ''; the keys of a row come from its id
    and text, so repeated rows are taken together; an empty table stays empty, one
    without a word gives every row once.  Where no exponent meets the limit it is
    the largest.  ``keys`` adds epoch, block, block_key, row_key, tokens and weight, the
    order of each source's stream; a name that ``docs`` has gets a ``_``.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")) if docs.columns else docs
    text, ident = F.col("d").getField(text_col), F.col("d").getField(id_col)
    source = F.coalesce(F.col("d").getField(source_col).cast("string"), F.lit(""))
    own = own.select("d", source.alias("source"), F.concat_ws(":", ident.cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string")).alias("rowkey"), tokens_of(text).alias("tokens"))
    made = plan(stash(own.select("source", "tokens", "rowkey"), "mix-rows"), mix)
    made = made.select("source", "weight", "full_epochs", "blocks", "cut_block_key", "cut_block", "cut_row_key")
    taken = own.join(_small(made), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_epochs"))))
    taken = with_keys(taken, F.col("epoch"), mix.seed)
    at, end = F.struct("block_key", "block"), F.struct(F.col("cut_block_key").alias("block_key"), F.col("cut_block").alias("block"))
    started = F.coalesce((at < end) | ((at == end) & (F.col("row_key") <= F.col("cut_row_key"))), F.lit(False))
    taken = taken.where((F.col("epoch") < F.col("full_epochs")) | started)
    added = ["epoch", "block", "block_key", "row_key", "tokens", "weight"]
    named = [F.col(c).alias(name) for c, name in zip(added, free_name(docs, *added))]
    return taken.select("d.*", *(named if keys else []))
