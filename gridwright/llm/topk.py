"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every dimension is a term with a posting for each row whose component isn't 0.
Query blocks meet candidate blocks on a grid; in a cell the queries' terms
scatter weighted postings into dense score arrays, the best k of each query are
selected, and a window merges the cells' results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Rows and queries of a cell at most, and rows at least where there are fewer cells than cores.
CANDIDATES = 1 << 17
QUERIES = 1 << 12
FEWEST = 1 << 12
#: Scores that a task holds at once.
SCORES = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of ``scores``, ties to the first place; ``ids`` must rise."""
    if len(scores) <= k:
        at = np.arange(len(scores))
    else:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > edge)
        at = np.concatenate([over, np.flatnonzero(scores == edge)[: k - len(over)]])
    return at[np.lexsort((ids[at], -scores[at]))]


def postings(rows: np.ndarray) -> list[np.ndarray]:
    """Each term's rows."""
    return [np.flatnonzero(rows[:, t]) for t in range(rows.shape[1])]


def accumulate(queries: np.ndarray, rows: np.ndarray, posted: list[np.ndarray] | None = None) -> np.ndarray:
    """Scores of every query against every row, one term at a time."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for t, at in enumerate(postings(rows) if posted is None else posted):
        asking = np.flatnonzero(queries[:, t])
        if not len(at) or not len(asking):
            continue
        if len(at) == len(rows) and len(asking) == len(queries):
            scores += queries[:, t, None] * rows[None, :, t]
        else:
            scores[np.ix_(asking, at)] += queries[asking, t, None] * rows[None, at, t]
    return scores


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product.

    Components are floor(scale * x).  A query's own row (any row with its id) is
    no candidate; ties go to the smaller id; queries with fewer than k candidates
    get them all.  Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without an id; a row meets only vectors
    of its own length; repeated rows are candidates each; an empty table gives an
    empty result; further columns aren't read.  Components so large that a score
    could pass 64 bits raise OverflowError.

    Cells are as large as a task's memory allows, so a row is sent to few of them.
    """
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") > 0))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")) * scale))
    own = stash(own.select("id", whole(F.col("v"), scale).alias("v"), "asks", largest.alias("largest")), "vectors")
    size = own.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("largest").alias("m"), F.max(F.size("v")).alias("width")).first()
    if size["n"] and (size["m"] + 1) ** 2 * size["width"] >= 2.0**62:
        raise OverflowError(f"components up to {size['m'] / scale:g} are too large for 64-bit scores")
    slots = own.sparkSession.sparkContext.defaultParallelism
    across, down = max(-(-size["n"] // CANDIDATES), min(slots, -(-size["n"] // FEWEST)), 1), -(-size["q"] // QUERIES) or 1
    spread = F.xxhash64("id", F.lit(7))
    rows = own.select(F.pmod(spread, F.lit(across)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("b"), "id", "v", F.lit(False).alias("asks"))
    asked = own.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"), F.pmod(spread, F.lit(down)).cast("int").alias("b"), "id", "v", "asks")

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        (q_ids, q_vec), (c_ids, c_vec) = _arrays(left), _arrays(right)
        for width in {len(v) for v in q_vec}:
            qa = np.array([len(v) == width for v in q_vec])
            ca = np.array([len(v) == width for v in c_vec], bool)
            qi, ci = q_ids[qa], c_ids[ca]
            if not len(ci):
                continue
            qm = np.stack([v for v, x in zip(q_vec, qa) if x])
            cm = np.stack([v for v, x in zip(c_vec, ca) if x])
            order = np.argsort(ci, kind="stable")
            ci, cm = ci[order], np.ascontiguousarray(cm[order])
            step, posted = max(1, SCORES // len(ci)), postings(cm)
            for a in range(0, len(qi), step):
                for q, s in zip(qi[a : a + step], accumulate(qm[a : a + step], cm, posted)):
                    other = ci != q
                    at = best(s[other], ci[other], k) if not other.all() else best(s, ci, k)
                    pick = np.flatnonzero(other)[at] if not other.all() else at
                    out.append((np.full(len(pick), q), ci[pick], s[pick]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    met = asked.groupBy("c", "b").cogroup(rows.groupBy("c", "b")).applyInArrow(cell, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _arrays(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = t.column("id").to_numpy()
    lists = t.column("v").combine_chunks()
    if not len(ids):
        return ids, []
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    return ids, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
