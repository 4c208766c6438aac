"""Scores of extracted tables against the truth."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rows as R


def grid_distances(pairs: DataFrame, left: str = "t1", right: str = "t2", ignore_comma: bool = False) -> DataFrame:
    return pairs.withColumn("distance", R.grid_distance(F.col(left), F.col(right), ignore_comma))


def compare_files(parsed: DataFrame, truth: DataFrame, key: str = "name") -> DataFrame:
    """(key, distance) of grids that share a key."""
    both = parsed.select(key, F.col("grid").alias("t1")).join(truth.select(key, F.col("grid").alias("t2")), key)
    return grid_distances(both).select(key, "distance")


Node = tuple[str, int, int, str]


def _post_order(html: str) -> tuple[list[Node], list[int]]:
    """Nodes (tag, colspan, rowspan, text) in post-order and each one's leftmost leaf, of the tree table > tr > td."""
    from ..sources.html import parse

    nodes: list[Node] = []
    left: list[int] = []
    for table in parse(html).tables[:1]:
        for row in table.rows:
            first = len(nodes)
            for cell in row:
                left.append(len(nodes))
                nodes.append(("td", cell.colspan, cell.rowspan, cell.value()))
            left.append(first)
            nodes.append(("tr", 1, 1, ""))
        left.append(0)
        nodes.append(("table", 1, 1, ""))
    return nodes, left


def text_distance(a: str, b: str) -> float:
    """Edits from one text to the other, as a share of the longer one."""
    if a == b:
        return 0.0
    last = list(range(len(b) + 1))
    for x in a:
        now = [last[0] + 1]
        for k, y in enumerate(b):
            now.append(min(now[k] + 1, last[k + 1] + 1, last[k] + (x != y)))
        last = now
    return last[-1] / max(len(a), len(b))


def rename_cost(a: Node, b: Node) -> float:
    """1 between unlike tags or spans, else the distance of the texts."""
    return 1.0 if a[:3] != b[:3] else text_distance(a[3], b[3])


def tree_distance(a: tuple[list[Node], list[int]], b: tuple[list[Node], list[int]]) -> float:
    """Ordered tree edit distance over key roots: 1 for a node more or less, ``rename_cost`` for another."""
    (la, fa), (lb, fb) = a, b
    cost = functools.cache(lambda s, t: rename_cost(la[s], lb[t]))
    roots = lambda first: sorted({leaf: k for k, leaf in enumerate(first)}.values())
    dist = [[0.0] * len(lb) for _ in la]
    for i in roots(fa):
        for j in roots(fb):
            p, q = fa[i], fb[j]
            forest = [[0.0] * (j - q + 2) for _ in range(i - p + 2)]
            for x in range(1, i - p + 2):
                forest[x][0] = x
            for y in range(1, j - q + 2):
                forest[0][y] = y
            for x in range(1, i - p + 2):
                for y in range(1, j - q + 2):
                    s, t = p + x - 1, q + y - 1
                    drop = min(forest[x - 1][y], forest[x][y - 1]) + 1
                    if fa[s] == p and fb[t] == q:
                        forest[x][y] = dist[s][t] = min(drop, forest[x - 1][y - 1] + cost(s, t))
                    else:
                        forest[x][y] = min(drop, forest[fa[s] - p][fb[t] - q] + dist[s][t])
    return dist[-1][-1] if la and lb else float(max(len(la), len(lb)))


def tree_similarity(left: str, right: str) -> float:
    """1 - distance / nodes of the larger tree; two documents without a table are alike."""
    a, b = _post_order(left), _post_order(right)
    most = max(len(a[0]), len(b[0]))
    return 1 - tree_distance(a, b) / most if most else 1.0


def teds(pairs: DataFrame, left: str = "html1", right: str = "html2") -> DataFrame:
    """``pairs`` with teds, the tree similarity of the first table of either HTML."""
    schema = pairs.withColumn("teds", F.lit(0.0)).schema
    i, j = pairs.columns.index(left), pairs.columns.index(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [tree_similarity(x or "", y or "") for x, y in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "teds"])

    return pairs.mapInArrow(run, schema)
