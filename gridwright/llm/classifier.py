"""Quality classifier: random Fourier features over document statistics.

Statistics of a whole text (one pass, no shuffle) are standardised and mapped to
random cosines, whose inner products approximate a Gaussian kernel.  Normal
equations are summed over partitions, the ridge solution scores documents, and
isotonic calibration over score bins turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_blas_thread, stash

#: Folds by which scores are calibrated.
FOLDS = 5

STATS = ["log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "other_mark", "stop", "space", "distinct", "repeat_next", "top_word", "dup_lines", "log_lines", "line_words", "long_words", "short_words", "entropy", "wide"]

_UPPER, _DIGIT, _SYMBOL, _BANG, _PIPE, _STOP, _SPACE, _OTHER = (np.zeros(256, bool) for _ in range(8))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"#*$%&<>=@^~\\{}[]_+")] = True
_BANG[list(b"!?")] = True
_PIPE[list(b"|")] = True
_STOP[list(b".,;:")] = True
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_OTHER[list(b"\"'()-/`")] = True


def statistics(text: str | None) -> list[float]:
    """The numbers of STATS for one whole text; an empty one has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = count[count > 0] / size
    share = lambda mask: float(count[mask].sum()) / size
    return [
        np.log1p(n), float(lengths.mean()), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_BANG), share(_PIPE), share(_OTHER), share(_STOP), share(_SPACE),
        len(kinds) / n ** 0.8, again / n, max(kinds.values()) / n, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(n / len(lines)),
        float((lengths > 14).mean()), float((lengths < 3).mean()), float(-(p * np.log(p)).sum()), float(count[128:].sum()) / size,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, len(STATS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATS)), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    freqs: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.freqs + self.phases), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit by pooling adjacent violators."""
    level: list[list[float]] = []
    for v, w in zip(value, weight):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level.pop()
            level.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in level]) if level else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def train(rows: DataFrame, waves: int = 256, width: float = 4.0, ridge: float = 1.0, bins: int = 200, seed: int = 0, parts: int = 32) -> Model | None:
    """Fit on ``rows`` (x, label 0/1), a stashed table; None without rows of both labels.

    All rows are used.  Every task sums one matrix of (waves+1) squared numbers
    a fold, ``parts`` tasks a fold sum those, and only their sums and ``bins`` counts reach
    the driver.  For calibration a row is scored by the weights of the other
    folds; the final weights are of all rows.  Equal rows are in one fold.
    """
    one_blas_thread()
    spark = rows.sparkSession
    rows = rows.select("x", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold"))
    n_stats = len(STATS)
    cols = [F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(n_stats)] + [F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(n_stats)]
    got = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *cols).first()
    if not got["n"] or not 0 < got["ones"] < got["n"]:
        return None
    rng = np.random.default_rng(seed)
    centre = np.array([got[f"m{k}"] for k in range(n_stats)])
    spread = np.array([got[f"s{k}"] for k in range(n_stats)]) + 1e-6
    model = Model(centre, spread, rng.normal(0, 1 / width, (n_stats, waves)), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.0]), np.array([0.0]))
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, {}
        for batch in batches:
            f, y, fold = m.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(fold).tolist():
                own = f[fold == k]
                total[k] = total.get(k, 0) + np.column_stack((own.T @ own, own.T @ y[fold == k]))
        task = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([task % parts] * len(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "fold", "s"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((waves + 1) * (waves + 2))
        for batch in batches:
            for one in batch.column(2):
                total += np.frombuffer(one.as_py())
        yield pa.record_batch([pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["fold", "s"])

    total = np.zeros((FOLDS, waves + 1, waves + 2))
    summed = rows.mapInArrow(sums, "part int, fold int, s binary").groupBy("part", "fold").applyInArrow(added, "fold int, s binary")
    for r in summed.toLocalIterator():
        total[r["fold"]] += np.frombuffer(r["s"]).reshape(waves + 1, waves + 2)
    penalty = ridge * np.eye(waves + 1)
    penalty[-1, -1] = 1e-6
    solved = lambda t: np.linalg.solve(t[:, :-1] + penalty, t[:, -1])
    model.weights = solved(total.sum(axis=0))
    others = spark.sparkContext.broadcast(np.stack([solved(total.sum(axis=0) - t) for t in total], axis=1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.features(_matrix(batch.column(0))) @ others.value
            raw = np.clip(raw[np.arange(len(raw)), batch.column(2).to_numpy(zero_copy_only=False)], -1, 2)
            yield pa.record_batch([pa.array(np.floor((raw + 1) / 3 * bins).astype(np.int32)), pa.array(raw), batch.column(1)], names=["bin", "raw", "label"])

    counts = rows.mapInArrow(binned, "bin int, raw double, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("label").alias("y")).orderBy("bin").collect()
    model.knots = np.array([r["raw"] for r in counts])
    model.levels = isotonic(np.array([r["y"] for r in counts]), np.array([float(r["n"]) for r in counts]))
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of rows (doc_id, x); without a model every score is 0."""
    if model is None:
        return stats.select("doc_id", F.lit(0.0).alias("score"))
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_every: int = 5) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``.

    held_out: crc32 of the id as text is divisible by ``held_out_every``; only
    the labels of other rows are learned.  Null and empty texts are scored by
    all-zero statistics; a null id is not held out and has no label; repeated
    rows are each returned; without labels of both kinds all scores are 0.
    """
    stats = stash(with_statistics(docs), "statistics")
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"), held_out_every)).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    model = train(stash(stats.join(known, "doc_id").select("x", "label"), "quality-labels"))
    return score(stats, model).select("doc_id", F.coalesce(held_out(F.col("doc_id"), held_out_every), F.lit(False)).alias("held_out"), "score")


def held_out(doc_id: Column, every: int = 5) -> Column:
    """Whether a row's labels are for evaluation only; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % every == 0
