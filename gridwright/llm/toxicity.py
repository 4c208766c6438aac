"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks, trained on sentences.

Strings are compared by the gap-weighted subsequence kernel: common character
triples count, gapped ones less, so an insult with inserted or missing characters
stays close to the plain one.  The training rows are the sentences of labelled
documents, each with its document's label.  Most sentences of a toxic document
are harmless, so the machine is fitted in rounds: first on kernel values of whole
sentences; then each sentence is represented by its span of the highest decision,
as in multiple-instance learning, and weighs as much as that span tells toxic
sentences from clean ones.  The machine is linear in kernel values and collapses
into one table over triples.  A sentence's decision is that of its highest span;
a document's score comes from its sentences' decisions by a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, one_blas_thread, stash

#: Triples of any characters are hashed to so many bits: the size of the model, 4 MB.
BITS = 20
GAPS = (1, 2, 3)
DECAY = 0.5
LONGEST = 24  # a longer word is read in overlapping windows of this many letters
CACHE = 400_000
#: Sentences whose triples are held at once.
CHUNK = 200
#: Deviations by which the number of toxic documents with a span is lowered: one document's words don't tell.
DOUBT = 2.0
RIDGE = 1e-4

_NOISE = re.compile(r"[^\w\s]|[\d_]")
_SPELLED = re.compile(r"(?<!\S)\w(?:[^\S\n]\w){3,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.?])\s|\n")


def sentences(text: str | None) -> list[list[str]]:
    """Sentences as lower-case words without digits and signs; letters spelled out one by one are also joined."""
    bare = _NOISE.sub("", _SENTENCE.sub("\n", (text or "").lower()))
    bare = _SPELLED.sub(lambda m: re.sub(r"\s", "", m[0]) + " " + m[0], bare)
    return [own for line in bare.split("\n") if (own := line.split())]


def windows(word: str) -> list[str]:
    """The spans of a word: itself, or overlapping windows of a long one."""
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def triples(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) array of hashed triples, -1 for none, and the weights of the places."""
    width = max(map(len, some)) + 2
    grid = np.zeros((len(some), width + 2 * max(GAPS)), np.uint32)
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    flat = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(some)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grid[row, at + 1] = flat + 3
    grid[:, 0] = 1  # opens
    grid[np.arange(len(some)), lengths + 1] = 2  # closes
    first = grid[:, :width]
    out, weights = [], []
    for a in GAPS:
        second = grid[:, a : a + width]
        pair = first * np.uint32(0x9E3779B1) + second
        for b in GAPS:
            third = grid[:, a + b : a + b + width]
            h = pair * np.uint32(0x85EBCA77) + third
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)
            out.append(np.where((first > 0) & (second > 0) & (third > 0), h.astype(np.int32), -1))
            weights.append(np.full(width, DECAY ** (a + b - 2)))
    return np.concatenate(out, axis=1), np.concatenate(weights)


def features(some: list[str], owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length: row, triple, value.  ``owner`` gives the row of each string; rows without a string are none."""
    codes, weights = triples(some)
    row, col = np.nonzero(codes >= 0)
    key = (row if owner is None else owner[row]).astype(np.int64) << BITS | codes[row, col]
    order = np.argsort(key, kind="stable")
    key, value = key[order], weights[col[order]]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    value, key = np.add.reduceat(value, start), key[start]
    row = key >> BITS
    return row, key & ((1 << BITS) - 1), value / np.sqrt(np.bincount(row, value**2))[row]


class Landmarks:
    """Strings that others are compared with; each is a list of spans, a sentence or a single one."""

    def __init__(self, strings: list[list[str]]):
        self.n = len(strings)
        row, code, value = features([w for s in strings for w in s], np.repeat(np.arange(self.n), [len(s) for s in strings]))
        self.codes, at = np.unique(code, return_inverse=True)
        self.rows = np.zeros((len(self.codes), self.n), np.float32)
        self.rows[at, row] = value

    def kernel(self, strings: list[list[str]]) -> np.ndarray:
        """Kernel values of strings with the landmarks."""
        out = np.zeros((len(strings), self.n), np.float32)
        for k in range(0, len(strings), CHUNK):
            some = strings[k : k + CHUNK]
            row, code, value = features([w for s in some for w in s], np.repeat(np.arange(len(some)), [len(s) for s in some]))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == code)
            if len(hit):
                row, at, value = row[hit], at[hit], value[hit].astype(np.float32)
                start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                out[k + row[start]] = np.add.reduceat(self.rows[at] * value[:, None], start, axis=0)
        return out

    def machine(self, kernel: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Table over triples and bias of the machine fitted to ``kernel``; ``own``: the landmarks' among themselves."""
        power, basis = np.linalg.eigh(own.astype(np.float64))
        keep = power > 1e-6 * power.max()
        half = basis[:, keep] / np.sqrt(power[keep])
        cost = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
        w, bias = svm(kernel @ half, y, cost, RIDGE)
        table = np.zeros(1 << BITS, np.float32)
        table[self.codes] = self.rows @ (half @ w)
        return table, float(bias)


def decide(some: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Decision values of words; a long word has that of its highest window."""
    if not some:
        return np.zeros(0)
    cut = [windows(w) for w in some]
    row, code, value = features([x for c in cut for x in c])
    one = np.bincount(row, value * table[code], sum(map(len, cut))) + bias
    return np.maximum.reduceat(one, np.cumsum([0] + [len(c) for c in cut[:-1]]))


def highest(word: str, table: np.ndarray, bias: float) -> str:
    """The span of a word that has its decision."""
    cut = windows(word)
    return cut[int(np.argmax(decide(cut, table, bias)))] if len(cut) > 1 else word


class Decisions:
    """Decisions of words, remembered."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.known = table, bias, {}

    def learn(self, some: dict[str, None]) -> None:
        new = [w for w in some if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(some)
        for k in range(0, len(new), 20_000):
            self.known.update(zip(new[k : k + 20_000], decide(new[k : k + 20_000], self.table, self.bias).tolist()))


@dataclass
class Model:
    """What scoring needs; 4 MB, whatever the corpus."""

    table: np.ndarray
    bias: float
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def features(self, texts: list[str | None], known: Decisions) -> np.ndarray:
        """Per document: three highest sentence decisions, log of the positive ones, their share."""
        own = [sentences(t) for t in texts]
        known.learn(dict.fromkeys(w for said in own for s in said for w in s))
        out = np.full((len(own), 5), -1.0)
        out[:, 3:] = 0
        for r, said in enumerate(own):
            if said:
                one = np.fromiter((known.known[w] for s in said for w in s), np.float64)
                d = np.maximum.reduceat(one, np.cumsum([0] + [len(s) for s in said[:-1]]))
                top = -np.partition(-d, min(2, len(d) - 1))[:3]
                top = -np.sort(-top)
                out[r, : len(top)] = np.maximum(top, -1.0)
                on = int((d > 0).sum())
                out[r, 3:] = math.log1p(on), math.log1p(100 * on / len(d))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Primal L2 support vector machine by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(40):
        xa, ca = x[active], cost[active]
        w = np.linalg.solve(eye + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        now = y * (x @ w) < 1
        if np.array_equal(now, active):
            break
        active = now
    return w[:-1], w[-1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(eye + (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p) - eye @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _said(rows: DataFrame, most: int) -> DataFrame:
    """(h, words, label, doc): the distinct sentences of ``rows`` (text, label), at most ``most`` of each label by their hash.

    A sentence that clean documents have too is clean; copies count once and belong to one document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, y, doc = [], [], [], []
            for text, label, key in zip(*(c.to_pylist() for c in batch.columns)):
                for own in sentences(text):
                    h.append(" ".join(own))
                    w.append(list(dict.fromkeys(own)))
                    y.append(label)
                    doc.append(key)
            yield pa.record_batch([pa.array(h, pa.string()), pa.array(w, pa.list_(pa.string())), pa.array(y, pa.int32()), pa.array(doc, pa.int64())], names=["h", "words", "label", "doc"])

    said = rows.select("text", "label", F.xxhash64("text").alias("doc")).mapInArrow(cut, "h string, words array<string>, label int, doc long")
    said = stash(said.groupBy(F.xxhash64("h").alias("h")).agg(F.min("label").alias("label"), F.min("doc").alias("doc"), F.first("words").alias("words")), "said")
    kept = [said.where(F.col("label") == y).orderBy("h").limit(most) for y in (1, 0)]
    return stash(kept[0].union(kept[1]), "said")


def _whole(said: DataFrame, most: int, landmarks: int) -> tuple[np.ndarray, float]:
    """The machine of kernel values of whole sentences, at most ``most`` of each label."""
    some = [said.where(F.col("label") == y).orderBy("h").limit(most) for y in (1, 0)]
    some = stash(some[0].union(some[1]).select("words", "label", "h"), "said")
    marks = [r["words"] for y in (1, 0) for r in some.where(F.col("label") == y).orderBy("h").select("words").limit(landmarks // 2).collect()]
    ground = Landmarks([[x for w in s for x in windows(w)] for s in marks])
    shared = said.sparkSession.sparkContext.broadcast(ground)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = shared.value.kernel([[x for w in s for x in windows(w)] for s in batch.column(0).to_pylist()])
            yield pa.record_batch([batch.column(1), pa.array(list(k), pa.list_(pa.float32()))], names=["label", "row"])

    got = some.mapInArrow(compare, "label int, row array<float>").toArrow()
    y = np.where(got.column(0).to_numpy() > 0, 1.0, -1.0)
    kernel = got.column(1).combine_chunks().flatten().to_numpy().reshape(len(y), ground.n)
    return ground.machine(kernel, ground.kernel([[x for w in s for x in windows(w)] for s in marks]), y, np.ones(len(y)))


def _spans(said: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """(span, toxic, clean, docs): the highest spans of sentences, with the number of sentences and toxic documents."""
    shared = said.sparkSession.sparkContext.broadcast((table, bias))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Decisions(*shared.value)
        for batch in batches:
            own = batch.column(0).to_pylist()
            known.learn(dict.fromkeys(w for s in own for w in s))
            span = [highest(max(s, key=known.known.__getitem__), *shared.value) for s in own]
            yield pa.record_batch([pa.array(span, pa.string()), batch.column(1), batch.column(2)], names=["span", "label", "doc"])

    found = said.select("words", "label", "doc").mapInArrow(best, "span string, label int, doc long")
    found = found.groupBy("span", "doc").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    return found.groupBy("span").agg(F.sum("t").alias("toxic"), F.sum("c").alias("clean"), F.count(F.when(F.col("t") > 0, 1)).alias("docs"))


def _refit(spans: list[tuple[str, float, float]], landmarks: int) -> tuple[np.ndarray, float]:
    """The machine of (span, weight among toxic, among clean sentences): one row a span and label, weighing as its sentences."""
    toxic = sorted(((s, t) for s, t, _ in spans if t > 0), key=lambda x: (-x[1], x[0]))
    clean = sorted(((s, c) for s, _, c in spans if c > 0), key=lambda x: (-x[1], x[0]))
    strings = [[s] for s, _ in toxic + clean]
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    weight = np.array([w for _, w in toxic + clean])
    # Landmarks: the heaviest toxic spans and the clean ones most like them.
    first = Landmarks(strings[: min(len(toxic), landmarks // 2)])
    near = first.kernel(strings[len(toxic) :]) @ weight[: first.n]
    marks = strings[: first.n] + [strings[len(toxic) + k] for k in np.argsort(-near, kind="stable")[: landmarks - first.n]]
    ground = Landmarks(marks)
    return ground.machine(ground.kernel(strings), ground.kernel(marks), y, weight)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", most_sentences: int = 60_000, landmarks: int = 200, rounds: int = 3) -> Model | None:
    """Fit on ``labelled`` (text, 0/1); None where one of the classes has no sentence.

    The sample is bounded: at most ``most_sentences`` distinct sentences of either
    label, by their hash, a fifth of them in the first fit.  What reaches the
    driver is bounded by that: kernel rows of the first fit, then one row for each
    span that represents clean sentences or tells toxic ones, and five numbers for
    each row of ``labelled``; bound those before (see ``sample``).  Null and
    wordless texts have no sentence; repeated rows count as one.
    """
    one_blas_thread()
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label is not null")
    said = _said(rows, most_sentences)
    total = said.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic = total["toxic"] or 0
    clean = total["n"] - toxic
    if not toxic or not clean:
        return None
    table, bias = _whole(said, max(1, most_sentences // 5), landmarks)
    # How far a span's share of toxic sentences, lowered by its doubt, exceeds its share of clean ones.
    least = F.col("toxic") / toxic * (1 - DOUBT / F.sqrt(F.greatest("docs", F.lit(1))))
    tells = F.when(least > 0, F.greatest(F.lit(0.0), 1 - (F.col("clean") + 1) / clean / least)).otherwise(0.0)
    for _ in range(rounds):
        found = stash(_spans(said, table, bias).withColumn("weight", F.col("toxic") * tells), "spans")
        some = found.where("weight > 0 or clean > 0").select("span", "weight", "clean").collect()
        if not any(r["weight"] > 0 for r in some):  # too few documents to tell: every sentence as labelled
            some = found.select("span", F.col("toxic").cast("double").alias("weight"), "clean").collect()
        if not any(r["clean"] > 0 for r in some):
            break
        table, bias = _refit([tuple(r) for r in some], landmarks)
    model = Model(table, bias, np.zeros(6), np.zeros(5), np.ones(5))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Decisions(m.table, m.bias)
        for batch in batches:
            x = m.features(batch.column(0).to_pylist(), known)
            yield pa.record_batch([*(pa.array(c) for c in x.T), batch.column(1)], names=["a", "b", "c", "d", "e", "y"])

    got = rows.mapInArrow(featured, "a double, b double, c double, d double, e double, y int").toArrow()
    x = np.column_stack([got.column(k).to_numpy() for k in range(5)])
    label = got.column(5).to_numpy().astype(float)
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic((x - model.centre) / model.spread, label)
    return model


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int = 20_000) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows, drawn by a hash of the id; ``docs`` isn't shuffled.

    Null ids and null labels take no part; of repeated labels the highest counts;
    rows of ``docs`` that share an id all take its label; empty tables give none.
    """
    drawn = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("label"))
    drawn = drawn.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stash(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "label"), "labelled")


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, made from whole texts in one pass without a shuffle.

    Null and wordless texts have the score of a document without any decision
    above -1; without a model every score is 0.  ``score_col`` must be free.
    """
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Decisions(m.table, m.bias)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                s = m.score(m.features(part.column(at).to_pylist(), known))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; the machine is fitted on ``labels`` (doc_id, toxic)."""
    (name,) = free_name(docs, "_toxicity")
    scored = score(docs, train(sample(docs, labels, "toxic", most)), score_col=name)
    return scored.where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
