"""Packing by cutting-stock column generation.

Texts longer than a sequence fill whole sequences; what is left of each is a
piece of some length.  Over the histogram of length classes a linear program
chooses patterns (multisets of classes that fit a sequence); a knapsack dynamic
program prices new ones.  Rounded pattern counts give every class a list of
slots, and the piece with the k-th rank in its class takes the k-th slot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_blas_thread, stash

#: Longer texts are encoded in stretches of about this many characters.
STRETCH = 1 << 18
#: Byte-level pre-splitting always cuts between a non-space and a space that a letter follows.
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")
#: Linear programs of up to this many length classes.
CLASSES = 256

PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, chunk int, class int, rank long, piece long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed value: how byte-level vocabularies of this family split a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "The quick  brown\n\n fox's 12 éèñ ß|##$ don't\tGO\u00a0x 4.5%\U0001f600 "


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    A faster engine works on the tokenizer file's own vocabulary, if that gives
    the tokenizer's ids on a probe text; texts that may hold special tokens go
    to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.twin = self._twin()

    def _twin(self):
        try:
            import tiktoken

            sign = {v: k for k, v in _byte_signs().items()}
            ranks = {bytes(sign[c] for c in token): k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items()}
            twin = tiktoken.Encoding("twin", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            return twin if twin.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids else None
        except (ImportError, KeyError, ValueError):
            return None

    def encode(self, text: str) -> bytes:
        if self.twin is None or "<|" in text:
            ids = [i for part in stretches(text) for i in self.tokenizer.encode(part, add_special_tokens=False).ids]
        else:
            ids = [i for part in stretches(text) for i in self.twin.encode_ordinary(part)] if len(text) > STRETCH else self.twin.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def stretches(text: str) -> list[str]:
    """``text`` in parts whose ids, one after another, are those of the whole."""
    out, at = [], 0
    while len(text) - at > STRETCH:
        m = _CUT.search(text, at + STRETCH)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def _byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a piece: at most ``budget`` ids (little-endian unsigned 32-bit), class and rank.

    Null texts count as empty: their piece is ``end_id`` alone.  chunk is the
    task; rank counts the pieces of one class within it, piece all of them.
    """
    step = -(-budget // CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(budget // step + 2, np.int64)
        made = 0
        encoder = Encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                ids, starts, lengths, totals, blobs, ranks = [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = encoder.encode(text or "") + end
                    n = len(tokens) // 4
                    for a in range(0, n, budget):
                        piece = tokens[4 * a : 4 * (a + budget)]
                        c = -(-len(piece) // 4 // step)
                        ids.append(doc_id)
                        starts.append(a)
                        lengths.append(len(piece) // 4)
                        totals.append(n)
                        blobs.append(piece)
                        ranks.append(seen[c])
                        seen[c] += 1
                n = np.array(lengths, np.int32)
                cols = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n), pa.array(totals, pa.int64()), pa.array(blobs, pa.binary()), pa.array(np.full(len(n), chunk, np.int32)), pa.array((-(-n // step)).astype(np.int32)), pa.array(ranks, pa.int64()), pa.array(np.arange(made, made + len(n)))]
                made += len(n)
                yield pa.record_batch(cols, names=["doc_id", "start", "length", "doc_tokens", "ids", "chunk", "class", "rank", "piece"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def price(dual: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of highest value: unbounded knapsack over classes 1..size, by dynamic programming."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        worth = dual[:room] + best[room - 1 :: -1][:room]
        k = int(np.argmax(worth))
        if worth[k] > best[room - 1] + 1e-12:
            best[room], took[room] = worth[k], k + 1
        else:
            best[room], took[room] = best[room - 1], 0
    pattern, room = np.zeros(size, np.int64), size
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[size]), pattern


def patterns(demand: np.ndarray, most_steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns with counts that cover ``demand`` (pieces by class 1..size) exactly.

    Column generation by the revised simplex method from one pattern a class,
    until the program is within 0.1 % of a lower bound on its optimum: the
    volume of the pieces, or Farley's bound from the best pattern's price.
    Fractions are rounded down and the rest, at most a pattern a class, goes
    first-fit in falling order.
    """
    one_blas_thread()
    size = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    m = len(used)
    columns = np.zeros((size, m))
    for j, c in enumerate(used):
        columns[c, j] = size // (c + 1)
    a = columns[used]
    need = demand[used].astype(float)
    inverse = np.diag(1 / np.diag(a))
    x = inverse @ need
    basis = [columns[:, j].astype(np.int64) for j in range(m)]
    floor = float(demand @ np.arange(1, size + 1)) / size
    for step in range(most_steps):
        dual = np.zeros(size)
        dual[used] = inverse.sum(axis=0)
        value, pattern = price(np.maximum(dual, 0), size)
        floor = max(floor, x.sum() / max(value, 1.0))
        if x.sum() <= 1.001 * floor:
            break
        pattern[np.setdiff1d(np.arange(size), used)] = 0
        d = inverse @ pattern[used]
        able = np.flatnonzero(d > 1e-9)
        ratio = x[able] / d[able]
        out = able[int(np.argmin(ratio))]
        x = x - d * (x[out] / d[out])
        x[out] = ratio.min()
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        basis[out] = pattern
        if step % 200 == 199:
            inverse = np.linalg.inv(np.array([b[used] for b in basis]).T.astype(float))
            x = np.maximum(inverse @ need, 0)
    left = demand.astype(np.int64).copy()
    out_patterns: list[tuple[np.ndarray, int]] = []
    for b, n in sorted(zip(basis, np.floor(x + 1e-9).astype(int)), key=lambda p: -p[1]):
        fits = b > 0
        n = min(n, int((left[fits] // b[fits]).min())) if fits.any() else 0
        if n > 0:
            out_patterns.append((b, int(n)))
            left -= b * n
    bins: list[np.ndarray] = []
    rooms: list[int] = []
    for c in range(size - 1, -1, -1):
        for _ in range(int(left[c])):
            k = next((k for k, r in enumerate(rooms) if r >= c + 1), None)
            if k is None:
                bins.append(np.zeros(size, np.int64))
                rooms.append(size)
                k = len(bins) - 1
            bins[k][c] += 1
            rooms[k] -= c + 1
    return out_patterns + [(b, 1) for b in bins]


def slots(found: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first slot, slots, each, first sequence, place) for every class in every pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in found:
        place = 0
        for c in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[c])
            at = taken.get(int(c), 0)
            out.append((int(c) + 1, at, at + each * n, each, sequence, place))
            taken[int(c)] = at + each * n
            place += each
        sequence += n
    return out


def assign(pieces: DataFrame, budget: int = 2048) -> DataFrame:
    """``pieces`` (read twice: a stashed table) with sequence_id and offset.

    The plan is one row a class and pattern: at most CLASSES squared rows for
    any corpus, so it is broadcast.  Ranks come from counts by class and chunk.
    """
    spark = pieces.sparkSession
    size = budget // -(-budget // CLASSES)
    counts = stash(pieces.groupBy("class", "chunk").agg(F.count("*").alias("n")), "packing-counts")
    demand = np.zeros(size, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[r["class"] - 1] = r["n"]
    plan = slots(patterns(demand))
    if not plan:
        return pieces.drop("class", "rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("class", "chunk", before.alias("_base"))
    spots = spark.createDataFrame(plan, "class int, _from long, _to long, _each long, _sequence long, _place int")
    rows = pieces.join(base, ["class", "chunk"]).withColumn("_slot", F.col("_base") + F.col("rank"))
    spots = spots.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("_to", "_from", "_each", "_sequence", "_place"))).alias("_spots"))
    rows = rows.join(F.broadcast(spots), "class").withColumn("_spot", F.element_at(F.filter("_spots", lambda s: s["_to"] > F.col("_slot")), 1))
    nth = F.col("_slot") - F.col("_spot._from")
    rows = rows.withColumn("sequence_id", F.col("_spot._sequence") + F.floor(nth / F.col("_spot._each")).cast("long")).withColumn("_place", F.col("_spot._place") + nth % F.col("_spot._each"))
    along = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long"))
    return rows.drop("class", "rank", "_base", "_slot", "_spots", "_spot", "_place")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): every token of ``docs`` in one piece.

    A null text counts as empty and gives one piece with ``end_id``; repeated
    rows are packed each; a null id stays null; an empty table gives no piece;
    other columns aren't read.  Padding is what a sequence lacks to ``budget``.
    """
    pieces = stash(tokenised_pieces(docs, tokenizer, end_id, budget, id_col, text_col), "pieces")
    placed = assign(pieces.drop("ids"), budget)  # the ids move once, when their place is known
    out = pieces.select("chunk", "piece", "ids").join(placed, ["chunk", "piece"])
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


def pack_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, budget: int = 2048) -> DataFrame:
    """``pack`` with a checksum of each piece's ids instead of the ids, which then aren't shuffled."""
    pieces = tokenised_pieces(docs, tokenizer, end_id, budget)
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(stash(digest, "pieces"), budget)
