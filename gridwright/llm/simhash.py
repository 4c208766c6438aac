"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that lies within half
the radius of both, so equal variants find every link, and by the triangle
inequality nothing else.  All variants of all fingerprints would be 2,081 rows
each at radius 4.  They are therefore shuffled on a prefix of the variant: a
fingerprint goes once to each prefix that one of its variants has, and the task
that owns the prefix expands just those variants, sorts them in bounded slices
and keeps a spanning forest.  Only distinct fingerprints take part, so a group
of copies, however large, is one row.

One 64-bit fingerprint can't tell a word-shingle similarity of 0.8: such texts
differ in 10 bits of 64.  ``drop_near_duplicates`` therefore hashes balls in
BLOCKS fingerprints of 32 bits each, at 2 bits, and verifies the pairs that
collide on their whole shingle sets.  These are shuffled on each of PARTS.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, id_or_digest, sieve, stash

BITS = 64
#: Variants that a task holds at once; prefixes are as long as this asks.
SLICE = 1 << 22
#: Fingerprints of whole prefixes that a task gathers before it expands them.
HELD = 1 << 16

#: Fingerprints of a text's shingle set, their bits, and the bits in which two may differ to meet.
#: Texts of similarity 0.8 meet in one of them with a probability of 0.98, of 0.85 of 0.9996.
BLOCKS, WIDE, NEAR = 32, 32, 2
#: The bits in parts: two fingerprints that differ in NEAR bits agree in one of NEAR + 1 parts.
PARTS = (range(11), range(11, 22), range(22, WIDE))
#: Texts that meet are compared in 96 bits, later in all 1024.  In more than FAR they are no candidates (similarity 0.8,
#: met within NEAR bits, has 11.4 of 96 on average, with a deviation of 2.9, and 155 of 1024, with 11.5; of unlike texts
#: that meet by chance 0.4 % are within FAR); one within WHOLE_TIGHT of another needs no turn against further texts.
FAR = 23
WHOLE_FAR, WHOLE_TIGHT = 190, 64
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, BLOCKS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BLOCKS // 2, dtype=np.uint64)


#: What is sent of a text in the two meetings, and for each part the columns of fingerprints that go there.
_SHORT = np.dtype([("node", "<i8"), ("block", "<u4"), ("rest", "<u8")])
_LONG = np.dtype([("node", "<i8"), ("words", "<u8", (BLOCKS // 2,))])
_GOES = [f"goes_{p}" for p in range(len(PARTS))]


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of one whole text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() maps A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    block = 1 << 16
    for k in range(0, len(starts), block):
        cut = [joined[a:b] for a, b in zip(starts[k : k + block], ends[k : k + block])]
        h = np.fromiter(map(xxh64_intdigest, cut, repeat(42)), np.uint64, len(cut))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of at most 255 ones stay in a byte
            counts += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    on = counts * 2 > len(starts)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fingerprint as signed long) of every row; null and wordless texts have 0.

    A null id becomes a negative id made from the text; equal rows stay rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(id_or_digest(id_col, text_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: Iterable[int], most: int) -> np.ndarray:
    """XOR masks of up to ``most`` of these bits, in order of the number of bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)], np.uint64)


#: Masks of the parts, and of up to half of NEAR bits beside each part.
_PART_MASKS = [np.uint64(sum(1 << b for b in part)) for part in PARTS]
_BALLS = [_masks([b for b in range(WIDE) if b not in part], NEAR // 2) for part in PARTS]


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index in each index's component of the graph with edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _meet(fps: np.ndarray, ids: np.ndarray, moved: np.ndarray, spent: np.ndarray, inner: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that meet in these prefixes.

    moved: the fingerprint with the prefix it was sent to; spent: the bits in
    which that differs; inner[k]: masks over the other bits for one that may
    still flip k.  Variants are sorted in slices by their low bits, so memory
    stays bounded for any number of rows.
    """
    half = radius // 2
    order = np.argsort(ids, kind="stable")
    fps, ids, moved, spent = fps[order], ids[order], moved[order], spent[order]
    total = sum(int((spent == k).sum()) * len(inner[half - k]) for k in range(half + 1))
    cut = max(0, math.ceil(math.log2(max(1, total) / SLICE)))
    low = np.uint64((1 << cut) - 1)
    found_a, found_b = [], []
    for part in range(1 << cut):
        variants, rows = [], []
        for k in range(half + 1):
            at, masks = np.flatnonzero(spent == k), inner[half - k]
            step = max(1, SLICE // len(masks))
            for j in range(0, len(at), step):
                some = at[j : j + step]
                v = moved[some][:, None] ^ masks[None, :]
                r = np.broadcast_to(some[:, None], v.shape)
                keep = (v & low) == part if cut else slice(None)
                variants.append(v[keep].ravel())
                rows.append(r[keep].ravel())
        v, r = np.concatenate(variants), np.concatenate(rows)
        order = np.argsort(v)
        v, r = v[order], r[order]
        same = v[1:] == v[:-1]
        a, b = r[:-1][same], r[1:][same]
        pair = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
        a, b = pair // len(fps), pair % len(fps)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        found_a.append(a[near])
        found_b.append(b[near])
    root = _roots(np.concatenate(found_a), np.concatenate(found_b), len(fps))
    linked = np.flatnonzero(ids[root] != ids)
    return ids[linked], ids[root[linked]]


def by_prefix(batches: Iterator[pa.RecordBatch], close: Callable[[list[tuple[np.ndarray, ...]]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``close`` of whole prefixes, the first column, gathered up to HELD rows or more."""
    held, size, last = [], 0, None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = (np.flatnonzero(np.diff(cols[0])) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(cols[0])]):
            if a == b:
                continue
            if cols[0][a] != last and size >= HELD:
                yield close(held)
                held, size = [], 0
            last = cols[0][a]
            held.append(tuple(c[a:b] for c in cols))
            size += b - a
    if held:
        yield close(held)


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct (a, b), a > b: links between ``nodes`` (id, fp) that keep every component whole.

    ``fp`` must be distinct.  Of the links that meet in one prefix only a
    spanning forest is returned, never all pairs of a group.
    """
    if radius % 2:
        raise ValueError("radius must be even: balls have half of it")
    n, half = nodes.count(), radius // 2
    per = sum(math.comb(BITS, k) for k in range(half + 1))
    key = min(30, max(4, math.ceil(math.log2(max(1, n * per / SLICE)) + 1)))
    outer = _masks(range(BITS - key, BITS), half)
    inner = [_masks(range(BITS - key), k) for k in range(half + 1)]
    shift = np.uint64(BITS - key)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in outer:
                prefix = pa.array(((fps ^ mask) >> shift).astype(np.int32))
                yield pa.record_batch([prefix, batch.column(0), batch.column(1)], names=["prefix", "id", "fp"])

    def close(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        prefix, ids, fps = (np.concatenate(x) for x in zip(*held))
        fps = fps.view(np.uint64)
        moved = (fps & np.uint64((1 << (BITS - key)) - 1)) | (prefix.astype(np.uint64) << shift)
        a, b = _meet(fps, ids, moved, np.bitwise_count(moved ^ fps), inner, radius)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_prefix(batches, close)

    sent = nodes.select("id", "fp").mapInArrow(send, "prefix int, id long, fp long")
    met = sent.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(meet, "a long, b long")
    return met.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of ``edges`` (a > b) but the smallest of its component, with that smallest.

    Alternating large-star and small-star steps until nothing changes; each round
    is a table in the shared folder, and only its row count and checksum reach
    the driver.
    """
    now, before = stash(edges, "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            return now
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        now = stash(small, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest id reachable.  Null or wordless texts have fingerprint 0 and link
    like any other; a null id is replaced by a negative one made from the text;
    repeated rows are each returned; an empty table gives an empty result;
    further columns are not read.
    """
    prints = stash(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    stars = components(links(nodes, radius))
    label = nodes.join(stars, nodes.id == stars.a, "left").select("fp", F.coalesce("b", "id").alias("component_id"))
    return prints.join(label, "fp", "left").select("doc_id", "fp", "component_id")


def normal(text: str | None) -> bytes:
    """A text's words, A-Z in lower case, with one space between; null has none."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a normal text; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    if not text:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    n = len(gaps) + 2 - width
    if n <= 1:
        return np.array([xxh64_intdigest(text)], np.uint64)
    starts = np.concatenate(([0], gaps[: n - 1] + 1)).tolist()
    ends = np.concatenate((gaps[width - 1 :], [len(text)])).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(text[a:b]) for a, b in zip(starts, ends)), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The BLOCKS SimHash fingerprints of a shingle set, two to an unsigned word: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(BITS * len(_TIMES), np.int64)
    for k in range(0, len(hashes), 255):  # sums of at most 255 ones stay in a byte
        z = hashes[k : k + 255, None] * _TIMES + _PLUS
        z = (z ^ (z >> np.uint64(32))) * _TIMES
        z ^= z >> np.uint64(29)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def _closest_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the edges a-b of distance d between n nodes."""
    root, kept = np.arange(n), []
    for at in np.unique(d):
        left = np.flatnonzero(d == at)
        while len(left := left[root[a[left]] != root[b[left]]]):
            x, y = root[a[left]], root[b[left]]
            high, first = np.unique(np.maximum(x, y), return_index=True)  # each component joins a smaller one
            root[high] = np.minimum(x, y)[first]
            while not np.array_equal(root, up := root[root]):
                root = up
            kept.append(left[first])
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[kept], b[kept], d[kept]


def _meetings(fps: np.ndarray, words: list[np.ndarray], ball: np.ndarray, far: int, tight: int, apart: list[np.uint64]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, differing bits) of rows that share a variant and differ in ``far`` bits of ``words`` or fewer.

    fps: fingerprints of 32 bits; ball: the masks that make their variants; apart:
    masks in each of which the two fingerprints must differ.  In each bucket of
    equal variants the first row is compared with all others; rows not within
    ``tight`` bits of it take their turn as first.  So a tight group costs its
    size, and no pair of a loose one is left out.  A variant and its row are one
    number, sorted in slices by a hash of the variant: memory stays bounded.
    """
    own, masks, row_bits = fps << np.uint64(32) | np.arange(len(fps), dtype=np.uint64), ball << np.uint64(32), np.uint64((1 << 32) - 1)
    cut = max(0, math.ceil(math.log2(max(1, len(own) * len(masks)) / SLICE)))
    step = max(1, SLICE // len(masks))
    for part in range(1 << cut):
        held = [np.zeros(0, np.uint64)]
        for j in range(0, len(own), step):
            v = (own[j : j + step, None] ^ masks).ravel()
            held.append(v[(v >> np.uint64(32)) * _TIMES[0] >> np.uint64(64 - cut) == part] if cut else v)
        v = np.sort(np.concatenate(held))
        same = v[1:] >> np.uint64(32) == v[:-1] >> np.uint64(32)
        v = v[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        bucket, r = v >> np.uint64(32), (v & row_bits).astype(np.int64)
        pending = np.ones(len(r), bool)
        while len(r):
            start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            size = np.diff(np.append(start, len(r)))
            lead = np.minimum.reduceat(np.where(pending, np.arange(len(r)), len(r)), start)
            of = r[np.repeat(lead, size)]
            d = np.zeros(len(r), np.int64)
            for word in words:
                d += np.bitwise_count(word[r] ^ word[of])
            near = (d <= far) & (r != of)
            for mask in apart:
                near &= (fps[r] ^ fps[of]) & mask != 0
            yield r[near], of[near], d[near]
            pending &= ~(near & (d <= tight))
            pending[lead] = False
            more = np.repeat(np.add.reduceat(pending, start, dtype=np.int64) > 0, size)
            bucket, r, pending = bucket[more], r[more], pending[more]


def _met(nodes: DataFrame, record: np.dtype, fill: Callable[[np.ndarray, np.ndarray, int], np.ndarray], take: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``take`` of each group of fingerprints that agree in one of PARTS.

    nodes: node, sketch and for each part the fingerprints that go there, as bits.
    Two within NEAR bits agree in a part, so a fingerprint goes once for each part,
    whatever the table's size.  What ``fill`` makes of it, a ``record``, is sent
    as bytes, many to a row; groups are as many as SLICE asks.
    """
    most = max(len(b) for b in _BALLS)
    key = min(min(map(len, PARTS)), max(3, math.ceil(math.log2(max(1, nodes.count() * most / SLICE)) + 1)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, goes = batch.column(0).to_numpy(), [c.to_numpy().view(np.uint32) for c in batch.columns[2:]]
            words = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            for k in range(BLOCKS):
                block = _block(words, k)
                for p, part in enumerate(PARTS):
                    at = np.flatnonzero(goes[p] >> np.uint32(k) & np.uint32(1))
                    if not len(at):
                        continue
                    group = (block[at] >> np.uint64(part[0]) & np.uint64((1 << key) - 1)).astype(np.uint16)
                    order = np.argsort(group, kind="stable")
                    at, group = at[order], group[order]
                    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                    ends = (np.append(start, len(at)) * record.itemsize).astype(np.int32)
                    rows = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(fill(node[at], words[at], k).tobytes())])
                    yield pa.record_batch([pa.array(group[start].astype(np.int32) | np.int32((k * len(PARTS) + p) << key)), rows], names=["group", "rows"])

    def close(group: int, held: list[bytes]) -> pa.RecordBatch:
        k, p = divmod(group >> key, len(PARTS))
        return pa.record_batch({c: pa.array(v) for c, v in take(np.frombuffer(b"".join(held), record), k, p).items()})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, []
        for batch in batches:
            for group, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if group != last and held:
                    yield close(last, held)
                    held = []
                last = group
                held.append(rows.as_py())
        if held:
            yield close(last, held)

    sent = nodes.select("node", "sketch", *_GOES).mapInArrow(send, "group int, rows binary")
    return sent.repartition("group").sortWithinPartitions("group").mapInArrow(meet, schema)


def _block(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint ``k`` of each sketch."""
    return words[:, k // 2] >> np.uint64(WIDE * (k % 2)) & np.uint64((1 << WIDE) - 1)


def _short(node: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    out = np.empty(len(node), _SHORT)
    out["node"], out["block"], out["rest"] = node, _block(words, k), words[:, (k // 2 + 1) % words.shape[1]]
    return out


def _long(node: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    out = np.empty(len(node), _LONG)
    out["node"], out["words"] = node, words
    return out


def _anybody(rows: np.ndarray, k: int, p: int) -> dict[str, np.ndarray]:
    """The nodes that have a near one, with this fingerprint's bit for this part.

    A pair counts in the first part in which it agrees; a row that has been found
    needs no turn of its own, as every row not found takes one.
    """
    block = rows["block"].astype(np.uint64)
    met = np.zeros(len(rows), bool)
    for a, b, _ in _meetings(block, [block, rows["rest"].copy()], _BALLS[p], FAR, FAR, _PART_MASKS[:p]):
        met[a] = met[b] = True
    node = rows["node"][met]
    bit = np.full(len(node), 1 << k, np.uint32).view(np.int32)
    return {"node": node} | {c: bit if c == _GOES[p] else np.zeros_like(bit) for c in _GOES}


def _closest(rows: np.ndarray, k: int, p: int) -> dict[str, np.ndarray]:
    """The closest links of the group, a forest, so that one fingerprint's links hide no other's."""
    node, words = rows["node"], rows["words"]
    held, size = [(np.zeros(0, np.int64),) * 3], 0
    for a, b, d in _meetings(_block(words, k), [w.copy() for w in words.T], _BALLS[p], WHOLE_FAR, WHOLE_TIGHT, []):
        held.append((a, b, d))
        size += len(a)
        if size > SLICE:
            held, size = [_closest_forest(*map(np.concatenate, zip(*held)), len(node))], 0
    a, b, _ = _closest_forest(*map(np.concatenate, zip(*held)), len(node))
    return {"a": np.maximum(node[a], node[b]), "b": np.minimum(node[a], node[b])}


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b: pairs of ``nodes`` (node, sketch) to be verified.

    Balls meet twice: first with 64 further bits only, to find the fingerprints
    that have any near one, then those alone with their whole sketches, of whose
    links a task keeps a forest of the closest.  So few bytes are shuffled for
    most texts, and the pairs of a group grow with its size, not with its square.
    """
    everywhere = nodes.select("node", "sketch", *[F.lit(-1).alias(c) for c in _GOES])
    some = _met(everywhere, _SHORT, _short, _anybody, "node long, " + ", ".join(f"{c} int" for c in _GOES))
    some = some.groupBy("node").agg(*[F.bit_or(c).alias(c) for c in _GOES])
    left = stash(nodes.join(some, "node"), "met-sketches")
    return _met(left, _LONG, _long, _closest, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, left = b, shingles(normal(y.as_py()), width)
                right = shingles(normal(x.as_py()), width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= similarity * (len(left) + len(right) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, text_col: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The links of ``similar`` and (raw, node): hashes of texts as they are and of their normal form.

    Texts are normalised once, where they are sketched; later passes over
    ``docs`` need only the hash of the text as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            plain = [normal(t.as_py()) for t in batch.column(1)]
            node = np.fromiter(map(xxh64_intdigest, plain), np.uint64, len(plain)).view(np.int64)
            own = [sketch(shingles(t, width)).view(np.int64) if t else None for t in plain]
            yield pa.record_batch([batch.column(0), pa.array(node), pa.array(own, pa.list_(pa.int64()))], names=["raw", "node", "sketch"])

    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("raw"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = stash(texts.mapInArrow(run, "raw long, node long, sketch array<long>"), "sketches")
    by_raw = stash(signed.select("raw", "node").distinct(), "hashes")
    nodes = stash(signed.where("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch")), "nodes")
    pairs = stash(candidates(nodes), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stash(by_raw.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("raw").alias("raw")), "wanted")
    # One text for each candidate; other texts and rows that repeat it are dropped before they move.
    bits, passes = sieve(wanted.select("raw"))
    found = texts.join(bits, passes(F.col("raw")), "left_semi").join(wanted, "raw").groupBy("node").agg(F.first("text").alias("text"))
    return _verified(pairs, stash(found, "candidate-texts"), width, similarity), by_raw


def similar(docs: DataFrame, text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b), a > b: links between 64-bit hashes of normal texts of Jaccard ``similarity`` or more.

    Ball hashing proposes pairs and the whole sets of ``width``-word shingles
    decide them.  Exact copies share a hash and need no link; null and wordless
    texts have none; an empty table gives none.
    """
    return _linked(docs, text_col, width, similarity)[0]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id.

    Texts with the same words are copies; others link if their sets of
    ``width``-word shingles have a Jaccard similarity of ``similarity`` or more,
    and groups are what links connect.  Null and wordless texts are copies of
    each other; a null id is replaced by a negative one made from the text; rows
    that share an id but not their text are told apart; of repeated rows one
    stays; an empty table stays empty.  Columns are those of ``docs``, whatever
    their names.
    """
    raw, key, rank, marks = free_name(docs, "_raw", "_key", "_rank", "_marks")
    linked, by_raw = _linked(docs, text_col, width, similarity)
    group = components(linked).withColumnRenamed("a", "node")
    group = group.union(group.select("b", "b").distinct())
    hashed = F.xxhash64(F.col(f"`{text_col}`"))
    own = docs.select(hashed.alias("raw"), id_or_digest(id_col, text_col).alias("id")).groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = own.join(by_raw, "raw").groupBy("node").agg(F.min(F.struct("id", "raw")).alias("s"), F.sum("n").alias("n"))
    first = stash(first.join(group, "node", "left"), "first")
    stay = first.groupBy(F.coalesce("b", "node").alias("b")).agg(F.min("s").alias("s"))
    stay = stash(stay.select(F.col("s.id").alias(key), F.col("s.raw").alias(raw)), "stay")
    # A row whose text has neither copy nor link stays where it is; only the others move to be told apart.
    bits, passes = sieve(by_raw.join(first.where("n > 1 or b is not null"), "node", "left_semi").select("raw"), marks)
    alone = docs.join(bits, passes(hashed), "left_anti")
    kept = docs.join(bits, passes(hashed), "left_semi").withColumn(key, id_or_digest(id_col, text_col)).withColumn(raw, hashed).join(stay, [key, raw], "left_semi")
    kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy(key, raw).orderBy(raw))).where(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(*columns).union(kept.select(*columns))
