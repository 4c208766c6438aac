"""The queries as registered: against their SQL, and against plain versions where SQL can't express them."""

import datetime
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwright.llm import classifier, oracles, pii, queries

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(oracles.ORACLES[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert want and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_packing_query(spark):
    """Every id of every document once, in order, gapless from 0 in its sequence."""
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, places = {}, {}
    for r in queries.op3_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = plain.encode(texts[i], add_special_tokens=False).ids + [1], 0
        for r in sorted(own, key=lambda r: r.start):
            cut = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(cut.tobytes()) and len(cut) == r.length
            at += r.length
        assert at == len(ids)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup_query(spark):
    """Fingerprints word by word, and the components of all pairs at 4 bits or fewer."""
    prints = {r.doc_id: plain_print(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def digest(label, k, half):
    return hashlib.sha256(f"key\x1f{label}\x1f{k}\x1f{half}".encode()).digest()


def plain_shift(half, by, whole=True):
    out = ""
    for k, c in enumerate(half):
        for first, size in ((48, 10), (97, 26), (65, 26), (224, 23), (192, 23)):
            if first <= ord(c) < first + size:
                step = by[k % 32] if whole else 1 + by[k % 32] % (size - 1)
                c = chr(first + (ord(c) - first + step) % size)
                break
        out += c
    return out


def plain_text(s, label):
    if len(s) < 2:
        return plain_shift(s, digest(f"{label}/1", 0, ""), whole=False)
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for k in range(pii.ROUNDS):
        left, right = (plain_shift(left, digest(label, k, right)), right) if k % 2 == 0 else (left, plain_shift(right, digest(label, k, left)))
    return left + right


def plain_grid(n, a, b, label):
    left, right = divmod(n, b)
    number = lambda k, half, size: int(digest(label, k, half).hex()[:12], 16) % size
    for k in range(2 * pii.ROUNDS):
        left, right = ((left + number(k, right, a)) % a, right) if k % 2 == 0 else (left, (right + number(k, left, b)) % b)
    return left * b + right


def plain_email(value):
    name, host = value.split("@")
    moved = plain_text("".join(c.lower() if "A" <= c <= "Z" else c for c in name), "email")
    return "".join(m.upper() if "A" <= c <= "Z" and "a" <= m <= "z" else m for m, c in zip(moved, name)) + "@" + host


def plain_date(value, shape):
    day = datetime.datetime.strptime(value, shape).date()
    n = plain_grid((day - datetime.date(1900, 1, 1)).days, pii.DAYS_A, pii.DAYS_B, "date")
    return (datetime.date(1900, 1, 1) + datetime.timedelta(n)).strftime(shape)


def plain_ip(value):
    n = 0
    for x in value.split("."):
        n = n * 256 + int(x)
    n = plain_grid(n, 65536, 65536, "ip")
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def plain_card(value):
    digits = [c for c in value if c.isdigit()]
    body = plain_text("".join(digits[:-1]), "card")
    last = next(d for d in "0123456789" if sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(body + d))) % 10 == 0)
    new = iter(body + last)
    return "".join(next(new) if c.isdigit() else c for c in value)


def test_pseudonyms_by_brute_force(spark):
    """The same permutations in plain Python: addresses, dates of three orders, network addresses, cards."""
    rng = np.random.default_rng(9)
    cards = ["4111 1111 1111 1111", "378282246310005", "5555-5555-5555-4444"]
    want = {v: plain_email(v) for v in ("Ann.Lee@ex.org", "ann.lee@ex.org", "a@b.io", "Zoé_9@mail.example.com")}
    want |= {v: plain_card(v) for v in cards}
    want |= {v: plain_ip(v) for v in (".".join(map(str, rng.integers(0, 256, 4))) for _ in range(20))}
    for _ in range(20):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(int(rng.integers(0, 73049)))
        want |= {d.strftime(s): plain_date(d.strftime(s), s) for s in ("%Y-%m-%d", "%d.%m.%Y")}
        if d.day > 12:
            want[d.strftime("%m/%d/%Y")] = plain_date(d.strftime("%m/%d/%Y"), "%m/%d/%Y")
    values = list(want)
    df = spark.createDataFrame([(k, f"x {v} y") for k, v in enumerate(values)], "doc_id long, text string")
    got = {values[r.doc_id]: r.text for r in pii.pseudonymised(df, "key").collect()}
    assert got == {v: f"x {new} y" for v, new in want.items()}
    assert want["Ann.Lee@ex.org"].lower() == want["ann.lee@ex.org"]


def test_pii_of_odd_tables(spark):
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), "key").count() == 0
    rows = [(1, "word " * 50_000 + "8.8.8.8", 5), (1, "word " * 50_000 + "8.8.8.8", 5), (None, None, None)]
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string, n long"), "key", count_col="n")
    assert got.columns == ["doc_id", "text", "n", "n_"] and sorted((r.n_, r.n or 0) for r in got.collect()) == [(0, 0), (1, 5), (1, 5)]


def test_classifier_by_brute_force(spark):
    """Ridge weights over random cosines and the calibration by folds, from the same statistics in numpy."""
    sf = SF.replace("0.001", "0.01")
    stats = classifier.with_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = stats.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null"), "doc_id").select("x", F.col("quality").alias("label")).cache()
    model = classifier.train(rows, waves=32, bins=50)
    own = rows.select("x", "label", F.pmod(F.xxhash64("x"), F.lit(classifier.FOLDS)).alias("fold")).collect()
    x, y, fold = np.array([r.x for r in own], float), np.array([r.label for r in own], float), np.array([r.fold for r in own])
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6)
    f = np.hstack([np.sqrt(2 / 32) * np.cos(z @ model.freqs + model.phases), np.ones((len(z), 1))])
    penalty = np.eye(33)
    penalty[-1, -1] = 1e-6
    ridge = lambda some: np.linalg.solve(f[some].T @ f[some] + penalty, f[some].T @ y[some])
    assert np.abs(ridge(np.ones(len(y), bool)) - model.weights).max() < 1e-3
    raw = np.array([np.clip(f[k] @ ridge(fold != fold[k]), -1, 2) for k in range(len(y))])
    bins = np.floor((raw + 1) / 3 * 50).astype(int)
    knots = [raw[bins == b].mean() for b in np.unique(bins)]
    levels = classifier.isotonic(np.array([y[bins == b].mean() for b in np.unique(bins)]), np.array([float((bins == b).sum()) for b in np.unique(bins)]))
    assert len(knots) == len(model.knots) and np.abs(model.knots - knots).max() < 1e-2 and np.abs(model.levels - levels).max() < 1e-2


def test_large_components_are_refused(spark):
    from gridwright.llm import topk

    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.search(df, F.col("vec_id") == 0)


def test_topk_across_cells(spark, monkeypatch):
    """Many cells give what one gives; repeated rows are candidates each, other columns aren't read."""
    from gridwright.llm import topk

    rng = np.random.default_rng(2)
    v = rng.integers(-40, 40, (300, 6)) / 16
    rows = [(k, x.tolist(), 1.5) for k, x in enumerate(v)] + [(7, v[7].tolist(), 2.5)]
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), F.col("vec_id") % 20 == 0)
    whole = np.floor(256 * np.vstack([v, v[7:8]])).astype(int)
    ids = np.array([*range(300), 7])
    want = {}
    for q in range(0, 300, 20):
        s = whole @ whole[q]
        order = sorted((k for k in range(301) if ids[k] != q), key=lambda k: (-s[k], ids[k]))[:5]
        want[q] = [(int(ids[k]), int(s[k])) for k in order]
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert have == want
