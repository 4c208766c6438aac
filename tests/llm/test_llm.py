"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridwright.llm import classifier, linededup, mixing, packing, pii, qualityrules, queries, simhash, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, None, "en", None, 0, "x"),
    (2, "", "en", "s", 0, "x"),
    (3, " \n\t ", None, "s", 0, None),
    (4, "same words here again " * 9, "en", "s", 0, "x"),
    (4, "same words here again " * 9, "en", "s", 0, "x"),
    (5, "same words here again " * 9, "en", "s", 0, "x"),
    (None, "a text without id", "en", "t", 0, "x"),
    (6, "long " + "word and more " * 30_000, "en", "t", 0, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 4: near duplicates ---


def plain_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(ids):
        for y in ids[:k]:
            if (prints[x] ^ prints[y]).bit_count() <= radius:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {}
    for k in range(400):
        fp = int(base[k % 12])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            fp ^= 1 << int(b)
        prints[k] = fp
    distinct = {}
    for k, fp in prints.items():
        distinct.setdefault(fp, k)
    nodes = spark.createDataFrame([(k, fp - (1 << 64) if fp >> 63 else fp) for fp, k in distinct.items()], "id long, fp long")
    got = {r.a: r.b for r in simhash.components(simhash.links(nodes)).collect()}
    want = plain_components({k: fp for fp, k in distinct.items()}, 4)
    assert {k: got.get(k, k) for k in want} == want


def test_slices_do_not_change_the_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**12, 300).astype(np.uint64)
    fps = np.unique(fps)
    ids = np.arange(len(fps))
    inner = [simhash._masks(range(60), k) for k in range(3)]
    want = simhash._meet(fps, ids, fps, np.zeros(len(fps), int), inner, 4)
    monkeypatch.setattr(simhash, "SLICE", 1 << 12)
    got = simhash._meet(fps, ids, fps, np.zeros(len(fps), int), inner, 4)
    assert sorted(zip(*map(list, got))) == sorted(zip(*map(list, want)))


def test_near_duplicates_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD)
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[5].component_id == 4
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6]
    assert simhash.near_duplicates(none).count() == 0


# --- 3: packing ---


def test_ids_are_the_tokenizers(docs):
    encoder, plain = packing.Encoder(TOKENIZER), packing._tokenizer(TOKENIZER)
    texts = [r.text for r in docs.select("text").collect()][:60] + ["", " ", "a  b", " \n x", "don't  stop\n\n\n now ", "x\x00 y", "<|endoftext|> z", "é   f"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    long = "Some words, and 12 more. " * 20_000
    assert np.frombuffer(encoder.encode(long), "<u4").tolist() == plain.encode(long, add_special_tokens=False).ids


def check_packed(rows, texts):
    plain = packing._tokenizer(TOKENIZER)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for doc_id, text in texts:
        whole = b"".join(bytes(r.ids) for r in sorted(by_doc[doc_id], key=lambda r: r.start))
        assert np.frombuffer(whole, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1]
    return sum(2048 for _ in by_seq)


def test_pack_round_trip(docs):
    rows = packing.pack(docs, TOKENIZER).collect()
    room = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.length for r in rows) / room > 0.95


def test_pack_odd_rows(odd, none):
    rows = packing.pack(odd, TOKENIZER).collect()
    check_packed(rows, [(d, t) for d, t, *_ in ODD if d != 4])
    assert len([r for r in rows if r.doc_id == 4]) == 2
    assert packing.pack(none, TOKENIZER).count() == 0


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(0)
    demand = rng.integers(0, 900, 64)
    found = packing.patterns(demand)
    total = sum(n * p for p, n in found)
    assert (total == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in found)
    bound = (demand * np.arange(1, 65)).sum() / 64
    assert sum(n for _, n in found) < 1.05 * bound + 64
    assert packing.patterns(np.zeros(8, int)) == []


# --- 1: mixing ---


def test_mix_meets_its_quotas(docs):
    rows = mixing.mixed(docs, mixing.Mix(max_repeats=1.5), keys=True).collect()
    words, taken = {}, {}
    for r in docs.collect():
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.tokens
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    repeats = {s: taken[s] / words[s] for s in words}
    assert min(repeats.values()) >= 1 and max(repeats.values()) <= 1.5 + 1e-6
    weights = {r.source: r.weight for r in rows}
    assert abs(sum(weights.values()) - 1) < 1e-9
    most = max(words[s] / weights[s] for s in words)
    longest = max(r.tokens for r in rows)
    for s in words:
        assert -1e-6 <= most * weights[s] - taken[s] <= longest + 1


def test_mix_entropy_and_budget(spark, docs):
    mix = mixing.Mix(max_repeats=None, target_entropy=2.9, budget_tokens=1_000_000)
    rows = mixing.mixed(docs, mix, keys=True).collect()
    weights = {r.source: r.weight for r in rows}
    assert sum(r.tokens for r in rows) <= 1_000_000
    assert len(weights) == 20 and -sum(w * math.log(w) for w in weights.values()) == pytest.approx(2.9, abs=1e-4)


def test_mix_by_brute_force(spark):
    """Exponent, quotas, epochs and the cut of the last one, against a plain version over the rows' own keys."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), f"s{min(int(rng.exponential(1.5)), 4)}") for k in range(900)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Mix(max_repeats=1.7), keys=True).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {x for *_, x in rows}}

    def weights(x):
        power = {s: (n / sum(size.values())) ** x for s, n in size.items()}
        return {s: p / sum(power.values()) for s, p in power.items()}

    def repeats(x):
        w = weights(x)
        budget = max(size[s] / w[s] for s in size)
        return {s: w[s] * budget / size[s] for s in size}

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max(repeats(mid).values()) <= 1.7 else (mid, hi)
    want = weights(hi)
    for r in got:
        assert r.weight == pytest.approx(want[r.source], abs=1e-5)
    for s, n in size.items():
        quota = n * repeats(hi)[s]
        own = {}
        for r in got:
            if r.source == s:
                own.setdefault(r.epoch, []).append(r)
        full = int(quota / n + 1e-4)
        assert sorted(own)[:full] == list(range(full)) and all(len(own[e]) == sum(x == s for *_, x in rows) for e in range(full))
        rest = sorted(own.get(full, []), key=lambda r: (r.block_key, r.block, r.row_key))
        assert sum(r.tokens for r in rest) <= quota - full * n + 1e-3 * n
        # The taken rows begin the epoch's permutation: no other row of it comes before the last one.
        if rest:
            key = lambda r: (r.block_key, r.block, r.row_key)
            blocks = max(1, -(-sum(x == s for *_, x in rows) // mixing.BLOCK))
            md = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:15], 16)
            keys = {r.doc_id: r for r in own[0]}
            assert all(r.block == keys[r.doc_id].block and r.block < blocks for r in rest)
            assert all(r.block_key == md(0, "b", s, r.block, full) for r in rest)
            missing = {i for i in keys} - {r.doc_id for r in rest}
            later = [md(0, "b", s, keys[i].block, full) for i in missing]
            assert all(x >= key(rest[-1])[0] for x in later)


def test_mix_of_a_table_without_a_word(spark):
    rows = [(1, None, "a", 1), (2, " ", "a", 1), (2, " ", "a", 1), (3, "", None, 1)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, epoch long"), keys=True)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 2, 3] and {"epoch", "epoch_"} <= set(got.columns)


def test_mix_odd_rows(odd, none):
    got = mixing.mixed(odd, mixing.Mix(max_repeats=2.0))
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5, 6, None}
    assert mixing.mixed(none).count() == 0


# --- 2: line dedup ---


def plain_dedup(rows, ratio, least):
    seen, total = {}, {}
    for _, host, text in rows:
        total[host or ""] = total.get(host or "", 0) + 1
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")} - {""}:
            seen[host or "", line] = seen.get((host or "", line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return {i: text if text is None else "\n".join(x for x in text.split("\n") if (host or "", x.strip(" \t\n\x0b\x0c\r")) not in bad) for i, host, text in rows}


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_line_dedup(spark, docs, limit):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = linededup.drop_boilerplate(docs, "text", "source", 0.05, 2, broadcast_bytes=limit)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == plain_dedup(rows, 0.05, 2)


def test_line_dedup_odd_rows(odd, none):
    got = linededup.drop_boilerplate(odd, "text", "source", 0.3, 2, dropped_col="gone").collect()
    assert len(got) == len(ODD) and [r.text for r in got if r.doc_id == 1] == [None]
    assert [r.text for r in got if r.doc_id == 5] == [""]
    assert linededup.drop_boilerplate(none, "text", "source").count() == 0


# --- 5: quality rules ---


def test_quality_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in qualityrules.rules(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[2].kept
    assert got[4].n_repeat_words == 36 and got[4].base_failed
    assert qualityrules.rules(none).count() == 0


def test_common_lines_reject(spark):
    line = "this very line stands in every single document of the host and says nothing at all to anyone really yes"
    rows = [(k, f"{line}\nonly {chr(97 + k % 26)}{chr(97 + k // 26)}", "h") for k in range(30)] + [(100, " ".join(f"w{k}" for k in range(40)), "h")]
    got = {r.doc_id: r for r in qualityrules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[3].base_failed and not got[3].kept and got[3].n_words_left == 2 and got[100].kept


# --- 6: search ---


def test_topk_ties_and_bad_vectors(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(0, 120)] + [(200, None), (201, [1.0, None, 0.0]), (202, [float("nan"), 0.0, 0.0]), (203, [2.0, 1.0]), (250, [1.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in got if r.query_id == 50] == [0, 1, 2, 3, 4]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 250] == [(203, 512 * 256 + 256 * 256)]
    assert topk.search(df.where("false"), F.lit(True)).count() == 0


def test_accumulate_is_the_product():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-9, 9, (5, 7)), rng.integers(-9, 9, (11, 7)) * rng.integers(0, 2, (11, 7))
    assert (topk.accumulate(q, c) == q @ c.T).all()


# --- 7: PII ---


def test_pseudonyms(spark):
    text = "mail Ann.Lee@ex.org or 4111 1111 1111 1111, not 4111111111111112; +1 (643) 555-5742, 10.0.0.255 not 10.0.0.256; 2020-02-29, 31/12/1999 not 2021-02-30; 123-45-6789 not 000-12-3456; GB82 WEST 1234 5698 7654 32 v1.2.3"
    df = spark.createDataFrame([(1, text, 0), (2, text, 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, found long")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "k", count_col="n").collect()}
    new = got[1].text
    assert got[2].text == new and got[3].text is None and got[4].text == "" and got[1].n == 8
    for gone in ("Ann.Lee", "4111 1111 1111 1111", "555-5742", "10.0.0.255", "2020-02-29", "31/12/1999", "123-45-6789", "5698"):
        assert gone not in new
    for stays in ("@ex.org", "4111111111111112", "+1 (", "10.0.0.256", "2021-02-30", "000-12-3456", "v1.2.3"):
        assert stays in new
    shape = lambda t: re.sub(r"\d+(?=\.)|(?<=\.)\d+", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", t))))
    assert shape(new) == shape(text)
    card = re.search(r"or ([\d ]+),", new)[1].replace(" ", "")
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    iban = re.search(r"GB[\d A-Z]+(?= v)", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_cards_beside_other_numbers(spark):
    card, other = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [f"{card} 12/25", f"{card} 123", f"7 {card}", f"12 34 {card}", f"{card} {other} 9", f"{card} 2020-02-29", f"{card} 31.12.1999", f"{card} 10.0.0.1", f"{card}-555-123-4567", f"1 {card} x@y.org", "1234 5678 9012 3456 12", "4111-1111-1111-1111-123", card, "0 " * 4000 + "0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "k", count_col="n").collect()}
    assert [got[k].n for k in range(len(texts))] == [1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 0, 1, 1, 0]
    new = got[12].text
    assert new != card and luhn(new.replace(" ", ""))
    for k, keep in {0: f"{new} 12/25", 1: f"{new} 123", 2: f"7 {new}", 3: f"12 34 {new}", 10: texts[10], 11: new.replace(" ", "-") + "-123", 13: texts[13]}.items():
        assert got[k].text == keep
    for k in (4, 5, 6, 7, 8, 9):
        assert card not in got[k].text and new in got[k].text
    for k, gone in {4: other, 5: "2020-02-29", 6: "31.12.1999", 7: "10.0.0.1", 8: "555-123-4567", 9: "x@y"}.items():
        assert gone not in got[k].text
    assert got[4].text.endswith(" 9") and len(got[4].text) == len(texts[4])


def test_values_of_single_digits(spark):
    texts = ["at 8.8.8.8 only", "at 8.8.8.8 and 12", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "no 1 or 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "k", count_col="n").collect()}
    assert [got[k].n for k in range(5)] == [1, 1, 1, 1, 0]
    assert got[0].text.split()[1] == got[1].text.split()[1] != "8.8.8.8"


def test_permutations_are_permutations(spark):
    grid = spark.range(73049).select(pii.permute_grid(F.col("id"), pii.DAYS_A, pii.DAYS_B, "k", "date").alias("x"))
    assert grid.distinct().count() == 73049
    three = spark.range(1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "n").alias("x"))
    assert three.distinct().count() == 1000 and three.where("length(x) <> 3").count() == 0


# --- 8 and 10: classifiers ---


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def scores_against(rows, labels):
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    return [p for p, y in own if y], [p for p, y in own if not y]


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = scores_against(queries.op8_quality_classifier(spark, sf).collect(), labels)
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, sf).collect()
    toxic, clean = scores_against(rows, labels)
    assert np.mean([p >= 0.5 for p in toxic]) > 0.8 and np.mean([p >= 0.5 for p in clean]) < 0.02


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert classifier.classify(odd, labels).count() == len(ODD)
    assert classifier.classify(none, labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert toxicity.drop_toxic(none, labels).count() == 0


def test_isotonic():
    assert classifier.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def plain_triples(word):
    """Gap-weighted character triples of a word, with its ends."""
    own, out = ["<", *word, ">"], {}
    for x in range(len(own)):
        for y in range(x + 1, min(x + 4, len(own))):
            for z in range(y + 1, min(y + 4, len(own))):
                key = own[x], own[y], own[z]
                out[key] = out.get(key, 0) + 0.5 ** (z - x - 2)
    return out


def plain_kernel(a, b):
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    sums = []
    for side in (a, b):
        total = {}
        for word in side:
            for k, v in plain_triples(word).items():
                total[k] = total.get(k, 0) + v
        sums.append(total)
    return dot(*sums) / math.sqrt(dot(sums[0], sums[0]) * dot(sums[1], sums[1]))


SAID = ["you are an idiot", "what a woorthless thing", "trash and nothing else", "ein wörtchen über alles", "the other water", "一 事實 勝 於 雄辯", "of this and that", "worth more than less", "и это всё", "no"]


def test_kernel_by_brute_force():
    strings = [x.split() for x in SAID]
    got = toxicity.Landmarks(strings).kernel(strings)
    want = [[plain_kernel(a, b) for b in strings] for a in strings]
    off = np.abs(got - np.array(want))
    assert (off > 1e-5).mean() < 0.05 and off.max() < 0.02  # triples are hashed to 20 bits: a few share one


def test_machine_is_the_exact_kernel_machine():
    """With every string as a landmark, decisions are those of the dual machine on the plain kernel."""
    strings = [[w] for w in dict.fromkeys(" ".join(SAID).split())]
    y = np.array([1.0 if w[0] in ("idiot", "woorthless", "trash") else -1.0 for w in strings])
    weight = np.arange(1.0, len(y) + 1)
    ground = toxicity.Landmarks(strings)
    table, bias = ground.machine(ground.kernel(strings), ground.kernel(strings), y, weight)
    cost = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
    kernel = np.array([[plain_kernel(a, b) for b in strings] for a in strings]) + toxicity.RIDGE / 1e-6  # the bias, as a constant
    active = np.ones(len(y), bool)
    for _ in range(40):
        alpha = np.linalg.solve(kernel[np.ix_(active, active)] + toxicity.RIDGE * np.diag(1 / cost[active]), y[active])
        f = kernel[:, active] @ alpha
        if np.array_equal(y * f < 1, active):
            break
        active = y * f < 1
    assert np.abs(toxicity.decide([w[0] for w in strings], table, bias) - f).max() < 0.01


def test_gapped_insults_stay_close():
    usual = "the and of ering thing other north under worth less about there which would water".split()
    table, bias = toxicity._refit([(w, 50.0, 0.0) for w in ("worthless", "idiot", "moron")] + [(w, 0.0, 30.0) for w in usual], 18)
    names = ["worthless", "woorthless", "wortless", "idioot", "other", "water"]
    d = dict(zip(names, toxicity.decide(names, table, bias)))
    assert min(d["worthless"], d["woorthless"], d["wortless"], d["idioot"]) > max(d["other"], d["water"])
    assert "idiot" in toxicity.sentences("an i d i o t here")[0] and toxicity.sentences(None) == toxicity.sentences(" 1 2 _") == []
    assert toxicity.sentences("One two. Three\nfour") == [["one", "two"], ["three"], ["four"]]
    assert toxicity.highest("x" * 40 + "idiot", table, bias).endswith("idiot")


def test_sentences_learn_their_label(spark):
    """Toxic sentences in two scripts among harmless ones of the same documents; a long word's end counts too."""
    rng = np.random.default_rng(5)
    usual = ["".join(rng.choice(list("aeiourstln"), 5)) for _ in range(120)] + ["слово", "другой", "事情", "天氣"]
    bad = ["grumbold", "вреднюк", "壞東西"]
    rows = []
    for k in range(240):
        said = [" ".join(rng.choice(usual, 8)) for _ in range(6)]
        if k % 3 == 0:
            said[k % 6] += " " + bad[k // 3 % 3]
        rows.append((". ".join(said), int(k % 3 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"))
    texts = [(k, " ".join(rng.choice(usual, 9)) + end) for k, end in enumerate([" grumbold", " grumbolld", " вреднюк", " 壞東西", "", " слово"])]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert min(got[k] for k in range(4)) > 0.5 > max(got[4], got[5])


# --- 9: WARC ---


def test_warc_audit(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>page {k} é</p>" * (k % 7)) for k in range(600)] + [(600, None, None)], "page_id long, url string, html string")
    recs = warc.records(pages)
    assert warc.audit(recs, recs).count() == 0
    other = recs.where("record_id <> 600").withColumn("record", F.when(F.col("record_id") == 78, F.regexp_replace("record", "page", "Page")).otherwise(F.col("record")))
    got = {r.left_id: r.status for r in warc.audit(recs, other).collect()}
    assert got == {78: "changed", 600: "missing"}
    assert [r.status for r in warc.audit(other, recs).where("left_id is null").collect()] == ["extra"]
    warc.write(recs, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert back.count() == 601 and warc.audit(recs, back).count() == 0
    assert warc.audit(recs.where("false"), recs.where("false")).count() == 0


def test_warc_realigns(spark):
    """A record lost or inserted within a file is the only one reported, whatever follows it."""
    recs = warc.records(spark.createDataFrame([(k, f"http://h/{k}", f"<p>page {k}</p>" * 30) for k in range(250)], "page_id long, url string, html string"))
    lost = warc.audit(recs, recs.where("record_id <> 3")).collect()
    assert [(r.left_id, r.status) for r in lost] == [(3, "missing")]
    more = warc.audit(recs.where("record_id <> 3"), recs).collect()
    assert [(r.right_id, r.status) for r in more] == [(3, "extra")]


def test_warc_odd_rows(spark):
    rows = [(None, None, None, 1), (None, None, None, 1), (1, "u", None, 2), (1, "u", "x", 2), (1, "u", "x", 2), (2, "u", "long " * 60_000, 3)]
    recs = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string, offset long"))
    assert recs.count() == 6 and warc.audit(recs, recs).count() == 0
    got = warc.audit(recs, recs.dropDuplicates()).collect()
    assert sorted(r.status for r in got) == ["missing", "missing"]
    assert warc.leaves(recs).agg(F.min("record_id")).first()[0] < 0
