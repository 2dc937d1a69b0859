"""Lexical search, MinHash near-duplicates, importance resampling, and hashes that words built to collide don't fool."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hearthgrid.llm import common, importance, lexical_search, minhash, packing, substring_dedup
from tests.conftest import SF, rows_of
from tests.llm.test_free_operators import FOLD

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_minhash_near_dedup", "op13_importance_resampling"])
def test_query_equals_sql(spark, duck, name):
    from hearthgrid.llm import registry

    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# --- words that collide under a polynomial modulo a power of two, whatever its base


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_built_to_collide_differ(spark):
    x, y = thue_morse(2048, 0), thue_morse(2048, 1)
    for seed in (0, 1):
        h, counts = common.word_hashes([f"{x} {y}".encode(), x.encode()], seed=seed)
        assert counts.tolist() == [2, 1] and h[0] != h[1] and h[0] == h[2]
    rest = " ".join(f"w{k}" for k in range(12))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{x} {rest}")], DOCS)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 13}
    tokenizer = packing.RunTokenizer(packing.tokenizer_path())
    for text, ids in zip([f"{x} {y}", f"{y} a", x], tokenizer.ids([f"{x} {y}", f"{y} a", x]), strict=True):
        assert ids.tolist() == tokenizer.own.encode(text, add_special_tokens=False).ids


def test_word_hashes_go_over_pieces(monkeypatch):
    text = " ".join(f"w{k % 7}" for k in range(500)).encode()
    want = common.word_hashes([text, b"", b" a "])
    monkeypatch.setattr(common, "CHUNK", 16)
    got = common.word_hashes([text, b"", b" a "])
    assert (got[0] == want[0]).all() and got[1].tolist() == [500, 0, 1]


# --- lexical search


def brute_search(docs, items, top=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = {}
    for i, t in docs:
        if i is not None:
            held.setdefault(i, Counter()).update(term.findall((t or "").translate(FOLD)))
    held = {i: c for i, c in held.items() if c}
    n_docs, n_all = len(held), sum(sum(c.values()) for c in held.values())
    df = Counter(t for c in held.values() for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(term.findall((t or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held.items():
            m = 25 + 75 * sum(c.values()) * n_docs // n_all
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in terms.items() if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "block"), [(4, 1 << 20), (2048, 1 << 20), (2048, 40)])
def test_search_equals_brute_force(spark, window, block):
    rng = random.Random(3)
    words = ["the", "The", "of", "ångström", "x1", "ﬁ", "data", "query", "spark", "rare", "Zug"]
    docs = [(k * 3 - 40, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for k in range(80)]
    docs += [(500, None), (501, ""), (502, "--- !!"), (None, "rare rare spark"), (-7, docs[3][1]), (503, "the"), (504, "the"), (503, "data")]
    docs += [(9_000_000_000, "spark " * 5000 + "tail"), (-9_000_000_000, "spark query")]
    items = [(1, "the data of spark"), (2, "rare RARE x1, ångström!"), (3, None), (4, ""), (5, "nowhere"), (6, "tail"), (1, "zug"), (None, "query")]
    d = spark.createDataFrame([(*x, 1, "a") for x in docs], "doc_id long, text string, window long, term string").repartition(3)
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, score long")
    got = lexical_search.search(d, i, window=window, block_bytes=block).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_search(docs, items)


def test_search_pieces_and_empty_tables(spark, monkeypatch):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b a"), (2, "b c")], DOCS)
    items = spark.createDataFrame([("q", "a c")], "item_id string, text string")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(some, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.search(some, items, top=1).collect()] == [("q", 1, 1)]
    monkeypatch.setattr(lexical_search, "PIECE", 8)
    text = " ".join(f"w{k % 5}" for k in range(400))
    (batch,) = lexical_search._postings(type("B", (), {"value": {b"w1": 0, b"w9": 1}}), 4)([pa.RecordBatch.from_pydict({"doc_id": pa.array([6], pa.int64()), "text": [text]})])
    assert batch.to_pylist() == [{"window": 1, "term": -1, "slots": [2], "counts": [400]}, {"window": 1, "term": 0, "slots": [2], "counts": [80]}]


def test_heap_keeps_smaller_documents_on_ties():
    heap = lexical_search.Heap(3)
    heap.add(np.array([5, 5, 5, 5, 1]), np.array([9, 8, 7, 6, 1]))
    heap.add(np.array([5, 6]), np.array([2, 50]))
    assert sorted(heap.held) == [(5, -6), (5, -2), (6, -50)]


# --- MinHash near-duplicates


def brute_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append((i, frozenset(tuple(w[k : k + 2]) for k in range(max(len(w) - 1, 1 if w else 0)))))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = {i: i for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root, {i: len(s) for i, s in sets}


def family(rng, base, n, most, ids):
    """Variants of one text with up to ``most`` of its words replaced, so links chain and not all variants are similar."""
    words = [f"w{base}x{k}" for k in range(rng.randrange(30, 200))]
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(0, max(2, int(len(w) * most)))):
            w[rng.randrange(len(w))] = f"other{rng.randrange(5000)}"
        ids.append((len(ids) + 1, " ".join(w)))


@pytest.mark.parametrize(("most", "cell", "stars"), [(0.04, 512, 3), (0.12, 8, 1), (0.12, 512, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, most, cell, stars):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "STARS", stars)
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "two one"), (8, "ONE two")]
    for base in range(8):
        family(rng, base, 14, most, rows)
    want, sizes = brute_components(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, digest int, label string").repartition(5)
    got = minhash.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "A b c d"), (None, "z z z"), (None, None), (9, long), (8, long + " end"), (7, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, None), (None, 1, None, None), (None, 0, None, None), (9, 29_999, 8, False), (8, 30_000, 8, True), (7, 0, 7, True)], key=repr)


def test_tables_take_the_square_root_of_the_minhashes():
    a = np.unique(common.mix64(np.arange(1000, dtype=np.uint64)))
    mins = minhash.minhashes([a, a[:-1]])
    assert mins.shape == (2, 2 * minhash.EACH * minhash.HALVES) and (mins[0] == mins[1]).mean() > 0.97
    assert len(set(minhash.half_keys(mins)[0].tolist())) == 2 * minhash.HALVES
    below = sum(math.comb(minhash.HASHES, k) * 0.8**k * 0.2 ** (minhash.HASHES - k) for k in range(minhash.least_marks()))
    assert below < minhash.LOSS
    b = np.append(a[:-100], common.mix64(np.arange(5000, 5090, dtype=np.uint64)))
    differ = np.bitwise_count(minhash.bitmap(a) ^ minhash.bitmap(b)).sum()
    assert 0 < differ <= len(np.setxor1d(a, b))


# --- importance resampling


def brute_features(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def test_automaton_equals_plain_crc(monkeypatch):
    rng = random.Random(2)
    alphabet = "abzAZ019 \n-_@[`{~éßЖ中\U0001f600\x7f"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(200)] + [None, "", "Word", "word", "x" * 5000, "é" * 300 + " y"]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(importance, "PIECE", piece)
        for array in (pa.array(texts), pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
            got = [(int(r), int(b)) for row, bucket in importance.features(array, 10_000) for r, b in zip(row, bucket, strict=True)]
            assert got == [(k, zlib.crc32(w.encode()) % 10_000) for k, t in enumerate(texts) for w in brute_features(t)]
    assert list(importance.features(pa.array([], pa.string()))) == []


def brute_resample(docs, target, percent, least, buckets, seed=2024):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(bucket(w) for _, x in docs for w in brute_features(x)), Counter(bucket(w) for x in target for w in brute_features(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, x in docs:
        w = brute_features(x)
        weight = sum(gain[bucket(f)] for f in w) // len(w) if w else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(w), weight, score))
    can = sorted((-r[3], r[0]) for r in rows if r[0] is not None and r[1] >= least)
    drawn = {i: k + 1 for k, (_, i) in enumerate(can[: len(can) * percent // 100])}
    return sorted([(*r, drawn.get(r[0])) for r in rows], key=repr)


@pytest.mark.parametrize(("percent", "least"), [(10, 20), (50, 0), (0, 3), (100, 3)])
def test_resample_equals_brute_force(spark, percent, least):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(0, 60)))) for k in range(120)] + [(200, None), (201, ""), (None, "w1 w2 w3 w4"), (202, "A-b_C"), (203, "w59 " * 4000)]
    target = ["w1 w2 w3", None, "w4 w1"]
    d = spark.createDataFrame([(*x, 3, 1) for x in docs], "doc_id long, text string, score int, _row int").repartition(4)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, percent=percent, least_words=least, buckets=97).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_resample(docs, target, percent, least, 97)


def test_resample_repeated_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "a b c")] * 4 + [(2, "c d e")], DOCS)
    none = spark.createDataFrame([], DOCS)
    got = importance.resample(one, none, percent=80, least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert importance.resample(none, one).collect() == []


def test_ranks_go_over_ranges(spark):
    rows = common.materialize(spark.range(5000).selectExpr("id as doc_id", "pmod(hash(id), 40) as score", "id as _row"), "ranges")
    got = sorted(importance.ranked(rows.selectExpr("doc_id", "cast(score as long) as score", "_row"), 1234).where("rank is not null").collect(), key=lambda r: r["rank"])
    want = sorted(rows.collect(), key=lambda r: (-r["score"], r["doc_id"]))[:1234]
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want] and [r["rank"] for r in got] == list(range(1, 1235))


# --- packing: the fit is least squares, and ranks come from cells of a length's own size


def test_fit_is_non_negative_least_squares():
    rng = random.Random(5)
    counts = np.zeros(101, np.int64)
    for _ in range(12):
        counts[rng.randrange(5, 100)] += rng.randrange(1, 400)
    patterns = packing.patterns_of(counts, 100)
    a = np.zeros((101, len(patterns)))
    for k, p in enumerate(patterns):
        for v in p:
            a[v, k] += 1
    s = np.arange(101) / 100
    a, want = a * s[:, None], counts * s
    x = packing.fit_counts(patterns, counts, 100, rounds=4000)
    gradient = a.T @ (a @ x - want)
    scale = np.abs(a.T @ want).max()
    assert (x >= 0).all() and (gradient > -0.01 * scale).all() and np.abs(gradient * x).max() < 0.01 * scale * x.max()
    y = np.zeros(len(patterns))  # projected gradient from zero
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        y = np.maximum(y - step * (a.T @ (a @ y - want)), 0)
    assert ((a @ x - want) ** 2).sum() <= 1.02 * ((a @ y - want) ** 2).sum() + 1e-3 * (want**2).sum()


def test_pieces_of_one_length_are_ranked_in_several_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 3)
    rows = [(k, "word") for k in range(40)] + [(100 + k, "two words here") for k in range(5)] + [(None, None)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), capacity=16).collect()
    assert len(got) == len(rows)
    for places in [[r for r in got if r["sequence_id"] == q] for q in {r["sequence_id"] for r in got}]:
        edges = sorted((r["offset"], r["length"]) for r in places)
        assert edges[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(edges, edges[1:], strict=False)) and sum(n for _, n in edges) <= 16


# --- passing tables


@pytest.mark.parametrize("name", ["op6_simhash_near_dedup", "op9_best_fit_packing", "op11_lexical_search", "op12_minhash_near_dedup", "op13_importance_resampling", "pipeline"])
def test_nothing_is_left_behind(spark, name):
    """What a query still reads is all that it leaves, and its caller can delete that."""
    import corpus_pipeline
    from hearthgrid.llm import registry

    folder = common.shared_dir(spark).removeprefix("file:")
    before, mine = set(os.listdir(folder)), common.written()
    out = corpus_pipeline.run(spark, SF) if name == "pipeline" else registry.QUERIES[name](spark, SF)
    assert out.count() > 0
    left = common.written() - mine
    assert len(left) <= 3 and len(set(os.listdir(folder)) - before) == len(left)
    common.discard_but(spark, *mine)
    assert set(os.listdir(folder)) == before
