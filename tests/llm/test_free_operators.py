"""Operators that SQL can't express: brute force, round trips, held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from hearthgrid.llm import decontamination, html_text, language_id, packing, simhash
from tests.conftest import SF

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(ids, fps, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("cap", [1024, 2])
def test_simhash_equals_brute_force(spark, monkeypatch, cap):
    """With a cap of 2 nearly all buckets take the way for large ones."""
    monkeypatch.setattr(simhash, "BUCKET_CAP", cap)
    base = " ".join(f"word{i}" for i in range(300)).split()
    rng = random.Random(4)
    texts = [None, "", " \n", "A b", "a B", "Üb er", "x y z"]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(300)] = "other"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    ids, fps = list(range(len(texts))), [brute_fingerprint(t) for t in texts]
    want = brute_components(ids, fps)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (fps[i], want[i]) for i in ids}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        for k in range(n):
            for j in rng.integers(0, 64, rng.integers(0, 5)):
                b[k] ^= np.uint64(1 << int(j))
        for radius in (0, 1, 2, 3):
            assert (simhash.within_radius(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()


def test_bucket_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 70, 3, 1, 200, 65]
    group = np.repeat(np.arange(len(sizes)), sizes)
    fps = rng.integers(0, 1 << 63, len(group), dtype=np.uint64) & np.uint64(0x7F)
    a, b = simhash.bucket_links(group, fps)
    ids = list(range(len(group)))
    want = {}
    for g in range(len(sizes)):
        own = [i for i in ids if group[i] == g]
        want |= brute_components(own, [int(fps[i]) for i in own])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {i: r for i, r in want.items() if i != r}
    assert [len(x) for x in simhash.bucket_links(group[:0], fps[:0])] == [0, 0]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges, "chain").collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_odd_inputs(spark):
    rows = [("the quick brown fox and the dog", "en"), ("le renard et la forêt avec des arbres", "fr"), (None, "en"), ("text", None), ("", "fr")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the fox"), (None, "la forêt"), (6, "the fox " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[None][0] == "fr" and got[6][0] == "en"
    empty = language_id.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}


def plain_kneser_ney(text, order=4):
    """log probability of a character after a context, by the formula over dictionaries; unseen contexts back off whole."""
    padded = " " * (order - 2) + text
    counts = {order: {}}
    for i in range(len(padded) - order + 1):
        g = padded[i : i + order]
        counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discount(k):
        ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        return min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5

    def prob(g):
        k, d = len(g), discount(len(g))
        same = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if k == 1:
            return (max(counts[1].get(g, 0) - d, 0) + d * len(same) / (len(same) + 1)) / total
        if not total:
            return prob(g[1:])
        return (max(same.get(g, 0) - d, 0) + d * len(same) * prob(g[1:])) / total

    return prob


def test_kneser_ney_equals_the_formula():
    rng = random.Random(9)
    text = language_id.fold(" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(400)))
    g, n = np.unique(language_id.codes(text), return_counts=True)
    model, prob = language_id.kneser_ney({"x": (g, n)}), plain_kneser_ney(text)
    probes = [text[i : i + 4] for i in range(0, len(text) - 4, 7)] + ["abcd", "éééé", " aé ", "ddd ", "zabc", "zzab", "zzza"]
    codes = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(p)) for p in probes], np.uint64)
    assert np.allclose(np.exp(model.log_probs(codes)[:, 0]), [prob(p) for p in probes], rtol=1e-4)


def test_no_language_loses_grams_to_another(spark):
    """Every gram of the drawn documents is in the model, however many others there are."""
    rng = random.Random(1)
    big = [("".join(rng.choice("abcdefghij") for _ in range(200)), "big") for _ in range(40)]
    small = [("χψω φχψ", "small")] * 3
    model = language_id.train(spark.createDataFrame(big + small, "text string, lang string"))
    want = np.unique(language_id.codes(language_id.fold(small[0][0])))
    assert np.isin(want, model.grams[-1]).all() or not len(small)
    docs = spark.createDataFrame([(1, "φχψ ωχψ", "x"), (1, "φχψ ωχψ", "y"), (2, "½ ②", "z"), (3, "Ⅷ 9", "z"), (4, "𐐀𐐁 𐐂", "z"), (5, "e\u0301", "z")], "doc_id long, text string, lang_pred string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, model).collect())
    assert got[:4] == [(1, "small"), (1, "small"), (2, "und"), (3, "und")] and got[4][1] != "und" and got[5][1] != "und"
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rng, items = random.Random(3), bench.collect()
    clean = [r["text"] for r in docs.collect() if 400 < len(r["text"]) < 5000]
    words = sorted({w for t in clean for w in t.split()})
    planted = []
    for i, r in enumerate(items):
        w = [x if rng.random() > 0.1 else rng.choice(words) for x in r["text"].split()] if i % 2 else r["text"].upper().split()
        c = rng.choice(clean).split()
        k = rng.randrange(len(c))
        planted.append((100_000 + i, " ".join(c[:k] + w + c[k:])))
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*planted, (None, items[0]["text"]), (7_000_000, None), (7_000_001, "")], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(all_, bench).collect()}
    hit = [(100_000 + i, r["item_id"]) in got for i, r in enumerate(items)]
    assert all(hit[::2]) and sum(hit[1::2]) / len(hit[1::2]) > 0.9
    assert (None, items[0]["item_id"]) in got
    grams = {}
    for r in items:
        w = re.findall(r"\w+", r["text"].lower())
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), r["item_id"])
    for r in docs.collect():  # documents that share no eight words with an item stay clean
        w = re.findall(r"\w+", r["text"].lower())
        found = {grams[t] for k in range(len(w) - 7) if (t := tuple(w[k : k + 8])) in grams}
        assert {i for d, i in got if d == r["doc_id"]} <= found
    assert decontamination.contaminations(all_.limit(0), bench).count() == 0
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


def test_randomised_svd_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    left, right = rng.standard_normal((60, 5)), rng.standard_normal((5, 30))
    a = left @ right
    df = spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "terms array<int>, weights array<double>")
    basis = decontamination.randomised_svd(df, 30, rank=8)
    assert np.abs(a - a @ basis @ basis.T).max() < 1e-3 * np.abs(a).max()


def test_lcs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 20))], [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(np.array(a), np.array(b), 5) == t[-1][-1]


ODD_TEXTS = [None, "", "a", "hello world " * 9000, "A*<|endoftext|>b", "é's l'L ½ 😀", "ÀÉß ÷×² àéÿ÷a µª", "don't I'LL 12ab a\x1cb\x85c"]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["same text here"] * 500
    df = spark.createDataFrame([(i if i != 2 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(df, with_ids=True).collect()
    got = {}
    for r in rows:
        got.setdefault(2 if r["doc_id"] is None else r["doc_id"], []).append(r)
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(got[d], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == want
        assert [r["start"] for r in parts] == list(range(0, len(want), 4096)) and all(r["length"] == 4096 for r in parts[:-1])
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in parts)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= 1.01 * sum(r["length"] for r in rows) / 4096 + 1
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pattern_packing_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6 + seed / 2, 1, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.pack_counts(counts)
    used = np.zeros(4097, int)
    for pattern, times in plan:
        assert sum(pattern) <= 4096 and times > 0
        for v in pattern:
            used[v] += times
    assert (used == counts).all()
    big = int((lengths > 2048).sum())
    assert sum(t for _, t in plan) <= 1.01 * max(lengths.sum() / 4096, big) + 1


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>'
    '<div id="content"><article class="post"><header>By me</header><h1>Head &amp; line</h1><p>First <b>bold</b>\n text&nbsp;here, long enough to count as text of the page.<br>Next line<p>Second<div class="ad">Buy</div>'
    "<ul><li>one<li>two</ul><form>Name <input></form><section id=comments><p>Nice article, I liked it very much indeed, thank you for it</section></article><aside>Side</aside></div><footer>&copy; foot</footer>"
)


def test_html_extraction():
    assert html_text.extract(PAGE) == "Head & line First bold text here, long enough to count as text of the page. Next line Second one two"
    bare = "<body><div class=menu><a href=x>a</a> <a href=y>b</a></div><div><p>Some long paragraph of text without any link in it at all.</p><p>And another one of about the same length.</p></div><div class=footer>foot</div>"
    assert html_text.extract(bare) == "Some long paragraph of text without any link in it at all. And another one of about the same length."
    assert [html_text.extract(x) for x in (None, "", "  ", "<p>", "plain < text", "<a" * 1000)][:5] == ["", "", "", "", "plain < text"]
    assert html_text.extract("<article>" + "<div>" * 5000 + "deep" + "</article>") == "deep"


def test_html_pages(spark):
    import html as h

    for r in html_text.op10_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub(r"</?b>", "", body))
        assert r["text"] == " ".join(x for x in (" ".join(h.unescape(p).split()) for p in parts) if x) and r["n_chars"] == len(r["text"])
