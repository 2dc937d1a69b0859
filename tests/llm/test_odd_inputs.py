"""Nulls, clashing names, repeated rows, long texts and many matches for the operators that others don't cover."""

import hashlib
import random
import time
from types import SimpleNamespace

import pytest

from hearthgrid.llm import common, decontamination, quality_rules, secret_scan, substring_dedup

KEY, ID, URL = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "user_id = alice99", "https://db.example.com/x"


def test_redaction_leaves_other_columns_alone(spark):
    names = "doc_id long, text string, secret string, hex string, assign string, ident string, endpoint string, access string, i string, k string, e string, t string, c string, base string, all string, far string"
    rows = [(1, f"{ID}\nkey {KEY} at {URL}", *[f"own{j}" for j in range(14)]), (1, None, *[None] * 14), (1, f"{ID}\nkey {KEY} at {URL}", *[f"own{j}" for j in range(14)])]
    df = spark.createDataFrame(rows, names)
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "[secret]\nkey [secret] at [secret]", *rows[0][2:]), rows[1], (1, "[secret]\nkey [secret] at [secret]", *rows[0][2:])]))
    assert secret_scan.redact(df.limit(0)).count() == 0


def test_links_of_many_parts_take_no_square_time(spark):
    near = [f"{ID} {KEY} {URL} " for _ in range(4_000)]
    texts = ["".join(near), f"{ID} " * 30_000 + "x " * 300 + f"{KEY} " * 3_000 + "y " * 300 + f"{URL} " * 10_000]
    began = time.perf_counter()
    got = {r["doc_id"]: r["spans"].split(",") for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 120
    assert len(got[0]) == 12_000 and got[1] == [""]


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice([ID, KEY, URL, "AKIA" + "Q" * 16, "token=abcdef1", "word " * rng.randrange(40)]) for _ in range(25)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.find_spans(df).collect()
    sizes = set()
    for r in rows:
        near = lambda x, ys: any(x["s"] - y["e"] <= 200 and y["s"] - x["e"] <= 200 for y in ys)
        text, certain = r["text"], [*r["assign"], *r["access"], *r["hex"]]
        places = lambda part: [{"s": i, "e": i + len(part)} for i in range(len(text)) if text.startswith(part, i)]
        free = lambda part: [x for x in places(part) if not any(y["s"] < x["e"] and x["s"] < y["e"] for y in certain)]
        i, k, e = free(ID), free(KEY), free(URL)
        ids, keys = [*i, *r["access"]], [*k, *r["assign"], *r["hex"]]
        want = [[x["s"] for x in i if near(x, keys)], [x["s"] for x in k if near(x, ids)], [x["s"] for x in e if near(x, ids) and near(x, keys)]]
        assert [sorted(x["s"] for x in r[c]) for c in ("ident", "secret", "endpoint")] == want
        sizes.add(tuple(map(len, want)))
    assert len(sizes) > 5


def test_rules_leave_the_columns_of_the_stage_alone(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "a", "b", 7), (1, good, "a", "b", 7), (2, None, None, None, None), (3, "!" * 500, "a", "b", 1), (None, good, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, `by` string, n_words int")
    out = quality_rules.kept_rows(df)
    assert out.columns == df.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[4]]))
    assert quality_rules.kept_rows(df.limit(0)).count() == 0
    assert quality_rules.kept_rows(df, rules=[]).count() == len(rows)


def test_levels_double():
    assert substring_dedup.levels(13) == [4, 8] and substring_dedup.levels(40) == [4, 8, 16, 32] and substring_dedup.levels(4) == [4] and substring_dedup.levels(2) == [2]


@pytest.mark.parametrize("window", [1, 2, 4, 5, 8, 9, 17])
def test_windows_of_any_length_equal_brute_force(spark, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(60))] + passage[rng.randrange(20) :] * rng.randrange(2)) for _ in range(40)] + [" ".join(["z"] * 30_000), None, ""]
    df = spark.createDataFrame([(i % 41, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, g int")
    first = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d % 41)
            first[tuple(w[i : i + window])] = min(first[tuple(w[i : i + window])], d % 41)
    want = []
    for d, t in enumerate(texts):
        w, gone = (t or "").split(), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d % 41:
                gone |= set(range(i, i + window))
        want.append((d % 41, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = substring_dedup.substring_dedup(df, window=window, group_docs=5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_candidate_with_the_answer_is_enough(spark):
    """A nearer copy without the answer doesn't hide one with it; parts of a long item count; parts change nothing here."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    item, filler = [word() for _ in range(40)], [word() for _ in range(2_000)]
    some = lambda n: [rng.choice(filler) for _ in range(n)]
    keep = lambda share: [w if rng.random() < share else rng.choice(filler) for w in item]
    early = [w if k % 20 < 13 else rng.choice(filler) for k, w in enumerate(item)]  # 0.65, its last words replaced
    late = [w if k % 5 < 2 or k >= 32 else rng.choice(filler) for k, w in enumerate(item)]  # below 0.6, with the last words
    long_item = [word() for _ in range(300)]
    docs = [(1, early), (2, some(80) + early + some(300) + late), (3, some(50) + late), (4, some(100) + long_item[120:220] + some(100)), (5, some(500)), (6, keep(0.9)), (6, keep(0.9)), (None, item)]
    df = spark.createDataFrame([(d, " ".join(w), 1, "x") for d, w in docs] + [(7, None, None, None), (8, "", 1, "x")], "doc_id long, text string, item_id int, cosine string")
    bench = spark.createDataFrame([(10, " ".join(item), "x"), (11, " ".join(long_item), "y"), (12, None, None), (13, "", "z"), (14, "two words", "z")], "item_id long, text string, doc_id string")
    told = []
    for part in (1 << 22, 1200, 400):
        rows = decontamination.contaminations(df, bench, part_bytes=part).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(2, 10), (3, 10), (4, 11), (6, 10), (None, 10)}
        told.append(sorted((r["doc_id"] or 0, r["item_id"], round(r["cosine"], 4), r["lcs_ratio"], r["answer_found"]) for r in rows))
    assert told[0] == told[1] == told[2]
    odd = spark.createDataFrame([(1, None, "an answer"), (2, "", "more"), (None, "words without an id", None)], "item_id long, text string, answer string")
    assert decontamination.contaminations(df, odd).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    empty = SimpleNamespace(isEmpty=lambda: True)
    inner = SimpleNamespace(getCheckpointDir=lambda: empty)
    stub = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: inner)))
    with pytest.raises(RuntimeError):
        common.shared_dir(stub)
