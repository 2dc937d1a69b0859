"""The pipeline's near copies against brute force at five-word Jaccard 0.8."""

import random
import re

import pytest

from hearthgrid.llm import jaccard, simhash
from tests.conftest import SF
from tests.llm.test_free_operators import FOLD


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0)))


def brute_roots(rows):
    """Smallest id of the component of each (id, text)."""
    sets = sorted((i, brute_set(t)) for i, t in rows)
    root = {i: i for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if root[i] != root[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("sample", [64, 1])
def test_stage_equals_brute_force(spark, monkeypatch, sample):
    """With a sample of all documents, shingles of eight of them come last in the order."""
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "a b", "A b", "a b c d e", "a b c d e f"])]
    line = "this line is in all of the documents of the family".split()
    for base in range(12):
        words = [f"w{base}x{k}" for k in range(rng.randrange(40, 300))] + line
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"other{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    want = brute_roots(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(df).collect()} == want
    kept = {r["doc_id"] for r in simhash.stage(spark, df, SF).collect()}
    assert kept == {i for i, r in want.items() if i == r}
    assert kept != {r["doc_id"] for r in simhash.near_duplicates(df).where("doc_id = component_id").collect()}
