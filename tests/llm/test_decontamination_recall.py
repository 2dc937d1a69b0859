"""Recall of altered benchmark items must not fall as the corpus grows."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from hearthgrid.llm import decontamination as dc

SF = "/root/testdata/sf0.01"


def model(texts, documents):
    """The items with weights as of ``documents`` documents like ``texts``."""
    items = dc.read_items([r | {"answer": None} for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()])
    seen = Counter(t for x in texts for t in set(items.terms([x])[0].tolist()))
    counts = np.array([seen[t] for t in range(len(items.vocab))]) * (documents / len(texts))
    items.idf = np.log((documents + 2) / np.append(counts + 0.5, 1.5)).astype(np.float32)
    rows = np.zeros((len(items.unit_of), len(items.vocab)), np.float32)
    for row, (t, w) in zip(rows, dc.passage_rows(items), strict=True):
        row[t] = w
    dc.place(items, np.linalg.svd(rows, full_matrices=False)[2][: dc.RANK].T)
    return items


@pytest.mark.parametrize("replaced", [0.25, 0.4])
def test_altered_items_are_found_in_a_large_corpus(replaced):
    texts = [dc.normalise(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    texts = [t for t in texts if 400 < len(t) < 5000]
    items, rng = model(texts, 10_000_000), random.Random(8)
    plain = [dc.normalise(r["text"]).decode().split() for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    pool, due, docs = [w for t in texts for w in t.decode().split()], [], []
    for i in [k % len(plain) for k in range(400)]:
        w = [x if rng.random() > replaced else rng.choice(pool) for x in plain[i]]
        c = rng.choice(texts).decode().split()
        at = rng.randrange(len(c))
        docs.append(" ".join(c[:at] + w + c[at:]).encode())
        own, put, answer = items.words[i], items.terms([docs[-1]])[0][at : at + len(w)], items.answers[i]
        ratio = dc.lcs(own, put, len(items.vocab)) / len(own)
        if ratio >= dc.SURE or (ratio >= dc.LIKELY and dc.lcs(answer, put, len(items.vocab)) >= dc.ANSWER * len(answer)):
            due.append((len(docs) - 1, i))
    found = {(d, i) for d, i, *_, contaminated in dc.matches(items, docs) if contaminated}
    assert len(due) > 30 and len(set(due) - found) <= 0.05 * len(due)
