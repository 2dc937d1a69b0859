"""The quality classifier against given labels, which it never reads."""

import numpy as np

from hearthgrid.llm import quality_classifier as qc
from hearthgrid.llm import registry


def test_every_document_is_scored_and_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = registry.QUERIES["op2_quality_classifier"](spark, sf)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count() and set(rows) == {r["doc_id"] for r in docs.collect()}
    assert all(0 <= r["score"] <= 1 and r["quality"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.8
    assert np.mean([s >= 0.5 for s in good]) > 0.9


def test_em_finds_the_hidden_class():
    """Labellers of known accuracy; EM beats the majority's worst pattern and keeps the classes' sides."""
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    right = rng.random((20_000, qc.LABELLERS)) < np.array([0.95, 0.9, 0.9, 0.55, 0.55, 0.55, 0.55, 0.55])
    v = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    found, back, counts = np.unique(v @ 3 ** np.arange(qc.LABELLERS), return_inverse=True, return_counts=True)
    p = qc.posteriors(found, counts.astype(float))[back]
    majority = v.mean(axis=1) > 0.5
    assert ((p > 0.5) == truth).mean() > 0.95 > (majority == truth).mean()


def test_a_long_text_is_scored_whole():
    w = np.random.default_rng(1).standard_normal(qc.SLOTS).astype(np.float32) * 0.1
    text = "".join(chr(97 + k % 23) + " " * (k % 7 == 0) for k in range(qc.CHUNK * 2 // 3)) + "zzq " * qc.CHUNK
    data = b" " + text.encode() + b" "
    d = np.frombuffer(data, np.uint8).astype(np.uint64)
    slots = ((d[:-2] + d[1:-1] * 256 + d[2:] * 65536) * 2654435761 % 2**32) >> np.uint64(32 - qc.SLOT_BITS)
    want = 1 / (1 + np.exp(-w[slots.astype(int)].astype(float).mean()))
    assert abs(qc.score(text, w, 0.0) - want) < 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "some words here"), (1, None), (2, " \n"), (3, "a"), (3, "a"), (4, "good text. " * 50)], "doc_id long, text string")
    got = qc.classify(docs).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert qc.classify(docs.limit(0)).count() == 0
