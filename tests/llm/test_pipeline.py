"""The pipeline against a plain version of its stages; near copies are five-word shingle sets at a similarity of 0.8 or more."""

import corpus_pipeline
from hearthgrid.llm import decontamination, packing, registry
from tests.conftest import SF
from tests.llm.test_jaccard import brute_roots
from tests.llm.test_native_operators import brute_base


def test_pipeline_equals_plain_version(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in registry.QUERIES["op3_quality_rules"](spark, SF).where("kept").collect()}
    ids = sorted(good)
    roots = brute_roots([(i, docs[i]["text"]) for i in ids])
    first = {i for i in ids if roots[i] == i}
    bad = {r["doc_id"] for r in decontamination.op4_benchmark_decontamination(spark, SF).collect()}
    want = first - bad
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == want
    tokenizer = packing.RunTokenizer(packing.tokenizer_path())
    plain = {i for i in want if not brute_base(docs[i]["text"])}
    lengths = {i: len(tokenizer.ids([docs[i]["text"]])[0]) + 1 for i in plain}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert all(got[i] == lengths[i] for i in plain)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 100, "en", "s", 500), (3, " ".join(f"w{i}" for i in range(200)), None, "s", 1), (3, " ".join(f"w{i}" for i in range(200)), None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
