"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``SPAN`` words; a word's weight is its frequency there times its inverse document
frequency over all documents. A randomised SVD of the passages' TF-IDF matrix (subspace iteration whose products are Spark
jobs over the passages) gives a latent space; windows of every document are projected into it and compared with all
passages by cosine. For each candidate, the longest common subsequence of the item and the document's words around the
window decides: ``SURE`` of the item is a copy; from ``LIKELY`` on, a paraphrase, if the item's answer (its ``answer``
column, else its last words) is found there too. Each candidate is judged by itself, and one is enough.

The benchmark is a query set that every document meets, in blocks. Vocabulary, weights and latent space are those of the whole
benchmark, made once in Spark; only the items themselves are cut, by a hash, into parts of about ``PART_BYTES``, each with its own
pass over the documents. So the size of a part changes what a task holds, never a match. What grows with the benchmark without
parts is its vocabulary: each different word takes ``RANK`` numbers on the driver and in a broadcast. Documents are handled where
they're scanned and never shuffled.

Defined results: null or wordless text has no match, null or wordless items match nothing; items shorter than ``LEAST``
words match only as a whole run of words; a null doc_id's matches are returned under the null id; repeated rows are all
looked at; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, byte_set, discard, materialize, table, word_pieces

SPAN, STRIDE = 24, 6
RANK, POWER_STEPS, SEED = 256, 2, 20
#: Most words of an item that are judged as one.
UNIT = 80
#: Bytes of benchmark text (about 25,000 items) that a task compares with at once. That bounds the units and the passages'
#: points (rank numbers for each 12 words) that the driver collects and broadcasts together.
PART_BYTES = 4 << 20
#: Least cosine of a candidate window in the latent space.
COSINE = 0.5
SURE, LIKELY, ANSWER = 0.7, 0.5, 0.8
#: Items below this number of words have too little text for a cosine.
LEAST = 8
BATCH_BYTES = 2 << 20
#: Candidates that are compared word by word together.
HELD = 50_000

_SLOT_BITS = 20
_SLOT_SHIFT = np.uint64(64 - _SLOT_BITS)
#: UTF-8 of the marks and spaces from U+0080 to U+00BF, U+2000 to U+206F and U+3000 to U+303F.
_ODD_MARKS = re.compile(rb"(?:\xC2[\x80-\xBF]|\xE2\x80[\x80-\xBF]|\xE2\x81[\x80-\xAF]|\xE3\x80[\x80-\xBF])+")
_WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(0x80, 0x100))
_MARKS = ~byte_set(_WORD_BYTES)
_RESULT = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_found boolean, contaminated boolean"


def normalise(text: str | None) -> bytes:
    low = (text or "").lower().encode()
    return _ODD_MARKS.sub(b" ", low) if b"\xc2" in low or b"\xe2" in low or b"\xe3" in low else low


@dataclass
class Items:
    """Benchmark items in terms of a vocabulary, cut into units that are judged by themselves, and the latent space of all passages.

    ``ids``, ``words`` and ``answers`` have a row for each unit. What all parts of a benchmark share (``_SHARED``) travels once.
    """

    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)
    lengths: np.ndarray | None = None
    #: Sorted unit * (vocabulary + 1) + term, and how often the unit has the term.
    bag_keys: np.ndarray | None = None
    bag_counts: np.ndarray | None = None
    #: The words in order, and their numbers.
    vocab: list[bytes] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)
    maybe: np.ndarray | None = None
    idf: np.ndarray | None = None
    unit_of: np.ndarray | None = None
    offset: np.ndarray | None = None
    #: Weight of each word times its row of the basis; zeros for words outside.
    weighted: np.ndarray | None = None
    passages: np.ndarray | None = None

    def index(self) -> Items:
        """Adds a filter that answers most look-ups of the bags' keys at once."""
        self.maybe = np.zeros(1 << _SLOT_BITS, bool)
        self.maybe[_key_slot(self.bag_keys)] = True
        return self

    def shared(self) -> Items:
        return Items(**{k: getattr(self, k) for k in _SHARED})

    def within(self, space: Items) -> Items:
        return replace(self, **{k: getattr(space, k) for k in _SHARED})

    def terms(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word of all texts in the vocabulary, or its size for words outside, and the number of words of each text."""
        get, n, counts, out, words = self.number.get, len(self.vocab), np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], []
        for k, more in word_pieces(texts, _MARKS):
            counts[k] += len(more)
            words += more
            if len(words) > CHUNK // 8:
                out.append(np.fromiter(map(get, words, repeat(n)), np.int32, len(words)))
                words = []
        out.append(np.fromiter(map(get, words, repeat(n)), np.int32, len(words)))
        return np.concatenate(out), counts


_SHARED = ("vocab", "number", "idf", "weighted")


def _key_slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> _SLOT_SHIFT


def spans(n: int, size: int, step: int) -> list[int]:
    """Starts of windows over n words; the last one ends at the end."""
    if n <= size:
        return [0]
    out = list(range(0, n - size + 1, step))
    return out if out[-1] == n - size else [*out, n - size]


def words_of_bytes(text: bytes) -> list[bytes]:
    return [w for _, more in word_pieces([text], _MARKS) for w in more]


def named(vocab: list[bytes]) -> Items:
    return Items(vocab=vocab, number={w: k for k, w in enumerate(vocab)})


def read_items(rows: list, space: Items | None = None) -> Items:
    """Items in terms of the space's vocabulary, else of their own.

    Items longer than UNIT words are judged by overlapping units of that many, so a long verbatim part counts.
    """
    kept = []
    for r in rows:
        h = words_of_bytes(normalise(r["text"]))
        if r["item_id"] is not None and h:
            a = words_of_bytes(normalise(r["answer"])) if r["answer"] else h[-max(3, len(h) // 5) :]
            kept += [(r["item_id"], h[k : k + UNIT], a) for k in spans(len(h), UNIT, UNIT // 2)]
    out = (space or named(sorted({w for k in kept for part in k[1:] for w in part}))).shared()
    out.ids = [k[0] for k in kept]
    if not kept:
        return out
    out.words, out.answers = ([np.array([out.number[w] for w in k[j]], np.int32) for k in kept] for j in (1, 2))
    out.lengths = np.array([len(w) for w in out.words])
    keys = np.repeat(np.arange(len(kept)), out.lengths) * (len(out.vocab) + 1) + np.concatenate(out.words)
    out.bag_keys, out.bag_counts = np.unique(keys, return_counts=True)
    places = [(i, s) for i, w in enumerate(out.words) for s in spans(len(w), SPAN, SPAN // 2)]
    out.unit_of, out.offset = (np.array(x, np.int64) for x in zip(*places, strict=True))
    return out.index()


def _term_counts(model):
    """Documents of each batch that hold each term; the term -1 counts the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = model.value
        for b in batches:
            total = np.zeros(len(items.vocab) + 1, np.int64)
            for _, texts in _grouped(b):
                terms, counts = items.terms(texts)
                edge = np.cumsum(np.append(0, counts))
                some = max(1, (1 << 24) // len(total))
                for i in range(0, len(texts), some):
                    j = min(i + some, len(texts))
                    held = np.zeros((j - i, len(total)), bool)
                    held[np.repeat(np.arange(j - i), counts[i:j]), terms[edge[i] : edge[j]]] = True
                    total += held.sum(axis=0)
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], b.num_rows))], names=["term", "n"])

    return run


def weigh(items: Items, rows: DataFrame) -> Items:
    """Adds the words' weights over all documents; one number for each word of the block reaches the driver."""
    model = rows.sparkSession.sparkContext.broadcast(items)
    found = rows.mapInArrow(_term_counts(model), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts, total = np.zeros(len(items.vocab) + 1), 0
    for t, n in zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True):
        if t < 0:
            total = n
        else:
            counts[t] = n
    items.idf = np.log((total + 2) / (counts + 0.5)).astype(np.float32)
    return items


def _products(basis: np.ndarray):
    """For rows (terms, weights) of A: the partial sums of A' (A basis), one row for each term of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[int, np.ndarray] = {}
            for terms, weights in zip(b.column("terms"), b.column("weights"), strict=True):
                t, w = np.array(terms.as_py(), np.int64), np.array(weights.as_py())
                y = w @ basis[t]
                for k, x in zip(t.tolist(), w, strict=True):
                    total[k] = total.get(k, 0) + x * y
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["term", "row"])

    return run


def randomised_svd(matrix: DataFrame, terms: int, rank: int = RANK, steps: int = POWER_STEPS, seed: int = SEED) -> np.ndarray:
    """Orthonormal right singular vectors (terms x rank) of the rows (terms, weights) of ``matrix``.

    A random start is multiplied by A'A in Spark ``steps`` times, orthonormalised in between. What moves is terms x rank
    numbers, bounded by the block of items whose vocabulary the terms are.
    """
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(rank, terms))))[0]
    for _ in range(steps + 1):
        parts = matrix.mapInArrow(_products(basis), "term long, row array<double>")
        summed = parts.groupBy("term").agg(F.array(*[F.sum(F.col("row")[k]) for k in range(basis.shape[1])]).alias("row")).toArrow()
        new = np.zeros_like(basis)
        new[summed.column("term").to_numpy()] = np.array(summed.column("row").to_pylist()).reshape(-1, basis.shape[1])
        q, r = np.linalg.qr(new)
        basis = q[:, np.abs(np.diag(r)) > 1e-9 * max(np.abs(np.diag(r)).max(), 1e-300)]
    return basis.astype(np.float32)


def passage_rows(items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of each passage; weights are of length one."""
    for i, s in zip(items.unit_of.tolist(), items.offset.tolist(), strict=True):
        t, n = np.unique(items.words[i][s : s + SPAN], return_counts=True)
        w = items.idf[t] * n
        yield t, w / np.linalg.norm(w)


def place(items: Items, basis: np.ndarray) -> Items:
    """Adds the latent space given by the right singular vectors, and the passages' points in it."""
    items = lay(items, basis)
    return items if not items.ids else stand(items, basis)


def lay(space: Items, basis: np.ndarray) -> Items:
    # rows that lie together in memory are several times faster to gather
    space.weighted = np.ascontiguousarray(np.vstack([space.idf[:-1, None] * basis, np.zeros((1, basis.shape[1]))]), np.float32)
    return space


def stand(items: Items, basis: np.ndarray) -> Items:
    points = np.array([w.astype(np.float32) @ basis[t] for t, w in passage_rows(items)])
    items.passages = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    return items


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: set[bytes] = set()
        for r in b.to_pylist():
            if words := words_of_bytes(normalise(r["text"])):  # an answer without a question is no item
                found.update(words, words_of_bytes(normalise(r["answer"])))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])


def _passages(model):
    """(terms, weights) of the passages of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Items = model.value
        for b in batches:
            items = read_items(b.to_pylist(), space)
            rows = list(passage_rows(items)) if items.ids else []
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k].astype(t) for r in rows], kind) for k, t, kind in zip((0, 1), ("int32", "float64"), kinds, strict=True)], names=["terms", "weights"])

    return run


def whole_space(queries: DataFrame, rows: DataFrame) -> tuple[Items, np.ndarray]:
    """Vocabulary and weights of all items (item_id, text, answer), and the singular vectors of their passages.

    The driver gets the different words, a count and ``RANK`` numbers for each; texts and passages stay with the tasks.
    """
    words = queries.select("text", "answer").mapInArrow(_vocabulary, "word binary").distinct().toArrow()
    space = named(sorted(words.column("word").to_pylist()))
    if not space.vocab:
        return space, np.zeros((0, 0), np.float32)
    space = weigh(space, rows)
    model = rows.sparkSession.sparkContext.broadcast(space)
    matrix = materialize(queries.mapInArrow(_passages(model), "terms array<int>, weights array<double>"), "passages")
    basis = randomised_svd(matrix, len(space.vocab))
    discard(matrix)
    return lay(space, basis), basis


def lcs(a: np.ndarray, b: np.ndarray, outside: int) -> int:
    """Length of the longest common subsequence, a bit of one integer for each place of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if x != outside and (m := masks.get(x)):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def shared(items: Items, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each (text, unit, start, end): the words that the unit and the area share, each as often as in both.

    No common subsequence is longer, so this tells which areas can't reach LIKELY.
    """
    out = np.zeros(len(places), np.int64)
    v = len(items.vocab) + 1
    for at in range(0, len(places), 2048):
        _, unit, a, b = places[at : at + 2048].T
        size = b - a
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        key = unit[owner] * v + terms[np.arange(len(owner)) + (a - begin)[owner]]
        # the filter passes too many words at worst; repeats and the keys themselves matter only where they are enough
        hit = items.maybe[_key_slot(key)]
        enough = np.bincount(owner[hit], minlength=len(size)) >= LIKELY * items.lengths[unit]
        hit = np.flatnonzero(hit & enough[owner])
        owner, key = owner[hit], key[hit]
        held = np.minimum(np.searchsorted(items.bag_keys, key), len(items.bag_keys) - 1)
        own = items.bag_keys[held] == key
        pair, often = np.unique(owner[own] * len(items.bag_keys) + held[own], return_counts=True)
        most = np.minimum(often, items.bag_counts[pair % len(items.bag_keys)])
        out[at : at + 2048] = np.bincount(pair // len(items.bag_keys), most, len(size)).astype(np.int64)
    return out


def _window_points(items: Items, terms: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start in it, latent point) of windows of SPAN words, every STRIDE words; a text's last one may be shorter.

    A window is the sum of the points of SPAN // STRIDE neighbouring blocks, so each word is projected once.
    """
    each, out = SPAN // STRIDE, len(items.vocab)
    blocks = np.where(counts > 0, np.maximum(-(-counts // STRIDE), each), 0)
    owner, first = np.repeat(np.arange(len(counts)), blocks), np.cumsum(blocks) - blocks
    nth = np.arange(len(owner)) - first[owner]
    padded = np.full(len(owner) * STRIDE, out, np.int32)
    start = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    padded[first[text] * STRIDE + np.arange(len(terms)) - start[text]] = terms
    padded = padded.reshape(-1, STRIDE)
    step = 512
    for at in range(0, len(owner), step):
        part = padded[at : at + step + each - 1]
        sums = items.weighted[part[:, 0]]
        for j in range(1, STRIDE):
            sums += items.weighted[part[:, j]]
        n = len(part) - each + 1
        whole = np.flatnonzero(owner[at : at + n] == owner[at + each - 1 : at + each - 1 + n])
        points = sums[:n] + sums[1 : 1 + n]
        for j in range(2, each):
            points += sums[j : j + n]
        if len(whole) < n:
            points = points[whole]
        yield owner[at + whole], nth[at + whole] * STRIDE, points


def _judge(items: Items, terms: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], best: dict[tuple[int, int], tuple[bool, float, float, bool]]) -> None:
    """Compare the held candidates (places as of ``shared``, cosines) word by word and put the best into ``best``."""
    if not held:
        return
    places, cosine = (np.concatenate(x) for x in zip(*held, strict=True))
    can = np.flatnonzero(shared(items, terms, places) >= LIKELY * items.lengths[places[:, 1]])
    places, one = np.unique(places[can], axis=0, return_index=True)
    for (d, u, a, b), c in zip(places.tolist(), cosine[can[one]].tolist(), strict=True):
        own, area, out = items.words[u], terms[a:b], len(items.vocab)
        if (ratio := lcs(own, area, out) / len(own)) < LIKELY:
            continue
        answer = items.answers[u]
        found = lcs(answer, area, out) >= ANSWER * len(answer)
        got = (ratio >= SURE or found, ratio, c, found)
        key = (d, items.ids[u])
        if key not in best or got > best[key]:
            best[key] = got


def matches(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, bool, bool]]:
    """(text number, item id, cosine, lcs ratio, answer found, contaminated) of each text and item that reaches LIKELY.

    Every candidate is judged by itself; an item contaminates a text if one of them does, and the best of those is told.
    """
    terms, counts = items.terms(texts)
    first = np.cumsum(np.append(0, counts))
    best: dict[tuple[int, int], tuple[bool, float, float, bool]] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for text, start, points in _window_points(items, terms, counts):
        norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", points, points)), 1e-9)
        dots = points @ items.passages.T
        at = np.flatnonzero(dots >= (COSINE * norms)[:, None])
        row, p = at // dots.shape[1], at % dots.shape[1]
        unit, doc = items.unit_of[p], text[row]
        n = items.lengths[unit]
        near, slack = first[doc] + start[row] - items.offset[p], SPAN // 2 + n // 4
        places = np.stack([doc, unit, np.maximum(first[doc], near - slack), np.minimum(first[doc + 1], near + n + slack)], axis=1)
        keep = (n >= LEAST) & (places[:, 3] > places[:, 2])
        held.append((places[keep], (dots[row, p] / norms[row])[keep]))
        if sum(len(c) for _, c in held) >= HELD:
            _judge(items, terms, held, best)
            held = []
    _judge(items, terms, held, best)
    for (d, i), (bad, ratio, cosine, found) in best.items():
        yield d, i, cosine, ratio, found, bad
    yield from _short_matches(items, terms, first, counts)


def _short_matches(items: Items, terms: np.ndarray, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, float, bool, bool]]:
    """Items below LEAST words, as whole runs of words."""
    owner = np.repeat(np.arange(len(counts)), counts)
    for i, own in enumerate(items.words):
        if len(own) >= LEAST or len(own) > len(terms):
            continue
        n = len(terms) - len(own) + 1
        same = owner[:n] == owner[len(own) - 1 :]
        for j, x in enumerate(own):
            same = same & (terms[j : j + n] == x)
        for d in np.unique(owner[:n][same]).tolist():
            yield d, items.ids[i], 1.0, 1.0, True, True


def _grouped(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, normalised texts) of consecutive rows of about BATCH_BYTES."""
    first, group, total = 0, [], 0
    for k, text in enumerate(b.column("text")):
        group.append(normalise(text.as_py()))
        total += len(group[-1])
        if total > BATCH_BYTES:
            yield first, group
            first, group, total = k + 1, [], 0
    if group:
        yield first, group


def _search(space, part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = part.value.within(space.value)
        for b in batches:
            docs, rows = b.column("doc_id").to_pylist(), []
            for first, texts in _grouped(b):
                rows += [(docs[first + d], *rest) for d, *rest in matches(items, texts)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs_ratio", "answer_found", "contaminated"])

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_found) of each document and item judged a copy or paraphrase."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    queries = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).where("item_id is not null").distinct()
    size = queries.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    space, basis = whole_space(queries, rows)
    out = spark.createDataFrame([], _RESULT)
    if not space.vocab:
        return out.where("contaminated").drop("contaminated")
    shared_space = spark.sparkContext.broadcast(space)
    queries = queries.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for k in range(parts):
        items = read_items(queries.where(F.col("part") == k).orderBy("item_id", "text").collect(), space)
        if items.ids:
            items = replace(stand(items, basis), vocab=[], number={}, idf=None, weighted=None)
            found = rows.mapInArrow(_search(shared_space, spark.sparkContext.broadcast(items)), _RESULT)
            out = found if parts == 1 else out.unionByName(found)
    return out.where("contaminated").drop("contaminated")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating passage."""
    bad = contaminations(docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
