"""Ranked lexical search by windowed bucket scoring.

Documents belong to fixed windows of ``WINDOW`` consecutive ids, and a posting names a slot of its window, so the scores of a
window for one item are an array that stays in the cache. The index is a written table with a row for each window and term
(slots, occurrences), sorted by both; it holds the terms that the items have, and each window's document lengths. A task
walks its windows one after another: for an item it adds the impacts of its terms' postings into the array, one term's
slots at a time, ors the terms' occupancy bitsets, and harvests only occupied slots that reach the item's heap of the best so
far. Heaps are joined in two steps, so no task sees an item's rows from all windows.

The texts are read once for each block of items; a block has at most about ``BLOCK_BYTES`` bytes of item text (or is one
item), so neither what is broadcast nor a worker's heaps grow with the items. Counts, weights and scores are those of all
documents, whatever the blocks.

Defined results: null text has no terms; a document without terms isn't counted; rows that share a doc_id are one document,
rows that share an item_id (or have none) are one item, and their terms add up; documents without an id are left out; an item
without terms, or whose terms are in no document, has no rows; equal scores go by doc_id; empty tables give an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, table

WINDOW, TOP = 2048, 10
BLOCK_BYTES = 4 << 20
#: Bytes of text whose words are counted together.
PIECE = 4 << 20
#: Number of the row that holds a window's document lengths.
LENGTHS = -1
#: Parts in which an item's best rows are joined first.
SALT = 64
_POSTINGS = "window long, term int, slots array<int>, counts array<long>"


@cache
def _term_bytes() -> bytes:
    """Digits, lower-case letters and bytes beyond ASCII stand for themselves, capitals for lower case, others for a space."""
    keep = lambda b: b >= 128 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 128 and keep(b) else b if keep(b) else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_term_bytes()).split()


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row, terms) of texts; a long text comes in pieces that end between terms."""
    for row, t in enumerate(texts):
        data = (t.as_py() or "").encode().translate(_term_bytes())
        at = 0
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            yield row, data[at:end].split()
            at = end


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _lists(window: np.ndarray, term: np.ndarray, slot: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row for each window and term of postings sorted by both."""
    first = np.flatnonzero(np.append(True, (window[1:] != window[:-1]) | (term[1:] != term[:-1]))) if len(window) else np.zeros(0, int)
    edges = pa.array(np.append(first, len(window)), pa.int32())
    cols = [pa.array(window[first], pa.int64()), pa.array(term[first], pa.int32()), *(pa.ListArray.from_arrays(edges, pa.array(x, t)) for x, t in ((slot, pa.int32()), (count, pa.int64())))]
    return pa.RecordBatch.from_arrays(cols, names=["window", "term", "slots", "counts"])


def _postings(known, size: int):
    """Texts to posting lists of one batch; terms are numbered by ``known``, and a document's length goes to LENGTHS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        n_terms = np.int64(len(number) + 1)
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            keys, counts = [], []
            rows, found, lengths, held = [], [], [], 0

            def flush() -> None:
                """Pairs of row and term so far, each once."""
                nonlocal rows, found, lengths, held
                row = np.repeat(np.array(rows, np.int64), np.array(lengths, np.int64))
                term = np.fromiter(found, np.int64, len(found)) if found else np.zeros(0, np.int64)
                on = term >= 0
                pairs, n = np.unique(row[on] * n_terms + term[on] + 1, return_counts=True)
                keys.extend((pairs, np.array(rows, np.int64) * n_terms))
                counts.extend((n, np.array(lengths, np.int64)))
                rows, found, lengths, held = [], [], [], 0

            for row, terms in _pieces(b.column("text")):
                rows.append(row)
                lengths.append(len(terms))
                found.extend(map(number.get, terms, repeat(-1)))
                held += len(terms)
                if held > PIECE // 8:
                    flush()
            flush()
            key, count = _summed(np.concatenate(keys), np.concatenate(counts))
            key, count = key[count > 0], count[count > 0]
            doc, term = ids[key // n_terms], key % n_terms - 1
            window, slot = doc // size, doc % size
            order = np.lexsort((slot, term, window))
            yield _lists(window[order], term[order], slot[order], count[order])

    return run


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, terms, slots, counts) of each window, a posting to an element, from rows sorted by window."""
    kept: list[pa.Table] = []

    def flat(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        slots, counts = (t.column(c).combine_chunks() for c in ("slots", "counts"))
        term = np.repeat(t.column("term").to_numpy(), np.diff(slots.offsets.to_numpy()))
        return t.column("window")[0].as_py(), term, slots.flatten().to_numpy(), counts.flatten().to_numpy()

    for b in batches:
        t, window = pa.Table.from_batches([b]), b.column("window").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, window[1:] != window[:-1])), len(window)).tolist() if len(window) else []
        for a, e in zip(edges, edges[1:], strict=False):
            if kept and kept[0].column("window")[0].as_py() != window[a]:
                yield flat(pa.concat_tables(kept))
                kept = []
            kept.append(t.slice(a, e - a))
    if kept:
        yield flat(pa.concat_tables(kept))


def _merged(size: int):
    """Posting lists of a window from all batches that had some of it, a slot once for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window, term, slot, count in _by_window(batches):
            key, count = _summed((term.astype(np.int64) + 1) * size + slot, count)
            yield _lists(np.full(len(key), window), key // size - 1, key % size, count)

    return run


def index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, term, slots, counts) sorted by window and term within partitions, of the ``terms`` (to their numbers); a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    known = docs.sparkSession.sparkContext.broadcast(terms)
    parts = rows.mapInArrow(_postings(known, window), _POSTINGS)
    whole = parts.repartition("window").sortWithinPartitions("window", "term").mapInArrow(_merged(window), _POSTINGS)
    return materialize(whole, "lexical-index")


class Heap:
    """The ``top`` best (score, document) so far, the smaller document first among equal scores."""

    def __init__(self, top: int):
        self.top, self.held = top, []

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        if len(self.held) == self.top:
            on = scores >= self.held[0][0]
            scores, docs = scores[on], docs[on]
        if len(scores) > self.top:
            best = np.lexsort((docs, -scores))[: self.top]
            scores, docs = scores[best], docs[best]
        for s, d in zip(scores.tolist(), docs.tolist(), strict=True):
            if len(self.held) < self.top:
                heapq.heappush(self.held, (s, -d))
            else:
                heapq.heappushpop(self.held, (s, -d))


def impacts(counts: np.ndarray, lengths: np.ndarray, weight: int, n_docs: int, n_all: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to the score of each document that has it."""
    m = 25 + (75 * lengths * n_docs) // n_all
    return weight * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _scored(queries, size: int, top: int):
    """Windows to the best (item, doc_id, score) of all windows of a task.

    ``queries``: for each item its term numbers and how often it has each; weights by term number; the counts N and L.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_all = queries.value
        heaps = [Heap(top) for _ in items]
        scores = np.zeros(size, np.int64)
        for window, term, slot, count in _by_window(batches):
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            edges, here = np.append(first, len(term)).tolist(), term[first].tolist()
            length = np.zeros(size, np.int64)
            lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for t, a, e in zip(here, edges, edges[1:], strict=False):
                if t == LENGTHS:  # the lowest number, so the first
                    length[slot[a:e]] = count[a:e]
                    continue
                occupied = np.zeros(size, bool)
                occupied[slot[a:e]] = True
                lists[t] = slot[a:e], impacts(count[a:e], length[slot[a:e]], int(weights[t]), n_docs, n_all), np.packbits(occupied)
            for heap, (terms, times) in zip(heaps, items, strict=True):
                on = [(lists[t], k) for t, k in zip(terms, times, strict=True) if t in lists]
                if not on:
                    continue
                for (at, add, _), k in on:
                    scores[at] += add * k  # a term has a slot once
                hit = np.flatnonzero(np.unpackbits(reduce(np.bitwise_or, [x[2] for x, _ in on])))
                got = scores[hit]
                scores[hit] = 0
                heap.add(got[got > 0], hit[got > 0] + window * size)
        rows = [(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap.held]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, block: DataFrame, top: int, window: int, **names: str) -> DataFrame:
    """(item_id, doc_id, score, rank) for one block of items (item_id, text), which fits in the driver."""
    spark = docs.sparkSession
    counted: dict[object, dict[bytes, int]] = {}
    for r in block.toLocalIterator():
        own = counted.setdefault(r["item_id"], {})
        for t in terms_of(r["text"]):
            own[t] = own.get(t, 0) + 1
    kinds = f"item_id {block.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    if not any(counted.values()):
        return spark.createDataFrame([], kinds)
    number = {t: k for k, t in enumerate(sorted(set().union(*counted.values())))}
    postings = index(docs, number, window=window, **names)
    # documents that have a term, their number and length under LENGTHS; a row for each term of the items at most
    stats = postings.groupBy("term").agg(F.sum(F.size("slots")).alias("df"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).toArrow()
    term, df, n = (stats.column(c).to_numpy() for c in ("term", "df", "n"))
    n_docs, n_all = int(df[term == LENGTHS].sum()), int(n[term == LENGTHS].sum())
    held = np.zeros(len(number), np.int64)
    held[term[term >= 0]] = df[term >= 0]
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * held + 1))).astype(np.int64)
    items = [([number[t] for t in own], list(own.values())) for own in counted.values()]
    sent = spark.sparkContext.broadcast((items, weights, n_docs, max(n_all, 1)))
    found = postings.mapInArrow(_scored(sent, window, top), "item int, doc_id long, score long")
    best = materialize(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))), "lexical-best")
    discard(postings)
    order = (F.desc("score"), F.asc("doc_id"))
    for keys in (("item", "salt"), ("item",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    ids = spark.createDataFrame(list(enumerate(counted)), "item int, item_id " + block.schema["item_id"].dataType.simpleString())
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item."""
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = [_block(docs, asked.where(dealt == k), top, window, id_col=id_col, text_col=text_col) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
asked AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY item_id, w),
len AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM len),
tf AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN (SELECT w FROM asked) GROUP BY doc_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
part AS (
  SELECT doc_id, w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_all)))) AS s
  FROM tf JOIN df USING (w) JOIN len USING (doc_id), a
), scored AS (SELECT item_id, doc_id, sum(times * s)::BIGINT AS score FROM asked JOIN part USING (w) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
