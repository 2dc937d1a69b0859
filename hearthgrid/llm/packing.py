"""Best-fit packing of token sequences by pattern counts.

Documents are tokenised where they are scanned; only piece lengths go on. The histogram of lengths (at most ``capacity``
bins) is all that reaches the driver: patterns of a few lengths that fill a sequence are enumerated, non-negative least
squares fits how often each is repeated, the counts are rounded down, and what is left is packed best fit by counts, so
the plan's size and time depend on the number of different lengths and not on the number of documents. Pieces then take
places in the plan by their rank among the pieces of their length; ranks come from counts per small cell, so that many
documents of one length are never sorted together.

Defined results: null text is the empty text, whose document is the end token alone; repeated rows are packed each for
itself; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, word_pieces

CAPACITY, END = 4096, 1
#: Words, and runs, whose ids a worker keeps (about 30 MB each).
CACHE = 120_000
#: Characters that are tokenised together.
GROUP_CHARS = 2 << 20
#: Mean number of pieces in a cell in which pieces are ranked.
CELL_ROWS = 2_500
#: Patterns enumerated for each length, and rounds of the fit.
PATTERNS, ROUNDS = 6, 300


@cache
def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RunTokenizer:
    """Ids of whole texts, made of the ids of their different words, and those of the ids of the words' runs.

    The tokenizer cuts a normal, lower-case text into runs of letters, single digits and runs of marks, never across white
    space, and encodes each by itself. In texts of plain characters (below), the same cut is made here: the different words of
    many texts are encoded once, and the ids of words and runs, which recur, are kept. Any other text is encoded as it stands.
    """

    #: The tokenizer's own rule for lower-case texts of plain characters.
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
    #: White space, printable ASCII and the accented Latin letters of one byte: each is its own normal form.
    plain = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a worker on every core
        self.own, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # a run is already normal and whole, so only its bytes are mapped
        self.whole.normalizer, self.whole.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def is_plain(self, text: str) -> bool:
        """No other characters, and nothing that could be one of the tokenizer's special strings."""
        try:
            return "<|" not in text and not text.encode("latin-1").translate(None, self.plain)
        except UnicodeEncodeError:
            return False

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't known; they're kept while there is room, so the words of the first texts, and with them the
        common ones, stay."""
        cuts = [self.cut.findall(w.decode().lower()) for w in new]
        runs = self.runs
        fresh = list(set().union(*cuts).difference(runs))
        made = {r: array("I", e.ids).tobytes() for r, e in zip(fresh, self.whole.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        if len(runs) < CACHE:
            runs.update(made)
            made = runs
        else:
            made = ChainMap(runs, made)
        out = {w: made[c[0]] if len(c) == 1 else b"".join([made[r] for r in c]) for w, c in zip(new, cuts, strict=True)}
        if len(self.words) < CACHE:
            self.words.update(out)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        texts = [t or "" for t in texts]
        plain = [self.is_plain(t) for t in texts]
        place: dict[bytes, int] = {}
        held, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for k, words in word_pieces([t.encode() if p else b"" for t, p in zip(texts, plain, strict=True)]):
            counts[k] += len(words)
            held.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)))
        which, different = np.concatenate(held), list(place)
        get = self.words.get
        found = [get(w) for w in different]
        if missing := [i for i, x in enumerate(found) if x is None]:
            collects = gc.isenabled()
            gc.disable()  # hundreds of thousands of small lists that hold no cycles
            learned = self._learn([different[i] for i in missing])
            for i in missing:
                found[i] = learned[different[i]]
            if collects:
                gc.enable()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        # each word's ids are copied from its place in ``flat`` to its place in the texts
        n = size[which]
        to = np.cumsum(n) - n
        out = flat[np.repeat(at[which] - to, n) + np.arange(int(n.sum()))]
        edges = np.append(to, len(out))[np.cumsum(np.append(0, counts))].tolist()
        return [out[a:b] if p else np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4") for t, p, a, b in zip(texts, plain, edges, edges[1:], strict=False)]


@cache
def tokenizer_of(path: str) -> RunTokenizer:
    """A worker's tokenizer, which it keeps from task to task."""
    return RunTokenizer(path)


def _grouped(b: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Consecutive rows (ids, texts) of about GROUP_CHARS characters."""
    names, texts, total = [], [], 0
    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
        names.append(doc)
        texts.append(text.as_py())
        total += len(texts[-1] or "")
        if total > GROUP_CHARS:
            yield names, texts
            names, texts, total = [], [], 0
    if names:
        yield names, texts


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = tokenizer_of(path), np.array([end], "<u4")
        for b in batches:
            docs, parts, starts, lengths, sums, tokens = [], [], [], [], [], []
            for names, texts in _grouped(b):
                for doc, ids in zip(names, tokenizer.ids(texts), strict=True):
                    ids = np.append(ids, last)
                    for k in range(0, len(ids), capacity):
                        piece = ids[k : k + capacity]
                        docs.append(doc)
                        parts.append(k // capacity)
                        starts.append(k)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece))
                        if with_ids:
                            tokens.append(piece.view("<i4"))
            cols = [pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def patterns_of(counts: np.ndarray, capacity: int, each: int = PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths present in ``counts``, largest first; most fill the capacity exactly or nearly."""
    have = np.flatnonzero(counts)
    weight = counts[have] * have
    share = np.cumsum(weight) / max(weight.sum(), 1)
    out: dict[tuple[int, ...], None] = {}

    def fit(room: int) -> int:
        at = np.searchsorted(have, room, side="right") - 1
        return int(have[at]) if at >= 0 else 0

    for first in have[::-1].tolist():
        out[(first,)] = None
        for k in range(each):
            pattern, room = [first], capacity - first
            # partners are drawn at even steps of the token mass that still fits, the last one is the best fit
            for depth in range(k % 3):
                top = np.searchsorted(have, room, side="right") - 1
                if top < 0:
                    break
                pick = int(have[np.searchsorted(share, share[top] * (k + 1 + depth) / (each + 2))])
                if pick > room:
                    break
                pattern.append(pick)
                room -= pick
            if last := fit(room):
                pattern.append(last)
            out[tuple(sorted(pattern, reverse=True))] = None
    return list(out)


def fit_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 that minimise ||S (A x - counts)||^2 with A the patterns' lengths and S the lengths themselves, so an unmet long
    length costs more than a short one. Multiplicative updates: each keeps x >= 0 and never raises the sum of squares.
    """
    rows = np.array([x for p in patterns for x in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    scale = np.arange(len(counts)) / capacity
    fill = np.array([sum(p) / capacity for p in patterns])
    want = counts * scale
    x = np.full(len(patterns), counts.sum() / max(len(patterns), 1)) * fill**8
    top = np.bincount(cols, (want * scale)[rows], len(patterns))
    for _ in range(rounds):
        made = np.bincount(rows, x[cols], len(counts)) * scale
        x *= top / np.maximum(np.bincount(cols, (made * scale)[rows], len(patterns)), 1e-12)
    return x


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram ``counts`` (index: length) exactly."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((pattern, times))
            for x in pattern:
                left[x] -= times

    if left.any():
        full = [p for p in patterns_of(counts, capacity) if sum(p) > 0.995 * capacity]
        if full:
            x = fit_counts(full, counts, capacity)
            for i in np.argsort(-x):
                uses = {v: full[i].count(v) for v in full[i]}
                take(full[i], int(min([x[i], *(left[v] // k for v, k in uses.items())])))
    # the residual: the longest length opens sequences, and the best fit for the room that is left follows
    while len(have := np.flatnonzero(left)):
        pattern, room, used = [], capacity, {}
        while True:
            at = np.searchsorted(have, room, side="right") - 1
            while at >= 0 and left[have[at]] <= used.get(int(have[at]), 0):
                at -= 1
            if at < 0:
                break
            v = int(have[at])
            pattern.append(v)
            used[v] = used.get(v, 0) + 1
            room -= v
        take(tuple(pattern), int(min(left[v] // k for v, k in used.items())))
    return plan


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset); ranks from there on go to consecutive sequences."""
    next_rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for v in pattern:
            rank = next_rank.get(v, 0)
            rows.setdefault(v, []).append((rank, sequence, offset))
            next_rank[v] = rank + times
            offset += v
        sequence += times
    return {v: np.array(r, np.int64) for v, r in rows.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of each piece."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = materialize(rows.mapInArrow(_pieces(path or tokenizer_path(), capacity, end, with_ids), schema), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # one row for each length, so at most ``capacity``
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    places = spark.sparkContext.broadcast(place_table(pack_counts(counts, capacity)))
    # as many cells as a length's own pieces fill; one row for each length
    cells = spark.createDataFrame([(r["length"], -(-r["count"] // CELL_ROWS)) for r in histogram], "length long, cells long")
    pieces = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells"))).drop("cells")
    ahead = pieces.groupBy("length", "cell").count().selectExpr("length", "cell", "sum(count) over (partition by length order by cell rows between unbounded preceding and 1 preceding) as ahead")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(ahead.select("length", "cell", F.coalesce("ahead", F.lit(0)).alias("ahead")), ["length", "cell"])
    ranked = ranked.withColumn("rank", F.expr("ahead + row_number() over (partition by length, cell order by doc_id, piece, ids_crc32) - 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                at, rows_ = np.flatnonzero(length == v), places.value[int(v)]
                k = np.searchsorted(rows_[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows_[k, 1] + rank[at] - rows_[k, 0], rows_[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(run, schema + ", sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(docs)
