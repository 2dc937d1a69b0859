"""Substring dedup: word windows that also start in a document with a smaller id are removed.

Windows are found level by level. Hashes of 2, 4 and 8 words are made of two hashes of half the length, those of a whole
window of the two longest ones that cover it. At the first level, and again at twice its length until that would pass the
window, the smallest of the hashes inside a window stands for it, so equal windows pick equal stand-ins and few places are
looked at. Only windows whose stand-in occurs in two documents go on to twice the length; where none survive, nothing more
is hashed. What is left is compared at the window's own length by 96 bits: two hashes of a window, made in different ways of the 64-bit hashes
of its words.

Documents are dealt by a hash into groups of a bounded mean number and size. A group reports each hash once, with the
smallest document that has it and whether others of the group do, so a passage in a third of all documents is one row for
each group, not one for each document. Texts are shuffled once; the passes over the groups share that exchange.

Defined results: null or blank text has no words; texts of fewer words than a window keep all; a null doc_id is no source
and loses nothing; rows that share a doc_id count as one document; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, word_hashes

WINDOW = 13
#: Words of the first level's windows.
FIRST = 4
#: Mean number of documents of a group, and mean bytes of their texts, at most.
GROUP_DOCS, GROUP_BYTES = 1_000, 4 << 20

_Q = np.uint64(0xD6E8FEB86659FD93)
#: Offset of words' hashes for the second hash of windows.
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: ``gm``: twice the group's number, plus one if more than one document of the group has the hash; ``gk``: gm and, in the
#: lower 32 bits, the second hash.
_SHORT, _FULL = "gm long, h long", "gk long, h long, lo long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(window: int) -> list[int]:
    """Lengths at which candidates are looked for before the window's own: each twice the one before."""
    out = [min(FIRST, window)]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return out


def extended(half: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of ``to`` words from hashes of ``size`` words (half of ``to`` at least), which may overlap."""
    step = to - size
    n = max(0, len(half) - step)
    return mix64(half[:n] * _Q + half[step : step + n] + np.uint64(to))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place; the last size - 1 places have none."""
    out, have = words, 1
    while have < size:
        to = min(2 * have, size)
        out, have = extended(out, have, to), to
    return out


class Windows:
    """Every window inside a text: its place, its text, and hashes on demand."""

    def __init__(self, texts: list[bytes], size: int, second: bool = False):
        self.size, (self.words, self.counts) = size, word_hashes(texts)
        self.other = mix64(self.words + _SECOND) if second else None
        owner = np.repeat(np.arange(len(texts)), self.counts)
        n = max(0, len(owner) - size + 1)
        self.place = np.flatnonzero(owner[:n] == owner[size - 1 :]) if n else np.zeros(0, int)
        self.owner = owner[self.place]

    def stand_ins(self, length: int) -> np.ndarray:
        """Smallest hash of ``length`` words in each window."""
        h = window_hashes(self.words, length)
        n = max(0, len(self.words) - self.size + 1)
        low = h[:n].copy()
        for k in range(1, self.size - length + 1):
            np.minimum(low, h[k : k + n], out=low)
        return low[self.place].view(np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes of each window."""
        h, k = (window_hashes(w, self.size)[self.place] for w in (self.words, self.other))
        return h.view(np.int64), (k >> np.uint64(32)).view(np.int64)


def _texts(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, ids, and which ids are known."""
    ids = t.column("doc_id")
    return [(x or "").encode() for x in t.column("text").to_pylist()], ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()


def _once(group: int, ids: np.ndarray, *keys: np.ndarray) -> pa.Table:
    """Each hash (with one key) or window (with two) of a group once; of windows the smallest id as well."""
    order = np.lexsort((ids, *keys[::-1]))
    ids, keys = ids[order], [k[order] for k in keys]
    new = np.zeros(max(len(ids) - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    first = np.flatnonzero(np.append(True, new)) if len(ids) else np.zeros(0, int)
    last = np.append(first[1:], len(ids)) - 1 if len(ids) else first
    gm = 2 * group + (ids[last] != ids[first]).astype(np.int64)
    cols = {"gm": gm, "h": keys[0][first]} if len(keys) == 1 else {"gk": (gm << 32) | keys[1][first], "h": keys[0][first], "lo": ids[first]}
    return pa.table({n: pa.array(c, pa.int64()) for n, c in cols.items()})


def _group(*tables: pa.Table) -> int:
    return next((t.column("g")[0].as_py() for t in tables if len(t)), 0)


def _reported(w: Windows, on: np.ndarray, length: int, group: int, ids: np.ndarray, known: np.ndarray) -> pa.Table:
    """The stand-ins of ``length`` words of the windows ``on``."""
    low = w.stand_ins(length)
    on = on & known[w.owner]
    on[1:] &= (low[1:] != low[:-1]) | (w.owner[1:] != w.owner[:-1]) | ~on[:-1]  # neighbours mostly share theirs
    return _once(group, ids[w.owner[on]], low[on])


def _first(size: int, length: int):
    def run(docs: pa.Table) -> pa.Table:
        texts, ids, known = _texts(docs)
        w = Windows(texts, size)
        return _reported(w, np.ones(len(w.place), bool), length, _group(docs), ids, known)

    return run


def _further(size: int, length: int, to: int):
    """From candidates of ``length`` words to those of ``to`` words, or to whole windows."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(docs) or not len(found):
            none = np.zeros(0, np.int64)
            return _once(0, none, *[none] * (1 if to < size else 2))
        texts, ids, known = _texts(docs)
        w = Windows(texts, size, second=to == size)
        on = np.isin(w.stand_ins(length), found.column("h").to_numpy()) & known[w.owner]
        if to < size:
            return _reported(w, on, to, _group(docs), ids, known)
        h, k = w.whole()
        return _once(_group(docs), ids[w.owner[on]], h[on], k[on])

    return run


def _removed(size: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids, known = _texts(docs)
        if len(found):
            w = Windows(texts, size, second=True)
            counts, gone = w.counts, np.zeros(int(w.counts.sum()) + 1, np.int64)
            h, kf = (found.column(c).to_numpy() for c in ("h", "kf"))
            order = np.argsort(h, kind="stable")
            h, k, all_ = h[order], kf[order] & 0xFFFFFFFF, kf[order] >> 32 == 1
            own, other = w.whole()
            at, row = np.searchsorted(h, own), np.full(len(own), -1)
            while len(left := np.flatnonzero((at < len(h)) & (h[np.minimum(at, len(h) - 1)] == own))):  # once more for each hash that two windows share
                same = left[k[at[left]] == other[left]]
                row[same] = at[same]
                at[left] += 1
            on = np.flatnonzero((row >= 0) & known[w.owner])
            least = np.full(len(h), np.iinfo(np.int64).max)
            np.minimum.at(least, row[on], ids[w.owner[on]])
            hit = np.zeros(len(own), bool)
            hit[on] = all_[row[on]] | (ids[w.owner[on]] > least[row[on]])
            place = w.place[hit]
            np.add.at(gone, place, 1)
            np.add.at(gone, place + size, -1)
            gone = np.cumsum(gone)[:-1] > 0
        else:
            counts, gone = np.array([len(t.split()) for t in texts], np.int64), None
        out, at = [], 0
        for text, n in zip(texts, counts.tolist(), strict=True):
            words, removed = text.split(), 0
            if gone is not None:
                mask, at = gone[at : at + n], at + n
                if removed := int(mask.sum()):
                    words = [words[i] for i in np.flatnonzero(~mask)]
            out.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
        n, removed, digest = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return run


def _repeated(hashes: DataFrame) -> DataFrame:
    """(g, h): the groups' hashes that occur in two documents. A hash has a row for each group at most."""
    over = "over (partition by h)"
    return hashes.withColumns({"first": F.expr(f"min(gm) {over}"), "last": F.expr(f"max(gm) {over}")}).where("first <> last or gm % 2 = 1").select(F.expr("gm div 2").alias("g"), "h")


def _later(windows: DataFrame) -> DataFrame:
    """(g, h, kf): windows that documents of a group lose: all that have it, where a smaller document of another group does too
    (bit 32 of kf is set), else all but the smallest of the group. The lower bits of kf are the second hash."""
    found = windows.select(F.expr("shiftright(gk, 32)").alias("gm"), "h", F.expr("gk & 4294967295").alias("k"), "lo")
    found = found.withColumn("least", F.expr("min(lo) over (partition by h, k)")).where("least < lo or gm % 2 = 1")
    return found.select(F.expr("gm div 2").alias("g"), "h", F.expr("k + if(least < lo, 4294967296L, 0L)").alias("kf"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-size["n"] // group_docs), -(-(size["bytes"] or 0) // GROUP_BYTES))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups)))
    lengths = [*levels(window), window]
    found = rows.groupBy("g").applyInArrow(_first(window, lengths[0]), _SHORT)
    for length, to in zip(lengths, lengths[1:], strict=False):
        found = rows.groupBy("g").cogroup(_repeated(found).groupBy("g")).applyInArrow(_further(window, length, to), _SHORT if to < window else _FULL)
    return rows.groupBy("g").cogroup(_later(found).groupBy("g")).applyInArrow(_removed(window), _RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE lo < doc_id
), gone AS (SELECT DISTINCT doc_id, i + k AS p FROM bad, (SELECT unnest(range(0, 13)) AS k)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
