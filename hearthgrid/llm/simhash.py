"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits, compared as bit planes.

Fingerprints are computed beside the scan, so texts are never shuffled. Equal fingerprints are one node. The 64 bits are
cut in four blocks; two fingerprints that differ in at most two bits agree on at least two blocks, so the six pairs of
blocks are six tables of buckets that together hold every link. In a bucket, all distances are counted at once: bit planes
are stored vertically and carry-save counters add them up for 64 comparisons per machine word, and a block of comparisons is
abandoned once all exceed the radius. A bucket above ``BUCKET_CAP`` goes another exact way: its members meet at every
value one flipped bit away, where at most 33 can meet.

Defined results: null or blank text has fingerprint zero and is linked like any other; a null doc_id gets its
fingerprint and the component of its fingerprint's smallest known id (null if there is none); repeated rows are all returned;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, discard_but, materialize, table, written

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Most members of a bucket that is compared pair by pair.
BUCKET_CAP = 1024
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLOCKS = [np.uint64(0xFFFF << s) for s in (0, 16, 32, 48)]
_PAIRS = list(combinations(range(4), 2))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes; zero without words."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    counts, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 65_536):  # a very long text is counted piece by piece
        spans = zip(starts[i : i + 65_536], ends[i + shingle - 1 : i + 65_536 + shingle - 1].tolist(), strict=False)
        hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes (uint64); zero without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[i : i + 65_536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def _planes(fps: np.ndarray, more: int = 0) -> np.ndarray:
    """64 rows, one for each bit; 64 fingerprints to a word, and ``more`` empty words behind."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    lanes = -len(fps) % 64 + 64 * more
    return np.packbits(np.ascontiguousarray(np.pad(bits, ((0, 0), (0, lanes)))), axis=1, bitorder="little").view(np.uint64)


def _differing(a: np.ndarray, b: np.ndarray, step: int, words: int, radius: int) -> np.ndarray:
    """For lane i of the first ``words`` words: whether lane i of planes a and lane i + step of planes b differ in more than
    ``radius`` bits (3 at most).

    ``ones`` and ``twos`` are the carry-save counters of every lane; ``over`` marks lanes beyond the radius. Blocks of 4096
    lanes that are all over are abandoned after each eight planes.
    """
    ones, twos, over = (np.zeros(words, np.uint64) for _ in range(3))
    alive = np.arange(words)
    word, bit = divmod(step, 64)
    low, high = np.uint64(bit), np.uint64(64 - bit)
    for start in range(0, 64, 8):
        o, t, x = ones[alive], twos[alive], over[alive]
        for k in range(start, start + 8):
            other = b[k, alive + word]
            if bit:
                other = (other >> low) | (b[k, alive + word + 1] << high)
            diff = a[k, alive] ^ other
            carry = o & diff
            o = o ^ diff
            x |= t & carry
            t = t ^ carry
        if radius < 3:
            x |= (t & o) if radius == 2 else (t if radius == 1 else t | o)
        ones[alive], twos[alive], over[alive] = o, t, x
        full = (over[alive] == np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks = alive // 64
        dead = np.isin(blocks, blocks[~full], invert=True)
        alive = alive[~dead]
        if not len(alive):
            break
    return np.unpackbits(over.view(np.uint8), bitorder="little").astype(bool)


def within_radius(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean for each lane: a and b (uint64) differ in at most ``radius`` bits. radius is 3 at most."""
    pa_, pb = _planes(a), _planes(b)
    return ~_differing(pa_, pb, 0, pa_.shape[1], radius)[: len(a)]


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n members reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member it reaches in its bucket) for rows sorted by ``group``.

    The members of all buckets are compared at one distance in the order after another, so one pass serves many buckets.
    """
    n = len(fps)
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(edge, n))
    # the largest buckets first, so those that have members ``step`` apart are a run of lanes; the planes are made once
    first = np.argsort(-size, kind="stable")
    held = np.repeat(edge[first] - (np.cumsum(size[first]) - size[first]), size[first]) + np.arange(n)
    left_in = np.repeat(np.cumsum(size[first]), size[first]) - 1
    planes = _planes(fps[held], more=int(size.max()) // 64 + 2)
    left, right = [], []
    for step in range(1, int(size.max())):
        lanes = int(size[size > step].sum())
        near = ~_differing(planes, planes, step, -(-lanes // 64), radius)[:lanes]
        hit = np.flatnonzero(near & (np.arange(lanes) + step <= left_in[:lanes]))
        left.append(held[hit])
        right.append(held[hit + step])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    label = _smallest(n, np.concatenate(left), np.concatenate(right))
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp, node) sorted by t, key to edges (u, v) of nodes; a bucket may go over batches."""
    kept: np.ndarray | None = None
    for b in batches:
        new = np.stack([b.column(c).to_numpy() for c in ("t", "key", "fp", "node")], axis=1)
        rows = new if kept is None else np.concatenate([kept, new])
        if not len(rows):
            continue
        cut = len(rows) - np.argmax((rows[::-1, :2] != rows[-1, :2]).any(axis=1)) if (rows[:, :2] != rows[-1, :2]).any() else 0
        kept, rows = rows[cut:], rows[:cut]
        if len(rows):
            yield _edges_of(rows)
    if kept is not None and len(kept):
        yield _edges_of(kept)


def _edges_of(rows: np.ndarray) -> pa.RecordBatch:
    group = np.cumsum(np.append(False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    a, b = bucket_links(group, np.ascontiguousarray(rows[:, 2]).view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], names=["u", "v"])


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes (fp, node) that connect exactly the fingerprints within two bits of each other."""
    masks = [int(np.int64(np.uint64(_BLOCKS[i] | _BLOCKS[j]).view(np.int64))) for i, j in _PAIRS]
    keyed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key")
    rows = materialize(nodes.select(keyed, "fp", "node").select(F.col("t").cast("long").alias("t"), "key", "fp", "node"), "simhash-buckets")
    sizes = rows.groupBy("t", "key").count().where("count > 1")
    sized = rows.join(sizes, ["t", "key"])
    small = sized.where(F.col("count") <= BUCKET_CAP).select("t", "key", "fp", "node")
    small = small.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    near = small.mapInArrow(_bucket_edges, "u long, v long")
    flips = [1 << i for i in range(63)] + [-(1 << 63)]
    free = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in [0, *[f for f in flips if not f & m]]]) for m in masks]), (F.col("t") + 1).cast("int"))
    large = sized.where(F.col("count") > BUCKET_CAP).select("node", "fp", F.explode(free).alias("flip"))
    large = large.select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met = large.groupBy("at").agg(F.collect_set("node").alias("all")).where(F.size("all") > 1)  # 65 at most
    far = met.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v")
    return near.unionByName(far)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots: the smallest node that each reaches.

    Alternates large and small stars until no edge changes; every round is a written table, so lost executors cost little.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        old, e = e, materialize(small.where("u <> v").distinct(), label)
        discard(old)
        after = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.scratch_path = e.scratch_path
            return out
        before = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as long, component_id) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    before = written()
    roots = components(links(nodes.where("node is not null")), "simhash-edges")
    discard_but(docs.sparkSession, *before, roots.scratch_path)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at five-word Jaccard 0.8, the one with the smallest id (all its rows, if that id repeats). Rows without an id stay.

    At that similarity fingerprints are about ten bits apart, more than blocks of bits can find, so the shingles decide.
    """
    from .jaccard import near_copies

    copies = near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
