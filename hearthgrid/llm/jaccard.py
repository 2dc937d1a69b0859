"""Near copies at an exact Jaccard similarity of five-word shingle sets.

SimHash alone can't decide a similarity of 0.8: such texts are about ten of 64 bits apart. So fingerprints of five-word
shingles, compared as bit planes, give the first candidates, and the shingles themselves the rest: two sets of similarity
0.8 or more share a shingle among the first fifth (and one) of either, in whatever order all shingles are sorted, and up to
the first one that both have there is little enough that only one has. Documents meet at the shingles of these prefixes.

In each bucket of a shingle the member with the least before it, the one nearest to all others, is the centre, and every
other member meets the centre only; candidates are compared on whole sets, and what is similar gets one class. Then
members of a bucket that are still of different classes meet each other, in cells of bounded size. So no pair that could
join two classes is left out, and a family of near copies doesn't become all its pairs. Equal sets are one node.

Shingles that a sample of documents finds common come last in the order, commonest at the end; that keeps them out of most
prefixes. The sample decides the order only, never the result. Shingles and sets are compared by 64-bit hashes. Texts
aren't shuffled, only prefixes and the sets of candidates.

Defined results: a text below five words is one shingle; null or blank texts have the empty set and are equal; a null
doc_id gets the component of its set's smallest known id (null if there is none); repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, discard_but, materialize, mix64, word_hashes, written
from .simhash import components, links, majority

SHINGLE = 5
#: Least similarity as a fraction.
NUM, DEN = 4, 5
#: One document of SAMPLE is looked at for common shingles: those in HOT of them at least, HOT_MOST at most.
SAMPLE, HOT, HOT_MOST = 16, 2, 400_000
#: Slots of the filter that the sets of candidates pass.
SLOTS = 1 << 22
#: Mean number of members of a bucket that meet in one cell.
CELL = 1_000
BATCH_BYTES = 2 << 20
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_B = 0x9E3779B97F4A7C15
_NODE = "doc_id long, digest long, fp long, size long, prefix array<long>"


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted different hashes of the shingles of each text."""
    hashes, counts = word_hashes([(t or "").encode().translate(_FOLD) for t in texts])
    at = 0
    for n in counts.tolist():
        words, k = hashes[at : at + n], min(n, shingle)
        at += n
        value = np.zeros(n - k + 1 if n else 0, np.uint64)
        for j in range(k if n else 0):
            value = value * np.uint64(_B) + words[j : j + len(value)]
        value = np.sort(mix64(value + np.uint64(k)))
        yield value[np.append(True, value[1:] != value[:-1])] if len(value) else value


def grouped_sets(b: pa.RecordBatch, shingle: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of consecutive rows with texts of about BATCH_BYTES together."""
    first, group, size = 0, [], 0
    for k, t in enumerate(b.column("text")):
        group.append(t.as_py())
        size += len(group[-1] or "")
        if size > BATCH_BYTES or k + 1 == b.num_rows:
            yield first, list(shingle_sets(group, shingle))
            first, group, size = k + 1, [], 0


def digest(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def prefix(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all sets, as many as a similar set must share one of; ``hot`` ones last, by rank."""
    n = len(shingles)
    k = n - -(-NUM * n // DEN) + 1 if n else 0
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        late = hot[at] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late][np.argsort(rank[at[late]])]])
    return shingles[:k]


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, found in grouped_sets(b):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])


def _nodes(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in grouped_sets(b):
                d, fp, n, p = zip(*[(digest(s), majority(s), len(s), prefix(s, *hot.value).view(np.int64)) for s in sets], strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]), pa.int32()), pa.array(np.concatenate(p)))
                ids = b.column("doc_id").slice(first, len(sets))
                cols = [ids, pa.array(d, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "fp", "size", "prefix"])

    return run


def _can(nu, nv, iu, iv):
    """Whether sets of nu and nv shingles whose first common one is at iu and iv can be similar (numbers or columns)."""
    least = NUM * (nu + nv)
    return (least <= (NUM + DEN) * (nu - iu)) & (least <= (NUM + DEN) * (nv - iv))


def _pair(a: str, b: str, can: Column) -> list[Column]:
    return [F.when(can, F.least(a, b)).alias("u"), F.when(can, F.greatest(a, b)).alias("v")]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, cell) to pairs (u, v) of a cell that are of different classes and can be similar.

    ``cell`` is x * cells + y for the blocks x <= y that meet in it; a row's ``side`` is 0 in block x, 1 in block y.
    """
    names = ("h", "cell", "side", "digest", "size", "pos", "label")
    kept = np.zeros((0, len(names)), np.int64)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, step = len(rows), 1
        key, side, d, size, pos, label = rows[:, :2], *rows[:, 2:].T
        at = np.arange(n)
        while len(at := at[at + step < n]):
            o = at + step
            same = (key[at] == key[o]).all(axis=1)
            at, o = at[same], o[same]
            inner = (side[at] == 2) | (side[at] != side[o])
            ok = inner & (label[at] != label[o]) & _can(size[at], size[o], pos[at], pos[o])
            a, b = d[at[ok]], d[o[ok]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])
            step += 1

    for b in batches:
        rows = np.concatenate([kept, np.stack([b.column(c).to_numpy() for c in names], axis=1)])
        if not len(rows):
            continue
        other = (rows[:, :2] != rows[-1, :2]).any(axis=1)
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        kept, rows = rows[cut:], rows[:cut]
        yield from found(rows)
    yield from found(kept)


def _sets_in(slots, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in grouped_sets(b, shingle):
                rows = {d: s.tobytes() for s in sets if slots.value[(d := digest(s)) % SLOTS]}
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["digest", "shingles"])

    return run


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes leave room for a similar rest.

    The prefix that ends first in the order has all its common shingles in both prefixes, so only its tail can add to them.
    """
    for b in batches:
        keep = []
        for x, y, nu, nv in zip(b.column("a"), b.column("b"), b.column("nu").to_pylist(), b.column("nv").to_pylist(), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append((NUM + DEN) * (both + max(nu - len(x), nv - len(y))) >= NUM * (nu + nv))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("a"), b.column("b"), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = 0
            if len(x) and len(y):
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _joined(pairs: DataFrame, held: DataFrame, **names: str) -> DataFrame:
    """``pairs`` with columns of ``held`` for either end; names: column of ``held`` to its two names."""
    for end, k in (("v", 1), ("u", 0)):
        pairs = pairs.join(held.select(F.col("digest").alias(end), *[F.col(c).alias(n.split()[k]) for c, n in names.items()]), end)
    return pairs


def sets_of(rows: DataFrame, digests: DataFrame, label: str, shingle: int = SHINGLE) -> DataFrame | None:
    """(digest, shingles) of the ``digests`` (and some more), made again from the texts of ``rows``; a written table, None for no digests.

    A filter of SLOTS marks, whatever the number of documents, keeps most other sets from being shuffled.
    """
    taken = np.zeros(SLOTS, bool)
    taken[digests.select(F.pmod("digest", F.lit(SLOTS)).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    if not taken.any():
        return None
    slots = rows.sparkSession.sparkContext.broadcast(taken)
    sets = rows.select("text").mapInArrow(_sets_in(slots, shingle), "digest long, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return materialize(sets, f"{label}-sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v: digests) whose sets are similar."""
    return _joined(pairs, sets, shingles="a b").select("u", "v", "a", "b").mapInArrow(_similar, "u long, v long")


def verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """Those of ``pairs`` (u, v: digests) whose sets, made again from the texts of ``rows``, are similar; a written table."""
    pairs = materialize(_joined(pairs, nodes, prefix="a b", size="nu nv").select("u", "v", "a", "b", "nu", "nv").mapInArrow(_bound, "u long, v long"), f"{label}-pairs")
    sets = sets_of(rows, pairs.select(F.explode(F.array("u", "v")).alias("digest")), label)
    if sets is None:
        return pairs
    out = materialize(confirmed(pairs, sets), f"{label}-similar")
    discard(pairs, sets)
    return out


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank by rising count) of the shingles that a sample finds common, HOT_MOST at most."""
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    common = sample.mapInArrow(_all, "h long").groupBy("h").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "h").limit(HOT_MOST).toArrow()
    hot, count = common.column("h").to_numpy().view(np.uint64), common.column("count").to_numpy()
    rank = np.empty(len(hot), np.int64)
    rank[np.lexsort((hot, count))] = np.arange(len(hot))
    order = np.argsort(hot)
    return hot[order], rank[order]


def similar_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the components of all similar sets of ``nodes``, in digests; roots themselves aren't named. Leaves tables behind."""
    index = nodes.select("digest", "size", F.posexplode("prefix").alias("pos", "h"))
    shared = index.groupBy("h").count().where("count > 1").select("h")
    buckets = materialize(index.join(shared, "h").select("h", "digest", "size", F.col("pos").cast("long").alias("pos")), "jaccard-buckets")
    centre = buckets.groupBy("h").agg(F.min(F.struct("pos", "size", "digest")).alias("c"))
    starred = materialize(buckets.join(centre, "h"), "jaccard-starred")
    discard(buckets)
    can = _can(F.col("size"), F.col("c.size"), F.col("pos"), F.col("c.pos"))
    spokes = starred.where("digest <> c.digest").where(can).select(*_pair("digest", "c.digest", F.lit(True)))
    # the bit planes' links are of nodes with a known id; all nodes get their digest as the number here
    planes = links(nodes.select("fp", F.col("digest").alias("node")).groupBy("fp").agg(F.min("node").alias("node")))
    met = spokes.unionByName(planes.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    edges = verified(rows, nodes, met, "jaccard-centre")
    roots = components(edges, "jaccard-first")
    # members of a bucket that are of different classes still, but its centre, which has met all of them
    label = F.coalesce("root", "digest").alias("label")
    classed = starred.where("digest <> c.digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("h", "digest", "size", "pos", label)
    classed = materialize(classed, "jaccard-classed")
    mixed = classed.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high")
    cells = F.ceil(F.col("n") / CELL)
    block = F.pmod(F.xxhash64("digest"), cells)
    dealt = classed.join(mixed, "h").select("h", "digest", "size", "pos", "label", cells.alias("k"), block.alias("b"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(0L, k - 1)")))
    side = F.when(F.col("o") == F.col("b"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).cast("long")
    dealt = dealt.select("h", (F.least("b", "o") * F.col("k") + F.greatest("b", "o")).alias("cell"), side.alias("side"), "digest", "size", "pos", "label")
    rest = dealt.repartition("h", "cell").sortWithinPartitions("h", "cell").mapInArrow(_cross, "u long, v long").distinct()
    more = verified(rows, nodes, rest, "jaccard-rest")
    if not more.isEmpty():
        roots = components(edges.unionByName(more), "jaccard-edges")
    return roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = spark.sparkContext.broadcast(common_shingles(rows))
    whole = materialize(rows.mapInArrow(_nodes(hot), _NODE), "jaccard")
    firsts = [F.first(c).alias(c) for c in ("fp", "size", "prefix")]
    nodes = materialize(whole.groupBy("digest").agg(F.min("doc_id").alias("node"), *firsts), "jaccard-nodes")
    found = materialize(whole.select("doc_id", "digest"), "jaccard-digests")
    discard(whole)
    before = written()
    roots = similar_sets(rows, nodes.where("node is not null"))
    discard_but(spark, *before, roots.scratch_path)
    named = nodes.select("digest", "node").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.select("digest", "node", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("node").alias("component_id"))
    out = found.select("doc_id", "digest").join(named.join(least, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")
    out = materialize(out, "jaccard-classes")
    discard(found, nodes, roots)
    return out
