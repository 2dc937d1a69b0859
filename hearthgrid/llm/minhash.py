"""MinHash near-duplicates by tensored banding, verified on whole sets.

Two small collections of half-keys are made of each document's shingles; a half-key is ``EACH`` minhashes. Every pair of one
half-key of the first collection and one of the second is the key of a table, so ``HALVES`` squared tables, which would
take 2 * EACH * HALVES ** 2 minhashes of their own, take 2 * EACH * HALVES: about the square root. At a similarity of 0.8 a
half-key agrees with probability 0.512 and two documents miss each other in all tables with probability 2 * 0.488 ** 16,
about 1 in 48,000; above 0.8 it falls steeply. A key is only made of half-keys that another document has too, so most
documents make none. Equal sets are one node from the start.

Links are found by rounds. A bucket's centre is its member that meets most others over all tables; the others take the
centre that they meet most often, and are compared with it on whole sets; what is similar gets one class. In the next round
the centre is one of those that aren't in the class of the first. Members that are of different classes even then meet
each other pair by pair, but not members of the largest class among themselves. They meet under their half-keys of the
first collection, in cells of bounded size, and only the first half-key that a pair has in common, if one of the second
collection agrees too, looks at it: so what is compared is what met in the tables, once. Pairs whose minhashes agree too
rarely for the similarity (below one chance in a million), or whose bitmaps differ in more places than two similar sets can
(never wrong), don't leave the cell. So a family of copies costs a comparison or two for each document, a family that isn't
similar enough costs no rows, and what two classes could be joined by is still looked at.

Defined results: a text of fewer words than a shingle is one shingle; null, empty or blank texts have an empty set, link with
nothing and keep their own id; a row without an id links nothing and gets the component of its set's smallest known id (null
if there is none); repeated rows are all returned; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard_but, materialize, mix64, table, written
from .jaccard import DEN, NUM, confirmed, digest, grouped_sets, sets_of
from .simhash import components

SHINGLE = 2
#: Half-keys of a collection, and minhashes of a half-key.
HALVES, EACH = 16, 3
HASHES = 2 * HALVES * EACH
#: Rounds in which buckets meet at a centre before what is left meets pair by pair.
STARS = 2
#: Mean members of either side of a cell.
CELL = 512
#: Chance of losing a pair at the least similarity when minhashes are compared in a cell.
LOSS = 1e-6
#: Bits of a set's bitmap.
BITS = 2048
_SKETCH = "doc_id long, digest long, size long, halves array<long>"
_MEMBER = "key long, place int, digest long, label long, size long, marks binary, bits binary"


@cache
def least_marks() -> int:
    """Minhashes that must agree: with fewer, a pair at the least similarity has less than LOSS of a chance."""
    p, below, k = NUM / DEN, 0.0, 0
    while (below := below + comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)) < LOSS:
        k += 1
    return k


@cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each minhash."""
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    return mix64(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix64(k ^ np.uint64(0xD6E8FEB86659FD93))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES numbers for each set (none of them empty); all sets go through one permutation at once."""
    flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint64)
    for j, (factor, mask) in enumerate(zip(*_seeds(), strict=True)):
        x = (flat ^ mask) * factor
        x ^= x >> np.uint64(29)
        out[:, j] = np.minimum.reduceat(x, first)
    return out


def half_keys(mins: np.ndarray) -> np.ndarray:
    """A row of 2 * HALVES numbers for each row of minhashes; the place is part of the key, so places don't mix."""
    parts = mins.reshape(len(mins), 2 * HALVES, EACH)
    out = np.broadcast_to(np.arange(1, 2 * HALVES + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(EACH):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in grouped_sets(b, shingle):
                size = np.array([len(s) for s in sets], np.int64)
                full, halves = np.flatnonzero(size), [None] * len(sets)
                if len(full):
                    for i, h in zip(full.tolist(), half_keys(minhashes([sets[i] for i in full])).view(np.int64), strict=True):
                        halves[i] = h
                ids = b.column("doc_id").slice(first, len(sets))
                cols = [ids, pa.array([digest(s) for s in sets], pa.int64()), pa.array(size), pa.array(halves, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "size", "halves"])

    return run


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITS bits; two bitmaps never differ in more places than their sets have members that the other hasn't."""
    out = np.zeros(BITS, bool)
    out[(shingles % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, label, shingles) to a row for each half-key of the first collection."""
    for b in batches:
        if not b.num_rows:
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("shingles")]
        mins, n = minhashes(sets), b.num_rows
        keys = half_keys(mins)[:, :HALVES]
        marks = [x.tobytes() for x in (mix64(mins) & np.uint64(0xFFFF)).astype(np.uint16)]
        bits = [bitmap(s).tobytes() for s in sets]
        row = pa.array(np.repeat(np.arange(n), HALVES))
        held = [b.column("digest"), b.column("label"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())]
        place = np.tile(np.arange(HALVES, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(place), *[c.take(row) for c in held]], names=["key", "place", "digest", "label", "size", "marks", "bits"])


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, cell) to pairs (u, v) of side 0 and side 1 of a cell whose classes differ, whose first common half-key
    this is, and whose sizes, minhashes and bitmaps allow the similarity."""
    names, kept = ("key", "cell", "side", "place", "digest", "label", "size"), None

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: t.column(c).to_numpy() for c in names}
        marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint16).reshape(-1, HASHES)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        edge = np.flatnonzero(np.append(True, (cols["key"][1:] != cols["key"][:-1]) | (cols["cell"][1:] != cols["cell"][:-1])))
        u, v = [], []
        for a, e in zip(edge.tolist(), np.append(edge[1:], t.num_rows).tolist(), strict=True):
            side = cols["side"][a:e]
            strays, all_ = a + np.flatnonzero(side == 0), a + np.flatnonzero(side == 1)
            for s in strays.tolist():
                n, m = cols["size"][s], cols["size"][all_]
                on = all_[(cols["label"][all_] != cols["label"][s]) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))]
                same = marks[on] == marks[s]
                half = same.reshape(len(on), 2 * HALVES, EACH).all(axis=2)
                keep = (np.argmax(half, axis=1) == cols["place"][s]) & half[:, HALVES:].any(axis=1) & (same.sum(axis=1) >= least_marks())
                on = on[keep]
                # at least NUM / DEN in common leaves (DEN - NUM) / (DEN + NUM) of both sizes for what isn't
                apart = np.bitwise_count(bits[on] ^ bits[s]).sum(axis=1, dtype=np.int64)
                on = on[(DEN + NUM) * apart <= (DEN - NUM) * (n + cols["size"][on])]
                d, o = np.full(len(on), cols["digest"][s]), cols["digest"][on]
                u.append(np.minimum(d, o))
                v.append(np.maximum(d, o))
        if u and len(pairs := np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for b in batches:
        t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        key, cell = (t.column(c).to_numpy() for c in ("key", "cell"))
        other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        kept = t.slice(cut)
        if cut:
            yield from found(t.slice(0, cut))
    if kept is not None and kept.num_rows:
        yield from found(kept)


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, digest): the tables' keys, made of half-keys that two nodes have; a key that only one node has is left out."""
    halves = nodes.select("digest", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    own = halves.join(shared, "half").groupBy("digest")
    own = own.agg(*[F.collect_list(F.when(F.col("place").between(HALVES * k, HALVES * k + HALVES - 1), F.col("half"))).alias(c) for k, c in enumerate("ab")])
    keyed = own.select("digest", F.explode("a").alias("x"), "b").select("digest", "x", F.explode("b").alias("y"))
    keyed = materialize(keyed.select(F.xxhash64("x", "y").alias("key"), "digest"), "minhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    met = materialize(keyed.join(sizes, "key"), "minhash-met")
    often = met.groupBy("digest").agg(F.sum("met").alias("often"))
    out = materialize(met.join(often, "digest").select("key", "digest", "often"), "minhash-tables")
    return out


def _spokes(members: DataFrame, outside: bool) -> DataFrame:
    """(u, v): each node that isn't of its bucket's centre's class, and the centre that it meets most often.

    ``members``: (key, digest, often, label). ``outside``: the centre isn't of the class of the most met member, but the most
    met of the others.
    """
    most = lambda df: df.groupBy("key").agg(F.max(F.struct("often", "digest", "label")).alias("c"))
    if outside:
        first = most(members).select("key", F.col("c.label").alias("not"))
        centre = most(members.join(first, "key").where("label <> not"))
    else:
        centre = most(members)
    met = members.join(centre, "key").where("label <> c.label").groupBy("digest", F.col("c.digest").alias("v")).count()
    return met.groupBy(F.col("digest").alias("u")).agg(F.max_by("v", F.struct("count", "v")).alias("v"))


def _cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of ``members`` (digest, label) of different classes that met in a table and can be similar."""
    rows = materialize(sets.join(members, "digest").select("digest", "label", "shingles").mapInArrow(_members, _MEMBER), "minhash-members")
    classes = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"), F.count("*").alias("k"))
    mixed = rows.join(classes.where("k > 1").drop("k"), "key")
    blocks, strays = F.ceil(F.col("n") / CELL), F.ceil((F.col("n") - F.col("most")) / CELL)
    h, first = F.xxhash64("digest"), F.lit(0).cast("long")
    stray = mixed.where("label <> main").withColumn("x", F.pmod(h, strays)).withColumn("y", F.explode(F.sequence(first, blocks - 1)))
    every = mixed.withColumn("y", F.pmod(h, blocks)).withColumn("x", F.explode(F.sequence(first, strays - 1)))
    both = [df.select(*rows.columns, (F.col("x") * blocks + F.col("y")).alias("cell"), F.lit(k).cast("long").alias("side")) for k, df in enumerate((stray, every))]
    dealt = both[0].unionByName(both[1]).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_in_cells, "u long, v long").distinct()


def similar_sets(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, root) in digests: the components of all similar sets of ``nodes``; roots themselves aren't named. Leaves tables behind."""
    tables = table_keys(nodes)
    sets = sets_of(rows, tables.select("digest").distinct(), "minhash", shingle)
    edges = tables.select(F.col("digest").alias("u"), F.col("digest").alias("v")).limit(0)
    if sets is None:
        return components(edges, "minhash-roots")
    members, roots = tables.withColumn("label", F.col("digest")), None
    for k in range(STARS + 1):
        pairs = _spokes(members, outside=k > 0) if k < STARS else _cells(members.select("digest", "label").distinct(), sets)
        new = materialize(confirmed(pairs, sets), "minhash-similar")
        edges = edges.unionByName(new)
        if k and new.isEmpty():
            continue
        roots = components(edges, "minhash-roots")
        if k == STARS:
            break
        label = F.coalesce("root", "digest").alias("label")
        held = tables.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", "often", label)
        mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        members = materialize(held.join(mixed, "key"), "minhash-mixed")
        if members.isEmpty():
            break
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    before = written()
    whole = materialize(rows.mapInArrow(_sketches(shingle), _SKETCH), "minhash")
    nodes = materialize(whole.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves")), "minhash-nodes")
    roots = similar_sets(rows, nodes.where("node is not null"), shingle)
    named = nodes.select("digest", "node").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "node", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("node").alias("least"))
    named = named.join(least, "root").select("digest", "least")
    out = whole.select("doc_id", "digest", "size").join(named, "digest", "left")
    component = F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id")), "minhash-classes")
    discard_but(spark, *before, out.scratch_path)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
e2 AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e2.y, r.root FROM r JOIN e2 ON e2.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
