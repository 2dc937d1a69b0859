"""Importance resampling towards a target distribution, on hashed word features.

Texts are never split into Python strings. A lookup table classifies the bytes of the Arrow buffer as they lie there (word
byte in lower case, or separator), differences of that mask give the words' starts and ends, and one table-driven CRC-32 is
advanced across all starts at once: step k feeds the k-th byte of every word that is longer than k. Every byte of a
character beyond ASCII is a word byte, so the automaton on bytes finds the words that one on characters would.

Two scans: the first adds up what each bucket holds in the corpus (a task sends its buckets once, however much it reads),
the second gives each document the mean gain of its features. The draw is Gumbel top-k. A histogram of the scores names the
lowest score that is drawn; only what reaches it is sorted, in ranges, and ranks are the ranges' sizes before plus the place
in the range, so no task sees all of it.

Defined results: null, empty or blank text has no features, weight 0, and can be drawn only if ``least_words`` is 0; rows with
a null id count as features of the corpus and get a weight, but no score and no rank; repeated rows are documents of their
own and get ranks one after another; equal scores go by id; an empty corpus gives an empty result, an empty target counts 0
in each bucket; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, materialize, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes of text whose words are looked at together.
PIECE = 1 << 20
#: Words that are still unfinished are left to one call each once they're so few.
FEW = 16


@cache
def byte_table() -> np.ndarray:
    """Byte to its lower-case word byte, or 0 for a separator: digits, letters and all bytes beyond ASCII make words."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    word = np.zeros(256, bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        word[ord(low) : ord(high) + 1] = True
    word[128:] = True
    out[~word] = 0
    return out


@cache
def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1)).astype(np.uint32)
    return out


def word_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` (mapped bytes); a word never goes over one of the ``edges``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = edges[(edges > 0) & (edges < len(data))]
    cut = np.unique(cut[(data[cut] != 0) & (data[cut - 1] != 0)])  # two texts that touch inside a run of word bytes
    if len(cut):
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return starts, ends


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end], all advanced together, longest first so that the unfinished ones are a prefix."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    value, steps = np.full(len(at), 0xFFFFFFFF, np.uint32), crc_table()
    longest = int(left[0]) if len(left) else 0
    alive = np.searchsorted(-left, -np.arange(longest), side="left")  # words longer than k
    for k in range(longest):
        n = int(alive[k])
        if n <= FEW:  # the same table, one word at a time
            for i in range(n):
                value[i] = zlib.crc32(data[at[i] + k : at[i] + left[i]], int(value[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        v = value[:n]
        value[:n] = steps[(v ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (v >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = value ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each word of an Arrow string array, in pieces of about PIECE bytes that end between words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, stop, lookup = int(edges[0]), int(edges[-1]), byte_table()
    while at < stop:
        end = min(at + PIECE, stop)
        while end < stop and lookup[whole[end]] and edges[here := np.searchsorted(edges, end)] != end:  # on to a separator or the next text
            ahead = min(end + PIECE, int(edges[here]))
            room = lookup[whole[end:ahead]] == 0
            end = end + int(np.argmax(room)) if room.any() else ahead
        first = np.searchsorted(edges, at, side="right") - 1
        last = np.searchsorted(edges, end, side="left")
        data = lookup[whole[at:end]]
        starts, ends = word_bounds(data, edges[first : last + 1] - at)
        row = np.searchsorted(edges, starts + at, side="right") - 1
        yield row, crc32_of(data, starts, ends) % np.uint32(buckets)
        at = end


def _counts(buckets: int, least: int):
    """Batches of texts to (bucket, n), once for all that a task reads; bucket -1 counts texts of ``least`` words with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole = np.zeros(buckets, np.int64), 0
        for b in batches:
            words = np.zeros(b.num_rows, np.int64)
            for row, bucket in features(b.column("text"), buckets):
                total += np.bincount(bucket, minlength=buckets)
                words += np.bincount(row, minlength=b.num_rows)
            whole += int((b.column("has_id").to_numpy(zero_copy_only=False) & (words >= least)).sum())
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(total[on], whole))], names=["bucket", "n"])

    return run


def _weights(gains, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for row, bucket in features(b.column("text"), buckets):
                n += np.bincount(row, minlength=b.num_rows)
                np.add.at(total, row, gain[bucket])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "weight"])

    return run


def bucket_counts(rows: DataFrame, buckets: int, least: int) -> tuple[np.ndarray, int]:
    """(what each bucket holds, texts of ``least`` words with an id) of rows (doc_id, text); ``buckets`` rows reach the driver."""
    sent = rows.select("text", F.col("doc_id").isNotNull().alias("has_id")).mapInArrow(_counts(buckets, least), "bucket long, n long")
    got = sent.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(buckets, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of target to corpus in each bucket, one added everywhere, rounded down."""
    n = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def ranked(rows: DataFrame, count: int, ids: str = "doc_id") -> DataFrame:
    """``rows`` with ``rank``: 1 to ``count`` by falling score, then rising id; null beyond, and where the score is null.

    ``rows`` must be a written table, as it's read more than once.
    """
    held = rows.groupBy("score").count().where("score is not null").toArrow()  # one row for each different integer score
    score, n = held.column("score").to_numpy(), held.column("count").to_numpy()
    order = np.argsort(-score)
    at = int(np.searchsorted(np.cumsum(n[order]), count)) if count else 0
    if not count or not len(score):
        return rows.withColumn("rank", F.lit(None).cast("long"))
    lowest = int(score[order][min(at, len(score) - 1)])
    reach = F.coalesce(F.col("score") >= lowest, F.lit(False))
    # 33 lower bits: the place in the range, upper bits: the range
    top = rows.where(reach).repartitionByRange(F.desc("score"), F.asc(ids), F.asc("_row")).sortWithinPartitions(F.desc("score"), F.asc(ids), F.asc("_row"))
    top = materialize(top.withColumn("_at", F.monotonically_increasing_id()), "importance-top")
    sizes = top.groupBy(F.shiftright("_at", 33).alias("_part")).count()  # a row for each range
    before = sizes.selectExpr("_part", "sum(count) over (order by _part) - count as _before")
    place = F.col("_before") + (F.col("_at").bitwiseAND((1 << 33) - 1)) + 1
    placed = top.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    placed = placed.select(*rows.columns, F.when(place <= count, place).alias("rank"))
    return placed.unionByName(rows.where(~reach).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: float = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null for what isn't drawn.

    ``weight``: floored mean of the features' gains. ``score``: weight plus 1000 times a Gumbel number made of the seed and
    the id, so a draw can be repeated and shared out over machines.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    corpus, eligible = bucket_counts(rows, buckets, least_words)
    wanted, _ = bucket_counts(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), buckets, least_words)
    gains = spark.sparkContext.broadcast(bucket_gains(corpus, wanted))
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "n_features", "weight")])
    weighed = rows.mapInArrow(_weights(gains, buckets), schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id())
    scored = materialize(scored, "importance")
    # those that can't be drawn keep their score and are ranked apart
    can = F.coalesce(F.col("n_features") >= least_words, F.lit(False)) & F.col("doc_id").isNotNull()
    drawn = ranked(scored.where(can), int(eligible * percent // 100))
    out = drawn.unionByName(scored.where(~can).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), bytes AS (
  SELECT w, list_transform(range(0, length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)
), hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes
), f AS (SELECT side, id, bucket FROM words JOIN hashed USING (w)),
held AS (SELECT range AS bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM range(10000) LEFT JOIN f ON bucket = range GROUP BY range),
gain AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s::DOUBLE + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM held),
own AS (SELECT id AS doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id
), drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS k FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)
"""
