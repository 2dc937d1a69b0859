"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale-factor directory, whatever file system holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: the session's checkpoint directory.

    Where it is unset, a local session (tests, bench) gets one of its own; on a cluster that's an error, as a folder of one
    machine would lose data.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"spark-shared-{os.getpid()}"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
    return got.get().rstrip("/")


#: Folders of the tables that ``materialize`` wrote and nothing has deleted since.
_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage: later stages never recompute ``df``, and a lost executor costs only its own tasks. ``discard``
    removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def written() -> set[str]:
    """Folders of the tables that are there now; results of the operators may still read them."""
    return set(_written)


def discard_but(spark: SparkSession, *keep: str) -> None:
    """Delete the tables of this process but those in the folders ``keep``: for when their readers' results are written.

    An operator returns a lazy result that reads its tables, so only its caller knows when they aren't needed any more.
    """
    for path in written() - set(keep):
        _delete(spark, path)


def scratch(docs: DataFrame, *names: str) -> list[str]:
    """Names for passing columns that no column of ``docs`` has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (three xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


SPACE_BYTES = byte_set(SPACES.encode())
#: Words whose hash a worker keeps, and bytes of the longest of them.
KEPT_WORDS, KEPT_BYTES = 200_000, 40


class _Hashes(dict):
    """64-bit XXH3 of each word; those met first, and with them the common ones, are kept."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < KEPT_WORDS and len(word) <= KEPT_BYTES:
            self[word] = found
        return found


@cache
def _hashes_of(seed: int) -> _Hashes:
    return _Hashes(seed)


def word_pieces(texts: list[bytes], separators: np.ndarray = SPACE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(text number, words) in order; a text of more than CHUNK bytes comes in pieces that end between words.

    Words are runs of bytes outside ``separators``, which must hold the six white-space characters.
    """
    spaced = np.where(separators, 32, np.arange(256)).astype(np.uint8).tobytes()
    for k, text in enumerate(texts):
        text, at = text.translate(spaced), 0
        while at < len(text):
            end = text.find(b" ", at + CHUNK)
            end = len(text) if end < 0 else end
            yield k, text[at:end].split()
            at = end


def word_hashes(texts: list[bytes], separators: np.ndarray = SPACE_BYTES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts in order, and the number of words of each text."""
    get, counts, out, words = _hashes_of(seed).__getitem__, np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)], []
    for k, more in word_pieces(texts, separators):
        counts[k] += len(more)
        words += more
        if len(words) > CHUNK // 8:
            out.append(np.fromiter(map(get, words), np.uint64, len(words)))
            words = []
    out.append(np.fromiter(map(get, words), np.uint64, len(words)))
    return np.concatenate(out), counts
