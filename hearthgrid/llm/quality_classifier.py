"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document, beside the scan. Spark counts the documents
of each pattern of votes; EM over the patterns (classes hidden, votes independent within a class) gives each pattern's
posterior. A linear scorer on hashed byte trigrams is fitted to the posteriors and scores every whole document. No given
label is read.

EM sees the votes of all documents. The scorer is fitted on about ``TRAIN_DOCS`` documents (a documented bound, drawn by a
hash of the text, whole texts, never held-out ones); a document sends at most ``SLOTS`` numbers to the driver.

Defined results: null text and text without a word have score 0; if all posteriors are alike, all other texts get their
mean; repeated rows are all returned; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import held_out

TRAIN_DOCS = 4_096
SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
EM_STEPS, FIT_STEPS, RATE, DECAY = 100, 150, 0.05, 1e-4
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20

GOOD, BAD, NONE = 1, 0, 2
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_]")
#: Frequent function words of the corpus's languages.
_COMMON = set(
    "the of and to in is that it was for on are as with be by this a der die das und ist nicht von zu mit ein eine den auf für "
    "le la les de des et est un une dans que pour pas qui sur el los las en y es por con para del no se al".split()
)


def _band(x: float, bad_below: float, good_from: float) -> int:
    return BAD if x < bad_below else GOOD if x >= good_from else NONE


def votes(text: str | None) -> list[int]:
    """One vote of each labeller; they look at overlapping signs of the same text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [BAD] * LABELLERS
    letters = sum(map(str.isalpha, text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    ends = sum(w[-1] in ".!?" for w in words) / n
    mean = sum(map(len, words)) / n
    triples = list(zip(words, words[1:], words[2:], strict=False))
    return [
        _band(-len(_SYMBOLS.findall(text)) / n, -0.1, -0.02),
        _band(letters / sum(map(len, words)), 0.8, 0.9),
        _band(sum(w.lower() in _COMMON for w in words) / n, 0.08, 0.2),
        _band(n, 30, 100),
        _band(len(set(lines)) / len(lines), 0.7, 0.9) if len(lines) > 1 else NONE,
        _band(len(set(triples)) / len(triples), 0.5, 0.8) if triples else NONE,
        GOOD if 0.02 <= ends <= 0.25 else BAD if ends < 0.005 or ends > 0.4 else NONE,
        GOOD if 3 <= mean <= 9 else BAD if mean < 2.5 or mean > 12 else NONE,
    ]


LABELLERS = 8


def pattern(text: str | None) -> int:
    """The votes as digits of a number to base 3."""
    return sum(v * 3**k for k, v in enumerate(votes(text)))


def _digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(LABELLERS) % 3


def posteriors(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Probability of a good document for each pattern. Starts from the majority of votes, so good stays good."""
    v = _digits(patterns)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    p = (good + 1) / (good + bad + 2)
    hit = np.stack([v == k for k in (BAD, GOOD, NONE)], axis=2).astype(float)
    for _ in range(steps):
        sides = []
        for weight in (counts * (1 - p), counts * p):
            table_ = np.tensordot(weight, hit, axes=1) + 0.5
            sides.append(np.log(weight.sum() + 1) + np.tensordot(hit, np.log(table_ / table_.sum(axis=1, keepdims=True)), axes=2))
        new = 1 / (1 + np.exp(np.clip(sides[0] - sides[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def _slots(text: str | None) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of a text with a word, piece by piece."""
    if not text or text.isspace():
        return
    data = b" " + text.lower().encode() + b" "
    for at in range(0, len(data) - 2, CHUNK):
        d = np.frombuffer(data[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        g = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
        yield (g * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)


def _pattern_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, n = np.unique(np.fromiter((pattern(t.as_py()) for t in b.column("text")), np.int64, b.num_rows), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple[int, bytes, bytes]] = []
        for t in b.column("text").to_pylist():
            total = sum((np.bincount(s, minlength=SLOTS) for s in _slots(t)), np.zeros(SLOTS, np.int64))
            at = np.flatnonzero(total)
            if len(at):
                rows.append((pattern(t), at.astype(np.uint16).tobytes(), (total[at] / total.sum()).astype(np.float32).tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["pattern", "slots", "shares"])


def fit(slots: list[np.ndarray], shares: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the slots' shares and the constant of a logistic scorer, by Adam over all rows; soft targets."""
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    bias, w = np.log(mean / (1 - mean)), np.zeros(SLOTS)
    if np.ptp(target) < 1e-6:
        return w.astype(np.float32), float(bias)
    at, x = np.concatenate(slots).astype(np.int64), np.concatenate(shares).astype(np.float64)
    first = np.cumsum([0, *map(len, slots)])[:-1]
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    # slots that are common everywhere would else hide the others
    scale = 1 / np.sqrt(np.bincount(at, x, SLOTS) / len(slots) + 1e-5)
    x = x * scale[at]
    # either class weighs as much as the other
    even = target / (2 * mean) + (1 - target) / (2 * (1 - mean))
    bias, m, s = 0.0, np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for k in range(1, FIT_STEPS + 1):
        wrong = even * (1 / (1 + np.exp(-np.clip(np.add.reduceat(x * w[at], first) + bias, -50, 50))) - target) / len(target)
        slope = np.append(np.bincount(at, x * wrong[row], SLOTS) + DECAY * w, wrong.sum())
        m, s = 0.9 * m + 0.1 * slope, 0.99 * s + 0.01 * slope**2
        step = RATE * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return (w * scale).astype(np.float32), float(bias)


def train(rows: DataFrame, learnable: DataFrame) -> tuple[np.ndarray, float]:
    """The scorer for the texts of ``rows``; only ``learnable`` ones are fitted on."""
    counted = rows.mapInArrow(_pattern_counts, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    patterns, counts = counted.column("pattern").to_numpy(), counted.column("n").to_numpy()
    if not len(patterns):
        return np.zeros(SLOTS, np.float32), 0.0
    of = dict(zip(patterns.tolist(), posteriors(patterns, counts.astype(float)).tolist(), strict=True))
    # the hash is uniform, so its place among all 64-bit values is a draw that depends on the text only
    draw = (F.xxhash64("text") / F.lit(2.0**64)) + F.lit(0.5)
    drawn = learnable.where(draw < min(1.0, TRAIN_DOCS / int(counts.sum()))).select("text")
    got = drawn.mapInArrow(_features, "pattern long, slots binary, shares binary").toArrow().to_pydict()
    if not got["pattern"]:
        return np.zeros(SLOTS, np.float32), 0.0
    order = sorted(range(len(got["pattern"])), key=lambda i: (got["pattern"][i], got["slots"][i], got["shares"][i]))
    slots = [np.frombuffer(got["slots"][i], np.uint16) for i in order]
    return fit(slots, [np.frombuffer(got["shares"][i], np.float32) for i in order], np.array([of[got["pattern"][i]] for i in order]))


def score(text: str | None, weights: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for s in _slots(text):
        total, n = total + float(weights[s].sum(dtype=np.float64)), n + len(s)
    return 1 / (1 + float(np.exp(-np.clip(total / n + bias, -50, 50)))) if n else 0.0


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, quality) of each row; quality is 1 from a score of a half on."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows.select("text"), rows.where(~held_out()).select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([score(t.as_py(), *model.value) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("quality"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
