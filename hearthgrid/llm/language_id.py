"""Language identification with interpolated Kneser-Ney character models.

Texts are folded to lower-case letters with one space between runs of letters. For each language, counts of character
4-grams give an interpolated Kneser-Ney model; the grams of all languages stand in one sorted array of 64-bit codes (four
16-bit hashes of characters; those below U+10000 are their own hash) with a column of log probabilities for each language,
and a shorter gram answers where a longer one was never seen. The language with the lowest cross-entropy per character wins.

Training reads at most about ``TRAIN_DOCS`` labelled documents of each language (a documented bound, drawn by a hash of
the text, whole texts); counting is distributed, and all grams of the drawn documents, none left out, make the model. The
score is the winner's probability among the languages, its sharpness fitted on labelled texts that weren't counted.
A text is marked rejected if its cross-entropy lies above what ``1 - REJECT_RATE`` of those texts of the winning language
reach (at a like length).

Defined results: null text and text without a letter give ``und`` with score 0; with no labelled text at all, every text
gives ``und``; repeated rows are all returned; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORDER = 4
#: Mean number of training documents drawn for each language; an eighth of them calibrates.
TRAIN_DOCS = 4_000
REJECT_RATE = 0.005
#: Characters that are scored at once.
CHUNK = 1 << 20

#: Runs without a letter or a mark on one (categories L and M); digits, numerals and other number signs are no letters.
_ASCII, _ANY, _LETTER = re.compile(r"[^a-z]+"), regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_MASKS = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]


def fold(text: str | None) -> str:
    """Lower-case letters, one space around each run; empty if there is no letter."""
    low = (text or "").lower()
    words = (_ASCII if low.isascii() else _ANY).sub(" ", low).strip()
    return f" {words} " if words and (words.isascii() or _LETTER.search(words)) else ""


def codes(folded: str) -> np.ndarray:
    """The gram that ends at each character after the first, as four 16-bit characters; spaces stand before the text.

    Characters from U+10000 on are hashed to the 2,048 values that no other character has.
    """
    chars = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(chars > 0xFFFF, 0xD800 + (chars * np.uint32(2654435761) >> np.uint32(21)), chars).astype(np.uint64)
    c = np.concatenate([np.full(ORDER - 2, 0x20, np.uint64), c])
    n = len(c) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | c[k : k + n]
    return out


@dataclass
class Model:
    """``grams[k]``: sorted codes of k + 1 characters; ``logp[k]``: their log probability in each language.

    ``back[k]``: log weight of the shorter gram behind each context of k + 1 characters. ``mean`` and ``spread``: cross-
    entropy of the languages' own texts; ``limit``: most standard scores above the mean; ``sharpness``: of the score.
    """

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf
    sharpness: float = 1.0

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """One row for each gram, one column for each language."""
        out = np.full((len(grams), len(self.langs)), self.floor, np.float32)
        todo, carried = np.arange(len(grams)), np.zeros((len(grams), len(self.langs)), np.float32)
        for k in range(ORDER - 1, -1, -1):
            if not len(todo):
                break
            own = grams[todo] & _MASKS[k + 1]
            at = np.minimum(np.searchsorted(self.grams[k], own), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == own
            out[todo[hit]] = self.logp[k][at[hit]] + carried[hit]
            todo, carried, own = todo[~hit], carried[~hit], own[~hit]
            if k:
                context = own >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.grams[k - 1], context), len(self.grams[k - 1]) - 1)
                known = self.grams[k - 1][at] == context
                carried = carried + np.where(known[:, None], self.back[k - 1][at], np.float32(0))
        if len(todo):
            out[todo] += carried
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, and the number of characters (0: no letter)."""
        sums, lengths = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        pending, owners, size = [], [], 0

        def flush():
            if pending:
                flat = self.log_probs(np.concatenate(pending))
                bounds = np.cumsum([0] + [len(p) for p in pending])[:-1]
                np.add.at(sums, owners, np.add.reduceat(flat, bounds, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            grams = codes(f) if (f := fold(text)) else np.zeros(0, np.uint64)
            lengths[i] = len(grams)
            for a in range(0, len(grams), CHUNK):
                pending.append(grams[a : a + CHUNK])
                owners.append(i)
                size += len(pending[-1])
                if size >= CHUNK // 4:
                    flush()
                    pending, owners, size = [], [], 0
        flush()
        return -sums / np.maximum(lengths, 1)[:, None], lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected as none of the learned languages."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        odds = np.exp(np.minimum(0, (low[:, None] - h) * self.sharpness * np.sqrt(np.maximum(n, 1))[:, None])).sum(axis=1)
        score = np.where(n > 0, 1 / np.maximum(odds, 1), 0.0)
        far = n == 0
        if self.mean is not None:
            far |= (low - self.mean[best]) * np.sqrt(np.maximum(n, 1)) / self.spread[best] > self.limit
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], score, far


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of each language's (4-gram codes, counts).

    The longest grams count occurrences, shorter ones the different characters before them; one discount per order.
    """
    langs = sorted(counts)
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        order = np.argsort(counts[lang][0])
        levels = [(counts[lang][0][order], counts[lang][1][order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):
            levels.append(tuple(x.astype(t) for x, t in zip(np.unique(levels[-1][0] & _MASKS[k], return_counts=True), (np.uint64, np.float64), strict=True)))
        tables.append(levels[::-1])
    grams = [np.unique(np.concatenate([t[k][0] for t in tables])) if tables else np.zeros(0, np.uint64) for k in range(ORDER)]
    logp, back = [], []
    size = max(len(grams[0]) + 1, 2)
    for k in range(ORDER):
        probs = np.zeros((len(grams[k]), len(langs)))
        if k:
            back.append(np.zeros((len(grams[k - 1]), len(langs)), np.float32))
        for j, levels in enumerate(tables):
            g, c = levels[k]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
            own = np.zeros(len(grams[k]))
            own[np.searchsorted(grams[k], g)] = np.maximum(c - discount, 0)
            if not k:
                probs[:, j] = own / c.sum() + discount * len(g) / c.sum() / size
                continue
            context = np.searchsorted(grams[k - 1], grams[k] >> np.uint64(16))
            context = np.where(grams[k - 1][np.minimum(context, len(grams[k - 1]) - 1)] == grams[k] >> np.uint64(16), context, -1)
            at = np.searchsorted(grams[k], g)
            total, kinds = np.zeros(len(grams[k - 1]) + 1), np.zeros(len(grams[k - 1]) + 1)
            np.add.at(total, context[at], c)
            np.add.at(kinds, context[at], 1)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            weight[-1] = 1.0
            lower = np.exp(logp[k - 1][np.minimum(np.searchsorted(grams[k - 1], grams[k] & _MASKS[k]), len(grams[k - 1]) - 1), j].astype(np.float64))
            probs[:, j] = np.where(total[context] > 0, own / np.maximum(total[context], 1e-9), 0) * (context >= 0) + weight[context] * lower
            back[k - 1][:, j] = np.log(np.maximum(weight[:-1], 1e-9))
        logp.append(np.log(np.maximum(probs, 1e-12)).astype(np.float32))
    back.append(np.zeros((len(grams[-1]), len(langs)), np.float32))
    return Model(langs, grams, logp, back, float(np.log(1 / size / 4)))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; those texts are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        texts = b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            g, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            pending: list[np.ndarray] = []
            for i in [*np.flatnonzero(langs == lang).tolist(), None]:
                if i is not None and (f := fold(texts[i])):
                    pending.append(codes(f))
                if pending and (i is None or sum(map(len, pending)) > CHUNK):
                    new, m = np.unique(np.concatenate(pending), return_counts=True)
                    both, at = np.unique(np.concatenate([g, new]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
                    g, pending = both, []
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model of the rows (text, lang); rows without either are passed over."""
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.where("lang is not null").groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [], [], [], 0.0)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, train_docs / n))) for k, n in sorted(sizes.items())])
    # the hash is uniform, so its place among all 64-bit values is a draw that depends on the text only
    draw = (F.xxhash64("text") / F.lit(2.0**64)) + F.lit(0.5)
    drawn = rows.select("text", "lang", (draw / share).alias("draw")).where("draw < 1")
    counted = drawn.where("draw < 0.875").select("text", "lang").mapInArrow(_gram_counts, "lang string, gram long, n long")
    counts = _collect_counts(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), sorted(sizes))
    model = kneser_ney({k: v for k, v in counts.items() if len(v[0])})
    return _calibrated(model, drawn.where("draw >= 0.875").select("text", "lang"))


def _collect_counts(counted: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The grams of each language; as many as the drawn documents hold, so train_docs bounds what reaches the driver."""
    t = counted.toArrow()
    lang, gram, n = np.array(t.column("lang").to_pylist(), object), t.column("gram").to_numpy(), t.column("n").to_numpy()
    return {k: (gram[at].view(np.uint64), n[at]) for k in langs for at in [np.flatnonzero(lang == k)]}


def _calibrated(model: Model, texts: DataFrame) -> Model:
    """Sharpness and rejection limit from texts that weren't counted; only their entropies reach the driver."""
    if not model.langs:
        return model
    langs = model.langs

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = model.entropies(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.string()), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], names=["lang", "n", "h"])

    got = [r for r in texts.mapInArrow(measure, "lang string, n long, h array<double>").collect() if r["n"] and r["lang"] in langs]
    h, n = np.array([r["h"] for r in got]).reshape(-1, len(langs)), np.array([r["n"] for r in got], np.float64)
    own = np.array([langs.index(r["lang"]) for r in got], int)
    mine = h[np.arange(len(got)), own]
    overall = mine.mean() if len(got) else 3.0
    mean = np.array([mine[own == j].mean() if (own == j).any() else overall for j in range(len(langs))])
    z = (mine - mean[own]) * np.sqrt(n)
    spread = np.array([max(z[own == j].std(), 1e-3) if (own == j).sum() > 1 else 1.0 for j in range(len(langs))])
    model.mean, model.spread = mean, spread
    if len(got):
        model.limit = float(np.quantile(z / spread[own], 1 - REJECT_RATE))
        loss = [(-np.log(np.maximum(1e-12, 1 / np.exp((mine[:, None] - h) * s * np.sqrt(n)[:, None]).sum(axis=1))).mean(), s) for s in (0.25, 0.5, 1, 2, 4, 8, 16)]
        model.sharpness = min(loss)[1]
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score, far = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
