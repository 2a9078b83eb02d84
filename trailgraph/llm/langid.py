"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1-, 2- and 3-grams of the lower-cased text.  Document frequencies are counted over every training
row.  The weights are fitted by follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties, on a
sample of whole, different training texts bounded by ``rows_a_language`` for each language (all of them where there are
fewer); every language that has a label is learnt.  A fifth of the sample sets the temperature of the probabilities.
Term frequencies are relative, so a score is a sum over the text and a text of any length is scored in slices.

The model is sparse: only buckets with a weight have a row.  The driver fits it in 16 bytes for each language and bucket
that occurs in the sample (65,536 at most).

Defined cases: ``und`` and score 0 for null texts and texts without a letter, and for every text when nothing is there
to learn from; a null id counts as held out; rows with a null label are not learnt from; a single language always wins;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import map_arrow, map_batches

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SLICE = 1 << 20
#: Weights that are summed at a time, in buckets.
BLOCK = 1 << 12
#: Draws are of so many bits: a rate stays above zero for any number of rows.
DRAW_BITS = 60
SCALE = 10.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
UNKNOWN = "und"

_U = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams, a slice of the text at a time (slices overlap by two)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    for at in range(0, len(codes), SLICE):
        c = codes[max(0, at - 2) : at + SLICE].astype(np.uint64)
        new = at - max(0, at - 2)
        h, out = c, []
        for n, m in enumerate(_MULTIPLIERS):
            h = h if n == 0 else h[:-1] * _U(0x100000001B3) + c[n:]
            if len(h):
                out.append(((h + _U(n)) * _U(m) >> _U(64 - BUCKET_BITS))[max(0, new - n) :])
        yield np.concatenate(out).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Texts that have each bucket; a row a bucket and task is summed, ``BUCKETS`` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
        for b in batches:
            for text in b.column(0).to_pylist():
                for g in grams(text or ""):
                    seen[g] = True
                total += seen
                seen[:] = False
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in map_arrow(texts, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def _counted(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for lang, fold, text in zip(*(b.column(i).to_pylist() for i in range(3))):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for g in grams(text):
            total += np.bincount(g, minlength=BUCKETS)
        used = np.flatnonzero(total)
        rows.append((lang, fold, used.astype(np.uint16).tobytes(), (total[used] / total.sum()).astype(np.float32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "fold", "buckets", "values"])


@dataclass
class LanguageModel:
    languages: list[str]
    rows: np.ndarray  # for each bucket its row of weights; 0, a row of zeros, where it has none
    weights: np.ndarray  # rows x languages, document frequencies folded in
    bias: np.ndarray
    temperature: float

    def sums(self, g: np.ndarray) -> np.ndarray:
        """The weights of the buckets together; buckets of long texts are counted first."""
        if len(g) <= BLOCK:
            return self.weights[self.rows[g]].sum(axis=0, dtype=np.float64)
        counts = np.bincount(self.rows[g], minlength=len(self.weights))
        used = np.flatnonzero(counts)
        blocks = (used[at : at + BLOCK] for at in range(0, len(used), BLOCK))
        return sum((counts[b] @ self.weights[b].astype(np.float64) for b in blocks), np.zeros(len(self.languages)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            total += self.sums(g)
            n += len(g)
        logits = (total / n + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in ascending order, their weights (buckets x classes), and biases.  rows: class, buckets, values."""
    known = np.unique(np.concatenate([buckets for _, buckets, _ in rows])) if rows else np.zeros(0, dtype=np.int64)
    size = len(known)
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    l1 = np.full((size + 1, 1), L1)
    l1[size] = 0  # the bias is not penalised

    def weights(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * l1[at]) / ((BETA + np.sqrt(na)) / ALPHA + L2)
        return np.where(np.abs(za) <= l1[at], 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, buckets, values = rows[i]
            at, x = np.append(np.searchsorted(known, buckets), size), np.append(values, 1.0)[:, None]
            w = weights(at)
            logits = (w * x).sum(axis=0)
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return known, w[:size], w[size]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search of its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, rows_a_language: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from the rows that are not held out and have a language and a letter-bearing text."""
    train = docs.filter(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    train = train.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS, dtype=np.int32), np.zeros((1, 0), dtype=np.float32), np.zeros(0), 1.0)
    df = document_frequencies(train.select("text"))
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    draw = F.xxhash64(F.col("doc_id"), F.lit(11)).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))
    rate = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int(min(1.0, rows_a_language / counts[lang]) * (1 << DRAW_BITS))))])
    sample = train.filter(draw < rate[F.col("lang")]).select("lang", "text").distinct()
    fold = F.pmod(F.xxhash64("text", F.lit(12)), F.lit(5))
    # Bounded by rows_a_language for each language (in expectation), a few KB each.
    held = map_batches(sample.select("lang", fold.alias("fold"), "text"), _counted, "lang string, fold long, buckets binary, values binary").collect()
    held = sorted(((r["lang"], r["fold"], bytes(r["buckets"]), bytes(r["values"])) for r in held if len(r["buckets"])))
    number = {lang: i for i, lang in enumerate(languages)}
    rows = []
    for lang, fold_no, buckets, values in held:
        at = np.frombuffer(buckets, dtype=np.uint16).astype(np.int64)
        rows.append((fold_no, (number[lang], at, np.frombuffer(values, dtype=np.float32) * idf[at] * SCALE)))
    learn = [r for fold_no, r in rows if fold_no] or [r for _, r in rows]
    check = [r for fold_no, r in rows if not fold_no] or learn
    known, w, bias = fit_ftrl(learn, len(languages))
    of_bucket, some = np.zeros(BUCKETS, dtype=np.int32), np.flatnonzero((w != 0).any(axis=1))
    of_bucket[known[some]] = 1 + np.arange(len(some))
    folded = np.concatenate((np.zeros((1, len(languages))), w[some] * (idf[known[some]] * SCALE)[:, None]))
    plain = np.concatenate((np.zeros((1, len(languages))), w[some]))
    logits = np.array([(plain[of_bucket[at]] * x[:, None]).sum(axis=0) + bias for _, at, x in check]).reshape(len(check), len(languages))
    temperature = fit_temperature(logits, np.array([y for y, _, _ in check])) if check else 1.0
    return LanguageModel(languages, of_bucket, folded.astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a float for each language and bucket with a weight, BUCKETS at most

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shipped.value.predict(t) for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
