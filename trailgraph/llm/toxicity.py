"""Toxicity by maximum-scoring segments.

A feature is a token, or the first few bytes of one, so that words of one stem count together.  Its weight is its log-odds
between toxic and other labelled texts under an informative Dirichlet prior, drawn to zero by its standard error.  A
token's score is the weight of that of its features whose weight is the furthest from zero, less a small drift that
every token pays, so that random text has a negative mean.  A linear-time scan finds all maximal-scoring segments of a
text.  Their scores follow an extreme-value law in clean text: of ``m`` tokens, K m exp(-lambda S) segments of score S or
more are expected.  lambda solves sum p exp(lambda s) = 1 over the scores of clean tokens; it and K are set by clean texts
that the weights have not seen.  A text's evidence is the sum of -ln(expected) over its significant segments, and a
logistic curve over it gives the score.

The classifier is fitted on a sample of labelled texts bounded by ``max_train_rows``, half of it toxic where there are
enough; equal texts count once, and near copies mostly.  The whole sample gives the weights.  For lambda, K and the curve, each third of it is
scored by weights of the other two.

Defined cases: null text counts as empty; a text without significant segment, empty ones too, has the curve's value at
no evidence; without labels of both classes every score is 0; repeated labels of an id count as toxic if one is; a null
id is held out; other columns are ignored (``drop_toxic`` keeps them).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import discard, map_arrow, map_batches, written
from trailgraph.llm.words import Chunks, chunk_groups, mix

#: Pseudo-counts: spread as the tokens are, and for each token.
PRIOR_TOTAL, PRIOR_EACH = 100.0, 0.5
#: Standard errors that weights are drawn to zero by; texts that a feature must be in.
SHRINK, MIN_TEXTS = 2.0, 3
DRIFT = 0.1
#: Parts of the sample; the texts of each are calibrated by the weights of the others.
FOLDS = 3
_COUNTS = [f"n{y}_{k}" for k in range(FOLDS) for y in (0, 1)]
#: Bytes of a token's beginnings that are features too.
STEMS = (4, 5, 6, 7)
#: Draws are of so many bits: a rate stays above zero for any number of labels.
DRAW_BITS = 60
#: Segments above this score set K.
CALIBRATE_ABOVE = 0.5
#: Features of texts that a task holds before it sums them.
HELD_FEATURES = 500_000
#: Tokens of the shingles, and permutations, that near copies in the sample are known by.
MARK_TOKENS, MARK_SALTS = 5, (1, 2)
#: Scores of clean tokens are counted in steps of this.
STEP = 0.01
#: Expected number of such segments in clean text below which a segment is significant.
SIGNIFICANT = 1.0
THRESHOLD = 0.7


@dataclass
class ToxicityModel:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = -math.inf
    slope: float = 0.0

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Scores of tokens, each a hash in every array of ``features`` (0: it has none there)."""
        out = np.zeros(len(features[0]))
        if len(self.hashes) and len(out):
            for hashes in features:
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                weight = np.where(self.hashes[at] == hashes, self.weights[at], 0.0)
                out = np.where(np.abs(weight) > np.abs(out), weight, out)
        return out - DRIFT

    def expected(self, score: float, tokens: int) -> float:
        return self.scale * tokens * math.exp(-self.rate * score)

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int) -> float:
        return sum(-math.log(max(e, 1e-300)) for *_, s in segments if (e := self.expected(s, tokens)) < SIGNIFICANT)

    def probability(self, evidence: float) -> float:
        return _sigmoid(self.intercept + self.slope * math.log1p(evidence))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)) if x > -700 else 0.0


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), left to right; linear in the number of scores.

    Each candidate keeps the sums before it and up to its end, and a link to the last candidate that begins lower.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[float, float, int, int, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, start, end = float(total[i]), float(total[i + 1]), i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, start, end, j))
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(start, end, high - low) for low, high, start, end, _ in stack]


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def token_groups(texts: list[str | None]) -> Iterator[Chunks]:
    return chunk_groups(texts, marks_apart=True, prefixes=STEMS)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class and fold that have each feature, summed over ``HELD_FEATURES`` at a time.  Input: y, fold, text."""
    hashes: list[np.ndarray] = []
    kinds: list[np.ndarray] = []

    def summed() -> Iterator[pa.RecordBatch]:
        each, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(at * 2 * FOLDS + np.concatenate(kinds), minlength=len(each) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
        hashes.clear()
        kinds.clear()
        for k in range(0, len(each), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(each[part].view(np.int64)), *(pa.array(c) for c in counts[part].T)], names=["token", *_COUNTS])

    held = 0
    for b in batches:
        kind = 2 * b.column(1).to_numpy() + b.column(0).to_numpy()
        for group in token_groups(b.column(2).to_pylist()):
            for i in range(group.lo, group.hi):
                of_text = slice(group.first[i - group.lo], group.first[i - group.lo + 1])
                own = np.unique(np.concatenate([x[of_text] for x in (group.hashes, *group.prefixes)]))
                own = own[own != 0]
                hashes.append(own)
                kinds.append(np.full(len(own), kind[i], dtype=np.int8))
                held += len(own)
            if held >= HELD_FEATURES:
                yield from summed()
                held = 0
    if hashes:
        yield from summed()


def log_odds(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int, shrink: float) -> np.ndarray:
    """Weights of features that n1 of the toxic and n0 of the other texts have: log-odds drawn to zero by their standard
    errors.  all1, all0: the sums over all features."""
    if not (all1 and all0):
        return np.zeros(len(n1))
    prior = PRIOR_TOTAL * (n1 + n0) / (all1 + all0) + PRIOR_EACH
    a1, a0 = n1 + prior, n0 + prior
    odds = np.log(a1 / (all1 + PRIOR_TOTAL - a1)) - np.log(a0 / (all0 + PRIOR_TOTAL - a0))
    drawn = np.sign(odds) * np.maximum(np.abs(odds) - shrink * np.sqrt(1 / a1 + 1 / a0), 0)
    return np.where(n1 + n0 >= MIN_TEXTS, drawn, 0.0)


def _weights(sums: np.ndarray, shrink: float):
    """For batches of (token, counts): (token, weights), by all folds and without each, where one isn't zero."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.stack([c.to_numpy() for c in b.columns[1:]]).reshape(FOLDS, 2, -1)
        out = []
        for fold in (None, *range(FOLDS)):
            used = [k for k in range(FOLDS) if k != fold]
            (n0, n1), (all0, all1) = counts[used].sum(axis=0), sums[used].sum(axis=0)
            out.append(log_odds(n1, n0, int(all1), int(all0), shrink))
        some = np.any(out, axis=0)
        return pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(list(np.stack(out, axis=1)[some]), pa.list_(pa.float64()))], names=["token", "weights"])

    return run


def _marks(b: pa.RecordBatch) -> pa.RecordBatch:
    """(y, mark, text): a hash of the least hashes, by different permutations, of a text's shingles of five tokens, which
    texts that differ in a few words mostly share."""
    marks = []
    for group in token_groups(b.column(1).to_pylist()):
        for i in range(group.hi - group.lo):
            h = group.hashes[group.first[i] : group.first[i + 1]]
            width = min(MARK_TOKENS, len(h))
            total = np.zeros(len(h) - width + 1, dtype=np.uint64)
            for k in range(width):
                total += h[k : len(total) + k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            least = [mix(total * np.uint64(2 * salt + 1)).min() for salt in MARK_SALTS]
            marks.append(int(mix(np.array(least) * np.arange(1, 2 * len(least), 2, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)))
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64()), b.column(1)], names=["y", "mark", "text"])


def _root(scores: np.ndarray, shares: np.ndarray) -> float:
    """lambda > 0 with sum share exp(lambda score) = 1, by bisection."""

    def excess(rate: float) -> float:
        return float((shares * np.exp(np.minimum(rate * scores, 600))).sum()) - 1

    low, high = 1e-6, 1e-6
    while excess(high) <= 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) <= 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by damped Newton steps with a small ridge."""
    w, design = np.zeros(2), np.stack((np.ones_like(x), x), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.01 * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    return float(w[0]), float(w[1])


def _scored(shipped, b: pa.RecordBatch, text_at: int) -> list[tuple[int, list[tuple[int, int, float]], float, list[tuple[int, int, float]]]]:
    """Tokens, segments in tokens, evidence, and significant segments in bytes, of each text of the batch."""
    model: ToxicityModel = shipped.value
    out = []
    for group in token_groups(b.column(text_at).to_pylist()):
        scores = model.scores([group.hashes, *group.prefixes])
        for i in range(group.hi - group.lo):
            a, z = int(group.first[i]), int(group.first[i + 1])
            segments = maximal_segments(scores[a:z])
            zero = int(group.offsets[i])
            spans = [(int(group.starts[a + s]) - zero, int(group.ends[a + e - 1]) - zero, score) for s, e, score in segments if model.expected(score, z - a) < SIGNIFICANT]
            out.append((z - a, segments, model.evidence(segments, z - a), spans))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from labelled rows that are not held out."""
    spark = docs.sparkSession
    eligible = labels.filter(F.col(label_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in eligible.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        return ToxicityModel()
    draw = F.xxhash64(F.col("labelled_id"), F.lit(21)).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))
    rates = {y: min(1.0, max_train_rows / 2 / counts[y]) for y in (0, 1)}
    picked = eligible.filter(draw < F.when(F.col("y") == 1, int(rates[1] * (1 << DRAW_BITS))).otherwise(int(rates[0] * (1 << DRAW_BITS))))
    # Broadcast: at most max_train_rows ids (in expectation), whatever the input.
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
    sample = map_batches(sample.groupBy("text").agg(F.max("y").alias("y")).select("y", "text"), _marks, "y int, mark long, text string")
    # One of each class of each group of near copies, so that a text that was copied often doesn't make all its words telling.
    sample = written(sample.groupBy("y", "mark").agg(F.max("text").alias("text")).select("y", "text"))
    sample = sample.select("y", F.pmod(F.xxhash64("text", F.lit(22)), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    counted = map_arrow(sample, _count_features, "token long, " + ", ".join(f"{c} long" for c in _COUNTS))
    counted = written(counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    sums = counted.agg(*[F.sum(c).alias(c) for c in _COUNTS]).first()

    totals = np.array([sums[c] or 0 for c in _COUNTS]).reshape(FOLDS, 2)
    chosen = map_batches(counted, _weights(totals, SHRINK), "token long, weights array<double>").collect()  # of the sample's features
    discard(counted)
    hashes = np.array([r["token"] for r in chosen], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    weights = np.array([r["weights"] for r in chosen], dtype=np.float64).reshape(-1, 1 + FOLDS)[order]
    model, *unseen = (ToxicityModel(hashes[order], w) for w in weights.T.copy())
    if not model.weights.any():
        return ToxicityModel()
    shipped = spark.sparkContext.broadcast(unseen)  # the sample's features at most

    def checked_texts(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, folds = [], b.column(1).to_pylist()
        for group in token_groups(b.column(2).to_pylist()):
            for i in range(group.hi - group.lo):
                of_text = slice(group.first[i], group.first[i + 1])
                x = shipped.value[folds[group.lo + i]].scores([h[of_text] for h in (group.hashes, *group.prefixes)])
                steps, counts = np.unique(np.rint(x / STEP).astype(np.int64), return_counts=True)
                rows.append((len(x), [s for *_, s in maximal_segments(x)], steps.tolist(), counts.tolist()))
        types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["y", "tokens", "scores", "steps", "counts"])

    checked = map_batches(sample, checked_texts, "y int, tokens long, scores array<double>, steps array<long>, counts array<long>").collect()
    clean: Counter[int] = Counter()
    for r in checked:
        clean.update(dict(zip(r["steps"], r["counts"])) if r["y"] == 0 else {})
    shares = np.array(list(clean.values()), dtype=np.float64)
    model.rate = _root(np.array(list(clean)) * STEP, shares / shares.sum()) if clean else 1.0
    above = sum(s > CALIBRATE_ABOVE for r in checked if r["y"] == 0 for s in r["scores"])
    model.scale = max(0.5, above) / max(1e-9, sum(r["tokens"] for r in checked if r["y"] == 0) * math.exp(-model.rate * CALIBRATE_ABOVE))
    x = np.array([math.log1p(model.evidence([(0, 0, s) for s in r["scores"]], r["tokens"])) for r in checked])
    y = np.array([r["y"] for r in checked], dtype=np.float64)
    model.intercept, model.slope = _logistic(x, y, np.where(y == 1, 1 / rates[1], 1 / rates[0])) if len(x) else (0.0, 1.0)
    return model


_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, segments``: significant segments in code points, with their scores."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scored = _scored(shipped, b, 2)
        p = [shipped.value.probability(e) for _, _, e, _ in scored]
        spans = [_code_points(t, s) for t, (*_, s) in zip(b.column(2).to_pylist(), scored)]
        columns = [b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(spans, _SEGMENTS)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "segments"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int, segments array<struct<start:long,end:long,score:double>>")


def _code_points(text: str | None, spans: list[tuple[int, int, float]]) -> list[dict]:
    raw = (text or "").encode()
    return [{"start": len(raw[:a].decode()), "end": len(raw[:b].decode()), "score": s} for a, b, s in spans]


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([shipped.value.probability(e) < threshold for _, _, e, _ in _scored(shipped, b, at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
