"""Quality scores learnt from preference pairs (Bradley-Terry).

A document has a feature vector x of transformed counts of its whole text.  Of two documents, i is preferred to j with
probability sigma(w . (x_i - x_j)).  Weights minimise the logistic loss over pairs of a good and a bad labelled document,
plus a quadratic penalty, by Newton steps.  Pairs fix scores only up to a shift: the threshold is the quantile of the
labelled documents' scores at the share of bad ones, and a published score is sigma of the distance from it.

Learning uses every labelled document that may be learnt from, and the loss runs over all pairs of a good and a bad one.
Their number is the product of the classes, but a pair's loss depends on the difference of two scores alone: each Newton
step sums, by class and bin of scores, products of features and powers of the distance from the bin's centre, and Taylor
series of the logistic function at the distances of bins give the gradient over all pairs.  So a step is one reading of
the labelled vectors.  Every document is scored, whole.

Defined results: a null text is empty and scored as such; null labels and labels without a document don't count; a
document whose labels differ counts as good if at least half of them are; without labels of both classes every score is
0.5; repeated rows have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from numpy.polynomial import Polynomial
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.quality_rules import _counts, _without
from canopy.llm.words import Rolling, WordMemo, bounded_batches, slices, utf8
from canopy.plans.materialize import scratch, stage_table

PENALTY = 1e-3
#: Bins of scores and length of series: a distance in a pair of bins is off by 0.25 at most, and (0.25 / pi) ** 12 < 1e-13.
_WIDTH, _ORDER = 0.25, 12
_BINS, _ROWS = 4096, 2000
_DIGITS = bytes(range(48, 58))
FEATURES = ("length", "mean_length", "symbols", "dup_lines", "repeats", "upper", "stutter", "bangs", "bars", "digits", "lines", "very_short")
_SLICE = 1 << 20


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def features(texts: list[bytes], memo: WordMemo, rolling: Rolling) -> np.ndarray:
    """``FEATURES`` of each text, from text alone."""
    words, chars, symbols, dup_lines, repeats, upper, letters, lines, stutter = (x.astype(float) for x in _counts(texts, memo, rolling))
    bangs = np.array([t.count(b"!") for t in texts], float)
    bars = np.array([t.count(b"|") for t in texts], float)
    digits = np.array([len(t) - _without(t, _DIGITS) for t in texts], float)
    each = words + 10
    return np.stack(
        [
            np.log1p(words), (chars + 50 * 5.5) / (words + 50), np.sqrt(symbols / each), np.sqrt(dup_lines / (lines + 3)), np.sqrt(repeats / each), np.arcsin(np.sqrt(upper / (letters + 10))),
            np.sqrt(stutter / each), np.sqrt(bangs / each), np.sqrt(bars / each), np.sqrt(digits / (chars + 50)), np.sqrt(lines / each), (words < 20).astype(float),
        ],
        axis=1,
    )


class PairwiseRanker:
    """``weights`` on standardised features, the ``threshold`` and the standardisation."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float) -> None:
        self.centre, self.spread, self.weights, self.threshold = centre, spread, weights, threshold

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def _sums(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all ``rows`` by class and bin.  ``parts`` gives each row's bin and summands; tasks return one row a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            good, vectors = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            for low in range(0, len(good), _ROWS):
                own = good[low : low + _ROWS]
                bins, values = parts(own, vectors[low : low + _ROWS])
                order = np.lexsort((bins, own))
                own, bins = own[order], bins[order]
                first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (bins[1:] != bins[:-1])])
                for key, x in zip(zip(own[first].tolist(), bins[first].tolist(), strict=True), np.add.reduceat(values[order], first, axis=0), strict=True):
                    total[key] = total[key] + x if key in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["good", "bin", "sums"])

    out: dict[tuple[int, int], np.ndarray] = {}
    for key, x in sorted(((r["good"], r["bin"]), r["sums"]) for r in rows.mapInArrow(run, "good int, bin long, sums array<double>").collect()):
        out[key] = out[key] + np.array(x) if key in out else np.array(x)
    return out


def _moments(model: PairwiseRanker) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A row's bin of scores; of (1, z) the products with powers of the distance u from the bin's centre, and z z'."""

    def parts(good: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = model.scaled(x)
        raw = z @ model.weights
        bins = np.rint(raw / _WIDTH).astype(np.int64)
        powers = (raw - bins * _WIDTH)[:, None] ** np.arange(_ORDER)
        with_one = np.c_[np.ones(len(z)), z]
        return bins, np.c_[(powers[:, :, None] * with_one[:, None, :]).reshape(len(z), -1), (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)]

    return parts


def _logistic_series(x: np.ndarray) -> np.ndarray:
    """Taylor coefficients of 1 / (1 + exp(x)) at each ``x``: the derivative is a polynomial in the value p."""
    p = 1 / (1 + np.exp(np.clip(x, -700, 700)))
    term, out, factorial = Polynomial([0.0, 1.0]), [], 1.0
    for k in range(_ORDER):
        out.append(term(p) / factorial)
        term, factorial = term.deriv() * Polynomial([0.0, -1.0, 1.0]), factorial * (k + 1)
    return np.stack(out)


def _loss_slopes(sums: dict[tuple[int, int], np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss over all pairs of a good and a bad row, from sums by bin of scores.

    The series are cut where they are below 1e-13; curvature takes a bin's scores as its centre, which only steers steps.
    """
    size = _ORDER * (1 + dim)
    bins = [np.array([b for g, b in sums if g == k], float) for k in (1, 0)]
    both = [np.stack([x for (g, _), x in sums.items() if g == k]) for k in (1, 0)]
    good, bad = (x[:, :size].reshape(-1, _ORDER, 1 + dim) for x in both)
    bad = bad * ((-1.0) ** np.arange(_ORDER))[:, None]
    series = _logistic_series((bins[0][:, None] - bins[1][None, :]) * _WIDTH)
    pairs = good[:, 0, 0].sum() * bad[:, 0, 0].sum()
    gradient = np.zeros(dim)
    for k in range(_ORDER):
        for m in range(k + 1):
            by = series[k] * comb(k, m)
            gradient += (good[:, m, 0] @ by) @ bad[:, k - m, 1:] - (by @ bad[:, k - m, 0]) @ good[:, m, 1:]
    steep = -series[1]
    squares = [x[:, size:].reshape(-1, dim, dim) for x in both]
    cross = good[:, 0, 1:].T @ steep @ bad[:, 0, 1:]
    hessian = np.tensordot(steep @ bad[:, 0, 0], squares[0], 1) + np.tensordot(good[:, 0, 0] @ steep, squares[1], 1) - cross - cross.T
    return gradient / pairs, hessian / pairs


def _threshold(rows: DataFrame, model: PairwiseRanker, n_bad: int) -> float:
    """The middle of the gap after the ``n_bad`` lowest scores of all ``rows``: counts by bin narrow it down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))))], names=["raw"])

    raw = rows.mapInArrow(run, "raw double")
    low, high = (float(x) for x in raw.agg(F.min("raw"), F.max("raw")).first())
    for _ in range(4):
        if high - low <= 1e-10:
            break
        below = raw.where(F.col("raw") < low).count()
        width = (high - low) / _BINS
        at = F.least(F.floor((F.col("raw") - low) / width), F.lit(_BINS - 1))
        counts = dict(raw.where((F.col("raw") >= low) & (F.col("raw") <= high)).groupBy(at.alias("at")).count().collect())
        for k in sorted(counts):
            if below + counts[k] >= n_bad:
                break
            below += counts[k]
        # A little wider than the bin, as its edges are rounded.
        low, high = low + width * (k - 0.01), low + width * (k + 1.01)
    last, n, following = raw.agg(F.max(F.when(F.col("raw") <= high, F.col("raw"))), F.count(F.when(F.col("raw") <= high, 1)), F.min(F.when(F.col("raw") > high, F.col("raw")))).first()
    return float(last) if n > n_bad or following is None else (float(last) + float(following)) / 2


def fit(rows: DataFrame, penalty: float = PENALTY) -> PairwiseRanker:
    """A ranker from all ``rows`` (``good, x``) and all pairs of a good and a bad one."""
    dim = len(FEATURES)
    counted = _sums(rows, lambda good, x: (np.zeros(len(x), np.int64), np.c_[np.ones(len(x)), x]))
    total = sum(counted.values(), np.zeros(1 + dim))
    n = max(1.0, total[0])
    centre = total[1:] / n
    spread = np.sqrt(sum(_sums(rows, lambda good, x: (np.zeros(len(x), np.int64), (x - centre) ** 2)).values(), np.zeros(dim)) / n) + 1e-6
    model = PairwiseRanker(centre, spread, np.zeros(dim), 0.0)
    if len(counted) < 2:
        return model
    for _ in range(40):
        gradient, hessian = _loss_slopes(_sums(rows, _moments(model)), dim)
        step = np.linalg.solve(hessian + penalty * np.eye(dim), gradient + penalty * model.weights)
        model.weights = model.weights - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model.threshold = _threshold(rows, model, int(counted[0, 0][0]))
    return model


def labelled_features(documents: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """``good, x`` of every labelled document among the rows where ``may_learn`` holds.  Ids and vectors move, texts don't."""
    bounded_batches(documents.sparkSession)
    marked = labels.where(may_learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    texts = documents.where(may_learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rolling = WordMemo(), Rolling()
        for batch in batches:
            own = utf8(batch.column(1))
            for low, high in slices(own, _SLICE):
                x = features(own[low:high], memo, rolling)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return texts.mapInArrow(run, "doc_id long, x array<double>").join(marked, "doc_id").select("good", "x")


def train_on(documents: DataFrame, labels: DataFrame, may_learn: Column) -> PairwiseRanker:
    """A ranker from every labelled document among the rows where ``may_learn`` holds."""
    with scratch():
        return fit(stage_table(labelled_features(documents, labels, may_learn)))


def score(documents: DataFrame, model: PairwiseRanker, is_held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``documents``."""
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rolling = WordMemo(), Rolling()
        for batch in batches:
            texts = utf8(batch.column(2))
            for low, high in slices(texts, _SLICE):
                s = sent.value.score(features(texts[low:high], memo, rolling))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in (0, 1)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (held_out() if is_held_out is None else is_held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
