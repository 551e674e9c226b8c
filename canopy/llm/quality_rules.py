"""Quality rules: base limits and robust multivariate outliers.

Each text gives counts (see :func:`text_counts`) and, from those, a vector of transformed statistics.  For every language
and source a minimum-covariance-determinant estimate of centre and spread is fitted on all its documents that pass the
base limits.  Three starts compete: the medians with median deviations, with the covariance of spatial signs, and with the
floors alone.  From each, concentration steps keep the ``SHARE`` of the rows with the least Mahalanobis distance and
estimate again; the start whose covariance ends with the least determinant wins, and a reweighted step uses every row
within its 0.975 quantile.  A document is rejected when its squared distance exceeds the quantile of chi-square that a
share ``TAIL`` of normal documents would pass.

Every step is a pair of aggregations by group and start with map-side combination (a mergeable quantile sketch, then
moments), so a source with a third of all rows is no more work for one task than any other.  Estimates travel as a table,
one row for each group; a spread has a floor in each direction (``FLOORS``), since most clean texts have no symbols at
all.  Small groups lean on wider ones: the estimate of n rows has weight n / (n + ``PRIOR``) against that of its language,
and this one likewise against that of all documents; the wider ones are merged from the moments of the groups.

Defined results: a null text is empty and fails the base limits; null languages and sources are groups of their own; rows
that repeat an id are judged one by one; an empty table gives an empty result; columns of ``documents`` other than the
text, id, language and source pass through if named in ``keep``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.near_dedup import split_by_id
from canopy.llm.words import Rolling, WordMemo, bounded_batches, hashed, mixed, slices, trimmed, utf8
from canopy.plans.materialize import scratch, stage_table

#: What counts as a symbol, the least words, the largest percentage of repeated words.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 20, 30
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_stutter")
STATS = ("mean_length", "symbols", "dup_lines", "repeats", "upper", "stutter")
#: Least standard deviation of each statistic.
FLOORS = (0.25, 0.06, 0.12, 0.10, 0.05, 0.08)
#: Share of normal documents beyond the cutoff: quantile 45 of chi-square with six degrees.
TAIL = 4.7e-8
#: Share of the rows that concentration keeps; quantile of the reweighted step; concentration steps; weight of a wider estimate in rows.
SHARE, WITHIN, STEPS, PRIOR = 0.75, 0.975, 3, 50
_SLICE = 1 << 20


def _without(text: bytes, these: bytes) -> int:
    return len(text.translate(None, these))


def _counts(texts: list[bytes], memo: WordMemo, rolling: Rolling) -> list[np.ndarray]:
    words = [x.split() for x in texts]
    h, starts = hashed(words, memo)
    sizes = np.diff(starts)
    own = np.repeat(np.arange(len(texts)), sizes)
    left = starts[1:][own] - np.arange(len(h))
    at = np.flatnonzero(left >= _WINDOW)
    repeated = np.zeros(len(texts), np.int64)
    if len(at):
        keys = mixed(rolling.windows(rolling.prefix(h), at, _WINDOW) ^ (own[at].astype(np.uint64) << np.uint64(40)))
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        edge = np.zeros(len(h) + 1, np.int32)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + _WINDOW, -1)
        repeated = np.bincount(own[np.cumsum(edge[:-1]) > 0], minlength=len(texts))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    stutter = np.bincount(own[again], minlength=len(texts))
    rest = []
    for text in texts:
        lines = [x for x in text.split(b"\n") if x.strip()]
        letters = len(text) - _without(text, _LETTERS)
        rest.append((_without(text, _SPACE + _CONTINUATION), len(text) - _without(text, SYMBOLS), len(lines) - len(set(lines)), len(text) - _without(text, _UPPER), letters, len(lines)))
    chars, symbols, lines, upper, letters, n_lines = np.array(rest, np.int64).reshape(-1, 6).T
    return [sizes, chars, symbols, lines, repeated, upper, letters, n_lines, stutter]


def text_counts(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and ``COUNTS`` for each row of ``documents``, over whole texts."""
    names = list(dict.fromkeys(keep))
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rolling = WordMemo(), Rolling()
        for batch in batches:
            texts = utf8(batch.column(0))
            for low, high in slices(texts, _SLICE):
                kept = [batch.column(1 + k).slice(low, high - low) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x.astype(np.int64)) for x in _counts(texts[low:high], memo, rolling))], names=[*names, *COUNTS])

    # The text is read under a name of its own, so that it may be among the kept columns.
    source = documents.select(F.col("text").alias("__text"), *names)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*names).schema)
    return source.mapInArrow(trimmed(run), schema + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _statistics() -> list[Column]:
    """Transformed statistics: lengths shrunk towards a usual one for short texts, roots of shares."""
    words = F.col("n_words").cast("double")
    return [
        (F.col("word_chars") + 50 * 5.5) / (words + 50),
        F.sqrt(F.col("n_symbols") / (words + 10)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 3.0)),
        F.sqrt(F.col("n_repeat_words") / (words + 10)),
        F.asin(F.sqrt(F.col("n_upper") / (F.col("n_letters") + 10.0))),
        F.sqrt(F.col("n_stutter") / (words + 10)),
    ]


def _group(lang: str, source: str) -> Column:
    """One text for a language and source; the separator can't be mistaken, as lengths are given."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.concat_ws("|", part(lang), part(source))


_P = len(STATS)
_CROSS = [(i, j) for i in range(_P) for j in range(i, _P)]


def _distance() -> Column:
    """Squared Mahalanobis distance of x under the row's centre and precision (upper triangle)."""
    away = [F.col(STATS[i]) - F.col("centre")[i] for i in range(_P)]
    terms = [(1 if i == j else 2) * away[i] * away[j] * F.col("precision")[k] for k, (i, j) in enumerate(_CROSS)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def chi_square(x: float, degrees: int) -> float:
    """Share of a chi-square variable with an even number of degrees of freedom that is at most ``x``."""
    term, total = 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


def consistency(share: float, degrees: int = _P) -> float:
    """What the covariance of the nearest ``share`` of normal rows is to be multiplied by."""
    return share / chi_square(chi_square_quantile(share, degrees), degrees + 2)


_FIT = "grp string, start int, n long, centre array<double>, cov array<double>, precision array<double>, logdet double"
_FIT_SCHEMA = pa.schema([("grp", pa.string()), ("start", pa.int32()), ("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("centre", "cov", "precision")), ("logdet", pa.float64())])


def _square(upper: Sequence[float]) -> np.ndarray:
    out = np.zeros((_P, _P))
    for value, (i, j) in zip(upper, _CROSS, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _upper(square: np.ndarray) -> list[float]:
    return [float(square[i, j]) for i, j in _CROSS]


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres, covariances and precisions from sums and products, with the floors added to the variances."""
    floor = np.diag(np.square(FLOORS))
    for batch in batches:
        rows = []
        for group, start, n, sums, products, scale in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            centre = np.array(sums) / n
            cov = (_square(products) / n - np.outer(centre, centre)) * scale
            inverse = np.linalg.inv(cov + floor)
            rows.append((group, start, n, centre.tolist(), _upper(cov), _upper(inverse), float(np.linalg.slogdet(cov + floor)[1])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FIT_SCHEMA, strict=True)], schema=_FIT_SCHEMA)


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    sums = F.array(*[F.sum(s) for s in STATS])
    products = F.array(*[F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i, j in _CROSS])
    return rows.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"), products.alias("products")).withColumn("scale", F.lit(scale)).mapInArrow(trimmed(_estimates), _FIT)


def _starts(rows: DataFrame) -> DataFrame:
    """Three centres and precisions for each value of ``grp``; only their shapes count, as steps rank the rows."""
    medians = stage_table(rows.groupBy("grp").agg(*[F.percentile_approx(s, 0.5, 1000).cast("double").alias(f"m{i}") for i, s in enumerate(STATS)]), narrow=True)
    away = rows.join(medians, "grp").select("grp", *[(F.col(s) - F.col(f"m{i}")).alias(f"a{i}") for i, s in enumerate(STATS)])
    spread = [F.sqrt(F.pow(1.4826 * F.percentile_approx(F.abs(f"a{i}"), 0.5, 1000), 2) + FLOORS[i] ** 2).alias(f"d{i}") for i in range(_P)]
    scales = stage_table(medians.join(away.groupBy("grp").agg(*spread), "grp"), narrow=True)
    signs = away.join(scales.select("grp", *[f"d{i}" for i in range(_P)]), "grp").select("grp", *[(F.col(f"a{i}") / F.col(f"d{i}")).alias(f"u{i}") for i in range(_P)])
    length = sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(_P)), F.lit(0.0))
    signs = signs.withColumn("length", length).where("length > 0")
    signs = signs.groupBy("grp").agg(F.array(*[F.avg(F.col(f"u{i}") * F.col(f"u{j}") / F.col("length")) for i, j in _CROSS]).alias("signs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.array(FLOORS)
        for batch in batches:
            rows = []
            for group, centre, scale, sign in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                spread = np.array(scale)
                signed = np.eye(_P) / _P if sign is None else _square(sign)
                shapes = (np.diag(spread**2), np.outer(spread, spread) * (signed + np.eye(_P) / (20 * _P)), np.diag(floors**2))
                rows += [(group, k, 0, centre, _upper(shape), _upper(np.linalg.inv(shape)), 0.0) for k, shape in enumerate(shapes)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FIT_SCHEMA, strict=True)], schema=_FIT_SCHEMA)

    every = lambda c: F.array(*[F.col(f"{c}{i}") for i in range(_P)])
    return scales.join(signs, "grp", "left").select("grp", every("m"), every("d"), "signs").mapInArrow(trimmed(run), _FIT)


def mcd_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``grp, n, centre, cov`` for each value of ``grp`` from the columns ``STATS`` of all rows."""
    fit = stage_table(_starts(rows).select("grp", "start", "centre", "precision"), narrow=True)
    for step in range(steps):
        near = rows.join(fit, "grp").withColumn("d2", _distance())
        limit = stage_table(near.groupBy("grp", "start").agg(F.percentile_approx("d2", SHARE, 1000).alias("limit")), narrow=True)
        fit = _moments(near.join(limit, ["grp", "start"]).where("d2 <= limit"), consistency(SHARE))
        if step == steps - 1:
            best = fit.groupBy("grp").agg(F.min(F.struct("logdet", "start", "centre", "precision")).alias("best"))
            fit = best.select("grp", "best.start", "best.centre", "best.precision")
        fit = stage_table(fit.select("grp", "start", "centre", "precision"), narrow=True)
    near = rows.join(fit, "grp").withColumn("d2", _distance())
    return stage_table(_moments(near.where(F.col("d2") <= chi_square_quantile(WITHIN, _P)), consistency(WITHIN)).select("grp", "n", "centre", "cov"), narrow=True)


def _merged(fits: DataFrame, by: list[str]) -> DataFrame:
    """``n, centre, cov`` of the union of groups, from their moments."""
    n = F.col("n")
    sums = F.array(*[F.sum(n * F.col("centre")[i]) for i in range(_P)])
    products = F.array(*[F.sum(n * (F.col("cov")[k] + F.col("centre")[i] * F.col("centre")[j])) for k, (i, j) in enumerate(_CROSS)])
    total = fits.groupBy(*by).agg(F.sum("n").alias("n"), sums.alias("sums"), products.alias("products"))
    centre = F.transform("sums", lambda x: x / n)
    cov = F.array(*[F.col("products")[k] / n - F.col("sums")[i] / n * F.col("sums")[j] / n for k, (i, j) in enumerate(_CROSS)])
    return total.select(*by, "n", centre.alias("centre"), cov.alias("cov"))


def _leaning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's estimate drawn towards that of its language, and this one towards that of all."""
    floor = np.diag(np.square(FLOORS))

    def drawn(n, own, wider):
        weight = n / (n + PRIOR)
        return tuple(weight * x + (1 - weight) * y for x, y in zip(own, wider, strict=True))

    for batch in batches:
        rows: dict[str, list] = {"own": [], "centre": [], "precision": []}
        for x in batch.to_pylist():
            whole, wide, own = ((np.array(x[f"centre{k}"]), _square(x[f"cov{k}"])) if x[f"n{k}"] else None for k in ("_all", "_wide", "_own"))
            wide = drawn(x["n_wide"], wide, whole) if wide else whole
            centre, cov = drawn(x["n_own"], own, wide) if own else wide
            rows["own"].append(x["own"])
            rows["centre"].append(centre.tolist())
            rows["precision"].append(_upper(np.linalg.inv(cov + floor)))
        kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def fits_by_group(passing: DataFrame) -> DataFrame:
    """``own, centre, precision`` for each group of ``passing(own, wide, STATS)``."""
    with scratch() as keep:
        groups = stage_table(passing.select("own", "wide").distinct(), narrow=True)
        fits = groups.join(mcd_estimates(passing.select(F.col("own").alias("grp"), *STATS)).withColumnRenamed("grp", "own"), "own")
        fits = stage_table(fits, narrow=True)
        named = lambda frame, k: frame.select(*[c for c in ("own", "wide") if c in frame.columns], *[F.col(c).alias(f"{c}{k}") for c in ("n", "centre", "cov")])
        wide, whole = stage_table(_merged(fits, ["wide"]), narrow=True), stage_table(_merged(fits, []).where("n > 0"), narrow=True)
        every = groups.join(named(fits.drop("wide"), "_own"), "own", "left").join(named(wide, "_wide"), "wide", "left").join(F.broadcast(named(whole, "_all")), F.lit(True))
        return keep(stage_table(every.mapInArrow(trimmed(_leaning), "own string, centre array<double>, precision array<double>"), narrow=True))


def _described(counted: DataFrame) -> DataFrame:
    """Counts with the base verdict, the statistics and the groups."""
    wide = F.concat(F.lit("lang "), F.coalesce(F.concat(F.lit(":"), F.col("__lang").cast("string")), F.lit("-")))
    return counted.withColumns({"base_failed": base_failed(), "own": _group("__lang", "__source"), "wide": wide} | dict(zip(STATS, _statistics(), strict=True)))


def _verdicts(counted: DataFrame, fits: DataFrame, tail: float) -> DataFrame:
    """``counted`` with ``distance`` and ``kept``."""
    judged = counted.join(fits, "own", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square_quantile(1 - tail, _P)))


def _counted(documents: DataFrame, names: Sequence[str]) -> DataFrame:
    """Described counts of ``documents`` with the columns ``names`` as ``__k_<name>``."""
    own = ["lang AS __lang", "source AS __source"]
    return _described(text_counts(documents.selectExpr("text AS text", *own, *[f"`{c}` AS `__k_{c}`" for c in names]), ["__lang", "__source", *[f"__k_{c}" for c in names]]))


def judge(documents: DataFrame, keep: Sequence[str] = (), tail: float = TAIL) -> DataFrame:
    """``keep``, ``COUNTS``, ``base_failed``, ``distance`` (null where the base limits fail) and ``kept``.

    Rows are staged with what is to be kept of them; :func:`kept_rows` is for wide columns such as the text itself.
    """
    names = list(dict.fromkeys([*keep]))
    counted = stage_table(_counted(documents, names))
    judged = _verdicts(counted, fits_by_group(counted.where("NOT base_failed").select("own", "wide", *STATS)), tail)
    return judged.select(*[F.col(f"__k_{c}").alias(c) for c in names], *[F.col(c) for c in COUNTS if c not in names], "base_failed", "distance", "kept")


def kept_rows(documents: DataFrame, keep: Sequence[str] = (), tail: float = TAIL) -> DataFrame:
    """The columns ``keep`` of the rows that :func:`judge` keeps, for wide columns such as the text itself.

    A verdict follows from text, language and source, so a first reading notes a key of these for each rejected row in a
    Bloom filter.  Rows whose key it surely doesn't hold stay, and of them only keys pass Python; the others are counted
    and judged once more, so neither the filter nor equal keys of different rows change a verdict.  They are staged before,
    as else each task would hold two Python workers.
    """
    names = list(dict.fromkeys([*keep]))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), _group("lang", "source"))
    with scratch() as hold:
        light = stage_table(_counted(documents.select("text", "lang", "source", key.alias("key")), ["key"]).select("base_failed", "own", "wide", F.col("__k_key").alias("key"), *STATS))
        fits = hold(fits_by_group(light.where("NOT base_failed").select("own", "wide", *STATS)))
        rejected = stage_table(_verdicts(light, fits, tail).where("NOT kept").select("key").distinct(), narrow=True)
        rows = documents.select(*dict.fromkeys(["text", "lang", "source", *names]), key.alias("__verdict_key"))
        sure, maybe = split_by_id(rows, "__verdict_key", rejected, rejected.count())
    again = _verdicts(_counted(stage_table(maybe.drop("__verdict_key")), names), fits, tail).where("kept").select(*[F.col(f"__k_{c}").alias(c) for c in names])
    return sure.select(*[F.col(f"`{c}`") for c in names]).unionByName(again)


def document_verdicts(documents: DataFrame) -> DataFrame:
    """The verdict on every document with the counts behind it."""
    return judge(documents, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
