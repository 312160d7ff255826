"""Quality classifier by positive-unlabelled learning.

Only trusted positives (labelled good) and unlabelled web text are learnt from. A first
classifier tells the two apart on one half of the training rows; on the other half, the share
of unlabelled text above a score against the share of positives above it bounds the class prior
(the best bin, with its confidence width). The final model, logistic and linear in features
of the whole text, minimises the non-negative unbiased risk

    prior * R(positives as good) + max(0, R(unlabelled as bad) - prior * R(positives as bad)),

whose value, gradient and curvature are sums over rows: each partition adds up its own, Spark
adds up the partitions, and the driver holds some thousands of numbers, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import PIECE, Scratch, table, texts, word_hashes


@dataclass(frozen=True)
class PuSpec:
    """rounds: passes over the rows for each of the two fits. ridge: weight of the squared coefficients.

    delta: chance that the width of the class prior's best bin is exceeded. cut: features are
    cut to so many standard deviations. threshold: least score of label 1.
    """

    rounds: int = 10
    ridge: float = 4e-3
    delta: float = 0.1
    bins: int = 1000
    cut: float = 6.0
    push: float = 0.5
    threshold: float = 0.7


# ---------------------------------------------------------------- features

#: Classes of bytes: small letter, capital, digit, space, line end, stop, other sign, beyond ASCII.
KINDS = 8
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[0x20, 0x09, 0x0B, 0x0C]], _KIND[[0x0A, 0x0D]] = 3, 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[128:] = 7
OF_WORDS = 6
WIDTH = 1 + OF_WORDS + KINDS * KINDS


def _kind_pairs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of the pairs of neighbouring byte classes of each text."""
    out = np.zeros((len(off) - 1, KINDS * KINDS))
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + PIECE, "right")) - 1)
        for lo in range(int(off[row]), int(off[last]), PIECE):
            kind = _KIND[data[lo : min(lo + PIECE + 1, int(off[last]))]]
            code = kind[:-1] * KINDS + kind[1:]
            at = np.searchsorted(off, lo + np.arange(len(code)), "right") - 1
            whole = lo + np.arange(1, len(code) + 1) < off[at + 1]
            key = (at[whole] - row) * KINDS * KINDS + code[whole]
            out[row:last] += np.bincount(key, minlength=(last - row) * KINDS * KINDS).reshape(-1, KINDS * KINDS)
        row = last
    return out


def _word_shape(h: np.ndarray, n_bytes: int) -> list[float]:
    """Length, share of distinct words, of repeated 3-word windows, of the most frequent word; bytes a word."""
    n = len(h)
    if not n:
        return [0.0] * OF_WORDS
    _, times = np.unique(h, return_counts=True)
    again = 0.0
    if n > 3:
        window = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]
        again = 1 - len(np.unique(window)) / len(window)
    size = np.log1p(n)
    return [size, size * size / 10, len(times) / n, again, times.max() / n, np.log(n_bytes / n)]


def features(text: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers for each text; null, empty and blank texts have the constant only (and white space)."""
    data, off = texts(text)
    out = np.zeros((len(text), WIDTH), np.float32)
    out[:, 0] = 1
    pairs = _kind_pairs(data, off)
    out[:, 1 + OF_WORDS :] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    for first, h, at in word_hashes(text):
        for i in range(len(at) - 1):
            row = first + i
            out[row, 1 : 1 + OF_WORDS] = _word_shape(h[at[i] : at[i + 1]], int(off[row + 1] - off[row]))
    return out


def _featured(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in frames:
        x = features(f.column("text"))
        off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH * 4).buffers()[1]
        packed = pa.Array.from_buffers(pa.binary(), len(x), [None, off, pa.py_buffer(np.ascontiguousarray(x))])
        yield pa.RecordBatch.from_arrays([f.column("doc_id"), f.column("held_out"), packed], ["doc_id", "held_out", "x"])


# ---------------------------------------------------------------- sums over rows


@dataclass
class Scale:
    mean: np.ndarray
    spread: np.ndarray
    cut: float

    def rows(self, x: pa.Array) -> np.ndarray:
        raw = np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(-1, WIDTH)
        out = np.clip((raw - self.mean) / self.spread, -self.cut, self.cut)
        out[:, 0] = 1
        return out


def _added(rows: DataFrame, per_frame, size: int) -> np.ndarray:
    """Sum of the vectors that ``per_frame`` makes of record batches, over all partitions."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for f in frames:
            if f.num_rows:
                total += per_frame(f)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    sums = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out


def _scale(rows: DataFrame, spec: PuSpec) -> Scale:
    def per_frame(f: pa.RecordBatch) -> np.ndarray:
        x = np.frombuffer(b"".join(f.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    n, s, q = np.split(_added(rows, per_frame, 1 + 2 * WIDTH), [1, 1 + WIDTH])
    n = max(n[0], 1.0)
    spread = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
    return Scale(s / n, np.where(spread > 1e-6, spread, 1.0), spec.cut)


@dataclass
class Part:
    """Sums over the positives or the unlabelled rows: losses as good and as bad, and their derivatives."""

    n: float
    as_good: float
    as_bad: float
    x: np.ndarray
    sx: np.ndarray
    curve: np.ndarray

    @property
    def size(self) -> float:
        return max(self.n, 1.0)


def _part_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    g = x @ w
    s = 1 / (1 + np.exp(-g))
    return np.concatenate([[len(x), np.logaddexp(0, -g).sum(), np.logaddexp(0, g).sum()], x.sum(axis=0), s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def risk_parts(rows: DataFrame, w: np.ndarray, scale: Scale) -> tuple[Part, Part]:
    """Sums over the trusted positives and over all rows (the unlabelled text), one pass."""
    size = 3 + 2 * WIDTH + WIDTH * WIDTH

    def per_frame(f: pa.RecordBatch) -> np.ndarray:
        x = scale.rows(f.column("x"))
        good = f.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate([_part_sums(x[good], w), _part_sums(x, w)])

    flat = _added(rows.select("x", "positive"), per_frame, 2 * size)
    return tuple(Part(*v[:3], v[3 : 3 + WIDTH], v[3 + WIDTH : 3 + 2 * WIDTH], v[3 + 2 * WIDTH :].reshape(WIDTH, WIDTH)) for v in np.split(flat, 2))


def _apart(p: Part, u: Part) -> tuple[float, np.ndarray, np.ndarray]:
    """Risk, gradient and curvature of telling positives from unlabelled text, both of equal weight."""
    risk = (p.as_good / p.size + u.as_bad / u.size) / 2
    return risk, ((p.sx - p.x) / p.size + u.sx / u.size) / 2, (p.curve / p.size + u.curve / u.size) / 2


def nn_risk(p: Part, u: Part, prior: float, push: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative unbiased risk with a direction and a curvature to step by.

    While the estimated risk of the bad class is not negative, these are the risk's own (the
    two positive terms of the gradient meet in -prior * x). Where it falls below zero, the
    step goes uphill on that term alone, which takes the overfitting back.
    """
    bad = u.as_bad / u.size - prior * p.as_bad / p.size
    risk = prior * p.as_good / p.size + max(0.0, bad)
    if bad >= 0:
        return risk, u.sx / u.size - prior * p.x / p.size, u.curve / u.size
    return risk, -(u.sx / u.size - prior * p.sx / p.size), np.eye(len(p.x)) / push


def minimise(rows: DataFrame, scale: Scale, spec: PuSpec, risk) -> np.ndarray:
    """Damped Newton steps on ``risk`` plus the ridge; each round is one pass over ``rows``."""
    ridge = np.full(WIDTH, spec.ridge)
    ridge[0] = 0
    w = best = np.zeros(WIDTH)
    least, damp, at_best = np.inf, 1e-4, None
    for _ in range(spec.rounds):
        value, slope, curve = risk(*risk_parts(rows, w, scale))
        value += (ridge * w * w).sum() / 2
        if value <= least + 1e-12:
            gain, least, best, at_best = least - value, value, w, (slope + ridge * w, curve)
            damp /= 4
            if gain < 1e-6 * max(1.0, abs(value)):
                break
        else:
            damp = max(damp, 1e-4) * 16
        slope, curve = at_best
        w = best - np.linalg.solve(curve + np.diag(ridge + damp), slope)
    return best


# ---------------------------------------------------------------- class prior


def class_prior(rows: DataFrame, w: np.ndarray, scale: Scale, spec: PuSpec) -> float:
    """Share of good text among the unlabelled rows: the least ratio, over scores, of the share of
    unlabelled rows above a score to that of positives, by the bin with the least upper bound."""

    def per_frame(f: pa.RecordBatch) -> np.ndarray:
        s = 1 / (1 + np.exp(-(scale.rows(f.column("x")) @ w)))
        at = np.minimum((s * spec.bins).astype(np.int64), spec.bins - 1)
        good = f.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate([np.bincount(at[good], minlength=spec.bins), np.bincount(at, minlength=spec.bins)])

    return best_bin(*np.split(_added(rows.select("x", "positive"), per_frame, 2 * spec.bins), 2), spec.delta)


def best_bin(positives: np.ndarray, unlabelled: np.ndarray, delta: float) -> float:
    """The class prior by two histograms of scores (0 without rows of either)."""
    n_p, n_u = positives.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.0
    p, u = (np.cumsum(h[::-1]) / h.sum() for h in (positives, unlabelled))
    width = np.sqrt(np.log(4 / delta) / (2 * n_p)) + np.sqrt(np.log(4 / delta) / (2 * n_u))
    some = p > 0
    bound = u[some] / p[some] + width / p[some]
    return float(np.clip(u[some][np.argmin(bound)] / p[some][np.argmin(bound)], 1e-3, 0.99))


# ---------------------------------------------------------------- the operator


@dataclass
class PuModel:
    weights: np.ndarray
    scale: Scale
    prior: float


def fit(rows: DataFrame, spec: PuSpec) -> PuModel | None:
    """The model from training rows (doc_id, x, positive); None without a positive."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    scale = _scale(rows, spec)
    apart = minimise(rows.where(half == 0), scale, spec, _apart)
    prior = class_prior(rows.where(half == 1), apart, scale, spec) or class_prior(rows, apart, scale, spec)
    if not prior:
        return None
    return PuModel(minimise(rows, scale, spec, lambda p, u: nn_risk(p, u, prior, spec.push)), scale, prior)


def quality_scores(docs: DataFrame, labels: DataFrame, spec: PuSpec = PuSpec()) -> DataFrame:
    """doc_id, held_out, score, predicted and class_prior for every row of ``docs`` (doc_id, text).

    held_out: crc32 of the id as text, modulo 4, is 2 (a null id is not); neither labels nor
    texts of these rows are learnt from. Trusted positives are training rows with a label of
    quality 1; labels of quality 0 are not used, a repeated label counts once. Null, empty or
    blank text is scored by its length of zero. Repeated rows count each. Without a positive
    every score is 0.5. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pu-quality")

    def held(doc_id):
        return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))

    rows = docs.select("doc_id", held(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInArrow(_featured, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, x binary")
    trusted = labels.where("quality = 1").where(~held(F.col("doc_id"))).select(F.col("doc_id").alias("good_id")).distinct()
    made = made.join(trusted, F.col("doc_id") == F.col("good_id"), "left")
    made = scratch.write(made.select("doc_id", "held_out", F.col("good_id").isNotNull().alias("positive"), "x"), "features")
    model = fit(made.where("not held_out"), spec)

    def score(x: pa.Array) -> pa.Array:
        if model is None or not len(x):
            return pa.array(np.full(len(x), 0.5))
        return pa.array(1 / (1 + np.exp(-(model.scale.rows(x) @ model.weights))))

    out = made.select("doc_id", "held_out", F.arrow_udf(score, "double")("x").alias("score"))
    return out.select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= spec.threshold).cast("int").alias("predicted"),
        F.lit(model.prior if model else None).cast("double").alias("class_prior"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of ``documents`` learnt from ``labels``; see ``quality_scores`` for nulls, ties and repeats."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
