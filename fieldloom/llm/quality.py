"""Quality classifier: random Fourier features over document statistics.

Statistics of each whole text (character classes, word shapes, repetition) are
standardised and mapped to cosines that approximate a Gaussian kernel. Ridge
weights come from normal equations that partitions sum; an isotonic curve,
fitted on scores from the other half of the training rows, makes the score a
probability.

The fit uses at most TRAIN_ROWS labelled rows (chosen by a hash of the id);
everything else covers all rows. Defined results: null text counts as empty and
is scored as an empty text; without any labelled row each score is 0.5; of
several labels of one document the largest counts; of several rows of one id
the fit takes the one of least statistics; repeated rows are each scored; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, keep_where, mix64, prefix_hashes, release, rows_of, span_hashes, stage_table, text_bytes, texts_of, trim

TRAIN_ROWS = 40_000
FEATURES = 384
RIDGE = 3.0
WIDTH = 6.0
SEED = 20260101
#: Partitions that sum normal equations; the training rows are bounded, so this needs no more.
FIT_PARTITIONS = 12

_PUNCT, _SYMBOL = b".,;:'\"-()?", b"!#$%&*+/<=>@[\\]^_`{|}~"


def _class_table() -> np.ndarray:
    """Byte classes: 0 other control, 1 blank, 2 newline, 3 lower, 4 upper, 5 digit, 6 punctuation, 7 symbol, 8 beyond ASCII."""
    t = np.zeros(256, np.uint8)
    t[list(b" \t\x0b\x0c\r")], t[10] = 1, 2
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 3, 4, 5
    t[list(_PUNCT)], t[list(_SYMBOL)], t[128:] = 6, 7, 8
    return t


CLASSES = _class_table()
N_STATISTICS = 22


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATISTICS numbers for each text of a block of concatenated UTF-8 bytes."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    cls = CLASSES[data]
    hist = np.bincount(doc * 9 + cls, minlength=9 * n).reshape(n, 9).astype(float)
    letters = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256) if n else np.zeros((0, 256))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = letters / np.maximum(sizes, 1)[:, None]
        entropy = -np.where(p > 0, p * np.log2(p), 0).sum(1)
    # Words: runs of anything but white space, never across texts.
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = (cls == 1) | (cls == 2)
    first = ~gap[:-1]
    first[1:] &= gap[:-2] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    end_at = np.flatnonzero(~gap[:-1] & (gap[1:] | cut[1:])) + 1
    wdoc, wlen = doc[start] if len(start) else np.zeros(0, np.int64), (end_at - start).astype(float)
    words = np.bincount(wdoc, minlength=n).astype(float)
    per_word = lambda v: np.bincount(wdoc, weights=v, minlength=n) / np.maximum(words, 1)
    mean = per_word(wlen)
    spread = np.sqrt(np.maximum(per_word(wlen * wlen) - mean * mean, 0))
    h = mix64(span_hashes(prefix_hashes(data), start, end_at)) if len(start) else np.zeros(0, np.uint64)
    same = np.zeros(len(h))
    pair = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        near = wdoc[1:] == wdoc[:-1]
        same[1:] = near & (h[1:] == h[:-1])
        pair[1:] = np.where(near, mix64(h[1:] + h[:-1] * np.uint64(3)), h[1:])

    def distinct(x):
        key = np.sort((wdoc.astype(np.uint64) << np.uint64(40)) | (x >> np.uint64(24)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(words, 1)

    last = cls[end_at - 1] if len(start) else cls[:0]
    lead = cls[start] if len(start) else cls[:0]
    alpha = np.maximum(hist[:, 3] + hist[:, 4], 1)
    total = np.maximum(sizes, 1)
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), mean, spread,
        hist[:, 4] / alpha, hist[:, 5] / total, hist[:, 6] / total, hist[:, 7] / total, hist[:, 8] / total, hist[:, 0] / total,
        hist[:, 1] / total, np.log1p(sizes / (hist[:, 2] + 1)), entropy,
        distinct(h), per_word(same), distinct(pair),
        per_word((lead == 4).astype(float)), per_word((last == 7).astype(float)), per_word((last == 6).astype(float)), per_word(((lead == 7) | (lead == 5)).astype(float)),
        letters[:, ord("!")] / total, letters[:, ord("|")] / total,
    ])


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the isotonic curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(fourier(stats, self.mean, self.scale) @ self.weights, self.knots, self.values), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cosines of random projections; their inner products approximate exp(-|x-y|^2 / (2 WIDTH^2))."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(stats.shape[1], FEATURES)) / WIDTH
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -5, 5)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones(len(x))])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares fit, by pooling adjacent violators."""
    at, lot = np.unique(scores, return_inverse=True)  # equal scores are one step
    blocks: list[list[float]] = []
    for s, y, n in zip(at.tolist(), np.bincount(lot, weights=labels, minlength=len(at)).tolist(), np.bincount(lot, minlength=len(at)).tolist(), strict=True):
        blocks.append([s, s, y, float(n)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0], a[1], blocks[-1][2] + a[2], blocks[-1][3] + a[3]]
    # Each block is a step; half a count of either label at its ends keeps scores off 0 and 1 and the curve rising within it.
    x, v = [], []
    for lo, hi, y, n in blocks:
        p = (y + 0.5) / (n + 1)
        x += [lo, hi] if hi > lo else [lo]
        v += [p, p] if hi > lo else [p]
    v = np.maximum.accumulate(np.array(v))
    x = np.array(x)
    return x, v + 1e-6 * np.arange(len(x)) / max(1, len(x))


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in rows_of(batch):
            yield part, statistics(*text_bytes(part.column(part.schema.get_field_index("text"))))
        trim()


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of the bounded sample of labelled ids whose crc32 remainder isn't left out; an id that documents repeats comes as often."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % modulus != left_out))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    sample = F.broadcast(bounded_sample(own, "doc_id", bound))
    return texts_of(docs, "doc_id").join(sample, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, left_out: int = 1, bound: int = TRAIN_ROWS) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod modulus isn't left_out."""
    spark = docs.sparkSession

    def measure(batches):
        for part, stats in _stats_of(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    measured = training_rows(docs, labels, "quality", modulus, left_out, bound).mapInArrow(measure, "doc_id long, y double, x array<double>")
    # One row of each id, the least, so that the bound on ids bounds the rows.
    train = stage_table(measured.repartition(FIT_PARTITIONS, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")), "quality")
    parts = [F.col("x")[i] for i in range(N_STATISTICS)]
    row = train.agg(F.count("*"), *[F.avg(c) for c in parts], *[F.stddev_pop(c) for c in parts]).first()
    if not row[0]:
        release(spark, train)
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, scale = np.array(row[1 : N_STATISTICS + 1], float), np.array(row[N_STATISTICS + 1 :], float)
    scale[scale < 1e-9] = 1.0

    def halves(part):
        x = np.vstack(part.column(2).to_pylist()) if len(part) else np.zeros((0, N_STATISTICS))
        return fourier(x, mean, scale), np.asarray(part.column(1)), (mix64(np.asarray(part.column(0)).astype(np.uint64)) & np.uint64(1)).astype(int)

    def equations(batches):
        sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for part in batches:
            z, y, half = halves(part)
            for k in (0, 1):
                own = z[half == k]
                sums[k] += own.T @ np.column_stack([own, y[half == k]])
        rows = sums.reshape(-1, FEATURES + 2)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "v"])

    def add(key, frame):
        import pandas as pd

        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.vstack(frame["v"]), axis=0)]})

    summed = train.mapInArrow(equations, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    got = np.zeros((2 * (FEATURES + 1), FEATURES + 2))
    for i, v in summed.collect():  # FEATURES decides the size
        got[i] = v
    got = got.reshape(2, FEATURES + 1, FEATURES + 2)
    solve = lambda s: np.linalg.solve(s[:, :-1] + RIDGE * np.diag([1.0] * FEATURES + [1e-6]) / 10, s[:, -1])
    each, whole = [solve(got[1]), solve(got[0])], solve(got[0] + got[1])

    def cross(batches):
        for part in batches:
            z, y, half = halves(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(half == 0, z @ each[0], z @ each[1])), pa.array(y)], names=["s", "y"])

    pairs = np.array(train.mapInArrow(cross, "s double, y double").collect())  # at most TRAIN_ROWS
    release(spark, train)
    return Model(mean, scale, whole, *isotonic(pairs[:, 0], pairs[:, 1]))


def score_documents(docs: DataFrame, model: Model, modulus: int = 3, left_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches):
        for part, stats in _stats_of(batches):
            score = model.score(stats)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = texts_of(docs, "doc_id").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == left_out, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, whatever their names; a null text counts as empty, repeated rows are each decided."""
    return keep_where(docs, lambda texts: pa.array(model.score(statistics(*text_bytes(texts))) >= 0.5))
