"""Principal components with a fixed sign."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows and columns of the blocks in which products are summed.
BLOCK = 128


def centred_sums(df: DataFrame, values: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and covariance (over n - 1) of an array column of d elements; null rows are left out.

    A task adds up the products of its rows in one square, less the first row of
    all, so that a large mean costs no digits. The squares are handed on in
    blocks, which Spark sums up by block, partition by partition; so what a row
    becomes doesn't grow with d, and the driver gets each block once.
    """
    rows = df.select(values).where(F.col(values).isNotNull())
    first = rows.first()
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    shift = np.array(first[0], np.float64)
    d, block = len(shift), BLOCK

    def run(batches):
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            column = batch.column(0)
            if (np.diff(column.offsets.to_numpy()) != d).any():
                raise ValueError(f"arrays must have {d} elements like the first one")
            x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d) - shift
            n, total = n + len(x), total + x.sum(0)
            square += x.T @ x
        if n:
            parts = [(-1, -1, np.r_[float(n), total])]
            parts += [(i, j, square[i : i + block, j : j + block].ravel()) for i in range(0, d, block) for j in range(i, d, block)]
            for i, j, v in parts:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["i", "j", "v"])

    summed = rows.mapInArrow(run, "i int, j int, v array<double>").groupBy("i", "j").agg(Summarizer.sum(array_to_vector(F.col("v"))).alias("v"))
    got = {(r.i, r.j): r.v.toArray() for r in summed.collect()}
    n, total = int(round(got[-1, -1][0])), got[-1, -1][1:]
    square = np.zeros((d, d))
    for (i, j), v in got.items():
        if i >= 0:
            part = v.reshape(min(block, d - i), min(block, d - j))
            square[i : i + block, j : j + block] = part
            square[j : j + block, i : i + block] = part.T
    cov = (square - np.outer(total, total) / n) / max(n - 1, 1)
    return n, shift + total / n, cov


def principal_components(df: DataFrame, values: str, k: int, scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread, loadings (columns) and explained percent of an array column.

    One pass of block products summed by Spark; only a square of the array's
    length reaches the driver. Without spread a column keeps the scale 1. The loading
    of greatest size in each component is positive.
    """
    n, mean, cov = centred_sums(df, values)
    if n < 3:
        raise ValueError("principal components need three rows at least")
    d = len(mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    spread[spread < 1e-12] = 1.0
    if not scale:
        spread = np.ones(d)
    lam, vec = np.linalg.eigh(cov / np.outer(spread, spread))
    order = np.argsort(lam)[::-1][:k]
    load = vec[:, order]
    load *= np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    return mean, spread, load, 100 * np.maximum(lam[order], 0) / lam.sum()


def scores(df: DataFrame, key: str, values: str, k: int, scale: bool = True) -> DataFrame:
    """key and pc1 to pck of each row."""
    mean, spread, load, _ = principal_components(df, values, k, scale)
    at = lambda j: F.aggregate(F.zip_with(values, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda a, x: F.struct((a["s"] + x * F.get(F.array(*[F.lit(float(v)) for v in load[:, j] / spread]), a["i"])).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])
    return df.select(key, *[at(j).alias(f"pc{j + 1}") for j in range(k)])


def variance(df: DataFrame, values: str, k: int, scale: bool = True) -> DataFrame:
    """Explained and cumulative percent of each component."""
    *_, percent = principal_components(df, values, k, scale)
    rows = [(i + 1, float(p), float(c)) for i, (p, c) in enumerate(zip(percent, np.cumsum(percent), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, percent double, cumulative double")


def loadings(df: DataFrame, values: str, k: int, scale: bool = True) -> DataFrame:
    """Loading of each position on each component, with the position's place from 0 to 1."""
    _, _, load, _ = principal_components(df, values, k, scale)
    last = max(1, len(load) - 1)
    rows = [(j + 1, i, i / last, float(load[i, j])) for j in range(load.shape[1]) for i in range(len(load))]
    return df.sparkSession.createDataFrame(rows, "component int, pos int, place double, loading double")
