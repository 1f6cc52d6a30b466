"""Dissimilarities between the windows of an iteration, at each offset."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import gather


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _mean(v: Column) -> Column:
    return _sum(v) / F.size(v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Null where a vector is constant."""
    ca, cb = F.transform(a, lambda x: x - _mean(a)), F.transform(b, lambda x: x - _mean(b))
    return cosine(ca, cb)


def hamming(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """Of the places where one isn't zero, the share where they differ; 0 if there is none."""
    some = _sum(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")))
    differ = _sum(F.zip_with(a, b, lambda x, y: ((x != y) & ((x != 0) | (y != 0))).cast("double")))
    return F.when(some == 0, 0.0).otherwise(differ / F.nullif(some, F.lit(0.0)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "cosine": cosine, "correlation": correlation, "hamming": hamming, "jaccard": jaccard}


def rdm(windows: DataFrame, trajectory: DataFrame, length: int, metric: str | Column, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """by, carry, iteration, offset, i, j, d with i < j: a self-join on (by, carry, iteration, offset), as many rows as there are pairs of drawn windows.

    by: keys of windows and trajectory (subject, session); carry: keys of the
    trajectory alone (signal). metric: a name, or a column of names for signals
    that have their own.
    """
    keys = [*by, *carry, "iteration", "offset"]
    g = gather(windows, trajectory, length, by, carry)
    a = g.select(*keys, F.col("win").alias("i"), F.col("features").alias("fa"))
    b = g.select(*keys, F.col("win").alias("j"), F.col("features").alias("fb"))
    fa, fb = F.col("fa"), F.col("fb")
    d = METRICS[metric](fa, fb) if isinstance(metric, str) else F.coalesce(*[F.when(metric == name, f(fa, fb)) for name, f in METRICS.items()])
    return a.join(b, keys).where("i < j").select(*keys, "i", "j", d.alias("d"))


def zscored(rows: DataFrame, column: str, by: tuple[str, ...]) -> DataFrame:
    """column less its mean over its population deviation (1 if that is 0) in each group."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(column).over(w)
    return rows.withColumn("z", (F.col(column) - F.avg(column).over(w)) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0)))


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    """Upper triangle of the distances of rows, in order of (i, j)."""
    i, j = np.triu_indices(len(x), 1)
    if metric == "euclidean":
        return np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    if metric in ("correlation", "cosine"):
        c = x - x.mean(1, keepdims=True) if metric == "correlation" else x
        norm = np.sqrt((c * c).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (c[i] * c[j]).sum(1) / (norm[i] * norm[j])
    differ, some = x[i] != x[j], (x[i] != 0) | (x[j] != 0)
    if metric == "hamming":
        return differ.mean(1)
    return np.where(some.any(1), (differ & some).sum(1) / np.maximum(some.sum(1), 1), 0.0)


def rdm_blocks(windows: DataFrame, trajectory: DataFrame, length: int, metric: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, iteration, offset, z: the pairs' distances as one array, z-scored; a task holds one iteration's windows."""
    g = gather(windows, trajectory, length, by)
    kinds = dict(g.dtypes)

    def run(t):  # noqa: ANN001, ANN202
        win, off = t.column("win").to_numpy(), t.column("offset").to_numpy()
        x = np.array(t.column("features").to_pylist(), float)
        out = []
        for o in range(length):
            at = np.flatnonzero(off == o)
            d = distances(x[at[np.argsort(win[at])]], metric)
            out.append((d - d.mean()) / (d.std() or 1.0))
        it = t.column("iteration")[0].as_py()
        own = {c: pa.array([t.column(c)[0].as_py()] * length, t.schema.field(c).type) for c in by}
        return pa.table({**own, "iteration": pa.array([it] * length, pa.int32()), "offset": pa.array(range(length), pa.int32()), "z": pa.array([d.tolist() for d in out], pa.list_(pa.float64()))})

    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "iteration int, offset int, z array<double>"
    return g.select(*by, F.col("iteration").cast("int"), "win", "offset", "features").groupBy(*by, "iteration").applyInArrow(run, schema)
