"""Group statistics: means, t values, cluster permutation, bootstrap, decoding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import t_quantile
from ..functions.scalar import hash_uniform


def mean_sem(rows: DataFrame, by: tuple[str, ...], value: str = "r") -> DataFrame:
    """n, mean and standard error; the error is 0 for fewer than two."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))), F.lit(0.0)).alias("sem"))


def t_value(value: Column) -> Column:
    """Of an aggregate: mean over its standard error; 0 if that is 0."""
    return F.coalesce(F.avg(value) / F.nullif(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)), F.lit(0.0))


def t_map(rows: DataFrame, by: tuple[str, ...], value: str = "r") -> DataFrame:
    return rows.groupBy(*by).agg(t_value(F.col(value)).alias("t"))


def t_critical(alpha: float, n: int) -> float:
    return abs(t_quantile(1 - alpha / 2, n - 1))


def clusters(curve: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """first, last, mass of the runs of lags whose t exceeds the threshold; positive and negative runs are apart."""
    rows = curve.where(F.abs("t") > threshold).withColumn("sign", F.signum("t").cast("int"))
    w = Window.partitionBy(*by, "sign").orderBy("lag")
    rows = rows.withColumn("run", F.col("lag") - F.row_number().over(w))
    return rows.groupBy(*by, "sign", "run").agg(F.min("lag").alias("first"), F.max("lag").alias("last"), F.sum("t").alias("mass")).drop("run")


def sign_flips(subjects: DataFrame, permutations: int, seed: int) -> DataFrame:
    """perm, subject, flip (1 or -1), made of a hash."""
    perms = subjects.select("subject", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    return perms.select("perm", "subject", F.when(hash_uniform(F.lit(seed), F.col("perm"), F.col("subject")) < 0.5, -1.0).otherwise(1.0).alias("flip"))


def cluster_permutation(rows: DataFrame, threshold: float, permutations: int, alpha: float, seed: int) -> DataFrame:
    """Clusters of the group's lag curve (subject, lag, r) with whether their absolute mass exceeds the 1 - alpha quantile of the largest of each sign-flipped group.

    The flips join by subject, so rows grow with permutations; t values are
    partial sums, and only one number a permutation goes on.
    """
    flips = sign_flips(rows.select("subject").distinct(), permutations, seed)
    null = rows.join(F.broadcast(flips), "subject").withColumn("r", F.col("r") * F.col("flip"))
    found = clusters(t_map(null, ("perm", "lag")), threshold, ("perm",))
    most = flips.select("perm").distinct().join(found.groupBy("perm").agg(F.max(F.abs("mass")).alias("most")), "perm", "left")
    bar = most.agg(F.percentile(F.coalesce("most", F.lit(0.0)), F.lit(1 - alpha)).alias("bar"))
    return clusters(t_map(rows, ("lag",)), threshold).join(F.broadcast(bar), F.lit(True)).withColumn("significant", F.abs("mass") > F.col("bar"))


def label_cells(over: np.ndarray) -> np.ndarray:
    """Labels of 4-connected cells, from 1; both signs of t may be in one."""
    label, parent = np.zeros(over.shape, int), [0]

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(over), strict=True):
        near = [find(label[a, b]) for a, b in ((i - 1, j), (i, j - 1)) if a >= 0 and b >= 0 and label[a, b]]
        if not near:
            parent.append(len(parent))
            label[i, j] = len(parent) - 1
        else:
            label[i, j] = min(near)
            for x in near:
                parent[x] = min(near)
    for i, j in zip(*np.nonzero(label), strict=True):
        label[i, j] = find(label[i, j])
    return label


def masses(t: np.ndarray, threshold: float) -> tuple[np.ndarray, dict[int, float]]:
    label = label_cells(np.abs(t) > threshold)
    return label, {int(k): float(t[label == k].sum()) for k in np.unique(label) if k}


def flips_of(seed: int, permutations: int, subjects: list[str]) -> np.ndarray:
    """permutations x subjects of 1 and -1, the same as :func:`sign_flips`."""
    u = [[int(hashlib.md5(f"{seed}|{p}|{s}".encode()).hexdigest()[:13], 16) for s in subjects] for p in range(permutations)]
    return np.where((np.array(u, float).reshape(permutations, len(subjects)) + 0.5) / float(1 << 52) < 0.5, -1.0, 1.0)


def cluster_permutation_2d(rows: DataFrame, threshold: float, permutations: int, alpha: float, seed: int) -> DataFrame:
    """t_neural, t_model, t, cluster, significant of the subjects' matrices (subject, t_neural, t_model, r); a subject without a cell counts as 0 there.

    A flip changes no square, so a permutation needs only the flipped sums: a row
    of the matrices is a task, whose product with all flips gives that row of every
    permutation's t values. Then a permutation's map is a task of its own. What is
    shuffled are the matrices once, and a map for each permutation.
    """
    n = rows.agg(F.count_distinct("subject").alias("n"))
    tiles = rows.select(F.col("subject").cast("string").alias("subject"), "t_neural", "t_model", F.col("r").cast("double").alias("r")).join(F.broadcast(n), F.lit(True))

    def tile(t):  # noqa: ANN001, ANN202
        n = t.column("n")[0].as_py()
        subjects, i = np.unique(t.column("subject").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        cells, j = np.unique(t.column("t_model").to_numpy(), return_inverse=True)
        x = np.zeros((len(subjects), len(cells)))
        x[i, j] = t.column("r").to_numpy()
        sums = np.concatenate([x.sum(0, keepdims=True), flips_of(seed, permutations, subjects.tolist()) @ x])
        square = (x * x).sum(0)
        var = (square - sums**2 / n) / max(n - 1, 1)
        ok = var > 1e-14 * square / n
        tv = np.where(ok, sums / n / np.sqrt(np.where(ok, var, 1.0) / n), 0.0)
        k = permutations + 1
        return pa.table({"perm": pa.array(np.arange(-1, permutations), pa.int32()), "t_neural": pa.array([t.column("t_neural")[0].as_py()] * k, pa.int32()), "cells": pa.array([cells.astype(np.int32).tobytes()] * k), "t": pa.array([v.tobytes() for v in tv])})

    maps = tiles.withColumn("t_neural", F.col("t_neural").cast("int")).groupBy("t_neural").applyInArrow(tile, "perm int, t_neural int, cells binary, t binary")

    def whole(t):  # noqa: ANN001, ANN202
        perm = t.column("perm")[0].as_py()
        tn = t.column("t_neural").to_numpy()
        at = [np.frombuffer(c, np.int32) for c in t.column("cells").to_pylist()]
        rows_at, tm = np.unique(tn), np.unique(np.concatenate(at))
        m, there = np.zeros((len(rows_at), len(tm))), np.zeros((len(rows_at), len(tm)), bool)
        for i, c, v in zip(np.searchsorted(rows_at, tn), at, t.column("t").to_pylist(), strict=True):
            j = np.searchsorted(tm, c)
            m[i, j], there[i, j] = np.frombuffer(v), True
        label, mass = masses(m, threshold)
        most = max([abs(x) for x in mass.values()], default=0.0)
        if perm >= 0:
            return pa.table({"perm": pa.array([perm], pa.int32()), "most": pa.array([most]), "t_neural": pa.nulls(1, pa.int32()), "t_model": pa.nulls(1, pa.int32()), "t": pa.nulls(1, pa.float64()), "cluster": pa.nulls(1, pa.int32()), "mass": pa.nulls(1, pa.float64())})
        i, j = np.nonzero(np.ones_like(there))
        own = label[i, j]
        return pa.table({"perm": pa.array([perm] * len(i), pa.int32()), "most": pa.nulls(len(i), pa.float64()), "t_neural": pa.array(rows_at[i].astype(np.int32)), "t_model": pa.array(tm[j]), "t": pa.array(m[i, j]), "cluster": pa.array(own.astype(np.int32)), "mass": pa.array([mass.get(int(k), 0.0) for k in own])})

    found = maps.groupBy("perm").applyInArrow(whole, "perm int, most double, t_neural int, t_model int, t double, cluster int, mass double")
    bar = found.where("perm >= 0").agg(F.percentile("most", F.lit(1 - alpha)).alias("bar"))
    real = found.where("perm < 0").join(F.broadcast(bar), F.lit(True))
    return real.select("t_neural", "t_model", "t", "cluster", ((F.col("cluster") > 0) & (F.abs("mass") > F.col("bar"))).alias("significant"))


def bootstrap(rows: DataFrame, by: tuple[str, ...], unit: str, resamples: int, level: float, seed: int, value: str = "r") -> DataFrame:
    """low and high percentiles of the mean over units drawn with replacement, by a hash."""
    units = rows.select(unit).distinct().withColumn("place", F.row_number().over(Window.orderBy(unit)) - 1)
    n = units.agg(F.count(F.lit(1)).alias("n"))
    draws = units.select("place").join(F.broadcast(n), F.lit(True)).select("place", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("draw"))
    draws = draws.select("draw", F.floor(hash_uniform(F.lit(seed), F.col("draw"), F.col("place")) * F.col("n")).cast("int").alias("place")).groupBy("draw", "place").agg(F.count(F.lit(1)).alias("times"))
    means = rows.join(F.broadcast(units), unit).join(F.broadcast(draws), "place").groupBy(*by, "draw").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("mean"))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def pearson(rows: DataFrame, by: tuple[str, ...], x: str, y: str) -> DataFrame:
    """r of moments, null if a side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))).alias("r"))


def percentile_clip(rows: DataFrame, column: str, q: float) -> DataFrame:
    """Values beyond the q-th percentile of the absolute value are set to it."""
    bar = rows.agg(F.percentile(F.abs(column), F.lit(q)).alias("bar"))
    return rows.join(F.broadcast(bar), F.lit(True)).withColumn(column, F.greatest(F.least(F.col(column), F.col("bar")), -F.col("bar"))).drop("bar")


def clip_twice(epochs: DataFrame, column: str, q: float, by: tuple[str, ...], base: Column) -> DataFrame:
    """Clipped and brought to its baseline (the mean of the rows where base holds, in each group of by), and both again."""
    for _ in range(2):
        epochs = percentile_clip(epochs, column, q)
        w = Window.partitionBy(*by)
        epochs = epochs.withColumn(column, F.col(column) - F.coalesce(F.avg(F.when(base, F.col(column))).over(w), F.lit(0.0)))
    return epochs


def lda_decode(rows: DataFrame, by: str, folds: int = 5) -> DataFrame:
    """by, n, score: correlation of held-out LDA probabilities with the classes (row, features, y); more than two values are split at their median, two are the classes; folds by a hash of the row.

    Each group (a time point) is a task; it holds the epochs of one recording.
    """
    keyed = rows.select(F.col(by).alias("by"), "row", "features", "y", F.pmod(F.xxhash64("row"), F.lit(folds)).cast("int").alias("fold"))

    def run(t):  # noqa: ANN001, ANN202
        order = np.argsort(t.column("row").to_numpy())
        x, y, fold = np.array(t.column("features").to_pylist(), float)[order], t.column("y").to_numpy()[order].astype(float), t.column("fold").to_numpy()[order]
        label, p = (y > (np.median(y) if len(np.unique(y)) > 2 else y.min())).astype(int), np.full(len(y), 0.5)
        for f in range(folds):
            tr, te = fold != f, fold == f
            if te.any() and 0 < label[tr].sum() < tr.sum():
                mu, sd = x[tr].mean(0), x[tr].std(0)
                z = (x - mu) / np.where(sd == 0, 1, sd)
                m = [z[tr & (label == c)].mean(0) for c in (0, 1)]
                w = sum(np.cov(z[tr & (label == c)].T, bias=True).reshape(x.shape[1], -1) * (tr & (label == c)).sum() for c in (0, 1)) / tr.sum()
                b = np.linalg.pinv(w) @ (m[1] - m[0])
                c0 = np.log(label[tr].mean() / (1 - label[tr].mean())) - (m[0] + m[1]) @ b / 2
                p[te] = 1 / (1 + np.exp(-np.clip(z[te] @ b + c0, -500, 500)))
        ok = p.std() > 0 and label.std() > 0
        return pa.table({"by": pa.array([t.column("by")[0].as_py()], pa.int32()), "n": pa.array([len(y)], pa.int64()), "score": pa.array([float(np.corrcoef(p, label)[0, 1]) if ok else None], pa.float64())})

    return keyed.withColumn("by", F.col("by").cast("int")).groupBy("by").applyInArrow(run, "by int, n bigint, score double").withColumnRenamed("by", by)
