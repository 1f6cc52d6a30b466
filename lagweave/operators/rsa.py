"""Similarity of two series of dissimilarities across all pairs of offsets, and lag curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rdm import rdm, rdm_blocks, zscored


def rsa(neural: DataFrame, model: DataFrame, by: tuple[str, ...] = (), models: tuple[str, ...] = ()) -> DataFrame:
    """by, models, t_neural, t_model, r: the mean product of z over pairs, then over iterations; z-scored RDM rows (by, iteration, offset, i, j, z). by: keys of both sides; models: keys of the model side alone."""
    keys = [*by, "iteration", "i", "j"]
    n = neural.select(*keys, F.col("offset").alias("t_neural"), F.col("z").alias("zn"))
    m = model.select(*keys, *models, F.col("offset").alias("t_model"), F.col("z").alias("zm"))
    each = n.join(m, keys).groupBy(*by, *models, "iteration", "t_neural", "t_model").agg(F.avg(F.col("zn") * F.col("zm")).alias("r"))
    return each.groupBy(*by, *models, "t_neural", "t_model").agg(F.avg("r").alias("r"))


def rsa_blocks(neural: DataFrame, model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same of blocks (by, iteration, offset, z): a matrix product for each iteration, then a mean. For more than about 10**8 joined rows of :func:`rsa`."""
    kinds = dict(neural.dtypes)

    def run(n, m):  # noqa: ANN001, ANN202
        if not n.num_rows or not m.num_rows:
            return pa.table({**{c: pa.array([], n.schema.field(c).type) for c in by}, "t_neural": pa.array([], pa.int32()), "t_model": pa.array([], pa.int32()), "r": pa.array([], pa.float64())})
        a, b = (np.array(x.sort_by("offset").column("z").to_pylist()) for x in (n, m))
        r = a @ b.T / a.shape[1]
        i, j = np.indices(r.shape)
        own = {c: pa.array([n.column(c)[0].as_py()] * r.size, n.schema.field(c).type) for c in by}
        return pa.table({**own, "t_neural": pa.array(i.ravel().astype(np.int32)), "t_model": pa.array(j.ravel().astype(np.int32)), "r": pa.array(r.ravel())})

    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "t_neural int, t_model int, r double"
    each = neural.groupBy(*by, "iteration").cogroup(model.groupBy(*by, "iteration")).applyInArrow(run, schema)
    return each.groupBy(*by, "t_neural", "t_model").agg(F.avg("r").alias("r"))


#: Rows of the relational join from which the block path is taken.
CROSSOVER = 100_000_000


def choose_path(iterations: int, windows: int, length: int) -> str:
    return "block" if iterations * length * length * windows * (windows - 1) // 2 > CROSSOVER else "relational"


def similarity(windows: DataFrame, neural: DataFrame, model: DataFrame, iterations: int, n: int, length: int, metrics: tuple[str, str] = ("euclidean", "euclidean"), by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """by, t_neural, t_model, r of two trajectories (by, t, features) in the windows (by, iteration, win, start), by the path that suits the number of joined rows (of one key), or by the one named."""
    if (path or choose_path(iterations, n, length)) == "block":
        return rsa_blocks(*[rdm_blocks(windows, x, length, k, by) for x, k in zip((neural, model), metrics, strict=True)], by)
    sides = [zscored(rdm(windows, x, length, k, by), "d", (*by, "iteration", "offset")) for x, k in zip((neural, model), metrics, strict=True)]
    return rsa(*sides, by)


def lag_curve(matrix: DataFrame, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    """lag = t_neural - t_model, mean of r on that diagonal; undefined cells don't count."""
    lag = (F.col("t_neural") - F.col("t_model")).alias("lag")
    r = F.when(~F.isnan("r"), F.col("r"))
    return matrix.where(F.abs(F.col("t_neural") - F.col("t_model")) <= reach).groupBy(*by, lag).agg(F.avg(r).alias("r"))


def cut(matrix: DataFrame, neural: tuple[int, int], model: tuple[int, int]) -> DataFrame:
    return matrix.where(F.col("t_neural").between(*neural) & F.col("t_model").between(*model))


def peak(curve: DataFrame, by: tuple[str, ...] = (), absolute: bool = False) -> DataFrame:
    """lag and r of the largest r (or absolute r); of ties the smallest lag."""
    key = F.abs("r") if absolute else F.col("r")
    best = F.max_by(F.struct("lag", "r"), F.struct(key, -F.col("lag"))).alias("p")
    return curve.where(F.col("r").isNotNull()).groupBy(*by).agg(best).select(*by, F.col("p.lag").alias("peak_lag"), F.col("p.r").alias("peak_r"))


def border(curve: DataFrame, threshold: float, reach: int, legacy: bool = False) -> DataFrame:
    """The farthest lag of a self-similarity curve that reaches the threshold; 0 if none does, reach at most. legacy: the largest signed lag whose signed r is above it."""
    far = F.max(F.when(F.col("r") > threshold, F.col("lag"))) if legacy else F.max(F.when(F.abs("r") >= threshold, F.abs("lag")))
    return curve.agg(F.least(F.coalesce(far, F.lit(0)), F.lit(reach)).cast("int").alias("border"))


def nearest_time(series: DataFrame, snapshots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, tau and the point t of the series (by, t, sec) nearest to it; of ties the earlier (of one time the smaller t). One merge of both sides by key and time, no join; windows run up to a row, forwards and backwards, as one that starts at a row is made anew for each."""
    point = F.struct("sec", "t")
    points = series.groupBy(*by, "sec").agg(F.min("t").alias("t")).select(*by, "sec", F.lit(None).cast("double").alias("tau"), point.alias("p"))
    rows = points.unionByName(snapshots.select(*by, F.col("tau").alias("sec"), F.col("tau").cast("double").alias("tau")).withColumn("p", F.lit(None).cast(points.schema["p"].dataType)))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    nearest = lambda order: F.last("p", ignorenulls=True).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("before", nearest(F.col("sec"))).withColumn("after", nearest(F.col("sec").desc()))
    rows = rows.where(F.col("tau").isNotNull())
    later = F.col("before").isNull() | (F.col("after.sec") - F.col("tau") < F.col("tau") - F.col("before.sec"))
    return rows.select(*by, "tau", F.when(later, F.col("after.t")).otherwise(F.col("before.t")).alias("t"))
