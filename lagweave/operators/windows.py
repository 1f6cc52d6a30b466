"""Windows on a masked grid: candidate starts, random draws, permutations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def random_key(seed: int, *parts: Column) -> Column:
    """An order that every engine can replay."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def valid_starts(mask: DataFrame, length: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, start of every window whose points are all there and valid. A task holds one grid (of a subject, where by names it)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t").rowsBetween(0, length - 1)
    ok = mask.select(*by, "t", F.min(F.col("valid").cast("int")).over(w).alias("all"), F.count(F.lit(1)).over(w).alias("n"), (F.max("t").over(w) - F.col("t") + 1).alias("span"))
    return ok.where((F.col("all") == 1) & (F.col("n") == length) & (F.col("span") == length)).select(*by, F.col("t").alias("start"))


def onset_starts(onsets: DataFrame, rate: float, length: int, n_times: int, centre: bool = False) -> DataFrame:
    """start of the windows at (or around) the onsets, halves to the even point; those that leave the grid go."""
    at = F.rint(F.col("onset_sec") * rate)
    start = F.rint(at - (length - 1) / 2) if centre else at
    ok = onsets.where(~F.isnan("onset_sec") & (F.col("onset_sec") >= 0) & (F.col("onset_sec") < float("inf")))
    return ok.select(start.cast("int").alias("start")).where((F.col("start") >= 0) & (F.col("start") <= n_times - length)).distinct()


def draw_windows(starts: DataFrame, iterations: int, n: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, iteration, win, start: n starts of each iteration in random order; windows may overlap. Fewer than n starts are an error."""
    rows = starts.select(*by, "start", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    own = Window.partitionBy(*by, "iteration")
    w = own.orderBy(random_key(seed, *[F.col(c) for c in by], F.col("iteration"), F.col("start")), "start")
    few = F.count(F.lit(1)).over(own) < n
    win = F.when(few, F.raise_error(F.lit(f"fewer than {n} windows can start")).cast("int")).otherwise(F.row_number().over(w) - 1)
    return rows.withColumn("win", win).where(F.col("win") < n).select(*by, "iteration", "win", "start")


def draw_apart(starts: DataFrame, iterations: int, n: int, length: int, seed: int) -> DataFrame:
    """The same without overlap: in random order, a start goes if one nearer than a window was taken. Greedy choice is sequential, so each iteration is one task; it holds the starts of one grid. An iteration that can't place n windows is an error."""
    keyed = starts.select("start", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    keyed = keyed.withColumn("key", random_key(seed, F.col("iteration"), F.col("start")))

    def pick(t):  # noqa: ANN001, ANN202
        rows = sorted(zip(t.column("key").to_pylist(), t.column("start").to_pylist(), strict=True))
        taken: list[int] = []
        for _, s in rows:
            if len(taken) < n and all(abs(s - x) >= length for x in taken):
                taken.append(s)
        if len(taken) < n:
            raise ValueError(f"{len(taken)} of {n} windows fit without overlap")
        return pa.table({"iteration": pa.array([t.column("iteration")[0].as_py()] * n, pa.int32()), "win": pa.array(range(n), pa.int32()), "start": pa.array(taken, pa.int32())})

    return keyed.select(F.col("iteration").cast("int"), F.col("start").cast("int"), "key").groupBy("iteration").applyInArrow(pick, "iteration int, win int, start int")


def permute_windows(windows: DataFrame, seed: int) -> DataFrame:
    """Each iteration's windows in another order: the null model."""
    w = Window.partitionBy("iteration").orderBy(random_key(seed, F.col("iteration"), F.col("win")), "win")
    return windows.select("iteration", (F.row_number().over(w) - 1).alias("win"), "start")


def gather(windows: DataFrame, trajectory: DataFrame, length: int, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """by, iteration, win, offset, features, and the trajectory's columns named in carry (a signal, so that one plan gathers all)."""
    at = windows.select(*by, "iteration", "win", "start", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("offset")).withColumn("t", F.col("start") + F.col("offset"))
    return at.join(trajectory, [*by, "t"]).select(*by, *carry, "iteration", "win", "offset", "features")


def coverage(windows: DataFrame, length: int) -> DataFrame:
    """How many windows of an iteration hold a point."""
    return windows.select("iteration", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("t")).groupBy("iteration", "t").agg(F.count(F.lit(1)).alias("n"))
