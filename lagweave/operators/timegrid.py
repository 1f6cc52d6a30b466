"""Events, masks and series on a common time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paint(events: DataFrame, n_times: int, value: str = "value", order: str = "event_no", by: tuple[str, ...] = ()) -> DataFrame:
    """Last writer wins: by, t, value of the grid points in [start, stop) of the events.

    An interval join becomes an explode and one aggregate; each event is as many
    rows as it covers points, and the maximum by order is pre-aggregated.
    """
    lo, hi = F.greatest(F.col("start"), F.lit(0)), F.least(F.greatest(F.col("stop"), F.col("start") + 1), F.lit(n_times))
    rows = events.where((lo < hi) & (lo < n_times)).select(*by, F.explode(F.sequence(lo.cast("int"), (hi - 1).cast("int"))).alias("t"), order, value)
    return rows.groupBy(*by, "t").agg(F.max_by(value, order).alias(value))


def on_grid(painted: DataFrame, n_times: int, value: str, background: Column) -> DataFrame:
    """Every point of the grid; background where nothing was painted."""
    grid = painted.sparkSession.range(n_times).select(F.col("id").cast("int").alias("t"))
    return grid.join(painted, "t", "left").select("t", F.coalesce(F.col(value), background).alias(value), F.col(value).isNotNull().alias("covered"))


def clipped(events: DataFrame, n_times: int) -> DataFrame:
    """Events with their number of covered points."""
    lo, hi = F.greatest(F.col("start"), F.lit(0)), F.least(F.greatest(F.col("stop"), F.col("start") + 1), F.lit(n_times))
    return events.withColumn("covered", F.greatest(hi - lo, F.lit(0)))


def offsets(segments: DataFrame, order: str, length: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Where each segment begins when they are put one after the other."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def boundary_mask(series: DataFrame, segment: str) -> DataFrame:
    """valid is false at the first point of every segment but the first."""
    w = Window.partitionBy(segment).orderBy("t")
    return series.withColumn("valid", ~((F.row_number().over(w) == 1) & (F.col(segment) > 0)))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("valid", "other"), "t").select("t", (F.col("valid") & F.col("other")).alias("valid"))


def decimate_mask(mask: DataFrame, factor: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A block is valid if all its points are; a last block that isn't whole is left out where by names the grids."""
    if by:
        whole = mask.groupBy(*by, F.floor(F.col("t") / factor).cast("int").alias("t")).agg(F.bool_and("valid").alias("valid"), F.count(F.lit(1)).alias("n"))
        return whole.where(F.col("n") == factor).drop("n")
    return mask.groupBy(F.floor(F.col("t") / factor).cast("int").alias("t")).agg(F.bool_and("valid").alias("valid"))


def intervals(mask: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, first point and the point after the last of each valid run. A task holds one grid."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t")
    edge = mask.withColumn("rise", F.col("valid") & ~F.coalesce(F.lag("valid").over(w), F.lit(False)))
    run = edge.where("valid").withColumn("run", F.sum(F.col("rise").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "run").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop")).select(*by, "start", "stop")


def upsample_mask(mask: DataFrame, factor: int) -> DataFrame:
    """Each cell becomes factor x factor cells."""
    k = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = mask.withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
    return rows.select((F.col("t_neural") * factor + F.col("i")).cast("int").alias("t_neural"), (F.col("t_model") * factor + F.col("j")).cast("int").alias("t_model"), "significant")


def block_mean(matrix: DataFrame, factor: int, by: tuple[str, ...] = ()) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return matrix.groupBy(*by, cell("t_neural"), cell("t_model")).agg(F.avg("r").alias("r"))


def sample_interval(sample: Column, duration: Column, rate: float) -> tuple[Column, Column]:
    """start and stop on the grid of the samples: round(duration * rate) points from the onset on, one at least. A start before the grid is its first point."""
    start = F.greatest(sample, F.lit(0))
    return start.cast("int"), (start + F.greatest(F.rint(duration * rate), F.lit(1))).cast("int")


def target_interval(sample: Column, duration: Column, rate: float, target: float, begin: Column, end: Column) -> tuple[Column, Column]:
    """start and stop on a grid of another rate, inside a segment [begin, end): floor of the onset to ceiling of the end, one point at least."""
    onset = sample / F.lit(float(rate))
    a = begin + F.floor(onset * target)
    b = begin + F.ceil((onset + F.greatest(duration, F.lit(0.0))) * target)
    b = F.when(b <= a, a + 1).otherwise(b)
    return F.greatest(begin, a).cast("int"), F.least(end, b).cast("int")


def segment_lengths(segments: DataFrame, rate: float, target: float, n: str = "n_samples") -> DataFrame:
    """segments with n_points: their samples at the target rate, halves to the even number."""
    return segments.withColumn("n_points", F.rint(F.col(n) * target / rate).cast("int"))


def paint_spans(events: DataFrame, value: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """by, t, value: last writer wins, of spans [start, stop) that are clipped already."""
    rows = events.where("start < stop").select(*by, F.explode(F.sequence("start", F.col("stop") - 1)).alias("t"), order, value)
    return rows.groupBy(*by, "t").agg(F.max_by(value, order).alias(value))


def resample(series: DataFrame, up: int, down: int, taps: list[float], n_times: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, t, x at up / down times the rate: out[k] = sum of x[t] h[k down - t up], zeros outside, the taps' centre on each point.

    A point meets the outputs that its taps reach: one explode of a bounded number
    of them, and one sum. taps are those of an anti-alias filter at up times the rate.
    """
    half = len(taps) // 2
    h = F.array(*[F.lit(float(x) * up) for x in taps])
    first = F.greatest(F.ceil((F.col("t") * up - half) / F.lit(down)), F.lit(0))
    last = F.least(F.floor((F.col("t") * up + half) / F.lit(down)), F.lit(-(-n_times * up // down) - 1))
    rows = series.where(first <= last).select(*by, "t", "x", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("k"))
    tap = F.get(h, F.col("k") * down - F.col("t") * up + half)
    return rows.groupBy(*by, F.col("k").alias("t")).agg(F.sum(F.col("x") * tap).alias("x"))


def place_clips(segments: DataFrame, clips: DataFrame, rate: float, n_times: int, resampled: bool = True) -> DataFrame:
    """t, x: of each segment (seg_no, clip, onset, audio_onset, audio_offset), its part of a clip (clip, rate, samples) at its onset; later segments win.

    The part is brought to the rate by FFT where its own differs, or its length by
    more than a sample. A clip is one row; a task resamples one part at a time.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.numerics import fft_resample

    sr = F.col("rate")
    a, b = F.greatest(F.rint(F.col("audio_onset") * sr), F.lit(0)), F.least(F.rint(F.col("audio_offset") * sr), F.size("samples"))
    points = F.greatest(F.rint((F.col("audio_offset") - F.col("audio_onset")) * rate), F.lit(1)).cast("int")
    rows = segments.join(clips, "clip").where((b > a) & (F.col("audio_offset") > F.col("audio_onset")))
    rows = rows.select("seg_no", F.rint(F.col("onset") * rate).cast("int").alias("start"), sr.cast("double").alias("sr"), points.alias("points"), F.slice("samples", a.cast("int") + 1, (b - a).cast("int")).alias("part"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for row in batch.to_pylist():
                x = np.array(row["part"], float)
                x = fft_resample(x, row["points"]) if resampled and (row["sr"] != rate or abs(len(x) - row["points"]) > 1) else x[: row["points"]]
                yield pa.RecordBatch.from_arrays([pa.array([row["seg_no"]] * len(x), pa.int64()), pa.array(row["start"] + np.arange(len(x), dtype=np.int32)), pa.array(x)], ["seg_no", "t", "x"])

    placed = rows.withColumn("seg_no", F.col("seg_no").cast("long")).mapInArrow(run, "seg_no bigint, t int, x double")
    return placed.where((F.col("t") >= 0) & (F.col("t") < n_times)).groupBy("t").agg(F.max_by("x", "seg_no").alias("x"))


def ranked(rows: DataFrame, order: str, span: int = 1 << 16) -> DataFrame:
    """rows with rn, their place from 1 in the order of an integer column, and n, their number; no task sees more than `span` values of it and one row for each span."""
    rows = rows.withColumn("__span", F.floor(F.col(order) / span))
    held = rows.groupBy("__span").agg(F.count(F.lit(1)).alias("__held"))
    every = Window.partitionBy(F.lit(0))
    before = held.select("__span", F.coalesce(F.sum("__held").over(every.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__held").over(every).alias("n"))
    own = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__span").orderBy(order)))
    return own.join(before, F.equal_null(own["__span"], before["__span"])).select(*[c for c in rows.columns if c != "__span"], (F.col("__rn") + F.col("__before")).alias("rn"), "n")


def filter_decimate(series: DataFrame, taps: list[float], factor: int, n_times: int) -> DataFrame:
    """out[k] = sum over j of x[factor k + half - j] h[j], zeros outside: one explode over the taps and one sum; taps are a constant of the plan."""
    half = len(taps) // 2
    h = F.array(*[F.lit(float(x)) for x in taps])
    rows = series.select("t", "x", F.posexplode(h).alias("j", "h")).withColumn("at", F.col("t") + F.col("j") - half)
    n_out = -(-n_times // factor)
    rows = rows.where((F.col("at") % factor == 0) & (F.col("at") >= 0) & (F.col("at") < n_out * factor))
    return rows.groupBy((F.col("at") / factor).cast("int").alias("t")).agg(F.sum(F.col("x") * F.col("h")).alias("x"))


def epochs(series: DataFrame, onsets: DataFrame, before: int, after: int, by: tuple[str, ...] = (), step: int = 1, upto: int = -1) -> DataFrame:
    """by, onset, lag, x less the mean of the points up to `upto` after the onset (those before it); an onset whose window leaves the series is kept with what is there. step: every so many points, as decimation leaves them."""
    lags = onsets.select(*by, "onset", F.explode(F.sequence(F.lit(-before), F.lit(after), F.lit(step))).alias("lag")).withColumn("t", F.col("onset") + F.col("lag"))
    rows = lags.join(series, [*by, "t"])
    w = Window.partitionBy(*by, "onset")
    return rows.withColumn("x", F.col("x") - F.coalesce(F.avg(F.when(F.col("lag") <= upto, F.col("x"))).over(w), F.lit(0.0))).select(*by, "onset", "lag", "x")


def rolling_mean(series: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, t, sums of width points over width, as if zeros stood outside; an even width reaches one point further back. A task holds one series."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t").rowsBetween(-(width // 2), (width - 1) // 2)
    return series.select(*by, "t", (F.sum("x").over(w) / width).alias("x"))


def noise_fill(series: DataFrame, scale: Column, noise: Column) -> DataFrame:
    """Uncovered points get noise of the covered points' population deviation times scale; the deviation is one row and is joined to all."""
    sd = series.where("covered").agg(F.sqrt(F.greatest(F.var_pop("x"), F.lit(1e-12))).alias("sd"))
    return series.join(F.broadcast(sd), F.lit(True)).select("t", F.when(F.col("covered"), F.col("x")).otherwise(F.col("sd") * scale * noise).alias("x"), "covered")


def after(rows: DataFrame, order: str, kind: str, value: str, span: int = 1 << 16) -> DataFrame:
    """Rows whose predecessor in the order of an integer column has `value` as its kind; no task sees more than `span` values of that column and one row for each span."""
    rows = rows.withColumn("__span", F.floor(F.col(order) / span))
    own = Window.partitionBy("__span").orderBy(order)
    ends = rows.groupBy("__span").agg(F.max_by(kind, order).alias("__kind"))
    ends = ends.select("__span", F.lag("__kind").over(Window.orderBy("__span")).alias("__ahead"))
    near = rows.withColumn("__first", F.row_number().over(own) == 1).withColumn("__before", F.lag(kind).over(own))
    before = F.when(F.col("__first"), F.col("__ahead")).otherwise(F.col("__before"))
    return near.join(ends, F.equal_null(near["__span"], ends["__span"])).where(before == value).select(*[c for c in rows.columns if c != "__span"])
