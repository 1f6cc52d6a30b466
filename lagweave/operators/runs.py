"""Runs of subjects: their products in order, sensors, results, and grids put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_normal
from .timegrid import paint_spans


def voicing_counters(spans: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Segments and samples of each voicing in spans (by, start, stop, voicing); segments without a voicing are unknown, those that cover nothing don't count."""
    n = F.greatest(F.col("stop") - F.col("start"), F.lit(0))
    rows = spans.withColumn("n", n)
    count = lambda cond, name: F.count_if(cond & (F.col("n") > 0)).alias(name)
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name)
    up, down = F.col("voicing") > 0, F.col("voicing") < 0
    return rows.groupBy(*by).agg(count(up, "voiced_segments"), count(down, "unvoiced_segments"), F.count_if(F.col("voicing").isNull()).alias("unknown_segments"), total(up, "voiced_samples"), total(down, "unvoiced_samples"))


def same_channels(runs: DataFrame, by: tuple[str, ...], order: tuple[str, ...], require: bool = False) -> DataFrame:
    """runs (by, order, channels) with agrees: whether a run's channels are those of the first one. require: a run that differs is an error."""
    first = F.min_by("channels", F.struct(*order)).over(Window.partitionBy(*by))
    rows = runs.withColumn("agrees", first == F.col("channels"))
    if require:
        rows = rows.withColumn("agrees", F.when(~F.col("agrees"), F.raise_error(F.lit("channels of runs differ")).cast("boolean")).otherwise(True))
    return rows


def product_join(manifest: DataFrame, products: DataFrame, by: tuple[str, ...], order: tuple[str, ...], missing: str) -> DataFrame:
    """The products of the manifest's segments with seg_no, their place in it. missing: "abort" leaves a whole manifest out, "skip" the segment, "fail" is an error."""
    own = Window.partitionBy(*by)
    rows = manifest.withColumn("seg_no", F.row_number().over(own.orderBy(*order)) - 1)
    rows = rows.join(products.withColumn("__there", F.lit(True)), [*by, *order], "left")
    if missing == "skip":
        return rows.where("__there").drop("__there")
    whole = F.every(F.coalesce("__there", F.lit(False))).over(own)
    if missing == "fail":
        whole = F.when(whole, True).otherwise(F.raise_error(F.lit("a segment has no product")).cast("boolean"))
    return rows.withColumn("__whole", whole).where("__whole").drop("__there", "__whole")


def without_condition(events: DataFrame, left_out: str = "word_list", default: str = "story") -> DataFrame:
    """Events whose condition (the default where there is none) isn't the one left out."""
    return events.where(F.coalesce("condition", F.lit(default)) != left_out)


def zoomed(coverage: DataFrame, onsets: DataFrame, low: int, high: int) -> DataFrame:
    """kind, iteration, t, n: windows over each point, and onsets, from low to high."""
    inside = F.col("t").between(low, high)
    points = coverage.where(inside).select(F.lit("coverage").alias("kind"), "iteration", F.col("t").cast("int").alias("t"), "n")
    marks = onsets.where(inside).groupBy("t").agg(F.count(F.lit(1)).alias("n")).select(F.lit("onset").alias("kind"), F.lit(None).cast("int").alias("iteration"), F.col("t").cast("int").alias("t"), "n")
    return points.unionByName(marks)


def assemble(tokens: DataFrame, grid: DataFrame, n_times: int, scale: float, seed: int) -> DataFrame:
    """subject, t, x, covered: tokens (subject, event_no, j, a, b, x) on the subjects' grids, the last writer wins; gaps get noise of scale times the covered points' deviation."""
    spans = tokens.select("subject", F.col("a").alias("start"), F.least(F.col("b"), F.lit(n_times)).cast("int").alias("stop"), F.struct("event_no", "j").alias("at"), "x")
    painted = paint_spans(spans, "x", "at", ("subject",))
    sd = painted.groupBy("subject").agg(F.sqrt(F.greatest(F.var_pop("x"), F.lit(1e-12))).alias("sd"))
    rows = grid.join(painted, ["subject", "t"], "left").join(F.broadcast(sd), "subject")  # a row for each subject
    noise = F.col("sd") * scale * hash_normal(F.lit(seed), F.col("subject"), F.col("t"))
    return rows.select("subject", "t", F.coalesce("x", noise).alias("x"), F.col("x").isNotNull().alias("covered"))


def subject_results(results: DataFrame, models: list[str], origin: str = "base", label: str | None = None) -> DataFrame:
    """Rows (subject, neural, model, ...) of the models asked for, whatever the case, in runs of one origin and label. A missing neural label is "Neural 1". A model that a subject hasn't is an error, and so are several labels where none is asked for."""
    wanted = [m.lower() for m in models]
    rows = results.where((F.col("origin") == origin) & (F.lit(label is None) | (F.col("label") == (label or ""))))
    own = Window.partitionBy("subject")
    found = F.size(F.collect_set(F.lower("model")).over(own))
    labels = F.size(F.collect_set("label").over(own))
    rows = rows.where(F.lower("model").isin(wanted))
    ok = F.when(found < len(set(wanted)), F.raise_error(F.lit("a model is missing")).cast("boolean")).when(labels > 1, F.raise_error(F.lit("several simulations: name one")).cast("boolean")).otherwise(True)
    return rows.withColumn("__ok", ok).where("__ok").drop("__ok").withColumn("neural", F.coalesce("neural", F.lit("Neural 1")))


def sensor_union(sides: DataFrame) -> DataFrame:
    """channel, place: the sensors (line_no, side, channel) of the left, the right and the centre in this order, each where it is first."""
    part = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    first = sides.groupBy("channel").agg(F.min(F.struct(part.alias("part"), "line_no")).alias("at"))
    return first.select("channel", (F.row_number().over(Window.orderBy("at.part", "at.line_no")) - 1).alias("place"))


def sensor_places(sides: DataFrame, recording: DataFrame) -> DataFrame:
    """side, channel, place in the recording (channel, place) by normalised name, and whether it is missing there."""
    name = F.upper(F.regexp_replace(F.trim("channel"), r"\s+", " "))
    there = recording.select(name.alias("__name"), "place")
    rows = sides.select("side", "channel").distinct().withColumn("__name", name).join(F.broadcast(there), "__name", "left")  # a recording's channels
    return rows.select("side", "channel", "place", F.col("place").isNull().alias("missing"))
