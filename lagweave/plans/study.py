"""Queries of a study: runs of several subjects, their grids, products, models and simulations, each in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..functions import scalar as X
from ..operators import features as Ft
from ..operators import rdm as R
from ..operators import registry as Reg
from ..operators import regress as G
from ..operators import rsa as S
from ..operators import runs as Rn
from ..operators import stats as St
from ..operators import timegrid as T
from ..operators import windows as Win
from ..sources import sinks
from ..sources import tables as Src
from ..sources.tables import table
from . import control as C
from . import domain as D
from .core import query, spread
from .domain import CHANNELS, CURVE, EV, LENGTH, MODEL, NEURAL, POINTS, REACH, WIN, r6, uniform_sql

RUN = ("subject", "session", "task")
#: Samples a second of the recording and of the models, and the samples of a run (before what its session and task add).
RATE, TARGET, SAMPLES = 100, 10, 2000

ST = """st AS (SELECT event_id AS event_no, subject, (user_id // 8) % 2 AS session, k % 4 AS task, (event_id * 37) % 2100 - 50 AS sample, (k % 7) * 0.05::DOUBLE AS duration, event_type AS kind, value, k,
 2000 + 37 * ((user_id // 8) % 2) + 13 * (k % 4) AS n_samples FROM ev)"""
SEG = "seg AS (SELECT *, CAST(coalesce(sum(n_points) OVER (PARTITION BY subject ORDER BY session, task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start FROM (SELECT subject, session, task, CAST(round_even(any_value(n_samples) * 10 / 100.0::DOUBLE, 0) AS INTEGER) AS n_points FROM st GROUP BY 1, 2, 3))"
SAMPLE_SPAN = "sp AS (SELECT *, greatest(sample, 0) AS start, greatest(sample, 0) + greatest(CAST(round_even(duration * 100, 0) AS INTEGER), 1) AS stop FROM st)"
SAMPLE_PAINT = "pt AS (SELECT * EXCLUDE (t), CAST(t AS INTEGER) AS t FROM (SELECT *, unnest(range(start, least(stop, n_samples))) AS t FROM sp))"


def study(spark: SparkSession, d: str) -> DataFrame:
    """The events as those of runs: event_no, subject, session, task, sample, duration, kind, value, k, n_samples."""
    ev = D.events(spark, d)
    session = F.floor(F.col("user_id") / 8) % 2
    rows = ev.select(F.col("event_id").alias("event_no"), "subject", session.alias("session"), (F.col("k") % 4).alias("task"), ((F.col("event_id") * 37) % 2100 - 50).alias("sample"), ((F.col("k") % 7) * F.lit(0.05)).alias("duration"), F.col("event_type").alias("kind"), "value", "k")
    return rows.withColumn("n_samples", (SAMPLES + 37 * F.col("session") + 13 * F.col("task")).cast("int"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    start, stop = T.sample_interval(F.col("sample"), F.col("duration"), RATE)
    return study(spark, d).withColumn("start", start).withColumn("stop", F.least(stop, F.col("n_samples")))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """The manifest: subject, session, task, n_points, seg_start, in order of session and task."""
    runs = study(spark, d).groupBy(*RUN).agg(F.max("n_samples").alias("n_samples"))
    rows = T.segment_lengths(runs, RATE, TARGET).withColumn("at", F.struct("session", "task"))
    return T.offsets(rows, "at", "n_points", ("subject",)).select(*RUN, "n_points", F.col("offset").alias("seg_start"))


# Grids of runs.


@query(spread(EV, ST, SAMPLE_SPAN, SAMPLE_PAINT) + "SELECT subject, session, task, t, arg_max(value, event_no) AS value FROM pt GROUP BY ALL")
def paint_sample_grid(spark: SparkSession, d: str) -> DataFrame:
    return T.paint_spans(spans(spark, d), "value", "event_no", RUN)


@query(spread(EV, ST, SEG) + "SELECT subject, session, task, n_points, CAST(seg_start AS BIGINT) AS seg_start FROM seg")
def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d)


TARGET_SPAN = "tg AS (SELECT st.*, seg_start, seg_start + n_points AS seg_end, seg_start + CAST(floor(sample / 100.0::DOUBLE * 10) AS BIGINT) AS a, seg_start + CAST(ceil((sample / 100.0::DOUBLE + duration) * 10) AS BIGINT) AS b FROM st JOIN seg USING (subject, session, task)), ts AS (SELECT *, greatest(a, seg_start) AS start, least(CASE WHEN b <= a THEN a + 1 ELSE b END, seg_end) AS stop FROM tg)"


def _target(spark: SparkSession, d: str) -> DataFrame:
    rows = study(spark, d).join(F.broadcast(segments(spark, d)), list(RUN))
    start, stop = T.target_interval(F.col("sample"), F.col("duration"), RATE, TARGET, F.col("seg_start"), F.col("seg_start") + F.col("n_points"))
    return rows.withColumn("start", start).withColumn("stop", stop)


@query(spread(EV, ST, SEG, TARGET_SPAN, "p AS (SELECT subject, event_no, session, task, value, unnest(range(start, stop)) AS t FROM ts WHERE start < stop)") + "SELECT subject, CAST(t AS INTEGER) AS t, arg_max(value, (session, task, event_no)) AS value FROM p GROUP BY 1, 2")
def paint_target_grid(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to a subject's concatenated grid: floor to ceiling, a point at least, clipped to the segment."""
    rows = _target(spark, d).withColumn("at", F.struct("session", "task", "event_no"))
    return T.paint_spans(rows, "value", "at", ("subject",))


SENTENCE = "sm AS (SELECT g.subject, g.session, g.task, CAST(g.t AS INTEGER) AS t, p.t IS NOT NULL AS valid FROM (SELECT subject, session, task, unnest(range(n)) AS t FROM (SELECT subject, session, task, any_value(n_samples) AS n FROM st GROUP BY 1, 2, 3)) g LEFT JOIN (SELECT DISTINCT subject, session, task, t FROM pt WHERE kind IN ('view', 'click')) p USING (subject, session, task, t))"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    inside = T.paint_spans(spans(spark, d).where(F.col("kind").isin("view", "click")).withColumn("valid", F.lit(True)), "valid", "event_no", RUN)
    runs = study(spark, d).groupBy(*RUN).agg(F.max("n_samples").alias("n"))
    grid = runs.select(*RUN, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    return grid.join(inside, [*RUN, "t"], "left").select(*RUN, "t", F.coalesce("valid", F.lit(False)).alias("valid"))


@query(spread(EV, ST, SAMPLE_SPAN, SAMPLE_PAINT, SENTENCE) + "SELECT * FROM sm")
def sentence_mask_painted(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


@query(spread(EV, ST, SAMPLE_SPAN, SAMPLE_PAINT, SENTENCE) + "SELECT subject, session, task, round(avg(CAST(valid AS INTEGER)), 6) AS share FROM sm GROUP BY ALL")
def mask_proportion(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).groupBy(*RUN).agg(r6(F.avg(F.col("valid").cast("int"))).alias("share"))


@query(spread(EV, ST, SAMPLE_SPAN, SAMPLE_PAINT, SENTENCE, "dm AS (SELECT subject, session, task, t // 10 AS t, bool_and(valid) AS valid FROM sm GROUP BY ALL HAVING count(*) = 10)") + "SELECT subject, session, task, min(t) AS start, max(t) + 1 AS stop FROM (SELECT *, t - row_number() OVER (PARTITION BY subject, session, task ORDER BY t) AS run FROM dm WHERE valid) GROUP BY subject, session, task, run")
def run_mask_intervals(spark: SparkSession, d: str) -> DataFrame:
    return T.intervals(T.decimate_mask(_sentences(spark, d), RATE // TARGET, RUN), RUN)


@query(spread(EV, ST, SAMPLE_SPAN, "vo AS (SELECT subject, session, task, CASE kind WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS v, greatest(least(stop, n_samples) - start, 0) AS n FROM sp)") + "SELECT subject, session, task, count(*) FILTER (WHERE v > 0 AND n > 0) AS voiced_segments, count(*) FILTER (WHERE v < 0 AND n > 0) AS unvoiced_segments, count(*) FILTER (WHERE v IS NULL) AS unknown_segments, CAST(coalesce(sum(n) FILTER (WHERE v > 0), 0) AS BIGINT) AS voiced_samples, CAST(coalesce(sum(n) FILTER (WHERE v < 0), 0) AS BIGINT) AS unvoiced_samples FROM vo GROUP BY 1, 2, 3")
def voicing_counters(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("kind").isin("click", "purchase"), 1).when(F.col("kind") == "error", -1)
    return Rn.voicing_counters(spans(spark, d).withColumn("voicing", v), RUN)


@query(spread(EV, ST, "c AS (SELECT subject, session, task, list_sort(list(DISTINCT kind)) AS channels FROM st GROUP BY 1, 2, 3), f AS (SELECT subject, arg_min(channels, (session, task)) AS first FROM c GROUP BY 1)") + "SELECT subject, session, task, len(channels) AS n_channels, channels = first AS agrees FROM c JOIN f USING (subject)")
def channel_equality(spark: SparkSession, d: str) -> DataFrame:
    runs = study(spark, d).groupBy(*RUN).agg(F.sort_array(F.collect_set("kind")).alias("channels"))
    return Rn.same_channels(runs, ("subject",), ("session", "task")).select(*RUN, F.size("channels").alias("n_channels"), "agrees")


PRODUCTS = "pr AS (SELECT subject, session, task, round(avg(value), 6) AS x FROM st GROUP BY 1, 2, 3 HAVING count(*) % 7 <> 0)"


def _products(spark: SparkSession, d: str) -> DataFrame:
    """What runs gave: some runs have nothing."""
    return study(spark, d).groupBy(*RUN).agg(r6(F.avg("value")).alias("x"), F.count(F.lit(1)).alias("n")).where("n % 7 <> 0").drop("n")


@query(spread(EV, ST, SEG, PRODUCTS) + "SELECT subject, session, task, CAST(row_number() OVER (PARTITION BY subject ORDER BY session, task) - 1 AS INTEGER) AS seg_no, x FROM seg LEFT JOIN pr USING (subject, session, task) QUALIFY count(x) OVER (PARTITION BY subject) = count(*) OVER (PARTITION BY subject)")
def product_join_complete(spark: SparkSession, d: str) -> DataFrame:
    """Subjects with a run missing are left out."""
    return Rn.product_join(segments(spark, d), _products(spark, d), ("subject",), ("session", "task"), "abort").select(*RUN, "seg_no", "x")


@query(spread(EV, ST, SEG, PRODUCTS) + "SELECT subject, session, task, seg_no, x FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY session, task) - 1 AS INTEGER) AS seg_no FROM seg) JOIN pr USING (subject, session, task)")
def product_join_skip(spark: SparkSession, d: str) -> DataFrame:
    """Runs that are missing are left out."""
    return Rn.product_join(segments(spark, d), _products(spark, d), ("subject",), ("session", "task"), "skip").select(*RUN, "seg_no", "x")


CONDITION = "CASE k % 6 WHEN 0 THEN 'word_list' WHEN 1 THEN 'sentence' WHEN 2 THEN 'story' END"


@query(spread(EV, ST) + f"SELECT event_no, {CONDITION} AS condition FROM st WHERE coalesce({CONDITION}, 'story') <> 'word_list'")
def condition_filter(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("k") % 6 == 0, "word_list").when(F.col("k") % 6 == 1, "sentence").when(F.col("k") % 6 == 2, "story")
    return Rn.without_condition(study(spark, d).withColumn("condition", c)).select("event_no", "condition")


@query(spread(EV, ST) + "SELECT event_no, CAST(sample AS DOUBLE) AS sample, duration FROM st WHERE k % 10 NOT IN (0, 1, 2)")
def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose sample or duration isn't a finite number are skipped."""
    bad = F.when(F.col("k") % 10 == 0, "n/a").when(F.col("k") % 10 == 1, "nan").when(F.col("k") % 10 == 2, "inf")
    raw = study(spark, d).select("event_no", F.coalesce(bad, F.col("sample").cast("string")).alias("sample"), F.col("duration").cast("string").alias("duration"))
    return raw.select("event_no", Src.number(F.col("sample")).alias("sample"), Src.number(F.col("duration")).alias("duration")).dropna()


@query(spread(EV, ST, "s AS (SELECT subject, session, task, sample AS t, sum(value) AS x FROM st GROUP BY ALL)", "o AS (SELECT DISTINCT subject, session, task, sample AS onset FROM st WHERE kind = 'signup')", "e AS (SELECT o.*, t - onset AS lag, x FROM o JOIN s USING (subject, session, task) WHERE t - onset BETWEEN -200 AND 600 AND (t - onset) % 10 = 0)") + "SELECT subject, session, task, onset, CAST(lag AS INTEGER) AS lag, round(x - coalesce(avg(x) FILTER (WHERE lag <= 0) OVER (PARTITION BY subject, session, task, onset), 0), 6) + 0.0 AS x FROM e")
def epoch_decimated(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth point around the onsets of a run, its baseline up to the onset itself."""
    st = study(spark, d)
    series = st.groupBy(*RUN, F.col("sample").cast("int").alias("t")).agg(F.sum("value").alias("x"))
    onsets = st.where("kind = 'signup'").select(*RUN, F.col("sample").cast("int").alias("onset")).distinct()
    return T.epochs(series, onsets, 200, 600, RUN, 10, 0).select(*RUN, "onset", "lag", r6("x").alias("x"))


_TAPS = [round(float(x), 9) for x in N.lowpass_taps(3, 10)]


@query(spread(EV, "s AS (SELECT subject, t, sum(value) AS x FROM ev GROUP BY 1, 2)", f"h AS (SELECT unnest({_TAPS}::DOUBLE[]) * 2 AS h, unnest(range({len(_TAPS)})) AS j)") + f"SELECT subject, CAST((t * 2 + j - {len(_TAPS) // 2}) // 3 AS INTEGER) AS t, round(sum(x * h), 6) + 0.0 AS x FROM s, h WHERE (t * 2 + j - {len(_TAPS) // 2}) % 3 = 0 AND t * 2 + j - {len(_TAPS) // 2} BETWEEN 0 AND 239 GROUP BY 1, 2")
def polyphase_rational(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the rate, by the taps of a filter at twice the rate."""
    series = D.events(spark, d).groupBy("subject", "t").agg(F.sum("value").alias("x"))
    return T.resample(series, 2, 3, _TAPS, POINTS, ("subject",)).select("subject", "t", r6("x").alias("x"))


CLIPS = "cl AS (SELECT CAST(vec_id AS INTEGER) AS clip, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS samples FROM embeddings)"
PLACES = "pl AS (SELECT event_id AS seg_no, CAST(event_id % 500 AS INTEGER) AS clip, (event_id * 7 % 3000) / 10.0::DOUBLE AS onset, (k % 5) / 10.0::DOUBLE AS audio_onset, (k % 5 + 20) / 10.0::DOUBLE AS audio_offset FROM ev)"


@query(spread(EV, CLIPS, PLACES, "x AS (SELECT seg_no, CAST(round_even(onset * 10, 0) AS INTEGER) AS start, samples[CAST(round_even(audio_onset * 10, 0) AS INTEGER) + 1 : CAST(round_even(audio_offset * 10, 0) AS INTEGER)] AS part FROM pl JOIN cl USING (clip))", "y AS (SELECT seg_no, start + unnest(range(len(part))) AS t, unnest(part) AS x FROM x)") + "SELECT CAST(t AS INTEGER) AS t, round(arg_max(x, seg_no), 6) + 0.0 AS x FROM y WHERE t BETWEEN 0 AND 2999 GROUP BY 1")
def audio_placement(spark: SparkSession, d: str) -> DataFrame:
    """Parts of clips (a vector stands for a clip) at their onsets; later segments win."""
    clips = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("clip"), F.lit(TARGET).alias("rate"), F.col("embedding").cast("array<double>").alias("samples"))
    e = F.col("event_id")
    places = D.events(spark, d).select(e.alias("seg_no"), (e % 500).cast("int").alias("clip"), ((e * 7) % 3000 / F.lit(10.0)).alias("onset"), (F.col("k") % 5 / F.lit(10.0)).alias("audio_onset"), ((F.col("k") % 5 + 20) / F.lit(10.0)).alias("audio_offset"))
    return T.place_clips(places, clips, TARGET, 3000).select("t", r6("x").alias("x"))


@query(spread(EV, "e AS (SELECT subject, t, value FROM ev)", "a AS (SELECT subject, t, greatest(least(value, q), -q) AS value FROM e, (SELECT quantile_cont(abs(value), 0.95) AS q FROM e))", "b AS (SELECT subject, t, value - coalesce(avg(value) FILTER (WHERE t < 20) OVER (PARTITION BY subject), 0) AS value FROM a)", "c AS (SELECT subject, t, greatest(least(value, q), -q) AS value FROM b, (SELECT quantile_cont(abs(value), 0.95) AS q FROM b))", "z AS (SELECT subject, t, value - coalesce(avg(value) FILTER (WHERE t < 20) OVER (PARTITION BY subject), 0) AS value FROM c)") + "SELECT subject, t, round(sum(value), 5) + 0.0 AS total, count(*) AS n FROM z GROUP BY 1, 2")
def clip_twice(spark: SparkSession, d: str) -> DataFrame:
    """Clipped and brought to the baseline, twice."""
    out = St.clip_twice(D.events(spark, d).select("subject", "t", "value"), "value", 0.95, ("subject",), F.col("t") < 20)
    return out.groupBy("subject", "t").agg((F.round(F.sum("value"), 5) + 0.0).alias("total"), F.count(F.lit(1)).alias("n"))


# All subjects and models in one plan.


BY_SUBJECT = ("subject",)
GRID = f"grid AS (SELECT subject, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT subject FROM ev), range({POINTS}) g(t))"
S_NEU = "sn AS (SELECT g.subject, g.t, [" + ", ".join(f"coalesce(sum(value) FILTER (WHERE event_type = '{c}'), 0.0)" for c in CHANNELS) + "] AS f FROM grid g LEFT JOIN ev ON ev.subject = g.subject AND ev.t = g.t GROUP BY 1, 2)"
S_MOD = "sm AS (SELECT signal, g.subject, g.t, CASE signal WHEN 'Envelope' THEN [coalesce(sum(value), 0.0)] WHEN 'GloVe' THEN [" + ", ".join(f"CAST(coalesce(sum(k) FILTER (WHERE event_type = '{c}'), 0) + {i} AS DOUBLE)" for i, c in enumerate(CHANNELS)) + "] ELSE [" + ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{c}') % 3 AS DOUBLE)" for c in CHANNELS) + "] END AS f FROM grid g LEFT JOIN ev ON ev.subject = g.subject AND ev.t = g.t, (VALUES ('Envelope'), ('GloVe'), ('Phoneme Voicing')) s(signal) GROUP BY 1, 2, 3)"
S_WIN = f"sw AS (SELECT subject, CAST(i AS INTEGER) AS iteration, CAST(s AS INTEGER) AS start, CAST(row_number() OVER (PARTITION BY subject, i ORDER BY md5(concat_ws('|', '7', subject, i, s)), s) - 1 AS INTEGER) AS win FROM (SELECT DISTINCT subject FROM ev), range(2) a(i), range({POINTS - LENGTH + 1}) b(s) QUALIFY win < 8)"


def _z(name: str, source: str, distance: str, extra: str = "") -> str:
    keys = f"subject, {extra}iteration, o"
    return f"g{name} AS (SELECT sw.subject, {extra}iteration, win, CAST(o AS INTEGER) AS o, f FROM sw, range({LENGTH}) c(o), {source} x WHERE x.subject = sw.subject AND x.t = start + o), d{name} AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.win AS i, b.win AS j, {distance} AS d FROM g{name} a JOIN g{name} b USING ({keys}) WHERE a.win < b.win), z{name} AS (SELECT {keys}, i, j, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS z FROM d{name} WINDOW w AS (PARTITION BY {keys}))"


MODEL_DISTANCE = f"CASE WHEN a.signal = 'GloVe' THEN {D.DISTANCE['correlation']} ELSE {D.DISTANCE['euclidean']} END"
S_EACH = "se AS (SELECT n.subject, signal, iteration, n.o AS t_neural, m.o AS t_model, avg(n.z * m.z) AS r FROM zn n JOIN zm m USING (subject, iteration, i, j) GROUP BY 1, 2, 3, 4, 5), sr AS (SELECT subject, signal, t_neural, t_model, avg(r) AS r FROM se GROUP BY 1, 2, 3, 4)"
STUDY_RSA = spread(EV, GRID, S_NEU, S_MOD, S_WIN, _z("n", "sn", D.DISTANCE["euclidean"]), _z("m", "sm", MODEL_DISTANCE, "signal, "), S_EACH)


def dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows, neural signals and models of all subjects on whole grids."""
    ev = D.events(spark, d)
    grid = ev.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("t"))
    each = ev.groupBy("subject", "t").agg(F.sum("value").alias("all"), *[F.sum(F.when(F.col("event_type") == c, F.col("value"))).alias(f"v_{c}") for c in CHANNELS], *[F.sum(F.when(F.col("event_type") == c, F.col("k"))).alias(f"k_{c}") for c in CHANNELS], *[F.count(F.when(F.col("event_type") == c, 1)).alias(f"n_{c}") for c in CHANNELS])
    rows = grid.join(each, ["subject", "t"], "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    neural = rows.select("subject", "t", F.array(*[whole(f"v_{c}") for c in CHANNELS]).alias("features"))
    kinds = {"Envelope": F.array(whole("all")), "GloVe": F.array(*[whole(f"k_{c}") + i for i, c in enumerate(CHANNELS)]), "Phoneme Voicing": F.array(*[whole(f"n_{c}") % 3 for c in CHANNELS])}
    models = rows.select("subject", "t", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("features")) for k, v in kinds.items()])).alias("m")).select("subject", "m.signal", "t", "m.features")
    starts = grid.where(F.col("t") <= POINTS - LENGTH).select("subject", F.col("t").alias("start"))
    return Win.draw_windows(starts, 2, 8, D.SEED, BY_SUBJECT), neural, models


def _study_matrix(spark: SparkSession, d: str, wanted: str = "") -> DataFrame:
    windows, neural, models = dense(spark, d)
    chosen = Reg.selected(Reg.MODELS, wanted)
    models = models.where(F.col("signal").isin([m.label for m in chosen]))
    metric = Reg.metric_column(chosen, F.col("signal"))
    zn = R.zscored(R.rdm(windows, neural, LENGTH, "euclidean", BY_SUBJECT), "d", ("subject", "iteration", "offset"))
    zm = R.zscored(R.rdm(windows, models, LENGTH, metric, BY_SUBJECT, ("signal",)), "d", ("subject", "signal", "iteration", "offset"))
    return S.rsa(zn, zm, BY_SUBJECT, ("signal",))


@query(STUDY_RSA + f"SELECT subject, signal, t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM sr WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1, 2, 3")
def study_lag_curves(spark: SparkSession, d: str) -> DataFrame:
    """The lag curves of every subject and registered model, each by its own metric, in one plan."""
    return S.lag_curve(_study_matrix(spark, d), REACH, ("subject", "signal")).select("subject", "signal", "lag", r6("r").alias("r"))


@query(STUDY_RSA + "SELECT subject, t_neural, t_model, round(r, 6) + 0.0 AS r FROM sr WHERE signal = 'Envelope'")
def study_matrix_block(spark: SparkSession, d: str) -> DataFrame:
    """The same by blocks, of one model."""
    windows, neural, models = dense(spark, d)
    model = models.where("signal = 'Envelope'").drop("signal")
    return S.similarity(windows, neural, model, 2, 8, LENGTH, by=BY_SUBJECT, path="block").select("subject", "t_neural", "t_model", r6("r").alias("r"))


@query(STUDY_RSA + "SELECT subject, t_neural, t_model, round(r, 6) + 0.0 AS r FROM sr WHERE signal = 'Envelope'")
def study_matrix_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The same by the path that the number of joined rows asks for."""
    windows, neural, models = dense(spark, d)
    model = models.where("signal = 'Envelope'").drop("signal")
    return S.similarity(windows, neural, model, 2, 8, LENGTH, by=BY_SUBJECT).select("subject", "t_neural", "t_model", r6("r").alias("r"))


@query(STUDY_RSA + f", cv AS (SELECT subject, signal, t_neural - t_model AS lag, avg(r) AS r FROM sr WHERE signal IN ('Envelope', 'GloVe') AND abs(t_neural - t_model) <= {REACH} GROUP BY 1, 2, 3) SELECT signal, lag, count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r) / sqrt(count(r)), 6) AS sem FROM cv GROUP BY 1, 2")
def study_group_curves(spark: SparkSession, d: str) -> DataFrame:
    """The cohort's curves of the models that a filter names, whatever the case."""
    curves = S.lag_curve(_study_matrix(spark, d, "envelope, GLOVE"), REACH, ("subject", "signal"))
    return St.mean_sem(curves, ("signal", "lag")).select("signal", "lag", "n", r6("mean").alias("mean"), r6("sem").alias("sem"))


NOISE208 = f"n208 AS (SELECT CAST(t AS INTEGER) AS t, list(sqrt(-2 * ln({uniform_sql(chr(39) + '41' + chr(39), 't', 'c', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql(chr(39) + '41' + chr(39), 't', 'c', chr(39) + 'b' + chr(39))}) ORDER BY c) AS f FROM range({POINTS}) a(t), range(208) b(c) GROUP BY t)"
SIMS = "sims AS (SELECT 'Random Noise 208' AS signal, t, f FROM n208 UNION ALL SELECT 'Random Noise 1', t, [list_avg(f)] FROM n208 UNION ALL SELECT 'Neural', t, f FROM neu UNION ALL SELECT 'Envelope', t, f FROM model)"


def _sim_z(name: str, where: str) -> str:
    correlation = "a.signal = 'Random Noise 208'"
    return f"g{name} AS (SELECT signal, iteration, win, CAST(o AS INTEGER) AS o, f FROM win, range({LENGTH}) c(o), sims WHERE sims.t = start + o AND {where}), d{name} AS (SELECT signal, iteration, a.o, a.win AS i, b.win AS j, CASE WHEN {correlation} THEN {D.DISTANCE['correlation']} ELSE {D.DISTANCE['euclidean']} END AS d FROM g{name} a JOIN g{name} b USING (signal, iteration, o) WHERE a.win < b.win), z{name} AS (SELECT signal, iteration, o, i, j, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS z FROM d{name} WINDOW w AS (PARTITION BY signal, iteration, o))"


@query(spread(EV, NEURAL, MODEL, WIN, NOISE208, SIMS, _sim_z("a", "true"), "ea AS (SELECT n.signal AS source, m.signal, iteration, n.o AS t_neural, m.o AS t_model, avg(n.z * m.z) AS r FROM za n JOIN za m USING (iteration, i, j) WHERE m.signal = 'Envelope' OR n.signal = m.signal GROUP BY 1, 2, 3, 4, 5)", "ra AS (SELECT source, signal, t_neural, t_model, avg(r) AS r FROM ea GROUP BY 1, 2, 3, 4)") + f"SELECT source, signal, t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM ra WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1, 2, 3")
def simulation_curves(spark: SparkSession, d: str) -> DataFrame:
    """Each simulation as the neural side: noise of 208 channels, its mean, the signal itself, a model; against the model and against itself."""
    ev, windows = D.events(spark, d), D.windows(spark)
    t = spark.range(POINTS).select(F.col("id").cast("int").alias("t"))
    noise = t.select("t", F.transform(F.sequence(F.lit(0), F.lit(207)), lambda c: X.hash_normal(F.lit(41), F.col("t"), c)).alias("features"))
    single = noise.select("t", F.array(F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / 208).alias("features"))
    named = {"Random Noise 208": noise, "Random Noise 1": single, "Neural": D.neural(ev), "Envelope": D.model(ev)}
    signals = None
    for k, x in named.items():
        one = x.select(F.lit(k).alias("signal"), "t", "features")
        signals = one if signals is None else signals.unionByName(one)
    metric = F.when(F.col("signal") == "Random Noise 208", "correlation").otherwise("euclidean")
    z = R.zscored(R.rdm(windows, signals, LENGTH, metric, (), ("signal",)), "d", ("signal", "iteration", "offset"))
    n = z.withColumnRenamed("signal", "source")
    keys = ["iteration", "i", "j"]
    a, b = n.select("source", *keys, F.col("offset").alias("t_neural"), F.col("z").alias("zn")), z.select("signal", *keys, F.col("offset").alias("t_model"), F.col("z").alias("zm"))
    pairs = a.join(b, keys).where((F.col("signal") == "Envelope") | (F.col("signal") == F.col("source")))
    each = pairs.groupBy("source", "signal", "iteration", "t_neural", "t_model").agg(F.avg(F.col("zn") * F.col("zm")).alias("r"))
    return S.lag_curve(each.groupBy("source", "signal", "t_neural", "t_model").agg(F.avg("r").alias("r")), REACH, ("source", "signal")).select("source", "signal", "lag", r6("r").alias("r"))


@query(spread("p AS (SELECT * FROM (VALUES ('Envelope', 1), ('GloVe', 2), ('Word Frequency', 0)) v(signal, border))", f"c AS (SELECT CAST(t AS INTEGER) AS t_model, CAST(o AS INTEGER) AS t FROM range({LENGTH}) a(t), range({LENGTH}) b(o) WHERE abs(t - o) <= 4)") + "SELECT w.signal AS signal, t_model, p.signal AS predictor, t FROM p w, p, c WHERE CASE WHEN p.signal = w.signal THEN t = t_model OR abs(t - t_model) > w.border ELSE true END")
def design_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which model at which offset predicts: the model itself at its offset, others within reach, its own beyond its border."""
    borders = spark.createDataFrame([("Envelope", 1), ("GloVe", 2), ("Word Frequency", 0)], "signal string, border int")
    return Reg.design_columns(borders, LENGTH, 4)


@query(spread(EV, MODEL, WIN, D.rsa_sql("model", "model")) + f"SELECT CAST(least(coalesce(max(lag) FILTER (WHERE r > 0.05), 0), {REACH}) AS INTEGER) AS border FROM (SELECT t_neural - t_model AS lag, avg(r) AS r FROM rsa WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1)")
def regression_border_legacy(spark: SparkSession, d: str) -> DataFrame:
    z = D.rdm_z(spark, D.model(D.events(spark, d)))
    return S.border(S.lag_curve(S.rsa(z, z), REACH), 0.05, REACH, legacy=True)


RESULTS = "re AS (SELECT subject, lag, r, origin, label, model FROM curve, (VALUES ('base', '', 'Envelope'), ('base', '', 'GloVe'), ('model', 'GloVe', 'Envelope'), ('noise', 'Random Noise 1', 'Envelope')) v(origin, label, model))"


def _results(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(lb).alias("label"), F.lit(m).alias("model")) for o, lb, m in (("base", "", "Envelope"), ("base", "", "GloVe"), ("model", "GloVe", "Envelope"), ("noise", "Random Noise 1", "Envelope"))])
    rows = D.group_curve(D.events(spark, d)).withColumn("x", F.explode(kinds))
    return rows.select("subject", "x.*", F.lit(None).cast("string").alias("neural"), "lag", "r")


@query(spread(EV, CURVE, RESULTS) + "SELECT subject, 'Neural 1' AS neural, model, lag, round(r, 6) + 0.0 AS r FROM re WHERE origin = 'base' AND lower(model) IN ('envelope', 'glove')")
def subject_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of the models that are asked for; those without a neural label get one."""
    return Rn.subject_results(_results(spark, d), ["ENVELOPE", "glove"]).select("subject", "neural", "model", "lag", r6("r").alias("r"))


@query(spread(EV, CURVE, RESULTS) + "SELECT subject, 'Neural 1' AS neural, model, lag, round(r, 6) + 0.0 AS r FROM re WHERE origin = 'noise' AND label = 'Random Noise 1'")
def simulation_results(spark: SparkSession, d: str) -> DataFrame:
    return Rn.subject_results(_results(spark, d), ["Envelope"], origin="noise", label="Random Noise 1").select("subject", "neural", "model", "lag", r6("r").alias("r"))


@query(spread(EV, WIN, "c AS (SELECT iteration, CAST(start + o AS INTEGER) AS t, count(*) AS n FROM win, range(12) r(o) GROUP BY 1, 2)") + "SELECT 'coverage' AS kind, iteration, t, n FROM c WHERE t BETWEEN 30 AND 60 UNION ALL SELECT 'onset', NULL, t, count(*) FROM ev WHERE event_type = 'signup' AND t BETWEEN 30 AND 60 GROUP BY t")
def coverage_zoom(spark: SparkSession, d: str) -> DataFrame:
    on = D.events(spark, d).where("event_type = 'signup'").select("t")
    return Rn.zoomed(Win.coverage(D.windows(spark), LENGTH), on, 30, 60)


# Words and tokens.


@query("WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS x FROM embeddings) SELECT count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean FROM n")
def norm_summary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "embeddings").select(X.l2(F.col("embedding").cast("array<double>")).alias("x"))
    return n.agg(F.count(F.lit(1)).alias("n"), r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"), r6(F.avg("x")).alias("mean"))


PIECES = "pc AS (SELECT doc, pos, (length(token) + CASE WHEN pos > 0 THEN 1 ELSE 0 END + 3) // 4 AS n FROM tok)"


@query(spread(D.TOKENS, PIECES) + "SELECT doc, CAST(pos AS INTEGER) AS pos, CAST(coalesce(sum(n) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(n AS INTEGER) AS n FROM pc")
def tokenise_run(spark: SparkSession, d: str) -> DataFrame:
    """Where each word's tokens begin and how many there are; every word but a story's first has a space before it."""
    return Ft.tokenise_run(D.tokens(spark, d), Ft.fixed_pieces(4)).select("doc", "pos", "start", F.size("pieces").alias("n"))


ASSEMBLE = "aw AS (SELECT event_no, subject, (k % 11) = 0 AS listed, start, stop, 1 + event_no % 3 AS parts, value FROM (SELECT event_id AS event_no, subject, t AS start, t + greatest(k % 4, 1) AS stop, k, value FROM ev)), aj AS (SELECT *, unnest(range(parts)) AS j FROM aw WHERE NOT listed), ai AS (SELECT *, start + (j * (stop - start)) // parts AS a, greatest(start + ((j + 1) * (stop - start)) // parts, start + (j * (stop - start)) // parts + 1) AS b FROM aj), ap AS (SELECT subject, event_no, j, value * (j + 1) AS v, unnest(range(a, least(b, 120))) AS t FROM ai WHERE a < least(b, 120)), al AS (SELECT subject, t, arg_max(v, (event_no, j)) AS v FROM ap GROUP BY 1, 2), asd AS (SELECT subject, sqrt(greatest(var_pop(v), 1e-12)) AS sd FROM al GROUP BY 1)"


@query(spread(EV, GRID, ASSEMBLE) + f"SELECT g.subject, g.t, round(coalesce(v, sd * 0.1 * sqrt(-2 * ln({uniform_sql(chr(39) + '3' + chr(39), 'g.subject', 'g.t', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql(chr(39) + '3' + chr(39), 'g.subject', 'g.t', chr(39) + 'b' + chr(39))})), 6) + 0.0 AS x, v IS NOT NULL AS covered FROM grid g JOIN asd USING (subject) LEFT JOIN al ON al.subject = g.subject AND al.t = g.t")
def assemble_subject(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of words on each subject's grid; words of lists are left out, gaps get noise of the covered points' deviation."""
    ev = D.events(spark, d)
    words = ev.select(F.col("event_id").alias("event_no"), "subject", (F.col("k") % 11 == 0).alias("listed"), F.col("t").alias("start"), (F.col("t") + F.greatest(F.col("k") % 4, F.lit(1))).alias("stop"), "value").where("not listed")
    tokens = Ft.split_interval(words, 1 + F.col("event_no") % 3).withColumn("x", F.col("value") * (F.col("j") + 1))
    grid = ev.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("t"))
    return Rn.assemble(tokens, grid, POINTS, 0.1, 3).select("subject", "t", r6("x").alias("x"), "covered")


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT round(sum(s), 6) AS total, count(*) AS components FROM (SELECT var_samp(v) AS s FROM x GROUP BY dim)")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """The principal components' variances have the sum of the features' own."""
    var, _, _ = Ft.pca_basis(table(spark, d, "embeddings"), "embedding", 64)
    return spark.createDataFrame([(round(float(var.sum()), 6), len(var))], "total double, components long")


# Sensors, names, maps.


SIDES = "si AS (SELECT s_suppkey AS line_no, CASE s_suppkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'central' END AS side, 'MEG ' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS channel FROM supplier)"


def _sides(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    side = F.when(F.col("s_suppkey") % 3 == 0, "left").when(F.col("s_suppkey") % 3 == 1, "right").otherwise("central")
    return s.select(F.col("s_suppkey").alias("line_no"), side.alias("side"), F.concat(F.lit("MEG "), F.lpad(F.col("s_nationkey").cast("string"), 3, "0")).alias("channel"))


@query(spread(SIDES) + "SELECT channel, CAST(row_number() OVER (ORDER BY part, line_no) - 1 AS INTEGER) AS place FROM (SELECT channel, min(CASE side WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END) AS part, arg_min(line_no, (CASE side WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END, line_no)) AS line_no FROM si GROUP BY 1)")
def cohort_union(spark: SparkSession, d: str) -> DataFrame:
    """Left, right and central sensors in this order, each once."""
    return Rn.sensor_union(_sides(spark, d))


@query(spread(SIDES) + "SELECT side, channel, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS INTEGER) END AS place, n_nationkey % 4 = 0 AS missing FROM (SELECT DISTINCT side, channel FROM si) JOIN nation ON channel = 'MEG ' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')")
def sensor_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the sensors of each side are in the recording, and which of them it hasn't."""
    there = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.concat(F.lit("meg  "), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("channel"), F.col("n_nationkey").cast("int").alias("place"))
    return Rn.sensor_places(_sides(spark, d), there)


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' / v.' || p_size || '?', '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_.-') AS name FROM part")
def analysis_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" / v."), F.col("p_size").cast("string"), F.lit("?"))
    return table(spark, d, "part").select("p_partkey", X.analysis_name(raw).alias("name"))


@query("SELECT DISTINCT user_id, 'ses-' || (user_id % 2) AS session, 'task-' || (user_id % 4) AS task FROM events")
def label_prefixes(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    session = F.when(u % 3 == 0, (u % 2).cast("string")).otherwise(F.concat(F.lit("ses-"), u % 2))
    return table(spark, d, "events").select("user_id", X.prefixed(session, "ses-").alias("session"), X.prefixed((u % 4).cast("string"), "task-").alias("task")).distinct()


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS s, CAST(CAST(floor(o_totalprice) AS BIGINT) * 8 AS DOUBLE) AS b FROM orders)")
def pretty_amounts(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long")
    return table(spark, d, "orders").select("o_orderkey", X.duration_text((n % 9000).cast("double")).alias("duration"), X.size_text((n * 8).cast("double")).alias("size"))


@query(spread(EV) + "SELECT t, [round(sum(value), 6)] AS features, 1 AS axes FROM ev GROUP BY t")
def promote_series(spark: SparkSession, d: str) -> DataFrame:
    """A series of numbers as one of vectors with one feature."""
    return X.promoted(D.events(spark, d).groupBy("t").agg(r6(F.sum("value")).alias("x")), "x").select("t", "features", F.size("features").alias("axes"))


@query(spread(EV) + "SELECT event_type AS kind, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN 5 ELSE 0 END AS code, count(*) AS n FROM ev GROUP BY 1, 2")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Later maps win over earlier ones."""
    codes = X.merged_map({"click": 1, "error": -1, "signup": 2}, {"signup": 5})
    return D.events(spark, d).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select("kind", F.coalesce(F.try_element_at(codes, "kind"), F.lit(0)).alias("code"), "n")


# Files.


@query("SELECT vec_id, len(embedding) AS dim, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE), 4) AS DOUBLE))) * 10000) AS BIGINT) AS total FROM embeddings WHERE label <> 3")
def vector_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a vector file: only tokens of the vocabulary go on."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 4).cast("string")).alias("v"))
    lines = e.select(F.col("vec_id").alias("line"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join("v", " ")).alias("value"))
    vocabulary = e.where("label <> 3").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("token"))
    out = Src.vectors_of(lines, vocabulary)
    return out.select(F.substring("token", 2, 20).cast("long").alias("vec_id"), F.size("vector").alias("dim"), F.rint(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) * 10000).cast("long").alias("total"))


@query(spread(EV) + "SELECT user_id % 8 AS subject, CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY user_id) - 1 AS INTEGER) AS seg_no, CAST(user_id AS VARCHAR) AS session, CAST(n AS INTEGER) AS n_times FROM (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)")
def manifest_order(spark: SparkSession, d: str) -> DataFrame:
    """Segments of manifests, one a subject, in the order of their lists."""
    n = D.events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct("user_id", F.concat(F.lit('{"session": "'), F.col("user_id").cast("string"), F.lit('", "n_times": '), F.col("n").cast("string"), F.lit("}")).alias("json"))
    text = n.groupBy((F.col("user_id") % 8).alias("subject")).agg(F.sort_array(F.collect_list(item)).alias("s"))
    text = text.select("subject", F.concat(F.lit('{"segments": ['), F.array_join(F.transform("s", lambda x: x["json"]), ", "), F.lit("]}")).alias("json"))
    return Src.manifest_of(text, "session string, n_times int", ("subject",))


@query(spread(EV) + "SELECT event_id, event_type AS kind, sec + 0.0 AS onset, k FROM ev WHERE k % 5 <> 0")
def events_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an events table; rows whose literal can't be read are skipped."""
    ev = D.events(spark, d)
    literal = F.when(F.col("k") % 5 == 0, "{'kind': ").otherwise(F.concat(F.lit("{'kind': '"), "event_type", F.lit("', 'word': None, 'k': "), F.col("k").cast("string"), F.lit("}")))
    lines = ev.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.col("sec").cast("string"), literal).alias("value"))
    rows = Src.events_of(lines, "event_id long, onset double, trial_type string", "kind string, word string, k int")
    return rows.select("event_id", "kind", "onset", "k")




# Control.


@query()
def pcr_components(spark: SparkSession, d: str) -> DataFrame:
    """How many components the fits took: two models, offsets within reach."""
    ev, windows = D.events(spark, d), D.windows(spark)
    blocks = [R.rdm_blocks(windows, x, LENGTH, "euclidean") for x in (D.neural(ev), D.model(ev), D.counts(ev))]
    return G.component_counts(G.fits(blocks[0], {"envelope": blocks[1], "counts": blocks[2]}, {"envelope": 1, "counts": 1}, 2, "pcr"), ("model",))


@query(spread(SIDES) + "SELECT side, channel FROM (SELECT DISTINCT side, channel FROM si)")
def sensor_file(spark: SparkSession, d: str) -> DataFrame:
    """A selection written as a sectioned list and read again."""
    return Src.sensor_set(C.sensor_lines(_sides(spark, d).groupBy("side", "channel").agg(F.min("line_no").alias("line_no")))).select("side", "channel")


@query("SELECT 'correlation, GloVe; 3 x 10 windows of 12 s at 1 Hz, lags to 6 s' AS caption, 12 AS length, 6 AS reach, count(*) AS n FROM events")
def caption(spark: SparkSession, d: str) -> DataFrame:
    s = C.Settings(subsamples=D.WINDOWS, iterations=D.ITERATIONS, window_seconds=12.0, averaging_seconds=6.0, rate=1.0, models="GloVe").checked()
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.caption()).alias("caption"), F.lit(s.length).alias("length"), F.lit(s.reach).alias("reach"), "n")


@query("SELECT event_type AS kind, count(*) AS n_rows, 'event_id,ts,user_id,event_type,value,props' AS columns, sha1('{\"alpha\": 0.05}') AS params_hash FROM events GROUP BY 1")
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A record of settings beside each product."""
    return sinks.run_metadata(table(spark, d, "events"), {"alpha": 0.05}, ("event_type",)).select(F.col("event_type").alias("kind"), "n_rows", "columns", "params_hash")
