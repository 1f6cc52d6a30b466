"""The analysis' tables on the bundled ones: events as a recording, words and stories from documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rdm as R
from ..operators import windows as Win
from ..sources.tables import table

#: Points of six hours from 2024-01-01 on.
POINTS, BIN, EPOCH = 120, 21600, 1704067200
CHANNELS = ("click", "error", "purchase", "signup", "view")
LENGTH, WINDOWS, ITERATIONS, REACH, SEED = 12, 10, 3, 6, 7


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", sec.alias("sec"), F.floor(sec / BIN).cast("int").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("user_id") % 8).alias("subject"))


def neural(ev: DataFrame) -> DataFrame:
    return ev.groupBy("t").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("event_type") == c, F.col("value"))), F.lit(0.0)) for c in CHANNELS]).alias("features"))


def model(ev: DataFrame) -> DataFrame:
    return ev.groupBy("t").agg(F.array(F.sum("value")).alias("features"))


def counts(ev: DataFrame) -> DataFrame:
    return ev.groupBy("t").agg(F.array(*[(F.count(F.when(F.col("event_type") == c, 1)) % 3).cast("double") for c in CHANNELS]).alias("features"))


def mask(ev: DataFrame) -> DataFrame:
    return ev.groupBy("t").agg((10 * F.count_if(F.col("event_type") == "error") <= 3 * F.count(F.lit(1))).alias("valid"))


def windows(spark: SparkSession) -> DataFrame:
    starts = spark.range(POINTS - LENGTH + 1).select(F.col("id").cast("int").alias("start"))
    return Win.draw_windows(starts, ITERATIONS, WINDOWS, SEED)


def rdm_z(spark: SparkSession, trajectory: DataFrame, metric: str = "euclidean") -> DataFrame:
    return R.zscored(R.rdm(windows(spark), trajectory, LENGTH, metric), "d", ("iteration", "offset"))


def group_curve(ev: DataFrame) -> DataFrame:
    all_mean = ev.agg(F.avg("value").alias("m"))
    return ev.groupBy("subject", (F.col("t") % 13 - 6).alias("lag")).agg(F.avg("value").alias("a")).join(F.broadcast(all_mean), F.lit(True)).select("subject", "lag", (F.col("a") - F.col("m")).alias("r"))


def group_matrix(ev: DataFrame) -> DataFrame:
    all_mean = ev.agg(F.avg("value").alias("m"))
    return ev.groupBy("subject", (F.col("t") % 12).alias("t_neural"), F.floor(F.col("t") / 12).cast("int").alias("t_model")).agg(F.avg("value").alias("a")).join(F.broadcast(all_mean), F.lit(True)).select("subject", "t_neural", "t_model", (F.col("a") - F.col("m")).alias("r"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, pos, token of the conversations' words, turn by turn."""
    c = table(spark, sf_dir, "conversations")
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.posexplode(w).alias("pos", "token"))


def word_events(ev: DataFrame) -> DataFrame:
    """event_no, start, stop, place (of its vector), covering k points."""
    return ev.select(F.col("event_id").alias("event_no"), F.col("t").alias("start"), (F.col("t") + F.greatest(F.col("k") % 4, F.lit(1))).alias("stop"), (F.col("event_id") % 500).alias("place"), "value")


EV = """ev AS (SELECT event_id, user_id, event_type, value, epoch(ts) - 1704067200 AS sec, CAST(floor((epoch(ts) - 1704067200) / 21600) AS INTEGER) AS t,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 8 AS subject FROM events)"""
NEURAL = "neu AS (SELECT t, [" + ", ".join(f"coalesce(sum(value) FILTER (WHERE event_type = '{c}'), 0.0)" for c in CHANNELS) + "] AS f FROM ev GROUP BY t)"
MODEL = "model AS (SELECT t, [sum(value)] AS f FROM ev GROUP BY t)"
COUNTS = "counts AS (SELECT t, [" + ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{c}') % 3 AS DOUBLE)" for c in CHANNELS) + "] AS f FROM ev GROUP BY t)"
MASK = "mask AS (SELECT t, 10 * count(*) FILTER (WHERE event_type = 'error') <= 3 * count(*) AS valid FROM ev GROUP BY t)"
WIN = f"""win AS (SELECT iteration, win, start FROM (SELECT CAST(i AS INTEGER) AS iteration, CAST(s AS INTEGER) AS start,
 CAST(row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws('|', '{SEED}', i, s)), s) - 1 AS INTEGER) AS win FROM range({ITERATIONS}) a(i), range({POINTS - LENGTH + 1}) b(s)) WHERE win < {WINDOWS})"""
CURVE = "curve AS (SELECT subject, t % 13 - 6 AS lag, avg(value) - (SELECT avg(value) FROM ev) AS r FROM ev GROUP BY 1, 2)"
MATRIX = "cells AS (SELECT subject, t % 12 AS t_neural, t // 12 AS t_model, avg(value) - (SELECT avg(value) FROM ev) AS r FROM ev GROUP BY 1, 2, 3)"
TOKENS = r"""raw AS (SELECT conv_id * 1000 + turn AS doc, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM conversations),
tok AS (SELECT doc, unnest(range(len(w))) AS pos, unnest(w) AS token FROM raw)"""
WORDS = "we AS (SELECT event_id AS event_no, t AS start, t + greatest(k % 4, 1) AS stop, event_id % 500 AS place, value FROM ev)"


def gathered(source: str) -> str:
    return f"g_{source} AS (SELECT iteration, win, CAST(o AS INTEGER) AS o, f FROM win, range({LENGTH}) c(o), {source} WHERE {source}.t = start + o)"


DISTANCE = {
    "euclidean": "list_distance(a.f, b.f)",
    "cosine": "1 - list_cosine_similarity(a.f, b.f)",
    "correlation": "1 - list_cosine_similarity(list_transform(a.f, lambda x: x - list_avg(a.f)), list_transform(b.f, lambda x: x - list_avg(b.f)))",
    "hamming": "len(list_filter(list_zip(a.f, b.f), lambda z: z[1] <> z[2])) / CAST(len(a.f) AS DOUBLE)",
    "jaccard": "coalesce(len(list_filter(list_zip(a.f, b.f), lambda z: z[1] <> z[2])) / nullif(CAST(len(list_filter(list_zip(a.f, b.f), lambda z: z[1] <> 0 OR z[2] <> 0)) AS DOUBLE), 0), 0)",
}


def rdm_sql(source: str, metric: str = "euclidean") -> str:
    return f"{gathered(source)}, d_{source} AS (SELECT iteration, a.o, a.win AS i, b.win AS j, {DISTANCE[metric]} AS d FROM g_{source} a JOIN g_{source} b USING (iteration, o) WHERE a.win < b.win)"


def z_sql(source: str, metric: str = "euclidean") -> str:
    return f"{rdm_sql(source, metric)}, z_{source} AS (SELECT iteration, o, i, j, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS z FROM d_{source} WINDOW w AS (PARTITION BY iteration, o))"


def rsa_sql(a: str, b: str) -> str:
    other = "" if a == b else f", {z_sql(b)}"
    return f"{z_sql(a)}{other}, each_r AS (SELECT iteration, n.o AS t_neural, m.o AS t_model, avg(n.z * m.z) AS r FROM z_{a} n JOIN z_{b} m USING (iteration, i, j) GROUP BY 1, 2, 3), rsa AS (SELECT t_neural, t_model, avg(r) AS r FROM each_r GROUP BY 1, 2)"


def uniform_sql(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
