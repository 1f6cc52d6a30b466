"""Queries of discovery, names, simulations and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import features as Ft
from ..operators import rdm as R
from ..operators import rsa as S
from ..operators import stats as St
from ..sources import files as Fl
from ..sources.tables import table
from . import domain as D
from .core import RSA, query, spread
from .domain import CURVE, EV, LENGTH, MODEL, NEURAL, POINTS, REACH, TOKENS, WIN, r6, uniform_sql
from .recording import _LOGIT, _SOFT, _logits

_FILES = "SELECT 'raw/sub-' || lpad(CAST(o_custkey % 27 AS VARCHAR), 2, '0') || '_ses-' || (o_orderkey % 2) || '_task-' || (o_orderkey % 4) || '_meg.con' AS path FROM orders"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("raw/sub-"), F.lpad((F.col("o_custkey") % 27).cast("string"), 2, "0"), F.lit("_ses-"), F.col("o_orderkey") % 2, F.lit("_task-"), F.col("o_orderkey") % 4, F.lit("_meg.con")).alias("path"))


@query("SELECT DISTINCT lpad(CAST(o_custkey % 27 AS VARCHAR), 2, '0') AS subject, CAST(o_orderkey % 2 AS VARCHAR) AS session, CAST(o_orderkey % 4 AS VARCHAR) AS task FROM orders")
def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    return Fl.runs(_paths(spark, d))


@query("SELECT lpad(CAST(o_custkey % 9 AS VARCHAR), 2, '0') AS subject, '100' AS rate, 'elasticnet' AS method, CASE WHEN o_orderkey % 3 = 0 THEN 'simulation' ELSE 'base' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'white_noise' ELSE '' END AS label, count(*) AS n FROM orders GROUP BY ALL")
def results_discovery(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    sim = F.when(F.col("o_orderkey") % 3 == 0, "_sim_01_white_noise").otherwise("")
    names = o.select(F.concat(F.lit("out/sub-"), F.lpad((F.col("o_custkey") % 9).cast("string"), 2, "0"), F.lit("_res100_elasticnet"), sim, F.lit(".parquet")).alias("path"))
    return Fl.results(names).groupBy("subject", "rate", "method", "kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH f AS ({_FILES}) SELECT DISTINCT path, lower(path) AS found FROM f")
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d).distinct()
    return Fl.resolve_paths(p, p.select(F.lower("path").alias("path")))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) END, CASE WHEN p_partkey % 3 = 1 THEN upper(p_type) END, 'MEG ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS channel FROM part")
def channel_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    named = p.where("p_partkey % 3 = 0").select("p_partkey", X.channel_name(F.col("p_brand")).alias("manifest"))
    header = p.where("p_partkey % 3 = 1").select("p_partkey", X.channel_name(F.col("p_type")).alias("header"))
    plain = F.concat(F.lit("MEG "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    return p.select("p_partkey").join(named, "p_partkey", "left").join(header, "p_partkey", "left").select("p_partkey", F.coalesce("manifest", "header", plain).alias("channel"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0.005 THEN 'right' WHEN s_acctbal < -0.005 THEN 'left' ELSE 'central' END AS side FROM supplier")
def hemisphere_split(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.when(x > 0.005, "right").when(x < -0.005, "left").otherwise("central").alias("side"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, o_orderdate AS parsed FROM orders")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"))
    kind = dict(o.dtypes)["o_orderdate"]
    return o.select("o_orderkey", "stamp", F.try_to_timestamp("stamp", F.lit("yyyyMMdd_HHmmss")).cast(kind).alias("parsed"))


@query("SELECT user_id % 7 - 3 AS x, translate(CAST((user_id % 7 - 3) / 2.0::DOUBLE AS VARCHAR), '-.', 'mp') AS fragment, CASE WHEN user_id % 3 = 0 THEN 'true' WHEN user_id % 3 = 1 THEN 'false' ELSE 'unset' END AS flag, count(*) AS n FROM events GROUP BY ALL")
def name_fragments(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("user_id") % 7 - 3
    word = F.when(F.col("user_id") % 3 == 0, " Yes").when(F.col("user_id") % 3 == 1, "0").otherwise("maybe")
    return table(spark, d, "events").select(x.alias("x"), X.number_fragment(x / F.lit(2.0)).alias("fragment"), F.coalesce(X.optional_bool(word).cast("string"), F.lit("unset")).alias("flag")).groupBy("x", "fragment", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(spread(EV, NEURAL) + "SELECT t, round(f[4], 6) AS first, round(f[2], 6) AS second FROM neu")
def feature_subset(spark: SparkSession, d: str) -> DataFrame:
    pick = F.transform(F.array_distinct(F.array(F.lit(3), F.lit(1), F.lit(3))), lambda i: F.col("features")[i])
    return D.neural(D.events(spark, d)).select("t", pick.alias("f")).select("t", r6(F.col("f")[0]).alias("first"), r6(F.col("f")[1]).alias("second"))


@query(spread(EV, "a AS (SELECT t, sum(value) AS x FROM ev GROUP BY t)", "b AS (SELECT t, count(*) AS n FROM ev WHERE t < 100 GROUP BY t)") + "SELECT t, round(x, 6) AS x, n FROM a JOIN b USING (t)")
def trim_shared_length(spark: SparkSession, d: str) -> DataFrame:
    ev = D.events(spark, d)
    return ev.groupBy("t").agg(r6(F.sum("value")).alias("x")).join(ev.where("t < 100").groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t")


@query(spread(EV) + "SELECT event_type AS signal, max(t) + 1 AS n_times, max(max(t) + 1) OVER () = max(t) + 1 AS agrees FROM ev GROUP BY 1")
def length_validation(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = D.events(spark, d).groupBy(F.col("event_type").alias("signal")).agg((F.max("t") + 1).alias("n_times"))
    return n.withColumn("agrees", F.max("n_times").over(Window.partitionBy(F.lit(0))) == F.col("n_times"))


@query(spread(EV, CURVE, "m AS (SELECT lag, avg(r) AS r FROM curve GROUP BY 1)") + "SELECT round(min(r) - 0.05 * (max(r) - min(r)), 6) AS low, round(max(r) + 0.05 * (max(r) - min(r)), 6) AS high FROM m")
def plot_limits(spark: SparkSession, d: str) -> DataFrame:
    m = D.group_curve(D.events(spark, d)).groupBy("lag").agg(F.avg("r").alias("r"))
    pad = 0.05 * (F.max("r") - F.min("r"))
    return m.agg(r6(F.min("r") - pad).alias("low"), r6(F.max("r") + pad).alias("high"))


_NOISE = f"noise AS (SELECT CAST(t AS INTEGER) AS t, list(sqrt(-2 * ln({uniform_sql(chr(39) + '31' + chr(39), 't', 'c', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql(chr(39) + '31' + chr(39), 't', 'c', chr(39) + 'b' + chr(39))}) ORDER BY c) AS f FROM range({POINTS}) a(t), range(8) b(c) GROUP BY t)"


def _noise(spark: SparkSession) -> DataFrame:
    t = spark.range(POINTS).select(F.col("id").cast("int").alias("t"))
    return t.select("t", F.array(*[X.hash_normal(F.lit(31), F.col("t"), F.lit(c)) for c in range(8)]).alias("features"))


@query(spread(_NOISE) + "SELECT t, round(list_avg(f), 6) + 0.0 AS mean FROM noise")
def white_noise(spark: SparkSession, d: str) -> DataFrame:
    return _noise(spark).select("t", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / 8).alias("mean"))


@query(spread(EV, MODEL, WIN, _NOISE, D.rsa_sql("noise", "model")) + f"SELECT t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM rsa WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1")
def white_noise_curve(spark: SparkSession, d: str) -> DataFrame:
    z = D.rdm_z(spark, _noise(spark))
    return S.lag_curve(S.rsa(z, D.rdm_z(spark, D.model(D.events(spark, d)))), REACH).select("lag", r6("r").alias("r"))


@query(RSA + f"SELECT t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r, count(*) AS cells FROM rsa WHERE abs(t_neural - t_model) <= least(40, {LENGTH - 1}) GROUP BY 1")
def lag_curve_clamped(spark: SparkSession, d: str) -> DataFrame:
    ev = D.events(spark, d)
    m = S.rsa(D.rdm_z(spark, D.neural(ev)), D.rdm_z(spark, D.model(ev)))
    cells = m.groupBy((F.col("t_neural") - F.col("t_model")).alias("lag")).agg(F.count(F.lit(1)).alias("cells"))
    return S.lag_curve(m, min(40, LENGTH - 1)).join(cells, "lag").select("lag", r6("r").alias("r"), "cells")


@query(spread(_LOGIT, _SOFT, "em AS (SELECT vec_id AS symbol, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings WHERE vec_id < 64)") + "SELECT pos, CAST(dim AS INTEGER) AS dim, round(sum(exp(logp) * e), 6) + 0.0 AS expected FROM lp JOIN em USING (symbol) GROUP BY 1, 2")
def expected_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The first 64 vectors stand for the vocabulary of 64 symbols."""
    p = Ft.log_softmax(_logits(spark, d), "pos", "logit").select("pos", "symbol", F.exp("logp").alias("p"))
    e = table(spark, d, "embeddings").where("vec_id < 64").select(F.col("vec_id").cast("int").alias("symbol"), F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "e"))
    return p.join(e, "symbol").groupBy("pos", "dim").agg(r6(F.sum(F.col("p") * F.col("e"))).alias("expected"))


SETTINGS = '{"context": 8, "mass": 0.9, "model": "bigram"}'


@query(spread(TOKENS, f"sh AS (SELECT doc, sha256(string_agg(token, chr(10) ORDER BY pos) || '{SETTINGS}') AS story_hash, count(*) AS n FROM tok GROUP BY 1)") + "SELECT * FROM sh WHERE doc % 3 <> 0")
def story_cache(spark: SparkSession, d: str) -> DataFrame:
    """Stories whose hash of words, model and settings the cache hasn't: it holds a third, and another third of other settings."""
    words = D.tokens(spark, d)
    s = Ft.story_hashes(words, SETTINGS)
    known = s.where("doc % 3 = 0").select("doc", "story_hash").unionByName(Ft.story_hashes(words.where("doc % 3 = 1"), "{}").select("doc", "story_hash"))
    return s.join(known, ["doc", "story_hash"], "left_anti").select("doc", "story_hash", "n")


@query(spread(EV, CURVE) + "SELECT round(quantile_cont(r, 0.25), 6) + 0.0 AS low, round(quantile_cont(r, 0.5), 6) + 0.0 AS median, round(quantile_cont(r, 0.975), 6) + 0.0 AS high FROM curve")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: r6(F.percentile("r", F.lit(p)))
    return D.group_curve(D.events(spark, d)).agg(q(0.25).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))


@query("WITH w AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('5|' || vec_id), vec_id) AS k, embedding FROM embeddings) SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d FROM w a JOIN w b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.k <= 20 AND b.k <= 20")
def static_rdm(spark: SparkSession, d: str) -> DataFrame:
    """Distances of twenty drawn vectors of each label: the draw bounds the pairs, as it does for windows."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("5|"), F.col("vec_id").cast("string"))), "vec_id")
    e = e.withColumn("k", F.row_number().over(w)).where("k <= 20")
    a, b = e.select("label", F.col("vec_id").alias("i"), F.col("e").alias("ea")), e.select("label", F.col("vec_id").alias("j"), F.col("e").alias("eb"))
    return a.join(b, "label").where("i < j").select("label", "i", "j", r6(R.euclidean(F.col("ea"), F.col("eb"))).alias("d"))


@query(spread(EV) + "SELECT event_type AS label, count(*) AS n, round(covar_pop(value, sec) / nullif(stddev_pop(value) * stddev_pop(sec), 0), 6) + 0.0 AS r FROM ev GROUP BY 1")
def score_by_label(spark: SparkSession, d: str) -> DataFrame:
    out = St.pearson(D.events(spark, d).withColumnRenamed("event_type", "label"), ("label",), "value", "sec")
    return out.select("label", "n", r6("r").alias("r"))
