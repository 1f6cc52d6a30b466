"""Queries of annotations, grids, masks, words, tokens and group statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..functions import scalar as X
from ..operators import features as Ft
from ..operators import rsa as S
from ..operators import stats as St
from ..operators import timegrid as T
from ..sources import tables as Src
from ..sources.tables import table
from . import domain as D
from .core import query, spread
from .domain import CURVE, EV, MASK, MATRIX, POINTS, TOKENS, WORDS, r6, uniform_sql

#: What the bundled event types stand for as phoneme kinds, and the kinds' voicing.
PHONATION = (("click", "v"), ("error", "uv"), ("purchase", "v"), ("signup", "s"))
VOICING = {"v": 1, "uv": -1, "u": -1, "unvoiced": -1}


# Annotations.


@query(spread(EV) + "SELECT event_id, event_type AS kind, k, k % 3 <> 0 AS pronounced FROM ev WHERE k % 3 <> 0")
def event_parse_attrs(spark: SparkSession, d: str) -> DataFrame:
    ev = D.events(spark, d)
    word = F.when(F.col("k") % 2 == 0, "None").otherwise('"it\'s"')
    raw = F.concat(F.lit("{'kind': '"), "event_type", F.lit("', 'k': "), F.col("k").cast("string"), F.lit(", 'word': "), word, F.lit(", 'score': nan, 'pronounced': "), (F.col("k") % 3).cast("string"), F.lit(".0}"))
    got = ev.select("event_id", Src.parse_literal(raw, "kind string, k int, word string, score double, pronounced string").alias("a"))
    spoken = F.coalesce(F.col("a.pronounced").try_cast("double"), F.lit(1.0)) != 0
    return got.where(spoken).select("event_id", "a.kind", "a.k", spoken.alias("pronounced"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type AS phoneme, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS voicing, count(*) AS segments FROM events GROUP BY 1")
def voicing_lookup(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame(PHONATION, "phoneme string, phonation string").select("phoneme", F.coalesce(*[F.when(F.col("phonation") == k, v) for k, v in VOICING.items()]).alias("voicing")).where("voicing is not null")
    base = F.lower(F.trim(F.split(F.concat("event_type", F.lit("_S")), "_")[0])).alias("phoneme")
    return D.events(spark, d).select(base).join(F.broadcast(dim), "phoneme", "left").groupBy("phoneme", "voicing").agg(F.count(F.lit(1)).alias("segments"))


@query(spread(EV) + "SELECT event_id, sec + 0.0 AS onset, sec + k AS offset_sec, event_type AS kind FROM ev")
def annotation_frame(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).select("event_id", F.col("sec").alias("onset"), (F.col("sec") + F.col("k")).alias("offset_sec"), F.col("event_type").alias("kind"))


LABEL = "CASE WHEN bool_or(event_type = 'error' AND k > 95) THEN 'question' WHEN bool_or(event_type = 'signup' AND k < 3) THEN 'word_list' WHEN bool_or(event_type = 'click' AND k = 50) THEN 'pseudo_words' WHEN bool_or(event_type = 'view') THEN 'sentence' WHEN count(*) > 0 THEN 'other' ELSE 'unknown' END"


@query(spread(EV) + f"SELECT t, {LABEL} AS label FROM ev GROUP BY t")
def sequence_label(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k, more=None: F.bool_or((F.col("event_type") == k) & (more if more is not None else F.lit(True)))
    label = F.when(kind("error", F.col("k") > 95), "question").when(kind("signup", F.col("k") < 3), "word_list").when(kind("click", F.col("k") == 50), "pseudo_words").when(kind("view"), "sentence").when(F.count(F.lit(1)) > 0, "other").otherwise("unknown")
    return D.events(spark, d).groupBy("t").agg(label.alias("label"))


@query(spread(EV) + "SELECT t // 4 AS sequence_id, round(min(sec), 4) AS onset, round(max(sec + k), 4) AS offset_sec, arg_min(event_type, event_id) AS story, min(k) AS audio_start FROM ev GROUP BY 1")
def sequence_segments(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).groupBy(F.floor(F.col("t") / 4).cast("int").alias("sequence_id")).agg(F.round(F.min("sec"), 4).alias("onset"), F.round(F.max(F.col("sec") + F.col("k")), 4).alias("offset_sec"), F.min_by("event_type", "event_id").alias("story"), F.min("k").alias("audio_start"))


@query(spread(EV) + "SELECT t, count(*) FILTER (WHERE k BETWEEN 0 AND 90) AS kept, count(*) FILTER (WHERE k < 0 OR k > 90) AS dropped FROM ev GROUP BY t")
def range_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).groupBy("t").agg(F.count_if(F.col("k").between(0, 90)).alias("kept"), F.count_if(~F.col("k").between(0, 90)).alias("dropped"))


@query(spread(EV) + "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS before FROM ev) WHERE before = 'view'")
def adjacency_shift(spark: SparkSession, d: str) -> DataFrame:
    return T.after(D.events(spark, d).select("event_id", "event_type"), "event_id", "event_type", "view")


@query("SELECT DISTINCT user_id FROM events EXCEPT SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")
def cohort_difference(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select("user_id").distinct().join(ev.where("event_type = 'signup'").select("user_id").distinct(), "user_id", "left_anti")


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def cohort_intersection(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.where("event_type = 'signup'").select("user_id").intersect(ev.where("event_type = 'error'").select("user_id"))


# Grids and masks.


PAINT = "p AS (SELECT CAST(unnest(range(greatest(start, 0), least(stop, 120))) AS INTEGER) AS t, event_no, value, place FROM we)"


@query(spread(EV, WORDS, PAINT) + "SELECT t, arg_max(value, event_no) AS value FROM p GROUP BY t")
def paint_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return T.paint(D.word_events(D.events(spark, d)), POINTS)


@query(spread(EV, WORDS) + "SELECT place, count(*) AS n_words, CAST(sum(greatest(least(stop, 120) - greatest(start, 0), 0)) AS BIGINT) AS covered FROM we GROUP BY 1")
def paint_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.clipped(D.word_events(D.events(spark, d)), POINTS).groupBy("place").agg(F.count(F.lit(1)).alias("n_words"), F.sum("covered").alias("covered"))


@query(spread(EV, MASK) + "SELECT t, valid FROM mask")
def sentence_mask(spark: SparkSession, d: str) -> DataFrame:
    return D.mask(D.events(spark, d))


BOUND = "bound AS (SELECT t, NOT (t % 4 = 0 AND t // 4 > 0) AS valid FROM range(120) a(t))"


def _bound(spark: SparkSession) -> DataFrame:
    grid = spark.range(POINTS).select(F.col("id").cast("int").alias("t"), F.floor(F.col("id") / 4).cast("int").alias("segment"))
    return T.boundary_mask(grid, "segment")


@query(spread(BOUND) + "SELECT CAST(t AS INTEGER) AS t, valid FROM bound")
def boundary_mask(spark: SparkSession, d: str) -> DataFrame:
    return _bound(spark).select("t", "valid")


@query(spread(EV, MASK, BOUND) + "SELECT mask.t, mask.valid AND bound.valid AS valid FROM mask JOIN bound USING (t)")
def mask_and(spark: SparkSession, d: str) -> DataFrame:
    return T.mask_and(D.mask(D.events(spark, d)), _bound(spark).select("t", "valid"))


@query(spread(EV, MASK) + "SELECT t // 3 AS t, bool_and(valid) AS valid FROM mask GROUP BY 1")
def mask_decimate(spark: SparkSession, d: str) -> DataFrame:
    return T.decimate_mask(D.mask(D.events(spark, d)), 3)


@query(spread(EV, MASK) + "SELECT min(t) AS start, max(t) + 1 AS stop FROM (SELECT t, t - row_number() OVER (ORDER BY t) AS run FROM mask WHERE valid) GROUP BY run")
def mask_intervals(spark: SparkSession, d: str) -> DataFrame:
    return T.intervals(D.mask(D.events(spark, d)))


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lineitem")
def concat_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Segments of one number are in order of their other columns."""
    order = ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, d, "lineitem").select("l_orderkey", *order).withColumn("n", F.col("l_quantity").cast("bigint")).withColumn("at", F.struct(*order))
    return T.offsets(rows, "at", "n", ("l_orderkey",)).select("l_orderkey", "l_linenumber", "offset")


@query("SELECT 'orders' AS part, count(*) AS n, CAST(0 AS BIGINT) AS \"offset\" FROM orders UNION ALL SELECT 'customer', count(*), (SELECT count(*) FROM orders) FROM customer")
def concat_union(spark: SparkSession, d: str) -> DataFrame:
    one = lambda k, t: table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("seg"), F.lit(t).alias("part"), "n")
    return T.offsets(one(0, "orders").unionByName(one(1, "customer")), "seg", "n").select("part", "n", "offset")


@query(spread(EV) + "SELECT t, round(sum(value), 6) AS x FROM ev WHERE t BETWEEN 40 AND 80 AND t % 5 = 0 GROUP BY t")
def time_slice_stride(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).where(F.col("t").between(40, 80) & (F.col("t") % 5 == 0)).groupBy("t").agg(r6(F.sum("value")).alias("x"))


_TAPS = [round(float(x), 8) for x in N.lowpass_taps(3, 4)]
_SERIES = "s AS (SELECT t, sum(value) AS x FROM ev GROUP BY t)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return D.events(spark, d).groupBy("t").agg(F.sum("value").alias("x"))


@query(spread(EV, _SERIES, f"h AS (SELECT unnest({_TAPS}::DOUBLE[]) AS h, unnest(range({len(_TAPS)})) AS j)") + f"SELECT CAST((t + j - {len(_TAPS) // 2}) // 3 AS INTEGER) AS t, round(sum(x * h), 6) + 0.0 AS x FROM s, h WHERE (t + j - {len(_TAPS) // 2}) % 3 = 0 AND t + j - {len(_TAPS) // 2} BETWEEN 0 AND 119 GROUP BY 1")
def polyphase_decimate(spark: SparkSession, d: str) -> DataFrame:
    return T.filter_decimate(_series(spark, d), _TAPS, 3, POINTS).select("t", r6("x").alias("x"))


@query(spread(EV, _SERIES) + "SELECT t, round(sum(x) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS x FROM s")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return T.rolling_mean(_series(spark, d), 10).select("t", r6("x").alias("x"))


@query(spread(EV, _SERIES, "e AS (SELECT o.t AS onset, CAST(l AS INTEGER) AS lag, x FROM (SELECT CAST(t AS INTEGER) AS t FROM range(6, 110, 9) q(t)) o, range(-3, 7) r(l), s WHERE s.t = o.t + l)") + "SELECT onset, lag, round(x - coalesce(avg(x) FILTER (WHERE lag < 0) OVER (PARTITION BY onset), 0), 6) + 0.0 AS x FROM e")
def epoch_average(spark: SparkSession, d: str) -> DataFrame:
    onsets = spark.range(6, 110, 9).select(F.col("id").cast("int").alias("onset"))
    return T.epochs(_series(spark, d), onsets, 3, 6).select("onset", "lag", r6("x").alias("x"))


@query(spread(EV, "m AS (SELECT subject, t % 12 AS lag, avg(value) AS x FROM ev GROUP BY 1, 2)") + "SELECT lag, round(quantile_cont(x, 0.5), 6) AS median, round(sqrt(avg(x * x)), 6) AS gfp FROM m GROUP BY 1")
def median_evoked(spark: SparkSession, d: str) -> DataFrame:
    m = D.events(spark, d).groupBy("subject", (F.col("t") % 12).alias("lag")).agg(F.avg("value").alias("x"))
    return m.groupBy("lag").agg(r6(F.percentile("x", F.lit(0.5))).alias("median"), r6(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("gfp"))


_COVER = "c AS (SELECT t, x, t % 5 <> 0 AS covered FROM s)"


@query(spread(EV, _SERIES, _COVER) + f"SELECT t, round(CASE WHEN covered THEN x ELSE (SELECT sqrt(greatest(var_pop(x), 1e-12)) FROM c WHERE covered) * 0.1 * sqrt(-2 * ln({uniform_sql(chr(39) + '3' + chr(39), 't', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql(chr(39) + '3' + chr(39), 't', chr(39) + 'b' + chr(39))}) END, 6) + 0.0 AS x, covered FROM c")
def noise_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("covered", F.col("t") % 5 != 0)
    return T.noise_fill(rows, F.lit(0.1), X.hash_normal(F.lit(3), F.col("t"))).select("t", r6("x").alias("x"), "covered")


@query(spread(EV, _SERIES, _COVER) + "SELECT round(avg(x), 6) AS mean, round(greatest(var_pop(x), 1e-12), 4) AS var FROM c WHERE covered")
def noise_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).where(F.col("t") % 5 != 0)
    return rows.agg(r6(F.avg("x")).alias("mean"), F.round(F.greatest(F.var_pop("x"), F.lit(1e-12)), 4).alias("var"))


@query(spread(EV, WORDS, PAINT, "w AS (SELECT t, arg_max(place, event_no) AS place FROM p WHERE t % 7 <> 3 GROUP BY t)") + "SELECT CAST(g AS INTEGER) AS t, coalesce(place, CAST('0x' || substr(md5(concat_ws('|', '5', g)), 1, 8) AS BIGINT) % 500) AS place, place IS NOT NULL AS covered FROM range(120) r(g) LEFT JOIN w ON w.t = g")
def pool_fill(spark: SparkSession, d: str) -> DataFrame:
    painted = T.paint(D.word_events(D.events(spark, d)).select("event_no", "start", "stop", "place"), POINTS, "place").where("t % 7 <> 3")
    pool = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("5"), F.col("t").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(500))
    return T.on_grid(painted, POINTS, "place", pool)


# Words and tokens.


_DOC_WORDS = r"dw AS MATERIALIZED (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word FROM documents)"
_CAND = "nw AS MATERIALIZED (SELECT word, lower(trim(replace(word, '’', ''''))) AS b FROM (SELECT DISTINCT word FROM dw)), cw AS (SELECT word, b, trim(b, '.,!?;:\"()[]{}') AS p FROM nw), ca AS MATERIALIZED (SELECT word, list_filter([b, p, replace(p, '-', ''), replace(p, '''', '')], lambda x: x <> '') AS c FROM cw)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("word"))


@query(spread(_DOC_WORDS, _CAND) + "SELECT word, array_to_string(list_distinct_ordered, '|') AS candidates FROM (SELECT word, list_filter(c, lambda x, i: list_position(c, x) = i) AS list_distinct_ordered FROM ca)")
def word_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).distinct().select("word", F.array_join(X.word_candidates(F.col("word")), "|").alias("candidates"))


@query(spread(_DOC_WORDS, _CAND) + "SELECT count(DISTINCT v) AS vocabulary FROM (SELECT unnest(c) AS v FROM ca)")
def vocab_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).distinct().select(F.explode(X.word_candidates(F.col("word"))).alias("v")).agg(F.count_distinct("v").alias("vocabulary"))


@query(spread(_DOC_WORDS, "lw AS (SELECT lower(trim(word, '.,!?;:\"()[]{}')) AS w FROM dw)") + "SELECT w AS word, count(*) AS n, round(log10(count(*) * 1e9 / (SELECT count(*) FROM lw)), 2) AS zipf FROM lw WHERE w <> '' GROUP BY 1")
def zipf_frequency(spark: SparkSession, d: str) -> DataFrame:
    counts = _words(spark, d).select(F.lower(F.btrim("word", F.lit(X.PUNCTUATION))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.where("word <> ''").join(F.broadcast(total), F.lit(True)).select("word", "n", F.round(X.zipf(F.col("n"), F.col("total")), 2).alias("zipf"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def embedding_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", r6(X.l2(F.col("embedding").cast("array<double>"))).alias("norm"))


_VEC = "tv AS MATERIALIZED (SELECT token, place FROM (SELECT w AS token, row_number() OVER (ORDER BY n DESC, w) - 1 AS place FROM (SELECT lower(trim(word, '.,!?;:\"()[]{}')) AS w, count(*) AS n FROM dw GROUP BY 1) WHERE w <> '') WHERE place < 500)"


@query(spread(_DOC_WORDS, _CAND, _VEC, "cx AS (SELECT word, unnest(c) AS token, unnest(range(len(c))) AS pos FROM ca)", "hit AS (SELECT word, arg_min(token, pos) AS token, arg_min(place, pos) AS place FROM cx JOIN tv USING (token) GROUP BY 1)") + "SELECT n.word, hit.token, coalesce(hit.place, CAST('0x' || substr(md5(concat_ws('|', '9', n.word)), 1, 8) AS BIGINT) % 500) AS place FROM nw n LEFT JOIN hit USING (word)")
def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d).groupBy("word").count()
    low = words.groupBy(F.lower(F.btrim("word", F.lit(X.PUNCTUATION))).alias("token")).agg(F.sum("count").alias("count")).where("token <> ''")
    top = low.orderBy(F.desc("count"), "token").limit(500)  # as many as there are vectors
    vec = top.select("token", (F.row_number().over(Window.orderBy(F.desc("count"), "token")) - 1).cast("long").alias("place"))
    return Ft.lookup(words.select("word"), vec, 500, 9)


@query(spread(EV, WORDS, "s AS (SELECT *, 1 + event_no % 3 AS parts FROM we)", "j AS (SELECT *, unnest(range(parts)) AS j FROM s)") + "SELECT event_no, CAST(j AS BIGINT) AS j, CAST(start + (j * (stop - start)) // parts AS INTEGER) AS a, CAST(greatest(start + ((j + 1) * (stop - start)) // parts, start + (j * (stop - start)) // parts + 1) AS INTEGER) AS b FROM j")
def token_split(spark: SparkSession, d: str) -> DataFrame:
    return Ft.split_interval(D.word_events(D.events(spark, d)), 1 + F.col("event_no") % 3).select("event_no", F.col("j").cast("long"), "a", "b")


_BIGRAM = "bg AS (SELECT doc, pos, token, lag(token) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM tok), pn AS (SELECT prev, token, count(*) AS n FROM bg WHERE prev IS NOT NULL GROUP BY 1, 2), tn AS (SELECT prev, sum(n) AS total FROM pn GROUP BY 1), pr AS (SELECT bg.doc, bg.pos, bg.token, CASE WHEN bg.prev IS NOT NULL THEN (coalesce(n, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + 1000.0::DOUBLE) END AS p FROM bg LEFT JOIN pn USING (prev, token) LEFT JOIN tn USING (prev))"


@query(spread(TOKENS, _BIGRAM) + "SELECT doc, CAST(pos AS INTEGER) AS pos, round(-log2(greatest(p, 1e-12)), 6) AS surprisal FROM pr")
def bigram_surprisal(spark: SparkSession, d: str) -> DataFrame:
    return Ft.token_probability(D.tokens(spark, d), 1000).select("doc", "pos", r6(X.surprisal(F.col("p"))).alias("surprisal"))


@query(spread(TOKENS, _BIGRAM) + "SELECT doc, CAST(pos AS INTEGER) AS pos, round(lead(p) OVER (PARTITION BY doc ORDER BY pos), 6) AS predictability FROM pr")
def bigram_predictability(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("pos")
    return Ft.token_probability(D.tokens(spark, d), 1000).select("doc", "pos", r6(F.lead("p").over(w)).alias("predictability"))


@query(spread(TOKENS, _BIGRAM) + "SELECT CAST(least(greatest(floor(-log2(greatest(p, 1e-12)) * 5), 0), 49) AS INTEGER) AS bucket, count(*) AS n FROM pr WHERE p IS NOT NULL GROUP BY 1")
def surprisal_hist(spark: SparkSession, d: str) -> DataFrame:
    s = X.surprisal(F.col("p"))
    return Ft.token_probability(D.tokens(spark, d), 1000).where("p is not null").groupBy(F.least(F.greatest(F.floor(s * 5), F.lit(0)), F.lit(49)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(spread(TOKENS) + "SELECT least(pos + 1, 8) AS context, count(*) AS n, CAST(greatest(count(*) - 1, 0) AS BIGINT) AS cache_hits FROM tok GROUP BY 1")
def context_usage(spark: SparkSession, d: str) -> DataFrame:
    return D.tokens(spark, d).groupBy(F.least(F.col("pos") + 1, F.lit(8)).cast("long").alias("context")).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("cache_hits"))


_LOGIT = "lg AS (SELECT vec_id AS pos, unnest(range(64)) AS symbol, CAST(unnest(embedding) AS DOUBLE) * 8 AS logit FROM embeddings)"
_SOFT = "sm AS (SELECT pos, symbol, logit - max(logit) OVER w AS s FROM lg WINDOW w AS (PARTITION BY pos)), lp AS (SELECT pos, symbol, s - ln(sum(exp(s)) OVER (PARTITION BY pos)) AS logp FROM sm)"


def _logits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.posexplode(F.col("embedding").cast("array<double>")).alias("symbol", "x"))
    return e.select("pos", "symbol", (F.col("x") * 8).alias("logit"))


@query(spread(_LOGIT, _SOFT) + "SELECT pos, CAST(symbol AS INTEGER) AS symbol, round(logp, 6) + 0.0 AS logp FROM lp")
def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    return Ft.log_softmax(_logits(spark, d), "pos", "logit").select("pos", "symbol", r6("logp").alias("logp"))


_TOP = "pk AS (SELECT pos, symbol, exp(logp) AS p FROM lp), rk AS (SELECT *, row_number() OVER w AS k, coalesce(sum(p) OVER (PARTITION BY pos ORDER BY p DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pk WINDOW w AS (PARTITION BY pos ORDER BY p DESC, symbol))"


@query(spread(_LOGIT, _SOFT, _TOP) + "SELECT pos, CAST(symbol AS INTEGER) AS symbol, CAST(k AS INTEGER) AS k, round(p, 6) AS p FROM rk WHERE before < 0.9 AND k <= 40")
def topk_mass(spark: SparkSession, d: str) -> DataFrame:
    p = Ft.log_softmax(_logits(spark, d), "pos", "logit").select("pos", "symbol", F.exp("logp").alias("p"))
    return Ft.top_mass(p, "pos", "symbol", "p", 0.9, 40).select("pos", "symbol", "k", r6("p").alias("p"))


@query(spread(_LOGIT, _SOFT, _TOP, "cm AS (SELECT pos, k, before + p AS mass FROM rk WHERE k <= 20)") + "SELECT CAST(k AS INTEGER) AS k, round(avg(mass), 6) AS mass, round(1 - pow(0.01, k / 64.0::DOUBLE), 6) AS estimate FROM cm GROUP BY k")
def topk_mass_curve(spark: SparkSession, d: str) -> DataFrame:
    p = Ft.log_softmax(_logits(spark, d), "pos", "logit").select("pos", "symbol", F.exp("logp").alias("p"))
    w = Window.partitionBy("pos").orderBy(F.desc("p"), "symbol")
    rows = p.withColumn("k", F.row_number().over(w)).withColumn("mass", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("k <= 20")
    return rows.groupBy("k").agg(r6(F.avg("mass")).alias("mass")).withColumn("estimate", r6(X.mass_curve(0.99, F.col("k"), 64)))


@query()
def svd_basis(spark: SparkSession, d: str) -> DataFrame:
    s, v = Ft.svd_basis(Ft.gram(table(spark, d, "embeddings"), "embedding", 64), 8)
    return spark.createDataFrame([(k, float(s[k]), [float(x) for x in v[k]]) for k in range(len(s))], "component int, singular double, loadings array<double>")


@query()
def svd_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """component, share, cumulative share, and the first component that reaches 90 percent."""
    s, _ = Ft.svd_basis(Ft.gram(table(spark, d, "embeddings"), "embedding", 64), 64)
    share = spark.createDataFrame([(k, float(x)) for k, x in enumerate(s**2 / (s**2).sum())], "component int, share double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    rows = share.withColumn("total", F.sum("share").over(w))
    first = rows.where("total >= 0.9 - 1e-12").agg(F.min("component").alias("k90"))
    return rows.join(F.broadcast(first), F.lit(True)).select("component", r6("share").alias("share"), r6("total").alias("total"), "k90")


@query()
def svd_scores(spark: SparkSession, d: str) -> DataFrame:
    _, v = Ft.svd_basis(Ft.gram(table(spark, d, "embeddings"), "embedding", 64), 4)
    return Ft.project(table(spark, d, "embeddings"), "embedding", v).select("vec_id", F.transform("scores", lambda x: F.round(x, 6) + 0.0).alias("scores"))


@query()
def word_encode(spark: SparkSession, d: str) -> DataFrame:
    return Ft.map_words(_words(spark, d).distinct(), Ft.hashed_encoder())


@query(spread(TOKENS, "ln AS (SELECT doc, pos, count(*) OVER (PARTITION BY doc) AS n FROM tok)") + "SELECT doc, CAST(pos AS INTEGER) AS pos, CAST(least(pos // 4 * 4 + 4, n) - greatest(0, pos // 4 * 4 - 7) AS DOUBLE) AS score FROM ln")
def story_score(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of four with a context of eight; the scorer tells how many tokens it was given."""
    return Ft.score_story(D.tokens(spark, d), lambda words, n: [float(len(words))] * n, 8, 4)


# Groups.


@query(spread(EV, CURVE) + "SELECT lag, count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(coalesce(stddev_samp(r) / sqrt(count(r)), 0), 6) AS sem FROM curve GROUP BY 1")
def group_mean_sem(spark: SparkSession, d: str) -> DataFrame:
    return St.mean_sem(D.group_curve(D.events(spark, d)), ("lag",)).select("lag", "n", r6("mean").alias("mean"), r6("sem").alias("sem"))


_T = "coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0), 0)"


@query(spread(EV, CURVE) + f"SELECT lag, round({_T}, 5) + 0.0 AS t FROM curve GROUP BY 1")
def t_map(spark: SparkSession, d: str) -> DataFrame:
    return St.t_map(D.group_curve(D.events(spark, d)), ("lag",)).select("lag", (F.round("t", 5) + 0.0).alias("t"))


_BAR = round(St.t_critical(0.5, 8), 9)
_CLUSTERS = f"tm AS (SELECT lag, {_T} AS t FROM curve GROUP BY 1), cr AS (SELECT lag, t, CAST(sign(t) AS INTEGER) AS sign, lag - row_number() OVER (PARTITION BY sign(t) ORDER BY lag) AS run FROM tm WHERE abs(t) > {_BAR}), cl AS (SELECT sign, min(lag) AS \"first\", max(lag) AS \"last\", sum(t) AS mass FROM cr GROUP BY sign, run)"


@query(spread(EV, CURVE, _CLUSTERS) + 'SELECT sign, "first", "last", round(mass, 5) AS mass FROM cl')
def clusters_1d(spark: SparkSession, d: str) -> DataFrame:
    t = St.t_map(D.group_curve(D.events(spark, d)), ("lag",))
    return St.clusters(t, _BAR).select("sign", "first", "last", F.round("mass", 5).alias("mass"))


_FLIPS = f"su AS (SELECT DISTINCT subject FROM curve), fl AS (SELECT CAST(p AS INTEGER) AS perm, subject, CASE WHEN {uniform_sql(chr(39) + '13' + chr(39), 'p', 'subject')} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE AS flip FROM su, range(100) a(p))"
_NULL = f"nt AS (SELECT perm, lag, coalesce(avg(r * flip) / nullif(stddev_samp(r * flip) / sqrt(count(r)), 0), 0) AS t FROM curve JOIN fl USING (subject) GROUP BY 1, 2), nr AS (SELECT perm, lag, t, sign(t) AS sg, lag - row_number() OVER (PARTITION BY perm, sign(t) ORDER BY lag) AS run FROM nt WHERE abs(t) > {_BAR}), nc AS (SELECT perm, abs(sum(t)) AS mass FROM nr GROUP BY perm, sg, run), mx AS (SELECT f.perm, coalesce(max(mass), 0) AS most FROM (SELECT DISTINCT perm FROM fl) f LEFT JOIN nc ON nc.perm = f.perm GROUP BY 1), bar AS (SELECT quantile_cont(most, 0.9) AS bar FROM mx)"


@query(spread(EV, CURVE, _CLUSTERS, _FLIPS, _NULL) + 'SELECT sign, "first", "last", round(mass, 5) AS mass, abs(mass) > bar AS significant, round(bar, 5) AS bar FROM cl, bar')
def cluster_perm_1d(spark: SparkSession, d: str) -> DataFrame:
    out = St.cluster_permutation(D.group_curve(D.events(spark, d)), _BAR, 100, 0.1, 13)
    return out.select("sign", "first", "last", F.round("mass", 5).alias("mass"), "significant", F.round("bar", 5).alias("bar"))


@query()
def cluster_perm_2d(spark: SparkSession, d: str) -> DataFrame:
    out = St.cluster_permutation_2d(D.group_matrix(D.events(spark, d)), 1.0, 60, 0.1, 13)
    return out.select("t_neural", "t_model", r6("t").alias("t"), "cluster", "significant")


@query(spread(EV, MATRIX) + "SELECT subject, t_neural // 2 AS t_neural, t_model // 2 AS t_model, round(avg(r), 6) + 0.0 AS r FROM cells GROUP BY 1, 2, 3")
def matrix_block_mean(spark: SparkSession, d: str) -> DataFrame:
    return T.block_mean(D.group_matrix(D.events(spark, d)), 2, ("subject",)).select("subject", "t_neural", "t_model", r6("r").alias("r"))


@query(spread(EV, MATRIX) + f"SELECT CAST(t_neural * 2 + i AS INTEGER) AS t_neural, CAST(t_model * 2 + j AS INTEGER) AS t_model, significant FROM (SELECT t_neural, t_model, abs({_T}) > 1 AS significant FROM cells GROUP BY 1, 2), range(2) a(i), range(2) b(j)")
def mask_upsample(spark: SparkSession, d: str) -> DataFrame:
    t = St.t_map(D.group_matrix(D.events(spark, d)), ("t_neural", "t_model"))
    return T.upsample_mask(t.select("t_neural", "t_model", (F.abs("t") > 1).alias("significant")), 2)


@query(spread(EV, CURVE, "un AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM curve))", f"dr AS (SELECT CAST(i AS INTEGER) AS draw, CAST(floor({uniform_sql(chr(39) + '21' + chr(39), 'i', 'place')} * n) AS INTEGER) AS place FROM un, range(100) a(i))", "bm AS (SELECT lag, draw, avg(r) AS mean FROM curve JOIN un USING (subject) JOIN dr ON dr.place = un.place GROUP BY 1, 2)") + "SELECT lag, round(quantile_cont(mean, 0.025), 6) + 0.0 AS low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS high FROM bm GROUP BY 1")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = St.bootstrap(D.group_curve(D.events(spark, d)), ("lag",), "subject", 100, 0.95, 21)
    return out.select("lag", r6("low").alias("low"), r6("high").alias("high"))


@query(spread(EV, CURVE) + "SELECT subject, arg_max(lag, abs(r)) AS peak_lag, round(arg_max(r, abs(r)), 6) + 0.0 AS peak_r FROM curve GROUP BY 1")
def group_peak(spark: SparkSession, d: str) -> DataFrame:
    return S.peak(D.group_curve(D.events(spark, d)), ("subject",), absolute=True).select("subject", "peak_lag", r6("peak_r").alias("peak_r"))


@query(spread(EV) + "SELECT subject, event_type AS label, count(*) AS n, round(covar_pop(value, k) / nullif(stddev_pop(value) * stddev_pop(k), 0), 6) + 0.0 AS r FROM ev GROUP BY 1, 2")
def pearson_by_label(spark: SparkSession, d: str) -> DataFrame:
    out = St.pearson(D.events(spark, d).withColumnRenamed("event_type", "label").withColumn("k", F.col("k").cast("double")), ("subject", "label"), "value", "k")
    return out.select("subject", "label", "n", r6("r").alias("r"))


@query(spread(EV) + "SELECT event_id, round(greatest(least(value, b), -b), 6) AS value FROM ev, (SELECT quantile_cont(abs(value), 0.95) AS b FROM ev)")
def percentile_clip(spark: SparkSession, d: str) -> DataFrame:
    return St.percentile_clip(D.events(spark, d), "value", 0.95).select("event_id", r6("value").alias("value"))


@query()
def lda_decode(spark: SparkSession, d: str) -> DataFrame:
    """Embedding components in eight groups stand for the channels at eight times."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("e"))
    rows = e.select("row", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("time"), "e").select("row", "y", "time", F.slice("e", F.col("time") * 8 + 1, F.lit(8)).alias("features"))
    return St.lda_decode(rows, "time").select("time", "n", r6("score").alias("score"))


@query("SELECT doc_id, round_even((row_number() OVER (ORDER BY doc_id) - 1) / greatest(count(*) OVER () - 1, 1), 0) AS half FROM documents")
def half_label(spark: SparkSession, d: str) -> DataFrame:
    rows = T.ranked(table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", F.rint((F.col("rn") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("half"))


# Names and constants.


@query("SELECT DISTINCT source, regexp_replace(trim(regexp_replace(source || ' #1', '[^A-Za-z0-9]+', '_', 'g'), '_'), '^$', 'unnamed') AS slug, 'sub-' || lpad(regexp_extract(source, '([0-9]+)$', 1), 2, '0') AS subject, upper(source) AS channel FROM documents")
def name_labels(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    return table(spark, d, "documents").select("source", X.slug(F.concat(s, F.lit(" #1"))).alias("slug"), X.subject_label(s).alias("subject"), X.channel_name(s).alias("channel")).distinct()


@query("SELECT source, row_number() OVER (ORDER BY CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("source").distinct()
    return s.select("source", F.row_number().over(Window.orderBy(X.natural_key(F.col("source")))).cast("long").alias("place"))


@query("SELECT DISTINCT unnest(range(lo, hi + 1)) AS id FROM (VALUES (2, 5), (4, 7), (12, 12)) v(lo, hi)")
def id_range_expand(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.createDataFrame([("2-5",), ("7-4",), ("12",)], "part string")
    ends = F.split("part", "-")
    lo, hi = ends[0].cast("long"), F.element_at(ends, -1).cast("long")
    return parts.select(F.explode(F.sequence(F.least(lo, hi), F.greatest(lo, hi))).alias("id")).distinct()


@query("SELECT CAST(i AS INTEGER) AS band, round((pow(10.0::DOUBLE, (21.4 * log10(0.00437 * 150 + 1) + i * (21.4 * log10(0.00437 * 4000 + 1) - 21.4 * log10(0.00437 * 150 + 1)) / 14) / 21.4) - 1) / 0.00437, 4) AS hz FROM range(15) a(i)")
def erb_centres(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = X.erb(F.lit(150.0)), X.erb(F.lit(4000.0))
    return spark.range(15).select(F.col("id").cast("int").alias("band"), F.round(X.erb_to_hz(lo + F.col("id") * (hi - lo) / 14), 4).alias("hz"))


@query("SELECT event_id, round(pow(abs(value), 0.6::DOUBLE), 6) AS compressed, CAST(round_even(value, 0) AS BIGINT) AS nearest, CAST(floor(value) AS BIGINT) AS below, CAST(ceil(value) AS BIGINT) AS above FROM events")
def rounding_kinds(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r6(X.compress(v)).alias("compressed"), X.half_even(v).alias("nearest"), F.floor(v).alias("below"), F.ceil(v).alias("above"))


@query(spread(EV, MASK, "by8 AS (SELECT t // 8 AS b, sum(CASE WHEN valid THEN 1 << (7 - t % 8) ELSE 0 END) AS x FROM mask GROUP BY 1)") + "SELECT sha1(unhex(string_agg(printf('%02X', CAST(x AS BIGINT)), '' ORDER BY b))) AS mask_hash FROM by8")
def params_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-1 of the mask as packed bits, the first point highest."""
    byte = D.mask(D.events(spark, d)).groupBy(F.floor(F.col("t") / 8).alias("b")).agg(F.sum(F.when(F.col("valid"), F.expr("shiftleft(1, 7 - t % 8)")).otherwise(0)).alias("x"))
    packed = byte.agg(F.sort_array(F.collect_list(F.struct("b", F.lpad(F.hex("x"), 2, "0").alias("h")))).alias("s"))  # a byte for eight points of one mask
    return packed.select(F.sha1(F.unhex(F.array_join(F.transform("s", lambda y: y["h"]), ""))).alias("mask_hash"))


@query("SELECT o_custkey % 5 AS subject, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("subject"), F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("name"), F.lit(0).alias("modified"))
    return Src.latest_run(o, "subject", "name", "modified").select("subject", F.split("run", "_")[2].cast("long").alias("latest"))


@query("SELECT * FROM (VALUES ('left', 'MEG 001'), ('left', 'MEG 002'), ('right', 'MEG 003')) v(side, channel)")
def sensor_set(spark: SparkSession, d: str) -> DataFrame:
    text = ["# layout", "version=1", "[Left]", "MEG 001", "MEG 002", "", "[Right]", "MEG 003"]
    return Src.sensor_set(spark.createDataFrame(list(enumerate(text)), "line_no int, value string")).select("side", "channel")


# Signal kernels: the subjects' series, a series a task.


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """subject, x: the series of each subject on the whole grid."""
    rows = D.events(spark, d).groupBy("subject", "t").agg(F.sum("value").alias("x"))
    return rows.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("m")).select("subject", F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("x"))


def _kernel(spark: SparkSession, d: str, f) -> DataFrame:  # noqa: ANN001
    import pyarrow as pa

    def apply(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for row in batch.to_pylist():
                y = np.round(f(np.array(row["x"], float)), 6) + 0.0
                yield pa.RecordBatch.from_arrays([pa.array([row["subject"]] * len(y), pa.int64()), pa.array(range(len(y)), pa.int32()), pa.array(y)], ["subject", "t", "x"])

    return _signals(spark, d).select(F.col("subject").cast("long").alias("subject"), "x").mapInArrow(apply, "subject bigint, t int, x double")


SERIES = f"sg AS (SELECT g.subject, CAST(g.t AS INTEGER) AS t, coalesce(x, 0) AS x FROM (SELECT subject, t FROM (SELECT DISTINCT subject FROM ev), range({POINTS}) r(t)) g LEFT JOIN (SELECT subject, t, sum(value) AS x FROM ev GROUP BY 1, 2) s ON s.subject = g.subject AND s.t = g.t)"
_BAND = [round(float(x), 9) for x in N.bandpass_taps(0.02, 0.3, 1, 41)]


@query(spread(EV, SERIES, f"h AS (SELECT unnest({_BAND}::DOUBLE[]) AS h, unnest(range({len(_BAND)})) AS j)") + f"SELECT subject, CAST(t + j - {len(_BAND) // 2} AS INTEGER) AS t, round(sum(x * h), 6) + 0.0 AS x FROM sg, h WHERE t + j - {len(_BAND) // 2} BETWEEN 0 AND {POINTS - 1} GROUP BY 1, 2")
def fir_bandpass(spark: SparkSession, d: str) -> DataFrame:
    return _kernel(spark, d, lambda x: N.fir(x, np.array(_BAND)))


@query(spread(EV, SERIES, "k AS (SELECT CAST(k AS INTEGER) AS k, t, 1 + 2 * (SELECT sum(cos(2 * pi() * m * (k / 40.0::DOUBLE - t / 120.0::DOUBLE))) FROM range(1, 20) r(m)) + 2 * cos(2 * pi() * 20 * t / 120.0::DOUBLE) * cos(pi() * k) AS w FROM range(40) a(k), range(120) b(t))") + "SELECT subject, k AS t, round(sum(x * w) / 120, 6) + 0.0 AS x FROM sg JOIN k USING (t) GROUP BY 1, 2")
def fft_resample(spark: SparkSession, d: str) -> DataFrame:
    return _kernel(spark, d, lambda x: N.fft_resample(x, 40))


@query()
def gammatone_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The grid's points as samples of a thousand hertz."""
    return _kernel(spark, d, lambda x: N.envelope(x, 1000, [20, 45, 80, 150]))
