"""Queries of the core: windows, RDMs, similarity across time, lag curves, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rdm as R
from ..operators import regress as G
from ..operators import rsa as S
from ..operators import windows as Win
from . import domain as D
from .domain import EV, LENGTH, MASK, MODEL, NEURAL, POINTS, REACH, WIN, r6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def spread(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


@query(spread(EV, MASK, f"w AS (SELECT t, min(CAST(valid AS INTEGER)) OVER x AS a, count(*) OVER x AS n, max(t) OVER x - t + 1 AS span FROM mask WINDOW x AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING))") + f"SELECT t AS start FROM w WHERE a = 1 AND n = {LENGTH} AND span = {LENGTH}")
def valid_starts(spark: SparkSession, d: str) -> DataFrame:
    return Win.valid_starts(D.mask(D.events(spark, d)), LENGTH)


@query(spread(EV) + f"SELECT DISTINCT CAST(s AS INTEGER) AS start FROM (SELECT round_even(round_even(sec / 21600, 0) - 5.5, 0) AS s FROM ev WHERE event_type = 'signup') WHERE s >= 0 AND s <= {POINTS - LENGTH}")
def onset_starts(spark: SparkSession, d: str) -> DataFrame:
    on = D.events(spark, d).where("event_type = 'signup'").select(F.col("sec").alias("onset_sec"))
    return Win.onset_starts(on, 1 / D.BIN, LENGTH, POINTS, centre=True)


@query(spread(EV, MASK, f"w AS (SELECT t, min(CAST(valid AS INTEGER)) OVER x AS a, count(*) OVER x AS n, max(t) OVER x - t + 1 AS span FROM mask WINDOW x AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING))") + f"SELECT t AS start FROM w WHERE a = 1 AND n = {LENGTH} AND span = {LENGTH} INTERSECT SELECT CAST(round_even(sec / 21600, 0) AS INTEGER) FROM ev WHERE event_type = 'signup'")
def candidate_intersection(spark: SparkSession, d: str) -> DataFrame:
    ev = D.events(spark, d)
    on = ev.where("event_type = 'signup'").select(F.col("sec").alias("onset_sec"))
    return Win.valid_starts(D.mask(ev), LENGTH).intersect(Win.onset_starts(on, 1 / D.BIN, LENGTH, POINTS))


@query(spread(WIN) + "SELECT * FROM win")
def draw_windows_overlap(spark: SparkSession, d: str) -> DataFrame:
    return D.windows(spark)


GREEDY = f"""WITH RECURSIVE c AS (SELECT CAST(i AS INTEGER) AS iteration, CAST(s AS INTEGER) AS start, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws('|', '{D.SEED}', i, s)), s) AS rn FROM range({D.ITERATIONS}) a(i), range({POINTS - LENGTH + 1}) b(s)),
g AS (SELECT iteration, 1::BIGINT AS rn, [start] AS taken FROM c WHERE rn = 1
      UNION ALL
      SELECT c.iteration, c.rn, CASE WHEN len(taken) < 5 AND len(list_filter(taken, lambda x: abs(x - start) < {LENGTH})) = 0 THEN list_append(taken, start) ELSE taken END FROM g JOIN c ON c.iteration = g.iteration AND c.rn = g.rn + 1),
l AS (SELECT iteration, arg_max(taken, rn) AS taken FROM g GROUP BY 1)
SELECT iteration, CAST(unnest(range(len(taken))) AS INTEGER) AS win, unnest(taken) AS start FROM l"""


@query(GREEDY)
def draw_windows_greedy(spark: SparkSession, d: str) -> DataFrame:
    starts = spark.range(POINTS - LENGTH + 1).select(F.col("id").cast("int").alias("start"))
    return Win.draw_apart(starts, D.ITERATIONS, 5, LENGTH, D.SEED)


@query(spread(WIN) + f"SELECT iteration, CAST(start + o AS INTEGER) AS t, count(*) AS n FROM win, range({LENGTH}) c(o) GROUP BY 1, 2")
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    return Win.coverage(D.windows(spark), LENGTH)


SHUFFLED = "shuf AS (SELECT iteration, CAST(row_number() OVER (PARTITION BY iteration ORDER BY md5(concat_ws('|', '11', iteration, win)), win) - 1 AS INTEGER) AS win, start FROM win)"


@query(spread(WIN, SHUFFLED) + "SELECT * FROM shuf")
def shuffle_windows(spark: SparkSession, d: str) -> DataFrame:
    return Win.permute_windows(D.windows(spark), 11)


@query(spread(EV, NEURAL, WIN, D.gathered("neu")) + 'SELECT iteration, win, o AS "offset", round(list_sum(f), 6) AS total FROM g_neu')
def gather_windows(spark: SparkSession, d: str) -> DataFrame:
    g = Win.gather(D.windows(spark), D.neural(D.events(spark, d)), LENGTH)
    return g.select("iteration", "win", "offset", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _rdm(source: str, metric: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        ev = D.events(spark, d)
        traj = {"neu": D.neural, "model": D.model, "counts": D.counts}[source](ev)
        return R.rdm(D.windows(spark), traj, LENGTH, metric).select("iteration", "offset", "i", "j", r6("d").alias("d"))

    return run


for _metric, _source in (("euclidean", "neu"), ("correlation", "neu"), ("cosine", "neu"), ("hamming", "counts"), ("jaccard", "counts")):
    QUERIES[f"rdm_{_metric}"] = _rdm(_source, _metric)
    ORACLE_SQL[f"rdm_{_metric}"] = spread(EV, NEURAL, D.COUNTS, WIN, D.rdm_sql(_source, _metric)) + f'SELECT iteration, o AS "offset", i, j, round(d, 6) + 0.0 AS d FROM d_{_source}'


@query(spread(EV, NEURAL, WIN, D.z_sql("neu")) + 'SELECT iteration, o AS "offset", i, j, round(z, 6) + 0.0 AS z FROM z_neu')
def rdm_zscore(spark: SparkSession, d: str) -> DataFrame:
    return D.rdm_z(spark, D.neural(D.events(spark, d))).select("iteration", "offset", "i", "j", r6("z").alias("z"))


@query(spread(EV, NEURAL, WIN, D.z_sql("neu")) + 'SELECT iteration, o AS "offset", CAST(row_number() OVER (PARTITION BY iteration, o ORDER BY i, j) - 1 AS INTEGER) AS pair, round(z, 6) + 0.0 AS z FROM z_neu')
def rdm_block(spark: SparkSession, d: str) -> DataFrame:
    b = R.rdm_blocks(D.windows(spark), D.neural(D.events(spark, d)), LENGTH, "euclidean")
    return b.select("iteration", "offset", F.posexplode("z").alias("pair", "z")).withColumn("z", r6("z"))


RSA = spread(EV, NEURAL, MODEL, WIN, D.rsa_sql("neu", "model"))


def _rsa(spark: SparkSession, d: str) -> DataFrame:
    ev = D.events(spark, d)
    return S.rsa(D.rdm_z(spark, D.neural(ev)), D.rdm_z(spark, D.model(ev)))


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev, w = D.events(spark, d), D.windows(spark)
    return R.rdm_blocks(w, D.neural(ev), LENGTH, "euclidean"), R.rdm_blocks(w, D.model(ev), LENGTH, "euclidean")


@query(RSA + "SELECT t_neural, t_model, round(r, 6) + 0.0 AS r FROM rsa")
def rsa_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rsa(spark, d).select("t_neural", "t_model", r6("r").alias("r"))


@query(RSA + "SELECT t_neural, t_model, round(r, 6) + 0.0 AS r FROM rsa")
def rsa_block(spark: SparkSession, d: str) -> DataFrame:
    return S.rsa_blocks(*_blocks(spark, d)).select("t_neural", "t_model", r6("r").alias("r"))


@query(RSA + f"SELECT t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM rsa WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1")
def lag_curve(spark: SparkSession, d: str) -> DataFrame:
    return S.lag_curve(_rsa(spark, d), REACH).select("lag", r6("r").alias("r"))


@query(RSA + "SELECT t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM rsa WHERE abs(t_neural - t_model) <= 4 AND t_neural BETWEEN 2 AND 9 AND t_model BETWEEN 1 AND 7 GROUP BY 1")
def lag_curve_cut(spark: SparkSession, d: str) -> DataFrame:
    return S.lag_curve(S.cut(_rsa(spark, d), (2, 9), (1, 7)), 4).select("lag", r6("r").alias("r"))


@query(RSA + f"SELECT arg_max(lag, r) AS peak_lag, round(max(r), 6) + 0.0 AS peak_r FROM (SELECT t_neural - t_model AS lag, avg(r) AS r FROM rsa WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1)")
def lag_peak(spark: SparkSession, d: str) -> DataFrame:
    return S.peak(S.lag_curve(_rsa(spark, d), REACH)).select("peak_lag", r6("peak_r").alias("peak_r"))


@query(spread(EV, NEURAL, WIN, D.z_sql("neu"), SHUFFLED, "g_s AS (SELECT iteration, win, CAST(o AS INTEGER) AS o, f FROM shuf, range(12) c(o), neu WHERE neu.t = start + o)", "d_s AS (SELECT iteration, a.o, a.win AS i, b.win AS j, list_distance(a.f, b.f) AS d FROM g_s a JOIN g_s b USING (iteration, o) WHERE a.win < b.win)", "z_s AS (SELECT iteration, o, i, j, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS z FROM d_s WINDOW w AS (PARTITION BY iteration, o))", "e AS (SELECT iteration, n.o AS t_neural, m.o AS t_model, avg(n.z * m.z) AS r FROM z_s n JOIN z_neu m USING (iteration, i, j) GROUP BY 1, 2, 3)") + "SELECT t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM (SELECT t_neural, t_model, avg(r) AS r FROM e GROUP BY 1, 2) WHERE abs(t_neural - t_model) <= 6 GROUP BY 1")
def null_shuffle_curve(spark: SparkSession, d: str) -> DataFrame:
    """The negative control: one side's windows in another order."""
    traj = D.neural(D.events(spark, d))
    shuffled = R.zscored(R.rdm(Win.permute_windows(D.windows(spark), 11), traj, LENGTH, "euclidean"), "d", ("iteration", "offset"))
    return S.lag_curve(S.rsa(shuffled, D.rdm_z(spark, traj)), REACH).select("lag", r6("r").alias("r"))


SELF = spread(EV, MODEL, WIN, D.rsa_sql("model", "model"))


@query(SELF + f"SELECT t_neural - t_model AS lag, round(avg(r), 6) + 0.0 AS r FROM rsa WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1")
def self_similarity_curve(spark: SparkSession, d: str) -> DataFrame:
    """The positive control: a model with itself is 1 at lag 0."""
    z = D.rdm_z(spark, D.model(D.events(spark, d)))
    return S.lag_curve(S.rsa(z, z), REACH).select("lag", r6("r").alias("r"))


@query(SELF + f"SELECT CAST(least(coalesce(max(abs(lag)) FILTER (WHERE abs(r) >= 0.05), 0), {REACH}) AS INTEGER) AS border FROM (SELECT t_neural - t_model AS lag, avg(r) AS r FROM rsa WHERE abs(t_neural - t_model) <= {REACH} GROUP BY 1)")
def regression_border(spark: SparkSession, d: str) -> DataFrame:
    z = D.rdm_z(spark, D.model(D.events(spark, d)))
    return S.border(S.lag_curve(S.rsa(z, z), REACH), 0.05, REACH)


@query(spread(EV, "s AS (SELECT subject, sec AS tau FROM ev WHERE event_type = 'signup')", "p AS (SELECT subject, sec, min(event_id) AS t FROM ev WHERE event_type = 'click' GROUP BY 1, 2)", "b AS (SELECT s.subject, s.tau, p.sec, p.t FROM s ASOF JOIN p ON s.subject = p.subject AND s.tau >= p.sec)", "a AS (SELECT s.subject, s.tau, p.sec, p.t FROM s ASOF JOIN p ON s.subject = p.subject AND s.tau <= p.sec)") + "SELECT subject, tau, arg_min(t, (abs(sec - tau), sec)) AS t FROM (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) GROUP BY 1, 2")
def nearest_time(spark: SparkSession, d: str) -> DataFrame:
    """The click nearest to each of a subject's sign-ups."""
    ev = D.events(spark, d)
    series = ev.where("event_type = 'click'").select("subject", F.col("event_id").alias("t"), "sec")
    return S.nearest_time(series, ev.where("event_type = 'signup'").select("subject", F.col("sec").alias("tau")).distinct(), ("subject",))


def _regression(method: str, sql: str | None = None, **options: float) -> None:
    """Of one predictor: own RDM at t_model, without other models or offsets within the border."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        n, m = _blocks(spark, d)
        out = G.cross_temporal(n, {"m": m}, {"m": LENGTH}, 3, method, **options)
        return out.select("model", "t_neural", "t_model", r6("beta").alias("beta"), r6("r2").alias("r2"))

    QUERIES[f"{method}_beta"] = run
    if sql:
        ORACLE_SQL[f"{method}_beta"] = RSA + f", b AS (SELECT *, {sql} AS beta FROM each_r WHERE abs(t_neural - t_model) <= 3) SELECT 'm' AS model, t_neural, t_model, round(avg(beta), 6) + 0.0 AS beta, round(avg(2 * beta * r - beta * beta), 6) + 0.0 AS r2 FROM b GROUP BY 2, 3"


# With one standardised predictor of 45 pairs, all have a closed form in r; R squared is 2 b r - b b.
_regression("ridge", "r * 45 / (45 + 2.0)", alpha=2.0)
_regression("lasso", "sign(r) * greatest(abs(r) - 0.05, 0)", alpha=0.05)
_regression("elasticnet", "sign(r) * greatest(abs(r) - 0.05, 0) / 1.05", alpha=0.1, l1_ratio=0.5)
_regression("pcr", "r", explained=0.85)


@query()
def cross_temporal_elasticnet(spark: SparkSession, d: str) -> DataFrame:
    """Two models with their borders, all offsets within reach."""
    ev, w = D.events(spark, d), D.windows(spark)
    n, m = _blocks(spark, d)
    c = R.rdm_blocks(w, D.counts(ev), LENGTH, "euclidean")
    out = G.cross_temporal(n, {"envelope": m, "counts": c}, {"envelope": 1, "counts": 1}, 2, "elasticnet", alpha=0.1)
    return out.select("model", "t_neural", "t_model", r6("beta").alias("beta"), r6("r2").alias("r2"))
