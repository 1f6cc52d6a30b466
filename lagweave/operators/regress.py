"""Regression of one RDM on the others: ridge, lasso, elastic net and principal components, at each pair of offsets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standard(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd == 0, 1.0, sd)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Minimises |y - x b|^2 + alpha |b|^2."""
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, l1_ratio: float = 0.5, tol: float = 1e-10, rounds: int = 5000) -> np.ndarray:
    """Minimises |y - x b|^2 / (2 n) + alpha l1_ratio |b|_1 + alpha (1 - l1_ratio) |b|^2 / 2 by coordinate descent on the Gram matrix."""
    return descend(x.T @ x / len(y), x.T @ y / len(y), alpha, l1_ratio, tol, rounds)


def descend(gram: np.ndarray, c: np.ndarray, alpha: float, l1_ratio: float, tol: float = 1e-10, rounds: int = 5000) -> np.ndarray:
    """Coordinate descent for :func:`elastic_net`; gram and c are means over rows."""
    l1, l2, b = alpha * l1_ratio, alpha * (1 - l1_ratio), np.zeros(len(c))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(b)):
            if gram[k, k] == 0:
                continue
            rho = c[k] - gram[k] @ b + gram[k, k] * b[k]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[k, k] + l2)
            moved, b[k] = max(moved, abs(new - b[k])), new
        if moved < tol:
            break
    return b


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    return elastic_net(x, y, alpha, 1.0)


def components_regression(x: np.ndarray, y: np.ndarray, explained: float = 0.85) -> tuple[np.ndarray, int]:
    """Least squares on the first components whose shares of variance reach `explained`, back in terms of x."""
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    k = int(np.searchsorted(share, explained - 1e-12) + 1)
    scores = (x - x.mean(0)) @ vt[:k].T
    return vt[:k].T @ np.linalg.lstsq(scores, y - y.mean(), rcond=None)[0], k


def r_squared(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> float:
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - x @ b) ** 2).sum() / total) if total else 0.0


def fit(method: str, x: np.ndarray, y: np.ndarray, **options: float) -> tuple[np.ndarray, float, int | None]:
    x, y = standard(x), standard(y[:, None])[:, 0]
    if method == "pcr":
        b, k = components_regression(x, y, options.get("explained", 0.85))
        return b, r_squared(x, y, b), k
    call = {"ridge": ridge, "lasso": lasso, "elasticnet": elastic_net}[method]
    b = call(x, y, **{k: v for k, v in options.items() if k in ("alpha", "l1_ratio") and not (k == "l1_ratio" and method != "elasticnet")})
    return b, r_squared(x, y, b), None


def design(models: list[np.ndarray], which: int, t_model: int, reach: int, border: int) -> np.ndarray:
    """Columns: the model itself at t_model, then the other models' offsets within reach, then its own farther than its border."""
    at = columns([len(m) for m in models], which, t_model, reach, border)
    return np.stack([models[k][t] for k, t in at]).T


def columns(lengths: list[int], which: int, t_model: int, reach: int, border: int) -> list[tuple[int, int]]:
    """(model, offset) of the columns of :func:`design`."""
    near = [[t for t in range(n) if abs(t - t_model) <= reach] for n in lengths]
    rest = [(k, t) for k, ts in enumerate(near) if k != which for t in ts]
    return [(which, t_model), *rest, *[(which, t) for t in near[which] if abs(t - t_model) > border]]


def solver(method: str, gram: np.ndarray, rows: int, options: dict[str, float]) -> tuple[Callable[[np.ndarray], np.ndarray], int | None]:
    """From X'y / rows to the coefficients, for standardised columns with X'X / rows = gram; and the number of components, where there are any. What doesn't depend on y is done once."""
    if method == "pcr":
        value, vector = np.linalg.eigh(gram)
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        k = int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), options.get("explained", 0.85) - 1e-12) + 1)
        v, w = vector[:, :k], np.where(value[:k] > 1e-12, value[:k], np.inf)
        return lambda c: v @ ((v.T @ c) / w), k
    if method == "ridge":
        inverse = np.linalg.inv(gram * rows + options.get("alpha", 1.0) * np.eye(len(gram)))
        return lambda c: inverse @ (c * rows), None
    ratio = 1.0 if method == "lasso" else options.get("l1_ratio", 0.5)
    return lambda c: descend(gram, c, options.get("alpha", 1.0), ratio), None


def fits(neural: DataFrame, models: dict[str, DataFrame], borders: dict[str, int], reach: int, method: str = "elasticnet", by: tuple[str, ...] = (), predictors: tuple[str, ...] | None = None, **options: float) -> DataFrame:
    """by, iteration, model, t_neural, t_model, beta (of the model at t_model), r2, components: a row for each fit.

    Blocks (by, iteration, offset, z) of the neural signal and of all models meet by
    iteration and by a band of 2 reach + 1 offsets of the models: each block goes to
    the two or three bands whose fits it is part of, so that what is shuffled grows
    with the RDMs. A band's Gram matrix is made once; fits of one design share
    what doesn't depend on the neural offset. Cells farther apart than reach are
    never fitted. predictors: models that may stand beside the one in question (all).
    """
    names = list(models)
    if not names:
        raise ValueError("a regression needs a model")
    beside = {k for k, n in enumerate(names) if predictors is None or n in predictors}
    if method not in ("ridge", "lasso", "elasticnet", "pcr"):
        raise ValueError(f"no method {method}")
    wide = 2 * reach + 1
    side = lambda df, k: df.select(*by, F.col("iteration").cast("int").alias("iteration"), F.lit(k).alias("side"), F.col("offset").cast("int").alias("offset"), "z")
    rows = side(neural, -1)
    for k, name in enumerate(names):
        rows = rows.unionByName(side(models[name], k))
    bands = F.sequence(F.greatest(F.floor((F.col("offset") - reach) / wide), F.lit(0)), F.floor((F.col("offset") + reach) / wide))
    spread = rows.withColumn("band", F.explode(bands))
    kinds = dict(neural.dtypes)

    def run(t):  # noqa: ANN001, ANN202
        band, at, off = t.column("band")[0].as_py(), t.column("side").to_numpy(), t.column("offset").to_numpy()
        z = t.column("z").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        order = np.lexsort((off, at))
        at, off, z = at[order], off[order], z[order]
        x, ys = z[at >= 0], z[at < 0]
        n = z.shape[1]
        gram, cs = x @ x.T / n, x @ ys.T / n
        place = {(int(k), int(o)): i for i, (k, o) in enumerate(zip(at[at >= 0], off[at >= 0], strict=True))}
        out: list[tuple] = []
        for tm in sorted({o for _, o in place if o // wide == band}):
            cells = [(j, int(tn)) for j, tn in enumerate(off[at < 0]) if abs(int(tn) - tm) <= reach]
            for k, name in enumerate(names):
                if (k, tm) not in place:
                    continue
                near = [(m, o) for m, o in place if abs(o - tm) <= reach and (m, o) != (k, tm) and m in beside and (m != k or abs(o - tm) > borders.get(name, 0))]
                own = [place[k, tm], *[place[c] for c in sorted(near)]]
                g = gram[np.ix_(own, own)]
                solve, components = solver(method, g, n, options)
                for j, tn in cells:
                    c = cs[own, j]
                    b = solve(c)
                    total = float((ys[j] ** 2).mean())
                    out.append((name, tn, tm, float(b[0]), float(2 * b @ c - b @ g @ b) / total if total else 0.0, components))
        cols = list(zip(*out, strict=True)) or [()] * 6
        fixed = {c: pa.array([t.column(c)[0].as_py()] * len(out), t.schema.field(c).type) for c in (*by, "iteration")}
        kind = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32())
        return pa.table({**fixed, **{m: pa.array(c, y) for m, c, y in zip(("model", "t_neural", "t_model", "beta", "r2", "components"), cols, kind, strict=True)}})

    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "iteration int, model string, t_neural int, t_model int, beta double, r2 double, components int"
    return spread.groupBy(*by, "iteration", "band").applyInArrow(run, schema)


def cross_temporal(neural: DataFrame, models: dict[str, DataFrame], borders: dict[str, int], reach: int, method: str = "elasticnet", by: tuple[str, ...] = (), predictors: tuple[str, ...] | None = None, **options: float) -> DataFrame:
    """by, model, t_neural, t_model, beta, r2: the means of :func:`fits` over iterations."""
    each = fits(neural, models, borders, reach, method, by, predictors, **options)
    return each.groupBy(*by, "model", "t_neural", "t_model").agg(F.avg("beta").alias("beta"), F.avg("r2").alias("r2"))


def component_counts(each: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, low, median, high of the numbers of components of fits."""
    return each.where("components is not null").groupBy(*by).agg(F.min("components").alias("low"), F.percentile("components", F.lit(0.5)).alias("median"), F.max("components").alias("high"))
