"""The models of an analysis, their metrics and borders, and what predicts what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """border: how much a model must correlate with itself at a lag for its own past to be left out there; None: the analysis' default."""

    label: str
    metric: str
    border: float | None = None
    optional: bool = False


#: The models that analyses know.
MODELS = (
    Model("Envelope", "euclidean", 0.05),
    Model("Phoneme Voicing", "euclidean", 0.05),
    Model("Word Frequency", "euclidean", 0.2),
    Model("GloVe", "correlation", 0.1),
    Model("GloVe Norm", "euclidean", 0.1),
    Model("GPT Next-Token", "correlation", 0.25, optional=True),
    Model("GPT Surprisal", "euclidean", 0.1, optional=True),
)


def selected(models: tuple[Model, ...], wanted: str = "") -> tuple[Model, ...]:
    """Those whose label a comma-separated filter names, whatever the case; all without a filter."""
    names = {x.strip().lower() for x in wanted.split(",") if x.strip()}
    return tuple(m for m in models if not names or m.label.lower() in names)


def metric_column(models: tuple[Model, ...], label: Column) -> Column:
    return F.coalesce(*[F.when(label == m.label, m.metric) for m in models])


def borders(models: tuple[Model, ...], default: float) -> dict[str, float]:
    return {m.label: default if m.border is None else m.border for m in models}


def check_lengths(signals: DataFrame, n_times: int) -> DataFrame:
    """signals (signal, t, ...) unchanged; an error names the first whose number of points isn't n_times."""
    found = signals.groupBy("signal").agg(F.count_distinct("t").alias("n")).where(F.col("n") != n_times).orderBy("signal").first()
    if found:
        raise ValueError(f"{found['signal']}: {found['n']} points instead of {n_times}")
    return signals


def design_columns(models: DataFrame, length: int, reach: int) -> DataFrame:
    """signal, t_model, predictor, t of models (signal, border): an interval join, as many rows as there are columns of all designs."""
    offsets = F.sequence(F.lit(0), F.lit(length - 1))
    own = models.select("signal", "border", F.explode(offsets).alias("t_model"))
    near = own.select("signal", "border", "t_model", F.explode(F.sequence(F.greatest(F.col("t_model") - reach, F.lit(0)), F.least(F.col("t_model") + reach, F.lit(length - 1)))).alias("t"))
    every = models.agg(F.sort_array(F.collect_list("signal")).alias("all"))  # a row: the registry
    rows = near.join(F.broadcast(every), F.lit(True)).select("signal", "border", "t_model", "t", F.explode("all").alias("predictor"))
    itself = F.col("predictor") == F.col("signal")
    keep = ~itself | (F.col("t") == F.col("t_model")) | (F.abs(F.col("t") - F.col("t_model")) > F.col("border"))
    return rows.where(keep).select("signal", "t_model", "predictor", "t")
