"""Control of an analysis on the driver: settings and their checks, places of files, steps that are done once, results that are read again."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks


@dataclass(frozen=True)
class Settings:
    subsamples: int = 150
    iterations: int = 100
    window_seconds: float = 5.0
    averaging_seconds: float = 3.0
    rate: float = 100.0
    method: str = "correlation"
    l1_ratio: float = 0.5
    border_threshold: float = 0.1
    progress_every: int = 50
    noise: bool = False
    shuffle_windows: bool = False
    models: str = ""

    def checked(self) -> Settings:
        """Itself, or an error that names the first setting out of its range."""
        rules = (
            (0 <= self.l1_ratio <= 1, "l1_ratio must be from 0 to 1"),
            (self.subsamples > 1, "subsamples must be 2 or more"),
            (self.iterations > 0, "iterations must be positive"),
            (self.window_seconds > 0, "window_seconds must be positive"),
            (self.averaging_seconds > 0, "averaging_seconds must be positive"),
            (self.rate > 0, "rate must be positive"),
            (self.progress_every > 0, "progress_every must be positive"),
            (self.method in ("correlation", "ridge", "lasso", "elasticnet", "pcr"), "method is unknown"),
            (self.noise or not self.shuffle_windows, "shuffle_windows needs noise"),
        )
        for ok, why in rules:
            if not ok:
                raise ValueError(why)
        return self

    @property
    def length(self) -> int:
        """Points of a window."""
        return round(self.window_seconds * self.rate)

    @property
    def reach(self) -> int:
        """Lags of a curve to each side; no more than a window has."""
        return min(round(self.averaging_seconds * self.rate), self.length - 1)

    def caption(self) -> str:
        """One line for figures and tables."""
        kind = "correlation" if self.method == "correlation" else f"{self.method} regression"
        models = self.models or "all models"
        return f"{kind}, {models}; {self.iterations} x {self.subsamples} windows of {self.window_seconds:g} s at {self.rate:g} Hz, lags to {self.reach / self.rate:g} s"

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def base_dir(given: str | None = None, environment: Mapping[str, str] | None = None, variable: str = "LAGWEAVE_DATA") -> str:
    """The folder named, or that of the environment, or the current one."""
    return (given or (environment if environment is not None else os.environ).get(variable) or os.getcwd()).rstrip("/")


def rebased(path: str, old: str, new: str) -> str:
    """A path under the folder old as one under new; others stay."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return new + path[len(old) :] if path == old or path.startswith(old + "/") else path


def vectors_path(given: str | None, environment: Mapping[str, str], pointer: str | None = None) -> str:
    """Where a vector file is: as given, by the environment, or by the first line of a pointer file."""
    found = given or environment.get("LAGWEAVE_VECTORS")
    if not found and pointer and os.path.exists(pointer):
        with open(pointer, encoding="utf-8") as f:
            found = f.readline().strip()
    if not found:
        raise FileNotFoundError("no vector file is named")
    return found


def folders(base: str, analysis: str) -> dict[str, str]:
    """Where an analysis keeps what."""
    root = f"{base.rstrip('/')}/{analysis}"
    return {"root": root, **{k: f"{root}/{k}" for k in ("features", "windows", "results", "group", "logs")}}


def run_steps(steps: list[tuple[str, Callable[[], None]]], first: str | None = None, go_on: bool = False) -> dict[str, str]:
    """Runs named steps in order, from `first` on; with go_on a step that fails doesn't stop the others. Returns what became of each."""
    names = [n for n, _ in steps]
    if first is not None and first not in names:
        raise ValueError(f"no step {first}")
    state, on = {}, first is None
    for name, f in steps:
        on = on or name == first
        if not on:
            state[name] = "skipped"
            continue
        try:
            f()
            state[name] = "done"
        except Exception as e:
            state[name] = f"failed: {e}"
            if not go_on:
                raise
    return state


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def each_subject(spark: SparkSession, subjects: list[str], path: str, make: Callable[[str], DataFrame], spare: Callable[[str], list[str]] = lambda s: []) -> list[str]:
    """One table a subject under path, those that are there already are kept; then the folders that `spare` names for it are deleted. Returns the subjects that were made."""
    made = []
    for s in subjects:
        at = f"{path}/subject={s}"
        if not exists(spark, f"{at}/_SUCCESS"):
            sinks.save(make(s), at, "replace")
            made.append(s)
        prune(spark, spare(s), inside=path)
    return made


def prune(spark: SparkSession, paths: list[str], inside: str) -> None:
    """Deletes folders of intermediate data; all must be inside the folder named."""
    for path in paths:
        if ".." in path.split("/") or not path.startswith(inside.rstrip("/") + "/"):
            raise ValueError(f"{path} isn't inside {inside}")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cached(spark: SparkSession, path: str, settings: Settings, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that these settings gave before, or a new one that is kept under their hash."""
    key = spark.range(1).select(F.sha1(F.lit(settings.as_json())).alias("h")).first()["h"]
    at = f"{path.rstrip('/')}/params_hash={key}"
    if not exists(spark, f"{at}/_SUCCESS"):
        sinks.save(make(), at, "replace")
    return spark.read.parquet(at)


def save_group(tables: dict[str, DataFrame], path: str, settings: Settings) -> None:
    """A group's tables side by side, with a row of their settings; figures are made from these alone."""
    for name, df in tables.items():
        sinks.save(df, f"{path}/{name}", "replace")
    spark = next(iter(tables.values())).sparkSession
    sinks.save(spark.createDataFrame([(settings.as_json(),)], "settings string").coalesce(1), f"{path}/settings", "replace")


def load_group(spark: SparkSession, path: str, names: list[str], settings: Settings | None = None) -> tuple[dict[str, DataFrame], Settings]:
    """The tables of :func:`save_group` and their settings; other settings than those asked for are an error that names them."""
    then = replace(Settings(), **json.loads(spark.read.parquet(f"{path}/settings").first()["settings"]))
    if settings is not None and then != settings:
        differ = [k for k, v in asdict(then).items() if v != asdict(settings)[k]]
        raise ValueError(f"settings differ: {', '.join(differ)}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, then


def sensor_lines(sides: DataFrame) -> DataFrame:
    """line_no, value of a sectioned list of sensors (line_no, side, channel), as :func:`lagweave.sources.tables.sensor_set` reads it."""
    part = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    own = sides.select(part.alias("part"), F.lit(1).alias("k"), "line_no", F.col("channel").alias("value"))
    heads = sides.select(part.alias("part"), F.lit(0).alias("k"), F.lit(0).alias("line_no"), F.concat(F.lit("["), F.initcap("side"), F.lit("]")).alias("value")).distinct()
    rows = heads.select("part", "k", F.col("line_no").cast("long").alias("line_no"), "value").unionByName(own.select("part", "k", F.col("line_no").cast("long").alias("line_no"), "value"))
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("part", "k", "line_no", "value"))).alias("s"))  # a selection of one recording's sensors
    return packed.select(F.posexplode("s").alias("line_no", "s")).select("line_no", "s.value")
