"""Scans of files that Spark has no reader for, by binaryFile and Arrow; and run tables from file names."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns and codes of a phoneme table.
VOICED, UNVOICED = ("v",), ("uv", "u", "unvoiced")


def wav_scan(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples (16-bit, channels averaged, -1 to 1); a file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), np.int16).reshape(-1, w.getnchannels()).mean(1) / 32768
                    rate = w.getframerate()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64()))], ["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate int, samples array<double>")


def npy_scan(spark: SparkSession, path: str) -> DataFrame:
    """path, t, features of (features, time) arrays; one axis counts as one feature. Rows are time points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.atleast_2d(np.load(io.BytesIO(raw), allow_pickle=False)).astype(float).T
                for a in range(0, len(x), 10_000):
                    part = x[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part.tolist(), pa.list_(pa.float64()))], ["path", "t", "features"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, t int, features array<double>")


def voicing_table(spark: SparkSession, path: str) -> DataFrame:
    """phoneme, voicing (1 or -1) of a phoneme table; others are left out."""
    p = F.lower(F.trim("phonation"))
    return spark.read.csv(path, header=True).select(F.lower(F.trim("phoneme")).alias("phoneme"), F.when(p.isin(*VOICED), 1).when(p.isin(*UNVOICED), -1).alias("voicing")).where("voicing is not null")


def runs(files: DataFrame, path: str = "path") -> DataFrame:
    """subject, session, task of the files that are named after them."""
    part = lambda k: F.regexp_extract(path, rf"(?:^|[/_]){k}-([A-Za-z0-9]+)", 1)
    rows = files.select(part("sub").alias("subject"), part("ses").alias("session"), part("task").alias("task"))
    return rows.where("subject <> '' and session <> '' and task <> ''").distinct()


def results(files: DataFrame, path: str = "path") -> DataFrame:
    """subject, rate, method, kind (base or simulation) and label of result files."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    pattern = r"^sub-?(\w+?)_res(\d+)_([a-z]+)(?:_sim_(\d+)_(.+?))?\.parquet$"
    get = lambda k: F.regexp_extract(name, pattern, k)
    return files.select(get(1).alias("subject"), get(2).alias("rate"), get(3).alias("method"), F.when(get(4) != "", "simulation").otherwise("base").alias("kind"), get(5).alias("label")).where("subject <> ''")


def resolve_paths(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """path (as asked for) and found (as it is spelt there, whatever the case)."""
    return wanted.join(there.select(F.lower("path").alias("_k"), F.col("path").alias("found")), F.lower("path") == F.col("_k"), "left").groupBy("path").agg(F.min("found").alias("found"))
