"""Sinks: tables written once, skipped or replaced, with a row of their settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What to do where the table is there already.
MODES = {"skip": "ignore", "replace": "overwrite", "fail": "errorifexists"}


def save(df: DataFrame, path: str, existing: str = "skip", partition_by: tuple[str, ...] = (), kind: str = "parquet") -> None:
    """Writes df; Spark's commit makes it appear whole or not at all."""
    writer = df.write.mode(MODES[existing])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(kind).save(path)


def run_metadata(df: DataFrame, settings: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each product, where by names them): rows, columns, and the settings as JSON with their hash."""
    text = json.dumps(settings, sort_keys=True)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).select(*by, "n_rows", F.lit(",".join(df.columns)).alias("columns"), F.lit(text).alias("settings"), F.sha1(F.lit(text)).alias("params_hash"))
