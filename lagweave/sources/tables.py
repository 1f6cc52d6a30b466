"""Scans: tables, annotation literals, vector text files, manifests, sensor sets and result names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Annotation events: tab-separated with a header and maybe a byte-order mark; the literal column stays a string."""
    return spark.read.csv(path, sep="\t", header=True, encoding="UTF-8")


#: Words of the literal syntax and what JSON has for them.
LITERALS = (("None", "null"), ("nan", "NaN"), ("True", "true"), ("False", "false"))


def parse_literal(raw: Column, schema: T.StructType | str) -> Column:
    """A struct of a dict literal with single or double quotes; null if it can't be read.

    JSON's reader knows both quotes; only the words outside quotes are rewritten.
    """
    out = raw
    for word, json in LITERALS:
        out = F.regexp_replace(out, rf"(?<=[:\[,\s]){word}(?=\s*[,}}\]])", json)
    return F.from_json(out, schema, {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"})


def number(raw: Column) -> Column:
    """A double, or null where it isn't one or isn't finite."""
    x = raw.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def vectors_of(lines: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """token, vector of lines (line, value); only tokens in vocabulary (token), the last line of a token wins."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("line", parts.alias("p")).where(F.size("p") > 2)
    rows = rows.select("line", F.col("p")[0].alias("token"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("double")).alias("vector"))
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("token").distinct(), "token", "left_semi")
    return rows.groupBy("token").agg(F.max_by("vector", "line").alias("vector"))


def vectors_text(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """:func:`vectors_of` the lines of a text file."""
    return vectors_of(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"), vocabulary)


def events_of(lines: DataFrame, schema: str, literal: str, column: str = "trial_type") -> DataFrame:
    """Rows of tab-separated lines (value) with the fields of their literal column; those whose literal can't be read are skipped."""
    row = lines.select(F.from_csv(F.regexp_replace("value", "^\ufeff", ""), schema, {"sep": "\t", "quote": ""}).alias("r")).select("r.*")
    return row.withColumn("__a", parse_literal(F.col(column), literal)).where("__a is not null and __a.kind is not null").drop(column).select("*", "__a.*").drop("__a")


def manifest_of(texts: DataFrame, fields: str, by: tuple[str, ...] = (), column: str = "json") -> DataFrame:
    """by, seg_no and the fields of each segment of manifests that are JSON texts; the order is that of their lists."""
    rows = texts.select(*by, F.from_json(column, f"segments array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>").alias("m"))
    return rows.select(*by, F.posexplode("m.segments").alias("seg_no", "segment")).select(*by, "seg_no", "segment.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """seg_no and the fields of each segment of a manifest; its order is that of the list."""
    return spark.read.json(path, multiLine=True).select(F.posexplode("segments").alias("seg_no", "segment")).select("seg_no", "segment.*")


def sensor_set(lines: DataFrame) -> DataFrame:
    """side, channel of a sectioned list (line_no, value): [Left], [Right], [Central]; comments and key=value lines are skipped."""
    text = F.trim("value")
    head = F.regexp_extract(text, r"^\[(\w+)\]$", 1)
    order = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("line_no", text.alias("value"), F.last(F.when(head != "", F.lower(head)), ignorenulls=True).over(order).alias("side"))
    keep = F.col("side").isNotNull() & (F.col("value") != "") & ~F.col("value").rlike(r"^(#|\[)|=")
    return rows.where(keep).select("line_no", "side", F.col("value").alias("channel"))


def latest_run(runs: DataFrame, by: str, name: str, modified: str) -> DataFrame:
    """The newest run of each key: a time stamp in its name beats the time of its file."""
    stamp = F.regexp_extract(name, r"(\d{8}_\d{6})", 1)
    key = F.struct((stamp != "").alias("stamped"), F.when(stamp != "", stamp).otherwise("").alias("stamp"), F.col(modified), F.col(name))
    return runs.groupBy(by).agg(F.max_by(name, key).alias("run"))
