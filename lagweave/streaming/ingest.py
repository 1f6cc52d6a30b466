"""An extension: events as a stream, in tumbling bins of the time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(events: DataFrame, time: str = "ts", width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """bin, n, total of a stream or a table of events; a bin is final once the watermark has passed it."""
    rows = events.withColumn("_time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_time", late)
    return rows.groupBy(F.window("_time", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bin"), "n", "total")
