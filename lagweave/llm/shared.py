"""What the corpus operators share: tables in the shared folder and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker scans at a time; its arrays need some 80 times as much.
PIECE_BYTES = 1 << 19
#: The same for scans that deal out packed rows by range, which are fewer and larger then.
PACKED_BYTES = 1 << 20
#: Bytes of a row group of a step's table.
ROW_GROUP = 16 << 20
#: Rows of a slice, where texts are short.
PIECE_ROWS = 1 << 13
#: Rows that a join may broadcast, and so hold in the driver, at most.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where that is unset, a temporary folder of our own on one machine (local master, as in tests), and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lagweave.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lagweave-")
        spark.conf.set("lagweave.shared.dir", at)
    return at.rstrip("/")


def kept(df: DataFrame, name: str, one_file: bool = False) -> DataFrame:
    """df as a table written in the shared folder: its lineage is cut and lost executors cost nothing. one_file: for a table of a few rows, as many as there are sources or slots."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagweave-{name}-{uuid.uuid4().hex}"
    # A writer holds a row group; those of a step are read once or twice, so that small ones do.
    (df.repartition(1) if one_file else df).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest hash of their key: the same rows in every run.

    Where there are many more rows, those whose hash can't be among the n smallest
    (but for odds under one in 10**9) are left out before any is gathered, so that
    tasks send a few rows each, whatever their number.
    """
    total = rows.count()
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string")), 1)
    if total > 4 * n + 1000:
        rows = rows.where(h <= int((2**63 - 1) * min(1.0, (2 * n + 200) / total)))
    return rows.withColumn("__lw_h", h).orderBy("__lw_h", key).limit(n).drop("__lw_h")


def shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df, for a join whose sides may have `rows` rows: with more than BROADCAST_ROWS neither side goes through the driver. Spark would broadcast by the size of a table's file, of which the rows in memory are a multiple."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def dropped(df: DataFrame) -> None:
    """Deletes the tables of :func:`kept` that df reads; for those that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "lagweave-" in path.getName():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, for Python to get in batches of some 4 MB: texts are long, and a batch stands in memory several times. A limit that the session sets itself is left alone."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives what this worker has freed back to the machine; workers that wait for tasks stand beside those at work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of PIECE_ROWS rows at most whose column number `text` holds about `limit` bytes; one long text is one slice."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        column = batch.column(text)
        ends = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(at + PIECE_ROWS, max(at + 1, int(ends.searchsorted(base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    tidy()
