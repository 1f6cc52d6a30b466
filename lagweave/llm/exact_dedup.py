"""Exact dedup by an extendible-hash index on shared files; DataFrame operations only.

1. Directory: a bucket of keys splits, and with it the directory doubles, until no
   bucket holds more than ``capacity`` entries (or the depth is ``MAX_DEPTH``, where
   a bucket goes on). Buckets that aren't overfull keep the smaller depth they had.
2. Index: each row goes to the bucket of its key. Its owners see the key's texts
   whole: copies are one entry, and texts that share a key and differ in a byte
   are chained. A hot text is one row per task before the shuffle. Entries are
   written to the shared folder, a bucket in one file and in order of their key.
3. Look-up: each row finds its entry by bucket and key. Where that is a chain, its
   rows compare whole texts.

Nulls count as the empty text. Of equal texts, the row with the largest id
stays; rows that repeat an id and a text count as copies, and each of them is
returned. A null id is below every other. An empty table gives no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: A directory has at most 2**16 rows, so that it may be broadcast (under 3 MB).
MAX_DEPTH = 16


def _prefix(key: Column, depth: int | Column) -> Column:
    """The leading `depth` bits of a 64-bit key, by arithmetic that knows depth 0."""
    top = F.shiftrightunsigned(key, 64 - MAX_DEPTH)
    return F.floor(top / F.pow(F.lit(2.0), F.lit(MAX_DEPTH) - depth)).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """slot, bucket, local_depth of every slot in use: which bucket a key prefix of max_depth bits belongs to.

    Every key is an entry. A bucket splits, and with it the directory doubles where
    it must, as long as it holds more than `capacity` entries.
    """
    slots = keys.groupBy(_prefix(F.col("key"), F.lit(max_depth)).alias("slot")).count()
    level = slots.select("slot", "count", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("d"))
    level = level.withColumn("bucket", F.floor(F.col("slot") / F.pow(F.lit(2.0), F.lit(max_depth) - F.col("d"))).cast("long"))
    full = level.groupBy("d", "bucket").agg(F.sum("count").alias("held")).where((F.col("held") > capacity) & (F.col("d") < max_depth))
    # Overfull buckets are 2**max_depth at most. A slot's bucket is one level below the deepest of them that it is in.
    depth = level.join(F.broadcast(full), ["d", "bucket"], "left").groupBy("slot").agg(F.max(F.when(F.col("held").isNotNull(), F.col("d") + 1).otherwise(0)).alias("local_depth"))
    bucket = F.floor(F.col("slot") / F.pow(F.lit(2.0), F.lit(max_depth) - F.col("local_depth"))).cast("long")
    return depth.select("slot", (F.expr("shiftleft(1L, local_depth)") + bucket).alias("bucket"), "local_depth")


def located(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with the bucket of their key; the directory has 2**MAX_DEPTH rows at most."""
    at = F.broadcast(slots.select("slot", "bucket"))
    return rows.withColumn("slot", _prefix(F.col("key"), F.lit(MAX_DEPTH))).join(at, "slot").drop("slot")


def index_of(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """bucket, key, chain (distinct texts of the key), sha, keep_id, group_size (of the one text of a chain of one), in files by bucket and in order of their key.

    Rows go to their bucket's owners with their bytes: copies meet before and after
    that shuffle, and texts of one key that differ in a byte are links of its chain.
    """
    texts = rows.groupBy("bucket", "key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    links = texts.select("bucket", "key", F.sha2("text", 256).alias("sha"), "keep_id", "n")
    one = links.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("chain"), F.max("sha").alias("sha"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return kept(one.repartition("bucket").sortWithinPartitions("bucket", "key"), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 10_000, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    capacity: entries of a bucket. key_bits: as many bits of the key are compared
    before the texts are; fewer serve to test chains.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits), 64 - key_bits)
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    slots = kept(directory(rows.select("key").distinct(), capacity), "exact-directory", one_file=True)
    placed = located(rows, slots)
    index = index_of(placed, slots)
    out = ["id", "keep_id", "group_size", "sha"]
    chains = index.where("chain > 1").select("bucket", "key")
    # Both sides come straight from their tables, so that a hot key's rows can be split among tasks.
    found = placed.drop("text").join(index.where("chain = 1").drop("chain"), ["bucket", "key"]).select(out)
    if not chains.isEmpty():
        # Along a chain, bytes are compared.
        chained = placed.join(kept(chains, "exact-chains"), ["bucket", "key"], "left_semi")
        link = chained.groupBy("bucket", "key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(chained.join(link, ["bucket", "key", "text"]).withColumn("sha", F.sha2("text", 256)).select(out))
    # Rows with the largest id stay; if that id is there twice with this text, each of its rows is marked.
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each text, the one with the largest id, with all its columns. Of rows that repeat this id and text, the one whose columns have the smallest hash stays."""
    told = exact_dedup(docs, id_col, text_col, **options).select(F.col(id_col).alias("__lw_id"), F.col("text_sha256").alias("__lw_sha"), F.col("kept").alias("__lw_kept"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    on = F.col(id_col).eqNullSafe(F.col("__lw_id")) & (sha == F.col("__lw_sha"))
    marked = kept(told.groupBy("__lw_id", "__lw_sha", "__lw_kept").count(), "exact-decisions")
    alone = docs.join(marked.where("not __lw_kept or count > 1"), on, "left_anti")
    again = marked.where("__lw_kept and count > 1")
    if again.isEmpty():
        return alone
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(again, on).groupBy("__lw_id", "__lw_sha").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])).alias("__lw_row"))
    return alone.unionByName(one.select("__lw_row.*"))
