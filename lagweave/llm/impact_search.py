"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are cut into blocks by a hash of their id. A block's index has, for each
dimension, posting segments: the vectors whose component falls into one of
``LEVELS`` steps. A query's segments are processed by descending quantised
impact, each adding its impact to its vectors' accumulators. An accumulator is a
lower bound of a vector's score; with the largest impacts that are still to come
and the steps' widths it gives an upper bound. A block stops early only where the
bounds prove that at most a few vectors can still be among the k best of those
that have been scored exactly; these possible members are rescored exactly. Ties
can't be lost, since a vector is kept while its upper bound reaches the k-th score.

Blocks of queries meet blocks of candidates in a grid of tasks of bounded size;
each gives k rows a query at most, which are ranked at the end.

Sums are of doubles, and of 64-bit integers where doubles might round them.
Components x count as floor(256 * x). Vectors that are null or empty or hold a
null or non-finite component take no part; shorter vectors count as filled up
with zeros. An id that is there twice is one query (of its largest vector), and
no row with the query's id is a candidate. Rows with a null id take no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a dimension; vectors of a block of candidates, and of a block of queries where there are many.
LEVELS, CANDIDATES, QUERIES = 16, 16_384, 16_384
#: Of the last number's parts of the segments, those after which a stop is tried.
STOPS = (4, 8, 11, 13, 15, 16)


class Block:
    """Impact-ordered segments of a block of integer vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.largest = float(np.abs(x).max(initial=0))
        n, dims = x.shape
        low, high = x.min(0), x.max(0)
        step = np.maximum(-((low - high - 1) // LEVELS), 1)
        level = (x - low) // step
        self.lo, self.hi = np.zeros((dims, LEVELS)), np.zeros((dims, LEVELS))
        self.has = np.zeros((dims, LEVELS), bool)
        self.members: list[np.ndarray] = []
        for d in range(dims):
            order = np.argsort(level[:, d], kind="stable")
            cut = np.searchsorted(level[order, d], np.arange(LEVELS + 1))
            for k in range(LEVELS):
                own = order[cut[k] : cut[k + 1]]
                self.members.append(own)
                if len(own):
                    v = x[own, d]
                    self.lo[d, k], self.hi[d, k], self.has[d, k] = v.min(), v.max(), True

    def possible(self, q: np.ndarray, k: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of vectors among which the k best of those in ok are."""
        qd = q[:, None].astype(float)
        least = np.where(qd >= 0, qd * self.lo, qd * self.hi)
        slack = np.where(self.has, np.abs(qd) * (self.hi - self.lo), 0).max(1).sum()
        impact = np.where(self.has, least, np.inf)
        base = impact.min(1)
        impact = np.where(self.has, impact - base[:, None], -1)
        by_dim = np.argsort(-impact, axis=1, kind="stable")
        ranked = np.take_along_axis(impact, by_dim, 1)
        after = np.maximum(np.concatenate([ranked[:, 1:], np.zeros((len(q), 1))], 1), 0)
        drop = np.empty_like(impact)
        np.put_along_axis(drop, by_dim, np.maximum(ranked, 0) - after, 1)
        flat = impact.ravel()
        order = np.argsort(-flat, kind="stable")
        order = order[: int((flat > 0).sum())]
        left = np.maximum(ranked[:, 0], 0).sum() - np.cumsum(drop.ravel()[order])
        acc = np.full(len(self.x), base.sum(), np.float64)
        acc[~ok] = -np.inf
        wide = float(np.abs(q).sum()) * self.largest >= 2**52  # doubles might round a score

        def exact(at: np.ndarray) -> np.ndarray:
            return self.x[at].astype(np.int64) @ q.astype(np.int64) if wide else self.x[at] @ q

        at = 0
        self.segments, self.done = len(order), 0
        for share in STOPS:
            end = -(-len(order) * share // STOPS[-1])
            for s in order[at:end]:
                acc[self.members[s]] += flat[s]
            at = self.done = end
            rest = (left[end - 1] if end else 0) + slack
            if wide:
                rest += 1e-9 * (np.abs(acc[ok]).max(initial=0) + abs(rest))
            best = np.argpartition(acc, -min(8 * k, len(acc)))[-min(8 * k, len(acc)) :]
            best = best[ok[best]]
            if len(best) >= k:
                bar = np.partition(exact(best), -k)[-k]
                alive = np.flatnonzero(acc + rest >= bar)
                # What can still be among the k best is scored exactly, if that is less work than to go on.
                if len(alive) <= max(64 * k, len(acc) // 16) or end == len(order):
                    return alive, exact(alive)
            if end == len(order):
                break
        alive = np.flatnonzero(ok)
        return alive, exact(alive)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of a list column, filled up with zeros."""
    out = np.zeros((len(column), dims))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.floor(256 * out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k best of each query, ties to the smaller id."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("q"))
    n, n_q, dims = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v"))).first()
    rank_schema = f"query_id bigint, rank int, `{id_col}` bigint, score bigint"
    if not n or not n_q:
        return vectors.sparkSession.createDataFrame([], rank_schema)
    # Few queries are still cut into some blocks, for tasks to work side by side.
    n_c, n_b = math.ceil(n / CANDIDATES), max(math.ceil(n_q / QUERIES), min(8, math.ceil(n_q / 128)))

    def packed(rows: DataFrame, name: str, blocks: int) -> DataFrame:
        """One row a block: its ids and integers as bytes."""

        def pack(key, t):  # noqa: ANN001, ANN202
            m = _matrix(t.column("v").combine_chunks(), dims)
            small = np.abs(m).max(initial=0) < 32768
            raw = m.astype(np.int16 if small else np.int64).tobytes()
            return pa.table({name: [key[0].as_py()], f"{name}_ids": [t.column("id").to_numpy().astype(np.int64).tobytes()], f"{name}_x": [raw]})

        return rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias(name), "id", "v").groupBy(name).applyInArrow(pack, f"{name} bigint, {name}_ids binary, {name}_x binary")

    asked = rows.where("q").groupBy("id").agg(F.max("v").alias("v"))
    cells = packed(rows, "c", n_c).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_b - 1).cast("long"))))
    sides = packed(asked, "b", n_b).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    grid = cells.hint("shuffle_merge").join(sides, ["b", "c"]).select("c", "c_ids", "c_x", "b_ids", "b_x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                c, c_ids, c_x, b_ids, b_x = (batch.column(j)[i].as_py() for j in range(5))
                ids, q_ids = np.frombuffer(c_ids, np.int64), np.frombuffer(b_ids, np.int64)
                unpack = lambda raw, m: np.frombuffer(raw, np.int16 if len(raw) == 2 * dims * m else np.int64).reshape(m, dims).astype(np.float64)
                if of != c:
                    index, of = Block(unpack(c_x, len(ids))), c
                queries, out = unpack(b_x, len(q_ids)), []
                for q_id, q in zip(q_ids, queries, strict=True):
                    at, s = index.possible(q, k, ids != q_id)
                    best = np.lexsort((ids[at], -s))[:k]
                    out.append((np.full(len(best), q_id), ids[at][best], s[best].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], ["query_id", "id", "score"])

    found = grid.mapInArrow(search, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
