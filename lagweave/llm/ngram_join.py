"""N-gram Jaccard join by a blocked sparse matrix product of documents and n-grams.

A document is the set of its distinct word shingles, held as 64-bit hashes. Rows
with equal sets are one class from the start.

1. Columns: of the n-grams, in one order for all (frequent ones last, as counted
   over all documents), the first ``n - ceil(t n) + 1`` of a set are enough: two
   sets with similarity t share one of them. Only these columns are multiplied
   first. Classes of one column whose sizes allow a link are paired; in a column
   of more than ``MANY`` classes, those next to each other in size are chained
   instead, so that no column emits all its pairs.
2. Bounds: parities of hash bits bound the symmetric difference from below,
   and sizes bound the one that a link allows from above; other pairs go.
3. Blocks: what is still tied together is a block of rows (large ones are cut
   and meet in a grid of block pairs). In a block, a row is multiplied with all
   rows that the bounds leave and that it isn't yet tied to, which accumulates
   their overlap counts over all columns; links that these prove tie rows.

Links come out as a forest; components are those of the full set of links. No
group emits all its pairs, and none is capped.

A null or empty text, or one without words, has the empty set: size 0, linked
with nothing, a component of itself. A text of fewer words than n is one shingle.
An id that several rows bear is one node, with the links of each of its texts. A
row with a null id gets a null component and takes part in no link. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .graph import components
from .shared import PACKED_BYTES, dropped, kept, pieces, shuffled, small_batches

MANY = 32
#: Frequent n-grams that are known by name when columns are ordered: a bound on what is broadcast (8 MB). Any order gives the same links.
KNOWN = 1_000_000
#: Rows, and n-grams of all rows, of a block that one task holds.
BLOCK, TASK_COLUMNS = 2048, 500_000
#: Bytes of text whose n-grams one owner task has, about.
TASK_TEXT = 2 << 20
#: Counters that are made at a time when parities are taken.
CELLS = 1 << 20
#: Columns whose hash is in the lowest quarter come first; of these the counts are known.
LOW = np.uint64(1 << 62)
_POSTING = np.dtype([("t", "<u8"), ("id", "<i8"), ("n", "<i4")])


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of (row, hash), their rows, and the rows' sizes."""
    data, offsets = B.flat(column)
    data = B.lower(data)
    start, end, row = B.spans(data, offsets)
    words = B.word_hash(data, B.prefix_hash(data), start, end)
    h, r = B.distinct(*B.shingles(words, row, len(offsets) - 1, k))
    return h, r, np.bincount(r, minlength=len(offsets) - 1)


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`sets` of a column of any size, a slice at a time."""
    parts, at = [], 0
    for part in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0, 1 << 20):
        h, row, n = sets(part.column(0), k)
        parts.append((h, row + at, n))
        at += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def at_least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest overlap that lets a set of n reach the similarity num / den."""
    return -(-n * num // den)


def odd_bits(at: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Bits (n_rows, width / 8) of the numbers under width that a row has an odd number of times; row ascends. Rows are counted CELLS bits at a time, packed at once."""
    out = np.empty((n_rows, width // 8), np.uint8)
    step = max(1, CELLS // width)
    for lo in range(0, n_rows, step):
        hi = min(n_rows, lo + step)
        a, b = np.searchsorted(row, (lo, hi))
        count = np.bincount((row[a:b] - lo) * width + at[a:b], minlength=(hi - lo) * width)
        out[lo:hi] = np.packbits((count & 1).astype(np.uint8).reshape(hi - lo, width), axis=1)
    return out


def parity(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each row, the parities of m classes of its hashes, as bits: m is a power of two, 512 at least and the set's size at least."""
    m = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = (B.mix(h) >> np.uint64(32)).astype(np.int64)
    out: list[bytes] = [b""] * len(n)
    for width in np.unique(m):
        rows = np.flatnonzero(m == width)
        place = np.full(len(n), -1)
        place[rows] = np.arange(len(rows))
        own = place[row] >= 0
        for r, bits in zip(rows, odd_bits(at[own] & (width - 1), place[row[own]], len(rows), int(width)), strict=True):
            out[r] = bits.tobytes()
    return out


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of two sets' symmetric difference: parities that differ, the longer row folded to the shorter one's length."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def split_by(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, bytes of its rows) for each key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True):
        yield int(keys[a]), rows[a:b].tobytes()


def signatures(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """One scan: rows (id, n, f1, f2), and rows (range, packed) of the low hashes of a slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1, PACKED_BYTES):
            h, row, n = sets(part.column(1), k)
            m = part.num_rows
            f1, f2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            np.add.at(f1, row, B.mix(h + np.uint64(1)))
            np.add.at(f2, row, B.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
            low = h[h < LOW]
            own = list(split_by((low >> np.uint64(30)) * np.uint64(ranges) >> np.uint64(32), low))
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], ["id", "n", "f1", "f2", "r", "packed"])
            if own:
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], ["id", "n", "f1", "f2", "r", "packed"])

    return small_batches(docs).mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, r bigint, packed binary")


def frequent(packed: DataFrame) -> np.ndarray:
    """The most frequent low hashes, of those in more than MANY rows: KNOWN at most, where those of the last count go together. Counts stay in the shared folder; the driver gets hashes as bytes, 8 each, and no rows."""

    def count(t):  # noqa: ANN001, ANN202
        u, c = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("packed").to_pylist()]), return_counts=True)
        u, c = u[c > MANY], c[c > MANY]
        return pa.table({"h": u.view(np.int64), "c": c.astype(np.int64)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary())], ["packed"])

    counted = kept(packed.groupBy("r").applyInArrow(count, "h bigint, c bigint"), "ngram-counts")
    by_count = counted.groupBy("c").agg(F.count(F.lit(1)).alias("m")).toArrow()  # as many as there are different counts
    c, m = (by_count.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(-c)
    fits = np.cumsum(m[order]) <= KNOWN
    least = int(c[order][fits][-1]) if fits.any() else np.iinfo(np.int64).max
    got = counted.where(F.col("c") >= least).select("h").mapInArrow(pack, "packed binary").toArrow().column(0)
    known = np.sort(np.frombuffer(b"".join(x.as_buffer() for x in got), np.uint64))
    dropped(counted)
    return known


def columns(docs: DataFrame, k: int, num: int, den: int, known: np.ndarray) -> DataFrame:
    """id, n, bits (parities), first (packed hashes that pairs may share first), heavy (those of frequent ones)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in pieces(batches, 1):
            h, row, n = sets(part.column(1), k)
            kind = (h >= LOW).astype(np.int8)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                kind[known[at] == h] = 2
            bits = parity(h, row, n)
            order = np.lexsort((h, kind, row))
            h, row, kind = h[order], row[order], kind[order]
            rank = np.arange(len(h)) - (np.cumsum(n) - n)[row]
            first = rank < (n - at_least(n, num, den) + 1)[row]
            h, row, kind = h[first], row[first], kind[first]
            light, heavy = kind < 2, kind == 2
            cut = lambda ok: [x.tobytes() for x in np.split(h[ok], np.cumsum(np.bincount(row[ok], minlength=len(n)))[:-1])]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(bits, pa.binary()), pa.array(cut(light), pa.binary()), pa.array(cut(heavy), pa.binary())], ["id", "n", "bits", "first", "heavy"])

    return small_batches(docs).mapInArrow(run, "id bigint, n bigint, bits binary, first binary, heavy binary")


def candidates(cols: DataFrame, num: int, den: int, ranges: int) -> DataFrame:
    """a, b, chained: pairs of one column that sizes allow, or neighbours in a long column."""
    log = math.log(den / num)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            out = []
            for at, more in ((2, (0,)), (3, (0, 1))):
                lists = part.column(at).to_pylist()
                row = np.repeat(np.arange(len(ids)), [len(x) // 8 for x in lists])
                h = np.frombuffer(b"".join(lists), np.uint64)
                for j in more:  # a frequent column is parted by size; each size meets the next one
                    p = np.zeros(len(h), _POSTING)
                    p["t"] = h if at == 2 else B.mix(h + (np.log(n[row]) / log).astype(np.uint64) + np.uint64(j))
                    p["id"], p["n"] = ids[row], n[row]
                    out.append(p)
            p = np.concatenate(out)
            own = list(split_by((B.mix(p["t"]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), p))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], ["r", "packed"])

    def pair(t):  # noqa: ANN001, ANN202
        p = np.concatenate([np.frombuffer(x, _POSTING) for x in t.column("packed").to_pylist()])
        p = p[np.lexsort((p["id"], p["n"], p["t"]))]
        tok, ids, n = p["t"], p["id"], p["n"].astype(np.int64)
        new = np.concatenate([[True], tok[1:] != tok[:-1]])
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        found = []
        for d in range(1, MANY):
            if d >= len(p):
                break
            i = np.flatnonzero((tok[d:] == tok[:-d]) & (n[:-d] * den >= n[d:] * num) & ((size[d:] <= MANY) | (d == 1)))
            if not len(i):
                break
            found.append((ids[i], ids[i + d], size[i] > MANY))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        a, b = np.minimum(a, b), np.maximum(a, b)
        e = np.unique(np.rec.fromarrays([a, b, c], names="a,b,c")) if len(a) else np.rec.fromarrays([a, b, c], names="a,b,c")
        e = e[e["a"] != e["b"]]
        return pa.table({"a": np.ascontiguousarray(e["a"]), "b": np.ascontiguousarray(e["b"]), "chained": np.ascontiguousarray(e["c"])})

    packed = cols.select("id", "n", "first", "heavy").mapInArrow(deal, "r bigint, packed binary")
    return packed.groupBy("r").applyInArrow(pair, "a bigint, b bigint, chained boolean").groupBy("a", "b").agg(F.max("chained").alias("chained"))


def bounded(pairs: DataFrame, cols: DataFrame, num: int, den: int, count: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities allow; chained ones stay."""
    side = lambda s: shuffled(cols.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits")), count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            total = part.column(2).to_numpy() + part.column(4).to_numpy()
            most = total - 2 * at_least(total, num, num + den)
            differ = np.array([apart(x, y) for x, y in zip(part.column(3).to_pylist(), part.column(5).to_pylist(), strict=True)], np.int64)
            yield part.select([0, 1]).filter(pa.array(differ <= most))

    rest = pairs.where("not chained").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    near = rest.select("a", "b", "a_n", "a_bits", "b_n", "b_bits").mapInArrow(run, "a bigint, b bigint")
    return pairs.where("chained").select("a", "b").unionByName(near)


def multiply(ids: np.ndarray, group: np.ndarray, side: np.ndarray, column: pa.Array, k: int, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links that tie together what the full sparse product of each group's rows links; a block pair multiplies one side with the other."""
    h, row, n = sets_of(column, k)
    first = np.cumsum(n) - n
    at = (B.mix(h) >> np.uint64(55)).astype(np.int64)
    bits = odd_bits(at, row, len(n), 512).view(np.uint64).reshape(len(n), 8)
    out_a, out_b = [], []
    order = np.lexsort((ids, n, group))
    cut = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
        own = order[lo:hi]
        label = np.arange(len(own))
        _, same = np.unique(ids[own], return_inverse=True)
        label = same.copy()  # rows of one id are one node
        size, sd = n[own], side[own]
        for i in range(len(own) - 1):
            j = np.arange(i + 1, int(np.searchsorted(size, size[i] * den // num, side="right")))
            j = j[label[j] != label[i]]
            if sd[0] != sd[-1] or len(set(sd.tolist())) > 1:
                j = j[sd[j] != sd[i]]
            if not len(j) or not size[i]:
                continue
            least = -(-(size[i] + size[j]) * num // (num + den))
            j = j[np.bitwise_count(bits[own[j]] ^ bits[own[i]]).sum(1) <= size[i] + size[j] - 2 * least]
            mine = h[first[own[i]] : first[own[i]] + size[i]]
            for a in range(0, len(j), 256):
                part = j[a : a + 256]
                part = part[label[part] != label[i]]
                if not len(part):
                    continue
                theirs = np.concatenate([h[first[own[x]] : first[own[x]] + size[x]] for x in part])
                of = np.repeat(np.arange(len(part)), size[part])
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                overlap = np.bincount(of[mine[at] == theirs], minlength=len(part))
                ok = part[overlap * den >= num * (size[i] + size[part] - overlap)]
                for x in ok:
                    if label[x] != label[i]:
                        out_a.append(int(ids[own[i]]))
                        out_b.append(int(ids[own[x]]))
                        label[label == label[x]] = label[i]
    return out_a, out_b


def links(docs: DataFrame, tied: DataFrame, cols: DataFrame, k: int, num: int, den: int, count: int) -> tuple[DataFrame, DataFrame]:
    """a, b: a forest of the links among the rows of each block of tied (node, component), and the table it reads; cols has the sizes of their sets."""
    tied = kept(tied.join(shuffled(cols.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), count), "node"), "ngram-tied")
    sizes = tied.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("held"))
    total = tied.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // TASK_COLUMNS)
    parts = F.greatest(F.ceil(F.col("count") / (BLOCK // 2)), F.ceil(F.col("held") / (TASK_COLUMNS // 2))).cast("long")
    large = (F.col("count") > BLOCK) | (F.col("held") > TASK_COLUMNS)
    part = F.pmod(F.xxhash64("node"), parts)
    mates = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: F.struct(F.least(x, part).alias("i"), F.greatest(x, part).alias("j")))
    spread = tied.join(shuffled(sizes, count), "component").select(
        "node", "component",
        F.when(large, part).otherwise(0).alias("part"),
        F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets))).alias("key"),
        large.alias("big"),
        F.explode(F.when(large, mates).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))).alias("cell"),
    )
    rows = docs.join(shuffled(spread, count), docs["id"] == spread["node"]).select("id", "text", "component", "part", "big", "key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))

    def run(t):  # noqa: ANN001, ANN202
        out_a: list[int] = []
        out_b: list[int] = []
        ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy()
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        side = t.column("part").to_numpy() if cross else np.zeros(len(ids), np.int64)
        column = t.column("text").combine_chunks()
        out_a, out_b = multiply(ids, comp, side, column, k, num, den)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("big", "key", "i", "j").applyInArrow(run, "a bigint, b bigint"), tied


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links of a Jaccard similarity of num / den or more)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size, count = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = size or 0
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_TEXT + 1)
    scan = kept(signatures(texts, k, ranges), "ngram-signatures")
    rows = scan.where("r is null").select("id", "n", "f1", "f2")
    known = frequent(scan.where("r is not null").select("r", "packed"))
    classes = kept(rows.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "ngram-classes")
    filled = texts.where(F.col("id").isNotNull())
    cols = columns(filled, k, num, den, known).where("n > 0")
    cols = kept(cols.join(shuffled(classes.select(F.col("rep").alias("id")).distinct(), count), "id", "left_semi"), "ngram-columns")
    near = bounded(candidates(cols, num, den, ranges), cols, num, den, count)
    tied = components(near, "ngram-blocks")
    pairs, tied_sizes = links(filled, tied, cols, k, num, den, count)
    found = components(pairs, "ngram-links")
    for done in (cols, tied, tied_sizes):
        dropped(done)
    out = rows.join(shuffled(classes, count), ["n", "f1", "f2"], "left").join(shuffled(found.withColumnRenamed("node", "rep"), count), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns."""
    drop = jaccard_components(docs, id_col, text_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__lw_id"))
    return docs.join(shuffled(drop, docs.count()), F.col(id_col) == F.col("__lw_id"), "left_anti")
