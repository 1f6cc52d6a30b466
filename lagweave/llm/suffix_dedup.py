"""Suffix-array dedup: bytes that a repeated string of ``length`` bytes covers are removed, but for its first place.

1. Anchors: of each text's hashes of ``GRAM`` bytes, those that are the smallest of
   some window of ``length`` bytes (all of them, if equal). Two equal strings of
   that length have the same anchors, so that all their places meet at a hash,
   whose owner task sees each place's context: the bytes that all strings with
   this anchor may cover. Places with the same context are one class, and all
   strings of all but its first place are repeats.
2. Where a hash has several classes, the first place of each goes to a suffix
   array. Strings are taken in four ranges of their start; those of one range
   share a core, and the contexts with one core are a block, in which the core is
   one symbol between what stands left and right of it. The linear grouping of
   :mod:`suffix_group` sorts all suffixes of many blocks at once; in this order,
   neighbours that agree on a whole string's symbols are its places, and all but
   the first are repeats.
3. Each text drops the bytes that its repeats cover.

Places carry their document and offset along; packed arrays travel, never a
row for each place. Tasks own ranges of hashes or documents whose number follows
the input, and copies are one class before anything is gathered for them.

Places are in order of id, then offset. Hashes of 64 bits stand for the anchor and
of 64 more for the context or the core. A null text is empty; an id that is null
is below all others. Rows that repeat an id are in order of their text's hash;
those that repeat the text too are one document, each with its result. An
empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .ngram_join import split_by
from .shared import PACKED_BYTES, kept, pieces, small_batches
from .suffix_group import _ranges, suffix_arrays

GRAM = 32
PARTS = 4
#: Text bytes of the documents that one task holds.
TASK_BYTES = 4 << 20
_NULL = -(1 << 63)
_PLACE = np.dtype([("d", "<i8"), ("t", "<u4"), ("p", "<i4")])
_SPAN = np.dtype([("d", "<i8"), ("t", "<u4"), ("a", "<i4"), ("b", "<i4")])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)


def _text_hash(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (B.span_hash(sums, offsets[:-1], offsets[1:]) >> np.uint64(32)).astype(np.uint32)


def _owner(d: np.ndarray, n: int) -> np.ndarray:
    return ((B.mix(d.view(np.uint64)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position and row of the anchors of all texts."""
    wide = length - GRAM + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n - GRAM + 1)
    h = B.span_hash(sums, at, at + GRAM)
    h[at + GRAM > end[: len(at)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = B.slide(h, wide, np.minimum)
    low[np.arange(len(low)) + length > end[: len(low)]] = 0  # no string of the length starts here
    pad = np.zeros(wide - 1, np.uint64)
    best = B.slide(np.concatenate([pad, low, pad]), wide, np.maximum)
    pos = np.flatnonzero((h == best[: len(h)]) & (at + GRAM <= end[: len(at)]))
    return h[pos], pos, np.searchsorted(offsets, pos, side="right") - 1


def _pack(keys: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table | None:
    """Rows (r, one binary for each column): the columns' values of each key."""
    if not len(keys):
        return None
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    out = {"r": pa.array(keys[order][cut].astype(np.int64))}
    for name, x in columns.items():
        out[name] = pa.array([y.tobytes() for y in np.split(x[order], cut[1:])], pa.binary())
    return pa.table(out)


def _unpack(t: pa.Table, name: str, kind) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(b"".join(x for x in t.column(name).to_pylist() if x is not None), kind)


def scan(docs: DataFrame, length: int, ranges: int) -> DataFrame:
    """Packed anchors by range of their hash: h, c (context), d, t, p, n (bytes of the text); and packed spans.

    A place whose context stands earlier in the same slice of texts is a repeat: it
    goes on as a span, by its document. So a context with any number of places is
    one row of each slice where it meets others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["r", "h", "c", "d", "t", "p", "n", "spans"]
        for part in pieces(batches, 1, PACKED_BYTES):
            data, offsets = B.flat(part.column(1))
            sums = B.prefix_hash(data)
            h, pos, row = anchors(data, offsets, sums, length)
            start = np.maximum(pos - (length - GRAM), offsets[row])
            stop = np.minimum(pos + length, offsets[row + 1])
            c = B.span_hash(sums, start, stop) + (pos - start).astype(np.uint64)
            d, t = _ids(part.column(0))[row], _text_hash(sums, offsets)[row]
            o = np.lexsort((pos - offsets[row], t, d, c, h))
            new = np.ones(len(o), bool)
            new[1:] = (h[o][1:] != h[o][:-1]) | (c[o][1:] != c[o][:-1])
            lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else o
            at = pos - offsets[row]
            twin = (d[o] == d[lead]) & (t[o] == t[lead]) & (at[o] == at[lead])  # the same place, of a row that is there twice
            first, again = np.sort(o[new]), o[~new & ~twin]
            spans = np.zeros(len(again), _SPAN)
            spans["d"], spans["t"], spans["a"], spans["b"] = d[again], t[again], (start - offsets[row])[again], (stop - offsets[row])[again]
            packed = _pack((B.mix(h[first]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), {"h": h[first], "c": c[first], "d": d[first], "t": t[first], "p": at[first].astype(np.int32), "n": np.diff(offsets)[row][first].astype(np.int32)})
            if packed:
                yield from packed.append_column("spans", pa.nulls(packed.num_rows, pa.binary())).to_batches()
            own = list(split_by(_owner(spans["d"].copy(), ranges), spans))
            if own:
                none = pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), *[none] * 6, pa.array([x for _, x in own], pa.binary())], names)

    return small_batches(docs).mapInArrow(run, "r bigint, h binary, c binary, d binary, t binary, p binary, n binary, spans binary")


def classes(packed: DataFrame, length: int, owners: int) -> DataFrame:
    """Of each document owner: spans (repeats known already) and asked (first places of the classes of hashes that have several)."""

    def run(t):  # noqa: ANN001, ANN202
        known = _unpack(t, "spans", _SPAN)
        h, c, d, th, p, n = (_unpack(t, x, k) for x, k in (("h", np.uint64), ("c", np.uint64), ("d", np.int64), ("t", np.uint32), ("p", np.int32), ("n", np.int32)))
        o = np.lexsort((p, th, d, c, h))
        h, c, d, th, p, n = h[o], c[o], d[o], th[o], p[o], n[o]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c = new_h.copy()
        new_c[1:] |= c[1:] != c[:-1]
        of = np.cumsum(new_h) - 1
        several = np.bincount(of, new_c)[of] > 1
        # Rows that are one document and one place aren't repeats of each other.
        twin = np.zeros(len(h), bool)
        twin[1:] = ~new_c[1:] & (d[1:] == d[:-1]) & (th[1:] == th[:-1]) & (p[1:] == p[:-1])
        lead = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        first = (d == d[lead]) & (th == th[lead]) & (p == p[lead])
        rep = ~first & ~twin
        spans = np.zeros(int(rep.sum()), _SPAN)
        spans["d"], spans["t"], spans["a"], spans["b"] = d[rep], th[rep], np.maximum(p[rep] - (length - GRAM), 0), np.minimum(p[rep] + length, n[rep])
        spans = np.concatenate([known, spans])
        ask = new_c & several
        asked = np.zeros(int(ask.sum()), _PLACE)
        asked["d"], asked["t"], asked["p"] = d[ask], th[ask], p[ask]
        rows = [("s", k, x) for k, x in split_by(_owner(spans["d"].copy(), owners), spans)] + [("q", k, x) for k, x in split_by(_owner(asked["d"].copy(), owners), asked)]
        return pa.table({"w": pa.array([k for _, k, _ in rows], pa.int64()), "spans": pa.array([x if s == "s" else None for s, _, x in rows], pa.binary()), "asked": pa.array([x if s == "q" else None for s, _, x in rows], pa.binary())})

    return packed.groupBy("r").applyInArrow(run, "w bigint, spans binary, asked binary")


def _match(d: np.ndarray, t: np.ndarray, docs_d: np.ndarray, docs_t: np.ndarray) -> np.ndarray:
    """For each (d, t), the place of the same in docs, or -1."""
    key = np.dtype([("d", "<i8"), ("t", "<u4")])
    a, b = np.zeros(len(d), key), np.zeros(len(docs_d), key)
    a["d"], a["t"], b["d"], b["t"] = d, t, docs_d, docs_t
    o = np.argsort(b, order=("d", "t"), kind="stable")
    at = np.minimum(np.searchsorted(b[o], a), max(len(b) - 1, 0))
    return np.where(b[o][at] == a, o[at], -1) if len(b) else np.full(len(a), -1)


def contexts(texts: DataFrame, found: DataFrame, length: int, ranges: int) -> DataFrame:
    """Packed contexts of the asked places by range of their anchor's hash: h, d, t, p, l and r (bytes left and right of the anchor's start), x (all their bytes)."""

    def run(t, q):  # noqa: ANN001, ANN202
        empty = pa.table({"r": pa.array([], pa.int64()), **{k: pa.array([], pa.binary()) for k in ("h", "d", "t", "p", "l", "e", "x")}})
        if not t.num_rows or not q.num_rows:
            return empty
        data, offsets = B.flat(t.column("text"))
        sums = B.prefix_hash(data)
        want = _unpack(q, "asked", _PLACE)
        row = _match(want["d"], want["t"], _ids(t.column("id").combine_chunks()), _text_hash(sums, offsets))
        want, row = want[row >= 0], row[row >= 0]
        pos = offsets[row] + want["p"]
        left, right = np.minimum(want["p"], length - GRAM).astype(np.uint8), np.minimum(offsets[row + 1] - pos, length).astype(np.uint8)
        h = B.span_hash(sums, pos, pos + GRAM)
        key = ((B.mix(h) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        o = np.argsort(key, kind="stable")
        key, h, want, left, right, pos = key[o], h[o], want[o], left[o], right[o], pos[o]
        out = _pack(key, {"h": h, "d": want["d"].copy(), "t": want["t"].copy(), "p": want["p"].copy(), "l": left, "e": right})
        if out is None:
            return empty
        size = left.astype(np.int64) + right
        flat = data[_ranges(pos - left, size)]
        cut = np.cumsum(size)[np.flatnonzero(key[1:] != key[:-1])]
        return out.append_column("x", pa.array([y.tobytes() for y in np.split(flat, cut)], pa.binary()))

    asked = found.where("asked is not null").select("w", "asked")
    return texts.groupBy("w").cogroup(asked.groupBy("w")).applyInArrow(run, "r bigint, h binary, d binary, t binary, p binary, l binary, e binary, x binary")


def repeats(h: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, flat: np.ndarray, length: int) -> np.ndarray:
    """Spans of the strings of the given contexts that have an earlier place."""
    starts = np.cumsum(left.astype(np.int64) + right) - (left.astype(np.int64) + right)
    pos = starts + left  # of the anchors, in flat
    sums = B.prefix_hash(flat)
    found = []
    reach = length - GRAM
    edges = np.linspace(0, reach + 1, PARTS + 1).astype(int)
    order = np.lexsort((places["p"], places["t"], places["d"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for a0, a1 in zip(edges[:-1], edges[1:] - 1, strict=True):
        # Strings that start a0 to a1 bytes before the anchor share [-a0, length - a1).
        ok = np.flatnonzero((left >= a0) & (right >= length - a1))
        if len(ok) < 2:
            continue
        more_l, more_r = np.minimum(left[ok].astype(np.int64) - a0, a1 - a0), np.minimum(right[ok].astype(np.int64) - (length - a1), a1 - a0)
        core = B.span_hash(sums, pos[ok] - a0, pos[ok] + length - a1)
        whole = B.span_hash(sums, pos[ok] - a0 - more_l, pos[ok] + length - a1 + more_r) + more_l.astype(np.uint64)
        o = np.lexsort((rank[ok], whole, core, h[ok]))
        ok, more_l, more_r, core, whole = ok[o], more_l[o], more_r[o], core[o], whole[o]
        new_b = np.ones(len(ok), bool)
        new_b[1:] = (core[1:] != core[:-1]) | (h[ok][1:] != h[ok][:-1])
        new_w = new_b.copy()
        new_w[1:] |= whole[1:] != whole[:-1]
        # The same bytes around the core: all strings of all but the first are repeats.
        again = ~new_w & (more_l + more_r >= a1 - a0)
        s = np.zeros(int(again.sum()), _SPAN)
        s["d"], s["t"] = places["d"][ok[again]], places["t"][ok[again]]
        s["a"] = places["p"][ok[again]] - a0 - more_l[again]
        s["b"] = places["p"][ok[again]] + length - a1 + more_r[again]
        found.append(s)
        block = np.cumsum(new_b) - 1
        keep = new_w & (np.bincount(block, new_w)[block] > 1) & (more_l + more_r >= a1 - a0)
        keep &= np.bincount(block[keep], minlength=block[-1] + 1)[block] > 1
        ok, more_l, more_r, block = ok[keep], more_l[keep], more_r[keep], block[keep]
        if not len(ok):
            continue
        found.append(_sorted_repeats(flat, pos, places, rank, ok, more_l, more_r, block, a0, a1, length))
    return np.concatenate(found) if found else np.zeros(0, _SPAN)


def _sorted_repeats(flat, pos, places, rank, ok, more_l, more_r, block, a0, a1, length) -> np.ndarray:  # noqa: ANN001
    """The repeats that the suffix arrays of the blocks show."""
    size = more_l + more_r + 2  # left bytes, the core, right bytes, and an end
    base = np.cumsum(size) - size
    symbols = np.zeros(int(size.sum()), np.int64)
    symbols[_ranges(base, more_l)] = flat[_ranges(pos[ok] - a0 - more_l, more_l)].astype(np.int64) + 3
    symbols[base + more_l] = 2
    symbols[_ranges(base + more_l + 1, more_r)] = flat[_ranges(pos[ok] + length - a1, more_r)].astype(np.int64) + 3
    symbols[base + size - 1] = 1
    of = np.repeat(np.arange(len(ok)), size)
    first_of = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    bounds = np.append(base[first_of], len(symbols))
    out = []
    # Strings of like size go side by side.
    by_size = np.argsort(np.diff(bounds), kind="stable")
    width = np.diff(bounds)[by_size]
    at = 0
    while at < len(by_size):
        to = at + 1
        total = width[at]
        while to < len(by_size) and total + width[to] < 400_000 and width[to] <= 2 * width[at]:
            total += width[to]
            to += 1
        group = np.sort(by_size[at:to])
        at = to
        places_in = _ranges(bounds[group], np.diff(bounds)[group])
        offsets = np.concatenate([[0], np.cumsum(np.diff(bounds)[group])])
        sa = places_in[suffix_arrays(symbols[places_in], offsets)]
        blk = np.repeat(np.arange(len(group)), np.diff(offsets))
        # A string: what is left of the core from here on, the core, and the rest of a1 - a0 bytes to its right.
        before = base[of[sa]] + more_l[of[sa]] - sa
        rest = (a1 - a0) - before
        whole = (before >= 0) & (before <= a1 - a0) & (more_r[of[sa]] >= rest)
        sa, blk, before = sa[whole], blk[whole], before[whole]
        if len(sa) < 2:
            continue
        need = a1 - a0 + 1
        same = blk[1:] == blk[:-1]
        pair = np.flatnonzero(same)
        equal = np.zeros(len(sa) - 1, bool)
        equal[pair] = (symbols[sa[pair][:, None] + np.arange(need)] == symbols[sa[pair + 1][:, None] + np.arange(need)]).all(1)
        run = np.concatenate([[0], np.cumsum(~equal)])
        place = of[sa]
        o = np.lexsort((rank[ok[place]], run))
        later = np.zeros(len(sa), bool)
        later[o[1:]] = run[o][1:] == run[o][:-1]
        x = ok[place[later]]
        s = np.zeros(len(x), _SPAN)
        s["d"], s["t"] = places["d"][x], places["t"][x]
        s["a"] = places["p"][x] - a0 - before[later]
        s["b"] = s["a"] + length
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, _SPAN)


def arrays(packed: DataFrame, length: int, owners: int) -> DataFrame:
    """Spans by document owner, of the contexts of each range of hashes."""

    def run(t):  # noqa: ANN001, ANN202
        places = np.zeros(sum(len(x) for x in t.column("h").to_pylist()) // 8, _PLACE)
        places["d"], places["t"], places["p"] = _unpack(t, "d", np.int64), _unpack(t, "t", np.uint32), _unpack(t, "p", np.int32)
        spans = repeats(_unpack(t, "h", np.uint64), places, _unpack(t, "l", np.uint8), _unpack(t, "e", np.uint8), _unpack(t, "x", np.uint8), length)
        rows = list(split_by(_owner(spans["d"].copy(), owners), spans))
        return pa.table({"w": pa.array([k for k, _ in rows], pa.int64()), "spans": pa.array([x for _, x in rows], pa.binary())})

    return packed.groupBy("r").applyInArrow(run, "w bigint, spans binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept (the remaining bytes). length: 64 to 255."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    found = kept(classes(scan(texts, length, owners), length, owners), "suffix-classes")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_owner(_ids(part.column(0)), owners))], ["id", "text", "w"])

    owned = texts.mapInArrow(own, "id bigint, text string, w bigint")
    more = arrays(contexts(owned, found, length, owners), length, owners)
    spans = found.where("spans is not null").select("w", "spans").unionByName(more)

    def cut(t, s):  # noqa: ANN001, ANN202
        data, offsets = B.flat(t.column("text"))
        ids = _ids(t.column("id").combine_chunks()) if t.num_rows else np.zeros(0, np.int64)
        th = _text_hash(B.prefix_hash(data), offsets) if t.num_rows else np.zeros(0, np.uint32)
        x = _unpack(s, "spans", _SPAN) if s.num_rows else np.zeros(0, _SPAN)
        key = np.zeros(len(ids), np.dtype([("d", "<i8"), ("t", "<u4")]))
        key["d"], key["t"] = ids, th
        first = _match(ids, th, ids, th)  # rows that are one document share its spans
        row = _match(x["d"], x["t"], ids, th)
        x, row = x[row >= 0], row[row >= 0]
        mark = np.zeros(len(data) + 1, np.int64)
        np.add.at(mark, offsets[row] + x["a"], 1)
        np.add.at(mark, offsets[row] + x["b"], -1)
        gone = np.cumsum(mark)[:-1] > 0
        out = []
        for i in range(len(ids)):
            a, b = offsets[first[i]], offsets[first[i] + 1]
            g = gone[a:b]
            rest = data[a:b][~g].tobytes()
            n_spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((None if ids[i] == _NULL else int(ids[i]), int(b - a), int(g.sum()), n_spans, hashlib.sha256(rest).hexdigest(), rest))
        names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({n: pa.array([r[j] for r in out], kinds[j]) for j, n in enumerate(names)})

    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return owned.groupBy("w").cogroup(spans.groupBy("w")).applyInArrow(cut, schema)
