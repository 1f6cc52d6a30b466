"""Vectorised scans over the UTF-8 bytes of whole Arrow text columns.

Everything works on one flat ``uint8`` buffer with row offsets, so that a batch
of documents costs a fixed number of numpy passes whatever their number.
Hashes are polynomial over the ring of integers modulo 2**64, with a random
64-bit value per byte and a final mix; they are equal on every machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multiplier of the polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = _table(20240101)
_pow: dict[str, np.ndarray] = {}
#: Bytes from which a word's hash is a cryptographic one.
LONG = 256


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier ("up") or of its inverse ("down")."""
    have = _pow.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, _P if kind == "up" else _PINV, dtype=np.uint64)
        out[0] = 1
        have = _pow[kind] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 running sums, of which :func:`span_hash` makes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers("up", len(data)), out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end); equal bytes give equal hashes wherever they stand."""
    inv = powers("down", len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`span_hash` of words. Long ones get a cryptographic hash: of the polynomial's modulus, a power of two, strings from some thousand bytes on are known that collide."""
    h = span_hash(sums, start, end)
    long = np.flatnonzero(end - start > LONG)
    if len(long):
        h[long] = whole_hash([data[a:b].tobytes() for a, b in zip(start[long], end[long], strict=True)]).view(np.uint64)
    return h


def whole_hash(texts: list[bytes]) -> np.ndarray:
    """64 bits of BLAKE2 of each text."""
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts), np.int64).copy()


#: The bytes that part words, space and 0x09 to 0x0D.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of letters and digits, and of every character outside ASCII.
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = True
_IS_ALNUM[128:] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_IS_SPACE[data] if inside is None else inside[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    cut = inner[word[inner] & word[inner - 1]]
    edge[0], edge[n] = word[0], word[-1]
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    start, end = at[0::2], at[1::2]
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def alnum_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`spans` of letters, digits and characters outside ASCII."""
    return spans(data, offsets, _IS_ALNUM)


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of each row's k-word shingles; a row of fewer words gives one shingle of them all."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    m = len(words)
    mult = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)]
    out_h, out_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m >= k:
        h = np.full(m - k + 1, k, np.uint64)
        for j in range(k):
            h = mix(h + words[j : m - k + 1 + j] * mult[j % 5])
        ok = row[k - 1 :] == row[: m - k + 1]
        out_h, out_r = h[ok], row[: m - k + 1][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = count[short].astype(np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            w = words[np.minimum(first[short] + j, m - 1)]
            h = np.where(has, mix(h + w * mult[j % 5]), h)
        out_h, out_r = np.concatenate([out_h, h]), np.concatenate([out_r, short])
    return out_h, out_r


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, in that order."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over x[i : i + width] for each i that has a whole window."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(x) - width + 1], out[rest : rest + len(x) - width + 1]) if rest else out[: len(x) - width + 1]
