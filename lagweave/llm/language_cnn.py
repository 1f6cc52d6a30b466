"""Language identification by a convolutional network over bytes, trained in numpy.

Each byte has a vector; filters of several widths slide over a window of fixed
length, the largest value of each filter in the window is kept, and a softmax
layer gives the language. Training: Adam on windows of a bounded sample of
labelled rows (``sample_rows`` rows, those with the smallest hash of their id; a
documented bound, the same at every size). Prediction: every byte of every whole
text lies in a window; a text's score is the softmax of its windows' mean logits,
weighted by their bytes.

Applying it: a filter over w bytes is a sum of w table rows, and tables over pairs
of bytes halve the look-ups.

Nulls: a null text is empty; empty texts and texts without a letter are `und`
with score 0. Rows with a null label or text aren't learnt from. With no row to
learn from, every text is `und`. Repeated rows are predicted alike. Ties go to
the label that is first in code-point order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .shared import bounded_sample, pieces, small_batches

WINDOW = 128
WIDTHS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")


class ByteNet:
    """Multi-width filters, max pooling and softmax; dim numbers a byte, filters of each width."""

    def __init__(self, labels: list[str], dim: int = 6, filters: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": rng.normal(0, 0.5, (257, dim))}
        self.p["E"][256] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p["V"] = rng.normal(0, 0.3, (len(WIDTHS) * filters, len(labels)))
        self.p["c"] = np.zeros(len(labels))

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e, pooled, kept = self.p["E"][x], [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols = np.concatenate([e[:, k : k + n] for k in range(w)], axis=2)
            out = cols @ self.p[f"W{w}"] + self.p[f"b{w}"]
            at = out.argmax(1)
            pooled.append(np.maximum(out.max(1), 0))
            kept.append((cols, at))
        return np.concatenate(pooled, axis=1), kept

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, steps: int = 1000, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> ByteNet:
        rng, step = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-steps * batch // max(len(x), 1)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        dim = self.p["E"].shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                xb, yb = x[at], y[at]
                h, kept = self._forward(xb)
                z = h @ self.p["V"] + self.p["c"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(at)), yb] -= 1
                z /= len(at)
                g = {"V": h.T @ z, "c": z.sum(0), "E": np.zeros_like(self.p["E"])}
                dh = (z @ self.p["V"].T) * (h > 0)
                f = dh.shape[1] // len(WIDTHS)
                for i, w in enumerate(WIDTHS):
                    cols, best = kept[i]
                    d = dh[:, i * f : (i + 1) * f]
                    rows = np.arange(len(at))[:, None]
                    seen = cols[rows, best]  # batch, filters, w * dim
                    g[f"W{w}"] = np.einsum("bfk,bf->kf", seen, d)
                    g[f"b{w}"] = d.sum(0)
                    back = d[:, :, None] * self.p[f"W{w}"].T[None]
                    for k in range(w):
                        np.add.at(g["E"], xb[rows, best + k], back[:, :, k * dim : (k + 1) * dim])
                g["E"][256] = 0
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> dict:
        """float32 tables of what each byte, or pair of bytes, adds to the filters of each width."""
        dim, out = self.p["E"].shape[1], {}
        for w in WIDTHS:
            one = [(self.p["E"][:256] @ self.p[f"W{w}"][k * dim : (k + 1) * dim]).astype(np.float32) for k in range(w)]
            parts = [(k, (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 1, one[w - 1]))
            out[w] = parts
        return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of the windows that hold every byte; a row's last window is moved back to be whole, if the row is long enough."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * WINDOW, np.maximum(size[row] - WINDOW, 0))
    return offsets[row] + start, np.minimum(WINDOW, size[row]), row


class Reader:
    """A trained network as a worker applies it."""

    def __init__(self, net: ByteNet):
        self.labels, self.parts = net.labels, net.tables()
        self.bias = {w: net.p[f"b{w}"].astype(np.float32) for w in WIDTHS}
        self.V, self.c = net.p["V"], net.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x: windows of bytes, all of one length of at least the widest filter."""
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n, total = x.shape[1] - w + 1, None
            for k, t in self.parts[w]:
                got = t[(pair if len(t) > 256 else x)[:, k : k + n]]
                total = got if total is None else total + got
            pooled.append(np.maximum(total.max(1) + self.bias[w], 0))
        return np.concatenate(pooled, axis=1) @ self.V + self.c

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Softmax of each row's mean logits; rows without bytes get equal shares."""
        start, size, row = windows(data, offsets)
        total, seen = np.zeros((len(offsets) - 1, len(self.labels))), np.zeros(len(offsets) - 1)
        whole = np.flatnonzero(size == WINDOW)
        for a in range(0, len(whole), 256):
            at = whole[a : a + 256]
            got = self.logits(data[start[at][:, None] + np.arange(WINDOW)])
            np.add.at(total, row[at], got * WINDOW)
            np.add.at(seen, row[at], WINDOW)
        for i in np.flatnonzero(size < WINDOW):  # rows shorter than a window: one each
            x = data[start[i] : start[i] + size[i]]
            x = np.concatenate([x, np.full(max(0, max(WIDTHS) - len(x)), 32, np.uint8)])
            total[row[i]] += self.logits(x[None])[0] * size[i]
            seen[row[i]] += size[i]
        z = total / np.maximum(seen, 1)[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(rows: DataFrame, text_col: str, label_col: str, id_col: str, sample_rows: int = 3000, windows_per_row: int = 2, seed: int = 11) -> ByteNet | None:
    """Learns from the sample_rows labelled rows with the smallest hash of their id; whole texts are never gathered, only their sampled windows."""
    ok = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("k"), F.col(label_col).alias("y"), F.encode(text_col, "UTF-8").alias("t"))
    ok = ok.where(F.length("t") > 0)
    cuts = [F.substring("t", (F.pmod(F.xxhash64(F.lit(seed + j), "k"), F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1) + 1).cast("int"), F.lit(WINDOW)).alias(f"w{j}") for j in range(windows_per_row)]
    got = sorted(bounded_sample(ok.select(F.coalesce("k", F.lit("")).alias("k"), "y", *cuts), "k", sample_rows, seed).collect())
    if not got:
        return None
    labels = sorted({r["y"] for r in got})
    x, y = np.full((len(got) * windows_per_row, WINDOW), 256, np.int64), np.zeros(len(got) * windows_per_row, np.int64)
    for i, r in enumerate(got):
        for j in range(windows_per_row):
            b = np.frombuffer(bytes(r[f"w{j}"]), np.uint8)
            x[i * windows_per_row + j, : len(b)] = b
            y[i * windows_per_row + j] = labels.index(r["y"])
    return ByteNet(labels).fit(x, y)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", pred_col: str = "lang_pred") -> DataFrame:
    """One row per row of docs: id, lang_pred, score. Nothing is shuffled."""
    id_type = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers, whatever the input
    held: list[Reader] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None and not held:
            held.append(Reader(shared.value))
        for part in pieces(batches, 1):
            lettered = np.array([bool(t and LETTER.search(t)) for t in part.column(1).to_pylist()])
            if held:
                got = held[0].scores(*B.flat(part.column(1)))
                best, top = got.argmax(1), got.max(1)
                name = [held[0].labels[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            else:
                name, top = ["und"] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(np.where([x != "und" for x in name], top, 0.0), pa.float64())], [id_col, pred_col, "score"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, `{pred_col}` string, score double")
