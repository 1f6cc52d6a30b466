"""Toxicity by a counterfactually regularised linear classifier over words and word beginnings, trained in numpy.

Features of a text: which words (letters and digits, A-Z lowered) and which first
three, four and five bytes of longer words it has. The features that tell the labels
apart best on the sample (largest z of the two rates; a documented number of
them) are weighed by logistic regression.

Counterfactuals: each identity term in a sample text is swapped for other terms of
its language, and for a neutral word, and the squared change of the text's logit
is part of the loss. A sample text that names no group is made to name one, each
term in turn, and its twin has the neutral word there. Naming a group moves a
score little therefore, whatever the labels say, and although its name may begin
like a word that they mark.

Bounds, the same at every size: ``sample_rows`` labelled rows (those with the
smallest hash of their id), ``n_features`` features, ``swaps`` per text. Scoring
reads every whole text; nothing is shuffled.

Nulls: a null text is empty; its score is that of no feature. Rows with a null
label aren't learnt from; labelled rows that are repeated count again. With
nothing to learn from, or one class only, every score is that class's rate (0.0
if there is none), kept under 0.5 unless every label is 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .shared import bounded_sample, kept, pieces, small_batches

#: Terms that name groups of people in English, German, French and Spanish, and the words that stand for none.
IDENTITY_TERMS = {
    "en": (
        "african", "american", "arab", "asian", "atheist", "black", "blind", "buddhist", "catholic", "chinese",
        "christian", "deaf", "disabled", "elderly", "european", "female", "gay", "hindu", "hispanic", "homosexual",
        "immigrant", "immigrants", "indian", "japanese", "jew", "jewish", "jews", "latino", "lesbian", "male",
        "men", "mexican", "mormon", "muslim", "muslims", "old", "protestant", "queer", "refugees", "straight",
        "trans", "transgender", "white", "women", "young", "black people", "deaf people", "old people",
    ),
    "de": (
        "afrikaner", "alte menschen", "araber", "asiate", "atheist", "ausländer", "behinderte", "blinde", "buddhist", "chinese",
        "christ", "einwanderer", "flüchtlinge", "frauen", "gehörlose", "hindu", "inder", "japaner", "jude", "juden",
        "jüdisch", "katholik", "lesbe", "mexikaner", "mormone", "muslim", "muslime", "männer", "protestant", "schwarze",
        "schwul", "transsexuell", "weiße", "ältere",
    ),
    "fr": (
        "africain", "arabe", "asiatique", "athée", "aveugle", "bouddhiste", "catholique", "chinois", "chrétien", "femmes",
        "handicapé", "hindou", "hommes", "immigré", "indien", "japonais", "juif", "juive", "lesbienne", "mexicain",
        "mormon", "musulman", "musulmane", "noir", "personnes âgées", "protestant", "réfugiés", "sourd", "transgenre", "vieux",
    ),
    "es": (
        "africano", "anciano", "asiático", "ateo", "budista", "católico", "chino", "ciego", "cristiano", "discapacitado",
        "gitano", "hindú", "hombres", "indio", "inmigrante", "japonés", "judía", "judío", "lesbiana", "mexicano",
        "mormón", "mujeres", "musulmana", "musulmán", "negro", "personas mayores", "protestante", "refugiados", "sordo", "transgénero",
    ),
}
NEUTRAL = {"en": "person", "de": "mensch", "fr": "personne", "es": "persona"}
#: Each term with the languages that have it; a text's terms are swapped for those of the first.
_LANGUAGE = {t: lang for lang in reversed(IDENTITY_TERMS) for t in IDENTITY_TERMS[lang]}
ALL_TERMS = tuple(dict.fromkeys(t for terms in IDENTITY_TERMS.values() for t in terms))
_TERM = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(ALL_TERMS, key=len, reverse=True)) + r")(?![^\W_])", re.I)
_KIND = [np.uint64(0), np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321), np.uint64(0x0F1E2D3C4B5A6978)]


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, at = hits(data, offsets, self.features)
        z = np.full(len(offsets) - 1, self.bias)
        np.add.at(z, row, self.weights[at])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features with their rows, repeats included."""
    data = B.lower(data)
    start, end, row = B.alnum_spans(data, offsets)
    sums = B.prefix_hash(data)
    out = [(B.span_hash(sums, start, end), row)]
    for kind, n in ((1, 3), (2, 4), (3, 5)):
        long = np.flatnonzero(end - start > n)
        out.append((B.span_hash(sums, start[long], start[long] + n) ^ _KIND[kind], row[long]))
    return np.concatenate([h for h, _ in out]), np.concatenate([r for _, r in out])


def hits(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in `known` (sorted) of each distinct known feature of each row."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, row = features(data, offsets)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    ok = known[at] == h
    pair = np.unique(row[ok] * len(known) + at[ok])
    return pair // len(known), pair % len(known)


def _way(k: int | None) -> Callable[[re.Match], str]:
    """The swap of a term for another one of its language, or for the neutral word (None)."""

    def swap(m: re.Match) -> str:
        lang = _LANGUAGE[m[0].lower()]
        terms = IDENTITY_TERMS[lang]
        return NEUTRAL[lang] if k is None else terms[(terms.index(m[0].lower()) + 1 + k * 7) % len(terms)]

    return swap


def swapped(text: str, swaps: int) -> list[str]:
    """The text with its identity terms swapped, in `swaps` fixed ways, and for the neutral word; none if it has no term."""
    return [_TERM.sub(_way(k), text) for k in [*range(swaps), None]] if _TERM.search(text) else []


def named(known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each identity term, the places in `known` of its features and of its neutral word's."""
    def own(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return hits(raw, np.array([0, len(raw)]), known)[1]

    return [(own(t), own(NEUTRAL[_LANGUAGE[t]])) for t in ALL_TERMS]


def logistic(rows: list[np.ndarray], y: np.ndarray, twins: list[tuple[np.ndarray, np.ndarray]], n: int, l2: float = 3e-5, fair: float = 1.0, toxic_weight: float = 2.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise logistic loss (toxic rows count toxic_weight times) + l2 * |w|^2 + fair * the twins' mean squared difference of logits; Adam on all rows."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    tr = np.repeat(np.arange(len(twins)), [len(a) + len(b) for a, b in twins]) if twins else np.zeros(0, np.int64)
    tc = np.concatenate([x for pair in twins for x in pair]).astype(np.int64) if twins else np.zeros(0, np.int64)
    ts = np.concatenate([s for a, b in twins for s in (np.ones(len(a)), -np.ones(len(b)))]) if twins else np.zeros(0)
    w, rate = np.zeros(n + 1), y.mean()
    w[n] = np.log(rate / (1 - rate))
    m, s = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(rows)) + w[n], -500, 500)))
        d = (p - y) * np.where(y > 0, toxic_weight, 1.0) / len(rows)
        g = np.append(np.bincount(c, d[r], n)[:n], d.sum())
        g[:n] += 2 * l2 * w[:n]
        if twins:
            gap = np.bincount(tr, ts * w[tc], len(twins))
            g[:n] += 2 * fair / len(twins) * np.bincount(tc, ts * gap[tr], n)[:n]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = 20_000, n_features: int = 2_000, swaps: int = 3, seed: int = 17, fair: float = 1.0) -> Model:
    """docs: texts; labels: the labels to learn from, by id. The sample is taken of the labels, so that it alone is broadcast and no text is shuffled."""
    chosen = bounded_sample(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")), "id", sample_rows, seed)
    sample = kept(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(kept(chosen, "toxicity-labels", one_file=True)), "id"), "toxicity-sample")
    tally = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = tally.get(1, 0), tally.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 30.0 if pos else -30.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            h, row = B.distinct(*features(*B.flat(part.column(0))))
            y = part.column(1).to_numpy(zero_copy_only=False)
            u, back = np.unique(h, return_inverse=True)
            up = np.bincount(back, y[row], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(up), pa.array(np.bincount(back, minlength=len(u)) - up)], ["f", "p", "n"])

    rates = small_batches(sample.select("text", "y")).mapInArrow(counted, "f bigint, p bigint, n bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p + n >= 3")
    both = (F.col("p") + F.col("n")) / float(pos + neg)
    z = F.abs(F.col("p") / float(pos) - F.col("n") / float(neg)) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / pos + 1 / neg))
    best = [r["f"] for r in rates.withColumn("z", z).where("z >= 4").orderBy(F.desc("z"), "f").limit(n_features).collect()]
    terms = "\n".join((*ALL_TERMS, *NEUTRAL.values())).encode()
    own, _ = features(np.frombuffer(terms, np.uint8), np.array([0, len(terms)]))
    known = np.unique(np.concatenate([np.array(best, np.int64).view(np.uint64), own]))
    shared = sample.sparkSession.sparkContext.broadcast(known)  # n_features and the terms' own at most

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            for k, text in enumerate(part.column(1).to_pylist()):
                texts = [text or "", *swapped(text or "", swaps)]
                raw = [t.encode() for t in texts]
                row, at = hits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), shared.value)
                lists = [at[row == i].tolist() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(k, 1), part.column(2).slice(k, 1), pa.array([lists], pa.list_(pa.list_(pa.int32())))], ["id", "y", "x"])

    id_type = dict(sample.dtypes)["id"]
    got = sample.mapInArrow(design, f"id {id_type}, y int, x array<array<int>>").collect()
    got.sort(key=lambda r: (r["id"] is None, str(r["id"]), r["y"], r["x"]))  # sums in one order: reruns agree
    x = [np.array(r["x"][0], np.int64) for r in got]
    twins = [(x[i], np.array(v, np.int64)) for i, r in enumerate(got) for v in r["x"][1:]]
    terms = named(known)
    plain = [i for i, r in enumerate(got) if len(r["x"]) == 1]
    for k, i in enumerate(plain):
        a, b = terms[k % len(terms)]
        has = set(x[i].tolist())  # only what one twin has and the other hasn't counts
        twins.append(tuple(np.array([f for f in u.tolist() if f not in has and f not in v], np.int64) for u, v in ((a, set(b.tolist())), (b, set(a.tolist())))))
    w, bias = logistic(x, np.array([r["y"] for r in got], float), twins if fair else [], len(known), fair=fair)
    return Model(known, w, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score, predicted (1 if the score is 0.5 or more)."""
    id_type = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            s = shared.value.scores(*B.flat(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def not_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns. Nothing is shuffled or joined: rows carry their decision along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            keep = shared.value.scores(*B.flat(part.column(at))) < 0.5
            yield part.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)
