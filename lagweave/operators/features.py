"""Feature models of words and tokens: look-ups, token scores, truncated SVD."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import word_candidates


def lookup(words: DataFrame, vectors: DataFrame, pool_size: int, seed: int) -> DataFrame:
    """word, token, place: the first candidate spelling that vectors (token, place) has; else a place of the pool by a hash."""
    rows = words.select("word", F.posexplode(word_candidates(F.col("word"))).alias("pos", "token"))
    hit = rows.join(vectors, "token").groupBy("word").agg(F.min_by(F.struct("token", "place"), "pos").alias("hit"))
    pool = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "word")), 1, 8), 16, 10).cast("long"), F.lit(pool_size))
    return words.join(hit, "word", "left").select("word", F.col("hit.token").alias("token"), F.coalesce(F.col("hit.place"), pool).alias("place"))


def log_softmax(rows: DataFrame, by: str, logit: str, temperature: float = 1.0) -> DataFrame:
    """logp of each row in its group; a temperature of 0 or less counts as 1."""
    return _log_softmax(rows.withColumn("x", F.col(logit) / (temperature if temperature > 0 else 1.0)), Window.partitionBy(by))


def _log_softmax(rows: DataFrame, w) -> DataFrame:  # noqa: ANN001
    rows = rows.withColumn("shift", F.col("x") - F.max("x").over(w))
    return rows.withColumn("logp", F.col("shift") - F.log(F.sum(F.exp("shift")).over(w))).drop("x", "shift")


def top_mass(rows: DataFrame, by: str, symbol: str, p: str, mass: float, cap: int) -> DataFrame:
    """The likeliest symbols that hold the mass, cap at most; ties to the smaller symbol."""
    w = Window.partitionBy(by).orderBy(F.desc(p), symbol)
    before = F.coalesce(F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("k", F.row_number().over(w)).withColumn("before", before).where((F.col("before") < mass) & (F.col("k") <= cap)).drop("before")


def bigram_model(tokens: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(prev, token, n) and (prev, total) of tokens (doc, pos, token), for add-alpha estimates."""
    w = Window.partitionBy("doc").orderBy("pos")
    pairs = tokens.withColumn("prev", F.lag("token").over(w)).where(F.col("prev").isNotNull()).groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n"))
    return pairs, pairs.groupBy("prev").agg(F.sum("n").alias("total"))


def token_probability(tokens: DataFrame, vocabulary: int, alpha: float = 1.0) -> DataFrame:
    """doc, pos, token, p: of each token after the one before it; null for the first."""
    pairs, totals = bigram_model(tokens)
    w = Window.partitionBy("doc").orderBy("pos")
    rows = tokens.withColumn("prev", F.lag("token").over(w)).join(pairs, ["prev", "token"], "left").join(totals, "prev", "left")
    return rows.select("doc", "pos", "token", F.when(F.col("prev").isNotNull(), (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("total", F.lit(0)) + alpha * vocabulary)).alias("p"))


def split_interval(words: DataFrame, k: Column) -> DataFrame:
    """Each word's interval cut into k parts: floor of equal shares, each a point at least."""
    d = F.col("stop") - F.col("start")
    rows = words.withColumn("parts", k).withColumn("d", d).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = F.col("start") + F.floor(F.col("j") * F.col("d") / F.col("parts"))
    b = F.col("start") + F.floor((F.col("j") + 1) * F.col("d") / F.col("parts"))
    return rows.withColumn("a", a.cast("int")).withColumn("b", F.greatest(b, a + 1).cast("int")).drop("d", "parts")


def map_words(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], word: str = "word") -> DataFrame:
    """word, vector by any encoder of lists of words, in Arrow batches; the encoder is loaded where it runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(encode(b.column(0).to_pylist()), float).tolist(), pa.list_(pa.float64()))], ["word", "vector"])

    return rows.select(F.col(word).alias("word")).mapInArrow(run, "word string, vector array<double>")


def hashed_encoder(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """An encoder without weights: signed counts of character trigrams."""

    def encode(words: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(words), dim))
        for i, w in enumerate(words):
            t = f"^{w}$"
            for j in range(len(t) - 2):
                h = zlib.crc32(t[j : j + 3].encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return encode


def gram(rows: DataFrame, features: str, dim: int) -> np.ndarray:
    """Sum of outer products, dim x dim: partial sums of each batch meet on the driver; as large as the feature axis, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            g += x.T @ x if len(x) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select(F.col(features).cast("array<double>")).mapInArrow(run, "i int, row array<double>")
    total = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g = np.zeros((dim, dim))
    for r in total:
        g[r["i"], r["j"]] = r["v"]
    return g


def svd_basis(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (rows) of the data behind a Gram matrix; the largest loading of each is positive."""
    value, vector = np.linalg.eigh(g)
    v = vector[:, ::-1][:, :k].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return np.sqrt(np.maximum(value[::-1][:k], 0)), v


def project(rows: DataFrame, features: str, basis: np.ndarray) -> DataFrame:
    """scores: features times the basis, a constant of the plan."""
    cols = [F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.array(*[F.lit(float(x)) for x in b]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for b in basis]
    return rows.withColumn("scores", F.array(*cols))


def score_story(tokens: DataFrame, score: Callable[[list[str], int], list[float]], context: int, block: int) -> DataFrame:
    """doc, pos, score: positions in blocks, each with up to context tokens before its own end; one story a task, any scorer of (tokens, how many to score)."""
    packed = tokens.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # Python objects are made of one story at a time
                story = b.column("s")[i].values
                words = story.field("token").to_pylist()
                out: list[float] = []
                for p in range(0, len(words), block):
                    end = min(p + block, len(words))
                    out += score(words[max(0, p - context + 1) : end], end - p)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("doc")[i], len(words)).cast(pa.int64()), story.field("pos").cast(pa.int32()), pa.array(out, pa.float64())], ["doc", "pos", "score"])

    return packed.mapInArrow(run, "doc bigint, pos int, score double")


def fixed_pieces(n: int) -> Callable[[Column], Column]:
    """A tokenizer without a vocabulary: pieces of n characters."""
    return lambda text: F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))


def tokenise_run(words: DataFrame, tokenize: Callable[[Column], Column]) -> DataFrame:
    """words (doc, pos, token) with their pieces and the number of pieces before them in the story; every word but the first has a space before it. tokenize: a column function, a UDF of any tokenizer among them."""
    w = Window.partitionBy("doc").orderBy("pos")
    rows = words.withColumn("pieces", tokenize(F.when(F.row_number().over(w) > 1, F.concat(F.lit(" "), "token")).otherwise(F.col("token"))))
    before = F.sum(F.size("pieces")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def pca_basis(rows: DataFrame, features: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, components (rows, the largest loading positive) and mean of the features: of one pass of partial sums, whatever the rows."""
    one = rows.select(F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>")).alias("f"))
    g = gram(one, "f", dim + 1)
    n, mean = g[0, 0], g[0, 1:] / max(g[0, 0], 1)
    s, v = svd_basis(g[1:, 1:] - n * np.outer(mean, mean), dim)
    return s**2 / max(n - 1, 1), v, mean


def story_hashes(words: DataFrame, settings: str) -> DataFrame:
    """doc, story_hash, n of words (doc, pos, token): of the words in order, a line each, and of the settings (model, fingerprint, parameters) as text. A story is one row."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "\n")
    return words.groupBy("doc").agg(F.sha2(F.concat(text, F.lit(settings)), 256).alias("story_hash"), F.count(F.lit(1)).alias("n"))
