"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, exact_dedup, impact_search, language_cnn, mixing, ngram_join, sentencepiece_table, site_tree, suffix_dedup, toxicity
from .shared import table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth row by CRC-32 of the id's decimal text."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encode_decode(table(spark, sf_dir, "documents"), model_path())


def op3_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.train(docs, labels.where(~held_out()), "doc_id", "text", "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_cnn.train(docs.where(~held_out()), "text", "lang", "doc_id")
    said = language_cnn.identify(docs, net)
    return said.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collinear_chaining": op1_collinear_chaining,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_site_tree": op3_site_tree,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), '[^ ]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, sum(source_size::DOUBLE) OVER () AS total, sum(w) OVER () AS all_w,
              coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(w) OVER f, 0) AS w_before, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place
       FROM s1 WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - cap_before) / (all_w - w_before) AS level FROM s2),
flood AS (SELECT arg_min(level, place) AS flood FROM s3 WHERE cap > level * w),
s4 AS (SELECT source, source_size, coalesce(least(cap, flood * w), cap) AS target FROM s3 CROSS JOIN flood),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS lack FROM s5),
s7 AS (SELECT * REPLACE (CASE WHEN whole < 3 THEN greatest(lack, 0) ELSE 0 END AS lack) FROM s6),
t0 AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
t1 AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
              sum(size::DOUBLE * size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS squares FROM t0),
t2 AS (SELECT t1.*, s7.lack, (s7.lack - certain) / squares AS c FROM t1 JOIN s7 ON t1.source IS NOT DISTINCT FROM s7.source),
t3 AS (SELECT source, arg_max(c, size) AS c FROM t2 WHERE lack > 0 AND c * size <= 1 GROUP BY 1),
s8 AS (SELECT s7.*, CASE WHEN lack > 0 THEN coalesce(t3.c, 1) ELSE 0 END AS c FROM s7 LEFT JOIN t3 ON s7.source IS NOT DISTINCT FROM t3.source),
r0 AS (SELECT d.doc_id, d.size, s8.*, least(1, s8.c * d.size) AS p, (CAST('0x' || substr(md5('7|' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
       FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source),
r1 AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN u / (1 - u) * ((1 - p) / p) WHEN p > 0 THEN 0 END AS q FROM r0),
r2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r1 WHERE q IS NOT NULL),
r3 AS (SELECT *, upto <= lack AS inside, lack - coalesce(max(upto) FILTER (WHERE upto <= lack) OVER (PARTITION BY source), 0) AS gap FROM r2),
r4 AS (SELECT source, arg_min(doc_id, row(abs(size - gap), q, doc_id)) AS fill FROM r3 WHERE NOT inside AND abs(size - gap) < gap GROUP BY 1),
r5 AS (SELECT r3.doc_id, inside OR coalesce(r3.doc_id = fill, false) AS again FROM r3 LEFT JOIN r4 ON r3.source IS NOT DISTINCT FROM r4.source)
SELECT r1.doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN again THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r1 LEFT JOIN r5 USING (doc_id)
""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), '[^ ]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END) AS h
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(h) AS n FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN g USING (doc_id) GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * x >= 90 * (u.n + v.n - x)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT doc_id, n AS n_shingles, c AS component_id FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) JOIN n USING (doc_id)
""",
    "op9_suffix_dedup": r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
f AS MATERIALIZED (SELECT h, min((doc_id, p)) AS first FROM s GROUP BY 1 HAVING count(*) > 1),
q AS MATERIALIZED (SELECT doc_id, p FROM s JOIN f USING (h) WHERE (doc_id, p) <> first),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM q)),
c AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS "from", a AS "to" FROM c UNION ALL SELECT doc_id, max(b), NULL FROM c GROUP BY 1),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM c GROUP BY 1),
y AS (SELECT doc_id, string_agg(substr(x, CAST(2 * "from" + 1 AS BIGINT), CAST(2 * (coalesce("to", n) - "from") AS BIGINT)), '' ORDER BY "from") AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN y USING (doc_id)
""",
}
