"""What each operator gives for null ids, repeated rows, ties, nulls in any column, empty tables and columns with clashing names; the pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import impact_search, language_cnn, mixing, ngram_join, queries, sentencepiece_table, site_tree, suffix_dedup, toxicity
from lagweave.llm.chaining import passages

from .test_dedup import ngram_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars string, id string, n int, f int, h int, size int, key int, row int, kept boolean, score int, target int, component int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows that are there twice, one id with two texts, nulls in every column."""
    p, q = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows = [(None, p, "en", "a"), (None, p, "en", "a"), (1, p, "en", "a"), (1, p, "en", "a"), (1, q, "de", None), (2, q + " x", None, None), (3, None, None, None), (3, "", "en", "a"), (None, None, None, "b")]
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], SCHEMA)


def test_passages(odd):
    got = {(r["doc_id"], r["match_id"]) for r in passages(odd).collect()}
    assert got == {(1, None), (2, 1)}  # copies of p tie to the null id, which is the smallest; q and q x share a passage
    twice = passages(odd.unionByName(odd)).collect()
    assert Counter(map(str, twice)) == Counter(map(str, passages(odd).collect()))
    assert passages(odd.limit(0)).collect() == []


def test_near_copies(odd):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd).collect())
    # Id 1 bears both texts, so that it ties them: its rows and that of 2 are one component.
    assert got == Counter({(None, 56, None): 2, (1, 56, 1): 3, (2, 57, 1): 1, (3, 0, 3): 2, (None, 0, None): 1})
    assert ngram_join.jaccard_components(odd.limit(0)).collect() == []


def test_repeated_strings(odd):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(odd).collect()]
    assert len(got) == odd.count() and Counter(i for i, _, _ in got) == Counter({None: 3, 1: 3, 2: 1, 3: 2})
    # Copies of p after its first place go whole; the first place of q is in a row of id 1.
    assert {x for i, n, x in got if i is None} == {0} and Counter(x == n for i, n, x in got if i == 1) == Counter({True: 2, False: 1})
    assert [x for i, n, x in got if i == 2] == [len(" ".join(f"q{i}" for i in range(60)))]


def test_suffix_arrays_decide_over_short_repeats(spark, monkeypatch):
    """Regions of little more than a string that texts share: without the sorted suffixes, repeats are lost."""
    from .test_dedup import suffix_brute

    import random

    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for i in range(60):
        shared = own(rng.randint(100, 125))
        rows += [(3 * i + k, own(rng.randint(80, 160)) + shared + own(rng.randint(80, 160))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = suffix_brute(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(df).collect()} == want
    module = suffix_dedup
    monkeypatch.setattr(module, "_sorted_repeats", lambda *a: np.zeros(0, module._SPAN))
    spans = sum_removed = 0
    for r in _in_process(rows, module):
        spans += 1
        sum_removed += r
    assert sum_removed < sum(w[1] for w in want.values())


def _in_process(rows, module):  # noqa: ANN001, ANN202
    """Bytes removed by what the hash passes alone find, in this process (where the patch holds)."""
    import pyarrow as pa

    from lagweave.llm import bytescan as B

    rows = sorted(rows)
    data, offsets = B.flat(pa.array([t for _, t in rows]))
    sums = B.prefix_hash(data)
    h, pos, row = module.anchors(data, offsets, sums, 100)
    left, right = np.minimum(pos - offsets[row], 100 - module.GRAM), np.minimum(offsets[row + 1] - pos, 100)
    places = np.zeros(len(pos), module._PLACE)
    places["d"], places["p"] = row, pos - offsets[row]
    o = np.argsort(h, kind="stable")
    flat = np.concatenate([data[a - x : a + y] for a, x, y in zip(pos[o], left[o], right[o], strict=True)])
    spans = module.repeats(h[o], places[o], left[o].astype(np.uint8), right[o].astype(np.uint8), flat, 100)
    gone = np.zeros(len(data), bool)
    for s in spans:
        gone[offsets[s["d"]] + s["a"] : offsets[s["d"]] + s["b"]] = True
    return [int(gone[offsets[i] : offsets[i + 1]].sum()) for i in range(len(rows))]


def test_mixing(odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(odd.repartition(3)).collect())
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in rows.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_sources(odd.limit(0)).collect() == [] and mixing.mixed(odd.limit(0)).collect() == []


def test_mixing_comes_near_its_targets(spark):
    import random

    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.choice([1, 5, 20, 400, 3000])), f"s{min(i % 7, 3)}") for i in range(700)], "doc_id long, text string, source string")
    taken, target, large = defaultdict(int), {}, defaultdict(list)
    for r in mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        large[r["size"]].append(r["taken"] / r["size"])
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in target)
    # Inclusion is unequal: long documents are taken again more often than short ones.
    assert np.mean(large[3000]) > np.mean(large[5])


def test_scores(odd, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, "doc_id", "text", "toxic")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(odd.limit(0), model).collect() == [] and toxicity.not_rejected(odd, model).columns == odd.columns


def test_languages(odd):
    net = language_cnn.train(odd, "text", "lang", "doc_id")
    rows = language_cnn.identify(odd, net).collect()
    assert len(rows) == odd.count() and Counter(r["lang_pred"] == "und" for r in rows)[True] == 3
    assert language_cnn.identify(odd.limit(0), net).collect() == []


def test_tokens(odd):
    rows = sentencepiece_table.encode_decode(odd, queries.model_path()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd.count() and all((r["n_tokens"] == 0) == (r["decoded_sha256"] == empty) for r in rows)


def test_pages(spark):
    page = "<html><body><article><h1>Title</h1><p>Some words of prose in it &amp; more</p></article></body></html>"
    df = spark.createDataFrame([(None, None, page, 1), (1, None, None, None), (1, "http://a/x", page, 2), (1, "http://a/x", page, 2), (2, "not a url", "", 3)], "page_id long, url string, html string, host int")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in site_tree.extract(df).collect())
    text = "Title\n\nSome words of prose in it & more"
    assert got == Counter({(None, text, len(text)): 1, (1, "", 0): 1, (1, text, len(text)): 2, (2, "", 0): 1})
    assert site_tree.extract(df.limit(0)).collect() == []


def test_formulas_and_named_sections_are_text(spark):
    page = "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><section id='discussion'><p>" + "We see this in all the samples. " * 4 + "</p></section></article>"
    assert site_tree.main_text(page) == "Where x=2 holds\n\n" + ("We see this in all the samples. " * 4).strip()
    two = "<article><p>" + "First half of it. " * 6 + "</p></article><div><p>" + "Second half of it. " * 7 + "</p></div>"
    assert "Second half" in site_tree.main_text(two) and "First half" in site_tree.main_text(two)


def test_importance_of_nodes_against_their_formula(spark):
    """What each host's tree says of its nodes, against entropies counted page by page."""
    import math

    menu = "<ul class=list><li>Home</li><li>News</li></ul>"
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<html><body><div class=top>{menu}</div><div class=story><p>Story {i} tells {i * 7}</p>{'<p>More</p>' if i % 3 == 0 else ''}</div></body></html>") for i in range(24)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = df.select(site_tree.host_of(F.col("url")).alias("host"), "html")
    found = {r["host"]: {x["path"]: (x["site"], x["name"]) for x in r["removed"]} for r in site_tree.removed_nodes(rows, 0.05, 10).collect()}
    for host in ("h0.org", "h1.org"):
        own = [site_tree.page_features(h)[0] for _, u, h in pages if host in u]
        styles, texts, ups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
        for feats in own:
            for path, kind, feature in set(feats):
                if kind == 0:
                    styles[path][feature] += 1
                elif kind == 1:
                    texts[path][feature] += 1
                elif kind == 2:
                    ups[path].add(feature)
        text_imp, node_imp, m_of = {}, {}, {}
        for path, seen in styles.items():
            m = m_of[path] = sum(seen.values())
            node_imp[path] = -sum(k / m * math.log(k / m) for k in seen.values()) / math.log(m) if m > 1 else 1.0
            if path in texts:
                text_imp[path] = float(np.mean([1 - math.log(min(k, m)) / math.log(m) if m > 1 else 1.0 for k in texts[path].values()]))
        low = set()
        for path, seen in styles.items():
            below = [text_imp[x] for x in text_imp if path in ups[x]]
            content = np.mean(below) if below else text_imp.get(path, 0.0)
            w = 0.9 ** len(seen)
            imp = max((1 - w) * node_imp[path] + w * content, max(below, default=0.0), text_imp.get(path, 0.0))
            if m_of[path] > 1 and imp < 0.05:
                low.add(path)
        got = {p & (2**64 - 1) for p, (site, _) in found[host].items() if site > 0}
        assert got == low and low
    out = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert all(t.startswith(f"Story {i} tells") and "Home" not in t for i, t in out.items())
    # Without the tree the menus would stay.
    assert all("Home" in site_tree.main_text(h) for _, _, h in pages)


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5]), (3, [1.0, 0.0, 4.0]), (None, [9.0, 9.0]), (4, None), (5, [None]), (6, []), (7, [float("nan")]), (8, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in impact_search.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    q = 256 * 256
    assert got == {(0, 1): (3, q), (0, 2): (8, q), (0, 3): (50, q // 2), (50, 1): (0, q // 2), (50, 2): (0, q // 2), (50, 3): (3, q // 2), (50, 4): (8, q // 2)}


def test_large_scores_are_whole_numbers(spark):
    big = [2.0**20, 1.0 / 256]
    df = spark.createDataFrame([(0, big), (1, big), (2, [2.0**20, 0.0]), (3, [2.0**20, 2.0 / 256])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in impact_search.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(3, 2**56 + 2), (1, 2**56 + 1), (2, 2**56)]


def test_searches_stop_before_the_end():
    rng = np.random.default_rng(0)
    x = np.floor(32 * (rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + 0.2 * rng.normal(size=(6000, 64))))
    block, early = impact_search.Block(x), 0
    for i in range(30):
        ok = np.arange(len(x)) != i
        at, s = block.possible(x[i], 5, ok)
        assert np.array_equal(np.sort(s)[-5:], np.sort((x @ x[i])[ok])[-5:]) and len(at) < len(x)
        early += block.done < block.segments
    assert early >= 25


@pytest.mark.parametrize("labelled", [False, True])
def test_pipeline_against_brute_force(spark, awkward, awkward_rows, tmp_path, labelled):
    import sentencepiece

    import corpus_pipeline

    extra = [(41, awkward_rows[41][1], "en", "s0"), (41, awkward_rows[41][1], "en", "s0"), (70, None, None, None), (70, None, None, None)]
    docs = awkward.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    toxic = [(i, int(i % 4 == 0)) for i in range(40)] if labelled else []
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    if labelled:
        model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")).where(~queries.held_out()), "doc_id", "text", "toxic")
        bad = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
        rows = [r for r in rows if r[0] not in bad]
    last = {}
    for i, t, s in rows:
        last[t or ""] = max(last.get(t or "", (i, t, s)), (i, t, s), key=lambda x: x[0])
    rows = list(last.values())
    comp = {i: c for i, (_, c) in ngram_brute(rows, 5, 8, 10).items()}
    rows = [r for r in rows if comp[r[0]] == r[0]]
    plan = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    text = {i: t or "" for i, t, _ in rows}
    want = Counter()
    for r in plan:
        if r["size"]:
            ids = sp.encode(text[r["doc_id"]])
            want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += r["taken"] // r["size"]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if text.get(r["doc_id"], "").split())
    assert got == +want and sum(got.values()) > 10


def test_pipeline_of_nothing(spark, awkward, tmp_path):
    import corpus_pipeline

    awkward.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_long_words_that_fool_polynomials():
    """Thue-Morse strings of two letters agree in every polynomial modulo a power of two."""
    from lagweave.llm import bytescan as B

    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + " " + two).encode(), np.uint8)
    sums, start, end = B.prefix_hash(data), np.array([0, 4097]), np.array([4096, 8193])
    assert len(set(B.span_hash(sums, start, end).tolist())) == 1 and len(set(B.word_hash(data, sums, start, end).tolist())) == 2
