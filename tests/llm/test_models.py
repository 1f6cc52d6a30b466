"""Tokenizer, classifiers, search, mixing, extraction and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import impact_search, language_cnn, mixing, queries, site_tree, toxicity
from lagweave.llm.sentencepiece_table import PrefixTable, encode_decode


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_encoding_is_the_library_s(library):
    table = PrefixTable(queries.model_path())
    rng = random.Random(1)
    letters = list("abcdefghij ▁▁  \n\t0123456789éèß日本語\U0001f600\x00<s>/.,;!#%-'")
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = library.encode(t)
        assert table.encode(t) == ids and table.decode(ids) == library.decode(ids)
        joined, back = table.both(t)
        assert joined == ",".join(map(str, ids)) and back == library.decode(ids)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 270), 28705]) for _ in range(rng.randint(0, 12))]
        assert table.decode(ids) == library.decode(ids)


def test_encoding_of_tables(library, awkward, awkward_rows, no_rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in encode_decode(awkward, queries.model_path()).collect()}
    for r in awkward_rows:
        ids = library.encode(r[1] or "")
        assert got[r[0]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert encode_decode(no_rows, queries.model_path()).collect() == []


def test_language_network_learns():
    rng = np.random.default_rng(0)
    words = {"x": [b"the ", b"and ", b"of "], "y": [b"der ", b"und ", b"von "]}
    make = lambda k: np.frombuffer(b"".join(rng.choice(words[k], 60))[: language_cnn.WINDOW], np.uint8)
    x, y = np.stack([make("xy"[i % 2]) for i in range(200)]).astype(np.int64), np.arange(200) % 2
    net = language_cnn.ByteNet(["x", "y"]).fit(x, y)
    read = language_cnn.Reader(net)
    held = np.concatenate([make("x"), make("y")])
    assert read.scores(held, np.array([0, 128, 256])).argmax(1).tolist() == [0, 1]
    # Applying by tables is the network itself.
    h, _ = net._forward(x[:5])
    assert np.allclose(read.logits(x[:5].astype(np.uint8)), h @ net.p["V"] + net.p["c"], atol=1e-4)


def test_every_byte_is_in_a_window():
    size = [0, 1, 127, 128, 129, 256, 1000]
    at = np.concatenate([[0], np.cumsum(size)])
    start, n, row = language_cnn.windows(np.zeros(at[-1], np.uint8), at)
    seen = np.zeros(at[-1], bool)
    for s, k, r in zip(start, n, row, strict=True):
        assert at[r] <= s and s + k <= at[r + 1]
        seen[s : s + k] = True
    assert seen.all()


def test_languages_held_out(spark, sf_dir):
    rows = queries.op10_language_id(spark, sf_dir).join(queries.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.85
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_awkward_rows(awkward, awkward_rows, no_rows):
    net = language_cnn.train(awkward, "text", "lang", "doc_id", sample_rows=60)
    got = {r["doc_id"]: r for r in language_cnn.identify(awkward, net).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {r[0] for r in awkward_rows if not any(c.isalpha() for c in r[1] or "")}
    assert got[60]["score"] == 0 and {r["lang_pred"] for r in got.values()} <= {"en", "de", "und"}
    assert language_cnn.train(no_rows, "text", "lang", "doc_id") is None
    assert {r["lang_pred"] for r in language_cnn.identify(awkward, None).collect()} == {"und"}


LARGER = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark, sf_dir):
    labels = queries.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    by = {r["doc_id"]: r for r in rows}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r["held_out"] and (r["predicted"] == (r["score"] >= 0.5)) for i, r in by.items())
    clean = [by[r["doc_id"]]["predicted"] for r in labels.where("toxic = 0").collect()]
    assert np.mean(clean) < 0.1


def test_toxicity_held_out_rates(spark):
    """On the tables with 64 clean and 6 toxic rows that are held out: toxic rows are found, clean ones left alone."""
    rows = queries.op7_toxicity(spark, LARGER).join(queries.table(spark, LARGER, "labels").where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    rate = {(y, h): np.mean([r["predicted"] for r in rows if r["toxic"] == y and r["held_out"] == h]) for y in (0, 1) for h in (False, True)}
    assert rate[1, False] >= 0.8 and rate[1, True] >= 0.5 and rate[0, False] <= 0.01 and rate[0, True] <= 0.05


def test_counterfactuals_lower_what_naming_a_group_does(spark):
    """On the query's own tables: without them, a name that begins like a word of toxic texts raises scores."""
    docs, labels = queries.table(spark, LARGER, "documents"), queries.table(spark, LARGER, "labels").where(~queries.held_out())
    moved = {}
    for fair in (0.0, 1.0):
        m = toxicity.train(docs, labels, "doc_id", "text", "toxic", fair=fair)
        moved[fair] = [abs(m.weights[a].sum() - m.weights[b].sum()) for a, b in toxicity.named(m.features)]
    assert max(moved[0.0]) > 0.1 and max(moved[1.0]) < 0.5 * max(moved[0.0]) and np.mean(moved[1.0]) < np.mean(moved[0.0])


def test_terms_of_four_languages_are_swapped_in_their_own():
    for text in ("the black people here", "die Juden dort", "les femmes ici", "un gitano aquí"):
        ways = toxicity.swapped(text, 3)
        assert len(ways) == 4 and len(set(ways)) == 4 and text not in ways
    assert toxicity.swapped("die Juden dort", 3)[-1] == "die mensch dort" and toxicity.swapped("blackbird", 3) == []


def test_identity_terms_do_not_move_scores(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        words = [rng.choice(["good", "day", "house", "tree", "walks", "reads"]) for _ in range(12)]
        if toxic:
            words[3] = rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.8 if toxic else 0.1):  # the labels go along with the term
            words[5] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    tests = spark.createDataFrame([(1, "a good muslim reads"), (2, "a good person reads"), (3, "a jewish idiot"), (4, "an idiot"), (5, None), (6, "")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(tests, model).collect()}
    assert s[1] < 0.5 and abs(s[1] - s[2]) < 0.1 and s[3] > 0.5 and s[4] > 0.5 and s[5] == s[6] < 0.5
    kept = toxicity.not_rejected(tests, model)
    assert kept.columns == tests.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 6}


def test_toxicity_without_labels(awkward, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(awkward, none, "doc_id", "text", "toxic")
    assert {r["predicted"] for r in toxicity.score(awkward, model).collect()} == {0}
    assert toxicity.not_rejected(awkward, model).count() == awkward.count()


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (500, 16)).astype(np.float32)
    v[77] = v[78] = v[50]  # ties
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)]
    rows += [(1000, None, 0), (1050, [None] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [], 0), (1200, [float("inf")] + [0.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = impact_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    x = np.floor(256 * v.astype(float))
    want = set()
    for q in range(0, 500, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(500), -s)) if i != q][:5]
        want |= {(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)}
    assert {tuple(r) for r in got} == want
    assert impact_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = impact_search.top_k(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_mixing(awkward, awkward_rows, no_rows):
    got = {r["doc_id"]: r for r in mixing.mix_sources(awkward).collect()}
    size = {r[0]: len([w for w in (r[1] or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]) for r in awkward_rows}
    assert {i: r["size"] for i, r in got.items()} == size
    of = {r[0]: r[3] for r in awkward_rows}
    sources = sorted({s for s in of.values() if s is not None}) + [None]
    held = {s: sum(size[i] for i in of if of[i] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    # Fill up by weight, again and again, until no source is above its cap.
    target, open_, rest = {}, set(sources), float(sum(held.values()))
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * held[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * held[s]
            rest -= target[s]
        open_ -= over
    for i, r in got.items():
        assert r["source_size"] == held[of[i]] and abs(r["target"] - target[of[i]]) < 1e-6 * max(1, target[of[i]])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    for s in sources:
        taken = sum(got[i]["taken"] for i in of if of[i] == s)
        assert abs(taken - target[s]) <= max([size[i] for i in of if of[i] == s], default=0) / 2 + 1e-6
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix_sources(awkward.repartition(3)).collect()}
    assert mixing.mix_sources(no_rows).collect() == []


def test_mixed_rows(awkward):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(awkward).collect()}
    rows = mixing.mixed(awkward)
    assert rows.columns == awkward.columns
    words: dict[int, int] = {}
    for r in rows.select("doc_id", mixing.n_words(F.col("text")).alias("k")).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["k"]
    assert {i: w for i, w in words.items() if w} == {i: t for i, t in taken.items() if t}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a>Site</a></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>two</b>three<br>four&nbsp;five<p>Six <i>seven</i>
 eight<ul><li>a<li>b</ul><form><p>sub</p></form><div class="comments"><p>bad</p></div><!-- <p>no</p> --></article>
<aside>x</aside><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert site_tree.main_text(PAGE) == "Title & more\n\nOne twothree four five\n\nSix seven eight\n\na\n\nb"
    assert site_tree.main_text("") == "" and site_tree.main_text("a < b & c <p") == "a < b & c"
    assert site_tree.main_text("<p>" * 3000 + "deep") == "deep" and site_tree.main_text("<div>" * 3000 + "deep") == "deep"


def test_site_tree_removes_what_all_pages_have(spark, no_rows):
    rows = [(i, f"http://a.example/{i}", f'<body><div class="slogan">Always the same</div><div class="text"><p>Page {i} says {i * i} and {"x" * i}</p></div></body>') for i in range(20)]
    rows += [(100, "http://b.example/", "<body><div>Always the same</div></body>"), (101, None, None), (102, "x", ""), (103, "http://a.example/c", rows[3][2])]
    got = {r["page_id"]: r for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"Page {i} says {i * i} and {'x' * i}".strip() for i in range(20))
    assert got[100]["text"] == "Always the same" and got[101]["text"] == got[102]["text"] == "" and got[103]["text"] == got[3]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert site_tree.extract(empty).collect() == []


def test_names_are_a_prior_only(spark):
    prose = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    page = lambda k: f'<body><div class="content with-sidebar"><p>{prose(k, 40)}</p><section id="discussion"><p>{prose(-k, 15)}</p></section><div class="related-work"><p>{prose(k + 500, 12)}</p></div><div class="share">Share it</div></div></body>'
    want = lambda k: "\n\n".join([prose(k, 40), prose(-k, 15), prose(k + 500, 12)])
    assert site_tree.main_text(page(1)) == want(1)
    same = " ".join(f"c{i}" for i in range(15))
    few = lambda k: f'<body><div class="x">Home and news</div><div><p>{prose(k, 50)}</p><div class="notice"><p>{same}</p></div></div></body>'
    rows = [(k, "http://a.example/", page(k)) for k in range(1, 13)] + [(k, "http://b.example/", few(k)) for k in range(101, 110)] + [(200, "http://c.example/", few(200))]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == want(k) for k in range(1, 13))
    # What nine pages have in common goes, by name or not; of one page it isn't known.
    assert all(got[k] == prose(k, 50) for k in range(101, 110))
    assert got[200] == "\n\n".join(["Home and news", prose(200, 50), same])


def test_a_card_is_not_the_page():
    story = " ".join(f"s{i}" for i in range(60))
    card = "<article><h2>Another story</h2></article>"
    assert site_tree.main_text(f"<body><div><p>{story}</p></div>{card}</body>") == f"{story}\n\nAnother story"
    assert site_tree.main_text(f"<body><div>Short note</div><article><p>{story}</p></article></body>") == story
    assert site_tree.main_text(f'<body><div class="content with-sidebar"><p>{story}</p></div>{card}</body>') == f"{story}\n\nAnother story"
    links = '<ul>' + '<li><a href="/x">Some other page of this site</a>' * 40 + '</ul>'
    assert site_tree.main_text(f"<body>{links}<article><p>{story}</p></article></body>") == story


def test_pages_of_the_table(spark, sf_dir):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf_dir, "pages").collect()}
    for r in queries.op3_site_tree(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def stages():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, sf_dir, stages):
    docs = queries.table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    counts = []
    for _, stage in stages.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        counts.append(docs.count())
    assert before >= counts[0] >= counts[1] >= counts[2] > 0
    last = stages.STAGES[-1][1](spark, docs, sf_dir)
    whole = stages.run(spark, sf_dir)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    key = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[k] for k in sorted(r))) for r in rows)
    assert key([r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]) == key([dict(zip(names, r, strict=True)) for r in want.fetchall()])
