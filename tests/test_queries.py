"""Every query against its SQL on the smallest tables, and those without SQL against what must hold."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave import catalog
from lagweave.functions import numerics as N

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows: list[dict]) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5g}"
        return str(v)

    return sorted(tuple(one(r[k]) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = plain([r.asDict() for r in catalog.QUERIES[name](spark, sf_dir).collect()])
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert got == plain([dict(zip(columns, r, strict=True)) for r in want.fetchall()])


def test_annotations_and_neighbours_of_every_event(spark, sf_dir):
    from lagweave.operators.timegrid import after

    events = sorted((r["event_id"], r["event_type"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect())
    assert sorted(r["event_id"] for r in catalog.QUERIES["annotation_frame"](spark, sf_dir).collect()) == [i for i, _ in events]
    want = [b for (_, kind), b in zip(events, events[1:], strict=False) if kind == "view"]
    assert sorted(tuple(r) for r in catalog.QUERIES["adjacency_shift"](spark, sf_dir).collect()) == want
    df = spark.createDataFrame(events, "event_id long, event_type string")
    assert sorted(tuple(r) for r in after(df, "event_id", "event_type", "view", span=7).collect()) == want


def test_greedy_windows_stay_apart(spark, sf_dir):
    rows = catalog.QUERIES["draw_windows_greedy"](spark, sf_dir).collect()
    for it in {r["iteration"] for r in rows}:
        starts = sorted(r["start"] for r in rows if r["iteration"] == it)
        assert len(starts) == 5 and min(np.diff(starts)) >= 12 and 0 <= starts[0] and starts[-1] <= 108


def test_greedy_windows_that_do_not_fit(spark):
    from lagweave.operators.windows import draw_apart

    with pytest.raises(Exception, match="without overlap"):
        draw_apart(spark.createDataFrame([(0,), (1,)], "start int"), 1, 2, 5, 1).collect()


def test_svd_reconstructs(spark, sf_dir):
    rows = catalog.QUERIES["svd_basis"](spark, sf_dir).orderBy("component").collect()
    v = np.array([r["loadings"] for r in rows])
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-8)
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], float)
    assert np.allclose([r["singular"] for r in rows], np.linalg.svd(x, compute_uv=False)[: len(rows)], rtol=1e-6)
    assert (v[np.arange(len(v)), np.abs(v).argmax(1)] > 0).all()


def test_clusters_2d_against_brute_force(spark, sf_dir):
    from lagweave.operators.stats import label_cells

    rng = np.random.default_rng(4)
    for _ in range(20):
        over = rng.random((7, 9)) < 0.5
        label = label_cells(over)
        seen: dict[tuple, int] = {}
        for i, j in zip(*np.nonzero(over), strict=True):
            if (i, j) in seen:
                continue
            todo, seen[i, j] = [(i, j)], len(seen) + 1
            while todo:
                a, b = todo.pop()
                for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c[0] < 7 and 0 <= c[1] < 9 and over[c] and c not in seen:
                        seen[c] = seen[i, j]
                        todo.append(c)
        pairs = list(seen)
        for p in pairs:
            for q in pairs:
                assert (label[p] == label[q]) == (seen[p] == seen[q])
        assert (label[~over] == 0).all()
    rows = catalog.QUERIES["cluster_perm_2d"](spark, sf_dir).collect()
    assert len(rows) == 120 and all(not r["significant"] for r in rows if r["cluster"] == 0)


def test_elastic_net_conditions():
    from lagweave.operators.regress import elastic_net, ridge, standard

    rng = np.random.default_rng(0)
    x = standard(rng.normal(size=(60, 8)))
    y = standard((x @ rng.normal(size=8) + rng.normal(size=60))[:, None])[:, 0]
    b = elastic_net(x, y, 0.2, 0.5)
    slope = x.T @ (y - x @ b) / 60 - 0.1 * b
    assert np.allclose(slope[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-7) and (np.abs(slope[b == 0]) <= 0.1 + 1e-7).all()
    r = ridge(x, y, 2.0)
    assert np.allclose(x.T @ (y - x @ r), 2.0 * r)


def test_t_quantile():
    from lagweave.functions.numerics import t_cdf, t_quantile

    assert abs(t_quantile(0.975, 7) - 2.364624251592784) < 1e-9
    assert abs(t_quantile(0.975, 26) - 2.055529438642871) < 1e-9
    assert abs(t_cdf(0.0, 5) - 0.5) < 1e-12


def test_signal_kernels():
    from lagweave.functions import numerics as N

    t = np.arange(1000) / 1000
    low, high = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 120 * t)
    taps = N.bandpass_taps(0.5, 30, 1000, 801)
    assert abs(N.fir(low, taps)[400:600]).max() > 0.9 and abs(N.fir(high, taps)[400:600]).max() < 0.02
    assert np.allclose(N.fft_resample(low, 100), low[::10], atol=1e-9)
    e = N.envelope(low, 1000, [10.0, 600.0])
    assert len(e) == 1000 and e[500:].max() > 0
    taps = N.lowpass_taps(10)
    assert abs(taps.sum() - 1) < 1e-12 and np.allclose(taps, taps[::-1])


def test_lda_finds_a_shift(spark):
    from lagweave.operators.stats import lda_decode

    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        y = float(i % 2)
        rows += [(i, y, 0, (rng.normal(size=3) + 2 * y).tolist()), (i, y, 1, rng.normal(size=3).tolist())]
    got = {r["time"]: r["score"] for r in lda_decode(spark.createDataFrame(rows, "row long, y double, time int, features array<double>"), "time").collect()}
    assert got[0] > 0.8 and abs(got[1]) < 0.4


def test_literals(spark):
    from lagweave.sources.tables import parse_literal

    raw = ["{'kind': 'word', 'word': \"it's\", 'x': nan, 'y': None, 'z': True}", "{'kind': 'None, nan'}", "broken", None]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(r,) for r in raw], "s string").select(parse_literal(F.col("s"), "kind string, word string, x double, y int, z boolean").alias("a")).collect()
    assert got[0]["a"]["word"] == "it's" and got[0]["a"]["y"] is None and got[0]["a"]["z"] is True and math.isnan(got[0]["a"]["x"])
    assert got[1]["a"]["kind"] == "None, nan"
    assert got[2]["a"] is None or got[2]["a"]["kind"] is None


def test_files(spark, tmp_path):
    from lagweave.sources import sinks, tables

    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\na 5 6\nc 7 8\n")
    vocab = spark.createDataFrame([("a",), ("b",)], "token string")
    assert {r["token"]: r["vector"] for r in tables.vectors_text(spark, str(tmp_path / "v.txt"), vocab).collect()} == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    (tmp_path / "m.json").write_text('{"segments": [{"session": "2", "n_times": 5}, {"session": "1", "n_times": 7}]}')
    assert [(r["seg_no"], r["session"], r["n_times"]) for r in tables.manifest(spark, str(tmp_path / "m.json")).orderBy("seg_no").collect()] == [(0, "2", 5), (1, "1", 7)]
    (tmp_path / "e.tsv").write_text("﻿trial_type\tsample\n{'kind': 'word'}\t5\n", encoding="utf-8")
    assert tables.events_tsv(spark, str(tmp_path / "e.tsv")).columns[-1] == "sample"
    out = str(tmp_path / "out")
    sinks.save(spark.range(3), out)
    sinks.save(spark.range(5), out, "skip")
    assert spark.read.parquet(out).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save(spark.range(5), out, "fail")
    sinks.save(spark.range(5), out, "replace")
    assert spark.read.parquet(out).count() == 5


def test_binary_files(spark, tmp_path):
    import wave

    from lagweave.sources import files

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(np.array([[16384, 0], [0, -16384]], np.int16).tobytes())
    r = files.wav_scan(spark, str(tmp_path / "a.wav")).collect()[0]
    assert r["rate"] == 100 and r["samples"] == [0.25, -0.25]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    assert [r["features"] for r in files.npy_scan(spark, str(tmp_path / "m.npy")).orderBy("t").collect()] == [[0, 3], [1, 4], [2, 5]]
    (tmp_path / "p.csv").write_text("phoneme,phonation\nAA,v\nP,uv\nSIL,s\n")
    assert {r["phoneme"]: r["voicing"] for r in files.voicing_table(spark, str(tmp_path / "p.csv")).collect()} == {"aa": 1, "p": -1}


def test_stream_of_bins(spark, sf_dir, tmp_path):
    from lagweave.streaming.ingest import binned

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = binned(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["bin"], r["n"]) for r in spark.sql("select * from bins").collect()}
    assert got == {(r["bin"], r["n"]) for r in binned(events).collect()}


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() == 13


def test_regressions_are_those_of_whole_designs(spark):
    """Bands, shared Gram matrices and borders give what fitting each design by itself gives."""
    from lagweave.operators import regress as G

    rng = np.random.default_rng(8)
    length, pairs = 9, 40
    z = {k: G.standard(rng.normal(size=(2 * length, pairs)).T).T.reshape(2, length, pairs) for k in ("y", "a", "b")}
    z["y"] = z["y"] * 0.3 + z["a"] * 0.9
    frame = lambda k: spark.createDataFrame([(i, o, [float(v) for v in z[k][i, o]]) for i in range(2) for o in range(length)], "iteration int, offset int, z array<double>")
    for method, options in (("ridge", {"alpha": 3.0}), ("elasticnet", {"alpha": 0.1}), ("lasso", {"alpha": 0.05}), ("pcr", {"explained": 0.7})):
        for predictors in (None, ("a",)):
            got = {(r["model"], r["t_neural"], r["t_model"]): (r["beta"], r["r2"]) for r in G.cross_temporal(frame("y"), {"a": frame("a"), "b": frame("b")}, {"a": 1, "b": 0}, 2, method, predictors=predictors, **options).collect()}
            assert len(got) == 2 * sum(abs(s - t) <= 2 for s in range(length) for t in range(length))
            for (name, tn, tm), (beta, r2) in got.items():
                want = []
                for i in range(2):
                    stacks, k = [z["a"][i], z["b"][i]], "ab".index(name)
                    at = [c for c in G.columns([length, length], k, tm, 2, {"a": 1, "b": 0}[name]) if c == (k, tm) or predictors is None or c[0] == 0]
                    y = (z["y"][i, tn] - z["y"][i, tn].mean()) / z["y"][i, tn].std()
                    b, r, _ = G.fit(method, np.stack([stacks[m][t] for m, t in at]).T, y, **options)
                    want.append((b[0], r))
                sd = [z["y"][i, tn].std() for i in range(2)]
                if method in ("pcr", "ridge"):  # linear in y, whose scale stays here
                    assert np.isclose(beta, np.mean([w[0] * s for w, s in zip(want, sd, strict=True)]), atol=0.03)
                    assert np.isclose(r2, np.mean([w[1] for w in want]), atol=0.03)
    with pytest.raises(ValueError, match="needs a model"):
        G.fits(frame("y"), {}, {}, 2)


def test_permutation_of_maps_against_brute_force(spark):
    from lagweave.operators import stats as St

    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 6, 5))
    x[:, 1:3, 1:4] += 1.5
    rows = [(f"s{s}", i, j, float(x[s, i, j])) for s in range(7) for i in range(6) for j in range(5) if (s, i, j) != (2, 4, 4)]
    x[2, 4, 4] = 0
    got = St.cluster_permutation_2d(spark.createDataFrame(rows, "subject string, t_neural int, t_model int, r double"), 2.0, 40, 0.1, 5).collect()
    tmap = lambda v: v.mean(0) / (v.std(0, ddof=1) / np.sqrt(7))
    flips = {(r["perm"], r["subject"]): r["flip"] for r in St.sign_flips(spark.createDataFrame([(f"s{s}",) for s in range(7)], "subject string"), 40, 5).collect()}
    most = [max([abs(m) for m in St.masses(tmap(x * np.array([flips[p, f"s{s}"] for s in range(7)])[:, None, None]), 2.0)[1].values()], default=0.0) for p in range(40)]
    label, mass = St.masses(tmap(x), 2.0)
    bar = np.quantile(most, 0.9)
    assert len(got) == 30 and any(r["significant"] for r in got)
    for r in got:
        i, j = r["t_neural"], r["t_model"]
        assert np.isclose(r["t"], tmap(x)[i, j]) and r["cluster"] == label[i, j]
        assert r["significant"] == bool(label[i, j] and abs(mass[label[i, j]]) > bar)


def test_decoding_of_two_and_more_values(spark):
    from lagweave.operators.stats import lda_decode

    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        y = float(i % 5 != 0)  # most are 1: the median is no split of two values
        rows.append((i, y, 0, [float(rng.normal() + 3 * y), float(rng.normal())]))
        rows.append((i, float(i % 3), 1, [float(rng.normal() + 3 * (i % 3 > 1)), float(rng.normal())]))
    got = {r["time"]: r["score"] for r in lda_decode(spark.createDataFrame(rows, "row long, y double, time int, features array<double>"), "time").collect()}
    assert got[0] > 0.7 and got[1] > 0.7


def test_envelope_is_that_of_both_half_waves():
    x = np.sin(2 * np.pi * 40 * np.arange(2000) / 1000)
    band = N.gammatone(x, 40.0, 1000)
    assert np.allclose(N.envelope(x, 1000, [40.0], 1.0), np.abs(band)) and np.allclose(N.envelope(-x, 1000, [40.0]), N.envelope(x, 1000, [40.0]))


def test_too_few_windows_and_other_channels_are_errors(spark):
    from lagweave.operators import registry, runs
    from lagweave.operators import windows as W

    starts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "subject string, start int")
    assert W.draw_windows(starts, 2, 1, 3, ("subject",)).count() == 4
    with pytest.raises(Exception, match="fewer than 2 windows"):
        W.draw_windows(starts, 2, 2, 3, ("subject",)).collect()
    chans = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["x"])], "subject string, task int, channels array<string>")
    assert [r["agrees"] for r in runs.same_channels(chans, ("subject",), ("task",)).orderBy("task").collect()] == [True, False]
    with pytest.raises(Exception, match="channels of runs differ"):
        runs.same_channels(chans, ("subject",), ("task",), require=True).collect()
    made = spark.createDataFrame([("a", 1, 5)], "subject string, task int, x int")
    with pytest.raises(Exception, match="a segment has no product"):
        runs.product_join(chans, made, ("subject",), ("task",), "fail").collect()
    with pytest.raises(ValueError, match="2 points instead of 3"):
        registry.check_lengths(spark.createDataFrame([("m", 0), ("m", 1)], "signal string, t int"), 3)
    results = spark.createDataFrame([("a", None, "A", "base", "", 1.0), ("a", None, "A", "model", "x", 1.0), ("a", None, "A", "model", "y", 1.0)], "subject string, neural string, model string, origin string, label string, r double")
    assert [r["neural"] for r in runs.subject_results(results, ["a"]).collect()] == ["Neural 1"]
    with pytest.raises(Exception, match="a model is missing"):
        runs.subject_results(results, ["a", "b"]).collect()
    with pytest.raises(Exception, match="several simulations"):
        runs.subject_results(results, ["a"], "model").collect()
    assert runs.subject_results(results, ["a"], "model", "y").count() == 1


def test_resampled_clips(spark):
    from lagweave.operators import timegrid as T

    clips = spark.createDataFrame([(1, 20, [float(np.sin(2 * np.pi * k / 20)) for k in range(40)])], "clip int, rate int, samples array<double>")
    seg = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0), (1, 1, 1.0, 0.5, 1.0), (2, 1, 2.9, 0.0, 2.0), (3, 1, 0.0, 1.5, 1.0)], "seg_no long, clip int, onset double, audio_onset double, audio_offset double")
    got = {r["t"]: r["x"] for r in T.place_clips(seg, clips, 10, 30).collect()}
    half = N.fft_resample(np.sin(2 * np.pi * np.arange(40) / 20), 20)
    assert set(got) == set(range(20)) | {29}
    assert all(np.isclose(got[t], half[t]) for t in [*range(10), *range(15, 20)]) and np.isclose(got[29], half[0])


def test_control(spark, tmp_path):
    from lagweave.plans import control as C

    s = C.Settings(window_seconds=2.0, averaging_seconds=3.0, rate=10.0).checked()
    assert (s.length, s.reach) == (20, 19) and "lags to 1.9 s" in s.caption()
    for bad in ({"l1_ratio": 1.5}, {"subsamples": 1}, {"iterations": 0}, {"window_seconds": 0}, {"averaging_seconds": -1}, {"progress_every": 0}, {"method": "x"}, {"shuffle_windows": True}):
        with pytest.raises(ValueError):
            C.replace(s, **bad).checked()
    assert C.base_dir(None, {"LAGWEAVE_DATA": "/x/"}) == "/x" and C.base_dir("/y", {}) == "/y"
    assert C.rebased("/a/b/c", "/a/b", "/z") == "/z/c" and C.rebased("/a/bc", "/a/b", "/z") == "/a/bc"
    pointer = tmp_path / "where.txt"
    pointer.write_text("/v/vec.txt\n")
    assert C.vectors_path(None, {}, str(pointer)) == "/v/vec.txt" and C.vectors_path(None, {"LAGWEAVE_VECTORS": "/w"}) == "/w" and C.vectors_path("/g", {}) == "/g"
    with pytest.raises(FileNotFoundError):
        C.vectors_path(None, {})
    done = []
    fails = lambda: 1 / 0
    steps = [("a", lambda: done.append("a")), ("b", fails), ("c", lambda: done.append("c"))]
    assert C.run_steps(steps, go_on=True) == {"a": "done", "b": "failed: division by zero", "c": "done"}
    assert C.run_steps(steps, first="c") == {"a": "skipped", "b": "skipped", "c": "done"} and done == ["a", "c", "c"]
    with pytest.raises(ZeroDivisionError):
        C.run_steps(steps)
    base = str(tmp_path / "out")
    make = lambda k: spark.range(3).withColumn("s", F.lit(k))
    spark.range(1).write.parquet(f"{base}/native/a")
    assert C.each_subject(spark, ["a", "b"], base, make, lambda k: [f"{base}/native/{k}"]) == ["a", "b"] and not C.exists(spark, f"{base}/native/a")
    assert C.each_subject(spark, ["a", "b", "c"], base, make) == ["c"] and spark.read.parquet(base).count() == 9
    with pytest.raises(ValueError):
        C.prune(spark, ["/etc"], base)
    made = []
    for _ in range(2):
        assert C.cached(spark, f"{base}/win", s, lambda: made.append(1) or spark.range(4)).count() == 4
    assert made == [1]
    C.save_group({"curves": spark.range(5)}, f"{base}/group", s)
    tables, then = C.load_group(spark, f"{base}/group", ["curves"], s)
    assert tables["curves"].count() == 5 and then == s
    with pytest.raises(ValueError, match="iterations"):
        C.load_group(spark, f"{base}/group", ["curves"], C.replace(s, iterations=7))
    assert C.folders("/b/", "x")["group"] == "/b/x/group"


def test_registry():
    from lagweave.operators import registry as Reg

    assert [m.label for m in Reg.selected(Reg.MODELS, "glove, ENVELOPE")] == ["Envelope", "GloVe"] and len(Reg.selected(Reg.MODELS)) == 7
    assert Reg.borders((Reg.Model("a", "euclidean"), Reg.Model("b", "cosine", 0.3)), 0.1) == {"a": 0.1, "b": 0.3}


def test_nearest_time_is_one_pass(spark):
    from lagweave.operators.rsa import nearest_time

    points = [("a", t, float(t)) for t in (0, 4, 10, 11)] + [("a", 99, 4.0), ("b", 7, 5.0)]
    taus = [("a", x) for x in (-3.0, 2.0, 2.5, 4.0, 7.0, 10.5, 40.0)] + [("b", 1.0), ("b", 9.0), ("c", 1.0)]
    out = nearest_time(spark.createDataFrame(points, "s string, t long, sec double"), spark.createDataFrame(taus, "s string, tau double"), ("s",))
    got = {(r["s"], r["tau"]): r["t"] for r in out.collect()}
    assert got == {("a", -3.0): 0, ("a", 2.0): 0, ("a", 2.5): 4, ("a", 4.0): 4, ("a", 7.0): 4, ("a", 10.5): 10, ("a", 40.0): 11, ("b", 1.0): 7, ("b", 9.0): 7, ("c", 1.0): None}
    # A frame that ends at the last row is made anew for each row.
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()


def test_stories_are_made_objects_one_at_a_time(spark):
    from lagweave.operators.features import score_story

    def most(stories: int) -> float:
        words = spark.range(stories * 100, numPartitions=1).select(F.floor(F.col("id") / 100).alias("doc"), (F.col("id") % 100).cast("int").alias("pos"), F.concat(F.lit("w"), "id").alias("token")).coalesce(1)

        def blocks(words: list[str], n: int) -> list[float]:
            import sys

            return [float(sys.getallocatedblocks())] * n

        return score_story(words, blocks, 8, 4).agg(F.max("score")).first()[0]

    assert most(4000) - most(4) < 100_000
