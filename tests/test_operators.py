"""Worked examples, brute force, invariants and finite differences for the operators."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.functions import vec
from verdigris.operators import classifiers as cl
from verdigris.operators import curation, evaluation, graphmethods, graphnet, graphs, joins, ordering, regions, reports, sampling, similarity, splits
from verdigris.operators.gradients import Var
from verdigris.plans import costs, runs
from verdigris.sources import domains, encoders, models, readers
from verdigris.streaming import logs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors(spark):
    a, b = F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(0.8), F.lit(0.6))
    r = one(spark, vec.dot(a, b).alias("d"), vec.normalized(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vec.normalized(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vec.hex_hamming(F.lit("ffffffff00000000"), F.lit("0000000000000001")).alias("h"))
    assert r["d"] == pytest.approx(0.96) and r["u"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["h"] == 33


def test_softmax_and_temperature(spark):
    z = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, 0.0)], "vec_id bigint, class int, z double")
    assert [round(r["p"], 3) for r in evaluation.softmax(z).orderBy("class").collect()] == [0.665, 0.245, 0.09]
    two = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0)], "vec_id bigint, class int, z double")
    assert [round(evaluation.softmax(two, tau=t).orderBy("class").first()["p"], 3) for t in (1.0, 2.0)] == [0.881, 0.731]


def test_metrics_example(spark):
    rows = [(0, 0)] * 80 + [(0, 1)] * 20 + [(1, 0)] * 10 + [(1, 1)] * 890
    cells = evaluation.confusion(spark.createDataFrame(rows, "label int, pred int"), 2)
    m = evaluation.class_metrics(cells).orderBy("class").first()
    assert [round(m[c], 3) for c in ("precision", "recall", "f1")] == [0.889, 0.8, 0.842]
    s = evaluation.summary(cells).first()
    assert round(s["acc"], 3) == 0.97 and round(s["macro_f1"], 3) == 0.913
    absent = evaluation.summary(evaluation.confusion(spark.createDataFrame(rows, "label int, pred int"), 4)).first()
    assert absent["macro_f1"] == pytest.approx(s["macro_f1"] / 2)


def test_ece_example(spark):
    rows = [(0.7, i < 36) for i in range(40)] + [(0.95, i < 57) for i in range(60)]
    assert evaluation.ece(spark.createDataFrame(rows, "conf double, right boolean")).first()[0] == pytest.approx(0.08)
    assert evaluation.ece(spark.createDataFrame([], "conf double, right boolean")).first()[0] == 0


def test_iou_and_suppression(spark):
    box = lambda *x: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1", "score"))])
    r = one(spark, regions.overlap(box(0, 0, 4, 4, 1), box(2, 2, 6, 6, 1)).alias("iou"), regions.suppressed(F.array(box(0, 0, 4, 4, 0.5), box(0, 0, 4, 3.9, 0.9), box(9, 9, 12, 12, 0.1))).alias("kept"))
    assert round(r["iou"], 3) == 0.143 and [k["score"] for k in r["kept"]] == [0.9, 0.1]


def test_cache_votes():
    c = cl.Cache(np.eye(2))
    assert 2 * c.affinity(np.array([[1.0, 0]]), np.array([[0.9, np.sqrt(1 - 0.81)]]), 5)[0, 0] == pytest.approx(1.213, abs=1e-3)
    assert 2 * c.affinity(np.array([[1.0, 0]]), np.array([[0.7, np.sqrt(1 - 0.49)]]), 5)[0, 0] == pytest.approx(0.446, abs=1e-3)


def gradients_agree(loss, params, tol=1e-4):
    _, grads = loss(params)
    rng = np.random.default_rng(0)
    for p, g in zip(params, grads):
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in p.shape)
            old, h = p[i], 1e-6
            p[i] = old + h
            up = loss(params)[0]
            p[i] = old - h
            down = loss(params)[0]
            p[i] = old
            assert (up - down) / (2 * h) == pytest.approx(g[i], abs=tol, rel=1e-3)


def toy(n=24, c=3, d=8, seed=0):
    rng = np.random.default_rng(seed)
    text = cl.unit(rng.normal(size=(c, d)))
    y = np.arange(n) % c
    return text, cl.Batch(cl.unit(text[y] + 0.4 * rng.normal(size=(n, d))), y, cl.unit(rng.normal(size=(n, d)) + text[y]))


@pytest.mark.parametrize("name", ["task_residual", "feature_adapter", "class_adaptive", "text_graph"])
def test_adapter_gradients(name, monkeypatch):
    monkeypatch.setattr(cl, "SCALE", 5.0)
    text, s = toy()
    m = cl.METHODS[name](text)
    params = [p + 0.1 * np.random.default_rng(1).normal(size=p.shape) for p in m.start(s, m.grid[0])]
    gradients_agree(lambda p: m.loss(p, s.x, s.y, m.grid[0]), params)


def test_cache_gradients(monkeypatch):
    monkeypatch.setattr(cl, "SCALE", 5.0)
    text, s = toy()
    m = cl.TrainedCache(text)
    m.values = cl.per_class(cl.one_hot(s.y, 3))
    gradients_agree(lambda p: m.loss(p, s.x, s.y), [s.x.copy()])
    t = cl.TwoCaches(text)
    t.values = m.values
    gradients_agree(lambda p: t.loss(p, s.x, s.x2, s.y), [s.x.copy(), s.x2.copy()])


@pytest.mark.parametrize("pick", [False, True])
@pytest.mark.parametrize("name", sorted(cl.METHODS))
def test_methods_learn(name, pick):
    text, s = toy(60)
    m = cl.METHODS[name](text)
    m.pick = pick
    m.fit(s, toy(30, seed=0)[1])
    assert m.f1(s) > 0.8
    assert m.fit(s, cl.Batch(np.zeros((0, 8)), np.zeros(0, int), np.zeros((0, 8)))).logits(s.x, s.x2).shape == (60, 3)


def test_calibration_keeps_what_is_right():
    assert evaluation.fit_temperature(np.array([[2.0, 0], [0, 2.0]]), np.array([0, 1]))[0] == 1.0
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    z = 8 * rng.normal(size=(400, 3)) + 4 * cl.one_hot(y, 3)
    tau, b = evaluation.fit_temperature(z, y)
    nll = lambda s: -np.log(cl.softmax(s)[np.arange(400), y]).mean()
    assert tau > 1 and nll((z + b) / tau) < nll(z)


def test_calibration_of_a_table_is_that_of_arrays(spark):
    """The summed Newton steps against the array's, and against a fine search around the result."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    z = 6 * rng.normal(size=(300, 3)) + 4 * cl.one_hot(y, 3) + [1.0, 0, -1]
    df = spark.createDataFrame([(i, int(y[i]), c, float(z[i, c])) for i in range(300) for c in range(3)], "vec_id int, label int, class int, z double").repartition(3)
    for bias in (True, False):
        tau, b = evaluation.fit_temperature(z, y, bias)
        got = evaluation.fit_calibration(df, 3, with_bias=bias)
        assert got[0] == pytest.approx(tau, rel=1e-6) and np.allclose(got[1], b, atol=1e-6)
        loss = lambda t, b: -np.log(cl.softmax((z + b) / t)[np.arange(300), y]).mean() + 1e-3 * (b @ b)  # noqa: B023, E731
        here = loss(tau, b)
        assert all(loss(tau * t, b) >= here - 1e-9 for t in (0.97, 1.03)) and (not bias or all(loss(tau, b + s * e) >= here - 1e-9 for e in np.eye(3) for s in (0.05, -0.05)))
    p = {(r["vec_id"], r["class"]): r["p"] for r in evaluation.calibrated(df, 2.0, np.array([0.5, 0.0, -0.5])).collect()}
    assert np.allclose([[p[i, c] for c in range(3)] for i in range(300)], cl.softmax((z + [0.5, 0, -0.5]) / 2))
    assert evaluation.fit_calibration(df.filter("false"), 3)[0] == 1.0


def test_attention_ignores_masked_nodes():
    rng = np.random.default_rng(0)
    net = graphnet.Network(8, hidden=8, rounds=1, heads=2)
    p = graphmethods.leaves(net.start(rng))
    nodes = graphnet.Nodes(rng.normal(size=(2, 5, 8)), np.ones((2, 5), int), rng.uniform(size=(2, 5, 5)), np.array([[True] * 3 + [False] * 2] * 2))
    a = net.attention(p, "0.0", Var(rng.normal(size=(2, 5, 4))), Var(graphnet.relations(nodes)), nodes.live).value
    assert np.allclose(a.sum(-1), 1) and np.all(a[..., 3:] == 0)
    changed = graphnet.Nodes(nodes.vector + 9 * ~nodes.live[..., None], nodes.kind, nodes.place, nodes.live)
    one, other = (net.states(p, x) for x in (nodes, changed))
    assert np.allclose(one.value[:, :3], other.value[:, :3]) and np.allclose(graphnet.pooled(one, nodes.live, p["ask"]).value, graphnet.pooled(other, nodes.live, p["ask"]).value)


def brute_components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_and_independent_set(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(i, i + 1) for i in range(60, 75)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    nodes = spark.range(80).withColumnRenamed("id", "node")
    for few in (0, 10**6):
        got = {r["node"]: r["root"] for r in graphs.components(edges, nodes, few).collect()}
        assert [got[i] for i in range(80)] == brute_components(80, pairs)
        assert graphs.components(edges, few=few).count() == len({x for p in pairs for x in p})
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(80)}
    kept = []
    for i in range(80):
        if not near[i] & set(kept):
            kept.append(i)
    rows = graphs.first_independent_set(nodes, edges).collect()
    assert sorted(r["node"] for r in rows if r["kept"]) == kept
    assert all(r["twin"] == min(near[r["node"]] & set(kept)) for r in rows if not r["kept"])
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert graphs.components(none, nodes).filter("node = root").count() == 80
    assert graphs.first_independent_set(nodes, none).filter("kept").count() == 80


def test_similar_pairs_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = cl.unit(rng.normal(size=(70, 6)))
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)] + [(99, None, 0)], "vec_id bigint, embedding array<double>, label int")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.5, 0.7, block=16).collect()}
    s = v @ v.T
    assert got == {(i, j) for i, j in itertools.combinations(range(70), 2) if s[i, j] >= (0.5 if i % 3 == j % 3 else 0.7)}


def test_close_hashes(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, (40, 2))
    rows = [(i, int(h), int(w), 0) for i, (h, w) in enumerate(base)] + [(100 + i, int(h) ^ 5, int(w) ^ (1 << 31), 0) for i, (h, w) in enumerate(base)]
    got = similarity.close_hashes(spark.createDataFrame(rows, "vec_id bigint, high bigint, low bigint, label int"), 6).collect()
    bits = lambda a, b: bin(a[1] ^ b[1]).count("1") + bin(a[2] ^ b[2]).count("1")
    assert {(r["a"], r["b"], r["bits"]) for r in got} == {(a[0], b[0], bits(a, b)) for a, b in itertools.combinations(rows, 2) if bits(a, b) <= 6}


@pytest.mark.parametrize("crowd", [3, 5_000])
def test_close_hashes_of_copies_and_crowds(spark, crowd):
    rng = np.random.default_rng(8)
    rows = [(i, 0, int(rng.integers(0, 64)), i % 2) for i in range(150)] + [(200 + i, 7, 7, 0) for i in range(20)] + [(300, None, 0, 0), (301, 0, None, 0), (302, 0, 0, None), (None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, high bigint, low bigint, label int")
    got = similarity.close_hashes(df.withColumn("own", F.lit(1)), 2, crowd=crowd).collect()
    bits = lambda a, b: bin(a[1] ^ b[1]).count("1") + bin(a[2] ^ b[2]).count("1")
    want = sorted((a[0], b[0], bits(a, b)) for a, b in itertools.combinations(rows[:170], 2) if a[3] == b[3] and bits(a, b) <= 2)
    assert sorted((r["a"], r["b"], r["bits"]) for r in got) == want
    assert similarity.close_hashes(df.filter("false"), 2, crowd=crowd).count() == 0


@pytest.mark.parametrize("crowd, block", [(1, 7), (4, 3), (256, 8192)])
def test_close_hashes_of_crowds_in_blocks(spark, crowd, block):
    """Few different band values: all pairs once each, highest bits and names as ids too, in tasks for the work and not for its bytes."""
    rng = np.random.default_rng(4)
    half = lambda: [int(x) for x in (rng.integers(0, 4, 90) << 30) | rng.integers(0, 2, 90) << 13 | rng.integers(0, 4, 90)]
    rows = [(f"{i:03}", h, w, "xy"[i % 2]) for i, (h, w) in enumerate(zip(half(), half()))]
    df = spark.createDataFrame(rows, "vec_id string, high bigint, low bigint, label string")
    got = similarity.close_hashes(df, 4, crowd=crowd, block=block)
    bits = lambda a, b: bin(a[1] ^ b[1]).count("1") + bin(a[2] ^ b[2]).count("1")
    want = sorted((a[0], b[0], bits(a, b)) for a, b in itertools.combinations(rows, 2) if a[3] == b[3] and bits(a, b) <= 4)
    assert sorted((r["a"], r["b"], r["bits"]) for r in got.collect()) == want and len(want) > 500
    assert got.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_nearest_of_nothing(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert similarity.nearest(q, q.filter("false")).first()["near_id"] is None
    with pytest.raises(ValueError):
        similarity.held(spark.range(10), "id", most=5)


def test_clusters_and_communities():
    v = cl.unit(np.array([[1, 0.1], [1, 0], [0, 1], [0.1, 1], [-1, 0]]))
    assert graphs.average_linkage(v, 0.9).tolist() == [0, 0, 1, 1, 2]
    edges = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a, b in itertools.combinations(g, 2)] + [(4, 5, 1.0)]
    c = graphs.louvain(list(range(10)), edges)
    assert [c[i] for i in range(10)] == [0] * 5 + [1] * 5 and graphs.louvain([1, 2], []) == {1: 0, 2: 1}


def test_homography_and_matches():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (20, 2))
    q = p @ np.array([[0.9, 0.1], [-0.1, 1.1]]) + 5
    q[15:] = rng.uniform(0, 100, (5, 2))
    assert graphs.homography_inliers(p, q, 1.0) >= 15 and graphs.homography_inliers(p[:3], q[:3]) == 0
    d = np.eye(6)
    assert graphs.mutual_matches(d[:4], d) == [(0, 0), (1, 1), (2, 2), (3, 3)]


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.tuples(st.integers(0, 9), st.integers(1, 9)), min_size=1, max_size=20))
def test_quota_is_kept(groups):
    counts = [(g, {"one": a, "many": b}) for g, (a, b) in groups.items()]
    taken = splits.fill_quota(counts, 0.2, 1.05, "s")
    for q in ("one", "many"):
        assert sum(dict(counts)[g][q] for g in taken) <= 0.21 * sum(c[q] for _, c in counts) + 1e-9


def test_best_assignment(spark):
    counts = {"a": (4, 1), "b": (1, 4), "c": (5, 5), "d": (10, 10), "e": (20, 20)}
    df = spark.createDataFrame([(g, c) for g, n in counts.items() for c in (0, 1) for _ in range(n[c])], "grp string, label int")
    got = {r["grp"]: r for r in splits.best_assignment(df, 0.25, "grp", tries=300).collect()}
    total = np.sum(list(counts.values()), 0)
    best = (np.inf, None)
    for t in range(300):
        have = splits.chosen(t, sorted(counts)) @ np.array([counts[g] for g in sorted(counts)], float)
        if not (have > total * 0.25 * 1.25).any():
            best = min(best, (float(np.abs(have / (total * 0.25) - 1).max()), t))
    assert [got[g]["in_pool"] for g in sorted(counts)] == splits.chosen(best[1], sorted(counts)).tolist() and {r["error"] for r in got.values()} == {best[0]} and best[0] < 0.3


def test_removals(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, None, "x"), (6, "c", "x")], "doc_id bigint, text string, lang string")
    got = {r["key"] if "key" in r else r["doc_id"]: (r["reason"], r["kept_twin"]) for r in curation.removals(docs, label="lang").collect()}
    assert got == {2: ("exact duplicate", 1), 3: ("label conflict", None), 4: ("exact duplicate", 3), 5: ("unreadable", None)}
    left = curation.cleaned(docs, curation.removals(docs, label="lang"), "lang").select("doc_id", "new_group").collect()
    assert sorted((r[0], r[1]) for r in left) == [(1, 0), (6, 0)]


def test_support_by_group(spark):
    df = spark.createDataFrame([(i, i % 2, i // 4) for i in range(40)], "vec_id bigint, label int, grp int")
    s = splits.support(df, 3, 1, group="grp").toPandas()
    assert s.groupby("label").size().tolist() == [3, 3] and s.groupby("label").grp.nunique().tolist() == [3, 3]
    assert splits.support(df, 99, 1).count() == 40


def test_ground_truth_and_labels(spark):
    lines = spark.createDataFrame([("a.png 1 1 2 3 4",), ("b.png 0",), ("a.png 1 5,6,7,8 9 9 9 9",), ("",)], "value string")
    got = {r["path"]: r["boxes"] for r in readers.ground_truth(lines).collect()}
    assert sorted(got["a.png"]) == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 9, 9, 9]] and got["b.png"] == []
    paths = spark.createDataFrame([("d/rust/scratch_1.png",), ("d/rust/z.png",), ("d/none/z.png",)], "p string")
    paths = paths.withColumnRenamed("p", "path").union(spark.createDataFrame([("Scratch Deep/c1500-x.png",), ("rust/deep/scratch/q.png",), ("rustic.png",), (None,)], "path string"))
    classes = spark.createDataFrame([(f"c{i}",) for i in range(2000)] + [("Rust",), ("scratch",), ("scratch deep",), ("",), (None,)], "class string")
    got = {r["path"]: r["label"] for r in readers.labels_of(paths, classes).collect()}
    assert got == {"d/rust/scratch_1.png": "scratch", "d/rust/z.png": "rust", "d/none/z.png": None, "Scratch Deep/c1500-x.png": "c1500", "rust/deep/scratch/q.png": "scratch", "rustic.png": "rust", None: None}


def test_store_and_log(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    df = spark.createDataFrame([("a", [1.0], "m", "global"), ("b", [2.0], "m", "aug")], readers.FEATURES)
    readers.save_features(df, store)
    readers.save_features(df.filter("mode = 'aug'").withColumn("vec", F.array(F.lit(3.0).cast("float"))), store)
    assert [(r["path"], r["vec"]) for r in readers.features(spark, store, "m", "aug").collect()] == [("b", [3.0])]
    with pytest.raises(KeyError):
        readers.bound(spark.createDataFrame([("z",)], "path string"), readers.features(spark, store, "m", "global"))
    text, s = toy(30)
    items = spark.createDataFrame([(i, [float(v) for v in x], int(y)) for i, (x, y) in enumerate(zip(s.x, s.y))], "vec_id bigint, embedding array<double>, label int")
    log = f"file://{tmp_path}/log"
    todo = runs.plan(spark, ["zero_shot", "task_residual"], (2,), (1,), ("last-epoch", "best-epoch"))
    go = lambda: runs.run(todo, log, lambda n: cl.METHODS[n](text), lambda k, seed: (splits.support(items, k, seed), items.limit(6)), items, 3)
    assert go() == 4 and go() == 0
    got = readers.run_log(spark, log)
    assert got.count() == 4 and got.filter("macro_f1 > 0.5").count() >= 2
    q = logs.tail(spark, log).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT count(*) FROM runs").first()[0] == 4
    table = reports.by_size(reports.mean_std(got, ["method", "K"], "macro_f1"), "method", "mean")
    assert "| method |" in readers.markdown(table.select("method", "k_2"))


def test_stream_of_arrivals(spark, tmp_path):
    ref = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/in")
    found = []
    s = spark.readStream.schema(ref.schema).parquet(f"{tmp_path}/in")
    logs.check_arrivals(s, ref, 0.9, lambda df, n: found.extend(r["vec_id"] for r in df.collect()), f"{tmp_path}/cp").awaitTermination(60)
    assert found == [7]


def test_event_windows(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:31"]), "event_type": "a", "value": [1.0, 2.0, 3.0]})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/ev")
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev")
    q = logs.event_windows(s).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n"], r["total"]) for r in spark.sql("SELECT * FROM windows").collect()] == [(2, 3.0)]


def test_dots(spark):
    log = spark.createDataFrame([("a", "1", 0.5), ("a", "1", 0.7), ("b", "1", 0.6004), ("b", "1", None), ("b", "2", 0.01), ("c", "2", None)], "method string, K string, f1 double").withColumn("place", F.lit("x"))
    got = {(r["method"], r["K"]): r for r in reports.dots(log, "f1").collect()}
    assert set(got) == {("a", "1"), ("b", "1"), ("b", "2")}  # a method without a value has no dot
    assert got["a", "1"]["lo"] == 0.5 and got["a", "1"]["hi"] == 0.7 and got["a", "1"]["start"] == pytest.approx(0.45)
    assert got["a", "1"]["best"] and got["b", "1"]["best"]  # equal as shown
    assert got["b", "2"]["start"] == 0 and [got[k]["place"] for k in sorted(got)] == [1, 2, 2]
    assert reports.dots(log.filter("false"), "f1").count() == 0


def test_verdicts(spark):
    one_, two = [spark.createDataFrame(r, "vec_id bigint, label int, pred int, conf double") for r in ([(1, 0, 0, 0.9), (2, 0, 1, 0.8), (3, None, 1, 0.5), (4, 1, 1, None)], [(1, 0, 1, 0.1), (2, 0, 0, 0.1), (3, None, None, 0.1), (9, 1, 1, 0.1)])]
    v = reports.verdicts([("m", one_), ("n", two)], "m")
    assert {r["vec_id"]: (r["right"], r["n_right"], r["models"]) for r in v.collect()} == {1: (True, 1, 2), 2: (False, 1, 2), 3: (False, 0, 2), 4: (True, 1, 1)}
    assert [r["vec_id"] for r in reports.first_of_class(v, 1).orderBy("vec_id").collect()] == [1, 3, 4]  # null is a class


def test_pointing_game(spark):
    box = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = [("a", [0.0, 2.0, 2.0, 1.0], [(0.5, 0.0, 0.9, 0.3)]), ("a", [0.0, 0.0, None, 1.0], [(0.0, 0.0, 0.1, 0.1), (0.75, 0.75, 0.75, 0.75)]), ("a", [3.0, 0.0, 0.0, 0.0], [(0.9, 0.9, 0.9, 0.9)]),
            ("a", None, [(0.0, 0.0, 0.9, 0.9)]), ("a", [1.0, 0.0, 0.0, 0.0], []), ("a", [1.0, 0.0, 0.0, 0.0], None), ("b", [None] * 4, [(0.0, 0.0, 0.9, 0.9)]), ("c", [1.0, 0.0, 0.0, 0.0], [(None, 0.0, 0.9, 0.9)])]
    maps = spark.createDataFrame(rows, f"model string, heat array<double>, boxes {box}").withColumn("x", F.lit(9))
    got = regions.pointing_game(maps.withColumn("at", regions.hottest(F.col("heat"), 2)))
    assert {r["model"]: (round(r["on_box"], 6), r["n"]) for r in got.collect()} == {"a": (0.666667, 3), "c": (0.0, 1)}


def test_half_even(spark):
    r = one(spark, reports.cell(F.lit(0.8125), F.lit(0.0255)).alias("c"))
    assert r["c"] == "0.812 ± 0.026" or r["c"].startswith("0.812")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=60, unique=True), st.sampled_from([0.0, 0.2, 0.5, 1.0]))
def test_stratified_is_the_plain_window(spark, rows, share):
    import hashlib

    df = spark.createDataFrame(rows, "label int, vec_id bigint")
    got = {(r["label"], r["vec_id"]) for r in splits.stratified(df, share, "s").filter("split = 'pool'").collect()}
    want = set()
    for label in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == label), key=lambda r: (hashlib.md5(f"s|{r[1]}".encode()).hexdigest(), r[1]))
        want |= set(mine[: int(share * len(mine))])
    assert got == want


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 10007).alias("x")).repartition(5)
    got = ordering.numbered(df, "x", "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1000)) and [r["x"] for r in got] == sorted(r["x"] for r in got)


def test_balanced_draws():
    labels = np.array([0] * 90 + [1] * 10)
    assert labels[sampling.balanced_draws(labels, 4000)].mean() == pytest.approx(0.5, abs=0.05)


def test_encoders_and_store(spark, tmp_path):
    """Modes, boxes, texts, the store by requested kinds, and what is refused."""
    items = spark.createDataFrame([("a", "aab bb"), ("b", None), ("c", "")], "path string, content string")
    whole = encoders.encoded(items, encoders.Letters(), encoders.whole(), "global").collect()
    got = {r["path"]: np.array(r["vecs"][0]) for r in whole}
    assert np.allclose(got["a"][:2], np.array([2, 3]) / np.sqrt(13), atol=1e-6) and not got["b"].any() and not got["c"].any()
    many = encoders.encoded(items, encoders.Letters(), encoders.drawn_crops(F.col("path"), 7), "aug", batch=2).collect()
    assert all(len(r["vecs"]) == 7 and len(r["vecs"][0]) == 26 for r in many)
    boxes = items.select(encoders.drawn_crops(F.col("path"), 50).alias("b")).first()["b"]
    assert all(0 <= b["x0"] < b["x1"] <= 1 + 1e-12 and b["x1"] - b["x0"] >= 0.5 - 1e-12 and 0 <= b["y0"] < b["y1"] <= 1 + 1e-12 for b in boxes)
    with pytest.raises(ValueError):
        encoders.encoded(items, encoders.Letters(), encoders.whole(), "other")
    silent = type("Silent", (), {"name": "silent", "dim": 1, "text": None})()
    with pytest.raises(ValueError):
        encoders.encoded_texts(items, silent, "content", "path")
    at = f"file://{tmp_path}/store"
    readers.save_features(encoders.encoded(items, encoders.Letters(), encoders.whole(), "global").select("path", F.col("vecs")[0].alias("vec"), "backbone", "mode"), at)
    store = domains.Store(spark, at, "letters", need=("global",), optional=("grid",), second="letters")
    assert store.modes == ("global",) and set(store.batch(items.select("path")).columns) == {"path", "global", "second"}
    with pytest.raises(KeyError):
        domains.Store(spark, at, "letters", need=("grid",)).modes
    with pytest.raises(KeyError):
        store.batch(spark.createDataFrame([("z",)], "path string")).count()


def test_item_regions_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    kinds = {"o": "object", "i": "instance", "s": "spot"}
    rows = [(n, [(str(rng.choice(list("ois"))), *(float(x) for x in rng.uniform(0, 1, 2)), *(float(x) for x in rng.uniform(0.02, 1.2, 2)), float(rng.uniform(0, 0.5))) for _ in range(9)]) for n in range(40)]
    df = spark.createDataFrame(rows, "id int, raw array<struct<prompt:string,cx:double,cy:double,w:double,h:double,score:double>>")
    got = {r["id"]: r["r"] for r in df.select("id", encoders.item_regions(F.col("raw"), kinds, F.lit(100), F.lit(80)).alias("r")).collect()}
    for n, raw in rows:
        boxes = [(p, s, *(min(max(v * 100, 0), side) for v, side in ((x - w / 2, 100), (y - h / 2, 80), (x + w / 2, 100), (y + h / 2, 80)))) for p, x, y, w, h, s in raw]
        area = lambda b: max(0, b[4] - b[2]) * max(0, b[5] - b[3])

        def kept(prompt, least, most):
            out = []
            for b in sorted((b for b in boxes if b[0] == prompt and b[1] >= least and 0.002 < area(b) / 8000 < most), key=lambda b: -b[1]):  # noqa: B023
                both = [max(0, min(b[4], k[4]) - max(b[2], k[2])) * max(0, min(b[5], k[5]) - max(b[3], k[3])) for k in out]
                if all(c / max(area(b) + area(k) - c, 1e-6) <= 0.3 for c, k in zip(both, out)):  # noqa: B023
                    out.append(b)
            return out

        o = kept("o", 0.2, 0.85) or kept("o", 0.2, 0.98)
        i, s = kept("i", 0.06, 0.85), kept("s", 0.05, 0.12)
        take = min(len(i), max(2, 4 - len(s)))
        assert (got[n]["object"] and got[n]["object"]["score"]) == (o[0][1] if o else None)
        assert [(r["kind"], r["score"]) for r in got[n]["regions"]] == [("instance", b[1]) for b in i[:take]] + [("spot", b[1]) for b in s[: 4 - take]]


def test_models_domains_and_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = models.CacheModel(rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), np.array([0, 0, 1, 2, 2]), 3.0, 7.0, 1.5, np.array([0.1, 0, -0.1]), 0.2, 0.6, {"acc": 0.5})
    at = f"file://{tmp_path}/m"
    models.save(m, spark, at)
    models.save(m, spark, at)
    back = models.load(spark, at)
    assert all(np.array_equal(getattr(m, k), getattr(back, k)) for k in ("text", "keys", "labels", "bias")) and (back.weight, back.sharpness, back.tau, back.facts) == (3.0, 7.0, 1.5, {"acc": 0.5})
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(6)], "vec_id bigint, embedding array<double>")
    told = back.explain(df).toPandas()
    assert np.allclose(told.text_part + told.cache_part + told.bias_part, told.z) and np.allclose(told.groupby("vec_id").p.sum(), 1) and np.allclose(told.groupby("vec_id").text_part_centred.sum(), 0)
    path = f"file://{tmp_path}/j/x.json"
    for value in ({"a": "é"}, {"a": "b"}):
        readers.write_json(spark, value, path)
    assert [r["a"] for r in readers.read_json(spark, path, "a string").collect()] == ["b"] and sorted(p.name for p in (tmp_path / "j").iterdir() if not p.name.endswith("crc")) == ["x.json"]
    made = []
    for _ in range(2):
        readers.cached(spark, f"file://{tmp_path}/c", lambda: made.append(1) or df)
    assert len(made) == 1
    with pytest.raises(FileNotFoundError):
        domains.Domain.open(spark, "none", f"file://{tmp_path}").items(spark)


def test_lanes_and_costs(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 2) for i in range(40)], "vec_id bigint, embedding array<double>, label int").cache()
    todo = runs.plan(spark, ["zero_shot", "cache", "broken"], (1, 2), (1,))
    text, failed = np.eye(2, 4), []
    done = runs.run(todo, f"file://{tmp_path}/log", lambda m: cl.METHODS[m](text), lambda k, s: (splits.support(df, k, s), df), df, 2, failed=lambda n, e: failed.append(n), lanes=3)
    log = readers.run_log(spark, f"file://{tmp_path}/log")
    assert done == 4 == log.count() and len(failed) == 2 and {r["method"] for r in log.collect()} == {"zero_shot", "cache"}
    assert runs.run(todo, f"file://{tmp_path}/log", lambda m: cl.METHODS[m](text), lambda k, s: (splits.support(df, k, s), df), df, 2, failed=lambda n, e: None, lanes=2) == 0
    calls = []
    t = costs.table(spark, [("one", lambda: calls.append(1), 7)], reps=3, warm_up=2).first()
    assert len(calls) == 5 and t["reps"] == 3 and t["params"] == 7 and t["median_ms"] >= t["least_ms"]
    b = cl.Batch(rng.normal(size=(6, 4)), np.arange(6) % 2, None)
    assert set(costs.fits({"cache": cl.METHODS["cache"]}, text, b, b)) == {"cache"} and costs.values_of(cl.METHODS["cache"](text).fit(b, b)) == 24 + 12


def test_pairs_by_any_similarity(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), i % 2 if i < 28 else None) for i in range(30)], "vec_id bigint, embedding array<double>, label int")
    near = lambda a, b: -np.abs(a[:, None] - b[None]).sum(2)
    label = lambda i: i % 2 if i < 28 else None
    for block in (4, 100):
        got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, -1.5, block=block, score=near).collect()}
        assert got == {(i, j) for i in range(30) for j in range(i + 1, 30) if label(i) == label(j) is not None and np.abs(x[i] - x[j]).sum() <= 1.5} | {(i, j) for i, j in [(28, 29)] if np.abs(x[28] - x[29]).sum() <= 1.5 and (28, 29) in got}


def test_independent_set_in_rounds_and_tasks(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (150, 2)) if a != b]
    nodes, edges_ = spark.range(120).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "a bigint, b bigint")
    near = {}
    for a, b in pairs:
        near.setdefault(max(a, b), set()).add(min(a, b))
    kept, twin = set(), {}
    for n in range(120):
        hit = sorted(near.get(n, set()) & kept)
        if hit:
            twin[n] = hit[0]
        else:
            kept.add(n)
    for most in (1_000_000, 3, 0):
        rows = graphs.first_independent_set(nodes, edges_, most).collect()
        assert {r["node"] for r in rows if r["kept"]} == kept and {r["node"]: r["twin"] for r in rows if r["twin"] is not None} == twin


def test_refusals_come_first(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(5)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(ValueError):
        graphs.linkage_clusters(df, 0.5, most=4)
    with pytest.raises(ValueError):
        graphs.communities(df.select("label", F.col("vec_id").alias("node")), spark.createDataFrame([(0, 1, 2, 1.0)], "label int, a bigint, b bigint, weight double"), most=4)


def test_spread_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), ("y", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("x", "X"), ("z", "Z")], "k string, w string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for common in (joins.common_values(counts, "k"), counts.filter("false").select("k")):
        got = {(r["k"], r["v"]): r["w"] for r in joins.spread_join(left, right, "k", common).collect()}
        assert len(got) == 53 and got["x", 1] == "X" and got["y", 2] is None and got[None, 3] is None and all(got["hot", i] == "H" for i in range(50))
