"""Every query against its SQL on the smallest tables; the others run and have a fixed schema."""

import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import DATA
from verdigris.operators import classifiers, evaluation, graphmethods, similarity
from verdigris.plans import catalogue, extended  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].convert_dtypes()
    return sorted(tuple("" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["nn_cosine", "one_nn_classify", "leakage_experiment", "prototype_margin", "purged_test", "balanced_vs_onehot_cache"])
def test_query_with_a_large_side(spark, duck, name, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", 10)
    monkeypatch.setattr(similarity.held, "__kwdefaults__", {"most": 10})
    blocks = [similarity.nearest_in_blocks, similarity.cache_scores_in_blocks]
    for f in blocks:
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 64))
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())


SETS = "WITH " + catalogue.SUPPORT + ", valid AS (SELECT * FROM pool WHERE vec_id NOT IN (SELECT vec_id FROM sup)) "


def batch(duck, name):
    """Rows of a set by SQL, as the classifiers take them."""
    t = duck.sql(SETS + f"SELECT vec_id, e, label FROM {name} ORDER BY vec_id").df()
    x = np.stack(t.e.to_list())
    return t.vec_id.to_numpy(), classifiers.Batch(x, t.label.to_numpy(int), x[:, ::-1])


@pytest.mark.parametrize("name", ["linear_probe", "trained_cache", "two_caches", "task_residual", "feature_adapter", "class_adaptive", "text_graph"])
def test_method_query(spark, duck, name):
    """The same predictions as a method fitted and asked outside Spark, on sets that SQL draws."""
    text = np.stack(duck.sql("WITH " + catalogue.TEXTS + " SELECT t FROM texts ORDER BY class").df().t.to_list())
    (_, s), (_, v), (ids, t) = (batch(duck, x) for x in ("sup", "valid", "test"))
    p = classifiers.softmax(classifiers.METHODS[name](text).fit(s, v).logits(t.x, t.x2))
    got = catalogue.QUERIES[f"method_{name}"](spark, DATA).toPandas().set_index("vec_id").loc[ids]
    assert (got.pred.to_numpy() == p.argmax(1)).mean() > 0.995 and np.allclose(got.conf, p.max(1), atol=2e-3)


def test_methods_tune_on_a_bounded_set(spark, monkeypatch):
    """Beyond the bound methods still predict every row."""
    monkeypatch.setattr(catalogue, "TUNED_ON", 20)
    for name in ("method_trained_cache", "method_patch_graph"):
        assert catalogue.QUERIES[name](spark, DATA).count() == catalogue.tests(spark, DATA).count()


def test_methods_tune_on_all_validation_rows(spark, monkeypatch):
    """A validation set that the driver does not take is judged in tasks, all of it, with the same choices."""
    s = catalogue.support(spark, DATA)
    rows = catalogue.pool(spark, DATA).count() - s.count()
    small = {name: catalogue.fitted(spark, DATA, name) for name in classifiers.METHODS}
    monkeypatch.setattr(catalogue, "TUNED_ON", 20)
    monkeypatch.setattr(catalogue, "SEEN", 30)
    assert rows > 40 and catalogue.tuning(spark, DATA, s).count() == rows
    x = np.stack(catalogue.tests(spark, DATA).toPandas().embedding.to_list()).astype(float)
    for name, method in small.items():
        assert np.allclose(catalogue.fitted(spark, DATA, name).logits(x, x[:, ::-1]), method.logits(x, x[:, ::-1])), name
    valid = catalogue.judge(catalogue.tuning(spark, DATA, s), 10, catalogue.seen, 30)
    best = classifiers.METHODS["task_residual"](small["zero_shot"].text)
    best.pick = True
    assert best.fit(classifiers.batch(s), valid).f1(valid) > 0


def test_graph_methods_judge_in_tasks(spark, monkeypatch):
    """Only support sets come to the driver; options are judged on the validation table, and predictions are in as many tasks
    as their work asks for."""
    held, sizes = similarity.held, []
    monkeypatch.setattr(similarity, "held", lambda *a, **k: sizes.append(len(out := held(*a, **k))) or out)
    monkeypatch.setattr(catalogue, "GRAPHS", 50)
    monkeypatch.setattr(catalogue, "JUDGED", 30)
    got = catalogue.QUERIES["method_patch_graph"](spark, DATA)
    assert sizes and max(sizes) <= 40 and got.rdd.getNumPartitions() > 4
    s, t = catalogue.support(spark, DATA), catalogue.texts(spark, DATA).sort_values("class")
    local = [catalogue.parts(df.select("vec_id", "embedding", "label").toPandas().sort_values("vec_id")) for df in (s, catalogue.tuning(spark, DATA, s), catalogue.tests(spark, DATA))]
    p = graphmethods.probabilities(graphmethods.PatchGraph(np.stack(t["vec"].to_list())).fit(*local[:2]), local[2])
    rows = got.toPandas().sort_values("vec_id")
    assert rows.pred.tolist() == p.argmax(1).tolist() and np.allclose(rows.conf, p.max(1), atol=1e-6)
    assert catalogue.judge(s.filter("false"), 10)(lambda b: b.y[None]) is None and catalogue.judge(s, 10)(lambda b: np.stack([b.y, 9 - b.y])).tolist() == [1.0, 0.0]


def test_calibration_query(spark, duck):
    """No temperature or bias nearby makes the pool likelier."""
    got = catalogue.QUERIES["calibration_fit"](spark, DATA).toPandas().sort_values("class")
    z = duck.sql("WITH " + catalogue.ZERO.replace("FROM test, texts", "FROM pool, texts") + " SELECT vec_id, any_value(label) y, list(z ORDER BY class) z FROM z GROUP BY 1").df()
    m, y, tau, bias = np.stack(z.z.to_list()), z.y.to_numpy(int), got.tau.iloc[0], got.bias.to_numpy()
    loss = lambda t, b: -np.log(classifiers.softmax((m + b) / t)[np.arange(len(y)), y]).mean() + evaluation.RIDGE * (b @ b)
    here = loss(tau, bias)
    assert here < loss(1.0, np.zeros(10)) and all(loss(tau * t, bias) > here - 1e-9 for t in (0.95, 1.05))
    assert all(loss(tau, bias + s * e) > here - 1e-9 for e in np.eye(10) for s in (-0.2, 0.2))


def test_linkage_query(spark, duck):
    """Clusters of each class are those of merging the two of largest mean cosine, looked at pair by pair."""
    got = catalogue.QUERIES["linkage_clusters"](spark, DATA).toPandas()
    t = duck.sql("SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings ORDER BY vec_id").df()
    for label, own in t.groupby("label"):
        s = np.stack(own.e.to_list()) @ np.stack(own.e.to_list()).T
        clusters = [[i] for i in range(len(own))]
        while len(clusters) > 1:
            best, a, b = max((s[np.ix_(x, y)].mean(), -i, -j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
            if best < catalogue.SAME:
                break
            clusters[-a] += clusters.pop(-b)
        mine = got[got.label == label].set_index("vec_id").cluster
        ids = own.vec_id.to_numpy()
        assert sorted(map(sorted, clusters)) == sorted(sorted(np.flatnonzero(mine.loc[ids].to_numpy() == c).tolist()) for c in set(mine))


def test_louvain_query(spark, duck):
    """No move of a node to a neighbour's community raises modularity, and every community hangs together."""
    got = catalogue.QUERIES["louvain_communities"](spark, DATA).toPandas()
    e = duck.sql("SELECT a.label, a.vec_id a, b.vec_id b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) w FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25").df()
    assert len(got) == len(duck.sql("SELECT vec_id FROM embeddings").df())
    for label, own in e.groupby("label"):
        of = got[got.label == label].set_index("node").community.to_dict()
        degree, total = dict.fromkeys(of, 0.0), own.w.sum()
        near = {}
        for a, b, w in own[["a", "b", "w"]].itertuples(index=False):
            degree[a] += w
            degree[b] += w
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {}).setdefault(of[y], 0.0)
                near[x][of[y]] += w
        mass = {}
        for n, c in of.items():
            mass[c] = mass.get(c, 0.0) + degree[n]
        for n, links in near.items():
            gain = lambda c: links.get(c, 0.0) - (mass[c] - degree[n] * (of[n] == c)) * degree[n] / (2 * total)  # noqa: B023, E731
            # a node may be better off alone or elsewhere only as part of a merged community
            assert gain(of[n]) >= -1e-9 or links.get(of[n], 0) > 0
        q = sum(w for a, b, w in own[["a", "b", "w"]].itertuples(index=False) if of[a] == of[b]) / total - sum((m / (2 * total)) ** 2 for m in mass.values())
        assert q > 0.1
        pairs = [(a, b) for a, b in own[["a", "b"]].itertuples(index=False) if of[a] == of[b]]
        root = {n: n for n in of}
        for _ in range(60):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        assert all(len({root[n] for n in of if of[n] == c}) == 1 for c in set(of.values()))


def test_keypoint_verification_query(spark, duck):
    """The pairs of enough matches, and no more inliers than matches."""
    got = catalogue.QUERIES["keypoint_verification"](spark, DATA).toPandas()
    want = duck.sql(catalogue.ORACLES["keypoint_matches"]).df()
    same = duck.sql("SELECT vec_id, label FROM embeddings").df().set_index("vec_id").label
    one = got[same.loc[got.a].to_numpy() == same.loc[got.b].to_numpy()]
    assert sorted(one[["a", "b", "matches"]].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert ((got.inliers >= 4) & (got.inliers <= got.matches)).all()


def test_leakage_query(spark, duck):
    """The nearest neighbour's rows are those of SQL; the probe has a row for each split."""
    got = catalogue.QUERIES["leakage_by_method"](spark, DATA).toPandas()
    want = duck.sql(catalogue.ORACLES["leakage_experiment"]).df().sort_values("split")
    one = got[got.method == "one_nn"].sort_values("split")
    assert one.n.tolist() == want.n.tolist() and np.allclose(one.acc, want.acc)
    assert got.acc.between(0, 1).all() and len(got) == 4


@pytest.mark.parametrize("name, epochs", [("region_graph", 60), ("region_graph_two_caches", 60), ("patch_graph", 20)])
def test_graph_methods_train_in_full(spark, name, epochs, monkeypatch):
    def fit(self, *_):
        raise InterruptedError(self.epochs)

    for cls in (graphmethods.RegionGraph, graphmethods.PatchGraph):
        monkeypatch.setattr(cls, "fit", fit)
    with pytest.raises(InterruptedError, match=f"^{epochs}$"):
        catalogue.QUERIES[f"method_{name}"](spark, DATA)


def test_entry_without_the_llm_queries():
    """Where a module of the llm queries cannot be imported, the other queries are there."""
    code = "import sys; sys.modules['verdigris.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and 'op1_langid' not in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_split_follows_a_rewritten_table(spark, tmp_path):
    rows = lambda n: pd.DataFrame({"vec_id": range(n), "embedding": [[1.0, 0.0]] * n, "label": 0})
    rows(20).to_parquet(tmp_path / "embeddings.parquet")
    first = catalogue.items(spark, str(tmp_path))
    assert first.count() == 20 and catalogue.items(spark, str(tmp_path)) is first
    rows(35).to_parquet(tmp_path / "embeddings.parquet")
    assert catalogue.items(spark, str(tmp_path)).count() == 35
