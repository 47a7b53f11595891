"""What spreads over all tasks: forests of links, hash tables, running sums, quantiles, rank sums, probes, linkage."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from verdigris.functions import vec
from verdigris.operators import communities, evaluation, graphs, linkage, ordering, probe, regions, reports, similarity, splits
from verdigris.plans import catalogue
from verdigris.sources import readers

ITEMS = "vec_id bigint, embedding array<double>, label int"


def items(spark, x, label=lambda i: i % 3):
    return spark.createDataFrame([(i, [float(a) for a in v], label(i)) for i, v in enumerate(x)], ITEMS).repartition(4)


def clustered(rng, groups, rows, spread, dim=64):
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, rows)] + spread * rng.normal(size=(rows, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def roots(edges):
    return sorted(map(tuple, graphs.components(edges).collect()))


# ---- forests
def test_spanning_and_bridging_links():
    rng = np.random.default_rng(0)
    for density in (0.0, 0.02, 0.1, 1.0):
        hit = rng.random((50, 50)) < density
        hit |= hit.T
        links, label = similarity.spanning(hit)
        groups = len(set(label))
        assert len(links) == 50 - groups and all(hit[i, j] and label[i] == label[j] for i, j in links)
        assert all(label[i] == label[j] for i, j in zip(*np.nonzero(hit)))
        across = rng.random((50, 30)) < density
        right = np.arange(30) // 3
        got = similarity.bridging(across, label, right)
        names = {("l", x) for x in label} | {("r", x) for x in right}
        group = {x: x for x in names}
        for pairs, count in ((got, True), (np.argwhere(across), False)):
            for i, j in pairs:
                a, b = group[("l", label[i])], group[("r", right[j])]
                assert across[i, j] and (a != b) >= count
                group = {k: a if v == b else v for k, v in group.items()}
                assert count or a == b  # nothing that the links have not joined


def test_forest_of_thousands_of_copies(spark):
    """5,000 copies over two blocks make fewer than two rows a member, and the components of all pairs."""
    v = [1.0] + [0.0] * 7
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, v)).alias("embedding"), F.lit(0).alias("label"))
    links = graphs.written(similarity.similar_pairs(df, 0.9, block=2500, forest=True))
    assert links.count() < 10_000 and {r[1] for r in roots(links)} == {0} and len(roots(links)) == 5000
    hashed = graphs.written(similarity.hashed_pairs(df, 0.9, forest=True))
    assert hashed.count() < 10_000 and len(roots(hashed)) == 5000


def test_forest_multiplies_each_pair_of_rows_once(monkeypatch):
    """Two blocks are multiplied with each other and not with themselves again, and still give few links."""
    seen, hits = [], similarity._hits
    monkeypatch.setattr(similarity, "_hits", lambda x, y, *a: seen.append((len(x), len(y))) or hits(x, y, *a))
    rng = np.random.default_rng(2)
    v = np.repeat(clustered(rng, 5, 5, 0.0), 60, 0)[rng.permutation(300)]
    left, right = (similarity.Rows(np.arange(a, z), v[a:z], np.zeros(z - a, int)) for a, z in ((0, 180), (180, 300)))
    for score in (None, lambda x, y: x @ y.T):
        links = [b for b in similarity._links(left, right, False, 0.9, None, score, True)]
        assert sum(b.num_rows for b in links) == len(np.unique(v.round(9), axis=0))
    assert seen == [(180, 120)] * 2
    assert not list(similarity._links(left[:0], right, False, 0.9, None, None, True))


@pytest.mark.parametrize("other", [None, 0.45])
def test_forest_has_the_components_of_all_pairs(spark, other):
    df = items(spark, clustered(np.random.default_rng(5), 60, 500, 0.9))
    full, few = (graphs.written(similarity.similar_pairs(df, 0.5, other, block=64, forest=f)) for f in (False, True))
    assert roots(full) == roots(few) and few.count() < min(full.count(), 500 + 36 * 64)
    assert few.join(full, ["a", "b"], "left_anti").isEmpty()


# ---- hash tables
def test_planned_tables_reach_the_recall_asked_for():
    rng = np.random.default_rng(9)
    for least, recall in ((0.8, 0.95), (0.9, 0.99)):
        t = similarity.Tables.plan(20_000, 48, least, recall)
        x = np.linalg.qr(rng.normal(size=(3000, 48, 2)))[0]
        a, b = x[:, :, 0], least * x[:, :, 0] + np.sqrt(1 - least**2) * x[:, :, 1]
        met = (t.codes(a)[1] == t.codes(b)[0][:, :, None]).any((1, 2)) | (t.codes(b)[1] == t.codes(a)[0][:, :, None]).any((1, 2))
        assert met.mean() >= recall - 0.01
    assert similarity.Tables.plan(10**6, 48, 0.95, 0.9).tables < similarity.Tables.plan(10**6, 48, 0.8, 0.9).tables


@pytest.mark.parametrize("block", [4096, 50])
def test_hashed_pairs_of_clusters(spark, block):
    """Nearly all pairs of clustered vectors, none that is not one, in whole buckets and in block pairs."""
    x = clustered(np.random.default_rng(1), 150, 1500, 0.35)
    x[100:130] = x[5]
    df = items(spark, x)
    for same, other in ((0.85, None), (0.85, 0.9)):
        want = {(r.a, r.b): (round(r.cos, 9), r.same_class) for r in similarity.similar_pairs(df, same, other).collect()}
        rows = similarity.hashed_pairs(df, same, other, block=block).collect()
        got = {(r.a, r.b): (round(r.cos, 9), r.same_class) for r in rows}
        assert len(rows) == len(got) and all(want[k] == v for k, v in got.items()) and len(got) >= 0.999 * len(want)
        assert roots(similarity.hashed_pairs(df, same, other, block=block, forest=True)) == roots(similarity.similar_pairs(df, same, other))


def test_hashed_rows_grow_with_the_rows():
    """Rows that are shuffled: rows times tables times (1 + flips), a few tables more as the bits grow with the logarithm."""
    few, many = (similarity.Tables.plan(n, 64, 0.9, 0.99) for n in (10**5, 10**7))
    assert many.tables <= 4 * few.tables and many.flips == few.flips


def test_hashed_pairs_odd(spark):
    df = spark.createDataFrame([(1, None, 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [1.0, 0.0], None), (5, [0.0, 1.0], 2), (6, [0.0, 1.0], 1)], ITEMS)
    assert [tuple(r) for r in similarity.hashed_pairs(df, 0.9).collect()] == [(3, 4, 1.0, True)]
    assert {(r.a, r.b, r.same_class) for r in similarity.hashed_pairs(df, 0.9, 0.9).collect()} == {(3, 4, True), (5, 6, False)}
    assert similarity.hashed_pairs(df.limit(0), 0.9).collect() == [] and similarity.hashed_pairs(df.filter("vec_id = 5"), 0.9).collect() == []


# ---- orders
def test_running_sums_and_previous_values(spark):
    rng = np.random.default_rng(2)
    t = pd.DataFrame({"k": rng.integers(0, 5, 400), "o": rng.permutation(400), "v": rng.integers(-9, 9, 400).astype(float)})
    t.loc[t.index % 7 == 0, "v"] = np.nan
    df = spark.createDataFrame([(int(k), int(o), None if np.isnan(v) else int(v)) for k, o, v in t.itertuples(index=False)], "k bigint, o bigint, v bigint").repartition(6)
    got = ordering.running(df, ["o"], {"before": "v"}).toPandas().sort_values("o")
    assert (got.before.to_numpy() == np.r_[0, t.sort_values("o").v.fillna(0).cumsum().to_numpy()[:-1]]).all()
    got = ordering.previous(df, "k", "o", "v", "last").toPandas().sort_values("o").reset_index(drop=True)
    want = t.sort_values("o").groupby("k").v.shift().to_numpy()
    assert all((pd.isna(a) and np.isnan(b)) or a == b for a, b in zip(got["last"], want))
    assert ordering.running(df.limit(0), ["o"], {"before": "v"}).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else i % 3, None if i % 13 == 0 else float(np.round(rng.normal(), 1))) for i in range(900)] + [(9, 4.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    at = [0.0, 0.1, 0.5, 0.99, 1.0]
    want = df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", at).alias("q")).filter("n > 0").collect()
    got = {r.g: r for r in ordering.quantiles(df, "v", at, ["g"]).collect()}
    assert len(got) == len(want) and all(got[r.g].n == r.n and np.allclose([got[r.g][f"q{i}"] for i in range(5)], r.q) for r in want)
    one = ordering.quantiles(df, "v", at).first()
    assert np.allclose([one[f"q{i}"] for i in range(5)], df.agg(F.percentile("v", at)).first()[0]) and one.n == df.agg(F.count("v")).first()[0]
    none = ordering.quantiles(df.filter("v is null"), "v", [0.5]).collect()
    assert [tuple(r) for r in none] == [(0, None)]
    assert reports.described(df.filter("v is null"), "v").first()["q50"] is None


def test_rank_sums_by_class(spark):
    """AUROC of scores that are nearly all distinct, and of ties, against all pairs; a class is in several ranges."""
    rng = np.random.default_rng(4)
    for digits in (1, 8):
        y, z = rng.integers(0, 3, 250), np.round(rng.normal(size=(250, 4)), digits)
        df = spark.createDataFrame([(int(y[i]), c, float(z[i, c])) for i in range(250) for c in range(4)], "label int, class int, z double").repartition(6)
        got = {r["class"]: r["auroc"] for r in evaluation.auroc(df).collect()}
        for c in range(3):
            a, b = z[y == c, c], z[y != c, c]
            assert got[c] == pytest.approx(((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2))
        assert got[3] is None


# ---- probe
def test_probe_is_the_fit_of_arrays(spark):
    """The weights of a fit in memory within 1e-6, whatever the partitions; its gradient is zero there."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    y = (x @ rng.normal(size=(8, 3)) + rng.normal(size=(400, 3))).argmax(1)
    df = items(spark, x, lambda i: int(y[i])).repartition(7)
    odd = df.union(spark.createDataFrame([(900, None, 1), (901, [1.0] * 8, None)], ITEMS))
    for c in (0.5, 20.0):
        got = probe.fit(odd, 3, c)
        full = probe.penalised(lambda w: (*probe.sums(x, y, w), len(x)), c)  # noqa: B023
        assert np.abs(full(got)[1]).max() < 1e-7
        assert np.abs(got - probe.minimum(full, np.zeros((3, 9)))).max() < 1e-6
        value = full(got)[0]
        assert all(full(got + 1e-3 * rng.normal(size=got.shape))[0] > value for _ in range(20))
    step = 1e-6 * rng.normal(size=(3, 9))
    assert probe.sums(x, y, got + step)[0] - probe.sums(x, y, got - step)[0] == pytest.approx(2 * (probe.sums(x, y, got)[1] * step).sum(), rel=1e-4)
    p = {r.vec_id: r.pred for r in probe.predict(odd, got).collect()}
    assert len(p) == 401 and np.mean([p[i] == y[i] for i in range(400)]) > 0.7
    assert probe.fit(df.limit(0), 3).shape == (3, 1)


def test_whole_pool_probe_query(spark):
    """The rows of the query are those of a fit of the same rows in memory, with the best penalty on the held-out fifth."""
    got = catalogue.QUERIES["probe_whole_pool"](spark, DATA).toPandas().set_index("vec_id")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    draw = "WITH " + catalogue.ITEMS + ", q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 'probe', vec_id::VARCHAR)), vec_id) <= floor(0.8e0 * count(*) OVER (PARTITION BY label)) fit FROM pool) "
    side = lambda sql: (lambda t: (t.vec_id.to_numpy(), np.stack(t.e.to_list()), t.label.to_numpy(int)))(c.sql(draw + sql).df())
    (_, x, y), (_, u, v), (ids, t, _) = side("SELECT vec_id, e, label FROM q WHERE fit"), side("SELECT vec_id, e, label FROM q WHERE NOT fit"), side("SELECT vec_id, e, label FROM test")
    best, w = None, np.zeros((10, x.shape[1] + 1))
    for penalty in probe.GRID:
        w = probe.minimum(probe.penalised(lambda a: (*probe.sums(x, y, a), len(x)), penalty), w)
        pred = (u @ w[:, :-1].T + w[:, -1]).argmax(1)
        score = np.mean([2 * ((pred == k) & (v == k)).sum() / max(1, (pred == k).sum() + (v == k).sum()) for k in range(10)])
        if best is None or score > best[0] + 1e-12:
            best = (score, w, penalty)
    z = t @ best[1][:, :-1].T + best[1][:, -1]
    assert set(got.c) == {best[2]} and (got.loc[ids].pred.to_numpy() == z.argmax(1)).mean() > 0.995


# ---- linkage
@pytest.mark.parametrize("block", [4096, 40])
def test_linkage_in_rounds_is_average_linkage(spark, block):
    """The clusters of the chain, class by class, with ties and copies, in one block and many."""
    x = clustered(np.random.default_rng(8), 25, 420, 0.8, 16)
    x[50:60] = x[3]
    label = lambda i: None if i % 5 == 0 else i % 2
    got = linkage.linkage_in_rounds(items(spark, x, label), 0.4, block=block).toPandas()
    for own in (None, 0, 1):
        ids = [i for i in range(len(x)) if label(i) == own]
        mine = got[got.label.isna()] if own is None else got[got.label == own]
        assert mine.set_index("vec_id").loc[ids].cluster.tolist() == graphs.average_linkage(x[ids], 0.4).tolist()


def test_classes_beyond_a_task_go_in_rounds(spark):
    x = clustered(np.random.default_rng(8), 9, 150, 0.7, 16)
    label = lambda i: int(i < 110)
    rows = lambda df: sorted(map(tuple, df.select("label", "vec_id", "cluster").collect()))
    df = items(spark, x, label)
    assert rows(linkage.clusters(df, 0.4, most=60)) == rows(linkage.clusters(df, 0.4)) == rows(linkage.linkage_in_rounds(df, 0.4))
    assert linkage.linkage_in_rounds(df.limit(0), 0.4).collect() == []


def test_linkage_queries_agree(spark):
    one, two = (catalogue.QUERIES[q](spark, DATA).toPandas().sort_values("vec_id") for q in ("linkage_clusters", "linkage_in_rounds"))
    assert (one[["label", "vec_id", "cluster"]].to_numpy() == two[["label", "vec_id", "cluster"]].to_numpy()).all()


# ---- communities
def modularity(of, edges):
    total, degree, mass = sum(w for *_, w in edges), {}, {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    for n, k in degree.items():
        mass[of[n]] = mass.get(of[n], 0) + k
    return sum(w for a, b, w in edges if of[a] == of[b]) / total - sum((m / (2 * total)) ** 2 for m in mass.values())


def test_communities_in_rounds(spark):
    """As good as one node after the other, within one in a hundred; classes apart, nodes without edges alone, pieces whole."""
    rng = np.random.default_rng(11)
    edges = {}
    for label, (n, inside) in enumerate(((60, 0.5), (90, 0.3))):
        for a in range(n):
            for b in range(a):
                if rng.random() < (inside if a % 5 == b % 5 else 0.03):
                    edges[label * 1000 + b, label * 1000 + a] = float(rng.integers(1, 4))
    rows = [(a // 1000, a, b, w / 2) for (a, b), w in edges.items()] + [(a // 1000, b, a, w / 2) for (a, b), w in edges.items()] + [(0, 5, 5, 9.0)]
    nodes = [(0, i) for i in range(60)] + [(1, 1000 + i) for i in range(90)] + [(None, 5000), (0, 70)]
    n, e = spark.createDataFrame(nodes, "label int, node bigint"), spark.createDataFrame(rows, "label int, a bigint, b bigint, weight double").repartition(3)
    got = communities.communities_in_rounds(n, e).toPandas()
    assert len(got) == len(nodes) and got[got.node == 5000].community.tolist() == [0]
    for label, low, high in ((0, 0, 60), (1, 1000, 1090)):
        own = got[got.label == label].set_index("node").community.to_dict()
        mine = [(a, b, w) for (a, b), w in edges.items() if low <= a < high]
        plain = graphs.louvain(list(range(low, high)), mine)
        assert modularity(own, mine) >= 0.99 * modularity(plain, mine)
        assert sorted(set(own.values())) == list(range(len(set(own.values()))))
        assert list(dict.fromkeys(own[k] for k in sorted(own))) == sorted(set(own.values()))
    large = communities.communities(n, e, most=70).toPandas()
    assert len(large) == len(nodes) and len(large[large.label == 1].community.unique()) < 30


def test_communities_in_blocks(spark):
    """Blocks, rounds of moves and few Spark jobs: 130 nodes whose 2,024 edges no task has at once, within one in a hundred of one task."""
    rng = np.random.default_rng(14)
    edges = [(0, a, b, float(rng.integers(1, 4))) for a in range(130) for b in range(a) if rng.random() < (0.7 if a % 5 == b % 5 else 0.13)]
    plain = graphs.louvain(list(range(130)), [x[1:] for x in edges])
    n, e = spark.createDataFrame([(0, i) for i in range(130)] + [(None, 999)], "label int, node bigint"), spark.createDataFrame(edges, "label int, a bigint, b bigint, weight double")
    for part, most in ((100, 700), (10_000, 60)):
        spark.sparkContext.setJobGroup(f"blocks{part}", "")
        got = communities.communities_in_rounds(n, e, part=part).toPandas()
        own = got[got.label == 0].set_index("node").community.to_dict()
        assert len(got) == 131 and len(own) == 130 and modularity(own, [x[1:] for x in edges]) >= 0.99 * modularity(plain, [x[1:] for x in edges])
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks{part}"))
        print(part, jobs)
        assert jobs <= most
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # degrees in a larger graph: two nodes that hang together by less than chance stay apart
    assert graphs.louvain([0, 1], [(0, 1, 1.0)], [9.0, 9.0], 20.0) == {0: 0, 1: 1} and graphs.louvain([0, 1], [(0, 1, 1.0)]) == {0: 0, 1: 0}


def test_edges_of_a_node_lie_together(spark):
    """In both directions, repeated ones added up, in one shuffle, each node's in one partition."""
    rows = [(a, b, 0.5) for a in range(40) for b in range(40) if a <= b] + [(3, 2, 1.0), (1, 2, -1.0)]
    both = communities._both_ways(spark.createDataFrame(rows, "a bigint, b bigint, weight double").repartition(5))
    got = both.withColumn("part", F.spark_partition_id()).toPandas()
    assert {(r.a, r.b): r.w for r in got.itertuples()} == {(a, b): 1.5 if {a, b} == {2, 3} else 0.5 for a in range(40) for b in range(40) if a != b}
    assert len(got) == 40 * 39 and (got.groupby("a").part.nunique() == 1).all()


# ---- trials, range joins
def test_best_assignment_of_many_groups(spark):
    """More groups and counts than any task holds as a rule, against the sums of whole trials."""
    rng = np.random.default_rng(12)
    rows = [(f"g{int(g)}", int(l)) for g, l in zip(rng.integers(0, 300, 4000), rng.integers(0, 4, 4000))] + [(None, 1), ("g1", None)]
    df = spark.createDataFrame(rows, "grp string, label int").repartition(9)
    got = {r.grp: r for r in splits.best_assignment(df, 0.3, "grp", tries=150).collect()}
    names = sorted({g for g, l in rows if g and l is not None})
    m = np.array([[sum(1 for r in rows if r == (g, c)) for c in range(4)] for g in names], float)
    target, best = m.sum(0) * 0.3, None
    for t in range(150):
        mask = splits.chosen(t, names)
        error = np.abs(mask @ m / target - 1).max()
        if not (mask @ m > target * 1.25).any() and (best is None or error < best[0]):
            best = (error, mask)
    assert [got[g].in_pool for g in names] == best[1].tolist() and got["g1"].error == pytest.approx(best[0])
    assert not any(r.in_pool for r in splits.best_assignment(df, 1e-9, "grp", tries=5).collect())


@pytest.mark.parametrize("dense", [20_000, 7])
def test_points_in_boxes(spark, dense):
    """Boxes of all sizes, points on edges and at one place, negative ones, nulls and numbers that are none."""
    rng = np.random.default_rng(13)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.normal(0, 20, (300, 2)), 1))] + [(1000 + i, 1.0, 1.0) for i in range(60)]
    boxes = []
    for i in range(120):
        x, y, w, h = *np.round(rng.normal(0, 20, 2), 1), *np.round(rng.choice([0.0, 0.1, 1.0, 8.0, 64.0, 900.0], 2) * rng.random(2), 1)
        boxes.append((i, float(x), float(y), float(x + w), float(y + h)))
    boxes += [(500, 1.0, 1.0, 1.0, 1.0), (501, 2.0, 0.0, 1.0, 9.0)]
    odd_points, odd_boxes = [(None, 1.0, 1.0), (9, None, 1.0), (10, float("nan"), 1.0), (11, float("inf"), 1.0)], [(None, 0.0, 0.0, 9.0, 9.0), (600, 0.0, None, 9.0, 9.0), (601, float("nan"), 0.0, 9.0, 9.0), (602, 0.0, 0.0, float("inf"), 9.0)]
    p = spark.createDataFrame(points + odd_points, "point int, x double, y double")
    b = spark.createDataFrame(boxes + odd_boxes, "box int, x0 double, y0 double, x1 double, y1 double")
    want = sorted((i, j) for i, x, y in points for j, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted(map(tuple, regions.points_in_boxes(p, b, dense=dense).collect())) == want and len(want) > 1000
    assert regions.points_in_boxes(p.limit(0), b).collect() == [] and regions.points_in_boxes(p, b.limit(0)).collect() == []


@pytest.mark.parametrize("dense", [8192, 20])
def test_boxes_meet_few_other_points(spark, dense):
    """Of the points that boxes meet about a third lie in them, though they are slim, and the join is dealt to many tasks."""
    rng = np.random.default_rng(3)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 50, (4000, 2)))]
    b = [(i, float(x), float(y), float(x + s / 5), float(y + s)) for i, (x, y, s) in enumerate(zip(*rng.uniform(0, 50, (2, 300)), rng.integers(1, 20, 300)))]
    sides = spark.createDataFrame(p, "point int, x double, y double"), spark.createDataFrame(b, "box int, x0 double, y0 double, x1 double, y1 double")
    want = {(i, j) for i, x, y in p for j, x0, y0, x1, y1 in b if x0 <= x <= x1 and y0 <= y <= y1}
    met, found = regions.meetings(*sides, dense=dense), regions.points_in_boxes(*sides, dense=dense).collect()
    assert set(map(tuple, found)) == want and len(found) == len(want)
    assert met.count() < 4 * len(want) and met.rdd.getNumPartitions() >= 16


def test_boxes_shuffle_few_copies(spark):
    """A point is shuffled once and a box a few times, however many grids boxes of all sizes would need; same pairs."""
    rng = np.random.default_rng(5)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (3000, 2)))]
    b = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(np.c_[rng.uniform(0, 100, (200, 2)), 2.0 ** rng.integers(-4, 4, (200, 2))])]
    sides = spark.createDataFrame(p, "point int, x double, y double"), spark.createDataFrame(b, "box string, x0 double, y0 double, x1 double, y1 double")
    for dense in (32_768, 500):
        met = regions.points_in_boxes(*sides, dense=dense)
        got = sorted((r.point, int(r.box)) for r in met.collect())
        assert got == sorted((i, j) for i, x, y in p for j, x0, y0, x1, y1 in b if x0 <= x <= x1 and y0 <= y <= y1) and len(got) > 100
        assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    # dealt rows: each point once, and of boxes fewer than three copies
    tiles = regions._tiles(sides[0], 2.0, 2.0, 500, 1)
    at, tile = tiles.met(*(np.array([r[k] for r in b]) for k in (1, 2, 3, 4)))
    assert len(tiles.ys) * tiles.high >= 6 and len(at) < 3 * len(b) and len(set(zip(at, tile))) == len(at)


def test_independent_set_of_long_chains(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("early"), (F.col("id") + 1).alias("late"))
    spent = []
    lost = {r["node"]: r["twin"] for r in graphs._in_prefixes(graphs.written(chain), 1000, spent).collect()}
    assert lost == {i: i - 1 for i in range(1, n + 1, 2)} and len(spent) <= 40, spent
    # a node with more earlier neighbours than a task takes, and one that all others lose to
    star = spark.createDataFrame([(i, 500) for i in range(500)] + [(0, i) for i in range(501, 900)] + [(500, 900), (499, 901)], "early bigint, late bigint")
    lost = {r["node"]: r["twin"] for r in graphs._in_prefixes(graphs.written(star), 40).collect()}
    assert lost == {500: 0, **{i: 0 for i in range(501, 900)}, 901: 499}


# ---- products in slices
def test_tables_are_taken_where_they_cost_less():
    """Few copies of a row where all rows are multiplied; hash tables, with fewer copies than before, where that costs more."""
    assert similarity.Tables.cheapest(300_000, 64, 0.8, 0.99999, 8) is None
    many = similarity.Tables.cheapest(20_000_000, 64, 0.9, 0.99, 160)
    assert many.copies < similarity.Tables.plan(20_000_000, 64, 0.9, 0.99).copies / 4


def test_blocks_of_a_self_join_do_not_grow_with_the_rows(spark):
    """A row goes to as many block pairs as there are blocks: the same number from 32,768 rows to a million of 64 numbers."""
    got = spark.createDataFrame([(5,), (5000,), (40_000,), (1_000_000,), (4_000_000,)], "n long").select(similarity.blocks_of(F.col("n"), F.lit(64))).collect()
    assert [r[0] for r in got] == [1, 2, 8, 8, 31]


@pytest.mark.parametrize("forest", [False, True])
def test_tables_given_find_what_all_products_find(spark, forest):
    x = clustered(np.random.default_rng(2), 60, 600, 0.35)
    df, t = items(spark, x), similarity.Tables.plan(600, x.shape[1], 0.85, 0.9999)
    for other in (None, 0.9):
        got, want = (f(df, 0.85, other, forest=forest, **a) for f, a in ((similarity.hashed_pairs, {"tables": t}), (similarity.similar_pairs, {})))
        assert roots(got) == roots(want) and (forest or got.select("a", "b").exceptAll(want.select("a", "b")).isEmpty())


def test_products_are_never_of_a_whole_batch(monkeypatch):
    """Nearest rows, kernel sums and near pairs by slices of few cells are those of one product."""
    rng = np.random.default_rng(3)
    v, m = rng.normal(size=(700, 8)), rng.normal(size=(900, 8))
    m[500] = m[20]
    monkeypatch.setattr(similarity, "CELLS", 1000)
    assert (similarity._best(v, m) == (v @ m.T).argmax(1)).all()
    w = rng.random((900, 3))
    assert np.allclose(similarity._kernel_sums(v, m, 2.0, w), np.exp(-2 * (1 - v @ m.T)) @ w)
    x, y = (similarity.Rows(np.arange(len(a)), a / np.linalg.norm(a, axis=1, keepdims=True), rng.integers(0, 3, len(a))) for a in (v, m))
    y.ids += 10_000
    parts = list(similarity._hits(x, y, 0.5, 0.7, None))
    s, equal = x.v @ y.v.T, x.of[:, None] == y.of[None, :]
    assert {(i, j) for p in parts for i, j in zip(p[0], p[1])} == set(zip(*np.nonzero(np.where(equal, s >= 0.5, s >= 0.7))))


def test_nearest_in_little_memory(spark):
    """A batch of 10,000 rows against 50,000 took 4,000 MB for their product."""
    side = spark.range(50_000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(i) for i in range(4)]).alias("embedding"))
    asked = side.filter("vec_id < 10000").coalesce(1)

    def peak(batches):
        import resource

        for b in batches:
            yield b.assign(mb=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)

    near = similarity.nearest(asked, side)
    assert near.mapInPandas(peak, "vec_id bigint, near_id bigint, cos double, mb bigint").agg({"mb": "max"}).first()[0] < 1500


def test_norm_is_worked_out_once_for_a_vector(spark):
    """Not for every component: 300 vectors of 2,000 numbers took 1.2 billion products."""
    import time

    v = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    began = time.time()
    got = v.select(vec.normalized(F.col("v")).alias("n")).agg(F.avg(vec.dot(F.col("n"), F.col("n")))).first()[0]
    assert abs(got - 1) < 1e-9 and time.time() - began < 20
    assert spark.range(1).select(vec.normalized(F.lit(None).cast("array<double>")).alias("n")).first()["n"] is None


# ---- keypoints, batches, classes
def test_keypoints_of_many_pairs_at_once():
    """The matches pair by pair; of few points each four is solved once, not 500 times."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=2, keepdims=True)
    a, b = unit(rng.normal(size=(50, 8, 8))), unit(rng.normal(size=(50, 6, 8)))
    hit, near = graphs.all_matches(a, b, 0.95)
    assert [[(int(i), int(near[k, i])) for i in np.flatnonzero(hit[k])] for k in range(50)] == [graphs.mutual_matches(x, y, 0.95) for x, y in zip(a, b)]
    assert len(graphs.samples(4, 500, 0)) == 1 and len(graphs.samples(6, 500, 0)) == 15


def test_inliers_of_many_pairs_at_once():
    """Those of one pair at a time: points that fit, some that do not, in line, at one place, far apart and near the border."""
    rng = np.random.default_rng(8)
    for n in (3, 4, 5, 7, 9):
        p, q = rng.normal(size=(2, 60, n, 2))
        q[10:20] = p[10:20] * 2 + 1
        q[20:30, :4] = p[20:30, :4] * 3
        q[20:30, 4:] = 1e4
        p[30:40], q[30:35] = np.round(p[30:40]), np.round(q[30:35])
        p[40:45] = p[40:45, :1]
        p[45:60] *= 40
        q[45:60] *= 40
        assert graphs.all_inliers(p, q).tolist() == [graphs.homography_inliers(x, y) for x, y in zip(p, q)]


@pytest.mark.parametrize("block", [None, 7])
def test_pairs_verified_where_they_are_found(spark, block):
    """Pairs and their matches one by one, items of several numbers of keypoints; no stage shuffles keypoints by pairs."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = [(i, unit(rng.normal(size=4)).tolist(), i % 2, rng.normal(size=(k, 2)).tolist(), unit(rng.normal(size=(k, 3))).tolist()) for i, k in enumerate(rng.choice([0, 1, 5, 6], 40))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, xy array<array<double>>, desc array<array<double>>").repartition(3)
    got = similarity.verified_pairs(df, 0.2, 0.3, least=2, ratio=0.9, block=block)
    want = []
    for a, v, l, xa, da in rows:
        for b, w, m, xb, db in rows[a + 1 :]:
            if np.dot(v, w) >= (0.2 if l == m else 0.3):
                at = graphs.mutual_matches(np.array(da), np.array(db), 0.9) if da else []
                if len(at) >= 2:
                    i, j = np.array(at).T
                    want.append((a, b, len(at), graphs.homography_inliers(np.array(xa)[i], np.array(xb)[j])))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20 and any(x[3] for x in want)
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_resumed_batches_are_bounded(spark, tmp_path):
    """Each batch reads the whole table: 3,000 rows by tens were 300 readings of it."""
    goes = []
    make = lambda df: goes.append(1) or df.select("id", F.lit(1).alias("n"))
    got = readers.resumed(spark.range(3000), f"{tmp_path}/out", make, "id", batch=10)
    assert len(goes) == readers.BATCHES < 300 and got.count() == got.select("id").distinct().count() == 3000


def test_square_of_a_class_is_small():
    """What average linkage of the largest class that one task works out keeps, at 8 bytes a cell: 3,200 MB before."""
    import inspect

    assert 8 * inspect.signature(linkage.clusters).parameters["most"].default ** 2 <= 2**29
