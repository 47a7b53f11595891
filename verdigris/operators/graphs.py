"""Graphs as tables of edges: components, greedy independent sets, communities, clusters, geometric checks."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Where that is unset, a local one in local
    mode (tests); on a cluster it is refused, as other machines would not see it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="work-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "step", rows: int | None = None) -> DataFrame:
    """df as a table in a shared folder: its lineage is cut and a lost executor costs nothing.

    With rows, about how many the table has, small partitions are put together, so that it is no more files than it needs.
    """
    at = workspace(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


#: Edges that one task ties together at once; more are contracted in rounds. Rows of a file of a written table.
FEW, ROWS = 500_000, 1 << 18


def tied(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs [n, 2] and their roots: the least node of each component."""
    names, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return names, names[root]
        root = new


def components(edges: DataFrame, nodes: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """node, root: the smallest node that each can reach; nodes (column node) without edges are their own root.

    Up to few edges go through one task. More are contracted to stars in alternating rounds: every node is tied to the
    least of its neighbourhood until all edges are stars.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = written(edges, "edges").distinct()
    before, n = None, now.count()
    small = n <= few

    def at_once(pdfs):
        rows = [pdf[["a", "b"]].to_numpy(np.int64) for pdf in pdfs]
        node, root = tied(np.concatenate(rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pd.DataFrame({"a": node[node != root], "b": root[node != root]})

    if small:
        now = written(now.coalesce(1).mapInPandas(at_once, "a bigint, b bigint"))
    while not small:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = large.join(low, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = written(ties.union(low).distinct(), rows=n)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if nodes is None:
        return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _in_order(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of pairs [n, 2] (early, late) that are lost, and the first kept neighbour of each, one node after the other."""
    lost: dict[int, int] = {}
    late = np.sort(np.unique(pairs[:, 1]))
    order = np.lexsort((pairs[:, 0], pairs[:, 1]))
    early, at = pairs[order, 0], np.searchsorted(pairs[order, 1], late)
    for n, a, z in zip(late.tolist(), at, [*at[1:], len(pairs)]):
        twin = next((e for e in early[a:z].tolist() if e not in lost), None)
        if twin is not None:
            lost[n] = twin
    return np.array(list(lost), np.int64), np.array(list(lost.values()), np.int64)


def _in_prefixes(pairs: DataFrame, most: int, spent: list[int] | None = None) -> DataFrame:
    """node, twin of the nodes that are lost, of components of any size, by beginnings of the order.

    A round takes the open edges of the first late ends, about most of them at first and twice as many after each round
    that went well. What they hold together is decided piece by piece, a piece of up to 2 most edges in one task in
    order; nodes beyond that lose to a kept one close with it. Of larger pieces, only nodes without an earlier open
    neighbour are decided, and the next beginning is half as long. So rounds follow the logarithm of the edges, or the
    edges of one piece by most, and not the longest chain. spent takes the open edges before each round.
    """
    room, now, lost = most, pairs, None
    while n := now.count():
        if spent is not None:
            spent.append(n)
        cut = None if room >= n else now.agg(F.percentile_approx("late", room / n, max(10_000, 10 * n // room))).first()[0]
        first = now if cut is None else now.filter(F.col("late") <= cut)
        roots = written(components(first.select(F.col("early").alias("a"), F.col("late").alias("b"))))
        pieces = written(first.join(roots.select(F.col("node").alias("early"), "root"), "early"), "pieces")
        big = pieces.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * most).select("root")
        waits = written(roots.join(big, "root", "left_semi").select("node"))
        done = pieces.join(big, "root", "left_anti").groupBy("root").applyInPandas(_decided, "node bigint, twin bigint").select("node")
        # kept: what no piece decided against, what begins a large piece, and what no open edge of this beginning touches
        nodes = now.select(F.col("early").alias("node")).union(now.select("late")).distinct()
        begins = now.select(F.col("early").alias("node")).distinct().join(now.select(F.col("late").alias("node")), "node", "left_anti")
        here = nodes if cut is None else nodes.filter(F.col("node") <= cut)
        done = written(done)
        kept = written(here.join(waits, "node", "left_anti").join(done, "node", "left_anti").union(begins).distinct())
        hit = now.join(kept.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node"))
        gone = written(done.union(hit).distinct())
        lost = gone if lost is None else lost.union(gone)
        over = kept.union(gone)
        now = now.join(over.select(F.col("node").alias("early")), "early", "left_anti").join(over.select(F.col("node").alias("late")), "late", "left_anti")
        now = written(now.select("early", "late"), rows=n)
        room = 2 * room if waits.isEmpty() else max(most, room // 2)
    stays = pairs.join(lost.select(F.col("node").alias("early")), "early", "left_anti")
    return stays.groupBy(F.col("late").alias("node")).agg(F.min("early").alias("twin")).join(lost, "node", "left_semi")


def _decided(pdf: pd.DataFrame) -> pd.DataFrame:
    """_in_order of one piece's rows (early, late)."""
    node, twin = _in_order(pdf[["early", "late"]].to_numpy(np.int64))
    return pd.DataFrame({"node": node, "twin": twin})


def first_independent_set(nodes: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """node, kept, twin of nodes taken in order, each kept unless an earlier kept node is its neighbour (twin: the first such).

    Components of at most most edges are each decided in one task, in order; larger ones by beginnings of the order, over all tasks.
    """
    pairs = written(edges.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).filter("early <> late").distinct())
    roots = written(components(pairs.select(F.col("early").alias("a"), F.col("late").alias("b"))))
    labelled = pairs.join(roots.select(F.col("node").alias("early"), "root"), "early")
    large = labelled.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("root")
    # many components share a task; none that is large
    lost = labelled.join(large, "root", "left_anti").groupBy("root").applyInPandas(_decided, "node bigint, twin bigint")
    rest = written(labelled.join(large, "root", "left_semi").select("early", "late"))
    lost = written(lost)
    if not rest.isEmpty():
        lost = lost.unionByName(_in_prefixes(rest, max(1, most)))
    return nodes.select("node").join(lost, "node", "left").select("node", F.col("twin").isNull().alias("kept"), "twin")


def lifted_edges(pairs: DataFrame, members: DataFrame, key: str, group: str, weight: str) -> DataFrame:
    """one, other, n, weight: pairs of rows (a, b) as edges between the groups of their ends, added up; none within a group."""
    of = lambda end, name: members.select(F.col(key).alias(end), F.col(group).alias(name))
    ends = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x <> y")
    return ends.groupBy(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other")).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))


def average_linkage(vectors: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers (in order of first member) by average linkage on cosine, merging while the mean cosine is least or more.

    By the nearest-neighbour chain: from a cluster to its nearest and on, until two are each other's nearest; those merge.
    The mean cosine never rises by merging, so the merges of least or more are those of the greedy order. Time and
    memory are of the order of the square of the rows.
    """
    n = len(vectors)
    s = vectors @ vectors.T
    np.fill_diagonal(s, -np.inf)
    size, alive, member, chain = np.ones(n), np.ones(n, bool), np.arange(n), []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            top = chain[-1]
            near = int(np.argmax(s[top]))
            if len(chain) > 1 and s[top, chain[-2]] >= s[top, near]:
                break
            chain.append(near)
        j, i = chain.pop(), chain.pop()
        if s[i, j] >= least:
            member[member == member[j]] = member[i]
        mean = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = mean, mean
        s[j], s[:, j], s[i, i] = -np.inf, -np.inf, -np.inf
        size[i] += size[j]
        alive[j] = False
    return np.unique([np.flatnonzero(member == m)[0] for m in member], return_inverse=True)[1] if n else np.zeros(0, int)


def refused_above(counts: DataFrame, most: int, what: str) -> None:
    """ValueError if a row of counts has n above most: said before any group is in a task's memory."""
    if not counts.filter(F.col("n") > most).isEmpty():
        raise ValueError(f"a class has more than {most} {what}")


def linkage_clusters(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", most: int = 20_000) -> DataFrame:
    """label, key, cluster: average-linkage clusters of each class. A class of more than most rows is refused: it needs the square in memory."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        return pd.DataFrame({"label": pdf["label"], "id": pdf["id"], "cluster": average_linkage(np.stack(pdf["v"].to_list()).astype(np.float64), least)})

    rows = df.select(F.col(label).cast("int").alias("label"), F.col(key).alias("id"), F.col(vector).alias("v"))
    refused_above(rows.groupBy("label").agg(F.count("*").alias("n")), most, "rows")
    return rows.groupBy("label").applyInPandas(run, "label int, id bigint, cluster int").withColumnRenamed("id", key)


def louvain(nodes: list, edges: list[tuple], degrees: list[float] | None = None, total: float | None = None) -> dict:
    """Community (numbered by first node) of each node of an undirected weighted graph, by local moves and aggregation.

    Nodes are visited in the given order; a move must raise modularity by more than 1e-12; ties go to the smaller
    community. Where the graph is a part of a larger one, degrees and total are weighted degrees and the weight of all
    edges in that one, so that moves raise its modularity.
    """
    index = {v: i for i, v in enumerate(nodes)}
    links: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = index[a], index[b]
        links[i][j] = links[i].get(j, 0.0) + w
        if i != j:
            links[j][i] = links[j].get(i, 0.0) + w
    member = list(range(len(nodes)))
    degree = [sum(x.values()) + x.get(i, 0.0) for i, x in enumerate(links)] if degrees is None else list(degrees)
    total = sum(degree) / 2 if total is None else total
    while total > 0:
        of, mass = list(range(len(links))), degree[:]
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in range(len(links)):
                near: dict[int, float] = {}
                for j, w in links[i].items():
                    if j != i:
                        near[of[j]] = near.get(of[j], 0.0) + w
                mass[of[i]] -= degree[i]
                gain = {c: w - mass[c] * degree[i] / (2 * total) for c, w in near.items()}
                stay = near.get(of[i], 0.0) - mass[of[i]] * degree[i] / (2 * total)
                best = min(gain, key=lambda c: (-gain[c], c), default=of[i])
                if gain.get(best, stay) > stay + 1e-12:
                    of[i], moved, moved_any = best, True, True
                mass[of[i]] += degree[i]
        if not moved_any:
            break
        names = {c: n for n, c in enumerate(dict.fromkeys(of))}
        merged: list[dict[int, float]] = [{} for _ in names]
        for i, x in enumerate(links):
            for j, w in x.items():
                a, b = names[of[i]], names[of[j]]
                if i <= j:
                    merged[a][b] = merged[a].get(b, 0.0) + w
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + w
        whole = [0.0] * len(names)
        for i, k in enumerate(degree):
            whole[names[of[i]]] += k
        member, links, degree = [names[of[m]] for m in member], merged, whole
    names = {c: n for n, c in enumerate(dict.fromkeys(member))}
    return {v: names[member[i]] for i, v in enumerate(nodes)}


def communities(nodes: DataFrame, edges: DataFrame, label: str = "label", most: int = 1_000_000) -> DataFrame:
    """label, node, community: Louvain communities of each class; edges (label, a, b, weight) of one class only. A class of more than most nodes or edges is refused."""
    left = nodes.select(F.col(label).cast("int").alias("label"), F.col("node").cast("bigint").alias("node"))
    right = edges.select(F.col(label).cast("int").alias("label"), "a", "b", "weight").filter("a <> b")
    right = right.groupBy("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))

    for df, what in ((left, "nodes"), (right, "edges")):
        refused_above(df.groupBy("label").agg(F.count("*").alias("n")), most, what)

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = sorted(n["node"])
        e = e.sort_values(["a", "b"])
        found = louvain(names, list(zip(e["a"], e["b"], e["weight"])))
        return pd.DataFrame({"label": [key[0]] * len(names), "node": names, "community": [found[x] for x in names]})

    return left.groupBy("label").cogroup(right.groupBy("label")).applyInPandas(run, "label int, node bigint, community int")


@lru_cache(1024)
def samples(n: int, tries: int, seed: int) -> np.ndarray:
    """Fours of n points drawn tries times, each once: of few points hardly any are different."""
    return np.unique(np.sort(np.argsort(np.random.default_rng(seed).random((tries, n)), axis=1)[:, :4], axis=1), axis=0)


def homography_inliers(p: np.ndarray, q: np.ndarray, within: float = 5.0, tries: int = 500, seed: int = 0) -> int:
    """Most points p that one homography maps to within a distance of their q, over random minimal samples, all at once."""
    n = len(p)
    if n < 4:
        return 0
    at = samples(n, tries, seed)
    each = lambda z: np.broadcast_to(z, (len(at), *z.shape))
    return int(_inliers(each(p), each(q), at, within).max())


#: Samples that all_inliers() tries at once, one wave after the other; how flat three points of a sample, how far a point may
#: be thrown, and how near the border it may come, for plain arithmetic to say the same as homography_inliers().
WAVES, FLAT, THROWN, BORDER = (1, 3, 12, 48), 1e-4, 1e-3, 1e-3


def all_inliers(p: np.ndarray, q: np.ndarray, within: float = 5.0, tries: int = 500, seed: int = 0) -> np.ndarray:
    """homography_inliers() of many pairs at once, points [pairs, n, 2].

    The homography of four points is worked out by areas of triangles, for samples until one has all points; where
    rounding could tell otherwise, and that would matter, it is solved for as there.
    """
    m, n = p.shape[:2]
    best = np.zeros(m, int)
    if n < 4 or not m:
        return best
    all_at, rest, unsure = samples(n, tries, seed), np.arange(m), []
    area = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    start = wave = 0
    while start < len(all_at) and len(rest):
        at = all_at[start : start + WAVES[min(wave, len(WAVES) - 1)]]
        x, y = p[rest][:, None], q[rest][:, None]  # [pairs, 1, n, 2]
        corners, sound = [], True
        for points in (p[rest][:, at], q[rest][:, at]):  # [pairs, samples, 4, 2]
            a, b, c, d = np.moveaxis(points, 2, 0)
            areas = np.stack([area(d, b, c), area(a, d, c), area(a, b, d)])
            size = np.square(points - points.mean(2, keepdims=True)).sum((2, 3))
            sound &= np.minimum(np.abs(areas).min(0), np.abs(area(a, b, c))) > FLAT * size
            corners.append((areas, [k[:, :, None] for k in (a, b, c)]))
        (of_p, (a, b, c)), (of_q, to) = corners
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            parts = (of_q / of_p)[..., None] * np.stack([area(x, b, c), area(a, x, c), area(a, b, x)])  # [3, pairs, samples, n]
            whole = parts.sum(0)
            apart = np.hypot(*(sum(t * k[..., i] for t, k in zip(parts, to)) / whole - y[..., i] for i in (0, 1)))
            clear = sound[..., None] & (np.abs(whole) > THROWN * np.abs(parts).sum(0)) & (np.abs(apart - within) > BORDER * within)
        surely = (clear & (apart <= within)).sum(2)
        most = surely + n - clear.sum(2)
        best[rest] = np.maximum(best[rest], surely.max(1))
        i, k = np.nonzero(most > best[rest][:, None])
        unsure.append((rest[i], k + start, most[i, k]))
        rest, start, wave = rest[best[rest] < n], start + len(at), wave + 1
    pair, sample, most = (np.concatenate(z) for z in zip(*unsure))
    open_ = np.flatnonzero(most > best[pair])
    for cut in range(0, len(open_), 4096):
        i = pair[open_[cut : cut + 4096]]
        np.maximum.at(best, i, _inliers(p[i], q[i], all_at[sample[open_[cut : cut + 4096]]], within))
    return best


def _inliers(p: np.ndarray, q: np.ndarray, at: np.ndarray, within: float) -> np.ndarray:
    """How many of the points [k, n, 2] the homography of the four at [k, 4] maps to within a distance of their q."""
    (x, y), (u, v) = (np.moveaxis(np.take_along_axis(z, at[:, :, None], 1), 2, 0) for z in (p, q))
    one, zero = np.ones_like(x), np.zeros_like(x)
    across = np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 2)
    down = np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 2)
    h = np.linalg.svd(np.concatenate([across, down], 1))[2][:, -1].reshape(-1, 3, 3)
    mapped = np.concatenate([p, np.ones((*p.shape[:2], 1))], 2) @ h.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.linalg.norm(mapped[..., :2] / mapped[..., 2:] - q, axis=2)
    return (apart <= within).sum(1)


def mutual_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.8) -> list[tuple[int, int]]:
    """Keypoints (i, j) of unit descriptors that are each other's nearest, the nearest closer than ratio times the second."""
    if not len(a) or len(b) < 2:
        return []
    d = np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))
    two = np.sort(np.partition(d, 1, axis=1)[:, :2], axis=1)
    near, back = d.argmin(1), d.argmin(0)
    return [(i, int(near[i])) for i in range(len(a)) if two[i, 0] < ratio * two[i, 1] and back[near[i]] == i]


def all_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """mutual_matches() of many pairs of items at once, descriptors [pairs, keypoints, dim]: which keypoints of a have a match, and which."""
    if not a.shape[1] or b.shape[1] < 2:
        return np.zeros(a.shape[:2], bool), np.zeros(a.shape[:2], int)
    d = np.sqrt(np.maximum(0, 2 - 2 * a @ b.transpose(0, 2, 1)))
    two = np.sort(np.partition(d, 1, axis=2)[:, :, :2], axis=2)
    near, back = d.argmin(2), d.argmin(1)
    return (two[:, :, 0] < ratio * two[:, :, 1]) & (np.take_along_axis(back, near, 1) == np.arange(a.shape[1])), near
