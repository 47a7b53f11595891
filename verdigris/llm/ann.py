"""Approximate nearest neighbours by balanced posting lists.

Vectors are put in the posting lists of their nearest centroids: one, and up to REPLICAS where they
lie at the boundary, no more than a factor as far from the others. Centroids come from a
balanced k-means of a bounded sample; they and their neighbourhood graph are small (LISTS at most)
and kept in memory by every task, which searches them best first: a walk keeps a beam of the nearest
centroids met and goes on from those it has not left yet. A query looks into the lists whose
centroids are no more than a ratio as far as its nearest, and into as many as hold enough vectors for k.

Factor, ratio and number of lists are planned: those that find RECALL of the true neighbours, among
all vectors, of ASKED drawn ones with the fewest products. Well clustered vectors so get a ratio just
above 1 and are found in few lists, others in as many as they need.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), with M
the largest norm. Equal vectors are one entry with the smallest ids, so that copies make no list
longer. Lists are dealt to bundles of about equal size, long lists in shards; a task scans one
bundle for the queries that chose a list in it, in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import staged, tune

#: Vectors that centroids are fitted on at most; lists at most; lists of a boundary vector at most.
SAMPLE, LISTS, REPLICAS = 20_000, 8192, 3
#: How many times as far as the nearest a vector's other centroids may be: the factors tried.
REPLICATE = (1.002, 1.01, 1.03, 1.08)
#: Lists in units of the root of the number of vectors: those tried.
FINENESS = (1, 2, 4)
#: Share of true neighbours that the ratio is to reach, how many vectors tell it, and how many the sizes of lists.
RECALL, ASKED, SIZED = 0.97, 256, 5000
#: Entries of a bundle, bundles at least, queries of a block.
BUNDLE, BUNDLES, QUERIES = 200_000, 12, 50_000
#: Queries that a task scans a bundle for at once.
SCANNED = 256
#: Neighbours of a centroid in the graph, and random ones besides; centroids that a walk starts from and leaves in a step.
DEGREE, FAR, STARTS, STEP = 16, 4, 16, 4


@dataclass
class Index:
    """Centroids [list, dim + 1], the graph over them, the largest norm, the factors planned, and the lists' sizes."""

    centroids: np.ndarray
    graph: np.ndarray
    largest: float
    replicate: float = REPLICATE[-1]
    ratio: float = 1.0
    first: int = 32
    sizes: np.ndarray | None = None

    def search(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The wanted nearest centroids of each x that a walk meets, nearest first, their squared distances, and the number
        of distances worked out for each x. What is kept of a walk is its beam, a few more than are wanted."""
        n, lists = len(x), len(self.centroids)
        wanted = min(wanted, lists)
        beam = min(lists, max(wanted + 16, wanted * 5 // 4))
        norms, own = (self.centroids**2).sum(1), (x * x).sum(1)
        met, d = np.full((n, beam), -1), np.full((n, beam), np.inf)
        ahead, visited = np.zeros((n, beam), bool), np.zeros(n, np.int64)
        rows = np.arange(n)
        new = np.broadcast_to(np.unique(np.linspace(0, lists - 1, STARTS).astype(int)), (n, min(lists, STARTS)))
        while len(rows):
            both = np.hstack([met[rows], new])
            order = np.argsort(both, axis=1, kind="stable")  # a centroid of the beam before its repetition
            line = np.take_along_axis(both, order, 1)
            fresh = np.zeros(both.shape, bool)
            np.put_along_axis(fresh, order, np.c_[line[:, :1] >= 0, (line[:, 1:] != line[:, :-1]) & (line[:, 1:] >= 0)], 1)
            fresh[:, :beam] = False
            cost = np.hstack([d[rows], np.full(new.shape, np.inf)])
            r, c = np.nonzero(fresh)
            to = both[r, c]
            cost[r, c] = np.maximum(own[rows[r]] + norms[to] - 2 * np.einsum("nd,nd->n", self.centroids[to], x[rows[r]]), 0.0)
            visited[rows] += fresh.sum(1)
            fresh[:, :beam] = ahead[rows]
            best = np.argpartition(cost, beam - 1, axis=1)[:, :beam]
            met[rows], d[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(cost, best, 1)
            met[rows] = np.where(np.isfinite(d[rows]), met[rows], -1)
            ahead[rows] = np.take_along_axis(fresh, best, 1)
            rows = rows[ahead[rows].any(1)]
            if not len(rows):
                break
            width = min(STEP, beam)
            cost = np.where(ahead[rows], d[rows], np.inf)
            pick = np.argpartition(cost, width - 1, axis=1)[:, :width]
            use = np.isfinite(np.take_along_axis(cost, pick, 1))
            ahead[rows[:, None], pick] = False
            new = np.where(use[:, :, None], self.graph[met[rows[:, None], pick]], -1).reshape(len(rows), -1)
        order = np.lexsort((met, d), axis=1)[:, :wanted]
        return np.take_along_axis(met, order, 1), np.take_along_axis(d, order, 1), visited

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The REPLICAS nearest centroids of each vector, and their distances in units of the nearest's."""
        parts = [self.search(lifted(v[i : i + 256], self.largest), REPLICAS)[:2] for i in range(0, max(1, len(v)), 256)]
        near, d = (np.concatenate(x) for x in zip(*parts))
        return near, np.sqrt((d + 1e-12) / (d[:, :1] + 1e-12))

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists of the vectors' entries."""
        near, far = self.nearest(v)
        use = far <= self.replicate
        return np.nonzero(use)[0], near[use]

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries as points: of the largest norm, where the nearest point is that of the largest inner product."""
        return np.hstack([q * (self.largest / np.maximum(np.linalg.norm(q, axis=1), 1e-300))[:, None], np.zeros((len(q), 1))])

    def probe(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and lists that the queries look into, and the centroids each has met. The graph is searched for the first
        nearest lists, and again for twice as many only where those do not reach the ratio and hold least vectors yet."""
        x, visited = self.aimed(q), np.zeros(len(q), np.int64)
        todo, wanted, rows, lists = np.arange(len(q)), self.first, [], []
        while len(todo):
            near, d, met = self.search(x[todo], wanted)
            visited[todo] += met
            held = np.cumsum(self.sizes[near], axis=1) - self.sizes[near]
            use = np.isfinite(d) & ((d <= d[:, :1] * self.ratio**2 + 1e-12) | (held < least))
            done = ~use[:, -1] | (near.shape[1] == len(self.centroids))
            at, to = np.nonzero(use & done[:, None])
            rows.append(todo[at])
            lists.append(near[at, to])
            todo, wanted = todo[~done], wanted * 2
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(lists or [np.zeros(0, np.int64)]), visited

    def plan(self, sample: np.ndarray, q: np.ndarray, true: list[np.ndarray], total: int) -> float:
        """Sets the factors: what the queries q need for RECALL of their true neighbours to be found. The answer is the
        products of a query among total vectors, with those of its walk among the centroids. Queries must be drawn
        from all vectors, as those that centroids were fitted on are nearer to their own than others are.

        A vector is found where one of its lists is asked, so it needs the least ratio among its lists' centroids.
        """
        of = np.repeat(np.arange(len(true)), [len(x) for x in true])
        if not len(of):
            return 0.0
        x, c = self.aimed(q), self.centroids
        d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0.0) + 1e-12
        ratio = np.sqrt(d / d.min(1)[:, None])
        near, far = self.nearest(np.concatenate([x for x in true if len(x)]))
        some = sample[:SIZED]
        lists, apart = self.nearest(some)
        least = np.inf
        for factor in REPLICATE:
            needed = np.where(far <= factor, ratio[of[:, None], near], np.inf).min(1)
            to = float(np.quantile(needed, RECALL, method="higher"))
            asked = ratio <= to
            first = int(np.quantile(asked.sum(1), 0.9)) + 2
            cost = float((asked @ np.bincount(lists[apart <= factor], minlength=len(c))).mean()) * total / len(some) + min(len(c), (DEGREE + FAR) * (STARTS + first) / 2)
            if cost < least:
                least, self.replicate, self.ratio, self.first = cost, factor, to, first
        return least


def lifted(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the coordinate that makes all norms the largest."""
    return np.hstack([v, np.sqrt(np.maximum(largest**2 - (v * v).sum(1), 0.0))[:, None]])


def train(sample: np.ndarray, largest: float, lists: int, seed: int = 11, rounds: int = 10) -> Index:
    """Centroids by k-means in which a list's size adds to its distance, and the graph of their neighbours."""
    rng = np.random.default_rng(seed)
    x = lifted(sample, largest)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    penalty = np.zeros(len(c))
    for _ in range(rounds):
        label = np.concatenate([np.argmin((c * c).sum(1) - 2 * part @ c.T + penalty, axis=1) for part in np.array_split(x, max(1, len(x) * len(c) // 4_000_000))])
        size = np.bincount(label, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        empty = np.flatnonzero(size == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
        spread = float(((x - c[label]) ** 2).sum(1).mean())
        penalty = 0.05 * spread * np.maximum(size / max(1.0, size.mean()) - 1, 0)
    d = (c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T
    near = np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE + 1, len(c))]
    ring = (np.arange(len(c))[:, None] + 1) % len(c)  # keeps the graph in one piece
    return Index(c, np.hstack([near, rng.integers(0, len(c), (len(c), FAR)), ring]), largest)


def planned(sample: np.ndarray, largest: float, q: np.ndarray, true: list[np.ndarray], total: int) -> Index:
    """The index, not yet with sizes, of the number of lists that costs least; a list has eight of the sample at least."""
    best, least = None, np.inf
    for lists in sorted({int(max(1, min(LISTS, len(sample) // 8, round(x * total**0.5)))) for x in FINENESS}):
        index = train(sample, largest, lists)
        cost = index.plan(sample, q, true, total)
        if cost < least:
            best, least = index, cost
    return best


def vectors(df: DataFrame, key: str, embedding: str) -> tuple[DataFrame, str, int]:
    """id, vec (its components' bytes), norm of the rows that take part, their number type and dimension."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(embedding).alias("e"))
    kind = "f4" if "float" in df.schema[embedding].dataType.simpleString() else "f8"
    if kind == "f8":
        rows = rows.withColumn("e", F.col("e").cast("array<double>"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("e").isNotNull() & ~odd & F.exists("e", lambda x: x != 0))
    usual = rows.groupBy(F.size("e").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    dim = usual["n"] if usual else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind) + np.dtype(kind).type(0)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "vec": pa.array([x.tobytes() for x in v], pa.binary()), "norm": pa.array(np.linalg.norm(v.astype(np.float64), axis=1))})

    return rows.filter(F.size("e") == dim).mapInArrow(run, "id bigint, vec binary, norm double"), kind, dim


def draw(entries: DataFrame, h: Column, n: int, total: int) -> list[bytes]:
    """The n vectors of least hash."""
    part = entries.select("vec", h.alias("h")).filter(F.pmod("h", F.lit(1 << 30)) < max(1, min(1 << 30, int((1 << 30) * 1.5 * n / total) + 1)))
    return [bytes(r["vec"]) for r in part.orderBy("h", "vec").limit(n).collect()]


def neighbours(entries: DataFrame, q: np.ndarray, k: int, kind: str, dim: int) -> list[np.ndarray]:
    """The k vectors of entries, other than itself, of largest inner product with each of a bounded number of vectors."""
    own = {x.tobytes(): i for i, x in enumerate(q.astype(kind))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kept = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), object)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                vecs = np.array(b.column("vec").slice(i, 4096).to_pylist(), object)
                s = q @ matrix(vecs, kind, dim).T
                for j, x in enumerate(vecs):
                    if x in own:
                        s[own[x], j] = -np.inf
                s, v = np.hstack([best, s]), np.hstack([kept, np.broadcast_to(vecs, s.shape)])
                first = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                best, kept = np.take_along_axis(s, first, 1), np.take_along_axis(v, first, 1)
        at, place = np.nonzero(np.isfinite(best))
        if len(at):
            yield pa.RecordBatch.from_pydict({"q": pa.array(at.astype(np.int32)), "score": pa.array(best[at, place]), "vec": pa.array(kept[at, place].tolist(), pa.binary())})

    rows = entries.select("vec").mapInArrow(run, "q int, score double, vec binary")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec"))).filter(F.col("n") <= k)
    found: list[list[bytes]] = [[] for _ in q]
    for r in first.select("q", "vec").collect():  # k a vector at most
        found[r["q"]].append(bytes(r["vec"]))
    return [matrix(x, kind, dim) for x in found]


def matrix(column: object, kind: str, dim: int) -> np.ndarray:
    """Packed vectors as doubles."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim).astype(np.float64)


def search(df: DataFrame, k: int = 20, step: int = 20, key: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score, asked, visited, products: for each row whose key is divisible by step, the k others of
    largest inner product found; lists asked, centroids met in the graph and vectors in the lists are those of the query.

    Nearest first, ties to the smaller key; scores are inner products of the original vectors in double precision.
    Rows with null keys, and vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do those of another dimension than most have. Of several vectors with one key the least (by its bytes)
    counts. With fewer than k candidates all found are returned. Other columns are not read.
    """
    spark = df.sparkSession
    tune(spark)
    rows, kind, dim = vectors(df, key, embedding)
    n = df.count()
    one = staged(rows.groupBy("id").agg(F.min(F.struct("vec", "norm")).alias("x")).select("id", "x.vec", "x.norm"), "vectors", n)
    w = Window.partitionBy("vec").orderBy("id")
    # more than the k + 1 smallest ids of one vector can never be among the k nearest
    few = one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    entries = staged(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("norm").alias("norm")), "entries", n)
    total, largest = entries.agg(F.count("*"), F.max("norm")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double, asked bigint, visited bigint, products bigint"
    if not total:
        return spark.createDataFrame([], schema)
    drawn, q = (matrix(draw(entries, F.xxhash64(F.lit(seed), "vec"), n, total), kind, dim) for seed, n in ((0, sample), (1, ASKED)))
    index = planned(drawn, largest, q, neighbours(entries, q, k, kind, dim), total)
    least = REPLICAS * (k + 2)  # enough for k others, though a vector may be in several of the lists
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                at, to = shared.value.assign(matrix(c.column("vec").to_pylist(), kind, dim))
                c = c.take(pa.array(at))
                yield pa.RecordBatch.from_pydict({"list": pa.array(to.astype(np.int32)), "vec": c.column("vec"), "ids": c.column("ids")})

    postings = staged(entries.select("vec", "ids").mapInArrow(assign, "list int, vec binary, ids array<bigint>"), "postings", n)
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    index.sizes = sizes
    each = int(min(BUNDLE, max(1, -(-int(sizes.sum()) // BUNDLES))))
    shards = np.maximum(1, -(-sizes // each))
    base, bundle, room = np.zeros(len(sizes), np.int64), 0, each
    order = np.argsort(index.centroids @ np.linalg.svd(index.centroids - index.centroids.mean(0), full_matrices=False)[2][0], kind="stable")
    for i in order:  # lists near each other share a bundle; a list of several shards has bundles of its own
        if shards[i] > 1:
            bundle += room < each
            base[i], bundle, room = bundle, bundle + shards[i], each
        else:
            if sizes[i] > room:
                bundle, room = bundle + 1, each
            base[i], room = bundle, room - sizes[i]
    shared = spark.sparkContext.broadcast(index)
    places = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(sizes), dtype=np.int32), "base": base, "shards": shards})))  # a row for each list
    placed = postings.join(places, "list").withColumn("bundle", F.col("base") + F.pmod(F.xxhash64("vec"), F.col("shards"))).select("bundle", "list", "vec", "ids")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                at, to, visited = shared.value.probe(matrix(c.column("vec").to_pylist(), kind, dim), least)
                asked, products = np.bincount(at, minlength=c.num_rows), np.bincount(at, shared.value.sizes[to], c.num_rows).astype(np.int64)
                out: dict[tuple[int, int], list[int]] = {}
                for r, x in zip(at.tolist(), to.tolist()):
                    for s in range(shards[x]):
                        out.setdefault((r, int(base[x]) + s), []).append(x)
                of = np.array([r for r, _ in out], np.int64)
                c = c.take(pa.array(of))
                yield pa.RecordBatch.from_pydict({"bundle": pa.array([x for _, x in out], pa.int64()), "id": c.column("id"), "vec": c.column("vec"), "lists": pa.array(list(out.values()), pa.list_(pa.int32())), "asked": pa.array(asked[of]), "visited": pa.array(visited[of]), "products": pa.array(products[of])})

    effort = ["asked", "visited", "products"]
    asked = one.filter(F.col("id") % step == 0).select("id", "vec").mapInArrow(probe, "bundle bigint, id bigint, vec binary, lists array<int>, asked bigint, visited bigint, products bigint")
    asked = staged(asked, "asked", n)
    # a bundle goes only where it is asked for, and twice only where more ask than one task should hold
    blocks = asked.groupBy("bundle").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    asked = asked.join(blocks, "bundle").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    placed = placed.join(blocks, "bundle").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def scan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "scores": pd.Series(dtype=object), **{x: pd.Series(dtype="int64") for x in effort}})
        if not len(left) or not len(right):
            return found
        left = left.sort_values("list", kind="stable")
        v, of = matrix(left["vec"], kind, dim), left["list"].to_numpy()
        ids = left["ids"].to_list()
        edges = {x: (int(np.searchsorted(of, x)), int(np.searchsorted(of, x, side="right"))) for x in np.unique(of)}
        parts = [top(right.iloc[i : i + SCANNED], v, ids, edges) for i in range(0, len(right), SCANNED)]
        return pd.concat([found, *parts])

    def top(queries: pd.DataFrame, v: np.ndarray, ids: list, edges: dict) -> pd.DataFrame:
        q = matrix(queries["vec"], kind, dim)
        own, spent = queries["id"].to_numpy(), queries[effort].to_numpy()
        by: dict[int, list[int]] = {}
        for i, xs in enumerate(queries["lists"]):
            for x in xs:
                by.setdefault(int(x), []).append(i)
        who, what = [], []
        for x, qs in by.items():
            if x not in edges:
                continue
            a, z = edges[x]
            s = q[qs] @ v[a:z].T
            # one more than k, for the query itself, and some for rounding in the product
            m = min(z - a, k + 4)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < z - a else np.broadcast_to(np.arange(z - a), s.shape)
            who.append(np.repeat(qs, m))
            what.append(best.reshape(-1) + a)
        if not who:
            return pd.DataFrame(columns=["query_id", "ids", "scores", *effort])
        who, what = np.concatenate(who), np.concatenate(what)
        exact = np.concatenate([np.einsum("ij,ij->i", q[who[i : i + 32768]], v[what[i : i + 32768]]) for i in range(0, len(who), 32768)])
        order = np.lexsort((-exact, who))
        who, what, exact = who[order], what[order], exact[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        out = []
        for a, z in zip(starts, np.r_[starts[1:], len(who)]):
            me, names, scores, last, seen = int(own[who[a]]), [], [], None, set()
            for j in range(a, z):
                if len(names) >= k and exact[j] < last:
                    break
                last = exact[j]
                for name in ids[what[j]]:
                    if name != me and name not in seen:
                        seen.add(name)
                        names.append(int(name))
                        scores.append(float(last))
            out.append((me, names, scores, *spent[who[a]].tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores", *effort])

    got = placed.groupBy("bundle", "block").cogroup(asked.groupBy("bundle", "block")).applyInPandas(scan, "query_id bigint, ids array<bigint>, scores array<double>, asked bigint, visited bigint, products bigint")
    flat = got.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("x"), *effort).select("query_id", F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), *effort)
    best = flat.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), *(F.max(x).alias(x) for x in effort))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score", *effort)
