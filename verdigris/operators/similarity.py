"""Similarity joins and nearest neighbours on vectors, in blocks of numpy products.

A thresholded self-join is dealt in pairs of blocks: each row goes to the block pairs that its block
takes part in, a task multiplies two blocks and gives only the pairs above the threshold. It is
exact, no task holds more than two blocks, and no pair below the threshold ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import graphs
from verdigris.operators.graphs import written

#: Rows of a block; rows of a reference side that every task may hold (a broadcast).
BLOCK, SIDE = 4096, 100_000
#: Blocks of a self-join at most, unless one would then have more than VALUES numbers; cells of a product that a task has at once.
BLOCKS, VALUES, CELLS = 8, 1 << 23, 1 << 22
#: Cells of a product of inner products, and columns: what a processor's cache holds; pairs that are tied at once.
TILE, WIDE, TIED = 1 << 20, 2048, 1 << 18
#: Rows of a block of two tables that meet.
MEET = 32_768


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (np.diff(column.offsets.to_numpy()) * len(column) != len(flat)).any():
        raise ValueError("vectors of several lengths")
    return flat.reshape(len(column), -1)


def _tied(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The places of those links (i, j) that tie components of root together, one for every two that become one; root,
    with a member that stands for each component, has them tied afterwards."""
    at, used = np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        a, b = root[i[at]], root[j[at]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if not len(at):
            return np.concatenate(used)
        high, first = np.unique(np.maximum(a, b), return_index=True)
        root[high] = np.minimum(a, b)[first]
        used.append(at[first])
        while (root[root] != root).any():
            root[:] = root[root]


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links [n, 2] that hold together what the symmetric matrix hit ties, one fewer than the rows of each component, and the components' numbers."""
    root, links = np.arange(len(hit)), np.argwhere(hit)
    return links[_tied(root, *links.T)], root


def bridging(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Links [n, 2] of rows and columns of hit that join the components that they have on either side, each once."""
    root = np.r_[_first(left), _first(right) + len(left)]
    links = np.argwhere(hit)
    return links[_tied(root, links[:, 0], links[:, 1] + len(left))]


def _first(names: np.ndarray) -> np.ndarray:
    """The place where each name is first met."""
    _, first, at = np.unique(names, return_index=True, return_inverse=True)
    return first[at]


Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Rows:
    """Rows that a task multiplies: ids, vectors, and their classes as numbers that are equal where the classes are."""

    ids: np.ndarray
    v: np.ndarray
    of: np.ndarray

    def __getitem__(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.ids[at], self.v[at], self.of[at])

    def __len__(self) -> int:
        return len(self.ids)

    @classmethod
    def read(cls, t: pa.Table) -> Rows:
        return cls(t.column("id").to_numpy(), _stacked(t.column("v")), pd.factorize(t.column("l").to_pandas())[0])


def _hits(x: Rows, y: Rows, same: float, other: float | None, score: Score | None, after: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, s, equal of the pairs of rows that are near enough, slice by slice; with after (x and y are the same rows)
    those with i < j only. Inner products are worked out in double where one in single precision leaves it open."""
    low = same if other is None else min(same, other)
    f, g, slack = x.v, y.v, 0.0
    if score is None:
        scale = np.linalg.norm(f, axis=1).max(initial=0.0) * np.linalg.norm(g, axis=1).max(initial=0.0)
        if scale < 1e18:
            f, g, slack = f.astype(np.float32), g.astype(np.float32), float((f.shape[1] + 8) * np.finfo(np.float32).eps * scale + 1e-30)
    wide = min(8192 if score else WIDE, max(1, len(y)))
    tall = max(1, (CELLS if score else TILE) // wide)
    for a in range(0, len(x), tall):
        for c in range(a if after else 0, len(y), wide):
            p, q = slice(a, a + tall), slice(c, c + wide)
            s = score(x.v[p], y.v[q]) if score else f[p] @ g[q].T
            at = np.flatnonzero(s >= low - slack)  # many times as fast as places in two dimensions
            if not len(at):
                continue
            i, j = np.divmod(at, s.shape[1])
            if score or not slack:
                s = s[i, j]
            elif len(i) * 64 > s.size:
                s = (x.v[p] @ y.v[q].T)[i, j]
            else:
                s = np.einsum("ij,ij->i", x.v[p][i], y.v[q][j])
            i, j = i + a, j + c
            equal = x.of[i] == y.of[j]
            keep = np.where(equal, s >= same, s >= other if other is not None else False) & (x.ids[i] != y.ids[j])
            if after:
                keep &= i < j
            if keep.any():
                yield i[keep], j[keep], s[keep], equal[keep]


def _links(left: Rows, right: Rows, alone: bool, same: float, other: float | None, score: Score | None, forest: bool) -> Iterator[pa.RecordBatch]:
    """a, b, cos, same_class of the pairs of two blocks, or within one if alone; with forest, only as many as tie together
    what the pairs of the two and within each tie, and of those within a block none but alone."""
    found = _hits(left, right, same, other, score, alone)
    for i, j, s, equal in _tying(left, right, alone, same, other, score, found) if forest else found:
        a, b = left.ids[i], right.ids[j]
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "cos": pa.array(s, pa.float64()), "same_class": pa.array(equal)})


def _tying(left: Rows, right: Rows, alone: bool, same: float, other: float | None, score: Score | None, found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the pairs found those that tie components, in one piece. Of two blocks, rows that are near the first row of theirs
    in a component need no pair of it: they are tied where each block meets itself."""
    root = np.arange(len(left) if alone else len(left) + len(right))
    kept, waiting, many = [], [], 0

    def tie() -> None:
        i, j, *more = (np.concatenate(z) for z in zip(*waiting))
        at = _tied(root, i, j if alone else j + len(left))
        kept.append((i[at], j[at], *(z[at] for z in more)))
        waiting.clear()

    for hit in found:
        waiting.append(hit)
        many += len(hit[0])
        if many >= TIED:
            tie()
            many = 0
    if waiting:
        tie()
    if not kept:
        return
    i, j, *more = (np.concatenate(z) for z in zip(*kept))
    if not alone:
        own = np.arange(len(root))
        for side, start, at in ((left, 0, np.unique(i)), (right, len(left), np.unique(j))):
            first = at[_first(root[at + start])]
            at, first = at[first != at], first[first != at]
            for a in range(0, len(at), BLOCK):
                p, q = at[a : a + BLOCK], first[a : a + BLOCK]
                s = np.array([score(side.v[k : k + 1], side.v[f : f + 1])[0, 0] for k, f in zip(p, q)]) if score else np.einsum("ij,ij->i", side.v[p], side.v[q])
                # surely near, so that the other task has the pair, too
                near = (s >= np.where(side.of[p] == side.of[q], same, np.inf if other is None else other) + 1e-9) & (side.ids[p] != side.ids[q])
                _tied(own, p[near] + start, q[near] + start)
        at = _tied(own, i, j + len(left))
        i, j, more = i[at], j[at], [z[at] for z in more]
    yield i, j, *more


LINKS = "a bigint, b bigint, cos double, same_class boolean"
#: From the ids and the carried columns of two blocks, and places of their pairs, to batches of a result.
Then = Callable[[np.ndarray, np.ndarray, pa.Table, pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]


def blocks_of(n: Column, dim: Column, block: int | None = None) -> Column:
    """How many blocks n rows of dim numbers are cut into. A row goes to as many block pairs, so there are BLOCKS at most as
    long as two blocks fit a task: what is shuffled grows with the rows and not with their square."""
    if block:
        return F.ceil(n / block).cast("int")
    return F.least(F.ceil(n / BLOCK), F.greatest(F.lit(BLOCKS), F.ceil(n * F.greatest(dim, F.lit(1)) / VALUES))).cast("int")


def similar_pairs(df: DataFrame, same: float, other: float | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int | None = None, score: Score | None = None, forest: bool = False, carry: tuple[str, ...] = (), then: Then | None = None, schema: str = LINKS) -> DataFrame:
    """a, b, cos, same_class of pairs a < b with a cosine of same or more in one class, other or more across (None: no such pairs).

    Vectors are taken as unit vectors: cos is their inner product, or what score gives of two matrices of vectors (a
    symmetric similarity of any kind). Null vectors take no part. With forest, only pairs that hold together the same
    components: fewer than two for a row, and one for two blocks of a group of copies. With then, what it makes (of that
    schema) of the pairs of two blocks, given the blocks' ids and carried columns.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("l"), *carry).filter("id is not null and v is not null")
    n = blocks_of(F.count("*"), F.max(F.size("v")), block).alias("n")
    if other is None:  # classes never meet: each has blocks of its own
        sizes = rows.groupBy(F.col("l").alias("of")).agg(n)
        rows = rows.join(F.broadcast(sizes) if sizes.limit(SIDE + 1).count() <= SIDE else sizes, F.col("l").eqNullSafe(F.col("of")))
    else:
        rows = rows.withColumns({"n": F.lit(max(1, rows.agg(n).first()[0] or 1)), "of": F.lit(None).cast("string")})
    blocks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y")))
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("at", F.explode(blocks)).select(F.col("id").cast("bigint").alias("id"), "v", "l", "own", "at.x", "at.y", "of", *carry)

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own, (x, y) = t.column("own").to_numpy(), (k.as_py() for k in key[1:])
        all_of = Rows.read(t)
        order = np.argsort(all_of.ids, kind="stable")
        left, right = (all_of[order[own[order] == z]] for z in (x, y))
        if then is None:
            yield from _links(left, right, x == y, same, other, score, forest)
            return
        ends = (t.select(carry).take(pa.array(order[own[order] == z])) for z in (x, y))
        yield from then(left.ids, right.ids, *ends, ((i, j) for i, j, _, _ in _hits(left, right, same, other, score, x == y)))

    spark = df.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the work is in products and not in bytes, by which Spark would put tasks together
    return dealt.repartition(tasks, "of", "x", "y").groupBy("of", "x", "y").applyInArrow(multiply, schema)


#: Pairs whose keypoints a task matches at once.
MATCHED = 2048


class Keypoints:
    """Items' keypoints from Arrow columns xy and desc (lists of lists), stacked by how many an item has."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        xy, desc = ((c.combine_chunks() if isinstance(c := t.column(n), pa.ChunkedArray) else c) for n in ("xy", "desc"))
        self.many = pc.fill_null(pc.list_value_length(desc), 0).to_numpy(zero_copy_only=False).astype(int)
        self.place, self.stacks = np.zeros(len(self.many), int), {}
        for k in np.unique(self.many[self.many > 0]):
            at = np.flatnonzero(self.many == k)
            self.place[at] = np.arange(len(at))
            self.stacks[k] = tuple(c.take(pa.array(at)).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), k, -1) for c in (xy, desc))


def verified_pairs(df: DataFrame, same: float, other: float | None = None, least: int = 8, ratio: float = 0.8, inliers: bool = True, **more) -> DataFrame:
    """a, b, matches, inliers (null unless asked for) of the pairs of similar_pairs() with least keypoint matches or more; df has
    keypoints, too (xy, desc), in arrays of arrays.

    Pairs are verified where they are found, by the keypoints of two blocks, so these are shuffled by items and not by pairs.
    """

    def check(ids: np.ndarray, others: np.ndarray, mine: pa.Table, theirs: pa.Table, hits: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        points, names = Keypoints(pa.concat_tables([mine, theirs])), np.r_[ids, others]
        for i, j in hits:
            j = j + len(ids)
            back = names[i] > names[j]
            i, j = np.where(back, j, i), np.where(back, i, j)
            kinds, kind = np.unique(np.stack([points.many[i], points.many[j]]), axis=1, return_inverse=True)
            for n, (k, l) in enumerate(kinds.T):
                if k < least or l < 2:  # a keypoint has one match at most
                    continue
                some = np.flatnonzero(kind == n)
                for start in range(0, len(some), MATCHED):
                    at = some[start : start + MATCHED]
                    a, b = i[at], j[at]
                    (xa, da), (xb, db) = ([z[points.place[e]] for z in points.stacks[m]] for e, m in ((a, k), (b, l)))
                    hit, near = graphs.all_matches(da, db, ratio)
                    found = hit.sum(1)
                    good = np.flatnonzero(found >= least)
                    if len(good):
                        yield pa.RecordBatch.from_pydict({"a": pa.array(names[a[good]], pa.int64()), "b": pa.array(names[b[good]], pa.int64()), "matches": pa.array(found[good], pa.int32()), "inliers": _fitting(xa[good], xb[good], hit[good], near[good]) if inliers else pa.nulls(len(good), pa.int32())})

    return similar_pairs(df, same, other, carry=("xy", "desc"), then=check, schema="a bigint, b bigint, matches int, inliers int", **more)


def _fitting(xa: np.ndarray, xb: np.ndarray, hit: np.ndarray, near: np.ndarray) -> pa.Array:
    """Inliers of each pair's matches: keypoints hit of a with those near them of b."""
    found, out = hit.sum(1), np.zeros(len(hit), np.int32)
    for n in np.unique(found):
        at = np.flatnonzero(found == n)
        i = np.nonzero(hit[at])[1].reshape(len(at), n)
        out[at] = graphs.all_inliers(xa[at[:, None], i], xb[at[:, None], np.take_along_axis(near[at], i, 1)])
    return pa.array(out, pa.int32())


@dataclass
class Tables:
    """Hash tables of sign projections: tables of bits signs each; a row asks at its own code and, of the bits whose
    projections are smallest, at those with one of flips bits turned."""

    tables: int
    bits: int
    flips: int
    dim: int
    seed: int = 0

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.dim, self.tables * self.bits))

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[rows, tables] own codes and [rows, tables, 1 + flips] codes asked for, the own first."""
        p = (v @ self.planes()).reshape(len(v), self.tables, self.bits)
        own = ((p > 0) << np.arange(self.bits)).sum(2)
        weak = np.argsort(np.abs(p), axis=2, kind="stable")[:, :, : self.flips]
        return own, np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << weak)], 2)

    @classmethod
    def plan(cls, rows: int, dim: int, least: float, recall: float, flips: int = 6, seed: int = 0, bits: int | None = None) -> Tables:
        """Bits by the number of rows, and as many tables as find a pair of cosine least with probability recall; measured
        on pairs of random directions of exactly that cosine (the chance depends on the angle alone)."""
        bits = bits or int(np.clip(np.ceil(np.log2(max(rows, 2) / 16)), 4, 40))
        flips = min(flips, bits)
        rng = np.random.default_rng(seed + 1)
        x = np.linalg.qr(rng.normal(size=(4096, max(dim, 2), 2)))[0]
        a, b = x[:, :, 0], least * x[:, :, 0] + np.sqrt(max(0.0, 1 - least * least)) * x[:, :, 1]
        one = cls(1, bits, flips, max(dim, 2), seed + 2)
        found = np.mean((one.codes(a)[1][:, 0] == one.codes(b)[0]).any(1) | (one.codes(b)[1][:, 0] == one.codes(a)[0]).any(1))
        found = max(float(found) - 2 * np.sqrt(found * (1 - found) / 4096), 1e-4)
        return cls(max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - found)))) if found < 1 else 1, bits, flips, dim, seed)

    @property
    def copies(self) -> int:
        return self.tables * (1 + self.flips)

    @classmethod
    def cheapest(cls, rows: int, dim: int, least: float, recall: float, blocks: int) -> Tables | None:
        """The plan whose copies of a row and products with it cost least, by large or small buckets; None if it costs less
        to multiply all rows, in so many blocks, each row then being copied as often."""
        best, cost = None, blocks * COPY + rows / 2
        for bits in range(4, int(np.clip(np.ceil(np.log2(max(rows, 2) / 16)), 4, 40)) + 1, 2):
            for flips in (0, 6):
                t = cls.plan(rows, dim, least, recall, flips, bits=bits)
                spent = t.copies * (COPY + rows / 2**bits / 2)
                if spent < cost:
                    best, cost = t, spent
        return best


#: What it costs to copy a row to another task, in products.
COPY = 20_000
#: Rows that a task works through together where buckets are smaller.
BATCH = 4096


def _met(one: DataFrame, n: int, t: Tables, same: float, other: float | None, block: int, forest: bool) -> DataFrame:
    """a, b, cos, same_class of the pairs of different rows (id, v, l), n in number, that meet in a bucket of the tables."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = 1 + t.flips
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                v = np.stack(c.column("v").to_numpy(zero_copy_only=False))
                codes = t.codes(v)[1] + (np.arange(t.tables) << t.bits)[None, :, None]
                at = pa.array(np.repeat(np.arange(c.num_rows), t.tables * ask))
                own = np.tile(np.arange(ask) == 0, c.num_rows * t.tables)
                yield pa.RecordBatch.from_pydict({n: c.column(n).take(at) for n in ("id", "v", "l")} | {"code": pa.array(codes.reshape(-1)), "home": pa.array(own)})

    told = written(one.select("id", "v", "l").mapInArrow(hashed, "id bigint, v array<double>, l string, code bigint, home boolean"), "hashed")
    bucket = F.xxhash64("code", "l") if other is None else F.col("code")
    told = told.withColumn("bucket", bucket)
    counts = told.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("n"))
    kept = told.join(counts, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y")))
    dealt = kept.withColumn("at", F.explode(blocks)).select("bucket", "id", "v", "l", "own", "at.x", "at.y")
    batch = F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(max(1, n * t.copies // BATCH))).alias("batch")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        rows, own = Rows.read(table), table.column("own").to_numpy()
        place = np.stack([table.column(c).to_numpy() for c in ("bucket", "x", "y")], 1)
        order = np.lexsort((rows.ids, *place.T[::-1]))
        place = place[order]
        cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, len(place)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            part, (_, x, y) = order[a:z], place[a]
            left, right = (rows[part[own[part] == k]] for k in (x, y))
            yield from _links(left, right, x == y, same, other, None, forest)

    return dealt.groupBy(batch).applyInArrow(multiply, LINKS).dropDuplicates(["a", "b"])


def hashed_pairs(df: DataFrame, same: float, other: float | None = None, recall: float = 0.999, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int | None = None, tables: Tables | None = None, forest: bool = False) -> DataFrame:
    """The pairs of similar_pairs(), each with a probability of recall or more; none that similar_pairs() does not give.

    Rows are kept in hash tables of sign projections under their code, and asked for under it and a few codes near it, so
    what is shuffled grows with the rows and not with their square: rows times tables times (1 + flips). Within a bucket
    cosines are exact. A bucket of more than block rows is dealt in block pairs. Without tables given, the plan of least
    cost is taken; where no tables cost less than the few copies of a row that similar_pairs() makes, it is that, and no
    pair is missed. Copies of one vector and class are one row; without forest all their pairs are given, with it one link each.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l")).filter("id is not null and v is not null")
    one = written(rows.groupBy("v", "l").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    size = one.agg(F.count("*"), F.max(F.size("v")), blocks_of(F.count("*"), F.max(F.size("v")), block)).first()
    empty = rows.sparkSession.createDataFrame([], "a bigint, b bigint, cos double, same_class boolean")
    if not size[0]:
        return empty
    if tables is None:
        tables = Tables.cheapest(size[0], size[1], min(x for x in (same, other) if x is not None), recall, size[2])
    found = similar_pairs(one, same, other, "id", "v", "l", block, forest=forest) if tables is None else _met(one, size[0], tables, same, other, block or BLOCK, forest)
    copies = rows.join(one.filter("n > 1").select(F.col("id").alias("first"), F.col("v").alias("_v"), F.col("l").alias("_l")), (F.col("v") == F.col("_v")) & F.col("l").eqNullSafe(F.col("_l")))
    norm = F.aggregate("v", F.lit(0e0), lambda s, x: s + x * x)
    if forest:
        own = copies.filter(F.col("first") != F.col("id")).filter(norm >= same)
        return found.unionByName(own.select(F.col("first").alias("a"), F.col("id").alias("b"), norm.alias("cos"), F.lit(True).alias("same_class")))
    copies = written(copies.select("first", "id", norm.alias("norm")), "copies")
    ends = found
    for end in ("a", "b"):  # each end once for each of its copies
        all_of = copies.select(F.col("first").alias(end), F.col("id").alias("_as"))
        ends = ends.join(all_of, end, "left").withColumn(end, F.coalesce("_as", end)).drop("_as")
    ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos", "same_class")
    within = copies.filter(F.col("norm") >= same).alias("x").join(copies.alias("y"), (F.col("x.first") == F.col("y.first")) & (F.col("x.id") < F.col("y.id")))
    return ends.unionByName(within.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.norm").alias("cos"), F.lit(True).alias("same_class")))


def hash_bands(high: str, low: str, bands: int) -> list[Column]:
    """The bands of a 64-bit hash (two numbers of 32 bits) as text; band i has the bits round(64 i / bands) and on, low ones first."""
    edges = [round(i * 64 / bands) for i in range(bands + 1)]

    def band(a: int, z: int) -> Column:
        parts = []
        for name, start in ((low, 0), (high, 32)):
            x, y = max(a, start) - start, min(z, start + 32) - start
            if x < y:
                parts.append(F.shiftright(F.col(name), x).bitwiseAND(F.lit((1 << (y - x)) - 1)))
        return F.concat_ws(":", *[p.cast("string") for p in parts])

    return [band(a, z) for a, z in zip(edges, edges[1:])]


#: Rows of a class and band value that are joined pair by pair at most; rows of a block of more; pairs whose bits are
#: counted at once, as many as a processor's cache holds; tasks for each core.
CROWD, CROWD_BLOCK, BITS, TASKS = 256, 8192, 1 << 18, 8


def _close(x: np.ndarray, y: np.ndarray, most: int, earlier: list[int], alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, bits of the pairs of hashes of 64 bits that differ in at most most bits but in each of the earlier bands, slice
    by slice; alone (x and y are the same): those with i < j."""
    tall = max(1, BITS // max(1, len(y)))
    for a in range(0, len(x), tall):
        start = a if alone else 0
        other = x[a : a + tall, None] ^ y[None, start:]
        bits = np.bitwise_count(other)
        i, j = np.nonzero(bits <= most)
        keep = i < j if alone else np.ones(len(i), bool)
        for mask in earlier:
            keep &= (other[i, j] & np.uint64(mask)) != 0
        i, j = i[keep], j[keep]
        if len(i):
            yield i + a, j + start, bits[i, j]


def close_hashes(df: DataFrame, most: int, key: str = "vec_id", high: str = "high", low: str = "low", label: str = "label", bands: int | None = None, crowd: int = CROWD, block: int = CROWD_BLOCK) -> DataFrame:
    """a, b, bits: pairs a < b of one class whose 64-bit hashes differ in at most most bits.

    Hashes within most bits agree in one of most + 1 bands at least, so equal bands (and the class) are join keys
    and nothing is lost; a pair is kept in the first band it shares only. A band value of more than crowd rows is cut into
    blocks by the rows' ids; every two of them meet in a group of their own, which counts the bits of a slice of pairs at once,
    and groups are dealt to many tasks, whatever their bytes. Rows with a null are in no pair.
    """
    both = F.shiftleft(F.col(high).cast("bigint"), 32).bitwiseOR(F.col(low).cast("bigint"))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("l"), both.alias("x")).dropna()
    edges = [round(i * 64 / (bands or most + 1)) for i in range((bands or most + 1) + 1)]
    masks = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    of_band = lambda x, n: x.bitwiseAND(F.lit(signed(masks[n])))
    one = rows.select("*", F.posexplode(F.array(*[of_band(F.col("x"), n) for n in range(len(masks))])).alias("n", "band"))
    at = ["l", "n", "band"]
    met = one.groupBy(*at).agg(F.count("*").alias("m")).filter("m > 1")
    one = written(one.join(met, at), "bands")

    few = one.filter(F.col("m") <= crowd).drop("m")
    other = F.col("p.x").bitwiseXOR(F.col("q.x"))
    new = F.lit(True)
    for n in range(len(masks) - 1):  # no earlier band is the same
        new &= (F.col("p.n") <= n) | (of_band(other, n) != 0)
    same = (F.col("p.l") == F.col("q.l")) & (F.col("p.n") == F.col("q.n")) & (F.col("p.band") == F.col("q.band")) & (F.col("p.id") < F.col("q.id"))
    bits = F.bit_count(other)
    found = few.alias("p").join(few.alias("q"), same & (bits <= most) & new).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), bits.alias("bits"))

    many = one.filter(F.col("m") > crowd).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    spark = df.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = many.withColumn("at", F.explode(meets)).select("id", "x", *at, "own", "at.i", "at.j").repartition(tasks, *at, "i", "j")

    def count(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        n, i, j = (group[k].as_py() for k in (1, 3, 4))
        own = t.column("own").to_numpy()
        (left, x), (right, y) = ((side.column("id").combine_chunks(), side.column("x").to_numpy().view(np.uint64)) for side in (t.filter(pa.array(own == k)) for k in (i, j)))
        for p, q, d in _close(x, y, most, masks[:n], i == j):
            yield pa.RecordBatch.from_arrays([left.take(pa.array(p)), right.take(pa.array(q)), pa.array(d.astype(np.int32))], ["a", "b", "bits"])

    kind = rows.schema["id"].dataType.simpleString()
    crowded = pairs.groupBy(*at, "i", "j").applyInArrow(count, f"a {kind}, b {kind}, bits int")
    return found.unionByName(crowded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").filter("a < b"))


def held(df: DataFrame, *columns: str, most: int = SIDE) -> pd.DataFrame:
    """A reference side that every task gets: collected only if it has no more than most rows."""
    pdf = df.select(*columns).limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError(f"the reference side has more than {most} rows; use similar_pairs, nearest_in_blocks or cache_scores_in_blocks")
    return pdf


def fits(side: DataFrame) -> bool:
    """Whether every task may hold side."""
    return side.limit(SIDE + 1).count() <= SIDE


def _best(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each row of v the row of m of largest inner product, the first of equal ones; so many cells at once as CELLS says."""
    best, top = np.zeros(len(v), np.int64), np.full(len(v), -np.inf)
    wide = min(8192, len(m))
    tall = max(1, CELLS // wide)
    for a in range(0, len(v), tall):
        for c in range(0, len(m), wide):
            s = v[a : a + tall] @ m[c : c + wide].T
            at = s.argmax(1)
            s, so_far = s[np.arange(len(s)), at], top[a : a + tall]
            more = (s > so_far) | (np.isnan(s) & ~np.isnan(so_far))
            best[a : a + tall][more], so_far[more] = at[more] + c, s[more]
    return best


def _different(m: np.ndarray) -> np.ndarray:
    """The places of the first of equal rows, so that rounding cannot choose between them."""
    return np.flatnonzero(~pd.Series([x.tobytes() for x in m + 0.0]).duplicated().to_numpy())


def _dealt(queries: DataFrame, side: DataFrame, block: int) -> DataFrame:
    """x, y, id, v, h, extra, asks: rows of queries (columns id, v, h) and side (id, v, extra), dealt to pairs of their blocks."""
    nx, ny = (max(1, -(-df.count() // block)) for df in (queries, side))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select("id", F.col("v").cast("array<double>").alias("v"), "h", F.lit(None).cast("int").alias("extra"), F.lit(True).alias("asks"), own(nx, "id", "h").alias("x"), all_of(ny).alias("y"))
    held_ = side.select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).cast("bigint").alias("h"), F.col("extra").cast("int").alias("extra"), F.lit(False).alias("asks"), all_of(nx).alias("x"), own(ny, "id").alias("y"))
    return asks.union(held_)


def _questions(queries: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v, h: h tells different vectors of one key apart."""
    return queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.xxhash64(F.col(vector).cast("array<double>")).alias("h"))


def nearest_in_blocks(queries: DataFrame, side: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: str | None = None, block: int = MEET) -> DataFrame:
    """The same as nearest(), for a side of any size: the best of each pair of blocks, then the best of those."""
    asked = _questions(queries, key, vector)
    rows = _dealt(asked.dropDuplicates(["id", "h"]), side.select(F.col(key).alias("id"), F.col(vector).alias("v"), (F.col(carry) if carry else F.lit(None)).alias("extra")), block)

    def best(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        q, r = t.filter(t.column("asks")), t.filter(pc.invert(t.column("asks"))).sort_by("id")
        if len(q) and len(r):
            v, m = _stacked(q.column("v")), _stacked(r.column("v"))
            some = _different(m)
            at = some[_best(v, m[some])]
            yield pa.RecordBatch.from_pydict({"id": q.column("id").combine_chunks(), "h": q.column("h").combine_chunks(), "near_id": r.column("id").combine_chunks().take(pa.array(at)), "cos": pa.array(np.einsum("ij,ij->i", v, m[at])), "carry": r.column("extra").combine_chunks().take(pa.array(at))})

    found = rows.groupBy("x", "y").applyInArrow(best, "id bigint, h bigint, near_id bigint, cos double, carry int")
    top = found.groupBy("id", "h").agg(F.max(F.struct("cos", (-F.col("near_id")).alias("back"), "carry")).alias("top")).select(F.col("id").alias("i2"), F.col("h").alias("h2"), "top")
    got = asked.join(top, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    return got.select(F.col("id").alias(key), (-F.col("top.back")).alias("near_id"), F.col("top.cos").alias("cos"), *([F.col("top.carry").alias(f"near_{carry}")] if carry else []))


def _kernel_sums(v: np.ndarray, keys: np.ndarray, beta: float, weights: np.ndarray) -> np.ndarray:
    """exp(-beta (1 - v keys')) weights, so many cells at once as CELLS says."""
    out = np.zeros((len(v), weights.shape[1]))
    wide = min(8192, max(1, len(keys)))
    tall = max(1, CELLS // wide)
    for a in range(0, len(v), tall):
        for c in range(0, len(keys), wide):
            s = v[a : a + tall] @ keys[c : c + wide].T
            s -= 1
            s *= beta
            out[a : a + tall] += np.exp(s, out=s) @ weights[c : c + wide]
    return out


def cache_scores_in_blocks(queries: DataFrame, support: DataFrame, beta: float = 5.0, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = MEET) -> DataFrame:
    """key, class, summed, balanced: cache_scores() of both kinds, for a support set of any size and unique keys of queries."""
    rows = _dealt(_questions(queries, key, vector), support.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("extra")), block)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        q, r = t.filter(t.column("asks")), t.filter(pc.invert(t.column("asks")))
        if len(q) and len(r):
            classes, of = np.unique(r.column("extra").to_numpy().astype(int), return_inverse=True)
            z = _kernel_sums(_stacked(q.column("v")), _stacked(r.column("v")), beta, (of[:, None] == np.arange(len(classes))).astype(np.float64))
            ids = q.column("id").combine_chunks().take(pa.array(np.repeat(np.arange(len(q)), len(classes))))
            yield pa.RecordBatch.from_pydict({"id": ids, "class": pa.array(np.tile(classes, len(q)), pa.int32()), "part": pa.array(z.reshape(-1))})

    parts = rows.groupBy("x", "y").applyInArrow(add, "id bigint, class int, part double")
    counts = support.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    summed = parts.groupBy("id", "class").agg(F.sum("part").alias("summed")).join(counts, "class")
    return summed.select(F.col("id").alias(key), "class", "summed", (F.col("summed") / F.col("n")).alias("balanced"))


def nearest(queries: DataFrame, side: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: str | None = None) -> DataFrame:
    """key, near_id, cos (and near_<carry>): the row of side with the largest inner product, ties to the smaller key.

    A side of at most SIDE rows is held by every task and queries stream through; a larger one is worked through in
    blocks. An empty side gives nulls.
    """
    if not fits(side):
        return nearest_in_blocks(queries, side, key, vector, carry)
    names = [key, vector, *([carry] if carry else [])]
    ref = held(side, *names, most=SIDE).sort_values(key)
    m = _matrix(ref[vector])
    some = _different(m) if len(m) else np.zeros(0, int)
    m, ids, extra = m[some], ref[key].to_numpy()[some], ref[carry].to_numpy()[some] if carry else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _stacked(b.column("v"))
            out = {"id": b.column("id")}
            if len(ids):
                best = _best(v, m) if len(v) else np.zeros(0, int)
                out |= {"near_id": pa.array(ids[best], pa.int64()), "cos": pa.array(np.einsum("ij,ij->i", v, m[best]) if len(v) else np.zeros(0), pa.float64())}
            else:
                out |= {"near_id": pa.nulls(b.num_rows, pa.int64()), "cos": pa.nulls(b.num_rows, pa.float64())}
            if carry:
                out["carry"] = pa.array(extra[best], pa.int32()) if len(ids) else pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_pydict(out)

    schema = "id bigint, near_id bigint, cos double" + (", carry int" if carry else "")
    got = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema).withColumnRenamed("id", key)
    return got.withColumnRenamed("carry", f"near_{carry}") if carry else got


def tile_margins(tiles: DataFrame, positives: DataFrame, negatives: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 1024) -> DataFrame:
    """key, margin, tile: of an item's tiles (numbered in column tile, fewer than most) the largest nearness to a positive
    less that to a negative, and which tile has it (the first of equal ones)."""
    each = tiles.withColumn("_t", F.col(key) * most + F.col("tile"))
    near = lambda side, name: nearest(each, side.withColumn("_t", F.col(key)), "_t", vector).select("_t", F.col("cos").alias(name))
    both = near(positives, "p").join(near(negatives, "n"), "_t").select(F.floor(F.col("_t") / most).cast("bigint").alias(key), (F.col("_t") % most).cast("int").alias("tile"), (F.col("p") - F.col("n")).alias("margin"))
    top = both.groupBy(key).agg(F.max(F.struct("margin", (-F.col("tile")).alias("back"))).alias("top"))
    return top.select(key, F.col("top.margin").alias("margin"), (-F.col("top.back")).alias("tile"))


def linked(rows: DataFrame, to: DataFrame, edges: DataFrame | None, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The keys of rows with an edge (a, b) to a row of to, in either direction, or with a cosine of least or more to one."""
    close = nearest(rows, to, key, vector).filter(F.col("cos") >= least).select(key)
    if edges is None:
        return close.distinct()
    ends = edges.select(F.col("a").alias(key), F.col("b").alias("_o")).union(edges.select(F.col("b"), F.col("a")))
    seen = ends.join(to.select(F.col(key).alias("_o")), "_o", "left_semi").join(rows.select(key), key, "left_semi").select(key)
    return seen.union(close).distinct()


def scores(queries: DataFrame, classes: pd.DataFrame, times: float = 100.0, key: str = "vec_id", vector: str = "embedding", name: str = "z") -> DataFrame:
    """key, class, z = times the inner product with each class's vector (class, vec): a few rows, held by every task."""
    ref = classes.sort_values("class")
    return _classwise(queries, key, vector, lambda v: times * v @ _matrix(ref["vec"]).T, ref["class"].to_numpy(), name)


def cache_scores(queries: DataFrame, support: pd.DataFrame, beta: float = 5.0, balanced: bool = True, key: str = "vec_id", vector: str = "embedding", name: str = "z") -> DataFrame:
    """key, class, z: sum over a class's support rows (label, vec) of exp(-beta (1 - cos)), over their number if balanced."""
    keys, labels = _matrix(support["vec"]), support["label"].to_numpy()
    classes = np.unique(labels)
    weights = (labels[:, None] == classes).astype(np.float64)
    if balanced:
        weights /= np.maximum(1, weights.sum(0))
    return _classwise(queries, key, vector, lambda v: _kernel_sums(v, keys, beta, weights), classes, name)


def score_parts(queries: DataFrame, classes: pd.DataFrame, support: pd.DataFrame, beta: float = 5.0, times: float = 100.0, balanced: bool = True, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, class, text, cache: scores() and cache_scores() of the classes in one pass, without a join. A class without support has cache 0."""
    ref = classes.sort_values("class")
    names, text, keys = ref["class"].to_numpy(), _matrix(ref["vec"]), _matrix(support["vec"])
    weights = (support["label"].to_numpy()[:, None] == names).astype(np.float64)
    if balanced:
        weights /= np.maximum(1, weights.sum(0))
    both = lambda v: (times * v @ text.T, _kernel_sums(v, keys, beta, weights) if len(keys) else np.zeros((len(v), len(names))))
    return _classwise(queries, key, vector, both, names, "text", "cache")


def _classwise(queries: DataFrame, key: str, vector: str, fn, classes: np.ndarray, *names: str) -> DataFrame:
    """A row for each row and class; fn gives one matrix [rows, classes], or one for each of several names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = fn(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64))
                z = z if isinstance(z, tuple) else (z,)
                yield pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), len(classes)))), "class": pa.array(np.tile(classes, b.num_rows), pa.int32())} | {f"z{i}": pa.array(x.reshape(-1)) for i, x in enumerate(z)})

    columns = ", ".join(f"z{i} double" for i in range(len(names)))
    return queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"id bigint, class int, {columns}").toDF(key, "class", *names)
