"""Exact Jaccard join of word shingles, by prefixes that grow with what they are estimated to cost.

A document is the set of its shingles. All sets are put in one global order, rare shingles first. If two sets of sizes n
and m share t elements or more, the first n - t + l of the one and the first m - t + l of the other share l at least. So
only prefixes are indexed, and a document may choose its l: a longer prefix costs postings, but asks of every candidate
that it shares more. Of two documents, the smaller l holds.

1. How often each shingle occurs is counted over all documents in a fixed number of cells. Noise of other shingles in a
   cell grows with the square root of the data only, so common shingles stand out at every size. Cell count and hash are
   the global order; any order gives the same links, this one keeps postings short.
2. Equal sets are one node. A node's l is the one, of 1 to LONGEST, of the least estimated cost.
3. The nodes of like size that have a shingle in their shortest prefixes are a bucket. Every member meets the bucket's smallest node: as many pairs as rows. A pair
   is a candidate if sizes allow a link, the prefixes share the smaller l, and what they share, with all that may follow
   after the prefix that ends first, can still make a link. Only candidates' sets are fetched and compared exactly.
4. Links make components. Buckets that still hold several are worked through in block pairs, in which the shared prefix
   shingles of all pairs of different components are counted through postings: first to find the nodes that have a
   candidate, then, with their sets, to compare. Only links that join components become rows.

So pairs are never written out within a bucket, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import common_values, release, spread_join, staged, texts, tune
from verdigris.llm.minhash import FAN, repeated, shingles, small, unresolved
from verdigris.operators.graphs import components

#: Words of a shingle; least similarity in hundredths.
WORDS, LEAST = 3, 90
#: Cells of the frequency table (a power of 2), and of a chunk of it.
CELLS, CHUNK = 1 << 21, 1 << 14
#: Largest l; what one exact comparison costs, in postings.
LONGEST, COMPARISON = 4, 8
#: Tables of counts that each cell is added up from in the second step. Bits of an element by which it is counted who else has it.
DEALS, SHORT = 8, 40
#: Width of a class of sizes, in steps of the largest ratio that links. Rows of block pairs that go to a task at once, about.
STEPS, BATCH = 3, 512
_SHIFT = np.uint64(64 - CELLS.bit_length() + 1)


class Words(dict):
    """64-bit hashes of words; stops growing at a size."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = h
        return h


def elements(text: str, known: Words, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text. Words are what ASCII white space leaves, A-Z in lower case; fewer
    words than a shingle has are one."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return shingles(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), words)[0]


def least_shared(n: int, least: int = LEAST) -> int:
    """Elements that a set of n shares at least with any that it links with."""
    return -(-n * least // 100)


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.int64)


def narrow(n: np.ndarray) -> bytes:
    """Counts as bytes: the number of bytes that the largest takes, then all of them in as many."""
    size = next(b for b in (1, 2, 4, 8) if n.max() < 1 << 8 * b - (b == 8))
    return bytes([size]) + n.astype(f"u{size}").tobytes()


def widened(n: bytes) -> np.ndarray:
    return np.frombuffer(n, f"u{n[0]}", offset=1).astype(np.int64)


def frequencies(df: DataFrame, text: str, words: int = WORDS) -> np.ndarray:
    """[CELLS] how many documents' shingles fall into each cell, over all rows of df.

    Tasks give their counts in chunks, added up in two steps; a table of fixed size is all that comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, waiting, size = Words(), np.zeros(CELLS, np.int64), [], 0
        for b in batches:
            for t in texts(b, "text"):
                waiting.append(cells(elements(t, known, words)))
                size += len(waiting[-1])
                if size > CELLS:
                    total += np.bincount(np.concatenate(waiting), minlength=CELLS)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=CELLS)
        for c in range(0, CELLS, CHUNK):
            at = np.flatnonzero(total[c : c + CHUNK])
            if len(at):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c // CHUNK], pa.int32()), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([narrow(total[c + at])], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for at, n in zip(pdf["at"], pdf["n"]):
            total[np.frombuffer(at, np.uint16)] += widened(n)
        at = np.flatnonzero(total)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "deal": 0, "at": [at.astype(np.uint16).tobytes()], "n": [narrow(total[at])]})

    schema = "chunk int, deal int, at binary, n binary"
    rows = df.select(F.col(text).alias("text")).mapInArrow(count, "chunk int, at binary, n binary").withColumn("deal", F.spark_partition_id() % DEALS)
    sums = rows.groupBy("chunk", "deal").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    out = np.zeros(CELLS, np.int64)
    for r in sums.toLocalIterator():
        out[r["chunk"] * CHUNK + np.frombuffer(r["at"], np.uint16).astype(np.int64)] = widened(r["n"])
    return out


def prefix(h: np.ndarray, table: np.ndarray, noise: float, least: int = LEAST, longest: int = LONGEST) -> tuple[int, np.ndarray, int]:
    """l, the first elements of a set in the global order that it asks for, and the cell count of the last of them.

    A prefix of l is estimated to meet one document for each posting that its cells have above the noise. They must all be
    gone through, and a document that shares l of them is met l times, so at most an l-th is compared.
    """
    count = table[cells(h)]
    order = np.argsort(count, kind="stable")  # elements are sorted, so equal counts are in order of the hash
    shared = least_shared(len(h), least)
    sizes = np.minimum(len(h) - shared + np.arange(1, min(longest, shared) + 1), len(h))
    met = np.cumsum(np.maximum(0.0, count[order[: sizes[-1]]] - 1 - noise))[sizes - 1]
    l = int(np.argmin(sizes + met + COMPARISON * met / np.arange(1, len(sizes) + 1))) + 1
    first = order[: sizes[l - 1]]
    return l, h[first], int(count[first[-1]])


def prefixes(df: DataFrame, key: str, text: str, table: np.ndarray, words: int = WORDS, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """key, told (hash of the text), same (identity of the set, null of an empty one), size, l, prefix, edge (the cell count of its last element) of every row."""
    noise = float(table.mean() + 2 * np.sqrt(table.mean()))
    held = df.sparkSession.sparkContext.broadcast(table)
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("told"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Words(), held.value
        for b in batches:
            sets = [elements(t, known, words) for t in texts(b)]
            found = [prefix(h, counts, noise, least, longest) if len(h) else (0, h, 0) for h in sets]
            yield pa.RecordBatch.from_pydict({
                "key": b.column("key"), "told": b.column("told"), "same": pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary()), "size": pa.array([len(h) for h in sets], pa.int32()),
                "l": pa.array([l for l, _, _ in found], pa.int32()), "prefix": pa.array([p.view(np.int64) for _, p, _ in found], pa.list_(pa.int64())), "edge": pa.array([e for *_, e in found], pa.int64()),
            })

    return rows.mapInArrow(run, "key " + rows.schema["key"].dataType.simpleString() + ", told bigint, same binary, size int, l int, prefix array<bigint>, edge bigint")


def sets_of(df: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """node, elements of the nodes (node, rep, told), from the row that stands for each. Where that row is repeated, so is the node."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    rows = rows.join(small(nodes), F.col("__key").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("told")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "elements": pa.array([elements(t, known, words).tobytes() for t in texts(b)], pa.binary())})

    return rows.select("node", "text").mapInArrow(run, "node bigint, elements binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether the intersection is least hundredths of the union or more."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < least * high:
        return False
    both = common(a, b)
    return 100 * both >= least * (low + high - both)


class Front:
    """Sizes, l and prefixes of nodes, for the test by prefixes."""

    def __init__(self, size: np.ndarray, l: np.ndarray, first: list[np.ndarray], edge: np.ndarray):
        self.size, self.l, self.first, self.edge = size.astype(np.int64), l, first, edge
        self.rest = self.size - np.array([len(x) for x in first], np.int64)
        self.last = np.array([x[-1] for x in first], np.uint64)

    def fits(self, i: int | np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
        """Which pairs are of sizes that allow a link."""
        n, m = self.size[i], self.size[j]
        return 100 * np.minimum(n, m) >= least * np.maximum(n, m)

    def possible(self, i: int | np.ndarray, j: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
        """Which of the nodes i and j, whose prefixes share so many elements, may be linked.

        All that two sets share up to the end of the prefix that ends first is in both prefixes; beyond it they share no
        more than the set of that prefix has left.
        """
        n, m = self.size[i], self.size[j]
        ends_first = (self.edge[i] < self.edge[j]) | ((self.edge[i] == self.edge[j]) & (self.last[i] <= self.last[j]))
        most = shared + np.where(ends_first, self.rest[i], self.rest[j])
        return self.fits(i, j, least) & (shared >= np.minimum(self.l[i], self.l[j])) & ((100 + least) * most >= least * (n + m))


def both_ends(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of side (node, ...) for each end, a_ and b_ before their names.

    a may recur any number of times: its row goes to as many places as hold FAN pairs each.
    """
    names = [c for c in side.columns if c != "node"]
    fans = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans")), "fans", 0)
    left = side.join(fans, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = side.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    dealt = pairs.join(small(fans.filter("fans > 1")), "a", "left").withColumn("fan", F.coalesce(F.pmod(F.xxhash64("b"), F.col("fans")).cast("int"), F.lit(0))).drop("fans")
    return dealt.join(right, "b").join(left, ["a", "fan"]).drop("fan")


def candidates(pairs: DataFrame, fronts: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) that may be linked by their prefixes; fronts: node, size, l, prefix, edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            first = [x.values.to_numpy().view(np.uint64) for c in ("a_prefix", "b_prefix") for x in b.column(c)]
            front = Front(*(np.concatenate([b.column(f"{e}_{c}").to_numpy() for e in "ab"]) for c in ("size", "l")), first, np.concatenate([b.column(f"{e}_edge").to_numpy() for e in "ab"]))
            shared = np.array([common(np.sort(x), np.sort(y)) for x, y in zip(first[:n], first[n:])], np.int64)
            keep = front.possible(np.arange(n), np.arange(n, 2 * n), shared, least)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both_ends(pairs, fronts).select("a", "b", *[f"{e}_{c}" for e in "ab" for c in ("size", "l", "prefix", "edge")]).mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The linked ones of pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(b.column("a_elements"), b.column("b_elements"))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both_ends(pairs, sets).select("a", "b", "a_elements", "b_elements").mapInArrow(run, "a bigint, b bigint")


class Block:
    """The nodes of a block pair of minhash.unresolved(), with size, l, prefix and edge: arrays and lists by column."""

    def __init__(self, of: dict, least: int):
        self.node, self.side, self.here, self.least = of["node"], of["side"], of["band"][0], least
        self.alone, self.opened = of["x"][0] == of["y"][0], of["open"]
        self.label = np.unique(of["root"], return_inverse=True)[1]
        first = [x.view(np.uint64) for x in of["prefix"]]
        self.front = Front(of["size"], of["l"], first, of["edge"])
        # postings of the prefix shingles: rows of equal shingles are next to each other
        row = np.repeat(np.arange(len(first)), list(map(len, first)))
        order = np.argsort(np.concatenate(first), kind="stable")
        self.token, self.row = np.concatenate(first)[order], row[order]

    @staticmethod
    def of_table(pdf: pd.DataFrame, least: int) -> Iterator[tuple[Block, np.ndarray]]:
        """The block pairs of a table of many, with the places of their rows; without those in which no sizes allow a link."""
        order = np.lexsort((pdf["node"], pdf["y"], pdf["x"], pdf["band"]))
        columns = {c: pdf[c].to_numpy()[order] for c in ("band", "x", "y", "node", "side", "root", "open", "size", "l", "prefix", "edge")}
        new = np.zeros(len(pdf), bool)
        for c in ("band", "x", "y"):
            new[1:] |= columns[c][1:] != columns[c][:-1]
        for a, z in zip(np.r_[0, np.flatnonzero(new)], np.r_[np.flatnonzero(new), len(pdf)]):
            size = np.sort(columns["size"][a:z].astype(np.int64))
            if (100 * size[:-1] >= least * size[1:]).any():
                yield Block({c: x[a:z] for c, x in columns.items()}, least), order[a:z]

    def partners(self, i: int) -> np.ndarray:
        """Nodes of other components that may be linked with i, each pair once and in the first bucket that both have open."""
        n = len(self.node)
        other = (np.arange(n) > i) if self.alone else (self.side > self.side[i])
        other &= (self.label != self.label[i]) & self.front.fits(i, np.arange(n), self.least)
        if not other.any():
            return np.zeros(0, np.int64)
        a, z = (np.searchsorted(self.token, self.front.first[i], side) for side in ("left", "right"))
        met = np.concatenate([self.row[x:y] for x, y in zip(a, z)])
        shared = np.bincount(met[other[met]], minlength=n)
        j = np.flatnonzero(shared)
        j = j[self.front.possible(i, j, shared[j], self.least)]
        return np.array([k for k in j if np.intersect1d(self.opened[i], self.opened[k])[0] == self.here], np.int64)

    def touched(self) -> np.ndarray:
        """Which nodes have a partner."""
        out = np.zeros(len(self.node), bool)
        for i in range(len(self.node)):
            j = self.partners(i)
            out[j] = True
            out[i] |= len(j) > 0
        return out

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join components."""
        out = []
        for i in range(len(self.node)):
            for j in self.partners(i):
                if self.label[i] != self.label[j] and linked(sets[i], sets[j], self.least):
                    out.append((int(self.node[i]), int(self.node[j])))
                    self.label[self.label == self.label[j]] = self.label[i]
        return out


def shared_elements(nodes: DataFrame, least: int) -> DataFrame:
    """node, size, e: the elements of each node's shortest prefix, without most of those that no other node's prefix has.

    Some that are alone stay, as they are told apart by SHORT bits: most elements are alone, and all go through a shuffle
    to be counted and through one to be kept, so neither has more of an element than it needs.
    """
    own = F.slice("prefix", 1, F.col("size") - F.ceil(F.col("size") * least / 100).cast("int") + 1)
    rows = nodes.select("node", "size", F.explode(own).alias("e"))
    short = F.col("e").bitwiseAND(F.lit((1 << SHORT) - 1))
    several = rows.groupBy(short.alias("short")).agg(F.count("*").alias("n")).filter("n > 1").select("short")
    return rows.join(several, short == F.col("short"), "left_semi")


def buckets_of(rows: DataFrame, least: int) -> DataFrame:
    """node, size, band: the buckets of each node, one for each of its elements (node, size, e) and class of sizes.

    Linked sets share an element of the prefixes for l = 1, as well. Of two linked sizes n <= m, m is n * 100 / least at
    most; classes are a few such steps wide, and a node is in that of its size and in that of the largest size it may be
    linked with, so linked nodes have the class of the larger in common.
    """
    step = float(np.log(100 / least)) * STEPS if least < 100 else 1.0
    of = lambda size: F.floor(F.log(size) / step + 1e-9)
    classes = F.array_distinct(F.array(of(F.col("size")), of(F.floor(F.col("size") * 100 / least))))
    return rows.select("node", "size", "e", F.explode(classes).alias("class")).select("node", "size", F.xxhash64("e", "class").alias("band"))


def links(df: DataFrame, nodes: DataFrame, key: str, text: str, words: int, least: int, n: int) -> DataFrame:
    """node, root of the nodes (node, rep, told, size, l, prefix, edge) that are linked to another; n: the rows of df."""
    # most prefix shingles are of one node, and go before anything else is asked of them
    met = staged(buckets_of(shared_elements(nodes, least), least), "met", n)
    hubs = met.groupBy("band").agg(F.min(F.struct("node", "size")).alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")).filter("n > 1")
    # buckets of the same nodes are one bucket
    hubs = staged(hubs.groupBy("hub", "n", "mark").agg(F.min("band").alias("band")).drop("mark"), "hubs", n)
    members = staged(met.join(small(hubs), "band"), "members", n)
    fits = 100 * F.least("size", "hub.size") >= least * F.greatest("size", "hub.size")
    pairs = staged(members.filter(F.col("node") != F.col("hub.node")).filter(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs", n)
    fronts = nodes.select("node", "size", "l", "prefix", "edge")
    possible = staged(candidates(pairs, fronts, least), "candidates", n)
    once = repeated(df.select(key))

    def fetched(wanted: DataFrame) -> DataFrame:
        sets = sets_of(df, wanted.join(nodes.select("node", "rep", "told"), "node"), key, text, words)
        return staged(sets.dropDuplicates(["node"]) if once else sets, "sets", n)

    sets = fetched(possible.select(F.col("a").alias("node")).union(possible.select("b")).distinct())
    found = staged(verified(possible, sets, least), "links", n)
    roots = staged(components(found), "roots", n)
    release(met, hubs, pairs, possible)

    def touched(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = [at[block.touched()] for block, at in Block.of_table(pdf, least)]
        return pdf.loc[pdf.index[np.concatenate(keep) if keep else []], ["band", "x", "y", "node"]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        out = [link for block, at in Block.of_table(pdf, least) for link in block.links([sets[i] for i in at])]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    rest = staged(unresolved(members.filter("n > 2").select("band", F.lit(0).alias("pos"), "node", "size"), roots, n).withColumn("open", F.array_sort("open.band")), "dealt", n)
    # most block pairs are small, and many of them go together
    batch = F.pmod(F.xxhash64("band", "x", "y"), F.lit(max(1, rest.count() // BATCH))).alias("batch")
    dealt = rest.join(fronts, "node")
    seen = staged(dealt.groupBy(batch).applyInPandas(touched, "band bigint, x int, y int, node bigint"), "touched", n)
    other = fetched(seen.select("node").distinct().join(sets.select("node"), "node", "left_anti"))
    whole = dealt.join(seen, ["band", "x", "y", "node"], "left_semi").join(sets.union(other), "node")
    more = staged(whole.groupBy(batch).applyInPandas(run, "a bigint, b bigint"), "links", n)
    if not more.isEmpty():
        roots = staged(components(found.union(more)), "roots", n)
    release(members, sets, other, rest, seen, found, more)
    return roots


def join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """key, n_shingles (size of the set) and component_id (the smallest key that links reach, the own included) of every row.

    Two rows link if the intersection of their sets is least hundredths of the union or more. Texts of fewer words than a
    shingle has are one shingle. Texts without a word (null, empty, white space) have the size 0 and link with nothing.
    Repeated rows and keys are rows like others: each has its own text's size and component. Rows with a null key link
    like others; component_id is null only where all keys of a component are. An empty table gives none; other columns
    are not read.
    """
    tune(df.sparkSession)
    n = df.count()
    rows = staged(prefixes(df, key, text, frequencies(df, text, words), words, least, longest), "prefixes", n)
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("told"))
    nodes = rows.filter("same is not null").groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "l", "prefix", "edge")])
    nodes = staged(nodes.select("same", F.col("first.key").alias("rep"), F.col("first.told").alias("told"), "copies", "size", "l", "prefix", "edge").withColumn("node", F.monotonically_increasing_id()), "nodes", n)
    roots = links(df, nodes, key, text, words, least, n)
    of = nodes.select("node", "same", "rep", "copies").join(roots, "node", "left").filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    named = staged(of.join(of.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("same", "copies", "component_id"), "named", n)
    found = spread_join(rows.select("key", "same", "size"), named.drop("copies"), "same", common_values(named, "same", "copies"))
    return found.select(F.col("key").alias(key), F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def oracle(words: int = WORDS, least: int = LEAST) -> str:
    """The same rows by SQL over documents (doc_id, text) with a unique doc_id: pairs by their shared shingles, then reach."""
    parts = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    return (
        f"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents), "
        f"s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {parts})) END s FROM w), "
        "e AS (SELECT doc_id, unnest(s) e FROM s), p AS (SELECT a.doc_id a, b.doc_id b, count(*) n FROM e a JOIN e b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL), "
        f"k AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= {least} * (len(x.s) + len(y.s) - n)), t AS (SELECT a, b FROM k UNION SELECT b, a FROM k), "
        "reach AS (SELECT doc_id node, doc_id root FROM s UNION SELECT t.b, reach.root FROM reach JOIN t ON t.a = reach.node) "
        "SELECT doc_id, len(s)::BIGINT n_shingles, (SELECT min(root) FROM reach WHERE node = doc_id) component_id FROM s"
    )
