"""Near-duplicate detection by DartMinHash signatures, banded joining and exact verification.

Documents are weighted sets: their shingles of five words, each with the number of times it occurs.
Two are near duplicates if the weighted Jaccard similarity is THRESHOLD or more, and a class is a
connected component of such links.

1. Equal word sequences are one node, however many copies there are. Each node gets a signature,
   cut into bands; nodes that share a band are a bucket. Buckets of the same nodes are one bucket.
2. Every member of a bucket is verified against the bucket's smallest node: as many pairs as rows.
   Links are gathered into components.
3. Buckets of three nodes or more that still hold several components are worked through whole:
   a pair of different components is first estimated from the signatures, and verified exactly
   unless the estimate lies DEVIATIONS standard deviations below the threshold. Pairs are not
   written out: a task holds the nodes of a bucket and gives only the links that join components.
   A pair that shares several open buckets is looked at in the first. Large buckets are dealt in
   blocks bounded by nodes and by bytes of their sets, the nodes of the largest component only
   against the others, so that a bucket which is one component but for a few nodes costs its rows
   times those few.

So every pair that shares a band is verified, or known to be in one class, or estimated too far off
(by an error of fewer than one pair in ten million at the threshold; the bands themselves miss one in
ten thousand).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import mix64, release, staged, texts, tune, uniform
from verdigris.operators.graphs import components

#: Words of a shingle; rows of a band and bands: 1 - (1 - .8^5)^25 > 0.9999 of pairs at similarity 0.8 share one.
WORDS, ROWS, BANDS = 5, 5, 25
#: Least weighted Jaccard similarity of near duplicates.
THRESHOLD = 0.8
#: Nodes of a block of an open bucket, and bytes of their sets, at most about.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Rows that are broadcast at most; more are joined by a shuffle. Pairs of a hub that meet its set in one task at most.
FEW, FAN = 200_000, 2_000
#: A text with a share of 1 / COMMON of all rows or more is common: there are COMMON such at most, and they are broadcast.
COMMON = 1000
#: Standard deviations that an estimated similarity may lie below the threshold before a pair is dropped unverified.
DEVIATIONS = 5.5
_WORD = re.compile(r"\w+")
_K = ROWS * BANDS


class Words(dict):
    """64-bit hashes of words; stops growing at a size."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 150_000:
            self[word] = h
        return h


def tokens(text: str, known: Words) -> np.ndarray:
    """Hashes of the words of a text: runs of letters, digits and underscores, lower case."""
    found = _WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingles(words: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of n words, sorted, and how often each occurs. A shorter text is one shingle; an empty one none."""
    if not len(words):
        return words, np.zeros(0)
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(h)])
    s, c = np.unique(h, return_counts=True)
    return s, c.astype(np.float64)


def dart_signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, k: int = _K) -> np.ndarray:
    """[doc, k] signatures of weighted sets. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

    Darts are thrown at the plane of weight and rank over each element, one for each unit of area on average, and at
    the same places for every set. Over cell v, the weights from 2^v - 1 to 2^(v+1) - 1, they come in order of rank as
    a Poisson process of rate 2^v. A dart below the element's weight counts for one coordinate, which keeps its
    earliest. Only ranks up to (k ln k + 2k) / total weight are looked at; where that leaves a coordinate empty, twice
    as far. element, weight and doc (from 0, in order) have one entry for each element of each set; weights are
    positive. Sets without elements get zeros.
    """
    out = np.zeros((docs, k), np.uint32)
    total = np.bincount(doc, weights=weight, minlength=docs)
    bound = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(docs), where=total > 0)
    cells = np.floor(np.log2(weight + 1 - 1e-12)).astype(np.int64).clip(0) + 1
    at = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    element, weight, doc = element[at], weight[at], doc[at]
    seed = mix64(element + mix64(cell.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)))
    rate = np.exp2(cell)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[doc])
        rank, step, first, found = np.zeros(len(live)), 0, 1, []
        while len(live):
            # the next arrivals over each cell that may still have some below the bound
            n = np.arange(step, step + first, dtype=np.uint64)
            with np.errstate(over="ignore"):
                h = mix64(seed[live, None] + (n + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            times = rank[:, None] + np.cumsum(-np.log(uniform(h)) / rate[live, None], axis=1)
            below = times < bound[doc[live], None]
            i, j = np.nonzero(below)
            dart = mix64(h[i, j] ^ np.uint64(0xA0761D6478BD642F))
            cell_at = live[i]
            hit = rate[cell_at] - 1 + uniform(dart) * rate[cell_at] < weight[cell_at]
            dart = mix64(dart[hit])
            found.append((doc[cell_at[hit]] * k + (dart % np.uint64(k)).astype(np.int64), times[i, j][hit], dart))
            more = below[:, -1]
            rank, live, step, first = times[more, -1], live[more], step + first, 16
        place, time, dart = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((time, place))
        place, dart = place[order], dart[order]
        keep = np.r_[True, place[1:] != place[:-1]] if len(place) else np.zeros(0, bool)
        place, dart = place[keep], dart[keep]
        got = np.bincount(place // k, minlength=docs)
        full = todo & (got == k)
        use = full[place // k]
        out.reshape(-1)[place[use]] = (dart[use] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        todo &= ~full
        bound = bound * 2
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """[doc, bands] 64-bit keys of the bands."""
    with np.errstate(over="ignore"):
        h = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64) + np.uint64(77)), (len(signatures), bands))
        for r in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::rows][:, :bands])
    return h.view(np.int64)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of sorted elements a, b with weights x, y; of two empty ones 0."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    low = np.minimum(x[same], y[at[same]]).sum()
    return float(low / (x.sum() + y.sum() - low))


def packed(elements: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """A weighted set as bytes; weights that are all 1 take none."""
    return elements.tobytes(), b"" if (weights == 1).all() else weights.astype(np.float32).tobytes()


def unpacked(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, np.uint64)
    return e, np.frombuffer(weights, np.float32).astype(np.float64) if weights else np.ones(len(e))


def identity(words: np.ndarray) -> bytes | None:
    """16 bytes that stand for a sequence of words; None for the empty one."""
    return xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None


def sketch(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, told (hash of the text), same (identity of the words, null without any), size (shingles), bands (array<bigint>), signature (its coordinates' low bytes)."""
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("told"), F.col(text).alias("text"))

    def some(keys: list[pa.Array], told: list[pa.Array], words: list[np.ndarray]) -> pa.RecordBatch:
        sets = [shingles(w) for w in words]
        sizes = [len(s) for s, _ in sets]
        sig = dart_signatures(np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]), np.repeat(np.arange(len(sets)), sizes), len(sets))
        low = (sig >> np.uint32(1)).astype(np.uint8)
        return pa.RecordBatch.from_pydict({
            "key": pa.concat_arrays(keys), "told": pa.concat_arrays(told), "same": pa.array([identity(w) for w in words], pa.binary()), "size": pa.array(sizes, pa.int32()),
            "bands": pa.array(list(band_keys(sig)), pa.list_(pa.int64())), "signature": pa.array([x.tobytes() for x in low], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, told, words, size = Words(), [], [], [], 0
        for b in batches:
            for n, t in enumerate(texts(b)):
                keys.append(b.column("key").slice(n, 1))
                told.append(b.column("told").slice(n, 1))
                words.append(tokens(t, known))
                size += len(words[-1])
                if size >= 100_000 or len(words) >= 500:
                    yield some(keys, told, words)
                    keys, told, words, size = [], [], [], 0
        if words:
            yield some(keys, told, words)

    return rows.mapInArrow(run, "key " + rows.schema["key"].dataType.simpleString() + ", told bigint, same binary, size int, bands array<bigint>, signature binary")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= FEW else df


def sets_of(df: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node, elements, weights of the nodes (node, rep, told): the shingles of the text of the row that stands for each.

    Where that row is repeated, so is the node.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    rows = rows.join(small(nodes), F.col("__key").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("told")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            out = [packed(*shingles(tokens(t, known))) for t in texts(b)]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "elements": pa.array([x[0] for x in out], pa.binary()), "weights": pa.array([x[1] for x in out], pa.binary())})

    return rows.select("node", "text").mapInArrow(run, "node bigint, elements binary, weights binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose similarity is threshold or more. a may recur in any number of pairs: its set goes to as
    many places as hold FAN of them each."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    left = sets.join(fans, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    wide = small(staged(fans.filter("fans > 1"), "fans", 0))
    dealt = pairs.join(wide, "a", "left").withColumn("fan", F.coalesce(F.pmod(F.xxhash64("b"), F.col("fans")).cast("int"), F.lit(0))).drop("fans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similarity(*unpacked(p.as_py(), q.as_py()), *unpacked(r.as_py(), s.as_py())) >= threshold for p, q, r, s in zip(*(b.column(c) for c in ("ea", "wa", "eb", "wb")))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.join(right, "b").join(left, ["a", "fan"]).select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(run, "a bigint, b bigint")


def links_in_block(pdf: pd.DataFrame, threshold: float = THRESHOLD, deviations: float = DEVIATIONS) -> list[tuple[int, int]]:
    """Verified links that join components among the nodes of a block pair; see unresolved() for the columns."""
    k = ROWS * BANDS
    sig = np.stack([np.frombuffer(x, np.uint8) for x in pdf["signature"]])
    side, node, here = pdf["side"].to_numpy(), pdf["node"].to_numpy(), pdf["band"].iloc[0]
    # [node, band] keys of the open buckets; a closed one holds a number of the row's own
    held, opened = np.zeros((len(node), BANDS), np.int64), np.zeros((len(node), BANDS), bool)
    for i, buckets in enumerate(pdf["open"]):
        for x in buckets:
            held[i, x["pos"]], opened[i, x["pos"]] = x["band"], True
    at_here = (opened & (held == here)).argmax(1)
    sets = [unpacked(e, w) for e, w in zip(pdf["elements"], pdf["weights"])]
    label = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
    alone = pdf["x"].iloc[0] == pdf["y"].iloc[0]
    least = threshold - deviations * np.sqrt(threshold * (1 - threshold) / k)
    out = []
    for i in range(len(node)):
        other = (np.arange(len(node)) > i) if alone else (side > side[i])
        other &= label != label[i]
        at = np.flatnonzero(other)
        if not len(at):
            continue
        close = (sig[at] == sig[i]).mean(1)
        at, close = at[close >= least], close[close >= least]
        if not len(at):
            continue
        shared = (held[at] == held[i]) & opened[at] & opened[i]
        first = shared.argmax(1) == at_here[i]
        at = at[first][np.argsort(-close[first], kind="stable")]
        for j in at:
            if label[i] != label[j] and similarity(*sets[i], *sets[j]) >= threshold:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return out


def unresolved(members: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """band, node, root, open, x, y, side: members (band, pos, node, size) of buckets with several components, dealt to block pairs.

    The largest component of a bucket is its core. The other nodes are in blocks 0 to p - 1, the core in blocks from p
    on. Block pairs are those of two blocks of others and those of a block of others and one of the core. open: place
    and key of every bucket of the node that is dealt.
    """
    bytes_ = F.lit(400) + F.col("size") * 12
    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = labelled.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum(bytes_).alias("bytes"))
    top = counts.groupBy("band").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("total"), F.sum("bytes").alias("bytes"), F.count("*").alias("kinds"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    p, q = blocks(F.col("total") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")), blocks(F.col("top.n"), F.col("top.bytes"))
    open_buckets = staged(top.filter("kinds > 1 and total > 2").select("band", F.col("top.root").alias("main"), p.alias("p"), q.alias("q")), "open", n)
    rows = staged(labelled.join(small(open_buckets), "band").withColumn("core", F.col("root") == F.col("main")), "rest", n)
    opened = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "band"))).alias("open"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("q")).otherwise(F.col("p")).cast("bigint")).cast("int")
    rows = rows.withColumn("own", own + F.when(F.col("core"), F.col("p")).otherwise(0))
    # two blocks that fit into one task are one block
    one = F.col("p") + F.col("q") == 2
    others = F.when(one, F.array(F.lit(0))).when(F.col("core"), F.sequence(F.lit(0), F.col("p") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))
    dealt = rows.join(opened, "node").withColumn("own", F.when(one, 0).otherwise(F.col("own"))).withColumn("other", F.explode(others))
    return dealt.select("band", "node", "root", "open", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key and class_id of every row of df: the smallest key of the row's class of near duplicates.

    Rows of equal words are of one class. Texts of fewer than five words are one shingle, so only equal words match;
    rows without a word (null, empty, or nothing but marks) are each a class of their own. Repeated rows and keys are
    rows of one class. Rows with a null key are linked like others; class_id is null only where all keys of a class
    are. Other columns are not read.
    """
    return classed(df, key, text, threshold).select(F.col("key").alias(key), "class_id")


def links(df: DataFrame, nodes: DataFrame, key: str, text: str, threshold: float, n: int) -> DataFrame:
    """node and root of the nodes (node, rep, told, size, bands, signature) that are linked to another; n: the rows of df."""
    banded = nodes.select("node", "size", F.posexplode("bands").alias("pos", "band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")).filter("n > 1")
    hubs = staged(hubs.groupBy("hub", "n", "mark").agg(F.min("band").alias("band")).drop("mark"), "hubs", n)
    # written first, so that a bucket of many rows can be split in the join, or the join needs no shuffle
    members = staged(banded.join(small(hubs), "band"), "members", n)
    pairs = staged(members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs", n)
    involved = staged(members.select("node").distinct().join(nodes.select("node", "rep", "told"), "node"), "involved", n)
    sets = sets_of(df, involved, key, text)
    sets = staged(sets.dropDuplicates(["node"]) if repeated(df.select(key)) else sets, "sets", n)
    first = staged(verified(pairs, sets, threshold), "links", n)
    roots = staged(components(first), "roots", n)
    release(hubs, pairs, involved)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_in_block(pdf, threshold), columns=["a", "b"]).astype("int64")

    rest = unresolved(members.filter("n > 2").select("band", "pos", "node", "size"), roots, n)
    whole = rest.join(nodes.select("node", "signature"), "node").join(sets, "node")
    more = staged(whole.groupBy("band", "x", "y").applyInPandas(run, "a bigint, b bigint"), "links", n)
    if not more.isEmpty():
        roots = staged(components(first.union(more)), "roots", n)
    release(members, sets, first, more)
    return roots


def classed(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """key, told, same, class_id, class_told of every row of df: classes() with the hash of the text, the identity of its
    words, and the hash of the text of the row that stands for the class."""
    spark = df.sparkSession
    tune(spark)
    n = df.count()
    rows = staged(sketch(df, key, text), "sketches", n)
    # the row that stands for a node: the smallest key, null last
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("told"))
    nodes = rows.filter("same is not null").groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "bands", "signature")])
    nodes = staged(nodes.select("same", F.col("first.key").alias("rep"), F.col("first.told").alias("told"), "copies", "size", "bands", "signature").withColumn("node", F.monotonically_increasing_id()), "nodes", n)
    roots = links(df, nodes, key, text, threshold, n)
    of = nodes.select("node", "same", "rep", "told", "copies").join(roots, "node", "left").filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    ids = of.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("told"))).alias("first"))
    named = staged(of.join(ids, "root").select("same", "copies", F.col("first.rep").alias("class_id"), F.col("first.told").alias("class_told")), "named", n)
    # rows without a word and texts that occur once need no join; common texts meet no shuffle
    least = max(2, -(-n // COMMON))
    common = F.broadcast(named.filter(F.col("copies") >= least).drop("copies"))
    rare = named.filter(F.col("copies") < least).drop("copies")
    some = rows.select("key", "told", "same")
    hot = some.join(common, "same").select("key", "told", "same", "class_id", "class_told")
    cool = some.filter("same is not null").join(common.select("same"), "same", "left_anti").join(small(rare), "same", "left")
    found = F.col("class_told").isNotNull()
    cool = cool.select("key", "told", "same", F.when(found, F.col("class_id")).otherwise(F.col("key")).alias("class_id"), F.coalesce("class_told", "told").alias("class_told"))
    none = some.filter("same is null").select("key", "told", "same", F.col("key").alias("class_id"), F.col("told").alias("class_told"))
    return hot.unionByName(cool).unionByName(none)


def repeated(keys: DataFrame) -> bool:
    """Whether a key occurs in several rows."""
    return not keys.groupBy(keys[0]).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def keep(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns as they are, that stand for their class: those of its smallest key (null last), one of
    equal rows.

    Where a key has several texts, each is kept or dropped on its own. Rows without a word are all kept, but one of
    those of equal key and text. An empty table stays empty; extra columns are kept, whatever their names.
    """
    of = classed(df, key, text, threshold)
    drop = staged(of.filter("same is not null and not (key <=> class_id and told = class_told)").select(F.col("key").alias("__drop"), F.col("told").alias("__told")).distinct(), "drop", df.count())
    kept = df.join(small(drop), F.col(key).eqNullSafe(F.col("__drop")) & (F.xxhash64(F.col(text)) == F.col("__told")), "left_anti")
    return kept.dropDuplicates([key, text]) if repeated(df.select(key)) else kept
