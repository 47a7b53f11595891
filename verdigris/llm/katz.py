"""A Katz backoff bigram model of a corpus: counted, stored in partitioned tables, and evaluated on every text.

P(w | v) = r*(v w) / c(v) where v w was seen r times in training, and bow(v) P(w) where it was not;
P(w) = r*(w) / N for a word seen in training, and what the discounts leave for the unknown word.
r* is Good-Turing's count for r up to K (Katz's formula), where the counts of counts allow it; beyond
K, bigrams keep all but RESERVE, so that every context keeps something to back off with. bow(v) is
what the seen words leave of 1, over what they leave of the unigrams: sums over all of v's words, so
that the probabilities after v add up to 1 exactly.

Words are 64-bit hashes throughout. How the work is dealt:

1. Words are counted. Those with a share of 1 / HOT of the tokens or more are hot: at most HOT words.
2. Pairs of hot words are counted in a HOT x HOT matrix. Every bigram with a share of 1 / HOT is
   among them, so no single bigram or word that is dealt by its hash can swamp a task.
3. All other bigrams go, with the documents that use them, to parts by the hash of their word (of
   both words, if the word is hot). A part counts them and knows each word's own count, as all
   bigrams that end in it are there. The parts are the stored tables.
4. A part gives each document's sum over its bigrams, and for each context what its words have been
   discounted and their unigram mass. Those meet by context and give what backing off costs the
   documents' unseen bigrams.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import mix64, remainder, scratch, staged, texts, tune

#: Highest count that Good-Turing discounts; what a bigram seen more often gives up of its count.
K, RESERVE = 5, 0.1
#: Most hot words; parts at least, and tokens of a part about; tokens and documents of a block at most.
HOT, PARTS, PART_TOKENS, BLOCK_TOKENS, BLOCK_DOCS = 1024, 108, 1_300_000, 900_000, 30_000
#: Hashes of what stands before a text and of its end.
BEGIN, END = (xxhash.xxh3_64_intdigest(x) for x in (b"\n<begin>\n", b"\n<end>\n"))


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, kind: type | str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), kind)


def packed_words(w: np.ndarray, u: Unigrams) -> bytes:
    """Hashes of words as bytes: hot words as their numbers, which pack well, and the others' hashes after them."""
    at = u.place(w)
    head = packed(np.where(at >= 0, at, 0xFFFF).astype(np.uint16))
    return len(head).to_bytes(8, "little") + head + packed(w[at < 0])


def unpacked_words(b: bytes, u: Unigrams) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    at = unpacked(b[8 : 8 + size], np.uint16)
    out = u.hot[np.minimum(at, len(u.hot) - 1)]
    out[at == 0xFFFF] = unpacked(b[8 + size :], np.uint64)
    return out


class Words(dict):
    """Hashes of words; stops growing at a size."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = h
        return h


def words(text: str, known: Words) -> np.ndarray:
    """Hashes of a text's tokens: words between ASCII white space with A-Z in lower case, then the end."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    out[-1] = END
    return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(w + mix64(v) * np.uint64(0x9E3779B97F4A7C15))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """r* for r = 0 to K from the numbers of types seen 1, ..., K + 1 times.

    Katz's formula where it gives 0 < r* < r for all of them; else r less n1 / (n1 + 2 n2), or less 1/2 if n1 is 0.
    """
    n = np.asarray(counts_of_counts, np.float64)
    r = np.arange(1, K + 1)
    if (n > 0).all():
        gt, a = (r + 1) * n[1:] / n[:-1], (K + 1) * n[K] / n[0]
        star = r * (gt / r - a) / (1 - a) if a < 1 else np.zeros(K)
        if ((star > 0) & (star < r)).all() and (np.diff(star) > 0).all():
            return np.r_[0.0, star]
    d = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.r_[0.0, r - min(0.9, max(0.1, d))]


@dataclass
class Unigrams:
    """N, V, the discounted counts, the share of the unknown word, and the hot words with their counts (sorted by hash)."""

    tokens: int
    types: int
    star: np.ndarray
    scale: float
    unknown: float
    hot: np.ndarray
    hot_counts: np.ndarray

    def share(self, c: np.ndarray) -> np.ndarray:
        """P(word) of words seen c times."""
        c = np.asarray(c, np.int64)
        r = np.where(c <= K, self.star[np.minimum(c, K)], c)
        return np.where(c > 0, r * self.scale / max(1, self.tokens), self.unknown)

    def place(self, w: np.ndarray) -> np.ndarray:
        """Index among the hot words, or -1."""
        at = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        return np.where(self.hot[at] == w, at, -1).astype(np.int32)


def parts_for(tokens: int) -> int:
    return max(PARTS, -(-tokens // PART_TOKENS))


def count_words(train: DataFrame, parts: int) -> Unigrams:
    """Counts of all words of the rows (text): in every task, then by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, size = Words(), [], 0
        for b in batches:
            for t in texts(b):
                seen.append(words(t, known))
                size += len(seen[-1])
                if size > 4_000_000:
                    yield flush(seen)
                    seen, size = [], 0
        if size:
            yield flush(seen)

    def flush(seen: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(seen), return_counts=True)
        at = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(1, parts))
        return pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "hashes": pa.array([x.tobytes() for x in np.split(h[order], edges)], pa.binary()), "counts": pa.array([x.astype(np.uint32).tobytes() for x in np.split(c[order], edges)], pa.binary())})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
        h, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, weights=np.frombuffer(b"".join(pdf["counts"]), np.uint32), minlength=len(h)).astype(np.int64)
        top = np.argsort(-c, kind="stable")[:HOT]
        return pd.DataFrame({"part": [key[0]], "hashes": [packed(h)], "counts": [packed(c)], "tokens": [int(c.sum())], "types": [len(h)], "often": [np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist()], "top": [h[top].tobytes()], "top_counts": [c[top].tobytes()]})

    schema = "part int, hashes binary, counts binary, tokens bigint, types bigint, often array<bigint>, top binary, top_counts binary"
    table = staged(train.mapInArrow(run, "part int, hashes binary, counts binary").groupBy("part").applyInPandas(add, schema), "unigrams")
    total = table.agg(F.sum("tokens"), F.sum("types"), *[F.sum(F.col("often")[i]) for i in range(K + 1)]).first()
    tokens, types = int(total[0] or 0), int(total[1] or 0)
    star = discounts([total[i + 2] or 0 for i in range(K + 1)])
    least = max(1, -(-tokens // HOT))

    def hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("top"), b.column("top_counts")):
                h, c = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[c >= least].view(np.int64)), "c": pa.array(c[c >= least])})

    found = {int(np.int64(r["h"]).view(np.uint64)): r["c"] for r in table.select("top", "top_counts").mapInArrow(hottest, "h bigint, c bigint").collect()}
    texts_seen = found.get(END, 0) if END in found else int(train.count()) if tokens else 0
    found |= {END: texts_seen, BEGIN: texts_seen}
    hot = np.array(sorted(found), np.uint64)
    counts = np.array([found[int(h)] for h in hot], np.int64)
    # mass that seen words keep: what the discounts take goes to the unknown word
    gone = sum((total[i + 1] or 0) * (i - star[i]) for i in range(1, K + 1))
    unknown, floor = gone / max(1, tokens), 1.0 / (tokens + 1)
    scale = 1.0
    if unknown < floor:
        scale, unknown = (1 - floor) / max(1e-300, 1 - unknown), floor
    return Unigrams(tokens, types, star, scale, unknown, hot, counts)


def count_hot_pairs(train: DataFrame, u: Unigrams) -> np.ndarray:
    """[context, word] counts of pairs of hot words, added up in each task and then by slices of contexts."""
    size, each = len(u.hot), 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, seen, chars = Words(), np.zeros(size * size, np.int64), [], 0
        first = int(u.place(np.array([BEGIN], np.uint64))[0])

        def add() -> None:
            at = u.place(np.concatenate(seen))
            starts = np.cumsum([0, *map(len, seen)])[:-1]
            before = np.r_[first, at[:-1]]
            before[starts] = first
            both = (at >= 0) & (before >= 0)
            np.add(total, np.bincount(before[both] * np.int32(size) + at[both], minlength=size * size), out=total)

        for b in batches:
            for t in texts(b):
                seen.append(words(t, known))
                chars += len(seen[-1])
                if chars > 1_000_000:
                    add()
                    seen, chars = [], 0
        if seen:
            add()
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(-(-size // each)), pa.int32()), "counts": pa.array([total[i * size : (i + each) * size].tobytes() for i in range(0, size, each)], pa.binary())})

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "counts": [np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0).tobytes()]})

    got = {r[0]: np.frombuffer(bytes(r[1]), np.int64) for r in train.mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInPandas(add_up, "slice int, counts binary").collect()}
    return np.concatenate([got[i] for i in sorted(got)]).reshape(size, size) if got else np.zeros((size, size), np.int64)


def packed_blocks(names: np.ndarray, at: np.ndarray) -> bytes:
    """Blocks of uses as bytes: the blocks' names, and each use's place among them."""
    head = packed(names)
    return len(head).to_bytes(8, "little") + head + packed(at.astype(np.uint32))


def unpacked_blocks(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(b[:8], "little")
    return unpacked(b[8 : 8 + size], np.int64), unpacked(b[8 + size :], np.uint32)


#: Columns of a stored part (part >= 0), and of a block of documents with its hot pairs (part = -1).
TABLE = "part int, block bigint, v binary, w binary, c binary, cw binary, uses binary, use_block binary, use_doc binary, use_n binary, often array<bigint>, hot binary, keys binary, sizes binary"
_NAMES = [x.split()[0] for x in TABLE.split(", ")]


def blocks(docs: DataFrame, u: Unigrams, parts: int) -> DataFrame:
    """Blocks of documents cut into bigrams and dealt to parts; docs has key (bigint), held (boolean), text."""
    schema = "part int, block bigint, v binary, w binary, uses binary, use_doc binary, use_n binary, keys binary, sizes binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, task = Words(), 0, TaskContext.get().partitionId()
        keys, held, seen, size = [], [], [], 0
        for b in batches:
            for k, h, t in zip(b.column("key").to_pylist(), b.column("held").to_pylist(), texts(b)):
                seen.append(words(t, known))
                keys.append(k)
                held.append(h)
                size += len(seen[-1])
                if size > BLOCK_TOKENS or len(keys) >= BLOCK_DOCS:
                    yield block((task << 24) + number, keys, held, seen)
                    keys, held, seen, size, number = [], [], [], 0, number + 1
        if keys:
            yield block((task << 24) + number, keys, held, seen)

    def grouped(key: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order by key, then: starts of bigrams, uses of each, the uses' documents (twice, plus 1 if held out) and counts."""
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_use = new_key | np.r_[True, d[1:] != d[:-1]]
        use = np.flatnonzero(new_use)
        n = np.diff(np.r_[use, len(k)]).astype(np.uint32)
        start = np.flatnonzero(new_key)
        uses = np.diff(np.r_[np.searchsorted(use, start), len(use)]).astype(np.uint32)
        return order[start], uses, (d[use] * 2 + mark[d[use]]).astype(np.uint32), n

    def block(name: int, keys: list, held: list, seen: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array(list(map(len, seen)))
        w = np.concatenate(seen)
        seen.clear()
        v = np.r_[np.uint64(BEGIN), w[:-1]]
        v[np.cumsum(np.r_[0, sizes[:-1]])] = BEGIN
        doc, mark = np.repeat(np.arange(len(keys), dtype=np.int32), sizes), np.array(held, np.int32)
        pv, pw = u.place(v), u.place(w)
        both = (pv >= 0) & (pw >= 0)
        rows = []
        at, uses, use_doc, use_n = grouped(pv[both] * np.int32(len(u.hot)) + pw[both], doc[both], mark) if both.any() else (np.zeros(0, np.int64), *[np.zeros(0, np.uint32)] * 3)
        null = np.array([k is None for k in keys])
        ids = np.array([0 if k is None else k for k in keys], np.int64)
        rows.append((-1, name, packed(pv[both][at].astype(np.uint32)), packed(pw[both][at].astype(np.uint32)), packed(uses), packed(use_doc), packed(use_n), packed(np.r_[ids, null.astype(np.int64)]), packed(sizes.astype(np.int64) * 2 + mark)))
        v, w, doc, pw = v[~both], w[~both], doc[~both], pw[~both]
        del pv, both, at, uses, use_doc, use_n
        if len(w):
            h = pair_hash(v, w)
            part = (np.where(pw >= 0, mix64(h), mix64(w)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable").astype(np.int32)
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            del part, pw
            for p in range(parts):
                i = order[edges[p] : edges[p + 1]]
                if len(i):
                    at, uses, use_doc, use_n = grouped(h[i], doc[i], mark)
                    by_word = np.lexsort((v[i][at], w[i][at]))  # equal words side by side pack better
                    bounds = np.r_[0, np.cumsum(uses)]
                    flat = _spread(bounds, by_word)
                    rows.append((p, name, packed_words(v[i][at][by_word], u), packed_words(w[i][at][by_word], u), packed(uses[by_word]), packed(use_doc[flat]), packed(use_n[flat]), None, None))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})

    return docs.mapInArrow(run, schema)


def _spread(bounds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The positions of runs bounds[j] to bounds[j + 1], run after run in the given order."""
    bounds = bounds.astype(np.int64)
    length = (bounds[1:] - bounds[:-1])[order]
    return np.repeat(bounds[:-1][order] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())


def tables(dealt: DataFrame, u: Unigrams, parts: int) -> DataFrame:
    """The stored tables: for each part its bigrams, their counts in training, their words' counts, and their uses."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            r = pdf.iloc[0]
            row = {"part": -1, "block": r["block"], "v": r["v"], "w": r["w"], "uses": r["uses"], "use_doc": r["use_doc"], "use_n": r["use_n"], "keys": r["keys"], "sizes": r["sizes"]}
            return pd.DataFrame([dict.fromkeys(_NAMES) | row])[_NAMES]
        homes, home = np.unique(pdf["block"].to_numpy(np.int64), return_inverse=True)
        v = np.concatenate([unpacked_words(x, u) for x in pdf["v"]])
        w = np.concatenate([unpacked_words(x, u) for x in pdf["w"]])
        uses, doc, n = (np.concatenate([unpacked(x, np.uint32) for x in pdf[c]]) for c in ("uses", "use_doc", "use_n"))
        home = np.repeat(home.astype(np.uint16 if len(homes) < 1 << 16 else np.uint32), [len(unpacked(x, np.uint32)) for x in pdf["use_doc"]])
        del pdf
        _, first, at = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
        v, w = v[first], w[first]
        order = np.lexsort((v, w))
        v, w = v[order], w[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        of = np.repeat(rank[at], uses)  # the bigram of each use
        del first, at, order, rank, uses
        c = np.bincount(of, weights=np.where(doc & 1, np.uint32(0), n), minlength=len(v)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        cw = np.add.reduceat(c, start)
        hot = u.place(w[start])
        cw = np.repeat(np.where(hot >= 0, u.hot_counts[hot], cw), np.diff(np.r_[start, len(w)]))
        by = np.argsort(of, kind="stable")
        number = np.bincount(of, minlength=len(v)).astype(np.uint32)
        del of
        context, seen = u.place(v), c > 0
        mine = seen & (context >= 0)
        level = np.minimum(c[mine], K + 1) - 1
        hot_kinds = np.bincount(context[mine].astype(np.int64) * (K + 1) + level, minlength=len(u.hot) * (K + 1)).astype(np.float64)
        hot_mass = np.bincount(context[mine], weights=u.share(cw[mine]), minlength=len(u.hot))
        often = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist()
        row = {"part": key[0], "block": 0, "v": packed_words(v, u), "w": packed_words(w, u), "c": packed(c.astype(np.uint32)), "cw": packed(cw.astype(np.uint32)), "uses": packed(number), "use_block": packed_blocks(homes, home[by]), "use_doc": packed(doc[by]), "use_n": packed(n[by]), "often": often, "hot": packed(np.r_[hot_kinds, hot_mass]), "keys": None, "sizes": None}
        return pd.DataFrame([dict.fromkeys(_NAMES) | row])[_NAMES]

    alone = F.when(F.col("part") < 0, F.col("block")).otherwise(F.lit(0))
    # as many partitions as parts, whatever the session's setting: a task reads about one part at any size
    return dealt.withColumn("alone", alone).repartition(parts, "part", "alone").groupBy("part", "alone").applyInPandas(merge, TABLE)


@dataclass
class Model:
    """What evaluation needs beside the stored tables."""

    unigrams: Unigrams
    pairs: np.ndarray
    star: np.ndarray
    hot_cost: np.ndarray

    def count(self, c: np.ndarray) -> np.ndarray:
        """r* of bigrams seen c > 0 times."""
        return np.where(c <= K, self.star[np.minimum(c, K)], c - RESERVE)


def finish(u: Unigrams, pairs: np.ndarray, table: DataFrame) -> Model:
    """Discounts from all bigrams' counts of counts, and log10 of c(v) bow(v) of the hot contexts."""
    parts = table.filter("part >= 0")
    often = np.array([x or 0 for x in parts.agg(*[F.sum(F.col("often")[i]) for i in range(K + 1)]).first()], np.int64)
    often = often + np.bincount(np.minimum(pairs.reshape(-1), K + 2), minlength=K + 3)[1 : K + 2]
    size = len(u.hot)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (K + 2))
        for b in batches:
            for x in b.column("hot"):
                total += unpacked(x.as_py(), np.float64)
        yield pa.RecordBatch.from_pydict({"hot": pa.array([total.tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"hot": [np.sum([np.frombuffer(x, np.float64) for x in pdf["hot"]], axis=0).tobytes()]})

    total = np.zeros(size * (K + 2))
    sums = parts.select("hot").mapInArrow(added, "hot binary").withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(16))).groupBy("g").applyInPandas(lambda pdf: add(pdf), "hot binary")
    for r in sums.collect():
        total += np.frombuffer(bytes(r[0]), np.float64)
    kinds, mass = total[: size * (K + 1)].reshape(size, K + 1), total[size * (K + 1) :]
    star = discounts(often)
    loss = np.r_[np.arange(1, K + 1) - star[1:], RESERVE]
    level = np.minimum(pairs, K + 1)
    for r in range(1, K + 2):
        kinds[:, r - 1] += (level == r).sum(1)
    mass = mass + (pairs > 0) @ u.share(u.hot_counts)
    left = kinds @ loss
    return Model(u, pairs, star, backing(left, mass))


def backing(left: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of c(v) bow(v) from the counts that v's words have given up and their unigram mass; 0 for a context never seen."""
    return np.where(left > 0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - mass, 1e-15)), 0.0)


def contexts(table: DataFrame, m: Model, parts: int) -> DataFrame:
    """block, doc, score: what backing off from contexts that are not hot adds to each document.

    Counts given up and unigram mass are added up in each part and sent to parts by context, as are the uses of
    bigrams never seen in training.
    """
    u = m.unigrams
    schema = "part int, v binary, left binary, mass binary, use_v binary, use_block binary, use_doc binary, use_n binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {name: x[i].as_py() for name, x in zip(b.schema.names, b.columns)}
                v, c, cw = unpacked_words(r["v"], u), unpacked(r["c"], np.uint32).astype(np.int64), unpacked(r["cw"], np.uint32)
                cold = u.place(v) < 0
                seen = cold & (c > 0)
                names_v, at = np.unique(v[seen], return_inverse=True)
                left = np.bincount(at, weights=c[seen] - m.count(c[seen]), minlength=len(names_v))
                mass = np.bincount(at, weights=u.share(cw[seen]), minlength=len(names_v))
                of = np.repeat(np.arange(len(v), dtype=np.int32), unpacked(r["uses"], np.uint32))
                use = (cold & (c == 0))[of]
                names_b, at_b = unpacked_blocks(r["use_block"])
                uv, ub, ud, un = v[of[use]], names_b[at_b[use]], unpacked(r["use_doc"], np.uint32)[use], unpacked(r["use_n"], np.uint32)[use]
                p, q = (mix64(names_v) % np.uint64(parts)).astype(np.int64), (mix64(uv) % np.uint64(parts)).astype(np.int64)
                po, qo = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
                pe, qe = np.searchsorted(p[po], np.arange(parts + 1)), np.searchsorted(q[qo], np.arange(parts + 1))
                del v, c, cw, of, use, at_b, p, q
                rows = []
                for j in range(parts):
                    a, z = po[pe[j] : pe[j + 1]], qo[qe[j] : qe[j + 1]]
                    if len(a) or len(z):
                        rows.append((j, packed(names_v[a]), packed(left[a]), packed(mass[a]), packed(uv[z]), packed(ub[z]), packed(ud[z]), packed(un[z])))
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int32() if n == "part" else pa.binary()) for n, x in zip(names, zip(*rows))})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        v, left, mass, uv, ub, ud, un = (np.concatenate([unpacked(x, k) for x in pdf[c]]) for c, k in zip(names[1:], (np.uint64, np.float64, np.float64, np.uint64, np.int64, np.uint32, np.uint32)))
        known, at = np.unique(v, return_inverse=True)
        cost = backing(np.bincount(at, weights=left, minlength=len(known)), np.bincount(at, weights=mass, minlength=len(known)))
        if len(known):
            place = np.minimum(np.searchsorted(known, uv), len(known) - 1)
            value = np.where(known[place] == uv, cost[place], 0.0) * un
        else:
            value = np.zeros(len(uv))
        return sums_of(*np.unique(ub, return_inverse=True), ud, value, None, None)

    return table.filter("part >= 0").select("v", "c", "cw", "uses", "use_block", "use_doc", "use_n").mapInArrow(run, schema).repartition(parts, "part").groupBy("part").applyInPandas(lambda pdf: meet(pdf), SUMS)


#: Sums of a block's documents: their numbers (null: all, in order) and what is to be added to each.
SUMS = "block bigint, docs binary, score binary, base binary, known binary"


def sums_of(names: np.ndarray, at: np.ndarray, doc: np.ndarray, *each: np.ndarray | None) -> pd.DataFrame:
    """A row of sums for each block: at gives each use's place among the blocks' names, doc twice its document's number
    (plus 1 if held out), each what the uses add (None: nothing)."""
    number = doc >> 1
    stride = int(number.max()) + 1 if len(number) else 1
    cell = at.astype(np.int64) * stride + number
    size = len(names) * stride
    if size > 4 * len(cell) + (1 << 20):  # a table of all cells would be larger than the uses: only those that are used
        used, cell = np.unique(cell, return_inverse=True)
        size, kept = len(used), slice(None)
    else:
        used = kept = np.flatnonzero(np.bincount(cell, minlength=size))
    totals = [np.zeros(len(used)) if x is None else np.bincount(cell, weights=x, minlength=size)[kept] for x in each]
    block, docs = used // stride, (used % stride).astype(np.uint32)
    edges = np.searchsorted(block, np.arange(len(names) + 1))
    rows = [(int(n), packed(docs[i:j]), *(packed(t[i:j]) for t in totals)) for n, i, j in zip(names, edges, edges[1:]) if i < j]
    return pd.DataFrame(rows, columns=["block", "docs", "score", "base", "known"])


def documents(table: DataFrame, m: Model) -> DataFrame:
    """Sums of all documents over the bigrams of each part and the hot pairs of each block."""
    u = m.unigrams
    end = int(u.place(np.array([END], np.uint64))[0])
    start = int(u.place(np.array([BEGIN], np.uint64))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = sums({name: x[i].as_py() for name, x in zip(b.schema.names, b.columns)})
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    def sums(r: dict) -> pd.DataFrame:
        hot = r["part"] < 0
        if hot:
            v, w = unpacked(r["v"], np.uint32), unpacked(r["w"], np.uint32)
            c, cw, context, last = m.pairs[v, w], u.hot_counts[w], v.astype(np.int64), w == end
        else:
            v, w = unpacked_words(r["v"], u), unpacked_words(r["w"], u)
            c, cw = unpacked(r["c"], np.uint32).astype(np.int64), unpacked(r["cw"], np.uint32).astype(np.int64)
            context, last = u.place(v), w == np.uint64(END)
        del v, w
        unseen = np.log10(u.share(cw)) + np.where(context >= 0, m.hot_cost[context], 0.0)
        each = np.where(c > 0, np.log10(np.maximum(m.count(c), 1e-300)), unseen)
        # every word is the context of the token after it: its count is divided by once, seen or not
        each -= np.where(last | (cw == 0), 0.0, np.log10(np.maximum(cw, 1)))
        base = np.log10(cw + 1)
        uses, doc, n = unpacked(r["uses"], np.uint32), unpacked(r["use_doc"], np.uint32), unpacked(r["use_n"], np.uint32)
        names, at = (np.array([r["block"]]), np.zeros(len(doc), np.uint32)) if hot else unpacked_blocks(r["use_block"])
        each, base, known = np.repeat(each, uses) * n, np.repeat(base, uses) * n, np.repeat(cw > 0, uses) * n
        if hot:
            # the count of texts, for the context before each text's first word
            texts_here = len(unpacked(r["sizes"], np.int64))
            first = np.full(texts_here, -np.log10(max(1, int(u.hot_counts[start]))))
            doc, at = np.r_[doc, np.arange(texts_here, dtype=np.uint32) * 2], np.zeros(len(doc) + texts_here, np.uint32)
            each, base, known = np.r_[each, first], np.r_[base, np.zeros(texts_here)], np.r_[known, np.zeros(texts_here)]
        return sums_of(names, at, doc, each, base, known)

    return table.select("part", "block", "v", "w", "c", "cw", "uses", "use_block", "use_doc", "use_n", "sizes").mapInArrow(run, SUMS)


def released(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what was written, rather than when the driver next collects its garbage."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", mod: int = 7, held: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The model learns from the rows whose crc32(key as text) modulo mod is not held. Null texts are empty: one token,
    their end. Keys are integers; repeated rows and keys each give a row and, in training, count each; null keys
    (the empty text, in that crc) stay null. Without training rows every token is unknown, with probability 1.
    Other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), (remainder(key, mod) == held).alias("held"), F.col(text).alias("text"))
    train = rows.filter(~F.col("held")).select("text")
    about = max(1, docs.rdd.getNumPartitions())
    u = count_words(train, max(16, min(2048, about)))
    parts = parts_for(u.tokens)
    pairs = count_hot_pairs(train, u)
    released(spark)
    at = scratch(spark, "bigrams")
    # rows are large and packed already: small row groups, or a writer would gather many of them in memory
    packed_rows = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false", "compression": "none"}
    tables(blocks(rows, u, parts), u, parts).write.options(**packed_rows).parquet(at)
    released(spark)
    table = spark.read.schema(TABLE).parquet(at)
    model = finish(u, pairs, table)
    sums = documents(table, model).unionByName(contexts(table, model, parts)).withColumns({"keys": F.lit(None).cast("binary"), "sizes": F.lit(None).cast("binary")})
    heads = table.filter("part < 0").select("block", "keys", "sizes")
    everything = sums.unionByName(heads, allowMissingColumns=True)
    norm = np.log10(u.tokens + u.types + 1)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["keys"].notna()].iloc[0]
        sizes = unpacked(head["sizes"], np.int64)
        held, sizes = (sizes & 1).astype(bool), sizes >> 1
        ids = unpacked(head["keys"], np.int64)
        ids, null = ids[: len(sizes)], ids[len(sizes) :].astype(bool)
        out = np.zeros((3, len(sizes)))
        for r in pdf[pdf["docs"].notna()].itertuples():
            where = unpacked(r.docs, np.uint32)
            for i, x in enumerate((r.score, r.base, r.known)):
                out[i][where] += unpacked(x, np.float64)
        return pd.DataFrame({"key": pd.array(ids, "Int64").copy() if not null.any() else pd.Series(ids, dtype="Int64").mask(null), "held_out": held, "n_tokens": sizes, "n_known": np.rint(out[2]).astype(np.int64), "train_tokens": u.tokens, "base_score": out[1] - sizes * norm, "score": out[0]})

    schema = "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return everything.groupBy("block").applyInPandas(lambda pdf: total(pdf), schema).withColumnRenamed("key", key)
