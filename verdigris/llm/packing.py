"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Texts are encoded with a vocabulary file, and cut into pieces of at most the largest permitted length.
Pieces are dealt by a hash of their document and number into shards of about SHARD documents; a shard
is packed on its own, so no task ever holds more than a run of RUN pieces, however many documents there
are or however long they are.

In a shard, pieces go longest first into the open bin that they fill best. Where none fits, a bin
is opened, of the permitted length that costs least for each token it may be expected to hold: the
piece, and as much of what is still to come as fits. At the end each bin is made as small as its
contents allow: the cheapest permitted length that holds them. A bin becomes a sequence: the ids of its
pieces one after the other, and where each begins.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import texts, tune

#: Permitted sequence lengths in tokens; documents of a shard; pieces that are packed together at most.
LENGTHS, SHARD, RUN = (512, 1024, 2048, 4096, 8192), 4096, 8192
#: Fixed cost of a sequence, in tokens; length at which attention costs as much as all else.
FIXED, ATTENTION = 512, 16384
#: Equal rows from which on they are dealt by their place, and not by their hash (a thousandth of all rows at least).
HOT = 4096

SCHEMA = "length int, used int, doc_ids array<{kind}>, documents array<struct<doc_id:{kind},piece:int,start:bigint,at:int,n_tokens:int>>, ids binary"


def cost(length: int, fixed: int = FIXED) -> float:
    """What a sequence of a length costs, in tokens: its start, its tokens (padding too) and their attention."""
    return fixed + length * (1 + length / ATTENTION)


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, fixed: int = FIXED) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's final length. Sizes are between 1 and the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = int(sum(sizes))
    bin_of, offset, used = [0] * len(sizes), [0] * len(sizes), []
    room: list[tuple[int, int]] = []  # (free tokens, bin), in order
    for i in order:
        size = sizes[i]
        left -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fit = [x for x in lengths if x >= size]
            free = min(fit, key=lambda x: (cost(x, fixed) / min(x, size + left), -x))
            b = len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bin_of, offset, [min((x for x in lengths if x >= u), key=lambda x: cost(x, fixed)) for u in used]


class Encoder:
    """Ids of texts under a vocabulary of ranked byte sequences, in as few bytes as they take (little-endian)."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), self.kind)

    def decode(self, ids: bytes) -> str:
        return self.encoding.decode(np.frombuffer(ids, self.kind).tolist(), errors="strict")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The file's encoder, built once in each worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def pieces(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", most: int = max(LENGTHS)) -> DataFrame:
    """key, told (hash of the text), piece, start, size, ids: every text encoded and cut; texts without tokens are one piece of size 0."""
    tune(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("told"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            at, piece, start, size, ids = [], [], [], [], []
            for n, t in enumerate(texts(b)):
                x = e.encode(t)
                for i in range(max(1, -(-len(x) // most))):
                    part = x[i * most : (i + 1) * most]
                    at.append(n)
                    piece.append(i)
                    start.append(i * most)
                    size.append(len(part))
                    ids.append(part.tobytes())
            of = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_pydict({"key": of.column("key"), "told": of.column("told"), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "size": pa.array(size, pa.int32()), "ids": pa.array(ids, pa.binary())})

    return rows.mapInArrow(run, f"key {kind}, told bigint, piece int, start bigint, size int, ids binary")


def dealt(df: DataFrame, cut: DataFrame, key: str, text: str, shard: int) -> DataFrame:
    """The pieces with their shard: by document and number, so that it does not depend on where a row lies. Only of rows
    that are equal and very many, each is dealt by its place."""
    n = df.count()
    shards = max(1, -(-n // shard))
    told = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    same = df.groupBy(F.col(key).alias("_key"), told.alias("_told")).agg(F.count("*").alias("_n"))
    hot = F.broadcast(same.filter(F.col("_n") >= max(HOT, n // 1000)).drop("_n"))  # a thousand rows at most
    marked = cut.join(hot, F.col("key").eqNullSafe(F.col("_key")) & (F.col("told") == F.col("_told")), "left")
    place = F.when(F.col("_told").isNotNull(), F.monotonically_increasing_id()).otherwise(0)
    return marked.withColumn("shard", F.pmod(F.xxhash64("key", "told", "piece", place), F.lit(shards))).drop("_key", "_told")


def pack(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS, fixed: int = FIXED, shard: int = SHARD) -> DataFrame:
    """One row per sequence: length (a permitted one), used (tokens), doc_ids, documents (doc_id, piece, start in its
    document, at in the sequence, n_tokens, in order) and ids (little-endian, 2 bytes each where the vocabulary allows).

    path and pattern name the vocabulary (ranked byte sequences, as executors can open it). Texts without tokens (null
    and empty ones) take no room: they are listed in rows of length 0 without ids. Repeated rows and keys are packed
    each on its own, null keys like others; equal lengths go in the order of key, text and piece. The result does not
    depend on the order of the rows or how they are split, but for which of very many equal rows is where. Other
    columns are not read. An empty table gives no sequence.
    """
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths must be positive")
    cut = pieces(df, path, pattern, key, text, max(lengths))
    kind = cut.schema["key"].dataType.simpleString()
    placed = dealt(df, cut, key, text, shard).repartition("shard").sortWithinPartitions("shard", F.desc("size"), "key", "told", "piece")
    names = ("key", "piece", "start", "size", "ids", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            shards = b.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)] if len(shards) else []
            for a, z in zip(edges, edges[1:]):
                if waiting and waiting[-1].column("shard")[0].as_py() != shards[a]:
                    yield from sequences(pa.Table.from_batches(waiting), lengths, fixed, schema)
                    waiting, held = [], 0
                while a < z:
                    part = b.slice(a, min(z - a, RUN - held))
                    waiting.append(part)
                    held, a = held + part.num_rows, a + part.num_rows
                    if held == RUN:
                        yield from sequences(pa.Table.from_batches(waiting), lengths, fixed, schema)
                        waiting, held = [], 0
        if waiting:
            yield from sequences(pa.Table.from_batches(waiting), lengths, fixed, schema)

    of = cut.schema["key"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(of.simpleString())
    if arrow is None:
        raise TypeError(f"a key of type {kind}")
    entry = pa.struct([("doc_id", arrow), ("piece", pa.int32()), ("start", pa.int64()), ("at", pa.int32()), ("n_tokens", pa.int32())])
    schema = pa.schema([("length", pa.int32()), ("used", pa.int32()), ("doc_ids", pa.list_(arrow)), ("documents", pa.list_(entry)), ("ids", pa.binary())])
    return placed.select(*names).mapInArrow(run, SCHEMA.format(kind=kind))


def sequences(rows: pa.Table, lengths: Sequence[int], fixed: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The sequences of pieces (key, piece, start, size, ids) that are packed together, longest piece first."""
    size = rows.column("size").to_numpy()
    full = np.flatnonzero(size > 0)
    bins, offset, final = best_fit(size[full].tolist(), lengths, fixed)
    order = np.lexsort((offset, bins)) if len(full) else np.zeros(0, np.int64)
    at, bin_of = full[order], np.array(bins, np.int64)[order]
    edges = np.r_[np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]][: len(bin_of)]), len(bin_of)]
    empty = np.flatnonzero(size == 0)
    if len(empty):
        at, edges = np.r_[at, empty], np.r_[edges, len(at) + len(empty)]
    offset = np.r_[np.array(offset, np.int64)[order], np.zeros(len(empty), np.int64)]
    taken = rows.take(pa.array(at)).combine_chunks()
    column = lambda c: taken.column(c).combine_chunks()
    entries = pa.StructArray.from_arrays([column("key"), column("piece"), column("start"), pa.array(offset, pa.int32()), column("size")], fields=list(schema.field("documents").type.value_type))
    ids = taken.column("ids").to_pylist()
    used = [int(size[at[a:z]].sum()) for a, z in zip(edges, edges[1:])]
    for i in range(0, len(used), 256):
        cut = edges[i : i + 257]
        inside = pa.array(cut - cut[0], pa.int32())
        part = slice(int(cut[0]), int(cut[-1]))
        docs = entries.slice(part.start, part.stop - part.start)
        yield pa.RecordBatch.from_arrays([
            pa.array([final[int(bin_of[a])] if a < len(bin_of) else 0 for a in cut[:-1].tolist()], pa.int32()), pa.array(used[i : i + 256], pa.int32()),
            pa.ListArray.from_arrays(inside, docs.field("doc_id")), pa.ListArray.from_arrays(inside, docs),
            pa.array([b"".join(ids[a:z]) or None for a, z in zip(cut.tolist(), cut[1:].tolist())], pa.binary()),
        ], schema=schema)


def waste(sizes: Iterable[int], lengths: Iterable[int]) -> float:
    """Share of the bins' tokens that is padding."""
    total = sum(lengths)
    return 1 - sum(sizes) / total if total else 0.0
