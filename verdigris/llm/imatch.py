"""I-Match fingerprints: distinct terms within a band of inverse document frequency, hashed by random sub-lexicons.

The lexicon holds the terms whose document frequency, counted over all rows, is a share between
LEAST and MOST of them (idf between -ln MOST and -ln LEAST). Its size has a bound that does not
grow with the data: terms in at least a share LEAST of the rows number at most (mean distinct terms
of a row) / LEAST.

Each level deals the lexicon at random into 2^level sub-lexicons, of which up to GROUPS are used.
A document's distinct terms in a sub-lexicon are sorted and hashed together; the fingerprint lists
those hashes of level 0 and of all levels from the document's own on, where it has about one term in
each or fewer, so that few hold any. Two documents agree in a sub-lexicon only if all their terms
there are the same, so level 0 tells equality and fine ones likeness: it is the share of agreeing
sub-lexicons among those that hold a term of either document, at the levels where the larger of
the two has about one term in each. Levels end at LEVELS, beyond any document's number of terms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import mix64, texts, tune

#: Shares of the rows that a term of the lexicon occurs in.
LEAST, MOST = 0.0005, 0.1
#: Terms that a lexicon, which every task holds, may have at most; a corpus of more is refused.
TERMS = 20_000_000
#: Levels of sub-lexicons; sub-lexicons used of a level; levels that likeness looks at, from the fitting one on.
LEVELS, GROUPS, FINER = 60, 16, 2
#: Fewer terms than this in the band tell nothing: such a document is fingerprinted by all its terms instead.
FEW = 2
#: Rows of a range of keys, and most ranges.
RANGE, RANGES = 4096, 10_000
_WORD = re.compile(r"[^\W_]+")
_WIDTH = 6


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) or 1


class _Hashes(dict):
    """Hashes of terms; stops growing at a size."""

    def __missing__(self, term: str) -> int:
        h = term_hash(term)
        if len(self) < 400_000:
            self[term] = h
        return h


def terms(text: str) -> set[str]:
    """The distinct terms: runs of letters and digits, lower case."""
    return set(_WORD.findall(text.lower()))


def lexicon(df: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms in the band, from all rows. Counted in every task, then added up by range of hashes.

    A lexicon of more than TERMS terms is refused by the tasks. A term must occur in two rows at least, and terms in two rows are in the band however few rows there are.
    """
    spark = df.sparkSession
    tune(spark)
    rows = df.select(F.col(text).alias("text"))
    parts = max(16, min(4096, rows.rdd.getNumPartitions() * 2))
    n = rows.count()
    low = max(2, int(np.ceil(least * n)))
    high = max(low, int(most * n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, size = _Hashes(), [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(seen), return_counts=True)
            edges = np.searchsorted(h, (np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)))
            return pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "hashes": pa.array([x.tobytes() for x in np.split(h, edges)], pa.binary()), "counts": pa.array([x.astype(np.uint32).tobytes() for x in np.split(c, edges)], pa.binary())})

        for b in batches:
            for t in texts(b):
                h = np.fromiter(set(map(known.__getitem__, terms(t))), np.uint64)
                seen.append(h)
                size += len(h)
                if size > 4_000_000:
                    yield flush()
                    seen, size = [], 0
        if size:
            yield flush()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
        c = np.frombuffer(b"".join(pdf["counts"]), np.uint32)
        h, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, weights=c, minlength=len(h))
        band = h[(c >= low) & (c <= high)]
        if len(band) * parts > 4 * TERMS:  # hashes are even, so the whole is about so many times a part
            raise ValueError(f"the lexicon has more than {TERMS} terms; raise the least share of the rows")
        return pd.DataFrame({"hashes": [band.tobytes()]})

    got = rows.mapInArrow(count, "part int, hashes binary, counts binary").groupBy("part").applyInPandas(add, "hashes binary").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in got), np.uint64))


class Fingerprinter:
    """Fingerprints under one lexicon."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.known, self.all = lexicon, {}, _Hashes()

    def _in_band(self, term: str) -> int:
        h = self.all[term]
        at = int(np.searchsorted(self.lexicon, np.uint64(h)))
        found = h if at < len(self.lexicon) and int(self.lexicon[at]) == h else 0
        if len(self.known) < 400_000:
            self.known[term] = found
        return found

    def hashes(self, text: str) -> np.ndarray:
        """Sorted hashes of the text's distinct terms in the band, or of all its terms if those are too few."""
        words, known, band = terms(text), self.known, self._in_band
        found = {known[w] if w in known else band(w) for w in words}
        found.discard(0)
        if len(found) < FEW:
            found = set(map(self.all.__getitem__, words))
        return np.sort(np.fromiter(found, np.uint64, len(found)))

    def sketches(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        """For each document the sorted entries of its sub-lexicons with terms: level, group (4 bits) and hash (24 bits)."""
        sizes = np.array([len(x) for x in documents], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int64) for _ in documents]
        h = np.concatenate(documents)
        doc = np.repeat(np.arange(len(documents)), sizes)
        own = np.array([own_level(int(n)) for n in sizes])
        found = [_entries(0, doc, np.zeros(len(h), np.int64), h)]
        # neighbouring levels are dealt independently; every other one goes on with the terms of the groups used so far
        for first in range(1, 1 + FINER):
            term, of, deal = h, doc, mix64(h ^ np.uint64(0x5851F42D4C957F2D + first))
            for level in range(first, LEVELS, FINER):
                group = deal >> np.uint64(64 - level)
                use = group < GROUPS
                term, of, deal, group = term[use], of[use], deal[use], group[use].astype(np.int64)
                if not len(term):
                    break
                fits = own[of] <= level
                if fits.any():
                    found.append(_entries(level, of[fits], group[fits], term[fits]))
        of, entry = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((entry, of))
        return np.split(entry[order], np.cumsum(np.bincount(of, minlength=len(documents)))[:-1])


def own_level(size: int) -> int:
    """The level at which a document of so many terms has about one in each sub-lexicon."""
    return min(LEVELS - FINER, max(0, (size - 1).bit_length()))


def _entries(level: int, doc: np.ndarray, group: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and entries of a level's sub-lexicons; terms are sorted within a document, and one at least."""
    cell = doc * GROUPS + group
    order = np.argsort(cell, kind="stable")  # terms stay sorted within a cell
    cell, term = cell[order], term[order]
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    rank = np.arange(len(cell)) - np.repeat(start, np.diff(np.r_[start, len(cell)]))
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix64(term + mix64(rank.astype(np.uint64) + np.uint64(level))), start)
    value = (mix64(total) >> np.uint64(64 - 4 * _WIDTH)).astype(np.int64)
    return cell[start] // GROUPS, (level * GROUPS + cell[start] % GROUPS) << 4 * _WIDTH | value


def likeness(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> float:
    """Likeness of two sketches with the numbers of terms behind them; of two empty ones 1."""
    if not size_a or not size_b:
        return float(size_a == size_b)
    if size_a == size_b and np.array_equal(a, b):
        return 1.0
    level = own_level(max(size_a, size_b))
    ends = np.array([level, level + FINER]) * GROUPS << 4 * _WIDTH
    x, y = (set(e[slice(*np.searchsorted(e, ends))].tolist()) for e in (a, b))
    some = len({e >> 4 * _WIDTH for e in x | y})
    return len(x & y) / some if some else 0.0


def encoded(sketch: np.ndarray, size: int) -> str:
    """A fingerprint as text: the number of terms, then the entries, each a level (2 digits), a group and a hash."""
    return f"{size:x}:" + "".join([f"{e:0{3 + _WIDTH}x}" for e in sketch.tolist()])


def decoded(fingerprint: str) -> tuple[np.ndarray, int]:
    size, _, rest = fingerprint.partition(":")
    return np.array([int(rest[i : i + 3 + _WIDTH], 16) for i in range(0, len(rest), 3 + _WIDTH)], np.int64), int(size, 16)


def compare(one: str, other: str) -> float:
    """likeness() of two fingerprints as text."""
    return likeness(*decoded(one), *decoded(other))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_descending_order(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, place, extra: rows in descending order of key within a partition's places, with what follows each place.

    Keys are cut into ranges of about RANGE rows. A range also gets, as extra rows, copies of the first of the range
    that follows it (the last range: of the first), so that each range can be worked through alone. Null keys come
    last; rows of one key are in descending order of text.
    """
    spark = df.sparkSession
    lowest = -(1 << 63)
    rows = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(RANGES, n // RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    splits = np.unique(np.array(rows.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 100 * ranges)).first()[0] if shares and n else [], np.int64))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(len(splits) - np.searchsorted(splits, keys.to_numpy(np.int64), side="right")).astype("int32")

    placed = rows.withColumn("place", place("key"))
    tops = sorted((r["place"], r["top"]) for r in rows.select("key").withColumn("place", place("key")).groupBy("place").agg(F.max("key").alias("top")).collect())
    copies = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]
    also = F.broadcast(spark.createDataFrame(copies, "top bigint, goes int"))  # a row for each range
    both = placed.join(also, F.col("key") == F.col("top"), "left").select(
        "key", "text", F.explode(F.when(F.col("goes").isNull(), F.array(F.struct("place", F.lit(False).alias("extra")))).otherwise(F.array(F.struct("place", F.lit(False).alias("extra")), F.struct(F.col("goes").alias("place"), F.lit(True).alias("extra"))))).alias("at")
    )
    return both.select("key", "text", "at.place", "at.extra").repartition("place").sortWithinPartitions("place", "extra", F.desc("key"), F.desc("text"))


def fingerprint(df: DataFrame, words: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row of df; null texts are empty, and empty ones have no terms."""
    tune(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(words)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter(shared.value)
        for b in batches:
            hashes = [f.hashes(t) for t in texts(b)]
            prints = [encoded(s, len(h)) for s, h in zip(f.sketches(hashes), hashes)]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "fingerprint": pa.array(prints, pa.string())})

    return rows.mapInArrow(run, "key " + rows.schema["key"].dataType.simpleString() + ", fingerprint string").withColumnRenamed("key", key)


def against_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The row that follows is the next in descending order of the integer key, after the last the first; a single row
    follows itself. Null texts are empty; null keys come last and stay null; rows of one key go in descending order
    of text. Other columns are not read.
    """
    spark = df.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(lexicon(df, text))
    lowest = -(1 << 63)
    schema = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter(shared.value)
        waiting = None  # the last row so far and its place: what follows it is still to come
        for b in batches:
            keys, places, extras = (b.column(c).to_pylist() for c in ("key", "place", "extra"))
            column, at = b.column("text"), 0
            while at < len(keys):
                group, size = [], 0
                while at < len(keys) and size < 1 << 20:
                    t = column[at].as_py()
                    group.append((keys[at], t, places[at], extras[at]))
                    size += len(t)
                    at += 1
                rows = ([waiting] if waiting else []) + group
                waiting = None if rows[-1][3] else rows[-1]
                pairs = [(rows[i], rows[i + 1]) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
                if not pairs:
                    continue
                changed = [edited(a[1], z[1]) for a, z in pairs]
                own = {id(r): f.hashes(r[1]) for r in {id(r): r for p in pairs for r in p}.values()}
                index = {k: i for i, k in enumerate(own)}
                sketch = f.sketches(list(own.values()))
                new = [f.hashes(t) for t in changed]
                new_sketch = f.sketches(new)
                out = []
                for i, (a, z) in enumerate(pairs):
                    s, n = sketch[index[id(a)]], len(own[id(a)])
                    t, m = sketch[index[id(z)]], len(own[id(z)])
                    out.append((None if a[0] == lowest else a[0], len(a[1]), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), encoded(s, n), encoded(new_sketch[i], len(new[i])), likeness(s, n, new_sketch[i], len(new[i])), likeness(s, n, t, m)))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"key": "Int64"}), preserve_index=False)

    names = [x.split()[0] for x in schema.split(", ")]
    return in_descending_order(df, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
