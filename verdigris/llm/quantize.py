"""Vector compression by product codebooks of integers, with partial-distance search for the nearest entry.

Vectors become integers, floor(SCALE x) of each component, and are cut into equal parts, each with a codebook of its own.
An entry is looked for dimension by dimension, those in which the codebook varies most first. An entry is dropped as soon
as what its distance has come to exceeds a distance that is known in full, so most are dropped after one or two
dimensions. All of it is integer arithmetic: results depend neither on partitions nor on the order of additions.

A codebook is a few thousand integers. Each round every task adds up the parts that its vectors give to each entry, and
Spark adds up the tasks' sums; only those, as many as the codebooks have numbers, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import common_values, spread_join, staged, tune

#: Parts of a vector, entries of a codebook (256 at most, as an index is two hex digits), rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest integer that a component may become: squares of differences stay far from 64 bits.
LARGEST = 1 << 26
#: Vectors of a block of the search.
BLOCK = 1024


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook [entries, width] in descending variance, the first of equal ones first."""
    n = len(book)
    spread = n * (book * book).sum(0) - book.sum(0) ** 2
    return np.argsort(-spread, kind="stable")


def nearest_entries(parts: np.ndarray, book: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book [entries, width] for each of parts [n, width], ties to the lower, and the squared distance.

    The entry that looks best so far is measured in full, and the least such distance is the bound. Pairs of part and
    entry are masked out once their sum over the dimensions seen is strictly more, so every entry at the least distance
    stays to the end.
    """
    order = by_variance(book) if order is None else order
    n, row_of = len(parts), np.arange(len(parts))
    if not n or not len(order):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums = (parts[:, order[0], None] - book[None, :, order[0]]) ** 2
    bound = ((parts - book[sums.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for at, d in enumerate(order[1:], 2):
        sums = sums + (parts[row, d] - book[entry, d]) ** 2
        if at < len(order):
            least = np.minimum.reduceat(sums, np.searchsorted(row, row_of))
            best = np.flatnonzero(sums == least[row])
            best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
            bound = np.minimum(bound, ((parts - book[entry[best]]) ** 2).sum(1))
        keep = sums <= bound[row]
        row, entry, sums = row[keep], entry[keep], sums[keep]
    start = np.searchsorted(row, row_of)
    least = np.minimum.reduceat(sums, start)
    best = np.flatnonzero(sums == least[row])
    best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
    return entry[best], least


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """[rows, width] floor(scale x) of a column of arrays without nulls; ValueError beyond LARGEST."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return x.astype(np.int64).reshape(-1, width)


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[rows, parts] entries of vectors [rows, width], and their squared distances; books [parts, entries, part width]."""
    parts = len(books)
    cut = vectors.reshape(len(vectors), parts, -1)
    code, error = np.zeros((2, len(vectors), parts), np.int64)
    orders = [by_variance(b) for b in books]
    for a in range(0, len(vectors), BLOCK):
        for p in range(parts):
            code[a : a + BLOCK, p], error[a : a + BLOCK, p] = nearest_entries(cut[a : a + BLOCK, p], books[p], orders[p])
    return code, error


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has components, none of them null, NaN or infinite."""
    x = F.col(vector)
    return df.filter(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks [parts, entries, part width] learned from all of rows (id, v); None of an empty table.

    They start as the parts of the rows of the smallest ids (null last; equal ids by their vectors), fewer entries where
    there are fewer rows. Each round gives every part to its nearest entry and moves each entry to the floor of the mean
    of its parts; one that gets none stays.
    """
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] is None:
        return None
    width = sizes[1]
    if sizes[0] != width or width % parts or entries > 256:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}, and entries 256 at most")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = np.ascontiguousarray(integers(first, width, scale).reshape(len(first), parts, -1).transpose(1, 0, 2))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            x = integers(b.column("v"), width, scale)
            code, _ = assigned(x, books)
            cut = x.reshape(len(x), parts, -1)
            for p in range(parts):
                np.add.at(total[p], code[:, p], cut[:, p])
                n[p] += np.bincount(code[:, p], minlength=books.shape[1])
        p, e = np.nonzero(n)
        wide = books.shape[2]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.repeat(p, wide), pa.int32()), "entry": pa.array(np.repeat(e, wide), pa.int32()), "place": pa.array(np.tile(np.arange(wide), len(p)), pa.int32()),
            "total": pa.array(total[p, e].reshape(-1), pa.int64()), "n": pa.array(np.repeat(n[p, e], wide), pa.int64()),
        })

    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(add_up, "part int, entry int, place int, total bigint, n bigint")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
        books = books.copy()  # tasks hold the books of their round
        books[sums["part"], sums["entry"], sums["place"]] = sums["total"] // sums["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """code (the entries of the parts in order, two hex digits each) and error (their squared distances, added up) beside the columns of rows; v is the vector, and goes."""
    width = books.shape[0] * books.shape[2]
    kept = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = assigned(integers(b.column("v"), width, scale), books)
            text = [x.tobytes().hex() for x in code.astype(np.uint8)]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in kept} | {"code": pa.array(text, pa.string()), "error": pa.array(error.sum(1), pa.int64())})

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, code string, error bigint")


def decode(df: DataFrame, books: np.ndarray, scale: int = SCALE, code: str = "code") -> DataFrame:
    """df with vector, array<double>: the entries that a code names, divided by scale. A null code gives null."""

    @F.pandas_udf("array<double>")
    def vector(codes):
        return codes.map(lambda c: None if c is None else np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(c))]) / scale)

    return df.withColumn("vector", vector(code))


def fingerprint(books: np.ndarray) -> str:
    """SHA-256, in hex, of all components in order of part, entry and place, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """key, code, error, label_error (the errors of all rows of equal label, nulls together), codebooks_sha256 of every usable row.

    Rows whose vector is null or empty or holds a null, NaN or infinite component are left out; those with a null key or
    label are rows like others, and repeated rows give repeated rows. Vectors of several lengths, lengths that parts does
    not divide and components beyond LARGEST / scale are refused. An empty table gives none. Other columns are not read.
    """
    spark = df.sparkSession
    tune(spark)
    of = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    rows = usable(df.select(F.col(key).alias("id"), of.alias("of"), F.col(vector).alias("v")), "v")
    books = fit(rows, parts, entries, rounds, scale)
    if books is None:
        empty = rows.select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.limit(0)
    coded = staged(encode(rows, books, scale), "codes")
    sums = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    whole = spread_join(coded, sums.drop("n"), "of", common_values(sums, "of"))
    return whole.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows by SQL over embeddings (vec_id, embedding, label): every distance in full."""
    steps = []
    gap = "list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT p.*, c.entry, {gap} AS gap FROM p JOIN c{r} c ON c.part = p.part QUALIFY row_number() OVER (PARTITION BY p.rid, p.part ORDER BY {gap}, c.entry) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, entry, i, sum(s[i])::BIGINT t, count(*) n FROM a{r}, (SELECT unnest(range(1, w + 1)) i FROM wide) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT part, entry, list((t - (t % n + n) % n) // n ORDER BY i) s FROM m{r} GROUP BY ALL)")
            steps.append(f"c{r + 1} AS (SELECT c.part, c.entry, coalesce(n.s, c.s) s FROM c{r} c LEFT JOIN n{r} n ON n.part = c.part AND n.entry = c.entry)")
    return (
        f"WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) q, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) rid FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        f"wide AS (SELECT max(len(q)) // {parts} w FROM v), p AS (SELECT vec_id, label, rid, part, q[part * w + 1 : part * w + w] s FROM v, wide, (SELECT unnest(range({parts})) part)), c0 AS (SELECT part, rid - 1 AS entry, s FROM p WHERE rid <= {entries}), "
        + ", ".join(steps)
        + f", f AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) h FROM c{rounds}), o AS (SELECT rid, any_value(vec_id) vec_id, any_value(label) label, string_agg(printf('%02x', entry), '' ORDER BY part) code, sum(gap)::BIGINT error FROM a{rounds} GROUP BY rid) "
        "SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT label_error, h codebooks_sha256 FROM o, f"
    )
