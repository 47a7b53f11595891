"""Vector codes: the search against every distance, the query against SQL and plain loops, odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from verdigris.llm import quantize
from verdigris.llm.queries import ORACLES, QUERIES

FLOATS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """code, error of each usable row of (vec_id, embedding, label), and the codebooks, by loops."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[int(np.floor(256 * float(x))) for x in r[1][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts]] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, of in own.items():
                books[p][e] = [sum(x) // len(of) for x in zip(*of)]
    out = []
    for r, c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, total[label], sha) for i, c, e, label in out if i is not None), sorted((c, e) for i, c, e, _ in out if i is None)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 7), st.integers(0, 10**6), st.sampled_from([2, 40, 3000]))
def test_search_equals_all_distances(rows, entries, width, seed, spread):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-spread, spread, (rows, width)), rng.integers(-spread, spread, (entries, width))
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    index, gap = quantize.nearest_entries(x, book)
    assert (index == full.argmin(1)).all() and (gap == full.min(1)).all()


def test_dimensions_in_descending_variance():
    book = np.array([[0, 5, -100, 5], [0, 6, 100, 4], [0, 5, 0, 5]])
    assert quantize.by_variance(book).tolist() == [2, 1, 3, 0]


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(c.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({ORACLES['op11_codes']})").fetchall())
    assert sorted(map(tuple, QUERIES["op11_codes"](spark, DATA).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 32)], int(i % 3)) for i in range(90)]
    rows += rows[:5] + [(7, rows[9][1], 1), (None, rows[2][1], None), (None, rows[30][1], None), (200, None, 1), (201, [1.0] * 31 + [None], 1), (202, [float("nan")] * 32, 2), (203, [float("-inf")] + [0.0] * 31, 2), (204, [], 0), (205, rows[4][1], None)]
    rng.shuffle(rows)
    rows = [tuple(r) for r in rows]
    df = spark.createDataFrame([(None if a is None else int(a), None if b is None else list(b), None if c is None else int(c)) for a, b, c in rows], FLOATS)
    # components as the table holds them
    held = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want, nameless = plain(held)
    got = quantize.compress(df.selectExpr("*", "'x' AS code", "1 AS of", "2 AS id"))
    assert sorted(map(tuple, got.filter("vec_id IS NOT NULL").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == want
    assert sorted(map(tuple, got.filter("vec_id IS NULL").select("code", "error").collect())) == nameless


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(2, [0.5] * 16, None), (1, [0.25] * 16, None)], FLOATS)
    got = {r.vec_id: r for r in quantize.compress(df).collect()}
    assert got[1].code == "00" * 16 and got[2].code == "01" * 16 and got[1].error == 0 and got[2].label_error == 0
    assert quantize.compress(df.limit(0)).collect() == [] and quantize.compress(df.limit(0)).columns == quantize.compress(df).columns


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = quantize.usable(df.selectExpr("vec_id AS id", "embedding AS v"), "v")
    books = quantize.fit(rows)
    got = quantize.decode(quantize.encode(rows, books), books).toPandas().set_index("id")
    for r in df.limit(50).collect():
        whole = np.floor(np.array(r.embedding, np.float64) * 256)
        assert got.loc[r.vec_id].error == ((np.array(got.loc[r.vec_id].vector) * 256 - whole) ** 2).sum()


def test_refusals(spark):
    for rows in ([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 15, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            quantize.compress(spark.createDataFrame(rows, FLOATS)).collect()
