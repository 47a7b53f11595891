"""The Jaccard join: prefixes against all pairs, components against brute force and SQL, odd rows, large groups."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from verdigris.llm import jaccard, minhash
from verdigris.llm.queries import ORACLES, QUERIES


def shingle_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def plain(rows, least=90):
    """(key, size, smallest key reached) of rows (key, text), by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    lowest = {}
    for (k, _), g in zip(rows, group):
        lowest[g] = min([x for x in (lowest.get(g), k) if x is not None], default=None)
    return sorted(((k, len(s), lowest[g]) for (k, _), s, g in zip(rows, sets, group)), key=str)


def got(df, **more):
    return sorted((tuple(r) for r in jaccard.join(df, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def copies(rng, groups, most, words=(12, 60), edits=3):
    """Texts in groups of near copies: each edits some words of one of its group."""
    out = []
    for g in range(groups):
        own = [[f"g{g}w{rng.randrange(40)}" if rng.random() < 0.5 else f"c{rng.randrange(25)}" for _ in range(rng.randrange(*words))]]
        for _ in range(rng.randrange(most)):
            new = list(rng.choice(own))
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(new))
                new[at : at + rng.randrange(2)] = [f"x{rng.randrange(500)}"]
            own.append(new)
        out += [" ".join(w) for w in own]
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(50, 100), st.integers(1, 6))
def test_linked_sets_share_prefix_elements(seed, least, longest):
    """Any two sets that link share, within their prefixes, the smaller l at least; whatever the table says."""
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 50, jaccard.CELLS // 64).repeat(64)
    a = np.unique(rng.integers(0, 2**63, rng.integers(1, 120), dtype=np.uint64) * np.uint64(2))
    drop, add = rng.integers(0, 8, 2)
    b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64) * np.uint64(2)])
    if not len(b):
        return
    found = [jaccard.prefix(x, table, 3.0, least, longest) for x in (a, b)]
    if jaccard.linked(a, b, least):
        shared = len(np.intersect1d(found[0][1], found[1][1]))
        assert shared >= min(found[0][0], found[1][0])
        front = jaccard.Front(np.array([len(a), len(b)]), np.array([f[0] for f in found]), [f[1] for f in found], np.array([f[2] for f in found]))
        for i in (0, 1):
            assert front.possible(i, np.array([1 - i]), np.array([shared]), least).all()
    both = len(np.intersect1d(a, b))
    assert jaccard.common(a, b) == both and jaccard.linked(a, b, least) == (100 * both >= least * (len(a) + len(b) - both))


def test_common_shingles_lengthen_the_prefix():
    """A set of rare elements takes the shortest prefix; one whose prefix would be common ones asks for more of them."""
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64) * np.uint64(2))
    rare, often = np.ones(jaccard.CELLS, np.int64), np.full(jaccard.CELLS, 1000)
    assert jaccard.prefix(h, rare, 0.0)[0] == 1 and len(jaccard.prefix(h, rare, 0.0)[1]) == 11
    l, first, edge = jaccard.prefix(h, often, 0.0)
    assert l == jaccard.LONGEST and len(first) == 10 + l and edge == 1000
    few = rare.copy()
    few[jaccard.cells(h[:90])] = 1000
    assert set(jaccard.prefix(h, few, 0.0)[1]) >= set(h[90:])  # rare ones come first


def test_shingles_of_texts():
    known = jaccard.Words()
    for text in ("a b c d a b c", "A\tb\x0bC", "one two", "ONE two", "x", "", " \n", "É é É é", "a\xa0b c d", "a\x1cb c d"):
        assert len(jaccard.elements(text, known)) == len(shingle_set(text))
    assert (jaccard.elements("A b\nC", known) == jaccard.elements("a B c", known)).all() and len(jaccard.elements("É é", known)) == 1
    assert jaccard.elements("É x y", known)[0] != jaccard.elements("é x y", known)[0]


@pytest.mark.parametrize("block", [None, 4])
def test_components_are_those_of_brute_force(spark, monkeypatch, block):
    """Groups of near copies with common words, chains, exact copies; in one block and in many."""
    if block:
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(jaccard, "FAN", 3)
        monkeypatch.setattr(minhash, "FEW", 0)
    rng = random.Random(7)
    texts = copies(rng, 25, 14)
    chain = [f"k{i}" for i in range(60)]
    texts += [" ".join(chain[:20] + [f"n{j}" if j < i else c for j, c in enumerate(chain[20:])]) for i in range(0, 40, 2)]
    texts += texts[:9] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(frame(spark, rows).repartition(5)) == plain(rows)


def test_other_thresholds(spark):
    rows = list(enumerate(copies(random.Random(3), 12, 8, edits=6)))
    assert got(frame(spark, rows), least=70) == plain(rows, 70)
    assert got(frame(spark, rows), longest=1) == plain(rows)


def test_large_group_with_strangers(spark):
    """Thousands of near copies, one link apart from a few that only reach the group through one of them."""
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base + [f"t{i}"]) for i in range(2500)]
    texts += [" ".join(base + ["t17"] + [f"u{j}" for j in range(12)]), " ".join(base[:60] + [f"v{j}" for j in range(60)])]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {k: c for k, _, c in got(frame(spark, rows))}
    assert [found[i] for i in range(2500)] == [0] * 2500
    assert found[2500] == 0 and found[2501] == 2501  # the first shares 119 of 132 with one of them and less with others


def test_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs home"
    long = " ".join(f"w{i % 977} the of{i}" for i in range(60_000))
    rows = [(5, base), (5, base), (2, base.upper()), (3, None), (4, ""), (6, " \t\n"), (None, base), (7, "one"), (8, "ONE"), (9, "one two"), (None, "alone"), (None, None), (10, long), (11, long + " end"), (2, "another text of key two here"), (12, "\x00 ퟿ 😀")]
    df = frame(spark, rows)
    assert got(df.selectExpr("*", "1 AS key", "2 AS node", "'x' AS same", "3 AS size", "4 AS component_id")) == plain(rows)
    assert got(df.limit(0)) == []
    assert got(df.filter("text IS NULL")) == [(3, 0, 3), (None, 0, None)]


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rows = sorted(map(tuple, QUERIES["op12_join"](spark, DATA).select("doc_id", "n_shingles", "component_id").collect()))
    assert rows == sorted(c.sql(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES['op12_join']})").fetchall())
    assert sorted(rows, key=str) == plain(c.sql("SELECT doc_id, text FROM documents").fetchall())


def test_counts_in_few_bytes():
    for top in (1, 255, 256, 65_535, 65_536, 2**40):
        n = np.array([0, 1, top])
        assert (jaccard.widened(jaccard.narrow(n)) == n).all()


def test_frequencies_count_documents(spark):
    df = frame(spark, [(i, f"a b c d a b c x{i % 3} y z") for i in range(50)] + [(99, None)])
    table, known = jaccard.frequencies(df.repartition(6), "text"), jaccard.Words()
    want = np.zeros(jaccard.CELLS, np.int64)
    for r in df.collect():
        np.add.at(want, jaccard.cells(jaccard.elements(r.text or "", known)), 1)
    assert (table == want).all()


def test_shuffled_bytes(spark):
    """To find who else has an element, a shuffle of all elements takes less than 10 bytes of each (about 15 by whole elements and classes)."""
    rng = random.Random(5)
    df = frame(spark, [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))) for i in range(400)])
    shuffled = lambda: time.sleep(1) or spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    nodes = jaccard.staged(jaccard.prefixes(df, "doc_id", "text", np.zeros(jaccard.CELLS, np.int64)).withColumnRenamed("key", "node"), "nodes")
    before = shuffled()
    assert jaccard.shared_elements(nodes, 90).count() == 0
    elements = sum(r.size - -(-90 * r.size // 100) + 1 for r in nodes.collect())
    assert shuffled() - before < 10 * elements
