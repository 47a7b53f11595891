"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward tables."""

import base64
import collections
import hashlib
import itertools
import math
import re
import shutil
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from verdigris.llm import ann, bpe, imatch, katz, langid, licenses, minhash, packing, queries, toxicity, warc

VOCABULARY, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and keys, and clashing extra columns."""
    base = "The quick brown fox jumps over the lazy dog and then goes home again to sleep."
    long = " ".join(f"w{i % 977} the of" for i in range(40_000))
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", None), (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "de", "b"), (None, "Kein Schlüssel hier, nur Wörter und Zahlen 123.", "de", "c"), (6, long, "en", "c"), (7, "!!! ???", "fr", None), (8, "été à la plage", "fr", "d"), (9, "Licensed under the MIT License.", None, "d"), (10, "😀 \x00 İ ß ΑΣ", "fr", "e"), (2, "another text of key two", "en", "a")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    extra = ("key", "score", "n_tokens", "node", "band", "held_out", "fingerprint", "class_id", "value", "vec", "id")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def held(key, mod, rest):
    return zlib.crc32(str(key).encode()) % mod == rest


# ---- 1
def test_language_accuracy_and_odd(spark, docs, odd, none):
    got = queries.op1_langid(spark, DATA).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got.held_out == got.doc_id.map(lambda i: held(i, 5, 0))).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    rows = langid.identify(odd).toPandas()
    assert len(rows) == odd.count() and set(rows[rows.doc_id.isin([3, 4, 5, 7])].lang_pred) == {"und"} and (rows[rows.doc_id.isin([3, 4])].score == 0).all()
    assert langid.identify(none).count() == 0
    blank = spark.createDataFrame([(1, "words", None, None, 5)], SCHEMA)
    assert langid.identify(blank).first()["lang_pred"] == "und"


def naive_gram_counts(text):
    """n-gram by n-gram, over the text's letters and single spaces."""
    seq, inside = [32], True
    for c in text.lower():
        if c.isalpha() or inside:
            seq.append(ord(c) if c.isalpha() else 32)
        inside = c.isalpha()
    seq.append(32)
    out = np.zeros(langid.DIM, np.int64)
    for n in (1, 2, 3):
        for i in range(len(seq) - n + 1):
            h = 0
            for c in seq[i : i + n]:
                h = h * 0x01000193 % 2**32 ^ c
            h = (h + n) * 0x9E3779B1 % 2**32
            out[(h ^ h >> 15) * 0x85EBCA6B % 2**32 >> 16] += 1
    return out


def test_language_counts_in_pieces(monkeypatch):
    """Cut anywhere, the counts are those of the text as one."""
    texts = ["Ein längerer Text, der in Stücke zerfällt 12 und weitergeht. " * 5, "12 a", "a", "..ab", "ΟΔΟΣ İstanbul 😀x", "a b"]
    for piece in (1, 2, 3, 7, 100, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t in texts:
            assert (langid.gram_counts(t) == naive_gram_counts(t)).all()
        assert langid.gram_counts("12 !") is None and langid.gram_counts("") is None


def test_ftrl_against_a_plain_table():
    """The leader's weights against dense tables updated coordinate by coordinate, row by row, from the definition."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(30, 4, replace=False)), rng.uniform(0.2, 1, 4), int(rng.integers(3))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.7, 1.3, 0.02, 0.05
    w, b = langid.ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=5)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - math.copysign(l1, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = [*at.tolist(), langid.DIM], [*x.tolist(), 1.0]
            old = {(i, c): weight(i, c) for i in at for c in range(3)}
            s = [sum(old[i, c] * v for i, v in zip(at, x)) for c in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for i, v in zip(at, x):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha
                    z[i, c] += g - sigma * old[i, c]
                    n[i, c] += g * g
    assert np.allclose(w[:30], [[weight(i, c) for c in range(3)] for i in range(30)]) and np.allclose(b, [weight(langid.DIM, c) for c in range(3)])
    assert not w[30:].any()


def test_elastic_net_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(np.array([c, 10 + int(rng.integers(500))]), np.array([0.9, 0.4]), c) for c in rng.integers(0, 3, 300)]
    w, _ = langid.ftrl(rows, 3, l1=0.5)
    assert (w[10:] != 0).mean() < 0.02 and (w[:3].argmax(1) == [0, 1, 2]).all()
    y = rng.integers(0, 3, 3000)
    z = 6 * (rng.normal(size=(3000, 3)) + 1.5 * np.eye(3)[y])
    t = langid.calibrate(z, y)
    p = langid.softmax(z / t)
    assert abs(p.max(1).mean() - (p.argmax(1) == y).mean()) < 0.03
    assert langid.keep  # stages use it; tested with the pipeline


# ---- 2
def test_warc_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    pages = [(i, f"http://h/{i}", "".join(map(chr, rng.integers(32, 0x2000, int(n))))) for i, n in enumerate([0, 1, 50, 4096, 4097, 40_000, 90_000])]
    pages += [(20, "u", pages[5][2]), (21, "u\r\nX: y", pages[5][2]), (22, None, None), (30, "u", "chunk\r\n0\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    got = {int(r["key"]): r for r in warc.round_trip(df, segment=3000, archive=20_000).collect()}
    assert len(got) == len(pages) and all(r["error"] is None for r in got.values())
    for i, _, html in pages:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        same = max(j for j, _, h in pages if (h or "").encode() == raw)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if same == i else ("revisit", str(same)))
        assert got[i]["payload"] == (bytearray(raw) if same == i else None)
    assert warc.round_trip(df.filter("false")).count() == 0
    some = warc.round_trip(df, least_bytes=10**6).filter("record_type = 'response'").count()
    assert some == len(pages)


def test_warc_query(spark):
    """All columns against SQL, and lengths and digests against hashlib."""
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pandas()
    got = queries.op2_warc(spark, DATA).toPandas().set_index("page_id").sort_index()
    want = duckdb.sql(queries.ORACLES["op2_warc"].replace("FROM pages", f"FROM '{DATA}/pages.parquet'")).df().set_index("page_id").sort_index()
    assert len(got) == len(pages) and got[want.columns].astype(object).where(got.notna(), None).equals(want.astype(object).where(want.notna(), None))
    for r in pages.itertuples():
        raw = (r.html or "").encode()
        assert tuple(got.loc[r.page_id][["payload_bytes", "payload_digest"]]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())


def test_warc_repeated_and_null_keys(spark):
    """Every row in gives a row back: repeated rows, repeated keys with other payloads, null keys, all in segments."""
    long = ["x%d " % i * 3000 for i in range(4)]
    rows = [(1, "u", long[0]), (1, "u", long[0]), (2, "u", long[1]), (2, "u", "short"), (None, "u", long[2]), (None, "u", long[2]), (None, "u", long[3]), (3, "u", long[3]), (4, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = warc.round_trip(df, segment=2000, archive=9000).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    seen = collections.Counter((r["key"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    sha = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    assert seen == {("1", sha(long[0]), "response", None): 2, ("2", sha(long[1]), "response", None): 1, ("2", sha("short"), "response", None): 1, (None, sha(long[2]), "response", None): 2, (None, sha(long[3]), "revisit", "3"): 1, ("3", sha(long[3]), "response", None): 1, ("4", sha(""), "response", None): 1, (None, sha(""), "revisit", "4"): 1}
    strings = spark.createDataFrame([("a\r\nX-Key: b%", "u", "h"), ("é", "u", "h")], "page_id string, url string, html string")
    assert {(r["key"], r["refers_to"]) for r in warc.round_trip(strings).collect()} == {("é", None), ("a\r\nX-Key: b%", "é")}


def test_warc_left_overs_of_attempts_are_not_read(spark, tmp_path):
    """Archives of an attempt that died are not in the manifest; a folder without one is read whole."""
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id bigint, url string, html string")
    assert warc.write(df, folder) == 20
    names = [r["name"] for r in warc.manifest(spark, folder).collect()]
    (tmp_path / "w" / "part-00000-0000-999.warc.gz").write_bytes((tmp_path / "w" / names[0]).read_bytes()[:-7])
    assert warc.read(spark, folder).count() == 20
    (tmp_path / "w" / "part-00000-0000-999.warc.gz").write_bytes(b"".join(warc.gzipped(x) for x in warc.records("z", 99, "u", b"more", warc.digest(b"more"))))
    assert warc.read(spark, folder).count() == 20
    shutil.rmtree(tmp_path / "w" / "manifest")
    assert warc.read(spark, folder).count() == 21


def test_warc_common_payloads(spark):
    """Payloads that many pages share are joined apart from the rest, with the same result."""
    rows = [(i, "u", "same" if i % 3 else f"own {i % 40}") for i in range(400)]
    got = {int(r["key"]): (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    top = {}
    for i, _, h in rows:
        top[h] = i
    assert got == {i: ("response", None) if top[h] == i else ("revisit", str(top[h])) for i, _, h in rows}


def test_warc_faults():
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.assemble([1, 3], [None, 6], [b"abc", b"def"])
    with pytest.raises(ValueError):
        warc.assemble([1, 2], [None, 7], [b"abc", b"def"])
    assert warc.assemble([2, 1], [6, None], [b"def", b"abc"]) == b"abcdef"
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# ---- 3
def test_bpe_is_exact(spark, docs, odd, none):
    library = Tokenizer.from_file(VOCABULARY)

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = queries.op3_bpe(spark, DATA).toPandas().set_index("doc_id")
    assert all(tuple(got.loc[r.doc_id]) == want(r.text) for r in docs.itertuples()) and len(got) == len(docs)
    rows = bpe.encode(odd, VOCABULARY).collect()
    texts = [r["text"] for r in odd.collect()]
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(map(want, texts))
    assert sorted(r["text"] for r in bpe.decode(spark.createDataFrame(rows), VOCABULARY).collect()) == sorted(r["decoded"] for r in rows)
    assert bpe.encode(none, VOCABULARY).count() == 0


def test_bpe_on_many_characters():
    library, codec = Tokenizer.from_file(VOCABULARY), bpe.Codec(VOCABULARY)
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}'s" for c in [*range(0x3000), *range(0xD7A0, 0xD7A4), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)]]
    texts += ["x<|endoftext|>y <|startoftext|>", "don't WE'LL 12a3", "é é ́x", "\x1c a\x1cb", "zzzzqqqqjxjxvkvk" * 9]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert codec.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_of_very_long_words():
    """Long fragments are merged through a heap: the same ids as the library's, near-linear in time."""
    library, codec, rng = Tokenizer.from_file(VOCABULARY), bpe.Codec(VOCABULARY), np.random.default_rng(2)
    words = ["".join(map(chr, rng.choice(list(range(97, 123)), n))) for n in (99, 100, 101, 500, 5000)] + ["a" * 3000, "ab" * 2000 + "c", "theing" * 700, "q" * 101, "é" * 400]
    for w in words:
        assert np.frombuffer(codec.encode(w), "<u4").tolist() == library.encode(w, add_special_tokens=False).ids
    assert all(len(k) <= bpe.KEPT for k in codec.known)
    began = time.time()
    million = "".join(map(chr, rng.choice(list(range(97, 123)), 1_000_000)))
    ids = np.frombuffer(codec.encode(million), "<u4").tolist()
    assert time.time() - began < 60 and codec.decode(np.array(ids, "<u4").tobytes()).replace(" ", "").replace("</w>", "") == million


def test_forced_boundaries_never_lie_inside_tokens():
    codec = bpe.Codec(VOCABULARY)
    word = "straßenqxzvkâ€œ".encode()
    cuts = codec.cut(word)
    assert b"".join(cuts) == word and len(cuts) > 1
    assert all((a[-1], b[0]) not in codec.joined for a, b in itertools.pairwise(cuts))
    assert b"".join(map(bpe.pack, [codec._merge(x, False) for x in cuts[:-1]])) + bpe.pack(codec._merge(cuts[-1], True)) == bpe.pack(codec._merge(word, True))


# ---- 4
def brute_neighbours(ids, x, step, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % step == 0:
            s = np.array([float(np.dot(x[i], x[j])) for j in range(len(ids))])
            out[ids[i]] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def test_neighbours_recall(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pandas()
    x = np.stack(t.embedding.to_list()).astype(float)
    want = brute_neighbours(t.vec_id.tolist(), x, 20, 20)
    got = queries.op4_ann(spark, DATA).toPandas()
    by = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(by) == set(want) and all(g["rank"].tolist() == list(range(1, 21)) for g in by.values())
    assert np.mean([len(set(by[q].vec_id) & set(w)) / 20 for q, w in want.items()]) >= 0.9
    place = {v: i for i, v in enumerate(t.vec_id)}
    for q, g in by.items():
        assert g.score.tolist() == pytest.approx([float(x[place[q]] @ x[place[v]]) for v in g.vec_id], abs=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [5.0, 0.0]), (11, [1.0, 2.0, 3.0]), (3, [0.0, 2.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"list": F.lit(1), "ids": F.lit("x")})
    got = ann.search(df, k=3, step=10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 10, 5.0), (0, 1, 1.0), (0, 2, 1.0), (10, 0, 5.0), (10, 1, 5.0), (10, 2, 5.0), (20, 10, 5.0), (20, 0, 1.0), (20, 1, 1.0)]
    assert ann.search(df.filter("false")).count() == 0
    few = ann.search(df.filter("vec_id in (0, 3)"), k=20, step=10).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 3)]


def test_neighbours_of_copies_and_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 4
    x = np.vstack([centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 8)) * 0.5, np.tile(centres[:1], (700, 1))]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [r.tolist() for r in x]}), "vec_id bigint, embedding array<float>")
    got = ann.search(df, k=10, step=100).toPandas()
    want = brute_neighbours(list(range(len(x))), x.astype(float), 100, 10)
    assert np.mean([len(set(g.vec_id) & set(want[q])) / 10 for q, g in got.groupby("query_id")]) >= 0.9


def test_neighbours_beyond_a_scan(spark):
    """On clustered vectors the index finds nine tenths with fewer than a quarter of a scan's products, the walk among centroids counted."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 32))
    x = (centres[rng.integers(0, 300, 20_000)] + rng.normal(size=(20_000, 32)) * 0.4).astype(np.float32)
    x[1000:1010] = x[0]  # repeated rows, and so ties
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [r.tolist() for r in x]}), "vec_id bigint, embedding array<float>")
    got = ann.search(df, k=20, step=50).toPandas()
    want = brute_neighbours(list(range(len(x))), x.astype(float), 50, 20)
    by = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(by) == set(want) and all(g["rank"].tolist() == list(range(1, 21)) for g in by.values())
    recall = np.mean([len(set(by[q].vec_id) & set(w)) / 20 for q, w in want.items()])
    each = got.drop_duplicates("query_id")
    print(f"recall {recall:.3f}, lists asked {each.asked.mean():.1f}, centroids met {each.visited.mean():.1f}, products {each.products.mean():.1f} of {len(x)}")
    assert recall >= 0.9 and (each.visited + each.products).mean() < len(x) / 4
    assert by[0].vec_id.head(10).tolist() == list(range(1000, 1010)) and by[1000].vec_id.head(10).tolist() == [0, *range(1001, 1010)]


@pytest.mark.parametrize("lists", [1, 40, 700])
def test_walks_among_centroids(lists):
    """A walk for all centroids has them all in order; one for a few finds nearly all of them and holds no more than its beam."""
    rng = np.random.default_rng(lists)
    centres = rng.normal(size=(60, 16)) * 2
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.5
    index = ann.train(x, float(np.linalg.norm(x, axis=1).max()), lists)
    q = index.aimed(x[:50])
    d = ((q[:, None, :] - index.centroids) ** 2).sum(2)
    near, cost, met = index.search(q, lists)
    assert np.allclose(cost, np.sort(d, axis=1)) and all(sorted(r) == list(range(lists)) for r in near.tolist()) and (met >= lists).all()
    near, cost, met = index.search(q, 12)
    true = np.argsort(d, axis=1, kind="stable")[:, :12]
    assert near.shape == (50, min(12, lists)) and np.allclose(cost, np.take_along_axis(d, near, 1))
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(near.tolist(), true.tolist())]) >= 0.95


# ---- 5
def brute_classes(texts, threshold=0.8):
    known, sets = minhash.Words(), []
    for t in texts:
        sets.append(minhash.shingles(minhash.tokens(t or "", known)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = collections.defaultdict(list)
    for i, (e, _) in enumerate(sets):
        for x in e:
            by[int(x)].append(i)
    for i, j in {p for v in by.values() for p in itertools.combinations(v, 2)}:
        if find(i) != find(j) and minhash.similarity(*sets[i], *sets[j]) >= threshold:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_are_those_of_brute_force(spark, docs):
    got = queries.op5_minhash(spark, DATA).toPandas().set_index("doc_id").class_id
    want = brute_classes(docs.text.tolist())
    assert [got[i] for i in docs.doc_id] == [docs.doc_id[r] for r in want]


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 8, "FAN": 5, "COMMON": 10}, {"BLOCK_BYTES": 9_000, "FEW": 0, "COMMON": 2}])
def test_large_groups_and_chains(spark, monkeypatch, limits):
    """A group whose members are near only some others, in blocks far smaller than it or in one, joined by shuffles or not."""
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for n in range(90):
        w = base.copy()
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"q{n}_{i}" for i in range(30)) for n in range(20)] + [texts[0]] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_null_keys_are_linked(spark):
    w = [f"w{i}" for i in range(60)]
    near, other = [*w[:59], "x"], [f"z{i}" for i in range(40)]
    rows = [(None, " ".join(near)), (7, " ".join(w)), (9, " ".join(near)), (None, " ".join(other)), (None, " ".join([*other, "end"])), (3, "  ".join(w)), (3, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["class_id"]) for r in minhash.classes(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (7, 3), (9, 3), (None, None), (None, None), (3, 3), (3, 3)], key=str)
    kept = minhash.keep(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None"]


def test_near_copies_in_thousands(spark):
    """Joins make no more rows than the bands have, however large the group: 1,500 near copies against brute force."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(40)], []
    for _ in range(1500):
        w = base.copy()
        for at in rng.choice(40, int(rng.integers(0, 5)), replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = []
    whole = minhash.unresolved
    minhash.unresolved = lambda *a: made.append(whole(*a)) or made[0]
    try:
        got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    finally:
        minhash.unresolved = whole
    want = brute_classes(texts)
    assert np.mean([got[i] == want[i] for i in range(len(texts))]) > 0.999
    # each member of an open bucket is once in each of its few block pairs
    assert made[0].count() <= 3 * minhash.BANDS * len(set(texts))


def test_classes_odd(spark, odd, none):
    got = minhash.classes(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["class_id"])
    assert by[1] == {1} and by[2] == {1, 2} and by[3] == {3} and by[4] == {4} and by[5] == {5} and by[7] == {7} and by[None] == {None}
    assert minhash.classes(none).count() == 0 and minhash.keep(none).columns == none.columns
    kept = minhash.keep(odd)
    assert kept.columns == odd.columns and sorted(x for x in (r["doc_id"] for r in kept.collect()) if x) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] or kept.count() >= 10


def test_keep_of_repeated_keys(spark):
    one, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, one), (2, one + " more"), (2, other), (3, other), (4, "something else that is quite different"), (4, "something else that is quite different"), (2, None)]
    kept = minhash.keep(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, one), (2, ""), (2, other), (4, rows[4][1])]


def test_signatures_agree_like_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 40).astype(np.uint64)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)
    y[:25] = x[:25]
    a, b = x > 0, y > 0
    s = minhash.dart_signatures(np.r_[e[a], e[b]], np.r_[x[a], y[b]], np.r_[np.zeros(a.sum(), int), np.ones(b.sum(), int)], 3, k=4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.03)
    assert (s[:2] > 0).all() and not s[2].any()
    scaled = minhash.dart_signatures(np.r_[e[a], e[a]], np.r_[x[a], x[a] * 2.5], np.repeat([0, 1], a.sum()), 2, k=4000)
    assert (scaled[0] == scaled[1]).mean() == pytest.approx(0.4, abs=0.03)


# ---- 6
def duck_rows(name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return c.sql(queries.ORACLES[name]).df()


def test_licenses_match_sql(spark):
    got = queries.op6_licenses(spark, DATA).toPandas()
    key = lambda df: sorted(df[["doc_id", "license", "containment", "start_word"]].itertuples(index=False, name=None))
    assert key(got) == key(duck_rows("op6_licenses"))


def test_licenses_brute_force_and_odd(spark, odd, none):
    rng = np.random.default_rng(0)
    fill = lambda n: " ".join(f"f{rng.integers(500)}" for _ in range(n))
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES * 3):
        w = t.split()
        if i % 3 == 1 and len(w) > 30:
            w[int(rng.integers(len(w)))] = "changed"
        rows.append((i, f"{fill(int(rng.integers(0, 400)))} {' '.join(w)} {fill(int(rng.integers(0, 300)))}"))
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r["doc_id"]].add((r["license"], round(r["containment"], 9), r["start_word"]))
    for i, text in rows:
        w = licenses.words(text)
        s = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        found = []
        for name, t in licenses.TEMPLATES:
            tw = licenses.words(t)
            ts = {tuple(tw[j : j + 5]) for j in range(len(tw) - 4)}
            size = licenses.size_class(len(ts))
            for at in range(0, len(s), size):
                c = len(ts & set(s[at : at + 2 * size])) / len(ts)
                if c >= 0.8 - 1e-9:
                    found.append((name, c, at, at + 2 * size))
        want = {}
        for name, c, at, to in found:
            if not any(n != name and d > c and x < to and at < y for n, d, x, y in found) and (c, -at) > want.get(name, (0, 0)):
                want[name] = (c, -at)
        assert got[i] == {(n, round(c, 9), -a) for n, (c, a) in want.items()}
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(odd).collect()] == [(9, "MIT")]
    assert licenses.scan(none).count() == 0 and licenses.scan(odd, ()).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, [("X", "too short")])


def test_licenses_short_notices(spark):
    texts = ["All rights reserved.", "one two. all RIGHTS, reserved; three", "all rights are reserved", "one two three four five Licensed under the MIT License. Copyright X. All rights reserved.", "reserved rights", licenses.TEMPLATES[-1][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = licenses.scan(df, notices=licenses.NOTICES)
    assert {(r["doc_id"], r["license"], r["containment"]) for r in got.collect()} == {(0, "Proprietary", 1.0), (1, "Proprietary", 1.0), (3, "MIT", 1.0), (3, "Proprietary", 1.0), (5, "Proprietary", 1.0)}
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", got._jdf.queryExecution().executedPlan().toString())
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"] for r in documents.collect() if "all rights reserved" in " ".join(licenses.words(r["text"] or ""))}
    assert want and {r["doc_id"] for r in licenses.scan(documents, notices=licenses.NOTICES).filter("license = 'Proprietary'").collect()} == want
    with pytest.raises(ValueError):
        licenses.scan(df, notices=[("X", "a notice of five words")])


def test_licenses_side_by_side(spark):
    mit = licenses.TEMPLATES[2][1].replace("restriction", "changed")
    fill = " ".join(f"f{i}" for i in range(100))
    gpl = "This work is licensed under the GNU General Public License, version"
    texts = [f"{mit} {fill} Licensed under CC BY 4.0.", f"Licensed under CC BY 4.0. {mit}", f"{gpl} 3.", f"{mit} {gpl} 2. {fill}"]
    got = collections.defaultdict(dict)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        got[r["doc_id"]][r["license"]] = r["containment"]
    assert {k: set(v) for k, v in got.items()} == {0: {"MIT", "CC-BY-4.0"}, 1: {"MIT", "CC-BY-4.0"}, 2: {"GPL-3.0"}, 3: {"MIT", "GPL-2.0"}}
    assert 0.9 < got[0]["MIT"] < 1 and got[0]["CC-BY-4.0"] == 1


def test_licenses_use_no_python(spark):
    plan = licenses.scan(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---- 7
def naive_best_fit(sizes, lengths, fixed):
    """Piece by piece, longest first, every open bin looked at: [(pieces, final length)]."""
    bins, left = [], sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        left -= sizes[i]
        fits = [(cap - sum(sizes[j] for j in own), n) for n, (own, cap) in enumerate(bins) if cap - sum(sizes[j] for j in own) >= sizes[i]]
        if fits:
            bins[min(fits)[1]][0].append(i)
        else:
            options = [x for x in lengths if x >= sizes[i]]
            bins.append(([i], min(options, key=lambda x: (packing.cost(x, fixed) / min(x, sizes[i] + left), -x))))
    return [(own, min((x for x in lengths if x >= sum(sizes[j] for j in own)), key=lambda x: packing.cost(x, fixed))) for own, _ in bins]


@pytest.mark.parametrize("lengths, fixed", [((4, 16, 64), 2), ((512, 1024, 8192), 512), ((7,), 0)])
def test_best_fit_is_that_of_a_naive_packer(lengths, fixed):
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 30, 200):
        sizes = np.minimum(rng.geometric(3 / max(lengths), n), max(lengths)).tolist()
        bins, offset, final = packing.best_fit(sizes, lengths, fixed)
        got = [([], x) for x in final]
        for i in sorted(range(n), key=lambda i: (bins[i], offset[i])):
            assert offset[i] == sum(sizes[j] for j in got[bins[i]][0])
            got[bins[i]][0].append(i)
        assert got == naive_best_fit(sizes, sorted(lengths), fixed)


def check_packing(rows, documents, lengths, most):
    """Every document's tokens are in the sequences, whole and once; sequences are full of what they list."""
    encoder = packing.encoder(RANKS, public_tokenizers.PATTERN)
    seen = collections.Counter()
    parts = collections.defaultdict(dict)
    for r in rows:
        if not r["length"]:
            assert r["ids"] is None and all(d["n_tokens"] == 0 for d in r["documents"])
            seen.update((d["doc_id"], b"") for d in r["documents"])
            continue
        ids, at = np.frombuffer(r["ids"], encoder.kind), 0
        assert r["doc_ids"] == [d["doc_id"] for d in r["documents"]] and len(ids) == r["used"] <= r["length"]
        assert r["length"] == min((x for x in lengths if x >= r["used"]), key=packing.cost)
        for d in r["documents"]:
            assert d["at"] == at and d["start"] == d["piece"] * most
            part, at = ids[at : at + d["n_tokens"]].tobytes(), at + d["n_tokens"]
            if d["piece"] == 0 and d["n_tokens"] < most:
                seen[d["doc_id"], part] += 1
            else:
                parts[d["doc_id"]].setdefault(d["piece"], []).append(part)
    for key, own in parts.items():
        assert all(len(x) == 1 for x in own.values()), "the tests have one long text to a key"
        seen[key, b"".join(own[i][0] for i in range(len(own)))] += 1
    assert seen == collections.Counter((k, encoder.encode(t or "").tobytes()) for k, t in documents)
    assert all(encoder.decode(x) == t for t in {t for _, t in documents if t} for x in [encoder.encode(t).tobytes()])


def test_packing(spark, docs, odd, none):
    rows = queries.op7_packing(spark, DATA).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.itertuples()], packing.LENGTHS, max(packing.LENGTHS))
    assert packing.waste([r["used"] for r in rows], [r["length"] for r in rows]) < 0.05
    pack = lambda df, **o: packing.pack(df, RANKS, public_tokenizers.PATTERN, **o)
    short = odd.filter("doc_id is null or doc_id <> 6")
    check_packing(pack(short, lengths=(4, 16, 64), fixed=2, shard=4).collect(), [(r["doc_id"], r["text"]) for r in short.collect() if not (r["text"] or "").startswith("The quick")] + [(r["doc_id"], r["text"]) for r in short.collect() if (r["text"] or "").startswith("The quick")], (4, 16, 64), 64)
    assert pack(odd).count() > 0 and pack(none).count() == 0
    with pytest.raises(ValueError):
        pack(odd, lengths=())


def test_packing_does_not_depend_on_partitions(spark, docs, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    monkeypatch.setattr(packing, "RUN", 100)
    found = [sorted((r["length"], tuple(map(tuple, r["documents"])), bytes(r["ids"] or b"")) for r in packing.pack(x, RANKS, public_tokenizers.PATTERN, shard=256).collect()) for x in (df, df.repartition(7), df.coalesce(1))]
    assert found[0] == found[1] == found[2]
    monkeypatch.setattr(packing, "HOT", 3)
    hot = df.limit(20).union(df.limit(1).crossJoin(spark.range(30)).drop("id"))
    got = packing.pack(hot, RANKS, public_tokenizers.PATTERN, shard=4).collect()
    want = collections.Counter(r["doc_id"] for r in hot.collect())
    assert collections.Counter(d["doc_id"] for r in got for d in r["documents"] if d["piece"] == 0) == want


# ---- 8
def brute_katz(rows):
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    out = {}
    uni, bi, after = collections.Counter(), collections.Counter(), collections.defaultdict(dict)
    for key, t in rows:
        if not held(key, 7, 2):
            w = toks(t)
            uni.update(w)
            bi.update(zip(["<", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    star = lambda c: katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)])
    us, bs = star(uni), star(bi)
    gone = sum(c - us[c] for c in uni.values() if c <= katz.K) / max(1, n)
    scale, unknown = 1.0, gone
    if unknown < 1 / (n + 1):
        scale, unknown = (1 - 1 / (n + 1)) / (1 - gone), 1 / (n + 1)
    p = lambda w: (us[uni[w]] if uni[w] <= katz.K else uni[w]) * scale / n if w in uni else unknown
    keep = lambda c: bs[c] if c <= katz.K else c - katz.RESERVE
    for (a, b), c in bi.items():
        after[a][b] = c
    size = {a: sum(m.values()) for a, m in after.items()}
    bow = {a: (1 - sum(map(keep, m.values())) / size[a]) / (1 - sum(map(p, m))) for a, m in after.items()}
    for a, m in itertools.islice(after.items(), 60):  # probabilities after a context add up to 1
        assert sum(keep(c) / size[a] for c in m.values()) + bow[a] * (sum(p(w) for w in uni if w not in m) + unknown) == pytest.approx(1, abs=1e-9)
    for key, t in rows:
        w = toks(t)
        s = base = 0.0
        for a, b in zip(["<", *w[:-1]], w):
            base += math.log10((uni.get(b, 0) + 1) / (n + v + 1))
            s += math.log10(keep(after[a][b]) / size[a]) if b in after.get(a, {}) else math.log10(bow.get(a, 1.0) * p(b))
        out[key] = (held(key, 7, 2), len(w), sum(b in uni for b in w), n, base, s)
    return out


def test_katz_is_exact(spark, docs):
    got = queries.op8_katz(spark, DATA).toPandas().set_index("doc_id")
    want = brute_katz(list(zip(docs.doc_id, docs.text)))
    for key, w in want.items():
        r = got.loc[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert (r.base_score, r.score) == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_katz_with_many_blocks_and_parts(spark, docs, monkeypatch):
    for name, value in (("BLOCK_DOCS", 7), ("HOT", 16), ("PARTS", 5)):
        monkeypatch.setattr(katz, name, value)
    some = docs.head(60)
    got = katz.score(spark.createDataFrame(some[["doc_id", "text"]])).toPandas().set_index("doc_id")
    for key, w in brute_katz(list(zip(some.doc_id, some.text))).items():
        assert (got.loc[key].base_score, got.loc[key].score) == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_katz_sums_of_few_uses_in_many_blocks():
    """The same sums whether all cells fit or only the used ones are kept."""
    rng = np.random.default_rng(0)
    for blocks, n in ((3, 5000), (4000, 60)):
        names, at, doc, x = np.arange(blocks) * 7, rng.integers(0, blocks, n), rng.integers(0, 2000, n).astype(np.uint32) * 2 + 1, rng.normal(size=n)
        want = collections.defaultdict(float)
        for a, d, v in zip(at, doc, x):
            want[int(names[a]), int(d) >> 1] += v
        got = {}
        for r in katz.sums_of(names, at, doc, x, None, x * 2).itertuples():
            for d, v, w in zip(katz.unpacked(r.docs, np.uint32), katz.unpacked(r.score, np.float64), katz.unpacked(r.known, np.float64)):
                got[r.block, int(d)] = v
                assert w == pytest.approx(2 * v)
        assert got == pytest.approx(want)


def test_katz_odd(spark, odd, none):
    rows = katz.score(odd).toPandas()
    assert len(rows) == odd.count() and np.isfinite(rows.score).all() and rows.doc_id.isna().sum() == 1
    assert (rows[rows.doc_id.isin([3, 4, 5])].n_tokens == 1).all()
    assert katz.score(none).count() == 0
    untrained = katz.score(odd.filter("doc_id = 6").withColumn("doc_id", F.lit(next(i for i in range(99) if held(i, 7, 2))))).first()
    assert (untrained["train_tokens"], untrained["base_score"], untrained["score"]) == (0, 0.0, 0.0)


# ---- 9
def test_fingerprints(spark, docs):
    got = queries.op9_imatch(spark, DATA).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False)
    texts, keys = order.text.fillna("").tolist(), order.doc_id.tolist()
    for i, (k, t) in enumerate(zip(keys, texts)):
        z, r, h = texts[(i + 1) % len(texts)], got.loc[k], len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + z[:h]).encode()).hexdigest()
        assert r.near_edited == imatch.compare(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == imatch.compare(r.fingerprint, got.loc[keys[(i + 1) % len(keys)]].fingerprint)
    assert docs.assign(f=docs.doc_id.map(got.fingerprint)).groupby("text").f.nunique().max() == 1
    assert (got.near_edited > got.near_next).mean() > 0.85


def naive_sketch(terms):
    """Sub-lexicon by sub-lexicon, as a dictionary of (level, group) to hash, in plain integers."""
    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    own = min(imatch.LEVELS - imatch.FINER, max(0, (len(terms) - 1).bit_length()))
    out = {}
    for level in [0, *range(max(1, own), imatch.LEVELS)]:
        groups = collections.defaultdict(list)
        for t in sorted(terms):
            group = mix(t ^ (0x5851F42D4C957F2D + 1 + (level - 1) % imatch.FINER)) >> (64 - level) if level else 0
            if group < imatch.GROUPS:
                groups[group].append(t)
        for g, own_terms in groups.items():
            out[level, g] = mix(sum(mix((t + mix(i + level)) % 2**64) for i, t in enumerate(own_terms)) % 2**64) >> 40
    return out


def test_sketches_and_likeness_are_those_of_plain_loops(docs):
    f = imatch.Fingerprinter(np.zeros(0, np.uint64))
    hashes = [f.hashes(t or "") for t in [*docs.text.head(30), "", "one", "one two", None]]
    prints = [naive_sketch(set(h.tolist())) if len(h) else {} for h in hashes]
    for h, got, want in zip(hashes, f.sketches(hashes), prints):
        assert [(e >> 28, e >> 24 & 15, e & 0xFFFFFF) for e in got.tolist()] == [(*k, v) for k, v in sorted(want.items())]
    for (h, a), (g, b) in itertools.product(zip(hashes[::3], prints[::3]), repeat=2):
        if not len(h) or not len(g):
            want = float(len(h) == len(g))
        elif set(h) == set(g):
            want = 1.0
        else:
            level = min(imatch.LEVELS - imatch.FINER, (max(len(h), len(g)) - 1).bit_length())
            cells = {k for k in a.keys() | b.keys() if level <= k[0] < level + imatch.FINER}
            want = sum(a.get(k) == b.get(k) for k in cells) / len(cells) if cells else 0.0
        text = [imatch.encoded(*f.sketches([x]), len(x)) for x in (h, g)]
        assert imatch.compare(*text) == want


@pytest.mark.parametrize("n", [60, 800, 3000, 20_000, 150_000])
def test_likeness_at_every_length(n):
    f = imatch.Fingerprinter(np.zeros(0, np.uint64))
    like = {"cut": [], "half": [], "other": []}
    for seed in range(6):
        w = [f"{seed}x{i}" for i in range(2 * n)]
        own, *rest = (f.hashes(" ".join(x)) for x in (w[:n], w[: n - n // 20], w[: n // 2] + w[n : n + n // 2], w[n:]))
        prints = [imatch.encoded(s, len(h)) for s, h in zip(f.sketches([own, *rest]), [own, *rest])]
        for kind, other in zip(like, prints[1:]):
            like[kind].append(imatch.compare(prints[0], other))
    cut, half, other = (np.mean(x) for x in like.values())
    assert cut > 0.8 and 0.1 < half < 0.5 and other < 0.05


def test_lexicon_is_the_band(spark, docs):
    df = collections.Counter(w for t in docs.text for w in imatch.terms(t))
    n = len(docs)
    low, high = max(2, math.ceil(imatch.LEAST * n)), max(2, math.ceil(imatch.LEAST * n), int(imatch.MOST * n))
    want = sorted(imatch.term_hash(w) for w, c in df.items() if low <= c <= high)
    assert imatch.lexicon(spark.read.parquet(f"{DATA}/documents.parquet")).tolist() == want


def test_lexicon_is_refused_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(imatch, "TERMS", 50)
    with pytest.raises(Exception, match="more than 50 terms"):
        imatch.lexicon(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_fingerprint_ranges_and_odd(spark, odd, none, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 4)
    texts = [f"text {i} " + "abc def " * (i % 7) for i in range(50)]
    got = {r["doc_id"]: r for r in imatch.against_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(got) == 50
    for i, t in enumerate(texts):
        assert got[i]["edited_sha256"] == hashlib.sha256(imatch.edited(t, texts[i - 1]).encode()).hexdigest()
    rows = imatch.against_edits(odd).toPandas()
    assert len(rows) == odd.count() and rows.near_edited.between(0, 1).all() and rows.doc_id.isna().sum() == 1
    assert imatch.against_edits(none).count() == 0
    alone = imatch.against_edits(odd.filter("doc_id = 8")).first()
    assert alone["near_next"] == 1.0


# ---- 10
def test_toxicity(spark, docs, odd, none):
    larger = DATA.replace("sf0.001", "sf0.01")  # with enough labels to learn from
    labels = pq.read_table(f"{larger}/labels.parquet").to_pandas()
    got = queries.op10_toxicity(spark, larger).toPandas()
    assert len(got) == pq.read_table(f"{larger}/documents.parquet").num_rows and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    merged = got.merge(labels, on="doc_id")
    assert (merged[~merged.held_out].toxic == merged[~merged.held_out].predicted).mean() > 0.9
    # on labels it has not learned from, where there are enough of them
    largest = DATA.replace("sf0.001", "sf0.1")
    aside = queries.op10_toxicity(spark, largest).toPandas().merge(pq.read_table(f"{largest}/labels.parquet").to_pandas(), on="doc_id")
    aside = aside[aside.held_out & aside.toxic.notna()]
    assert (aside.toxic == 1).sum() >= 30 and aside[aside.toxic == 1].predicted.mean() >= 0.85 and aside[aside.toxic == 0].predicted.mean() <= 0.01
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (6, 0), (6, 1)], "doc_id bigint, toxic int")
    rows = toxicity.assess(odd, marks).toPandas()
    assert len(rows) == odd.count() and rows.score.between(0, 1).all()
    assert toxicity.assess(none, marks).count() == 0
    assert (toxicity.assess(odd, marks.filter("false")).toPandas().score < 1e-6).all()


def test_deobfuscation(docs):
    words = "idiot moron loser stupid pathetic the and of that worth".split() * 50
    text = " ".join(words) + " " + " ".join(docs.text.head(60))
    s = toxicity.symbols()[np.frombuffer(("   " + text.lower() + "   ").encode("utf-32-le"), np.uint32)].astype(int)
    gram = sum(s[n : len(s) - 3 + n] * 28 ** (3 - n) for n in range(4))
    costs = toxicity.character_costs(np.bincount(gram, minlength=28**4))
    p = np.exp(-costs.reshape(-1, 28).astype(float)).sum(1)
    assert np.allclose(p, 1, atol=1e-4)
    r = toxicity.Restorer(costs)
    for seen, want in {"1d10t": "idiot", "m0r0n": "moron", "l o s e r": "loser", "i.d.i.o.t": "idiot", "idiiiiiot": "idiot", "$tup1d": "stupid", "p@th3t1c": "pathetic", "the": "the", "!!!": ""}.items():
        assert r.word(seen) == want
    assert "idiot" in r.words("you 1d10t!") and r.text("You l o s e r, go") == "you loser, go"
    assert r.text("") == "" and r.words("") == set()
    for t in [*docs.text.head(80), "A 1d10t, a l o s e r; (m0r0n) and an idiiiiot -- x_y \0 ok", "s t u p i d!! 2+2=4 ,,, a.b.c"]:
        assert r.words(t) == set(toxicity._WORD.findall(r.text(t)))

    def paths(seen, i=0, past=0, last="", word="", cost=0.0):
        """Every path through the lattice: (word, cost)."""
        if i == len(seen):
            yield word, cost + float(costs[past * 28])
            return
        arcs, drop = toxicity.lattice(seen[i])
        for x, n, extra in arcs:
            if x == last:
                yield from paths(seen, i + 1, past, last, word, cost + extra + toxicity.REPEAT)
            yield from paths(seen, i + 1, (past * 28 + n) % 28**3, x, word + x, cost + extra + float(costs[past * 28 + n]))
        if drop is not None:
            yield from paths(seen, i + 1, past, last, word, cost + drop)

    for seen in ["1d10t", "$tup1d", "***", "a**b", "!!!", "#(*", "iiii1i", "l o s e r", "b1**#1", "f#*k3r", "é1ß", "_-_"]:
        best = {}
        for w, c in paths(seen):
            best[w] = min(c, best.get(w, np.inf))
        assert best[toxicity.decode(seen, costs.tolist())] == pytest.approx(min(best.values()), abs=1e-4)
    # a long word goes through whole: as its parts do where nothing joins them
    long = "1d10t" * 5000
    began = time.time()
    assert r.word(long).startswith("idiotidiot") and len(r.word(long)) > 20_000 and time.time() - began < 20
    assert all(len(k) <= toxicity.KEPT for k in r.known)


def test_character_counts_in_windows(spark, monkeypatch):
    """Every n-gram of every text once, however the texts are cut."""
    rng = np.random.default_rng(0)
    rows = ["".join(rng.choice(list("abc d,É1"), n)) for n in (0, 1, 3, 99, 100, 101, 1234)] + [None, "ΟΔΟΣ İ"]
    want = np.zeros(28**4, np.int64)
    for t in rows:
        s = toxicity.symbols()[[ord(c) for c in "   " + (t or "").lower() + "   "]]
        for i in range(len(s) - 3):
            want[((s[i] * 28 + s[i + 1]) * 28 + s[i + 2]) * 28 + s[i + 3]] += 1
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for piece in (7, 100, 1 << 20):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got = toxicity.character_counts(df)
        got[0] = want[0] = 0  # empty texts side by side leave only blanks
        assert (got == want).all()


# ---- the pipeline
def plain_pipeline(spark, docs, labels):
    """The rows that the filtering stages leave, document by document: models are fitted on the same rows, all else is plain."""
    import corpus_pipeline as p

    frame = lambda pdf: spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), SCHEMA)
    m = langid.fit(frame(docs[[not held(i, 5, 0) for i in docs.doc_id]]))
    told = [m.predict(t) for t in docs.text]
    docs = docs[[x != "und" and s >= 0.4 for x, s in told]]
    m = toxicity.fit(frame(docs), labels.filter(p.remainder("doc_id", 5) != 0))
    restorer = toxicity.Restorer(m.costs)
    docs = docs[[m.score(restorer.words(t or "")) < 0.5 for t in docs.text]].sort_values("doc_id")
    classes = brute_classes(docs.text.tolist())
    return docs[[c == i for i, c in enumerate(classes)]]


def test_pipeline_against_plain_stages(spark, docs):
    import corpus_pipeline as p

    want = plain_pipeline(spark, docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert 0 < len(want) < len(docs)
    rows = p.run(spark, DATA).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in want.itertuples()], packing.LENGTHS, max(packing.LENGTHS))
    assert {d for r in rows for d in r["doc_ids"]} == set(want.doc_id)


def test_pipeline_stages_odd(spark, odd, none):
    """What each stage makes of nulls, empty and blank texts, repeated rows and keys, null keys and clashing columns."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    for stage in stages.values():
        assert stage(spark, none, DATA).count() == 0
    for name in list(stages)[:-1]:
        assert stages[name](spark, odd, DATA).columns == odd.columns
    keys = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in df.collect())
    some = keys(stages["language_id"](spark, odd, DATA))
    assert not {3, 4, 5, 7} & set(some) and {1, 6} <= set(some) and some.count(1) == 2
    assert keys(stages["toxicity"](spark, odd, DATA)) == keys(odd)
    # row 1 is there twice and again as row 2, which has another text besides
    assert keys(stages["near_duplicates"](spark, odd, DATA)) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    packed = stages["packing"](spark, odd, DATA).collect()
    found = collections.Counter(d["doc_id"] for r in packed for d in r["documents"] if d["piece"] == 0)
    assert found == collections.Counter(r["doc_id"] for r in odd.collect())
    assert {d["doc_id"] for r in packed if not r["length"] for d in r["documents"]} == {3, 4}
