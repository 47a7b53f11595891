"""Log reassembly: random logs in few and many ranges against a plain replay, the query against SQL and a plain replay."""

import random
import zlib

import duckdb
import pytest

from tests.conftest import DATA
from verdigris.llm import undo
from verdigris.llm.queries import ORACLES, QUERIES

LOG = "source string, seq bigint, op string, key bigint, value bigint"


def plain(log, epoch=64):
    """kind, id, n, value of the records (source, seq, op, key, value), one after the other."""
    store, rows, commits, open_of = {}, [], 0, {}

    def state():
        rows.append(("state", -(-commits // epoch), len(store), sum(store.values())))

    for source, seq, op, key, value in sorted(log, key=lambda r: (r[1], r[0] is not None, r[0] or "")):
        own = open_of.setdefault(source, [])
        if op == "change":
            own.append((seq, key, value))
        elif op == "savepoint":
            own.append(None)
        elif op == "rollback":
            while own and (x := own.pop()):
                rows.append(("rollback", x[0], seq, x[1]))
        elif op == "abort":
            rows.extend(("abort", x[0], seq, x[1]) for x in own if x)
            own.clear()
        else:
            for _, k, v in filter(None, own):
                store.pop(k, None)
                if v is not None:
                    store[k] = v
            own.clear()
            commits += 1
            if commits % epoch == 0:
                state()
    if commits % epoch:
        state()
    return rows + [("abort", x[0], None, x[1]) for own in open_of.values() for x in own if x]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x) for x in r])


def rows(df):
    return order(df.select("kind", "id", "n", "value").collect())


@pytest.mark.parametrize("weights", [(10, 4, 2, 1, 1), (10, 6, 8, 0.3, 0.1), (10, 3, 3, 0, 0.002), (5, 5, 1, 0, 0)])
def test_random_logs(spark, weights):
    """Transactions within a range, over some, and one over all of them."""
    random.seed(sum(weights))
    log = []
    for i in range(700):
        op = random.choices(["change", "savepoint", "rollback", "abort", "commit"], weights)[0]
        log.append((random.choice([None, "a", "a", "a", "b"]), i, op, *((random.randrange(30), random.choice([None, 5, random.randrange(1000)])) if op == "change" else (None, None))))
    df = spark.createDataFrame(log, LOG).repartition(7)
    for parts in (2, 24):
        assert rows(undo.digest(df, 4, parts)) == order(plain(log, 4))


def test_levels_over_many_ranges(spark):
    """Savepoints pile up over many ranges, then more rollbacks than savepoints undo them from others."""
    log = [("a", 2 * i + j, *(("change", i % 7, i) if j else ("savepoint", None, None))) for i in range(100) for j in (0, 1)]
    log += [("a", 200 + i, "rollback", None, None) for i in range(120)] + [("a", 320, "change", 3, 9), ("a", 321, "rollback", None, None), ("a", 322, "change", 4, 8), ("a", 323, "commit", None, None)]
    got = rows(undo.digest(spark.createDataFrame(log, LOG), 4, 40))
    assert got == order(plain(log, 4)) and ("state", 1, 1, 8) in got


def test_empty_commits_fill_epochs(spark):
    log = [("a", i, "commit", None, None) for i in range(9)]
    assert rows(undo.digest(spark.createDataFrame(log, LOG), 4, 3)) == [("state", 1, 0, 0), ("state", 2, 0, 0), ("state", 3, 0, 0)]


def test_odd_rows(spark):
    """No seq or op: left out. Repeated records count twice. Null keys are a key, null sources a source, equal seq goes by source."""
    log = [("a", 1, "change", 1, 10), ("a", 1, "change", 1, 10), (None, 2, "change", None, 7), ("a", 3, "commit", None, None), (None, 3, "commit", None, None), ("a", 3, "commit", None, None), ("a", 4, "change", 1, None), ("a", 5, "commit", None, None)]
    df = spark.createDataFrame(log + [("a", None, "abort", None, None), ("a", 4, None, 1, 1), ("a", 4, "nothing", 1, 1)], LOG)
    assert rows(undo.digest(df.selectExpr("*", "1 AS kind", "2 AS part"), 1, 2)) == [("state", 1, 1, 7), ("state", 2, 2, 17), ("state", 3, 2, 17), ("state", 4, 1, 7)]
    assert rows(undo.digest(df.limit(0))) == []
    assert rows(undo.digest(df.filter("op = 'change'"), 1, 2)) == [("abort", 1, None, 1), ("abort", 1, None, 1), ("abort", 2, None, None), ("abort", 4, None, 1)]


def test_values_of_any_type(spark):
    """Texts as values: the versions of each key are the published texts."""
    log = spark.createDataFrame([("a", 1, "change", "k", "one"), ("a", 2, "commit", None, None), ("a", 3, "change", "k", "two"), ("a", 4, "commit", None, None), ("a", 5, "change", "k", "lost"), ("a", 6, "rollback", None, None)], "source string, seq bigint, op string, key string, value string")
    history = undo.reassemble(log, 2)
    assert sorted(tuple(r) for r in undo.versions(history, 1)[1].collect()) == [("k", 1, "one", None), ("k", 2, "two", "one")]
    assert [tuple(r) for r in history.undone.collect()] == [("rollback", 5, 6, "k", "lost")]


def test_one_commit_of_many_changes_and_one_key(spark):
    """A source with all records, a commit with most changes and a key of a third of them."""
    log = [("a", i, "change", 1 if i % 3 else i, i) for i in range(3000)] + [("a", 3000, "commit", None, None)]
    log += [("a", 3001 + i, *(("commit", None, None) if i % 2 else ("change", 1, i))) for i in range(200)]
    assert rows(undo.digest(spark.createDataFrame(log, LOG), 2, 16)) == order(plain(log, 2))


def test_query_equals_sql_and_a_plain_replay(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = rows(QUERIES["op13_undo"](spark, DATA))
    assert got == order(c.sql(f"SELECT kind, id, n, value FROM ({ORACLES['op13_undo']})").fetchall())
    toxic, log = {r[0] for r in c.sql("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}, []
    for i, text, source in c.sql("SELECT doc_id, text, source FROM documents").fetchall():
        h = zlib.crc32(str(i).encode())
        op, key = (["commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback"] + ["change"] * 10)[h % 17], h // 100 % 30000
        log.append((source, i, op, *((key, None if text is None or i in toxic else zlib.crc32(f"{key}:{text}".encode())) if op == "change" else (None, None))))
    assert got == order(plain(log))


def test_odd_documents(spark):
    """Null texts and toxic ones delete, a null key is no record, repeated labels and extra columns do no harm."""
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}", "s", 1) for i in range(300)] + [(None, "x", "s", 1)], "doc_id bigint, text string, source string, op int")
    marks = spark.createDataFrame([(3, 1), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    log = undo.as_log(docs, marks).collect()
    assert len(log) == 300 and all((r.value is None) == (r.op != "change" or r.seq % 5 == 0 or r.seq == 3) for r in log)
