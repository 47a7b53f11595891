"""What Spark calls by name or as it goes: table functions, data sources, streams with state."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import boxes, tables
from verdigris.operators import regions
from verdigris.sources import encoders, formats, readers
from verdigris.streaming import arrivals


def test_table_functions_are_the_columns(spark):
    rng = np.random.default_rng(4)
    tables.register(spark)
    rows = [(i % 7, i, *map(float, rng.random(4)), float(rng.integers(0, 5))) for i in range(120)]
    rows += [(8, 0, 0.0, 0.0, 1.0, 1.0, 1.0), (8, 1, 0.0, 0.0, 1.0, 1.0, 1.0), (9, 0, None, 0.0, 1.0, 1.0, 1.0), (None, 0, 0.0, 0.0, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame([(a, k, x, y, None if x is None else x + w, y + h, s) for a, k, x, y, w, h, s in rows], "item bigint, k int, x0 double, y0 double, x1 double, y1 double, score double")
    df = df.withColumn("place", F.lit("clash"))
    got = {(r["item"], r["k"]) for r in spark.sql("SELECT * FROM suppressed(TABLE(SELECT * FROM {df}) PARTITION BY item)", df=df).collect()}
    box = F.struct("x0", "y0", "x1", "y1", "score", "k")
    lists = df.filter("x0 is not null").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("k", box.alias("b")))).alias("l"))
    kept = lists.select("item", F.explode(regions.suppressed(F.transform("l", lambda x: x["b"]))).alias("b"))
    assert got == {(r["item"], r["b"]["k"]) for r in kept.collect()} and (8, 0) in got and (8, 1) not in got and (None, 0) in got
    assert spark.sql("SELECT * FROM suppressed(TABLE(SELECT * FROM {df}) PARTITION BY item)", df=df.filter("false")).count() == 0
    sizes = spark.createDataFrame([(1, 700, 500), (2, 10, 20), (3, None, 5), (4, 0, 5)], "item bigint, width int, height int")
    tiles = spark.sql("SELECT * FROM tiles(TABLE(SELECT * FROM {df}), 224, 112)", df=sizes)
    plain = sizes.filter("width > 0").select("item", F.posexplode(encoders.tiles(F.col("width"), F.col("height"), 224, 112)).alias("place", "b")).select("item", "place", "b.*")
    assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, plain.collect()))
    assert boxes.kept_boxes(np.zeros((0, 4))) == []


WRITER = """
import sys
from pyspark.sql import SparkSession
from verdigris.sources import formats
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for i in range(3):
    formats.append_runs(s.createDataFrame([(sys.argv[2], "4", 10 * i + j) for j in range(5)], "method string, K string, seed int"), sys.argv[1])
"""


def test_two_drivers_append_to_one_log(spark, tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    both = [subprocess.Popen([sys.executable, "-c", WRITER, f"{tmp_path}/log", m], cwd=top, stderr=subprocess.DEVNULL) for m in ("x", "y")]
    assert [p.wait(120) for p in both] == [0, 0]
    rows = sorted((r["method"], r["K"], r["seed"]) for r in readers.run_log(spark, f"{tmp_path}/log").collect())
    assert rows == sorted((m, "4", 10 * i + j) for m in "xy" for i in range(3) for j in range(5))
    # what no commit lists counts for nothing, and a filter is tested on the lines
    (tmp_path / "log" / "_runs" / "lost.json").write_text(json.dumps({"method": "x", "seed": 99}) + "\n")
    log = spark.read.format("run_log").load(f"file://{tmp_path}/log")
    (tmp_path / "log" / "plain.json").write_text('{"method": "z", "K": 2}\n{"broken\n')
    assert {(r["method"], r["K"]) for r in log.collect()} - {("x", "4"), ("y", "4")} == {("z", "2"), (None, None)}
    assert log.count() == 32 and log.filter("method = 'x' and seed in (0, 1, 77)").count() == 2 and log.filter("acc is null").count() == 32


def test_run_log_odd(spark, tmp_path):
    at = f"{tmp_path}/log"
    formats.append_runs(spark.createDataFrame([], "method string"), at)
    formats.register(spark)
    assert spark.read.format("run_log").load(at).count() == 0
    formats.append_runs(spark.createDataFrame([(None, 4, [1.0], "ü\n"), ("m", None, None, None)], "method string, K int, ab_train array<double>, other string"), at)
    got = spark.read.format("run_log").load(at)
    assert {(r["method"], r["K"], tuple(r["ab_train"] or ())) for r in got.collect()} == {(None, "4", (1.0,)), ("m", None, ())}
    assert got.filter("method = 'm'").count() == 1 and got.filter("method is null").count() == 1
    with pytest.raises(Exception, match="only appended"):
        got.limit(0).write.format("run_log").mode("overwrite").save(at)


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_ground_truth_in_ranges(spark, tmp_path, split):
    formats.register(spark)
    text = "a/1.jpg 3 1 2 3 4\n\nb,4\nonly\na/2.jpg\tx 1 2 3 4 5 6 7 8 9\r\nc 5 1 2 z 4\nä 6"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_bytes(text.encode())
    (tmp_path / "in" / "_skipped").write_text("no 1\n")
    (tmp_path / "in" / "empty").write_text("")
    df = spark.read.format("ground_truth").option("split", split).load(f"{tmp_path}/in")
    got = sorted((r["path"], r["label"], r["boxes"]) for r in df.collect())
    four = [1.0, 2.0, 3.0, 4.0]
    assert got == [("a/1.jpg", 3, [four]), ("a/2.jpg", None, [four, [5.0, 6.0, 7.0, 8.0]]), ("b", 4, []), ("c", 5, [[1.0, 2.0, None, 4.0]]), ("ä", 6, [])]
    assert df.filter("path like 'a/%'").count() == 2 and df.filter("label = 5").count() == 1 and df.filter("label is null").count() == 1


ARRIVING = "vec_id bigint, label int, high bigint, low bigint, ts timestamp"


def drain(spark, at, most, **named):
    stream = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    q = arrivals.links(stream, most, **named).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    q.awaitTermination(200)
    return sorted((r["late"], r["early"], r["bits"]) for r in spark.read.schema(arrivals.LINK).parquet(f"{at}/out").collect())


def arrive(spark, at, name, rows):
    start = np.datetime64("2024-01-01T00:00:00")
    rows = [(i, c, h, w, None if m is None else (start + np.timedelta64(m, "m")).astype("datetime64[us]").item()) for i, c, h, w, m in rows]
    spark.createDataFrame(rows, ARRIVING).coalesce(1).write.parquet(f"{at}/in/{name}")


def test_near_copies_in_different_batches(spark, tmp_path):
    top = 1 << 31
    arrive(spark, tmp_path, "a", [(1, 0, top, 5, 0), (2, 1, top, 5, 1), (3, 0, 99, 99, 1), (4, None, top, 5, 2), (5, 0, None, 1, 2), (6, 0, 1, 1, None)])
    first = drain(spark, tmp_path, 2)
    assert first == []
    arrive(spark, tmp_path, "b", [(7, 0, top, 4, 5), (8, 0, top | 1, 5, 6), (9, None, top, 5, 6), (10, 0, 0, 0, 7), (1, 0, top, 5, 8)])
    # 8 is near 1 and 7; the repeated row of 1 meets 7 and 8, but not itself; null is a class
    want = [(1, 7, 1), (1, 8, 1), (7, 1, 1), (8, 1, 1), (8, 7, 2), (9, 4, 0), (10, 7, 2)]
    assert drain(spark, tmp_path, 2) == want
    assert drain(spark, tmp_path, 2) == want  # from the checkpoint: nothing twice
    # an hour and more later: what was seen has expired; what is late is dropped
    arrive(spark, tmp_path, "c", [(11, 0, top, 4, 69), (12, 0, top, 4, 100), (13, 0, 99, 99, 62)])
    assert set(drain(spark, tmp_path, 2)) - set(want) == {(12, 11, 0)}
    arrive(spark, tmp_path, "d", [(14, 0, top, 4, 80), (15, 0, top, 4, 101)])
    assert set(drain(spark, tmp_path, 2)) - set(want) == {(12, 11, 0), (15, 12, 0)}
    with pytest.raises(ValueError):
        arrivals.links(spark.createDataFrame([], ARRIVING), 2, keep="5 minutes")


def test_links_that_hold_arrivals_together(spark, tmp_path):
    """With forest far fewer links, all of them links without it, and the same groups, over batches and repeated hashes."""
    rng = np.random.default_rng(4)
    rows = [(i, int(c), 0, int(sum(1 << int(b) for b in rng.choice(6, 2))) | int(g) << 16, int(m)) for i, (c, g, m) in enumerate(zip(rng.integers(0, 2, 240), rng.integers(0, 3, 240) * 21, rng.integers(0, 9, 240)))]
    for n in range(3):
        arrive(spark, tmp_path / "one", str(n), rows[n::3])
        arrive(spark, tmp_path / "two", str(n), rows[n::3])
    whole, few = drain(spark, tmp_path / "one", 2), drain(spark, tmp_path / "two", 2, forest=True)

    def groups(links):
        root = {i: i for i in range(240)}
        for a, b, _ in links:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        return root

    assert set(few) <= set(whole) and len(few) < len(whole) / 2 and groups(few) == groups(whole) and len(set(groups(few).values())) < 200
    assert len(few) < 3 * 3 * len(rows)
