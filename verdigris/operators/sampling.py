"""Draws that repeat: so many rows of each stratum by hash order, bands of a value, and weighted draws with replacement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.graphs import written
from verdigris.operators.splits import draw


def per_stratum(df: DataFrame, n: int, seed: str, key: str, by: list[str]) -> DataFrame:
    """n rows of each stratum in the order of draw(); ranks above n are dropped before the shuffle."""
    w = Window.partitionBy(*by).orderBy(draw(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def at_most(df: DataFrame, most: int, seed: str, key: str) -> DataFrame:
    """df, or its first most rows in the order of draw() if it has more: a bounded set to tune on."""
    return df.orderBy(draw(seed, key), key).limit(most)


def band(value: Column, edges: list[float]) -> Column:
    """The number of the band [edge, next edge) that a value is in; null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = F.when((value >= lo) & (value < hi), F.lit(i)).otherwise(out)
    return out


def balanced_draws(labels: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Positions of n draws with replacement in which every class is as likely as any other."""
    names, at, counts = np.unique(labels, return_inverse=True, return_counts=True)
    p = 1 / (counts[at] * len(names))
    return np.random.default_rng(seed).choice(len(labels), n, p=p)


def drawn(df: DataFrame, n: int, seed: str, key: str, weight: str) -> DataFrame:
    """i, key: n draws with replacement, each row as likely as its weight; draw i lies at md5(seed|i) of the summed weights.

    Weights are summed in the order of key, range by range, so no task sorts all rows; a draw meets only the rows of
    its range.
    """
    spark = df.sparkSession
    rows = written(df.select(key, F.col(weight).cast("double").alias("w")).orderBy(key).withColumn("part", F.spark_partition_id()), "weights")
    sums = sorted((r["part"], r["w"]) for r in rows.groupBy("part").agg(F.sum("w").alias("w")).collect())  # a row for each range
    total = sum(w for _, w in sums)
    if not total:
        return spark.createDataFrame([], f"i bigint, {key} {df.schema[key].dataType.simpleString()}")
    starts, at = [], 0.0
    for _, w in sums:
        starts.append(at / total)
        at += w
    start, part = (F.array(*map(F.lit, x)) for x in (starts, [p for p, _ in sums]))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    draws = spark.range(n).withColumn("u", u).withColumn("_n", F.size(F.filter(start, lambda s: s <= F.col("u"))))
    draws = draws.select(F.element_at(part, F.col("_n")).alias("part"), F.round("u", 9).alias("at"), F.col("id").alias("i"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    within = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.join(F.broadcast(spark.createDataFrame([(p, s) for (p, _), s in zip(sums, starts)], "part int, start double")), "part")
    ends = ends.select("part", F.round(F.col("start") + F.sum("w").over(within) / total, 9).alias("at"), F.lit(None).cast("bigint").alias("i"), key)
    # from the largest place down, the last row passed is the first that ends beyond the draw
    down = Window.partitionBy("part").orderBy(F.desc("at"), F.col("i").isNotNull().desc(), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return draws.unionByName(ends).withColumn("_row", F.last(key, ignorenulls=True).over(down)).filter("i is not null").select("i", F.col("_row").alias(key))
