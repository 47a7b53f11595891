"""Average linkage of classes of any size, by merging clusters that are each other's nearest, many at once.

The mean cosine of two clusters is the inner product of their sums over the product of their sizes, so a cluster is its sum
vector and its size, and the square of all cosines is never kept. Merging never makes two clusters nearer to a third than
the nearer of them was. So clusters that are each other's nearest would be merged by the greedy order too, whatever happens
elsewhere; all of them merge in one round, and a cluster without a neighbour near enough is done.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.graphs import components, linkage_clusters, written
from verdigris.operators.ordering import running

#: Clusters of a block.
BLOCK = 4096


def nearest_clusters(clusters: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """c, partner, cos of the clusters (label, c, s, n) that have another of their class at a mean cosine of least or more:
    the nearest, of equally near ones that of the smaller pair of ids."""
    sizes = clusters.groupBy(F.col("label").alias("of")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = clusters.join(sizes, F.col("label").eqNullSafe(F.col("of"))).withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y")))
    dealt = rows.withColumn("at", F.explode(pairs)).select("label", "c", F.transform("s", lambda v: v / F.col("n")).alias("m"), "own", "at.x", "at.y")

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        left = pdf[pdf["own"] == key[1]]
        right = left if key[1] == key[2] else pdf[pdf["own"] == key[2]]
        out = pd.DataFrame({"c": np.zeros(0, np.int64), "partner": np.zeros(0, np.int64), "cos": np.zeros(0)})
        if not len(left) or not len(right):
            return out
        # rounded, so that a pair is as near from either side and in every block
        s = np.round(np.stack(left["m"].to_list()) @ np.stack(right["m"].to_list()).T, 12)
        i, j = left["c"].to_numpy(), right["c"].to_numpy()
        s[i[:, None] == j[None, :]] = -np.inf
        frames = [out]
        for a, b, t in ((i, j, s), (j, i, s.T)) if key[1] != key[2] else ((i, j, s),):
            top = t.max(1)
            # ids are in order, so of equally near ones the first is of the smaller pair: those below a in order, then those above
            at = (t == top[:, None]).argmax(1)
            keep = top >= least
            frames.append(pd.DataFrame({"c": a[keep], "partner": b[at[keep]], "cos": top[keep]}))
        return pd.concat(frames)

    found = dealt.groupBy("label", "x", "y").applyInPandas(best, "c bigint, partner bigint, cos double")
    pair = F.struct("cos", (-F.least("c", "partner")).alias("low"), (-F.greatest("c", "partner")).alias("high"), "partner")
    return found.groupBy("c").agg(F.max(pair).alias("top")).select("c", "top.partner", "top.cos")


def merges(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b: ids of clusters that merge, of rows (label, id, v) with unique ids; the smallest id stands for a cluster."""
    clusters = written(rows.select("label", F.col("id").alias("c"), F.transform("v", lambda x: x.cast("double")).alias("s"), F.lit(1).cast("bigint").alias("n")), "clusters")
    out = None
    while True:
        near = written(nearest_clusters(clusters, least, block), "near")
        back = near.select(F.col("c").alias("b"), F.col("partner").alias("a"))
        both = written(near.select(F.col("c").alias("a"), F.col("partner").alias("b")).filter("a < b").join(back, ["a", "b"]), "merges")
        if both.isEmpty():
            break
        out = both if out is None else out.union(both)
        live = clusters.join(near.select("c"), "c", "left_semi")  # the others are done
        parent = live.join(both.select(F.col("b").alias("c"), F.col("a").alias("into")), "c", "left")
        gone = parent.filter("into is not null").select(F.col("into").alias("c"), F.col("s").alias("s2"), F.col("n").alias("n2"))
        kept = parent.filter("into is null").drop("into").join(gone, "c", "left")
        s = F.when(F.col("n2").isNull(), F.col("s")).otherwise(F.zip_with("s", "s2", lambda x, y: x + y))
        clusters = written(kept.select("label", "c", s.alias("s"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "clusters")
    return out if out is not None else rows.sparkSession.createDataFrame([], "a bigint, b bigint")


def linkage_in_rounds(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """label, key, cluster: average-linkage clusters of each class by mean cosine of least or more, numbered from 0 in order
    of their first members; keys are unique. Rows without a vector take no part."""
    rows = written(df.select(F.col(label).cast("int").alias("label"), F.col(key).alias("id"), F.col(vector).alias("v")).filter("v is not null"), "rows")
    roots = written(rows.select("label", F.col("id").alias("node")).join(components(merges(rows, least, block), rows.select(F.col("id").alias("node"))), "node"), "roots")
    first = running(roots.filter("node = root").withColumn("one", F.lit(1).cast("bigint")), ["label", "root"], {"before": "one"}).select("label", "root", "before")
    starts = first.groupBy(F.col("label").alias("of")).agg(F.min("before").alias("start"))
    numbers = first.join(starts, F.col("label").eqNullSafe(F.col("of"))).select("root", (F.col("before") - F.col("start")).cast("int").alias("cluster"))
    return roots.join(numbers, "root").select("label", F.col("node").alias(key), "cluster")


def clusters(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label", most: int = 2 * BLOCK) -> DataFrame:
    """linkage_in_rounds() of classes of more than most rows, a class in a task of the others: the same clusters."""
    rows = df.filter(F.col(vector).isNotNull())
    sizes = written(rows.groupBy(F.col(label).alias("_of")).agg((F.count("*") > most).alias("_large")), "sizes")
    if sizes.filter("_large").isEmpty():
        return linkage_clusters(rows, least, key, vector, label, most)
    marked = rows.join(sizes, F.col(label).eqNullSafe(F.col("_of"))).drop("_of")
    small = linkage_clusters(marked.filter("not _large"), least, key, vector, label, most)
    return small.unionByName(linkage_in_rounds(marked.filter("_large"), least, key, vector, label))
