"""Removals and what they leave: exact copies, near copies, label conflicts; first reason wins; groups renumbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import vec
from verdigris.operators.joins import common_values, spread_join
from verdigris.operators.ordering import numbered


def exact_copies(df: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """md5, n, first_key of contents that several rows have; null contents are no copies of each other."""
    rows = df.filter(F.col(content).isNotNull()).groupBy(F.md5(F.col(content).cast("binary")).alias("md5"))
    return rows.agg(F.count("*").alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def label_conflicts(df: DataFrame, label: str, content: str = "text") -> DataFrame:
    """md5, n, labels of contents that occur with several labels."""
    rows = df.filter(F.col(content).isNotNull()).groupBy(F.md5(F.col(content).cast("binary")).alias("md5"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels")).filter("labels > 1")


def near_pairs(pairs: DataFrame, df: DataFrame, near: float, bits: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """a, b, cos of candidate pairs that hold: the cosine is stored at four places, and a pair whose stored cosine is below
    near must have signs that differ in bits components at most."""
    side = lambda n: df.select(F.col(key).alias(n), vec.sign_bits(F.col(vector), 32).alias(f"h{n}"), vec.sign_bits(F.col(vector), 0).alias(f"l{n}"))
    stored = pairs.select("a", "b", F.round("cos", 4).alias("cos"))
    both = stored.join(side("a"), "a").join(side("b"), "b")
    return both.filter((F.col("cos") >= near) | (vec.hamming(F.col("ha"), F.col("la"), F.col("hb"), F.col("lb")) <= bits)).select("a", "b", "cos")


def removals(df: DataFrame, near: DataFrame | None = None, key: str = "doc_id", content: str = "text", label: str | None = None) -> DataFrame:
    """key, reason, kept_twin of rows to remove: unreadable, then exact copies, near copies (near: key, twin), label conflicts.

    Of a content, the row of smallest key stays; a content with several labels goes whole. The first reason counts,
    and the twin of the first that has one.
    """
    rows = df.select(F.col(key).alias("key"), F.md5(F.col(content).cast("binary")).alias("md5"), *([F.col(label).alias("l")] if label else []))
    readable = rows.filter("md5 is not null")
    first = readable.groupBy("md5").agg(F.min("key").alias("first"), (F.countDistinct("l") if label else F.lit(1)).alias("labels"), F.count("*").alias("n"))
    joined = spread_join(readable, first.filter("n > 1").drop("n"), "md5", common_values(first, "md5")).filter("first is not null")
    parts = [
        rows.filter("md5 is null").select("key", F.lit(0).alias("p"), F.lit("unreadable").alias("reason"), F.lit(None).cast("bigint").alias("twin")),
        joined.filter("key <> first").select("key", F.lit(1), F.lit("exact duplicate"), F.col("first").cast("bigint")),
    ]
    if near is not None:
        parts.append(near.select(F.col("key"), F.lit(2), F.lit("near-identical"), F.col("twin").cast("bigint")))
    if label:
        parts.append(joined.filter("labels > 1").select("key", F.lit(3), F.lit("label conflict"), F.lit(None).cast("bigint")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    out = whole.groupBy("key").agg(F.min_by("reason", "p").alias("reason"), F.min_by("twin", F.when(F.col("twin").isNotNull(), F.col("p"))).alias("kept_twin"))
    return out.withColumnRenamed("key", key)


def cleaned(df: DataFrame, removed: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """The rows that stay, with new_group: groups numbered from 0 in the order of their first rows."""
    kept = df.join(removed.select(key), key, "left_anti")
    firsts = kept.groupBy(group).agg(F.min(key).alias("_first"))
    common = common_values(kept.groupBy(group).agg(F.count("*").alias("n")), group)
    return spread_join(kept, numbered(firsts, "_first", "new_group").drop("_first"), group, common)
