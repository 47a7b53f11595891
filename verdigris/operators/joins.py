"""Joins in which no value's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value is common if it has a share of 1 / COMMON of the rows or more: there are COMMON such values at most.
COMMON = 1000


def common_values(counts: DataFrame, on: str, n: str = "n") -> DataFrame:
    """The values of on that are common, from the number of rows of each: COMMON at most, so that they may be broadcast."""
    rows = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter((F.col(n) > 1) & (F.col(n) * COMMON >= rows)).select(on)


def spread_join(left: DataFrame, right: DataFrame, on: str, common: DataFrame) -> DataFrame:
    """left with the columns of right (one row for each value of on, null where there is none).

    common has the values of on that so many rows of left share that one task should not have them all; there must be
    a proven bound of their number, as their rows of right are broadcast. Rows of other values are dealt by value.
    """
    values = [c for c in right.columns if c != on]
    top = right.join(F.broadcast(common), on, "left_semi").select(on, F.struct(*values).alias("_top"))
    marked = left.join(F.broadcast(common.withColumn("_common", F.lit(True))), on, "left").join(F.broadcast(top), on, "left")
    # a null meets nothing, and the number beside it spreads the rows that have one
    marked = marked.withColumn("_on", F.when(F.col("_common").isNull(), F.col(on))).withColumn("_deal", F.when(F.col("_on").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(9973))).otherwise(0).cast("int"))
    rest = right.join(F.broadcast(common), on, "left_anti").select(F.col(on).alias("_on"), F.struct(*values).alias("_rest"), F.lit(0).alias("_deal"))
    both = F.coalesce("_top", "_rest")
    return marked.join(rest, ["_on", "_deal"], "left").select(*left.columns, *[both[c].alias(c) for c in values])
