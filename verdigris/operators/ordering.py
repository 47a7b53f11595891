"""Global orders without a global sort in one task: the first rows by a hash, and numbers in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.graphs import written


def first_by_hash(df: DataFrame, by: list[str], order: Column, key: str, number: Callable[[Column], Column], name: str = "taken") -> DataFrame:
    """df with a boolean: whether a row is among the first number(rows of its group) of its group in the order of a hex hash and key.

    The hash's first four digits cut each group into 65,536 ranges. Their counts, added up before the shuffle, tell in
    which range the cut lies; rows are ranked within ranges only, so a group of any size is spread over all tasks.
    """
    one = "_group"
    keys = by or [one]
    rows = (df if by else df.withColumn(one, F.lit(0))).withColumn("_order", order)
    rows = rows.withColumn("_range", F.conv(F.substring("_order", 1, 4), 16, 10).cast("int"))
    w = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    sums = counts.withColumns({"_all": F.sum("_n").over(w), "_before": F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).withColumn("_want", number(F.col("_all")).cast("bigint"))
    cuts = sums.filter("_before < _want and _want <= _before + _n").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_cut"), (F.col("_want") - F.col("_before")).alias("_need"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_order", key)))
    taken = F.coalesce((F.col("_range") < F.col("_cut")) | ((F.col("_range") == F.col("_cut")) & (F.col("_rank") <= F.col("_need"))), F.lit(False))
    extra = ["_order", "_range", "_rank", "_cut", "_need", *[f"_k{i}" for i in range(len(keys))], *([] if by else [one])]
    return ranked.join(cuts, same, "left").withColumn(name, taken).drop(*extra)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with each row's number, from 0, in the order of a column: a range-partitioned sort, then each partition's offset."""
    rows = written(df.orderBy(order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_part", "_at", "_before")


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with new columns {name: column}: each the sum of a column over the rows before a row in an order, 0 before the first.

    Rows are sorted into ranges, added up within each range, and the totals of the ranges before are added; only those, a
    row for each range, meet in one task. Rows of equal order come in any order and share a range, so group them first.
    """
    rows = written(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "running")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside, across = earlier(Window.partitionBy("_part").orderBy("_at")), earlier(Window.orderBy("_part"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = rows.groupBy("_part").agg(*[zero(F.sum(c)).alias(f"_{name}") for name, c in sums.items()])  # a row for each range
    before = totals.select("_part", *[zero(F.sum(f"_{name}").over(across)).alias(f"_{name}") for name in sums])
    both = rows.withColumns({f"_in_{name}": zero(F.sum(c).over(inside)) for name, c in sums.items()}).join(F.broadcast(before), "_part")
    return both.select(*df.columns, *[(F.col(f"_in_{name}") + F.col(f"_{name}")).alias(name) for name in sums])


def previous(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """df with the value of the row before in the order of its key, null at the first; (key, order) is unique.

    Keys of any number of rows are spread over ranges of (key, order); only the last row of each range meets the others.
    """
    rows = written(df.orderBy(key, order).withColumn("_part", F.spark_partition_id()), "previous")
    w = Window.partitionBy("_part", key).orderBy(order)
    last = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(key, order)).alias("_tail"))
    before = last.select("_part", F.lag("_tail").over(Window.orderBy("_part")).alias("_tail"))  # a row for each range
    seen = rows.withColumns({"_first": F.row_number().over(w) == 1, "_lag": F.lag(value).over(w)}).join(F.broadcast(before), "_part", "left")
    return seen.select(*df.columns, F.when(~F.col("_first"), F.col("_lag")).when(F.col("_tail.k").eqNullSafe(F.col(key)), F.col("_tail.v")).alias(name))


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """by, n and q0, q1, ... of each group: the exact quantiles of value at the given shares, between neighbours linear.

    Equal values are one row, ranked by running(), so a group of any size is spread over all tasks; no buffer has a
    group's values. Nulls count for nothing: a group of nulls only gives no row, a whole table of them one of nulls.
    """
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))] or ["_k"]
    rows = df.select(*([F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_k")]), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    ranked = running(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), [*keys, "_v"], {"_before": "_n"})
    groups = ranked.groupBy(*keys).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_all")).select(*[F.col(k).alias(f"{k}g") for k in keys], "_start", "_all")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}g"))
    first = F.col("_before") - F.col("_start")
    here = lambda r: F.max(F.when((first <= r) & (r < first + F.col("_n")), F.col("_v")))
    place = lambda p: F.lit(p) * (F.col("_all") - 1)
    ends = [x for i, p in enumerate(at) for x in (here(F.floor(place(p))).alias(f"_l{i}"), here(F.ceil(place(p))).alias(f"_h{i}"))]
    got = ranked.join(groups, same).groupBy(*keys).agg(F.max("_all").alias("n"), *ends)
    n = F.col("n") - 1
    values = [(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (F.lit(p) * n - F.floor(F.lit(p) * n))).alias(f"q{i}") for i, p in enumerate(at)]
    out = got.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", *values)
    if by:
        return out
    none = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_zero"))
    return none.join(out, F.lit(True), "left").select(F.coalesce("n", "_zero").alias("n"), *[f"q{i}" for i in range(len(at))])
