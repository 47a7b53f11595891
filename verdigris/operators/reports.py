"""Run logs and their reports: unions, winners of repeats, mean and deviation tables, pivots, audits, pending work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.ordering import quantiles

#: The order of support sizes in tables.
SIZES = ("1", "2", "4", "8", "16", "full")


def size_rank(k: str = "K") -> Column:
    return F.array_position(F.array(*map(F.lit, SIZES)), F.col(k).cast("string"))


def all_runs(logs: list[tuple[int, DataFrame]], keys: tuple[str, ...] = ("method", "K", "seed"), order: str = "run_id", exclude: tuple[str, ...] = ()) -> DataFrame:
    """The union of logs of differing columns, one row for each key: of the log of lowest priority number, its newest run."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_p", F.lit(p)) for p, df in logs])
    if exclude:
        whole = whole.filter(~F.col("method").isin(*exclude))
    w = Window.partitionBy(*keys).orderBy("_p", F.desc(order))
    return whole.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def mean_std(df: DataFrame, by: list[str], value: str, fill: bool = True) -> DataFrame:
    """by, mean, std (of the sample; of one row 0, or null without fill), lo, hi, n."""
    std = F.stddev_samp(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.coalesce(std, F.lit(0e0)) if fill else std).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def cell(mean: Column, std: Column, places: int = 3) -> Column:
    """'mean ± std', rounded half to even."""
    text = lambda x: F.format_string(f"%.{places}f", F.bround(x, places))
    return F.concat(text(mean), F.lit(" ± "), text(std))


def by_size(df: DataFrame, row: str, value: str, k: str = "K", sizes: tuple[str, ...] = SIZES) -> DataFrame:
    """A row for each method, a column k_<size> for each support size: the named columns keep this one aggregate."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(k).cast("string") == s, F.col(value))).alias(f"k_{s}") for s in sizes])


def audit(df: DataFrame, by: str, content: str, group: str) -> DataFrame:
    """by, files, contents, groups, and a TOTAL row that adds the rows up (a content in two classes counts twice)."""
    rows = df.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("files"), F.countDistinct(content).alias("contents"), F.countDistinct(group).alias("groups"))
    return rows.union(rows.agg(F.lit("TOTAL"), F.sum("files"), F.sum("contents"), F.sum("groups")))


def pending(plan: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """What of the plan is not in the log yet."""
    return plan.join(log.select(*keys).distinct(), keys, "left_anti")


def examples(df: DataFrame, right: int = 3, wrong: int = 1, by: str = "label", conf: str = "conf", key: str = "vec_id") -> DataFrame:
    """For each class the surest right rows and the surest wrong ones.

    The limits are literal, so each task keeps no more than those of a class before any row is shuffled.
    """

    def surest(rows: DataFrame, most: int) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(conf), key))).filter(F.col("_n") <= F.lit(most)).drop("_n")

    return surest(df.filter(F.col("right")), right).unionByName(surest(df.filter(~F.col("right")), wrong))


def described(df: DataFrame, value: str) -> DataFrame:
    """n, mean, std, lo, q25, q50, q75, hi; quartiles exact, between neighbours linear."""
    rest = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = quantiles(df, value, [0.25, 0.5, 0.75]).select("n", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return rest.join(q, F.lit(True)).select("n", "mean", "std", "lo", "q25", "q50", "q75", "hi")  # a row each


def winner(df: DataFrame, score: str, order: list[str]) -> DataFrame:
    """The row of largest score, of equal ones the first in order."""
    return df.orderBy(F.desc(score), *order).limit(1)


def formatted(means: DataFrame, row: str, at: str, places: int = 3, sizes: tuple[str, ...] = SIZES) -> DataFrame:
    """mean_std() as text: a 'mean ± std' column for each size, and place, the rows' order by their mean at one size (none last)."""
    cells = means.select(row, "K", half_even(F.col("mean"), places).alias("m"), cell(F.col("mean"), F.col("std"), places).alias("cell"))
    wide = by_size(cells, row, "cell", sizes=sizes)
    keys = cells.groupBy(row).agg(F.max(F.when(F.col("K").cast("string") == at, F.col("m"))).alias("_at"))
    # a row for each method
    return wide.join(keys, row).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("_at"), row))).drop("_at")


def statistics(df: DataFrame, by: str, metrics: list[str], places: int = 4) -> DataFrame:
    """by, and for each metric its mean, deviation of the sample and maximum, half to even."""
    kinds = (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))
    return df.groupBy(by).agg(*[half_even(f(F.col(m).cast("double")), places).alias(f"{m}_{n}") for m in metrics for n, f in kinds])


def differences(one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, one, other, and place: the order of what the other has more, smallest first. A row for each class."""
    both = one.select(key, F.col(value).alias("one")).join(other.select(key, F.col(value).alias("other")), key)
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.round(F.col("other") - F.col("one"), 9), key)))


def bars(log: DataFrame, value: str) -> DataFrame:
    """method, K, mean, gain over the size's mean of means, place within the size."""
    m = mean_std(log, ["method", "K"], value).select("method", "K", "mean")
    return m.withColumns({"gain": F.col("mean") - F.avg("mean").over(Window.partitionBy("K")), "place": F.row_number().over(Window.partitionBy("K").orderBy(F.desc("mean"), "method"))})


def dots(log: DataFrame, value: str, places: int = 3) -> DataFrame:
    """The data behind a chart of dots with a panel for each K: method, K, mean, lo, hi of the runs, place, start, best.

    place is the method's order by its average of means, the same in every panel; start the panel's left bound, below the
    least run on a twentieth and not below 0; best whether the mean, as shown, is the panel's largest, so that ties all are.
    Null values are no runs; a method without any at a size has no row there. A row for each method and size.
    """
    m = mean_std(log.filter(F.col(value).isNotNull()), ["method", "K"], value).select("method", "K", "mean", "lo", "hi")
    panel = Window.partitionBy("K")
    of = m.groupBy("method").agg(F.avg("mean").alias("_avg")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("_avg"), "method"))).drop("_avg")
    shown = half_even(F.col("mean"), places)
    m = m.withColumns({"start": F.greatest(F.lit(0e0), F.floor((F.min("lo").over(panel) - 0.02) * 20) / 20), "best": shown == F.max(shown).over(panel)})
    return m.join(of, "method").select("method", "K", "mean", "lo", "hi", "place", "start", "best")


def verdicts(models: list[tuple[str, DataFrame]], final: str, key: str = "vec_id") -> DataFrame:
    """key, label, pred, conf and right of the final model, and n_right, models: how many models are right, of how many.

    models are (name, key, label, pred; the final one's with conf too) on the same items, a row for each; an item that the
    final model lacks is left out, a model that lacks an item is not counted there. A null label or pred is not right.
    """
    right = F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    votes = reduce(DataFrame.unionByName, [df.select(key, right.cast("int").alias("_r")) for _, df in models])
    counts = votes.groupBy(key).agg(F.sum("_r").cast("int").alias("n_right"), F.count("*").cast("int").alias("models"))
    return dict(models)[final].select(key, "label", "pred", "conf", right.alias("right")).join(counts, key)


def first_of_class(df: DataFrame, most: int, by: str = "label", key: str = "vec_id") -> DataFrame:
    """The rows of the smallest keys of each class, at most most; a task keeps no more than those before rows are shuffled."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(key))).filter(F.col("_n") <= F.lit(most)).drop("_n")
