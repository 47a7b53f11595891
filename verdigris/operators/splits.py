"""Leakage-free splits: hash-ordered draws that any SQL engine repeats, quotas, purges, and checks of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.graphs import written
from verdigris.operators.joins import common_values, spread_join
from verdigris.operators.ordering import first_by_hash
from verdigris.operators.similarity import linked


def draw(seed: str | Column, key: str) -> Column:
    """A pseudo-random order of keys: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed) if isinstance(seed, str) else seed, F.col(key).cast("string")))


def support(df: DataFrame, k: int, seed: int, key: str = "vec_id", label: str = "label", group: str | None = None) -> DataFrame:
    """k rows of each class, or one row of each of k groups of the class; all of them, if fewer."""
    name = f"{k}.{seed}"
    if group:
        one = Window.partitionBy(label, group).orderBy(draw(name, key), key)
        df = df.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    w = Window.partitionBy(label).orderBy(draw(name, group or key), group or key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def stratified(df: DataFrame, share: float, seed: str, key: str = "vec_id", label: str = "label") -> DataFrame:
    """df with split: 'pool' for the first floor(share * n) rows of each class in the order of draw(), 'test' for the rest."""
    marked = first_by_hash(df, [label], draw(seed, key), key, lambda n: F.floor(F.lit(share) * n), "_pool")
    return marked.withColumn("split", F.when(F.col("_pool"), "pool").otherwise("test")).drop("_pool")


def hold_out_groups(df: DataFrame, parts: int, seed: str, group: str) -> DataFrame:
    """df with held: whether its group is among the first floor(groups / parts) in the order of draw()."""
    groups = first_by_hash(df.select(group).distinct(), [], draw(seed, group), group, lambda n: F.floor(n / parts), "held")
    return spread_join(df.filter(F.col(group).isNotNull()), groups, group, common_values(df.groupBy(group).agg(F.count("*").alias("n")), group))


def without_links(rows: DataFrame, to: DataFrame, edges: DataFrame | None, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that are not linked to any row of to (an edge, or a cosine of least or more)."""
    return rows.join(linked(rows, to, edges, least, key, vector), key, "left_anti")


def fill_quota(counts: list[tuple], share: float, slack: float, seed: str) -> list:
    """Groups taken, in pseudo-random order, while every quantity stays within share of its total times slack.

    counts has (group, {quantity: n}). A group that would break a quota is skipped, the next may still fit.
    """
    totals: dict = {}
    for _, c in counts:
        for q, n in c.items():
            totals[q] = totals.get(q, 0) + n
    have = dict.fromkeys(totals, 0)
    taken = []
    for g, c in sorted(counts, key=lambda x: (hashlib.md5(f"{seed}|{x[0]}".encode()).hexdigest(), x[0])):
        if all(have[q] + c.get(q, 0) <= totals[q] * share * slack for q in totals):
            taken.append(g)
            for q, n in c.items():
                have[q] += n
    return taken


def quota(df: DataFrame, share: float, group: str, quantity: str, label: str = "label", slack: float = 1.05, seed: str = "quota", most: int = 1_000_000) -> DataFrame:
    """label, group of the groups that fill each class's quota; only counts of groups reach a task, one class each, and a
    class of more than most counts is refused before."""
    counts = df.groupBy(F.col(label).cast("string").alias("label"), F.col(group).cast("string").alias("grp"), F.col(quantity).cast("string").alias("q")).agg(F.count("*").alias("n"))

    if not counts.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > most).isEmpty():
        raise ValueError(f"a class has more than {most} counts of groups")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict = {}
        for r in pdf.sort_values(["grp", "q"]).itertuples():
            by.setdefault(r.grp, {})[r.q] = r.n
        taken = fill_quota(list(by.items()), share, slack, seed)
        return pd.DataFrame({"label": [key[0]] * len(taken), "grp": taken})

    return counts.groupBy("label").applyInPandas(run, "label string, grp string").withColumnRenamed("grp", group)


def chosen(trial: int, groups: list, seed: str = "") -> np.ndarray:
    """Which groups a trial draws: each with the trial's own share, by md5, so that any engine can repeat it."""
    uniform = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2.0**32
    share = uniform(f"{seed}share|{trial}") * 0.9 + 0.05
    return np.array([uniform(f"{seed}in|{trial}|{g}") < share for g in groups], bool)


def best_assignment(df: DataFrame, share: float, group: str, label: str = "label", tries: int = 20_000, tolerance: float = 1.25, seed: str = "") -> DataFrame:
    """group, in_pool, error: of drawn subsets of the groups, the one whose class totals come relatively nearest to a share of all.

    Subsets that exceed a class's target tolerance times are out; the first of equal ones stays. error is its largest
    relative error (null, and no group in the pool, if every subset was out). Groups, of any number, are dealt over the
    tasks; each adds up what every trial draws of its own, a number for each trial and class, and Spark adds up those.
    Rows without a group or label do not count.
    """
    spark = df.sparkSession
    counts = written(df.groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count("*").alias("n")).filter("g is not null and l is not null"), "counts")
    target = counts.groupBy("l").agg(F.greatest(F.sum("n") * F.lit(share), F.lit(1e-9)).alias("target"))
    classes = target.count()

    def run(pdfs):
        total: dict = {}
        for pdf in pdfs:
            names, at = np.unique(pdf["g"], return_inverse=True)
            wide = pd.DataFrame({"at": at, "l": pdf["l"], "n": pdf["n"]}).pivot(index="at", columns="l", values="n").fillna(0)
            m = wide.to_numpy(float)
            got = np.stack([chosen(t, names.tolist(), seed) @ m for t in range(tries)]) if tries else np.zeros((0, m.shape[1]))
            for i, l in enumerate(wide.columns):
                total[l] = total.get(l, 0) + got[:, i]
        for l, got in total.items():
            t = np.flatnonzero(got)
            yield pd.DataFrame({"trial": t, "l": l, "n": got[t]})

    kind = {c: counts.schema[c].dataType.simpleString() for c in ("g", "l")}
    drawn = counts.mapInPandas(run, f"trial bigint, l {kind['l']}, n double").groupBy("trial", "l").agg(F.sum("n").alias("n")).join(target, "l")
    ratio = F.col("n") / F.col("target")
    errors = drawn.groupBy("trial").agg(F.max(F.abs(ratio - 1)).alias("error"), F.count("*").alias("seen"), F.max(F.col("n") > F.col("target") * tolerance).alias("out"))
    # a class of which a trial has nothing is off by its whole target
    each = spark.range(tries).withColumnRenamed("id", "trial").join(errors, "trial", "left").filter(~F.coalesce("out", F.lit(False)))
    each = each.select("trial", F.when(F.coalesce("seen", F.lit(0)) < classes, F.greatest(F.coalesce("error", F.lit(0e0)), F.lit(1e0))).otherwise(F.col("error")).alias("error"))
    best = each.orderBy("error", "trial").first() if classes else None

    def mark(pdfs):
        for pdf in pdfs:
            yield pdf.assign(in_pool=chosen(best["trial"], pdf["g"].tolist(), seed) if best else False)

    groups = counts.select("g").distinct().mapInPandas(mark, f"g {kind['g']}, in_pool boolean")
    return groups.select(F.col("g").alias(group), "in_pool", F.lit(best["error"] if best else None).cast("double").alias("error"))


def violations(pool: DataFrame, test: DataFrame, group: str, label: str = "label") -> DataFrame:
    """check, n: shared groups, and classes missing on either side; all 0 for a sound split."""
    shared = pool.select(group).distinct().intersect(test.select(group).distinct()).agg(F.count("*").alias("n")).select(F.lit("shared_groups").alias("check"), "n")
    a, b = pool.select(label).distinct(), test.select(label).distinct()
    missing = a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("n")).select(F.lit("missing_classes").alias("check"), "n")
    return shared.union(missing)
