"""Evaluation of class scores: predictions, confusion, F1, AUROC, calibration and its fit, agreement, explanations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.ordering import running


def softmax(df: DataFrame, key: str = "vec_id", z: str = "z", name: str = "p", tau: float | Column = 1.0) -> DataFrame:
    """df with a probability for each class of a key."""
    t = F.lit(tau) if isinstance(tau, float) else tau
    w = Window.partitionBy(key)
    e = F.exp((F.col(z) - F.max(z).over(w)) / t)
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def predicted(df: DataFrame, key: str = "vec_id", z: str = "z") -> DataFrame:
    """key, pred, top: the class of largest score, ties to the smallest class."""
    best = df.groupBy(key).agg(F.max(F.struct(F.col(z).alias("z"), (-F.col("class")).alias("c"))).alias("b"))
    return best.select(key, (-F.col("b.c")).cast("int").alias("pred"), F.col("b.z").alias("top"))


def margins(df: DataFrame, key: str = "vec_id", z: str = "z") -> DataFrame:
    """key, pred, margin: the largest score less the second."""
    two = F.slice(F.sort_array(F.collect_list(F.struct(F.col(z).alias("z"), (-F.col("class")).alias("c"))), asc=False), 1, 2)
    best = df.groupBy(key).agg(two.alias("b"))
    return best.select(key, (-F.col("b")[0]["c"]).cast("int").alias("pred"), (F.col("b")[0]["z"] - F.col("b")[1]["z"]).alias("margin"))


def confusion(df: DataFrame, classes: int, truth: str = "label", pred: str = "pred") -> DataFrame:
    """truth, pred, n for all classes x classes cells, and each row's share; 0 in empty cells, null shares in empty rows."""
    spark = df.sparkSession
    side = spark.range(classes).select(F.col("id").cast("int").alias("truth"))
    grid = side.withColumn("pred", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    counts = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    full = grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return full.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("truth")), F.lit(0)))


def class_metrics(cells: DataFrame) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 of every class of a confusion table; 0 where a denominator is 0."""
    tp = cells.filter("truth = pred").select(F.col("truth").alias("class"), F.col("n").alias("tp"))
    rows = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("actual"))
    columns = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("claimed"))
    x = tp.join(rows, "class").join(columns, "class").withColumns({"fp": F.col("claimed") - F.col("tp"), "fn": F.col("actual") - F.col("tp")})
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0e0))
    return x.select("class", "tp", "fp", "fn", part(F.col("tp"), F.col("claimed")).alias("precision"), part(F.col("tp"), F.col("actual")).alias("recall"), part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def summary(cells: DataFrame) -> DataFrame:
    """acc, macro_f1, macro_precision, macro_recall over all classes of a confusion table, absent ones counting 0."""
    m = class_metrics(cells).agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.sum("tp").alias("right"), (F.sum("tp") + F.sum("fn")).alias("all"))
    return m.select((F.col("right") / F.nullif(F.col("all"), F.lit(0))).alias("acc"), "macro_f1", "macro_precision", "macro_recall")


def auroc(df: DataFrame, truth: str = "label", score: str = "z") -> DataFrame:
    """class, auroc of each class against the rest by rank sums, ties at their mean rank; null without both kinds.

    Ranks come from counts of equal scores, added up over ranges of (class, score): neither a hot score nor a class is in
    one task.
    """
    counts = df.groupBy("class", F.col(score).alias("s")).agg(F.sum((F.col(truth) == F.col("class")).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    ranked = running(counts, ["class", "s"], {"before": "n"})
    # ranks are those of all classes, so each class's are less by what lies before its first
    sums = ranked.groupBy("class").agg(F.sum((F.col("before") + (F.col("n") + 1) / 2) * F.col("pos")).alias("r"), F.min("before").alias("start"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    r = F.col("r") - F.col("start") * F.col("p")
    return sums.select("class", ((r - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0e0))).alias("auroc"))


def calibration_bins(df: DataFrame, bins: int = 10, conf: str = "conf", right: str = "right") -> DataFrame:
    """bin (1 to bins), n, acc, mean_conf over (lower, upper] confidence bins; a confidence of 0 is in none."""
    return df.filter(F.col(conf) > 0).groupBy(F.ceil(F.col(conf) * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("acc"), F.avg(conf).alias("mean_conf"))


def ece(df: DataFrame, bins: int = 10, conf: str = "conf", right: str = "right") -> DataFrame:
    """ece: the bins' gaps between accuracy and confidence, weighted by their share of all rows."""
    none = F.when(F.col(conf) > 0, F.ceil(F.col(conf) * bins))
    b = df.groupBy(none.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("acc"), F.avg(conf).alias("mean"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("mean"))).otherwise(0e0)
    return b.agg(F.coalesce(F.sum(gap) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0e0)).alias("ece"))


def unsure_below(df: DataFrame, target: float = 0.9, least: int = 10, conf: str = "conf", right: str = "right") -> DataFrame:
    """threshold: the lowest of .50, .51, ..., .99 above which least rows or more are right in target or more; null if none."""
    grid = F.explode(F.transform(F.sequence(F.lit(50), F.lit(99)), lambda i: i / 100e0))
    kept = df.select(conf, right).withColumn("t", grid).filter(F.col(conf) >= F.col("t"))
    fine = kept.groupBy("t").agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("acc")).filter((F.col("n") >= least) & (F.col("acc") >= target))
    return fine.agg(F.min("t").alias("threshold"))


def temperature_grid(df: DataFrame, taus: list[float], key: str = "vec_id", truth: str = "label", z: str = "z") -> DataFrame:
    """tau, nll: the mean negative log likelihood of the true class at each temperature."""
    rows = df.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    each = rows.groupBy(key, "tau").agg(F.max(z).alias("top"), F.max(F.when(F.col("class") == F.col(truth), F.col(z))).alias("own"), F.collect_list(z).alias("all"))
    total = F.aggregate("all", F.lit(0e0), lambda s, x: s + F.exp((x - F.col("top")) / F.col("tau")))
    return each.groupBy("tau").agg(F.avg(F.log(total) - (F.col("own") - F.col("top")) / F.col("tau")).alias("nll"))


#: Bounds of ln tau, and the weight of the biases' squares in the loss.
LN_TAU, RIDGE = 3.0, 1e-3


def calibration_loss(z: np.ndarray, y: np.ndarray, s: float, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over rows of -ln softmax((z + b) e^s)[y], with its gradient and Hessian in (s, b); s is -ln tau.

    With u = z + b and p the probabilities: d/ds = e^s (E u - u_y), d/db = e^s (p - 1_y), and the second derivatives
    are e^2s (co)variances of u and of the classes under p, plus d/ds once more for s.
    """
    u, e, n = z + b, np.exp(s), len(z)
    w = u * e - (u * e).max(1, keepdims=True)
    p = np.exp(w)
    norm = p.sum(1, keepdims=True)
    p /= norm
    loss = float((np.log(norm[:, 0]) - w[np.arange(n), y]).sum())
    mean, hit = (p * u).sum(1), np.zeros_like(p)
    hit[np.arange(n), y] = 1
    g = np.r_[e * (mean - u[np.arange(n), y]).sum(), e * (p - hit).sum(0)]
    h = np.zeros((len(g), len(g)))
    h[0, 0] = e * e * ((p * u * u).sum(1) - mean**2).sum() + g[0]
    h[0, 1:] = h[1:, 0] = e * e * (p * (u - mean[:, None])).sum(0) + g[1:]
    h[1:, 1:] = e * e * (np.diag(p.sum(0)) - p.T @ p)
    return loss, g, h


def newton(step, size: int, rounds: int = 60) -> np.ndarray:
    """Minimum of a smooth function by damped Newton steps from 0; step(x) gives value, gradient and Hessian.

    Directions of negative curvature are turned round; a step that does not lower the value is halved.
    """
    x = np.zeros(size)
    value, g, h = step(x)
    for _ in range(rounds):
        curve, axes = np.linalg.eigh(h)
        move = -axes @ ((axes.T @ g) / np.maximum(np.abs(curve), 1e-9))
        if -(g @ move) < 1e-10:
            break
        for halving in range(40):
            new = x + move * 0.5**halving
            found = step(new)
            if np.isfinite(found[0]) and found[0] < value:
                break
        else:
            break
        x, (value, g, h) = new, found
    return x


def fit_temperature(z: np.ndarray, y: np.ndarray, with_bias: bool = True) -> tuple[float, np.ndarray]:
    """tau and class biases that make softmax((z + b) / tau) likeliest for y, biases held back by RIDGE.

    (1, 0) if every row is right already. The same numbers come from fit_calibration, for tables.
    """
    n, c = z.shape
    if not n or (z.argmax(1) == y).all():
        return 1.0, np.zeros(c)
    return _calibrated(lambda s, b: calibration_loss(z, y, s, b), n, c, with_bias)


def _calibrated(summed, n: int, c: int, with_bias: bool) -> tuple[float, np.ndarray]:
    """The fit on sums over n rows: summed(s, b) gives loss, gradient and Hessian."""
    free = 1 + c * with_bias

    def step(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        b = x[1:] if with_bias else np.zeros(c)
        if abs(x[0]) > LN_TAU:
            return np.inf, x, np.eye(free)
        loss, g, h = summed(x[0], b)
        g, h = g[:free] / n, h[:free, :free] / n
        g[1:] += 2 * RIDGE * x[1:]
        h[1:, 1:] += 2 * RIDGE * np.eye(free - 1)
        return loss / n + RIDGE * float(x[1:] @ x[1:]), g, h

    x = newton(step, free)
    return float(np.exp(-x[0])), x[1:] if with_bias else np.zeros(c)


def fit_calibration(df: DataFrame, classes: int, key: str = "vec_id", truth: str = "label", z: str = "z", with_bias: bool = True) -> tuple[float, np.ndarray]:
    """fit_temperature over a table of scores (key, class, z, truth) of any size: each Newton step is one pass over Arrow
    batches that gives a task's sums. (1, 0) if all rows are right already, or there are none. Rows that lack a class's
    score count it as impossible."""
    wide = df.groupBy(key, truth).agg(F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("int"), F.col(z).cast("double")))).alias("zs"))
    wide = wide.select(F.col(truth).cast("int").alias("y"), F.array(*[F.coalesce(F.element_at("zs", c), F.lit(-1e30)) for c in range(classes)]).alias("zs"))
    kept = wide.persist()

    def sums(s: float, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int, int]:
        def run(batches):
            total, rows, right = np.zeros(1 + (classes + 1) + (classes + 1) ** 2), 0, 0
            for batch in batches:
                if batch.num_rows:
                    y = batch.column("y").to_numpy(zero_copy_only=False)
                    m = np.stack(batch.column("zs").to_numpy(zero_copy_only=False))
                    loss, g, h = calibration_loss(m, y, s, b)
                    total += np.r_[loss, g, h.ravel()]
                    rows, right = rows + len(y), right + int((m.argmax(1) == y).sum())
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total) + 2, dtype=np.int32)), "v": pa.array(np.r_[total, rows, right])})

        got = kept.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        v = np.array([r["v"] for r in sorted(got)]) if got else np.zeros(3 + (classes + 1) + (classes + 1) ** 2)
        return float(v[0]), v[1 : classes + 2], v[classes + 2 : -2].reshape(classes + 1, classes + 1), int(v[-2]), int(v[-1])

    try:
        *_, n, right = sums(0.0, np.zeros(classes))
        if right == n:
            return 1.0, np.zeros(classes)
        return _calibrated(lambda s, b: sums(s, b)[:3], n, classes, with_bias)
    finally:
        kept.unpersist()


def calibrated(df: DataFrame, tau: float, bias: np.ndarray, key: str = "vec_id", z: str = "z", name: str = "p") -> DataFrame:
    """df with softmax((z + bias of the class) / tau) for each class of a key."""
    with_bias = df.withColumn("_z", F.col(z) + F.element_at(F.array(*[F.lit(float(x)) for x in bias]), F.col("class").cast("int") + 1))
    return softmax(with_bias, key, "_z", name, tau).drop("_z")


def agreement(runs: list[tuple[str, DataFrame]], truth: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, a column for each run (whether it is right), n_right."""
    out = truth.select(key, label)
    for name, df in runs:
        out = out.join(df.select(key, F.col("pred").alias(f"_{name}")), key)
    marks = [(F.col(f"_{name}") == F.col(label)).alias(name) for name, _ in runs]
    return out.select(key, *marks, sum(((F.col(f"_{name}") == F.col(label)).cast("int") for name, _ in runs), F.lit(0)).alias("n_right"))
