"""A resumable grid of runs: what the log lacks is fitted, scored on the test rows and appended."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from verdigris.operators import classifiers, evaluation, reports
from verdigris.sources import formats, readers

#: Support sizes with the whole pool last; seeds.
SIZES, SEEDS = (1, 2, 4, 8, 16), (1, 2, 3)


def plan(spark: SparkSession, methods: Iterable[str], sizes: Iterable[int] = SIZES, seeds: Iterable[int] = SEEDS, variants: Iterable[str] = ("last-epoch",)) -> DataFrame:
    """One row for each run. Variants are last-epoch and best-epoch: which of a trained method's epochs stays."""
    return spark.createDataFrame([(m, v, str(k), s) for m in methods for v in variants for k in sizes for s in seeds], "method string, variant string, K string, seed int")


def run(todo: DataFrame, log: str, make: Callable[[str], classifiers.Method], draw: Callable[[int, int], tuple[DataFrame, DataFrame]], test: DataFrame, classes: int, second: str | None = None, failed: Callable[[str, Exception], None] | None = None, lanes: int = 1) -> int:
    """Runs of todo that the log (a folder of JSON lines) lacks; how many were made.

    draw(size, seed) gives support and validation. Each finished run is appended at once, so that a stopped grid goes
    on where it was; other drivers may append to the log at the same time. With failed, a run that raises is reported and the grid goes on. Runs go through so many lanes at
    once, each a thread with a scheduler pool of its own, so that one lane's fit does not wait for another's jobs.
    """
    spark = todo.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        todo = reports.pending(todo, readers.run_log(spark, log), ["method", "variant", "K", "seed"])
    def one(r) -> int:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
        try:
            support, validation = draw(int(r["K"]), r["seed"])
            began = time.time()
            method = make(r["method"])
            method.pick = r["variant"] == "best-epoch"
            method.fit(classifiers.batch(support, second=second), classifiers.batch(validation, second=second))
            took = time.time() - began
            got = classifiers.predict(test, method, second=second).join(test.select("vec_id", "label"), "vec_id")
            m = evaluation.summary(evaluation.confusion(got, classes)).first()
            row = (r["method"], r["variant"], r["K"], r["seed"], support.count(), round(took, 1), round(m["acc"], 4), round(m["macro_f1"], 4))
        except Exception as e:
            if failed is None:
                raise
            failed(f"{r['method']} {r['K']} {r['seed']}", e)
            return 0
        formats.append_runs(spark.createDataFrame([row], "method string, variant string, K string, seed int, n_support int, fit_s double, acc double, macro_f1 double"), log)
        return 1

    rows = todo.orderBy("method", "variant", reports.size_rank(), "seed").collect()  # a plan is small: methods x sizes x seeds
    if lanes <= 1:
        return sum(map(one, rows))
    with ThreadPoolExecutor(lanes, thread_name_prefix="lane") as pool:
        return sum(pool.map(one, rows))
