"""What operations cost: medians of repeated timings after a warm-up, and the values that a method trains."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from verdigris.operators import classifiers

#: Timed repetitions, and ones before that are not.
REPS, WARM_UP = 5, 1


def timed(fn: Callable[[], object], reps: int = REPS, warm_up: int = WARM_UP) -> list[float]:
    """Milliseconds of each timed call."""
    out = []
    for i in range(warm_up + reps):
        began = time.perf_counter()
        fn()
        if i >= warm_up:
            out.append((time.perf_counter() - began) * 1000)
    return out


def table(spark: SparkSession, operations: Iterable[tuple[str, Callable[[], object], int]], reps: int = REPS, warm_up: int = WARM_UP) -> DataFrame:
    """operation, median_ms, least_ms, reps, params of each (name, call, trained values)."""
    rows = []
    for name, fn, params in operations:
        ms = timed(fn, reps, warm_up)
        rows.append((name, round(statistics.median(ms), 3), round(min(ms), 3), len(ms), params))
    return spark.createDataFrame(rows, "operation string, median_ms double, least_ms double, reps int, params bigint")


def values_of(method: object) -> int:
    """How many numbers a fitted method holds in arrays besides the class texts it was given."""
    return sum(v.size for k, v in vars(method).items() if isinstance(v, np.ndarray) and v.dtype.kind == "f" and k != "text")


def fits(methods: dict[str, type[classifiers.Method]], text: np.ndarray, support: classifiers.Batch, validation: classifiers.Batch) -> dict[str, float]:
    """Seconds that each method's fit takes, apart from reading its rows."""
    took = {}
    for name, make in methods.items():
        began = time.perf_counter()
        make(text).fit(support, validation)
        took[name] = time.perf_counter() - began
    return took
