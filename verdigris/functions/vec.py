"""Vector arithmetic as Columns (arrays of numbers, sums in double precision) and as aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least norm that a vector is divided by.
TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0e0), lambda s, v: s + v)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what a lambda names from outside is worked out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(v: Column) -> Column:
    """v over its Euclidean norm, the norm TINY at least."""
    return once(v, lambda w: once(1 / F.greatest(F.sqrt(dot(w, w)), F.lit(TINY)), lambda by: scaled(w, by)))


def plus(a: Column, b: Column, times: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + F.lit(times) * y.cast("double"))


def rooted(v: Column) -> Column:
    """Square roots of a non-negative vector's shares of its sum."""
    return once(v, lambda w: once(total(w), lambda t: F.transform(w, lambda x: F.sqrt(x.cast("double") / t))))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0e0), lambda s, x: s + x.cast("double"))


def mean_of(views: Column) -> Column:
    """The mean of an array of vectors, component by component."""
    n = F.size(views)
    sums = F.aggregate(F.slice(views, 2, n), F.transform(F.element_at(views, 1), lambda x: x.cast("double")), lambda s, v: plus(s, v))
    return F.transform(sums, lambda x: x / n)


def mean_vector(df: DataFrame, keys: list[str], vector: str, dim: int, name: str = "mean") -> DataFrame:
    """The mean vector of each group: one aggregate with partial sums before the shuffle, no explode."""
    parts = [F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(dim)]
    return df.groupBy(*keys).agg(*parts).select(*keys, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias(name))


def sign_bits(v: Column, start: int, n: int = 32) -> Column:
    """Bits of the signs of n components from start: bit i is set where component start + i is positive."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("bigint"), lambda s, i: s + F.when(F.get(v, i + start) > 0, F.pow(F.lit(2e0), i.cast("double")).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def hamming(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """Differing bits of two 64-bit hashes given as halves of 32 bits."""
    return F.bit_count(high_a.bitwiseXOR(high_b)) + F.bit_count(low_a.bitwiseXOR(low_b))


def hex_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hexadecimal digits."""
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return hamming(half(a, 1), half(a, 9), half(b, 1), half(b, 9))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("int"))
