"""Statistics as column expressions: intervals, paired tests, corrections, ranks."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the standard normal distribution.
Z95 = 1.9599639845400536


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(passed: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of passed out of n, within [0, 1]; null for n = 0."""
    n, p = n.cast("double"), ratio(passed, n)
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    some = n > 0
    low, high = F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)
    return F.when(some, low), F.when(some, high)


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, for x of 64 or more, where its error is below that of doubles."""
    y = x + 1
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p of b and c discordant pairs: twice the binomial(b + c, 1/2) tail up to the smaller.

    Sums exp of log probabilities, each from the one before, so that no factorial overflows. Terms more than
    20 roots of b + c below the last one are too small for a double and left out, so a pair of models costs as
    many steps at most, however many cases there are."""
    n, m = (b + c).cast("double"), F.least(b, c).cast("long")
    first = m - F.ceil(20 * F.sqrt(n))
    first = F.when(first >= 64, first).otherwise(F.lit(0)).cast("long")
    k0 = first.cast("double")
    begin = F.when(first == 0, 0.0).otherwise(_log_factorial(n) - _log_factorial(k0) - _log_factorial(n - k0)) - n * F.log(F.lit(2.0))
    start = F.struct(begin.alias("term"), F.exp(begin).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log(n - k + 1) - F.log(k.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(m > first, F.sequence(first + 1, m)).otherwise(F.array().cast("array<bigint>"))
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step, lambda acc: acc["sum"])))


def with_holm(df: DataFrame, p: str, ties: list[str], out: str = "holm_p_value") -> DataFrame:
    """df with the Holm step-down adjusted p of all its rows: the running maximum of (n - rank + 1) * p, at most 1."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col(p).asc(), *[F.col(t).asc() for t in ties])
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("__step", step).withColumn(out, running_max(F.col("__step"), order)).drop("__step")


def running_max(value: Column, order: W) -> Column:
    return F.max(value).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))


def rank_present(value: Column, partition: list[str] | None = None, descending: bool = True) -> Column:
    """Competition rank (ties share the smallest), null where the value is null."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    window = W.partitionBy(*partition).orderBy(order) if partition else W.partitionBy(F.lit(0)).orderBy(order)
    return F.when(value.isNotNull(), F.rank().over(window))


def floor_quantile(values: Column, q: float) -> Column:
    """The element at floor(q * (n - 1)) of the sorted values of an array."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, F.greatest(F.lit(1), F.floor(q * (F.size(ordered) - 1)) + 1).cast("int"))
