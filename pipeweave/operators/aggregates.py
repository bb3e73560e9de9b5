"""Reductions as Columns, with the values of the empty input: sums 0, products 1, the rest absent.

All but the ordered folds combine partial results, so they work on either side of a shuffle.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def size() -> Column:
    return F.count(F.lit(1))


def count(column: Column | None = None, value: object = None) -> Column:
    return F.count(F.lit(1)) if column is None else F.count_if(column.eqNullSafe(F.lit(value)))


def contains(column: Column, value: object) -> Column:
    return F.coalesce(F.bool_or(column.eqNullSafe(F.lit(value))), F.lit(False))


def sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def product(column: Column, exact: bool = False) -> Column:
    """Floats by the built-in; ``exact`` multiplies integers with an overflow error.

    Only factors other than 0, 1 and -1 are gathered, and more than 62 of these overflow unless another factor is 0.
    """
    if exact:
        x = column.cast("bigint")
        factors = F.collect_list(F.when(F.abs(x) > 1, x))
        sign = F.when(F.count_if(x == -1) % 2 == 1, F.lit(-1).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
        return F.when(F.count_if(x == 0) > 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(factors, sign, lambda a, f: a * f))
    return F.coalesce(F.product(column), F.lit(1.0))


def average(column: Column) -> Column:
    return F.avg(column)


def minimum(column: Column) -> Column:
    return F.min(column)


def maximum(column: Column) -> Column:
    return F.max(column)


def variance(column: Column) -> Column:
    """Of the whole population."""
    return F.var_pop(column)


def any(by: Column) -> Column:
    return F.coalesce(F.bool_or(by), F.lit(False))


def all(by: Column) -> Column:
    return F.coalesce(F.bool_and(by), F.lit(True))


def is_empty() -> Column:
    return F.count(F.lit(1)) == 0


def min_by(value: Column, key: Column, tie: Column) -> Column:
    """First of equals by ``tie``."""
    return F.min_by(value, F.struct(key, tie))


def max_by(value: Column, key: Column, tie: Column) -> Column:
    """First of equals by ``tie``, a number."""
    return F.max_by(value, F.struct(key, -tie))


def bucket(column: Column, width: float | int) -> Column:
    if isinstance(width, int):
        return column - F.pmod(column, F.lit(width))
    return F.floor(column / width) * F.lit(width)


def approx_distinct(column: Column) -> Column:
    """HyperLogLog with 4096 registers (standard error about 1.6 %)."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(12)))


def items(*columns: str | Column, order: Column) -> Column:
    """The group's rows as a list in order; for groups known to be small."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("__k"), F.struct(*columns).alias("x")))), lambda r: r.x)


def ordered_sum(column: Column, order: Column) -> Column:
    """The sum in order, equal to the last bit wherever rows lie; for groups known to be small."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("k"), column.alias("x"))))
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + r.x)


def concat_all(column: Column, order: Column) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), column.alias("x")))), lambda r: r.x))


def union_all(column: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def merge_all(column: Column, order: Column) -> Column:
    """Maps in order, the last value of a key wins."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("k"), F.map_entries(column).alias("x"))))
    entries = F.flatten(F.transform(rows, lambda r: r.x))
    names = F.array_distinct(F.transform(entries, lambda e: e.key))
    return F.map_from_entries(F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e.key == k), -1)))


def count_map(counts: Column, name: Column) -> Column:
    """A map from rows of (name, count)."""
    return F.map_from_entries(F.collect_list(F.struct(name, counts)))


# statistics


def mean(column: Column) -> Column:
    return F.avg(column)


def sample_variance(column: Column) -> Column:
    return F.var_samp(column)


def stdev(column: Column) -> Column:
    return F.stddev_samp(column)


def pvariance(column: Column) -> Column:
    return F.var_pop(column)


def pstdev(column: Column) -> Column:
    return F.stddev_pop(column)


def covariance(x: Column, y: Column) -> Column:
    return F.covar_samp(x, y)


def correlation(x: Column, y: Column) -> Column:
    """Absent where a side does not vary."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(flat, F.lit(None).cast("double")).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def median(column: Column) -> Column:
    return F.median(column)


def quantile(column: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(column, F.lit(q))


def quantiles(column: Column, n: int) -> Column:
    """The n-1 cut points of n equal parts."""
    return F.coalesce(F.percentile(column, F.array(*[F.lit(i / n) for i in range(1, n)])), F.array().cast("array<double>")) if n > 1 else F.array().cast("array<double>")


def mode(column: Column) -> Column:
    """The most frequent value, the least of equals."""
    return F.mode(column, True)


# named combiners: how a reduction by one runs, and how its result joins an initial value

COMBINERS = {
    "add": (lambda x: F.sum(x), lambda a, b: a + b),
    "mul": (lambda x: product(x), lambda a, b: a * b),
    "min": (lambda x: F.min(x), F.least),
    "max": (lambda x: F.max(x), F.greatest),
    "and": (lambda x: F.bool_and(x), lambda a, b: a & b),
    "or": (lambda x: F.bool_or(x), lambda a, b: a | b),
    "union": (lambda x: union_all(x), lambda a, b: F.array_sort(F.array_union(a, b))),
}
_OPERATORS = {operator.add: "add", operator.mul: "mul", operator.and_: "and", operator.or_: "or", F.least: "min", F.greatest: "max", F.array_union: "union"}


def combiner(by: object) -> tuple | None:
    """The aggregate that a name or operator stands for; None for any other function."""
    if isinstance(by, str):
        return COMBINERS[by]
    name = _OPERATORS.get(by)
    return COMBINERS[name] if name else None
