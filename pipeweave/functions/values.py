"""Options, results, lists, maps and open values as Columns.

An option is a column that may be absent (null); equality looks through it. A result is a struct
``is_ok, ok, err``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# options


def is_some(c: Column) -> Column:
    return c.isNotNull()


def is_none(c: Column) -> Column:
    return c.isNull()


def unwrap_or(c: Column, default: Column) -> Column:
    return F.coalesce(c, default)


unwrap_or_else = or_else = alternative = unwrap_or


def and_then(c: Column, by: Fn) -> Column:
    return F.when(c.isNotNull(), by(c))


def keep(c: Column, by: Fn) -> Column:
    """The value if the predicate holds, else absent."""
    return F.when(by(c), c)


# results


def ok(value: Column, err_type: str = "string") -> Column:
    return F.struct(F.lit(True).alias("is_ok"), value.alias("ok"), F.lit(None).cast(err_type).alias("err"))


def err(value: Column, ok_type: str = "string") -> Column:
    return F.struct(F.lit(False).alias("is_ok"), F.lit(None).cast(ok_type).alias("ok"), value.alias("err"))


def result(holds: Column, value: Column, error: Column) -> Column:
    return F.struct(holds.alias("is_ok"), F.when(holds, value).alias("ok"), F.when(~holds, error).alias("err"))


def is_ok(r: Column) -> Column:
    return r.getField("is_ok")


def is_err(r: Column) -> Column:
    return ~r.getField("is_ok")


def ok_of(r: Column) -> Column:
    return F.when(is_ok(r), r.getField("ok"))


def err_of(r: Column) -> Column:
    return F.when(is_err(r), r.getField("err"))


def result_or(r: Column, default: Column) -> Column:
    return F.when(is_ok(r), r.getField("ok")).otherwise(default)


def result_or_else(r: Column, by: Fn) -> Column:
    return F.when(is_ok(r), r.getField("ok")).otherwise(by(r.getField("err")))


def map_ok(r: Column, by: Fn) -> Column:
    return F.struct(is_ok(r).alias("is_ok"), F.when(is_ok(r), by(r.getField("ok"))).alias("ok"), r.getField("err").alias("err"))


def map_err(r: Column, by: Fn) -> Column:
    return F.struct(is_ok(r).alias("is_ok"), r.getField("ok").alias("ok"), F.when(is_err(r), by(r.getField("err"))).alias("err"))


def result_and_then(r: Column, by: Fn) -> Column:
    """``by`` gives a result; its error type is this one's."""
    return F.when(is_ok(r), by(r.getField("ok"))).otherwise(F.struct(F.lit(False).alias("is_ok"), by(r.getField("ok")).getField("ok").alias("ok"), r.getField("err").alias("err")))


def result_or_result(r: Column, by: Fn) -> Column:
    return F.when(is_ok(r), r).otherwise(by(r.getField("err")))


# lists


def list_at(xs: Column, i: int) -> Column:
    return F.get(xs, F.lit(i)) if i >= 0 else F.get(xs, F.size(xs) + i)


def list_slice(xs: Column, start: int = 0, end: int | None = None) -> Column:
    n = F.size(xs)
    a = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    b = n if end is None else n + end if end < 0 else F.least(F.lit(end), n)
    return F.slice(xs, a + 1, F.greatest(F.lit(0), b - a))


def list_zip(xs: Column, ys: Column) -> Column:
    """Pairs up to the shorter list."""
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(1), n), lambda x, y: F.struct(x.alias("first"), y.alias("second")))


def list_enumerate(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(i.cast("bigint").alias("first"), x.alias("second")))


def list_distinct(xs: Column) -> Column:
    return F.array_distinct(xs)


def list_range(start: int, end: int, step: int = 1) -> Column:
    """start, start + step, ... before end."""
    items = range(start, end, step)
    return F.sequence(F.lit(items[0]), F.lit(items[-1]), F.lit(step)).cast("array<bigint>") if len(items) else F.array().cast("array<bigint>")


def list_windows(xs: Column, n: int) -> Column:
    last = F.size(xs) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(xs, i + 1, F.lit(n)))).otherwise(F.slice(F.array(xs), 1, 0))


def list_fold(xs: Column, initial: Column, by: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(xs, initial, by)


# maps


def map_of(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def ordered_map(keys: Column, values: Column) -> Column:
    """Entries in order of construction, as a list, since a map promises none; a key that comes again is an error."""
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    pairs = F.transform(pairs, lambda e: F.struct(e.getField("key").alias("key"), e.getField("value").alias("value")))
    return F.when(repeated, F.raise_error(F.lit("a key comes twice"))).otherwise(pairs)


def ordered_get(m: Column, key: object) -> Column:
    return F.get(F.filter(m, lambda e: e.getField("key") == F.lit(key)), F.lit(0)).getField("value")


def sorted_map(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def get(m: Column, key: object) -> Column:
    return F.try_element_at(m, F.lit(key))


def with_key(m: Column, key: object, value: Column) -> Column:
    return F.map_concat(without(m, key), F.create_map(F.lit(key), value))


def without(m: Column, key: object) -> Column:
    return F.map_filter(m, lambda k, _: k != F.lit(key))


def entries(m: Column) -> Column:
    return F.map_entries(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def merge(a: Column, b: Column) -> Column:
    """The later map wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def same_map(a: Column, b: Column) -> Column:
    return sorted_map(a).eqNullSafe(sorted_map(b))


# open values


def data(text: Column) -> Column:
    """JSON text as an open value; bad text is absent."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str) -> Column:
    """A leaf by dotted path, read as a type; absent where it is missing or of another type."""
    return F.try_variant_get(value, f"$.{path}", kind)


def is_type(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value) == kind.upper()


def match(*cases: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The first case whose condition holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def given(value: Column, condition: Column, otherwise: Column | None = None) -> Column:
    return match((condition, value), otherwise=otherwise)


def least(*columns: Column) -> Column:
    return F.least(*columns)


def greatest(*columns: Column) -> Column:
    return F.greatest(*columns)
