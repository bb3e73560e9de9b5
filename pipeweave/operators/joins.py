"""The seven joins. Keys match null-safely; the result is in (left, right) order, unmatched rows last."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.operators.order import Key
from pipeweave.operators.rel import HIDDEN, Rel

On = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _sides(left: Rel, right: Rel) -> tuple[DataFrame, DataFrame, list[Key]]:
    a = left.raw.select(F.struct(*left.columns).alias("l"), *[k.column.alias(f"{HIDDEN}l{i}") for i, k in enumerate(left.order)])
    b = right.raw.select(F.struct(*right.columns).alias("r"), *[k.column.alias(f"{HIDDEN}r{i}") for i, k in enumerate(right.order)])
    order = [Key(F.col(f"{HIDDEN}l{i}"), k.ascending) for i, k in enumerate(left.order)] + [Key(F.col(f"{HIDDEN}r{i}"), k.ascending) for i, k in enumerate(right.order)]
    return a, b, order


def _condition(left_on: Sequence[str], right_on: Sequence[str], on: On | None) -> Column:
    out: Column | None = None
    for x, y in zip(left_on, right_on, strict=True):
        same = F.col(f"l.{x}").eqNullSafe(F.col(f"r.{y}"))
        out = same if out is None else out & same
    if on is not None:
        more = on(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))
        out = more if out is None else out & more
    if out is None:
        raise TypeError("a join needs keys or a condition; see cross_join")
    return out


def _join(how: str, left: Rel, right: Rel, left_on, right_on, on, into) -> Rel:
    left.finite(f"{how} join")
    right.finite(f"{how} join")
    a, b, order = _sides(left, right)
    out = a.join(b, _condition(left_on, right_on, on), how)
    shown = into if into is not None else {"l": F.col("l"), "r": F.col("r")}
    return Rel(out, order).map(**shown)


def join(left: Rel, right: Rel, left_on: Sequence[str] = (), right_on: Sequence[str] = (), on: On | None = None, into: dict[str, Column] | None = None) -> Rel:
    """Pairs that match. ``into`` names result columns over ``l.x`` and ``r.y``."""
    return _join("inner", left, right, left_on, right_on, on, into)


def left_join(left: Rel, right: Rel, left_on=(), right_on=(), on=None, into=None) -> Rel:
    return _join("left", left, right, left_on, right_on, on, into)


def right_join(left: Rel, right: Rel, left_on=(), right_on=(), on=None, into=None) -> Rel:
    return _join("right", left, right, left_on, right_on, on, into)


def full_join(left: Rel, right: Rel, left_on=(), right_on=(), on=None, into=None) -> Rel:
    return _join("full", left, right, left_on, right_on, on, into)


def cross_join(left: Rel, right: Rel, into=None) -> Rel:
    """Every pair, for the step of that name."""
    a, b, order = _sides(left, right)
    return Rel(a.crossJoin(b), order).map(**(into or {"l": F.col("l"), "r": F.col("r")}))


def _half(how: str, left: Rel, right: Rel, left_on, right_on, on) -> Rel:
    left.finite(f"{how} join")
    a = left.raw.withColumn("l", F.struct(*left.columns))
    b = right.raw.select(F.struct(*right.columns).alias("r"))
    return Rel(a.join(b, _condition(left_on, right_on, on), how).drop("l"), left.order)


def semi_join(left: Rel, right: Rel, left_on=(), right_on=(), on=None) -> Rel:
    return _half("left_semi", left, right, left_on, right_on, on)


def anti_join(left: Rel, right: Rel, left_on=(), right_on=(), on=None) -> Rel:
    return _half("left_anti", left, right, left_on, right_on, on)
