"""``over``: a row's place in its ordered partition. Results keep the input's order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from pipeweave.operators.order import Key, keys
from pipeweave.operators.rel import Rel


class Frame:
    """Rows around the current one; reductions over them are Columns."""

    def __init__(self, spec: WindowSpec):
        self.spec = spec

    def agg(self, reduction: Column) -> Column:
        return reduction.over(self.spec)

    def size(self) -> Column:
        return F.count(F.lit(1)).over(self.spec)

    def sum(self, c: Column) -> Column:
        return F.coalesce(F.sum(c).over(self.spec), F.lit(0))

    def average(self, c: Column) -> Column:
        return F.avg(c).over(self.spec)

    def min(self, c: Column) -> Column:
        return F.min(c).over(self.spec)

    def max(self, c: Column) -> Column:
        return F.max(c).over(self.spec)

    def items(self, c: Column) -> Column:
        return F.collect_list(c).over(self.spec)


class Place:
    """What ``into`` sees: ranks, neighbours and frames. Ranks see the order keys only; ties elsewhere fall to the input's order."""

    def __init__(self, by: Sequence[Column], order: Sequence[Key], tie: Sequence[Key]):
        base = Window.partitionBy(*by)
        self._ranks = base.orderBy(*[k.sorted() for k in order]) if order else base
        self._rows = base.orderBy(*[k.sorted() for k in [*order, *tie]]) if order or tie else base

    def row_number(self) -> Column:
        return F.row_number().over(self._rows)

    def rank(self) -> Column:
        return F.rank().over(self._ranks)

    def dense_rank(self) -> Column:
        return F.dense_rank().over(self._ranks)

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self._rows)

    def lead(self, c: Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self._rows)

    def first(self, c: Column) -> Column:
        return F.first(c).over(self._rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def last(self, c: Column) -> Column:
        return F.last(c).over(self._rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def size(self) -> Column:
        return self.whole().size()

    def running(self) -> Frame:
        return Frame(self._rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def rows(self, before: int, after: int) -> Frame:
        return Frame(self._rows.rowsBetween(-before, after))

    def whole(self) -> Frame:
        return Frame(self._rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def over(rel: Rel, by: Sequence[str | Column], order: Sequence, into: Callable[[Place], dict[str, Column]] | None, named: dict[str, Callable[[Place], Column]]) -> Rel:
    """Add the columns that ``into`` (or each named function) makes of a row's place."""
    place = Place([F.col(b) if isinstance(b, str) else b for b in by], keys(*order), rel.order)
    columns = dict(into(place)) if into else {}
    return rel.extend(**columns | {n: f(place) for n, f in named.items()})
