"""Sort keys. A comparison of rows is a list of keys; ``then`` appends the next list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    column: Column
    ascending: bool = True

    def sorted(self) -> Column:
        """Absent values stand last in either direction."""
        return self.column.asc_nulls_last() if self.ascending else self.column.desc_nulls_last()

    def reversed(self) -> Key:
        return Key(self.column, not self.ascending)


class Comparison(tuple):
    """An ordered list of keys."""

    def then(self, other: Comparison | Key | Column | str) -> Comparison:
        return Comparison((*self, *keys(other)))


def keys(*by: Comparison | Key | Column | str) -> Comparison:
    out: list[Key] = []
    for b in by:
        if isinstance(b, Comparison):
            out += b
        elif isinstance(b, Key):
            out.append(b)
        else:
            out.append(Key(F.col(b) if isinstance(b, str) else b))
    return Comparison(out)


def ascending(column: Column | str) -> Comparison:
    return keys(column)


def descending(column: Column | str) -> Comparison:
    return Comparison(k.reversed() for k in keys(column))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: where ``a`` stands to ``b``."""
    return F.when(a < b, -1).when(a > b, 1).when(a.eqNullSafe(b), 0)
