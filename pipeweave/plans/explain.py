"""A plan by stages: what runs together, and where rows are dealt anew."""

from __future__ import annotations

import re
from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import DataFrame

#: Physical operators by the shape they have.
SHAPES = {
    "partition": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin",
    "broadcast": r"BroadcastExchange",
    "reduction": r"HashAggregate|ObjectHashAggregate|SortAggregate",
    "barrier": r"Exchange SinglePartition|TakeOrderedAndProject|CollectLimit|GlobalLimit",
    "ordered": r"Window\b|SortMergeJoin|\bSort\b",
    "python": r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups",
    "scan": r"Scan \w+|FileScan",
}


def text(df: DataFrame, mode: str = "formatted") -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def stages(df: DataFrame) -> list[tuple[str, str]]:
    """(shape, operator) for each line of the physical plan that has a shape, from the top."""
    found = []
    for line in text(df, "simple").splitlines():
        for shape, pattern in SHAPES.items():
            if m := re.search(pattern, line):
                found.append((shape, m[0]))
                break
    return found


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", text(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", text(df))
