"""Results as text: per-row encoders are Columns, whole-result renderers stream rows to the driver."""

from __future__ import annotations

import json as _json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def csv(*columns: str) -> Column:
    return F.to_csv(F.struct(*columns))


def lines(column: str) -> Column:
    return F.col(column).cast("string")


def _rows(df: DataFrame, limit: int) -> Iterator:
    rows = df.toLocalIterator()
    return islice(rows, limit) if limit else rows


def jsonlines(df: DataFrame, limit: int = 0) -> str:
    return "".join(_json.dumps(r.asDict(True), default=str, ensure_ascii=False) + "\n" for r in _rows(df, limit))


def yaml(df: DataFrame, limit: int = 0) -> str:
    out = []
    for r in _rows(df, limit):
        for i, (k, v) in enumerate(r.asDict(True).items()):
            out.append(f"{'  ' if i else '- '}{k}: {_json.dumps(v, default=str, ensure_ascii=False)}\n")
    return "".join(out)


def markdown(df: DataFrame, limit: int = 0) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(map(cell, r))} |\n" for r in _rows(df, limit))


def text(df: DataFrame, limit: int = 0) -> str:
    return "".join("\t".join("none" if v is None else str(v) for v in r) + "\n" for r in _rows(df, limit))


def mermaid(edges: DataFrame, limit: int = 0) -> str:
    names: dict[str, str] = {}
    node = lambda n: names.setdefault(str(n), f"n{len(names)}")
    body = "".join(f'  {node(r["source"])}["{r["source"]}"] --> {node(r["target"])}["{r["target"]}"]\n' for r in _rows(edges, limit))
    return "graph LR\n" + body


def d2(edges: DataFrame, limit: int = 0) -> str:
    return "".join(f'"{r["source"]}" -> "{r["target"]}"\n' for r in _rows(edges, limit))
