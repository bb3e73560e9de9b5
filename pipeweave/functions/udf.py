"""User operations by shape: what the engine may assume of a function decides how it runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from pipeweave.operators.rel import Rel


def elementwise(kind: str) -> Callable:
    """A function over a batch of values (pandas Series in, Series out)."""
    return lambda f: F.pandas_udf(f, kind)


def reduction(kind: str) -> Callable:
    """A function of all values of a group (Series in, one value out); a group must fit a task, ``combined`` is for larger ones."""

    def wrap(f: Callable[[pd.Series], object]):
        def over(s):
            return f(s)

        over.__annotations__ = {"s": pd.Series, "return": float}
        return F.pandas_udf(over, kind, F.PandasUDFType.GROUPED_AGG)

    return wrap


def combined(kind: str, **parts: Callable[[pd.Series], object]) -> Callable:
    """A reduction of groups of any size: a function of ``parts`` by name, each a function of a Series that may be applied again
    to its own results for pieces of the group (min, max, sum). Pieces are reduced where the rows lie, only their results are dealt out.
    """

    def wrap(f: Callable[..., object]) -> Callable[[DataFrame, list[str], str, str], DataFrame]:
        def over(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
            value, held = _parse_datatype_string(kind), [f"__{n}" for n in parts]
            schema = StructType([*df.select(*by).schema.fields, *[StructField(h, value) for h in held]])
            pieces = df.select(*by, df[column].alias("__x")).mapInArrow(_pieces(by, list(parts.values()), held, to_arrow_type(value)), schema)
            merged = pieces.groupBy(*by).agg(*[reduction(kind)(part)(F.col(h)).alias(h) for h, part in zip(held, parts.values(), strict=True)])

            def whole(*columns: pd.Series) -> pd.Series:
                return pd.Series([f(**dict(zip(parts, row, strict=True))) for row in zip(*columns, strict=True)])

            return merged.select(*by, elementwise(kind)(whole)(*[F.col(h) for h in held]).alias(name))

        return over

    return wrap


def _pieces(by: list[str], parts: list[Callable], names: list[str], kind: pa.DataType) -> Callable:
    """For each batch, a row for each key in it: the key, and the parts of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for k in by:
                key = batch.column(k).dictionary_encode("encode")
                codes = np.unique(codes * len(key.dictionary) + key.indices.to_numpy(), return_inverse=True)[1]
            values = batch.column("__x").to_pandas()
            order = np.argsort(codes, kind="stable")
            firsts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            runs = [values.iloc[at] for at in np.split(order, firsts[1:])]
            keys = [batch.column(k).take(pa.array(order[firsts])) for k in by]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([part(x) for x in runs], kind, from_pandas=True) for part in parts]], names=[*by, *names])

    return run


def partition(schema: str, *by: str) -> Callable:
    """A function of one group's rows, a table in and a table out; a group must fit a task."""
    return lambda f: lambda rel: Rel(rel.raw.groupBy(*by).applyInPandas(f, schema))


def stream_of_batches(schema: str) -> Callable:
    """A function of a task's batches."""
    return lambda f: lambda rel: Rel(rel.raw.mapInPandas(f, schema))


def barrier(schema: str) -> Callable:
    """A function of the whole input in one task, for small inputs."""

    def wrap(f: Callable[[pd.DataFrame], pd.DataFrame]):
        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield f(pd.concat(list(batches), ignore_index=True))

        return lambda rel: Rel(rel.df.coalesce(1).mapInPandas(whole, schema))

    return wrap


def retry(operation: Callable[[object], object], attempts: int, kind: str, when: Callable[[Exception], bool] = lambda e: True) -> Callable[[Column], Column]:
    """Call until it succeeds, at most ``attempts`` times; the last error is the result's err. Values come in Arrow batches."""
    result = f"struct<is_ok:boolean,ok:{kind},err:string>"
    arrow = to_arrow_type(_parse_datatype_string(result))

    def one(value: object) -> dict[str, object]:
        error = None
        for _ in range(attempts):
            try:
                return {"is_ok": True, "ok": operation(value), "err": None}
            except Exception as e:  # noqa: BLE001
                error = e
                if not when(e):
                    break
        return {"is_ok": False, "ok": None, "err": str(error)}

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(v) for v in batch.to_pylist()], arrow)

    return run.asNondeterministic()


def generator(f: Callable, schema: str):
    """A table function from a Python generator class with ``eval``."""
    return F.udtf(f, returnType=schema)


def register(df: DataFrame, name: str, f) -> None:
    df.sparkSession.udf.register(name, f)
