"""The list of queries: each a function of the given tables, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.operators.rel import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        """A new folder that all executors share."""
        return f"{scratch(self.spark)}/pipeweave-{name}-{uuid.uuid4().hex[:12]}"


def query(sql: str | None = None):
    """Register a query of the tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def dec(c, digits: int = 4):
    return F.round(c, digits)
