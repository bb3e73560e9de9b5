"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from testdata_paths import FIXTURE

from pipeweave.functions import text
from pipeweave.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FIXTURE):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FIXTURE}/{f}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "None" if x != x else repr(round(x, 6) + 0.0)
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return repr(float(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FIXTURE)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(cell, r)) for r in got.select(*columns).collect())
    assert rows
    if name in catalog.oracle_sql():
        want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert rows == sorted(tuple(map(cell, r)) for r in want)


def test_case_of_every_character_equals_sql(spark, duck):
    cased = [c for c in map(chr, range(0x110000)) if c != c.upper() or c != c.lower()]
    texts = [None, "", "ab", *(x for c in cased for x in (c, f"{c}ßa", f"Aa{c}"))]
    want = duck.execute("SELECT c, upper(c), lower(c), upper(c[1]) || c[2:] FROM (SELECT unnest(?::VARCHAR[]) AS c)", [texts]).fetchall()
    c = F.col("c")
    got = spark.createDataFrame([(x,) for x in texts], "c string").select("c", text.upper(c), text.lower(c), text.capitalize(c)).collect()
    assert len(want) == len(texts) > 8000 and [(w, tuple(g)) for g, w in zip(got, want, strict=True) if tuple(g) != w] == []


def test_quantiles_hold_no_group_in_a_task(spark):
    plan = catalog.queries()["q_stats_quantiles"](spark, FIXTURE)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
