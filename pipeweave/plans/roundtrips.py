"""Queries that write a whole table through an endpoint and read it back."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.operators import aggregates as A
from pipeweave.operators.rel import Rel
from pipeweave.plans.registered import Tables, dec, query
from pipeweave.sources import files, sqlite
from pipeweave.streaming import live

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _there_and_back(t: Tables, kind: str) -> DataFrame:
    path = t.folder(kind)
    files.target(Rel(t.customer), path, kind, "create")
    return files.source(t.spark, path, kind, _SCHEMA).df


@query(_CUSTOMER)
def q_io_csv(t):
    return _there_and_back(t, "csv")


@query(_CUSTOMER)
def q_io_json(t):
    return _there_and_back(t, "json")


@query(_CUSTOMER)
def q_io_jsonlines(t):
    return _there_and_back(t, "jsonlines")


@query(_CUSTOMER)
def q_io_orc(t):
    return _there_and_back(t, "orc")


@query("SELECT c_name || ' ' || c_mktsegment AS value FROM customer")
def q_io_lines(t):
    path = t.folder("lines")
    files.target(Rel(t.customer).map(value=F.concat_ws(" ", "c_name", "c_mktsegment")), path, "lines", "create")
    return files.source(t.spark, path, "lines").df


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_mktsegment")
def q_io_partitioned(t):
    path = t.folder("partitioned")
    files.target(Rel(t.customer).map("c_custkey", "c_mktsegment"), path, "parquet", "create", by=["c_mktsegment"])
    return files.source(t.spark, path, "parquet").group("c_mktsegment").map(n=A.size(), total=A.sum(F.col("c_custkey")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW'")
def q_io_transaction(t):
    path = t.folder("transaction")
    files.target(Rel(t.orders).map("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path, "parquet", "create")
    done = files.transaction(t.spark, path, lambda d: files.update(files.delete(d, F.col("o_orderpriority") == "5-LOW"), F.col("o_totalprice") > 200000, o_orderstatus=F.lit("X")))
    if not done["is_ok"]:
        raise RuntimeError(done["err"])
    return files.source(t.spark, path, "parquet").map("o_orderkey", "o_orderstatus").df


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def q_io_sqlite(t):
    path = t.folder("sqlite").removeprefix("file:")
    os.makedirs(path)
    sqlite.write(Rel(t.supplier), f"{path}/x.db", "supplier")
    return sqlite.read(t.spark, f"{path}/x.db", "supplier", 4).select("s_suppkey", "s_name", F.col("s_nationkey").cast("int"), dec(F.col("s_acctbal"), 2).alias("s_acctbal"))


@query("SELECT n_nationkey, n_name FROM nation")
def q_io_sqlite_without_rowid(t):
    path = t.folder("sqlite").removeprefix("file:")
    os.makedirs(path)
    with sqlite3.connect(f"{path}/x.db") as db:
        db.execute("create table nation (n_nationkey integer primary key, n_name text) without rowid")
        db.executemany("insert into nation values (?, ?)", [tuple(r) for r in t.nation.select("n_nationkey", "n_name").collect()])
    return sqlite.read(t.spark, f"{path}/x.db", "nation").select(F.col("n_nationkey").cast("int"), "n_name")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def q_stream_table_join(t):
    out = t.folder("joined")
    rows = live.tap(t.spark, f"{t.sf_dir}/customer.parquet*", t.customer.schema).filter("c_acctbal > 0").map("c_custkey", n_nationkey=F.col("c_nationkey"))
    live.sink_parquet(live.join_table(rows, t.nation, ["n_nationkey"]).map("c_custkey", "n_name"), f"{out}/rows", f"{out}/log").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")
