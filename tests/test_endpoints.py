"""One evaluation for all branches, named combiners, streams that stop, documents, tables and transactions."""

import json
import sqlite3
import threading

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pipeweave.functions import udf
from pipeweave.operators import aggregates as A
from pipeweave.operators.rel import Rel
from pipeweave.plans import flow
from pipeweave.sources import files, sqlite
from pipeweave.streaming import live


def counted(spark, df):
    """``df`` with a count of how many of its rows are evaluated."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def note(x):
        seen.add(1)
        return x

    return df.withColumn("x", note.asNondeterministic()("id")), seen


def test_fork_and_tee_evaluate_the_input_once(spark):
    df, seen = counted(spark, spark.range(100))
    with flow.fork(Rel(df), low=lambda r: r.filter("x < 50"), high=lambda r: r.filter("x >= 50").agg(n=A.size())) as found:
        assert found["low"].df.count() == 50 and found["high"].first().n == 50
    assert seen.value == 100
    df, seen = counted(spark, spark.range(100))
    main, side = flow.tee(Rel(df), lambda r: r.agg(s=A.sum(F.col("x"))))
    assert main.df.where("x >= 0").count() == 100 and side.first().s == 4950 and seen.value == 100
    main.raw.unpersist()
    df, seen = counted(spark, spark.range(100))
    found = flow.fork(Rel(df), hold=False, a=lambda r: r.filter("x < 50"), b=lambda r: r.filter("x < 50"))
    assert found["a"].df.count() + found["b"].df.count() == 100 and seen.value == 200


def test_named_combiners_are_aggregates(spark):
    r = Rel.of(spark.createDataFrame([(1, [1]), (2, [2, 1]), (3, [3])], "id long, xs array<int>"), "id")
    one = lambda by, initial=None, item="id": r.reduce(F.col(item), initial, by).first().reduced
    assert (one("add"), one("min"), one("max"), one("mul")) == (6, 1, 3, 6.0)
    assert one("add", F.lit(10).cast("long")) == 16 and one(F.least, F.lit(0).cast("long")) == 0 and one("union", None, "xs") == [1, 2, 3]
    plan = r.reduce(F.col("id"), None, "add")._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert "collect_list" in r.reduce(F.col("id"), None, lambda a, x: a + x)._jdf.queryExecution().toString()
    nothing = Rel.of(spark.range(0), "id")
    assert nothing.reduce(F.col("id"), None, "add").first().reduced is None and nothing.reduce(F.col("id"), F.lit(4).cast("long"), "add").first().reduced == 4
    with pytest.raises(KeyError):
        r.reduce(F.col("id"), None, "divide")


def test_exact_product(spark):
    p = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long").agg(A.product(F.col("x"), exact=True)).first()[0]
    assert p(3, -1, 5, 1, -1, -1) == -15 and p(*[2] * 62) == 1 << 62 and p(*[10] * 40, 0) == 0 and p(-1) == -1
    with pytest.raises(PySparkException):
        p(*[2] * 63)


def test_take_stops_the_stream(spark, tmp_path):
    for i in range(6):
        spark.range(i * 2, i * 2 + 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.tap(spark, str(tmp_path / "in"), "id long", files=1)
    log = tmp_path / "log"
    assert len(live.take(s, 3, str(log))) == 3
    assert len([x for x in (log / "offsets").iterdir() if x.name.isdigit()]) <= 4
    assert len(live.take(s, 100, str(tmp_path / "log2"))) == 12 and live.take(s, 0, str(tmp_path / "log3")) == []


def test_take_from_a_stream_without_end(spark, tmp_path):
    endless = Rel(spark.readStream.format("rate").option("rowsPerSecond", 200).load())
    got: list = []
    run = threading.Thread(target=lambda: got.extend(live.take(endless, 5, str(tmp_path / "log"), wait=True)))
    run.start()
    run.join(60)
    assert not run.is_alive() and len(got) == 5


def test_batches_come_in_order_of_arrival(spark, tmp_path):
    spark.createDataFrame([(9,), (2,), (7,), (1,), (5,)], "x long").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    live.batches(live.tap(spark, str(tmp_path / "in"), "x long"), 2, F.col("x"), lambda d, _: got.extend(r[0] for r in d.collect()), str(tmp_path / "c")).awaitTermination()
    assert got == [[9, 2], [7, 1], [5]]


def test_stream_beside_a_table(spark, tmp_path):
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    s = live.tap(spark, str(tmp_path / "in"), "id long")
    live.sink_parquet(live.join_table(s, names, ["id"], "left"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {r.id: r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: None, 1: "one", 2: "two", 3: None, 4: None, 5: None}
    with pytest.raises(ValueError, match="optional side"):
        live.join_table(s, names, ["id"], "right")


def test_json_is_one_document(spark, tmp_path):
    for n in (0, 1, 2500):
        path = str(tmp_path / f"j{n}")
        files.target(Rel(spark.range(n).withColumn("y", F.when(F.col("id") > 0, F.lit("a\n\"b")))), path, "json")
        found = [json.loads(f.read_text()) for f in (tmp_path / f"j{n}").glob("part-*")]
        assert found == [[{"id": i, "y": 'a\n"b' if i else None} for i in range(n)]]
        if n:
            assert files.source(spark, path, "json", "id long, y string").df.count() == n


def test_sqlite_there_and_back(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.range(1200).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 2).alias("half"), F.lit(None).cast("string").alias("none"))
    assert sqlite.write(Rel.of(df, "id"), path, "t t") == 1200
    assert sqlite.write(Rel(df.limit(3)), path, "t t", "append") == 3
    back = sqlite.read(spark, path, "t t", 3)
    assert back.count() == 1203 and back.where("id = 7").first().half == 3.5 and back.where("none is null").count() == 1203
    with pytest.raises(sqlite3.OperationalError):
        sqlite.write(Rel(df), path, "t t", "create")
    with pytest.raises((PySparkException, Py4JJavaError)):  # a failure half-way leaves the table as it was
        sqlite.write(Rel(df.withColumn("id", F.assert_true(F.col("id") < 700).cast("string"))), path, "t t")
    assert sqlite.read(spark, path, "t t").count() == 1203


def test_transaction_sees_other_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    turns = []

    def change(d):
        turns.append(1)
        if len(turns) == 1:  # another writer adds rows between the read and the swap
            spark.range(10, 12).write.mode("append").parquet(path)
        return d.withColumn("id", F.col("id") + 100)

    assert files.transaction(spark, path, change) == {"is_ok": True, "err": None}
    assert len(turns) == 2 and sorted(r.id for r in spark.read.parquet(path).collect()) == [100, 101, 102, 103, 110, 111]

    def always(d):
        spark.range(1).write.mode("append").parquet(path)
        return d

    out = files.transaction(spark, path, always, attempts=2)
    assert not out["is_ok"] and "changed" in out["err"] and spark.read.parquet(path).count() == 8
    (tmp_path / "t.lock").write_text("")
    assert "lock" in files.transaction(spark, path, lambda d: d, attempts=1)["err"]
    (tmp_path / "t.lock").unlink()
    assert "boom" in files.transaction(spark, path, lambda d: d.where(F.raise_error(F.lit("boom")).isNull()), attempts=1)["err"]
    assert spark.read.parquet(path).count() == 8 and sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["t"]


def test_failed_swap_puts_the_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    real = files._state

    def gone(disk, here):  # what was staged vanishes just before the swap
        out = real(disk, here)
        if (tmp_path / "t.lock").exists():
            for x in tmp_path.glob("t.staged-*"):
                disk.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(x)), True)
        return out

    monkeypatch.setattr(files, "_state", gone)
    assert not files.transaction(spark, path, lambda d: d.where("id > 1"), attempts=1)["is_ok"]
    assert spark.read.parquet(path).count() == 4


def test_catalog_table(spark, tmp_path):
    files.table_target(Rel(spark.range(5)), "kept_rows")
    files.table_target(Rel(spark.range(2)), "kept_rows", "append")
    assert files.table(spark, "kept_rows").df.count() == 7
    spark.sql("drop table kept_rows")


def test_retry_runs_by_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def whole(v):
        calls.add(1)
        if v % 2:
            raise ValueError(f"odd {v}")
        return [v]

    r = udf.retry(whole, 3, "array<bigint>")(F.col("id"))
    out = spark.range(4).select("id", r.alias("r")).collect()
    assert [(x.r.is_ok, x.r.ok, x.r.err) for x in out] == [(True, [0], None), (False, None, "odd 1"), (True, [2], None), (False, None, "odd 3")]
    assert calls.value == 2 + 2 * 3
