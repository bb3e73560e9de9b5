"""Small exact cases: order, absence, empty inputs, checked arithmetic, contracts, sources, streams."""

import re
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from testdata_paths import SMALL

from pipeweave.functions import numbers, search, secrets, text, times, udf, values
from pipeweave.operators import aggregates as A
from pipeweave.operators import joins, rel
from pipeweave.operators.order import descending
from pipeweave.operators.rel import Rel, Unbounded
from pipeweave.plans import explain, flow
from pipeweave.plans.contract import Contract, email, is_domain
from pipeweave.session import spark_type
from pipeweave.sources import files, render, sqlite
from pipeweave.streaming import live


def seq(spark, xs, kind="long"):
    return Rel.of(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i long, x {kind}"), "i").map("x")


def xs(rel):
    return [r[0] for r in rel.df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_join_matrix(spark):
    a, b = seq(spark, [1, 2, 2, 3]), seq(spark, [2, 3, 3, 4])
    into = {"p": F.col("l.x"), "q": F.col("r.x")}
    pairs = lambda f: [tuple(r) for r in f(a, b, ["x"], ["x"], into=into).df.collect()]
    inner = [(2, 2), (2, 2), (3, 3), (3, 3)]
    assert pairs(joins.join) == inner
    assert pairs(joins.left_join) == [(1, None), *inner]
    assert pairs(joins.right_join) == [*inner, (None, 4)]
    assert pairs(joins.full_join) == [(1, None), *inner, (None, 4)]
    assert xs(joins.semi_join(a, b, ["x"], ["x"])) == [2, 2, 3]
    assert xs(joins.anti_join(a, b, ["x"], ["x"])) == [1]


def test_join_keys_match_absent_values(spark):
    a, b = seq(spark, [None, 1]), seq(spark, [None, 2])
    assert joins.join(a, b, ["x"], ["x"]).df.count() == 1


@pytest.mark.parametrize("head", [10_000, 3])  # by one task's head, and by positions
def test_slices_are_those_of_a_list(spark, monkeypatch, head):
    monkeypatch.setattr(rel, "HEAD", head)
    want = [4, 1, 3, 9, 7, None]  # absent values stand last
    s, set_ = Rel.of(spark.createDataFrame([(5, 7), (2, 1), (3, 3), (1, 4), (4, 9), (None, None)], "i long, x long").repartition(4), "i").map("x"), Rel(spark.range(6).repartition(3))
    for a, b in [(0, 2), (1, 5), (2, None), (-2, None), (-5, -2), (-9, -1), (-9, -8), (-2, -4), (1, -2), (-3, 5), (4, 2), (0, 0), (None, None), (0, -9)]:
        assert xs(s.slice(a, b)) == want[a:b], (a, b)
        assert xs(set_.slice(a, b)) == list(range(6))[a:b], (a, b)
    assert [xs(s.at(i)) for i in (0, 4, -1, -6, 6, -7)] == [[4], [7], [None], [4], [], []] and xs(s.reverse().slice(1, 3)) == [9, 3]
    assert xs(s.drop(4)) == [7, None] and xs(s.take(5)) == want[:5] and xs(s.take(5).drop(2)) == want[2:5] and xs(s.drop(0)) == want


def test_no_task_takes_all_rows_to_skip_some(spark):
    """A drop, a place or a slice of a large relation: the plan has no step that takes every row into one task."""
    s = Rel.of(spark.range(50_000).repartition(4), "id")
    for out in (s.drop(7), s.at(7), s.at(-1), s.slice(-5, -2), s.slice(7), s.slice(7, -7), s.slice(-20_000, -7), s.take(20_000), s.slice(7, 20_000)):
        plan = out.raw._jdf.queryExecution().executedPlan().toString()
        sizes = plan.count("Window [sum(__n")  # one row a partition
        assert plan.count("SinglePartition") == sizes and "GlobalLimit" not in plan and all(int(n) <= 10_000 for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)), plan


def test_ranks_with_a_tie(spark):
    s = Rel.of(spark.createDataFrame([("a", 9), ("b", 5), ("c", 9), ("d", 1)], "name string, score long"), "name")
    out = s.over([], [descending("score")], n=lambda w: w.row_number(), r=lambda w: w.rank(), d=lambda w: w.dense_rank())
    assert [(x.n, x.r, x.d) for x in out.df.collect()] == [(1, 1, 1), (3, 3, 2), (2, 1, 1), (4, 4, 3)]


def test_running_balance(spark):
    s = Rel.of(spark.createDataFrame([(1, 100), (2, -50), (3, 20)], "seq long, amount long"), "seq")
    assert [r.b for r in s.over([], ["seq"], b=lambda w: w.running().sum(F.col("amount"))).df.collect()] == [100, 50, 70]


def test_positions(spark):
    s = seq(spark, [3, 1, 2, 1, 5])
    assert xs(s.sort("x")) == [1, 1, 2, 3, 5]
    assert xs(s.reverse()) == [5, 1, 2, 1, 3]
    assert xs(s.distinct()) == [3, 1, 2, 5]
    assert xs(s.reverse().distinct()) == [5, 1, 2, 3]
    assert xs(s.take(2)) == [3, 1] and xs(s.drop(3)) == [1, 5]
    assert xs(s.slice(1, -1)) == [1, 2, 1] and xs(s.at(-1)) == [5] and xs(s.at(9)) == []
    assert xs(s.take_while(F.col("x") != 2)) == [3, 1] and xs(s.drop_while(F.col("x") != 2)) == [2, 1, 5]
    assert xs(s.take_while(F.col("x") > 0)) == [3, 1, 2, 1, 5] and xs(s.drop_while(F.col("x") > 0)) == []
    assert xs(s.concat(s.take(1))) == [3, 1, 2, 1, 5, 3]
    assert [r.first for r in s.enumerate().df.collect()] == [0, 1, 2, 3, 4]
    assert [r[0] for r in s.windows(4, F.col("x")).df.collect()] == [[3, 1, 2, 1], [1, 2, 1, 5]]
    assert [r[0] for r in s.collect(2, F.col("x")).df.collect()] == [[3, 1], [2, 1], [5]]
    assert xs(s.min_by("x")) == [1] and xs(s.max_by("x")) == [5] and xs(s.first()) == [3] and xs(s.last()) == [5]
    assert xs(s.take(1).one()) == [3]
    with pytest.raises(PySparkException):
        s.one().df.collect()


def test_a_set_maps_to_its_image(spark):
    s = Rel(spark.createDataFrame([(1,), (2,), (3,), (3,)], "n long")).as_set()
    image = s.filter("n > 0").map(m=F.col("n") % 2)
    assert s.raw.count() == 3 and image.unique and sorted(xs(image)) == [0, 1]
    assert seq(spark, [1, 2, 3]).map(m=F.col("x") % 2).df.count() == 3
    taken = s.take(2)
    assert not taken.unique and xs(taken) == [1, 2] and taken.map(m=F.lit(1)).raw.count() == 2
    assert s.union(Rel(spark.range(3).select(F.col("id").alias("n")))).map(m=F.col("n") * 0).raw.count() == 1


def test_split_invariance(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    for n in (1, 3, 16):
        r = Rel.of(df.repartition(n), "id")
        assert r.group("x").map(s=A.sum(F.col("id"))).orderBy("x").collect()[3].s == sum(i for i in range(1000) if i % 7 == 3)
        assert [x.first for x in r.enumerate().df.take(3)] == [0, 1, 2]
        assert xs(r.sort(descending("x")).map("id").take(2)) == [6, 13]


def test_reductions_of_nothing(spark):
    r = Rel(spark.range(0)).agg(s=A.sum(F.col("id")), a=A.average(F.col("id")), y=A.any(F.col("id") > 0), z=A.all(F.col("id") > 0), m=A.minimum(F.col("id")), q=A.quantiles(F.col("id"), 4)).first()
    assert tuple(r) == (0, None, False, True, None, [])


def test_statistics(spark):
    d = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 4, 4)], "x long")
    r = d.agg(A.median(F.col("x")), A.quantile(F.col("x"), 0.25), A.mode(F.col("x")), A.correlation(F.col("x"), F.col("x") * 2), A.correlation(F.col("x"), F.lit(1))).first()
    assert r[0] == 2.5 and r[1] == 2.0 and r[2] == 2 and abs(r[3] - 1) < 1e-12 and r[4] is None


def test_merge_all_keeps_the_last_value(spark):
    d = spark.createDataFrame([(0, {"a": 1, "b": 2}), (1, {"b": 3})], "k int, m map<string,int>")
    assert d.agg(A.merge_all(F.col("m"), F.col("k")).alias("m")).first().m == {"a": 1, "b": 3}


def test_checked_arithmetic(spark):
    assert one(spark, numbers.int_div("-7", "2")) == -3 and one(spark, numbers.rem(F.lit(-7), F.lit(2))) == -1
    assert one(spark, numbers.gcd(F.lit(84), F.lit(-36))) == 12 and one(spark, numbers.int_pow(F.lit(3), 4)) == 81
    assert one(spark, numbers.round(F.lit(2.5))) == 3.0
    for bad in (numbers.sqrt(F.lit(-1.0)), numbers.ln(F.lit(0.0)), numbers.int_div("1", "0"), numbers.int_pow(F.lit(10), 30)):
        with pytest.raises(PySparkException):
            one(spark, bad)


def scalar_cases():
    return [
        (text.trim(F.lit("  a\t")), "a"), (text.capitalize(F.lit("élan Vital")), "Élan Vital"), (text.split(F.lit("a.b.c"), "."), ["a", "b", "c"]),
        (text.replace_first(F.lit("aba"), "a", "x"), "xba"), (text.last_index_of(F.lit("abcabc"), "bc"), 4), (text.occurrences(F.lit("a.a.a"), "."), 2),
        (text.strip_suffix(F.lit("file.txt"), ".txt"), "file"), (text.trim_prefix(F.lit("abc"), "x"), "abc"), (text.lines(F.lit("a\r\nb\n")), ["a", "b"]),
        (text.words(F.lit("  ")), []), (text.pad_left(F.lit("abcd"), 3, "*"), "abcd"), (text.center(F.lit("ab"), 5, "*"), "*ab**"), (text.slice(F.lit("hello"), -3, -1), "ll"),
        (text.at(F.lit("abc"), -1), "c"), (text.at(F.lit("abc"), 5), None), (text.to_int(F.lit("1.5")), None), (text.to_bool(F.lit("yes")), None), (text.chr(F.lit(8364)), "€"),
        (text.ord(F.lit("é")), 233), (text.bytes(F.lit("é")), [195, 169]), (text.regex_replace_first(F.lit("a1b2"), "([0-9])", "<$1>"), "a<1>b2"), (text.find(F.lit("abc"), "z"), None),
        (text.encode(F.lit("a b/ü"), "percent"), "a%20b%2F%C3%BC"), (text.decode(F.lit("a%20b"), "percent"), "a b"), (text.decode(F.lit("zz"), "hex"), None),
        (times.to_date(F.lit("2026")), None), (times.fmt(F.lit("2026-03-05").cast("date"), "%d.%m.%Y"), "05.03.2026"), (times.iso_year(F.lit("2027-01-01").cast("date")), 2026),
        (times.total_millis(times.to_duration(F.lit("PT1H0.5S"))), 3600500), (times.to_duration(F.lit("PT")), None),
        (values.list_slice(F.array(*map(F.lit, [1, 2, 3, 4])), -3, -1), [2, 3]), (values.list_range(5, 0, -2), [5, 3, 1]), (values.list_at(F.array(F.lit(1)), -2), None),
        (values.merge(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))), {"a": 2}), (text.canonical(values.data(F.lit('{"b": 1, "a": 42.00}'))), '{"a":42,"b":1}'),
        (is_domain(F.lit("a.example")), True), (email(F.lit("a@b")), False), (values.result_or(values.err(F.lit("bad"), "int"), F.lit(3)), 3),
        (values.map_ok(values.ok(F.lit(2)), lambda x: x + 1).getField("ok"), 3), (numbers.uuid5(F.lit("python.org"), "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
    ]


def test_scalars(spark):
    wrong = [(str(c), one(spark, c), want) for c, want in scalar_cases() if one(spark, c) != want]
    assert not wrong


def test_time_zone_gap_and_overlap(spark):
    clock = lambda s: F.lit(s).cast("timestamp_ntz")
    shown = lambda c: one(spark, F.date_format(c, "yyyy-MM-dd HH:mm"))
    assert shown(times.in_zone(clock("2026-03-29 02:30:00"), "Europe/Berlin")) == "2026-03-29 01:30"
    assert shown(times.in_zone(clock("2026-10-25 02:30:00"), "Europe/Berlin")) == "2026-10-25 00:30"


def test_contract_routes_rows(spark):
    rows = Rel(spark.createDataFrame([(1, "5"), (2, "x"), (None, "7")], "id long, n string"))
    checked = Contract("c", {"id": "bigint", "n": "int"}).require("small", F.col("n").try_cast("int") < 6).validate(rows)
    good, bad = flow.quarantine(checked)
    assert [tuple(r.result) for r in good.df.collect()] == [(1, 5)]
    assert sorted(r.result.violations for r in bad.df.collect()) == [["id is bigint", "small"], ["n is int", "small"]]


def test_stream_refuses_whole_input_steps(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = live.tap(spark, str(tmp_path / "in"), "id long")
    for step in (lambda: s.sort("id"), lambda: s.group("id"), lambda: s.reverse(), lambda: s.agg(n=A.size()), lambda: s.over([], ["id"])):
        with pytest.raises(Unbounded, match="finite input"):
            step()
    got = []
    live.batches(s, 4, F.col("id"), lambda df, _: got.extend(len(r[0]) for r in df.collect()), str(tmp_path / "c1")).awaitTermination()
    assert got == [4, 4, 2]
    assert len(live.take(s, 3, str(tmp_path / "c2"))) == 3
    assert len(live.sample(s, 5, 1, str(tmp_path / "c3"))) == 5


def test_stream_routes_errors(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    s = live.tap(spark, str(tmp_path / "in"), "id long")
    checked = Contract("c", {"id": "bigint"}).require("even", F.col("id") % 2 == 0).validate(s)
    good, bad = [], []
    live.route(checked, "result", lambda d: good.append(d.count()), lambda d: bad.append(d.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(good) == 5 and sum(bad) == 5


def test_files_and_boundary(spark, tmp_path):
    p = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("Species Name,Total,Note\nowl,3,\nwren,x,seen\n")
    b = files.Boundary({"species": files.Mapped("Species Name"), "count": files.Mapped("Total", "int"), "note": files.Mapped("Note", absent=("missing", "null", "empty")), "more": files.Mapped()}, "open")
    rows = [tuple(r) for r in files.source(spark, p, "csv", boundary=b).map("species", "count", "note", "more").df.collect()]
    assert rows == [("owl", 3, None, None), ("wren", None, "seen", None)]
    with pytest.raises(ValueError, match="undeclared"):
        files.source(spark, p, "csv", boundary=files.Boundary({"species": files.Mapped("Species Name")}, "strict"))
    (tmp_path / "y.yaml").write_text("- a: 1\n  b: x\n- a: 2\n  b: null\n")
    assert [tuple(r) for r in files.source(spark, str(tmp_path / "y.yaml"), "yaml", "a int, b string").df.collect()] == [(1, "x"), (2, None)]
    out = str(tmp_path / "out")
    for mode, n in (("create", 5), ("append", 10), ("replace", 5)):
        files.target(Rel(spark.range(5)), out, "parquet", mode)
        assert spark.read.parquet(out).count() == n
    with pytest.raises(PySparkException):
        files.target(Rel(spark.range(5)), out, "parquet", "create")
    assert files.transaction(spark, out, lambda d: files.delete(d, F.col("id") > 2))["is_ok"]
    assert spark.read.parquet(out).count() == 3

    def refuse(d):
        raise files.Rollback("no")

    assert files.transaction(spark, out, refuse) == {"is_ok": False, "err": "no"}
    assert files.stem("a/b.c.txt") == "b.c" and files.extension("a/b") is None and files.parent("a/b") == "a"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (id integer, name text)")
        db.executemany("insert into t values (?, ?)", [(i, f"n{i}") for i in range(50)])
    got = sqlite.read(spark, path, "t", 4)
    assert got.count() == 50 and got.where("id = 7").first().name == "n7"


def test_user_operations(spark):
    import pandas as pd

    df = spark.range(10).withColumn("k", F.col("id") % 2)

    @udf.elementwise("long")
    def twice(s: pd.Series) -> pd.Series:
        return s * 2

    assert df.select(twice("id")).agg(F.sum(F.col(df.select(twice("id")).columns[0]))).first()[0] == 90
    top = udf.partition("k long, m long", "k")(lambda d: pd.DataFrame({"k": [d.k.iloc[0]], "m": [d.id.max()]}))(Rel(df))
    assert sorted(tuple(r) for r in top.df.collect()) == [(0, 8), (1, 9)]
    fail = udf.retry(lambda v: 1 // v, 2, "long")
    assert [r[0].is_ok for r in spark.range(2).select(fail("id")).collect()] == [False, True]


def test_reduction_of_large_groups(spark):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    def low(s: pd.Series) -> float:
        seen.add(int(len(s) > 10_000))
        return s.min()

    @udf.combined("double", low=low, high=pd.Series.max, n=lambda s: s.sum())
    def spread(low: float, high: float, n: float) -> float:
        return (high - low) * n

    x = F.when(F.col("id") % 7 > 0, (F.col("id") % 1000).cast("double"))
    df = spark.range(0, 60_000, 1, 2).select(F.when(F.col("id") < 50_000, "large").when(F.col("id") < 59_000, F.lit(None)).when(F.col("id") < 59_999, "small").alias("k"), (F.col("id") < 0).alias("b"), x.alias("x"))
    df = df.unionByName(spark.createDataFrame([("none", True, None)], df.schema))
    got = {(r.k, r.b): r.w for r in spread(df, ["k", "b"], "x", "w").collect()}
    want = df.groupBy("k", "b").agg(((F.max("x") - F.min("x")) * F.sum("x")).alias("w")).collect()
    assert len(got) == 4 and got == {(r.k, r.b): r.w for r in want} and got["none", True] is None
    assert spread(df, [], "x", "w").count() == 1 and spread(df.limit(0), ["k"], "x", "w").count() == 0
    assert seen.value == 0  # no piece is larger than a batch


def test_user_functions_deal_out_no_rows(spark):
    from pipeweave.plans import catalog

    plan = catalog.queries()["q_user_functions"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    widths = plan[plan.index("__low") :]
    assert "MapInArrow" in widths and re.search(r"MapInArrow", widths).start() > re.search(r"Exchange hashpartitioning", widths).start()


def test_lexical_scores_hold_a_piece_of_texts():
    import gc
    import tracemalloc

    import pyarrow as pa

    def fnv(word):
        h = search.FNV_OFFSET
        for b in word.encode("utf-8", "surrogatepass"):
            h = ((h ^ b) * search.FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        return h % search.BUCKETS

    words = ["", "a", "ß€😀", "\ud800", "x" * 3000, *(f"w{i}" for i in range(500))]
    assert search.word_buckets(words).tolist() == list(map(fnv, words)) and search.word_buckets([]).tolist() == []
    assert list(search.pieces(pa.array(["ab", "c", None, "defg", "h", ""]), 3)) == [["ab", "c", None], ["defg"], ["h", ""]]
    assert list(search.pieces(pa.array(["x", "é", "z"]).slice(1), 2)) == [["é"], ["z"]] and list(search.pieces(pa.array([], pa.string()))) == []
    one, *rest = search.bags(["ΑΣ b_b İ", "ασ b b i", None, "..."])
    assert (one == rest[0]).all() and abs(one @ one - 1) < 1e-12 and not rest[1].any() and not rest[2].any()
    tracemalloc.start()
    try:
        kept = []
        for n in range(4):  # words are not remembered from text to text
            assert sum(1 for _ in search.bags([" ".join(f"v{n}x{i}" for i in range(20_000))])) == 1
            gc.collect()
            kept.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert kept[3] - kept[0] < 500_000, kept


def test_secrets(spark):
    key = F.lit(b"0123456789abcdef")
    assert one(spark, secrets.decrypt(secrets.encrypt(F.lit("hi"), key), key)) == bytearray(b"hi")
    assert one(spark, secrets.decrypt(F.lit(b"12345678901234567890123456789012"), key)) is None
    import hashlib
    import hmac

    assert one(spark, secrets.mac(F.lit("m"), b"k")) == bytearray(hmac.digest(b"k", b"m", hashlib.sha256))
    assert secrets.verify_password("p", secrets.hash_password("p", 1 << 10))
    assert one(spark, secrets.unarmor(secrets.armor(F.lit(b"abc")))) == bytearray(b"abc")


def test_rendering(spark):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "x long, y string")
    assert render.markdown(d) == "| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    assert render.jsonlines(d, 1) == '{"x": 1, "y": "a|b"}\n'
    e = spark.createDataFrame([("a", "b")], "source string, target string")
    assert render.d2(e) == '"a" -> "b"\n' and "n0" in render.mermaid(e)


def test_plans_prune_and_push(spark):
    rows = Rel(spark.read.parquet(f"{SMALL}/lineitem.parquet")).filter(F.col("l_quantity") > 10).map("l_orderkey")
    assert "GreaterThan(l_quantity,10" in explain.pushed_filters(rows.df)[0]
    assert sorted(c.split(":")[0] for c in explain.read_columns(rows.df)[0].split(",")) == ["l_orderkey", "l_quantity"]
    shapes = [s for s, _ in explain.stages(Rel(spark.range(10)).group("id").map(n=A.size()))]
    assert "reduction" in shapes


def test_types():
    assert spark_type("Map<String, List<Int>>") == "map<string,array<bigint>>"
    assert spark_type("Result<Int, String>") == "struct<is_ok:boolean,ok:bigint,err:string>"
