"""Channels, configured endpoints, standard streams, growing files, HTTP sending, ordered maps, zones."""

import http.server
import io
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pipeweave.functions import times, values
from pipeweave.operators.rel import Rel
from pipeweave.plans import flow
from pipeweave.plans.contract import Contract
from pipeweave.sources import files, http as web, places
from pipeweave.streaming import live


def test_channel(spark):
    c = places.channel(spark, "rows")
    with pytest.raises(ValueError, match="nothing was sent"):
        c.read()
    c.send(Rel(spark.range(2))).send(Rel(spark.range(5, 7)))
    assert sorted(r.id for r in places.channel(spark, "rows").read().df.collect()) == [0, 1, 5, 6]
    assert places.channel(spark, "other").sent == []


def test_configured_endpoints(spark, tmp_path):
    (tmp_path / "e.toml").write_text(f'[out]\nkind = "csv"\npath = "{tmp_path}/o"\nschema = "id long"\n')
    known = places.endpoints(str(tmp_path / "e.toml"))
    places.configured_target(Rel(spark.range(4)), known, "out")
    assert places.configured(spark, known, "out").df.agg(F.sum("id")).first()[0] == 6
    with pytest.raises(KeyError, match="no endpoint"):
        places.configured(spark, known, "none")


def test_standard_streams(spark):
    assert [r.value for r in places.standard_input(spark, stream=io.StringIO("b\na\n")).df.collect()] == ["b", "a"]
    rows = places.standard_input(spark, "x int, y string", io.StringIO('{"x": 2, "y": "b"}\n{"x": 1}\n'))
    assert [tuple(r) for r in rows.df.collect()] == [(2, "b"), (1, None)]
    out = io.StringIO()
    places.standard_output(rows, "jsonlines", stream=out)
    assert out.getvalue() == '{"x": 2, "y": "b"}\n{"x": 1, "y": null}\n'
    assert places.table(rows) == "x  y\n2  b\n1\n" and places.table(rows, ["y"]) == "y\nb\n\n"


def test_tail(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("old\n")
    got = []
    query = live.sink(places.tail(spark, str(path), end=False), lambda d, _: got.extend(r.value for r in d.collect()), str(tmp_path / "c1"), once=False)
    with path.open("a") as f:
        f.write("new\nhalf")
        f.flush()
        for _ in range(100):
            query.processAllAvailable()
            if "new" in got:
                break
        f.write(" line\n")
        f.flush()
        query.processAllAvailable()
        query.processAllAvailable()
    query.stop()
    assert got == ["old", "new", "half line"]


def test_rows_are_sent(spark):
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(201 if b"1" in seen[-1] else 400)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.range(3).select(F.lit(f"http://127.0.0.1:{server.server_port}/").alias("to"), F.concat(F.lit("n"), "id").alias("text"))
    out = web.send_all(rows, "to", "text").collect()
    server.shutdown()
    assert sorted(seen) == [b"n0", b"n1", b"n2"] and sorted(r.status for r in out) == [201, 400, 400]


def test_ordered_map_and_zones(spark):
    m = values.ordered_map(F.array(F.lit("b"), F.lit("a")), F.array(F.lit(1), F.lit(2)))
    row = spark.range(1).select(m.alias("m"), values.ordered_get(m, "a").alias("a"), values.ordered_get(m, "z").alias("z"), times.local_zone().alias("l")).first()
    assert [tuple(e) for e in row.m] == [("b", 1), ("a", 2)] and (row.a, row.z, row.l) == (2, None, "UTC")
    with pytest.raises(PySparkException):
        spark.range(1).select(values.ordered_map(F.array(F.lit("b"), F.lit("b")), F.array(F.lit(1), F.lit(2)))).collect()
    assert times.zone("Europe/Berlin") == "Europe/Berlin"
    with pytest.raises(ValueError):
        times.zone("Nowhere/City")


def test_entries_and_diagnostics(spark, tmp_path):
    (tmp_path / "f").write_text("abc")
    e = places.entry(spark, str(tmp_path / "f"))
    assert (e["length"], e["is_folder"]) == (3, False) and places.entry(spark, str(tmp_path / "none")) is None
    checked = Contract("c", {"id": "bigint"}).require("small", F.col("id") < 2).validate(Rel(spark.range(5)))
    _, bad = flow.quarantine(checked)
    text = places.diagnostic(bad.df.select("result.*"), 2)
    assert text.startswith('c: small\n  {"id": ') and text.endswith("and 1 more\n")
    assert files.argument(99) is None and "PATH" in files.variables() and files.working_dir() and files.source_dir(__file__).endswith("tests")
