"""Vaults of documents, HTTP sources, logs, passphrases and merged streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from pipeweave.functions import graph, secrets
from pipeweave.plans.logs import Logger, to_file
from pipeweave.sources import http, vault
from pipeweave.streaming import live


def test_vault(spark, tmp_path):
    root = tmp_path / "my vault"
    (root / "b c").mkdir(parents=True)
    (root / "a.md").write_text('---\ntitle: "The A"\nkind: x: y\nkind: z\n---\n# Other\nsee [[b]], [[b|shown]], [[d#part]] and [[none]]\n')
    (root / "b c" / "b.md").write_text("intro\n\n## The B ##\n[[b c/d]] [[a.md]]\n")
    (root / "b c" / "d.hmd").write_text("---\n---\nno heading\n")
    (root / "d.md").write_text("\n")
    (root / "skip.txt").write_text("[[a]]")
    found = vault.cards(spark, str(root))
    rows = found.df.collect()
    assert [r.path for r in rows] == ["a.md", "b c/b.md", "b c/d.hmd", "d.md"]
    assert [r.title for r in rows] == ["The A", "The B", "d", "d"]
    assert rows[0].header == {"title": "The A", "kind": "x: y"} and rows[0].body.startswith("# Other")
    assert (rows[2].format, rows[2].body, rows[3].header) == ("hmd", "no heading\n", {})
    edges = vault.links(found.df)
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "card"), ("a", "d", "ambiguous"), ("a", "none", "forward"), ("b", "a", "card"), ("b", "d", "card")]
    near = graph.expand(spark.createDataFrame([("a",)], "name string"), edges.where("state = 'card'"), 1, "up")
    assert sorted(r.name for r in near.collect()) == ["a", "b"]


def test_http(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        one = http.fetch(spark, f"{base}/ok").first()
        assert (one.status, bytes(one.body), one.error) == (200, b"/ok", None)
        urls = spark.createDataFrame([(f"{base}/ok",), (f"{base}/no",), ("file:///etc/hosts",), (None,)], "url string")
        rows = {r.url: r for r in http.fetch_all(urls).collect()}
        assert len(rows) == 3 and rows[f"{base}/no"].status == 404 and rows["file:///etc/hosts"].error == "not an http url"
    finally:
        server.shutdown()


def test_logger(tmp_path):
    kept = []
    log = Logger("birds", kept.append)
    log.debug("unseen")
    log.info("loaded", count=312)
    log.error("lost")
    assert kept == ["INFO birds loaded {count: 312}", "ERROR birds lost"]
    Logger("a.b", to_file(str(tmp_path / "log")), "json", "trace").trace("x", y=[1])
    assert json.loads((tmp_path / "log").read_text()) == {"level": "Trace", "logger": "a.b", "message": "x", "data": {"y": [1]}}
    Logger("a", kept.append, "event").warn("w")
    assert kept[-1].level == "warn"


def test_passphrase(spark, tmp_path):
    df = spark.createDataFrame([(1, "secret"), (2, ""), (3, None)], "i int, s string")
    df.withColumn("e", secrets.encrypt_with_passphrase(F.col("s"), "open")).write.parquet(str(tmp_path / "e"))
    kept = spark.read.parquet(str(tmp_path / "e"))
    back = kept.select("i", secrets.decrypt_with_passphrase(F.col("e"), "open").cast("string").alias("s"))
    assert sorted(map(tuple, back.collect())) == [(1, "secret"), (2, ""), (3, None)]
    wrong = kept.select(secrets.decrypt_with_passphrase(F.col("e"), "shut").alias("s"))
    assert [r.s for r in wrong.collect()] == [None, None, None]


def test_merged_streams(spark, tmp_path):
    for name, n in (("p", 3), ("q", 4)):
        spark.range(n).write.parquet(str(tmp_path / name))
    both = live.merge(live.tap(spark, str(tmp_path / "p"), "id long"), live.tap(spark, str(tmp_path / "q"), "id long"))
    got = []
    live.sink(both, lambda batch, _: got.append(batch.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(got) == 7
