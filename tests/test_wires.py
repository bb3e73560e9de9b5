"""Wires against small servers of their own: a NATS server with one stream, a WebSocket server, a line server."""

import base64
import hashlib
import json
import socketserver
import threading
import time

import pytest
from pyspark.sql import functions as F

from pipeweave.operators.rel import Rel
from pipeweave.streaming import live, wires


class Broker(socketserver.ThreadingTCPServer):
    """Subjects (no wildcards) and a stream ``KEPT`` of all that is sent to ``kept``."""

    allow_reuse_address = daemon_threads = True

    def __init__(self):
        self.lock, self.listeners, self.stored = threading.Lock(), [], []
        super().__init__(("127.0.0.1", 0), BrokerLine)

    def deliver(self, subject, payload, reply=""):
        with self.lock:
            for own, sid, out in self.listeners:
                if own == subject:
                    out.write(f"MSG {subject} {sid} {reply + ' ' if reply else ''}{len(payload)}\r\n".encode() + payload + b"\r\n")
                    out.flush()


class BrokerLine(socketserver.StreamRequestHandler):
    def handle(self):
        b = self.server
        self.wfile.write(b"INFO {}\r\n")
        while line := self.rfile.readline():
            verb, *parts = line.decode().split()
            if verb == "PING":
                with b.lock:
                    self.wfile.write(b"PONG\r\n")
            elif verb == "SUB":
                with b.lock:
                    b.listeners.append((parts[0], parts[1], self.wfile))
            elif verb == "UNSUB":
                with b.lock:
                    b.listeners = [x for x in b.listeners if not (x[1] == parts[0] and x[2] is self.wfile)]
            elif verb == "PUB":
                payload = self.rfile.read(int(parts[-1]))
                self.rfile.read(2)
                self.published(parts[0], parts[1] if len(parts) == 3 else "", payload)

    def published(self, subject, reply, payload):
        b = self.server
        if subject == "$JS.API.STREAM.INFO.KEPT":
            b.deliver(reply, json.dumps({"state": {"first_seq": 1, "last_seq": len(b.stored)}}).encode())
        elif subject == "$JS.API.STREAM.MSG.GET.KEPT":
            n = json.loads(payload)["seq"]
            found = {"message": {"subject": "kept", "seq": n, "data": base64.b64encode(b.stored[n - 1]).decode()}} if n <= len(b.stored) else {"error": {"code": 404}}
            b.deliver(reply, json.dumps(found).encode())
        elif subject.startswith("$JS.API"):
            b.deliver(reply, json.dumps({"error": {"description": "stream not found"}}).encode())
        elif subject == "kept":
            b.stored.append(payload)
            if reply:
                b.deliver(reply, json.dumps({"stream": "KEPT", "seq": len(b.stored)}).encode())
        else:
            b.deliver(subject, payload)


@pytest.fixture
def broker():
    b = Broker()
    threading.Thread(target=b.serve_forever, daemon=True).start()
    yield b, f"nats://127.0.0.1:{b.server_address[1]}"
    b.shutdown()


def until(found, seconds=30):
    end = time.monotonic() + seconds
    while not found() and time.monotonic() < end:
        time.sleep(0.1)
    return found()


def test_subject_there_and_back(spark, broker, tmp_path):
    b, url = broker
    got = []
    query = live.sink(wires.nats(spark, "news", url), lambda d, _: got.extend(bytes(r.value) for r in d.collect()), str(tmp_path / "c"), once=False)
    assert until(lambda: any(s == "news" for s, _, _ in b.listeners))
    assert wires.send_nats(spark.range(3).select(F.concat(F.lit("n"), "id")), "news", url) == 3
    assert until(lambda: len(got) == 3)
    wires.send_nats(spark.createDataFrame([("later",)], "x string"), "news", url)
    assert until(lambda: len(got) == 4)
    query.stop()
    assert sorted(got) == [b"later", b"n0", b"n1", b"n2"]


def test_stream_goes_on_from_its_checkpoint(spark, broker, tmp_path):
    b, url = broker
    assert wires.send_nats(spark.range(5).select(F.col("id").cast("string")).coalesce(1), "kept", url, acknowledged=True) == 5
    got = []
    read = lambda: live.sink(wires.nats_jetstream(spark, "kept", "KEPT", url, most=2), lambda d, _: got.append([r.sequence for r in d.orderBy("sequence").collect()]), str(tmp_path / "c"), once=False)
    query = read()
    assert until(lambda: sum(map(len, got)) == 5) and max(map(len, got)) <= 2
    query.stop()
    b.stored.append(b"six")
    query = read()
    assert until(lambda: sum(map(len, got)) == 6)
    query.stop()
    assert [x for part in got for x in part] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="stream not found"):
        live.take(wires.nats_jetstream(spark, "kept", "NONE", url), 1, str(tmp_path / "c2"), wait=True)


def test_a_stream_sends_messages(spark, broker, tmp_path):
    b, url = broker
    spark.range(4).write.parquet(str(tmp_path / "in"))
    rows = live.tap(spark, str(tmp_path / "in"), "id long")
    wires.nats_sink(rows, F.col("id").cast("string"), "kept", url, str(tmp_path / "c"), acknowledged=True).awaitTermination()
    assert sorted(b.stored) == [b"0", b"1", b"2", b"3"]
    with pytest.raises(ConnectionError):
        wires.Nats("nats://127.0.0.1:1")


class Socket(socketserver.StreamRequestHandler):
    """Sends two messages (one in two frames, a ping between) and keeps what comes."""

    def handle(self):
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            head += self.rfile.readline()
        key = [x for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key")][0].split(b": ")[1]
        accept = base64.b64encode(hashlib.sha1(key + wires._ACCEPT).digest())
        self.wfile.write(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
        long = b"x" * 300
        self.wfile.write(b"\x01\x02on" + b"\x89\x01p" + b"\x80\x01e" + b"\x82\x7e" + len(long).to_bytes(2, "big") + long)
        while len(h := self.rfile.read(2)) == 2:
            n = h[1] & 0x7F
            n = int.from_bytes(self.rfile.read(2), "big") if n == 126 else n
            mask = self.rfile.read(4)
            self.server.seen.append((h[0] & 15, bytes(c ^ mask[i % 4] for i, c in enumerate(self.rfile.read(n)))))
            if h[0] & 15 == 8:
                break


def test_websocket(spark, tmp_path):
    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Socket) as s:
        s.daemon_threads, s.seen = True, []
        threading.Thread(target=s.serve_forever, daemon=True).start()
        url = f"ws://127.0.0.1:{s.server_address[1]}/x?y=1"
        got = live.take(wires.websocket(spark, url), 2, str(tmp_path / "c"), wait=True)
        assert [bytes(r.value) for r in got] == [b"one", b"x" * 300] and (10, b"p") in s.seen
        assert wires.send_websocket(spark.createDataFrame([("a",), ("b" * 200,)], "x string").coalesce(1), url) == 2
        assert until(lambda: (8, b"") in s.seen) and [m for k, m in s.seen if k == 1] == [b"a", b"b" * 200]
        s.shutdown()


def test_tcp_lines(spark):
    class Lines(socketserver.StreamRequestHandler):
        def handle(self):
            self.server.seen += self.rfile.read().split(b"\n")[:-1]

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Lines) as s:
        s.daemon_threads, s.seen = True, []
        threading.Thread(target=s.serve_forever, daemon=True).start()
        assert wires.send_tcp(Rel(spark.range(3)).df.select(F.col("id").cast("string")), "127.0.0.1", s.server_address[1]) == 3
        assert until(lambda: sorted(s.seen) == [b"0", b"1", b"2"])
        s.shutdown()
