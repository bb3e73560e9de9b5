"""Message wires as stream sources and sinks, over plain sockets: NATS subjects, JetStream streams, WebSockets, TCP lines.

A subject, a socket and a WebSocket are live: what comes while no one listens is lost, and a reader keeps what a running
micro-batch may ask for again. A JetStream stream is read by sequence number, so it can be replayed from a checkpoint.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import socket
import threading
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from pipeweave.operators.rel import Rel
from pipeweave.streaming import live

#: Fixed value of RFC 6455.
_ACCEPT = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


# ---- NATS


class Nats:
    """One connection: publish, request, and messages of subscriptions (subject, reply, payload)."""

    def __init__(self, url: str, timeout: float = 10.0):
        at = urlsplit(url if "://" in url else f"nats://{url}")
        self.socket = socket.create_connection((at.hostname, at.port or 4222), timeout=timeout)
        self.file = self.socket.makefile("rb")
        info = self.file.readline()
        if not info.startswith(b"INFO "):
            raise ConnectionError(f"not a NATS server: {info[:40]!r}")
        user = {"user": at.username, "pass": at.password or ""} if at.username else {}
        self._send(b"CONNECT " + json.dumps({"verbose": False, "pedantic": False, "lang": "python", "version": "1", **user}).encode() + b"\r\nPING\r\n")
        while (line := self.file.readline()) != b"PONG\r\n":
            if not line or line.startswith(b"-ERR"):
                raise ConnectionError(line.decode(errors="replace").strip() or "closed")
        self.numbers = itertools.count(1)

    def _send(self, raw: bytes) -> None:
        self.socket.sendall(raw)

    def publish(self, subject: str, payload: bytes, reply: str = "") -> None:
        self._send(f"PUB {subject} {reply + ' ' if reply else ''}{len(payload)}\r\n".encode() + payload + b"\r\n")

    def subscribe(self, subject: str) -> int:
        n = next(self.numbers)
        self._send(f"SUB {subject} {n}\r\n".encode())
        return n

    def flush(self) -> None:
        """Returns when the server has seen all that was sent; for connections without subscriptions."""
        self._send(b"PING\r\n")
        while self.file.readline() not in (b"PONG\r\n", b""):
            pass

    def messages(self) -> Iterator[tuple[str, str, bytes]]:
        while line := self.file.readline():
            if line.startswith(b"PING"):
                self._send(b"PONG\r\n")
            elif line.startswith(b"MSG "):
                parts = line.decode().split()
                payload = self.file.read(int(parts[-1]))
                self.file.read(2)
                yield parts[1], parts[3] if len(parts) == 5 else "", payload
            elif line.startswith(b"-ERR"):
                raise ConnectionError(line.decode(errors="replace").strip())

    def request(self, subject: str, payload: bytes = b"") -> bytes:
        inbox = f"_INBOX.{os.urandom(8).hex()}"
        n = self.subscribe(inbox)
        self.publish(subject, payload, inbox)
        answer = next(self.messages(), None)
        self._send(f"UNSUB {n}\r\n".encode())
        if answer is None:
            raise ConnectionError("closed")
        return answer[2]

    def close(self) -> None:
        self.file.close()
        self.socket.close()


# ---- WebSocket


class WebSocket:
    """A client connection: messages in and out, text as UTF-8."""

    def __init__(self, url: str, timeout: float = 10.0):
        at = urlsplit(url)
        if at.scheme != "ws":
            raise ValueError("only ws:// addresses")
        self.socket = socket.create_connection((at.hostname, at.port or 80), timeout=timeout)
        self.file = self.socket.makefile("rb")
        key = base64.b64encode(os.urandom(16))
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.socket.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key.decode()}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        status = self.file.readline()
        head = {}
        while (line := self.file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("latin-1").partition(":")
            head[name.strip().lower()] = value.strip()
        if b" 101 " not in status or head.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1(key + _ACCEPT).digest()).decode():
            raise ConnectionError(f"no WebSocket at {url}: {status.decode('latin-1').strip()}")
        self.socket.settimeout(None)

    def send(self, payload: bytes, kind: int = 1) -> None:
        n, mask = len(payload), os.urandom(4)
        size = bytes([0x80 | n]) if n < 126 else b"\xfe" + n.to_bytes(2, "big") if n < 1 << 16 else b"\xff" + n.to_bytes(8, "big")
        self.socket.sendall(bytes([0x80 | kind]) + size + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(payload)))

    def messages(self) -> Iterator[bytes]:
        """Whole messages until the other side closes; pings are answered."""
        held = b""
        while len(head := self.file.read(2)) == 2:
            last, kind, n = head[0] & 0x80, head[0] & 0x0F, head[1] & 0x7F
            if n >= 126:
                n = int.from_bytes(self.file.read(2 if n == 126 else 8), "big")
            mask = self.file.read(4) if head[1] & 0x80 else b""
            payload = self.file.read(n)
            if mask:
                payload = bytes(b ^ mask[i % 4] for i, b in enumerate(payload))
            if kind == 8:
                return
            if kind == 9:
                self.send(payload, 10)
            elif kind in (0, 1, 2):
                held += payload
                if last:
                    yield held
                    held = b""

    def close(self) -> None:
        self.file.close()
        self.socket.close()


# ---- sources


def _nats_messages(options: dict) -> Iterator[tuple]:
    n = Nats(options["url"])
    n.subscribe(options["subject"])
    n.socket.settimeout(None)
    return ((subject, reply or None, payload) for subject, reply, payload in n.messages())


def _websocket_messages(options: dict) -> Iterator[tuple]:
    return ((m,) for m in WebSocket(options["url"]).messages())


class _Live(SimpleDataSourceStreamReader):
    """What comes from now on, numbered; kept until a micro-batch that has it is done."""

    def __init__(self, connect: Callable[[dict], Iterator[tuple]], options: dict):
        self.connect, self.options = connect, options
        self.held: list[tuple] | None = None
        self.first = 0

    def _listen(self) -> list[tuple]:
        if self.held is None:
            self.held, self.lock = [], threading.Lock()
            source = self.connect(self.options)

            def run() -> None:
                for m in source:
                    with self.lock:
                        self.held.append(m)

            threading.Thread(target=run, daemon=True).start()
        return self.held

    def initialOffset(self) -> dict:
        self._listen()
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        held = self._listen()
        with self.lock:
            rows = held[max(0, start["n"] - self.first) :]
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        held = self._listen()
        with self.lock:
            return iter(held[max(0, start["n"] - self.first) : max(0, end["n"] - self.first)])

    def commit(self, end: dict) -> None:
        held = self._listen()
        with self.lock:
            del held[: max(0, end["n"] - self.first)]
            self.first = max(self.first, end["n"])


class _Stream(SimpleDataSourceStreamReader):
    """A JetStream stream by sequence number: what it holds can be read again."""

    def __init__(self, options: dict):
        self.options = options
        self.wire: Nats | None = None

    def _ask(self, api: str, body: dict | None = None) -> dict:
        self.wire = self.wire or Nats(self.options["url"])
        return json.loads(self.wire.request(f"$JS.API.{api}.{self.options['stream']}", json.dumps(body).encode() if body else b""))

    def _state(self) -> dict:
        found = self._ask("STREAM.INFO")
        if "error" in found:
            raise ConnectionError(found["error"].get("description", "no such stream"))
        return found["state"]

    def initialOffset(self) -> dict:
        state = self._state()
        return {"seq": state["last_seq"] + 1 if self.options.get("from") == "latest" else max(1, state["first_seq"])}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"seq": max(start["seq"], min(self._state()["last_seq"] + 1, start["seq"] + int(self.options.get("most", "1000"))))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, seq = [], start["seq"]
        while seq < end["seq"]:
            found = self._ask("STREAM.MSG.GET", {"seq": seq, "next_by_subj": self.options["subject"]})
            if "message" not in found or (m := found["message"])["seq"] >= end["seq"]:
                break
            rows.append((m["subject"], m["seq"], base64.b64decode(m.get("data", ""))))
            seq = m["seq"] + 1
        return iter(rows)


class NatsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nats"

    def schema(self) -> str:
        return "subject string, reply string, value binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Live(_nats_messages, self.options)


class JetStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nats_jetstream"

    def schema(self) -> str:
        return "subject string, sequence bigint, value binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class WebSocketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "websocket"

    def schema(self) -> str:
        return "value binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Live(_websocket_messages, self.options)


def nats(spark: SparkSession, subject: str, url: str) -> Rel:
    """Messages of a subject while the query runs: ``subject``, ``reply``, ``value``."""
    spark.dataSource.register(NatsSource)
    return Rel(spark.readStream.format("nats").option("subject", subject).option("url", url).load())


def nats_jetstream(spark: SparkSession, subject: str, stream: str, url: str, start: str = "earliest", most: int = 1000) -> Rel:
    """Messages of a stream from its first or next one on, ``most`` a micro-batch; the checkpoint holds the position."""
    spark.dataSource.register(JetStreamSource)
    return Rel(spark.readStream.format("nats_jetstream").option("subject", subject).option("stream", stream).option("url", url).option("from", start).option("most", most).load())


def websocket(spark: SparkSession, url: str) -> Rel:
    """Messages of a WebSocket while the query runs."""
    spark.dataSource.register(WebSocketSource)
    return Rel(spark.readStream.format("websocket").option("url", url).load())


# ---- sinks: the driver has the connection, rows come to it partition by partition


def _values(batch: DataFrame) -> Iterator[bytes]:
    return (bytes(r[0]) for r in batch.toLocalIterator(prefetchPartitions=True) if r[0] is not None)


def send_nats(values: DataFrame, subject: str, url: str, acknowledged: bool = False) -> int:
    """The only column's values (octets or text) as messages, in order; ``acknowledged``: a stream must confirm each. How many."""
    wire, n = Nats(url), 0
    try:
        for v in _values(values.select(values[0].cast("binary"))):
            if acknowledged:
                answer = json.loads(wire.request(subject, v))
                if "error" in answer:
                    raise ConnectionError(answer["error"].get("description", "not stored"))
            else:
                wire.publish(subject, v)
            n += 1
        if not acknowledged:
            wire.flush()
    finally:
        wire.close()
    return n


def send_websocket(values: DataFrame, url: str) -> int:
    wire, n = WebSocket(url), 0
    try:
        for v in _values(values.select(values[0].cast("binary"))):
            wire.send(v)
            n += 1
        wire.send(b"", 8)
    finally:
        wire.close()
    return n


def send_tcp(values: DataFrame, host: str, port: int) -> int:
    """The values as lines."""
    n = 0
    with socket.create_connection((host, port), timeout=10) as wire:
        for v in _values(values.select(values[0].cast("binary"))):
            wire.sendall(v + b"\n")
            n += 1
    return n


def nats_sink(rel: Rel, value: Column, subject: str, url: str, checkpoint: str, acknowledged: bool = False, once: bool = True) -> StreamingQuery:
    """A stream's rows as messages, at least once each."""
    return live.sink(rel.map(value=value), lambda batch, _: send_nats(batch, subject, url, acknowledged), checkpoint, once)
