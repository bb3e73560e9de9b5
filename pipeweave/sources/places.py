"""Where rows come from and go by name: channels, configured endpoints, standard streams, files that grow, sealed rows."""

from __future__ import annotations

import json
import sys
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from pipeweave.functions import keys
from pipeweave.operators.rel import Rel
from pipeweave.sources import files, render

# ---- channels


@dataclass
class Channel:
    """Rows in memory of one program, under a name: what was sent, in order of sending."""

    name: str
    sent: list[DataFrame] = field(default_factory=list)

    def send(self, rel: Rel) -> Channel:
        """Append rows; the first ones settle the columns."""
        df = rel.raw.select(*rel.columns)
        self.sent.append(df if not self.sent else df.select(*self.sent[0].columns))
        return self

    def read(self) -> Rel:
        """All rows so far, those sent first before later ones."""
        if not self.sent:
            raise ValueError(f"nothing was sent to channel {self.name}")
        out = Rel(self.sent[0])
        for df in self.sent[1:]:
            out = Rel(out.raw.unionByName(df))
        return out


_CHANNELS: dict[tuple[int, str], Channel] = {}


def channel(spark: SparkSession, name: str) -> Channel:
    """The session's channel of that name."""
    return _CHANNELS.setdefault((id(spark), name), Channel(name))


# ---- endpoints by configuration


def endpoints(path: str) -> dict[str, dict]:
    """Endpoints by id, from a TOML file: tables with ``kind`` and ``path``, ``table`` or ``url_env``, and ``schema``."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def configured(spark: SparkSession, known: dict[str, dict], name: str) -> Rel:
    """The rows of an endpoint that ``endpoints`` names."""
    if name not in known:
        raise KeyError(f"no endpoint {name}; there are {sorted(known)}")
    e = known[name]
    if e["kind"] == "jdbc":
        return files.jdbc(spark, e["url_env"], e["table"])
    if e["kind"] == "table":
        return files.table(spark, e["table"])
    return files.source(spark, e["path"], e["kind"], e.get("schema"))


def configured_target(rel: Rel, known: dict[str, dict], name: str, mode: str = "replace") -> None:
    e = known[name]
    if e["kind"] == "jdbc":
        files.jdbc_target(rel, e["url_env"], e["table"], mode)
    elif e["kind"] == "table":
        files.table_target(rel, e["table"], mode)
    else:
        files.target(rel, e["path"], e["kind"], mode)


# ---- standard streams


def standard_input(spark: SparkSession, schema: str = "value string", stream: TextIO | None = None) -> Rel:
    """Lines of standard input, in order; with a schema of several fields each line is a JSON object."""
    lines = [(i, line.rstrip("\n")) for i, line in enumerate(stream or sys.stdin)]
    rows = Rel.of(spark.createDataFrame(lines, "place long, value string"), "place").map("value")
    if schema == "value string":
        return rows
    return rows.map(r=F.from_json("value", schema)).map("r.*")


def standard_output(rel: Rel, kind: str = "jsonlines", limit: int = 0, stream: TextIO | None = None) -> None:
    """Rows as text of a kind that ``render`` writes."""
    (stream or sys.stdout).write(getattr(render, kind)(rel.df, limit))


def table(rel: Rel, columns: list[str] | None = None) -> str:
    """Rows under column heads, as aligned text: a presentation, for small results."""
    names = columns or rel.columns
    rows = [names, *[["" if v is None else str(v) for v in r] for r in rel.df.select(*names).toLocalIterator()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(names))]
    return "".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in rows)


# ---- a file that grows


class _Tail(SimpleDataSourceStreamReader):
    """New whole lines of a file, by byte offset."""

    def __init__(self, options: dict):
        self.path, self.from_end = options["path"], options.get("from", "start") == "end"

    def initialOffset(self) -> dict:
        if not self.from_end:
            return {"at": 0}
        with open(self.path, "rb") as f:
            return {"at": f.seek(0, 2)}

    def _lines(self, start: int, end: int | None) -> tuple[list[tuple[str]], int]:
        with open(self.path, "rb") as f:
            f.seek(start)
            raw = f.read() if end is None else f.read(end - start)
        whole = raw[: raw.rfind(b"\n") + 1]
        return [(x.decode("utf-8", "replace"),) for x in whole.split(b"\n")[:-1]], start + len(whole)

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        rows, end = self._lines(start["at"], None)
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        return iter(self._lines(start["at"], end["at"])[0])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Tail(self.options)


def tail(spark: SparkSession, path: str, end: bool = True) -> Rel:
    """Lines as they are added to one file on the driver; ``end``: only those added from now on."""
    spark.dataSource.register(TailSource)
    return Rel(spark.readStream.format("tail").option("path", path).option("from", "end" if end else "start").load())


# ---- sealed rows


def encrypted_to(rel: Rel, recipients: list[keys.PublicKey], rows: int = 1000) -> DataFrame:
    """Rows as age messages (``part``, ``message``) of ``rows`` JSON lines each, which any recipient opens. For any binary-capable target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= rows:
                yield message(held[:rows])
                del held[:rows]
        if held:
            yield message(held)

    def message(lines: list[str]) -> pa.RecordBatch:
        raw = "".join(x + "\n" for x in lines)
        return pa.RecordBatch.from_pydict({"rows": pa.array([len(lines)], pa.int64()), "message": pa.array([keys.encrypt_to(raw, recipients)], pa.binary())})

    lines = rel.df.select(F.to_json(F.struct(*rel.columns)).alias("value"))
    return lines.mapInArrow(run, "rows long, message binary")


def decrypted_with(sealed: DataFrame, identity: keys.PrivateKey, schema: str) -> Rel:
    """The rows of age messages; one that is not to this key, or was changed, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0).to_pylist():
                raw = keys.decrypt_with(m, identity)
                if raw is None:
                    raise ValueError("a message that this key does not open")
                yield pa.RecordBatch.from_pydict({"value": pa.array(raw.decode().split("\n")[:-1], pa.string())})

    lines = sealed.select("message").mapInArrow(run, "value string")
    return Rel(lines.select(F.from_json("value", schema).alias("r")).select("r.*"))


def entry(spark: SparkSession, path: str) -> dict | None:
    """Path, length, time of change and kind of a file or folder; absent where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    disk = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not disk.exists(p):
        return None
    s = disk.getFileStatus(p)
    return {"path": path, "length": s.getLen(), "modified": s.getModificationTime(), "is_folder": s.isDirectory()}


def diagnostic(errors: DataFrame, limit: int = 20) -> str:
    """Rejected rows (``contract``, ``value``, ``violations``) as text for a reader, with how many there are."""
    shown = [f"{r['contract']}: {', '.join(r['violations'])}\n  {json.dumps(r['value'].asDict(True), default=str, ensure_ascii=False)}\n" for r in errors.limit(limit).collect()]
    more = errors.count() - len(shown)
    return "".join(shown) + (f"and {more} more\n" if more > 0 else "")
