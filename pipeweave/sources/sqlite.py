"""SQLite tables as a data source: ``spark.read.format("sqlite")`` with path, table and schema."""

from __future__ import annotations

import contextlib
import itertools
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pipeweave.operators.rel import Rel


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Part(InputPartition):
    def __init__(self, low: int | None = None, high: int | None = None):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    """Row ranges by rowid, so parts can be read side by side; a table without rowid is one part, by its key."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", "1"))
        self.columns = columns

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as db:
            try:
                low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Part()]
        if low is None:
            return [_Part(0, -1)]
        step = max(1, (high - low + self.parts) // self.parts)
        return [_Part(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as db:
            names = ", ".join(map(_quoted, self.columns))
            if partition.low is None:
                yield from db.execute(f"select {names} from {_quoted(self.table)}")
                return
            yield from db.execute(f"select {names} from {_quoted(self.table)} where rowid between ? and ? order by rowid", (partition.low, partition.high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
        with sqlite3.connect(self.options["path"]) as db:
            rows = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in rows)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.fieldNames())


def read(spark: SparkSession, path: str, table: str, parts: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("parts", parts).load()


#: Spark types and the column types that SQLite keeps them in; all others are text.
KINDS = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def write(rel: Rel, path: str, table: str, mode: str = "replace", batch: int = 500) -> int:
    """Rows into a table of a file on the driver, in order and in one transaction; how many.

    SQLite has one writer, so rows come to the driver partition by partition and are not held. Modes: create, append, replace.
    """
    rows = rel.df
    names = ", ".join(map(_quoted, rows.columns))
    kinds = ", ".join(f"{_quoted(n)} {KINDS.get(t, 'TEXT')}" for n, t in rows.dtypes)
    plain = rows.select(*[F.col(f"`{n}`") if t in KINDS else F.col(f"`{n}`").cast("string") for n, t in rows.dtypes])
    n = 0
    with contextlib.closing(sqlite3.connect(path, isolation_level=None)) as db:
        db.execute("begin immediate")
        try:
            if mode == "replace":
                db.execute(f"drop table if exists {_quoted(table)}")
            db.execute(f"create table {'if not exists ' if mode == 'append' else ''}{_quoted(table)} ({kinds})")
            source = plain.toLocalIterator(prefetchPartitions=True)
            while part := list(itertools.islice(source, batch)):
                db.executemany(f"insert into {_quoted(table)} ({names}) values ({', '.join('?' * len(rows.columns))})", [tuple(r) for r in part])
                n += len(part)
            db.execute("commit")
        except BaseException:
            db.execute("rollback")
            raise
    return n
