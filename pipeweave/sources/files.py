"""Endpoints: formats, write modes, the schema boundary, paths, and tables by configuration."""

from __future__ import annotations

import fnmatch
import os
import posixpath
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.operators.rel import Rel

MODES = {"create": "errorifexists", "append": "append", "replace": "overwrite"}


@dataclass(frozen=True)
class Mapped:
    """How one field lies outside: its path there, its type, and what counts as absent."""

    path: str | None = None
    kind: str | None = None
    readable: bool = True
    writable: bool = True
    absent: tuple[str, ...] = ("missing", "null")


@dataclass(frozen=True)
class Boundary:
    """Field by field, between the program's names and the store's. Strictness: strict, compatible, open or warn."""

    fields: dict[str, Mapped] = field(default_factory=dict)
    strictness: str = "compatible"

    def read(self, df: DataFrame) -> DataFrame:
        outside = set(df.columns)
        columns: list[Column] = []
        for name, m in self.fields.items():
            if not m.readable:
                continue
            path = m.path or name
            if path.split(".")[0] not in outside:
                if "missing" not in m.absent or self.strictness == "strict":
                    raise ValueError(f"field {name}: nothing at {path}")
                columns.append(F.lit(None).cast(m.kind or "string").alias(name))
                continue
            value = F.col(path)
            if "empty" in m.absent:
                value = F.nullif(value, F.lit(""))
            if m.kind:
                value = value.try_cast(m.kind) if self.strictness in ("open", "warn") else value.cast(m.kind)
            columns.append(value.alias(name))
        if self.strictness == "strict" and (more := outside - {(m.path or n).split(".")[0] for n, m in self.fields.items()}):
            raise ValueError(f"undeclared fields {sorted(more)}")
        if self.strictness == "open":
            taken = {(m.path or n).split(".")[0] for n, m in self.fields.items()} | set(self.fields)
            columns += [F.col(c) for c in df.columns if c not in taken]
        return df.select(*columns)

    def write(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n).alias(m.path or n) for n, m in self.fields.items() if m.writable and n in df.columns])


def source(spark: SparkSession, path: str, kind: str, schema: str | None = None, boundary: Boundary | None = None) -> Rel:
    """A file, folder or glob as rows. Kinds: parquet, orc, json, jsonlines, csv, text, lines, yaml, binary."""
    read = spark.read.schema(schema) if schema and kind not in ("yaml", "text", "lines") else spark.read
    match kind:
        case "json":
            df = read.option("multiLine", True).json(path)
        case "jsonlines":
            df = read.json(path)
        case "csv":
            df = read.option("header", True).csv(path)
        case "text":
            df = read.text(path, wholetext=True)
        case "lines":
            df = read.text(path)
        case "yaml":
            df = _yaml(spark, path, schema or "value string")
        case "binary":
            df = read.format("binaryFile").load(path)
        case _:
            df = read.format(kind).load(path)
    return Rel(boundary.read(df) if boundary else df)


def in_file_order(rel: Rel) -> Rel:
    """Rows by file and place in it: the order of an input without a key."""
    return Rel.of(rel.raw.withColumn("__file", F.input_file_name()).withColumn("__line", F.monotonically_increasing_id()), "__file", "__line").map(*rel.columns)


def target(rel: Rel, path: str, kind: str, mode: str = "replace", by: list[str] | None = None, boundary: Boundary | None = None) -> None:
    df = boundary.write(rel.df) if boundary else rel.df
    writer = df.write.mode(MODES[mode])
    if by:
        writer = writer.partitionBy(*by)
    match kind:
        case "csv":
            writer.option("header", True).csv(path)
        case "json":
            _document(df).write.mode(MODES[mode]).text(path)
        case "jsonlines":
            writer.json(path)
        case "text" | "lines":
            writer.text(path)
        case _:
            writer.format(kind).save(path)


sink = target


def _document(df: DataFrame) -> DataFrame:
    """All rows as one JSON array, a line each: one document is one file, so one task writes it, batch by batch."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            found = b.column(0).to_pylist()
            if found:
                done = [] if last is None else [last]
                first = "[" if last is None else ""
                done += found[:-1]
                if done:
                    yield pa.RecordBatch.from_pydict({"value": [f"{first if i == 0 else ''}{x}," for i, x in enumerate(done)]})
                    last = found[-1]
                else:
                    last = first + found[-1]
        yield pa.RecordBatch.from_pydict({"value": ["[]" if last is None else f"{last}]"]})

    rows = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    return rows.coalesce(1).mapInArrow(lines, "value string")


def _plain(text: str) -> Iterator[dict[str, str | None]]:
    """The flat subset of YAML: documents or list items of ``name: value``."""
    row: dict[str, str | None] = {}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        start = line.lstrip()
        if (start.startswith("- ") or start == "---") and row:
            yield row
            row = {}
        if start == "---":
            continue
        name, colon, value = start.removeprefix("- ").partition(":")
        if colon:
            value = value.strip().strip("'\"")
            row[name.strip()] = None if value in ("", "null", "~") else value
    if row:
        yield row


def _yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    kind = spark.createDataFrame([], schema).schema
    names = kind.fieldNames()
    text = ", ".join(f"`{n}` string" for n in names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for t in b.column(0).to_pylist() for r in _plain(t)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in found], pa.string()) for n in names})

    flat = spark.read.text(path, wholetext=True).mapInArrow(rows, text)
    return flat.select(*[F.col(f.name).cast(f.dataType) for f in kind])


# tables


def table(spark: SparkSession, name: str) -> Rel:
    return Rel(spark.table(name))


def table_target(rel: Rel, name: str, mode: str = "replace", kind: str = "parquet", by: list[str] | None = None) -> None:
    """Rows into a table of the catalog."""
    writer = rel.df.write.mode(MODES[mode]).format(kind)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def jdbc(spark: SparkSession, url_env: str, name: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> Rel:
    """A database table; its url comes from the environment (the driver's jar must be on the class path)."""
    reader = spark.read.format("jdbc").option("url", os.environ[url_env]).option("dbtable", name)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return Rel(reader.load())


def jdbc_target(rel: Rel, url_env: str, name: str, mode: str = "append", parts: int | None = None, batch: int = 500) -> None:
    """Rows into a database table, ``batch`` a statement, by at most ``parts`` connections at once."""
    writer = rel.raw.select(*rel.columns).write.mode(MODES[mode]).format("jdbc").option("url", os.environ[url_env]).option("dbtable", name).option("batchsize", batch)
    (writer.option("numPartitions", parts) if parts else writer).save()


# rows changed in place: a staged rewrite, for stores without row-level statements


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


@dataclass
class Rollback(Exception):
    reason: str


def _state(disk, path) -> tuple:
    """What a folder of files holds: equal before and after if nothing wrote to it."""
    found, files = [], disk.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _moved(disk, source, to) -> bool:
    """A rename that says whether it happened."""
    try:
        return disk.rename(source, to)
    except Py4JJavaError:
        return False


def transaction(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], attempts: int = 3) -> dict[str, object]:
    """Read a Parquet table, stage the changed one beside it, and swap by two renames under a lock file.

    If the table was written to since it was read, or another transaction holds the lock, the change
    is tried again on the new table. A failed swap puts the old table back, and a failure leaves no staged files.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    disk, here, lock = at(path).getFileSystem(conf), at(path), at(f"{path}.lock")
    old, error = at(f"{path}.old"), "the table kept changing"
    for _ in range(attempts):
        staged = at(f"{path}.staged-{uuid.uuid4().hex[:12]}")
        before = _state(disk, here)
        try:
            spark.catalog.refreshByPath(path)
            change(spark.read.parquet(path)).write.mode("overwrite").parquet(staged.toString())
        except Rollback as e:
            disk.delete(staged, True)
            return {"is_ok": False, "err": e.reason}
        except Exception as e:  # noqa: BLE001
            disk.delete(staged, True)
            error = str(e)
            continue
        if not disk.createNewFile(lock):
            disk.delete(staged, True)
            error = "another transaction holds the lock"
            time.sleep(0.2)
            continue
        try:
            if _state(disk, here) != before:
                error = "the table changed since it was read"
                continue
            disk.delete(old, True)
            if not _moved(disk, here, old):
                error = "the table could not be moved"
                continue
            if not _moved(disk, staged, here):
                _moved(disk, old, here)
                error = "the changed table could not be moved"
                continue
            disk.delete(old, True)
            spark.catalog.refreshByPath(path)
            return {"is_ok": True, "err": None}
        finally:
            disk.delete(staged, True)
            disk.delete(lock, True)
    return {"is_ok": False, "err": error}


# paths and folders


def join(path: str, segment: str) -> str:
    return posixpath.join(path, segment)


def parent(path: str) -> str | None:
    return posixpath.dirname(path.rstrip("/")) or None


def name(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))


def stem(path: str) -> str:
    return posixpath.splitext(name(path))[0]


def extension(path: str) -> str | None:
    return posixpath.splitext(name(path))[1].removeprefix(".") or None


def matches(pattern: str, path: str) -> bool:
    return fnmatch.fnmatchcase(path, pattern)


def entries(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
    return found.select("path", "length", "modificationTime")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def variable(name: str) -> str | None:
    return os.environ.get(name)


def variables() -> dict[str, str]:
    return dict(os.environ)


def arguments() -> list[str]:
    return sys.argv[1:]


def argument(i: int) -> str | None:
    found = arguments()
    return found[i] if -len(found) <= i < len(found) else None


def working_dir() -> str:
    return os.getcwd()


def source_dir(module: str) -> str:
    """The folder of a module's own file, as ``__file__`` names it."""
    return os.path.dirname(os.path.abspath(module))
