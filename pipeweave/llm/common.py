"""Shared plumbing of the corpus operators: work folders, Arrow batch size, stable hashes."""

from __future__ import annotations

import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pipeweave
from pipeweave.operators.rel import small_batches

# Functions sent to executors carry their own code, so an executor needs no copy of the package.
cloudpickle.register_pickle_by_value(pipeweave)

#: Rows of an Arrow batch worked on together. Spark bounds a batch by bytes; texts of one slice and what is made of them lie in memory at once.
SLICE = 1000
#: Seconds between two times that an operator gives the driver's freed memory back.
RELEASE_S = 10.0
_released = [0.0]


def slices(batch, rows: int = SLICE) -> Iterator:
    """A batch (or array, or tuple of arrays) in runs of ``rows``, without copying. An empty one gives itself."""
    if isinstance(batch, tuple):
        for part in zip(*(slices(column, rows) for column in batch), strict=True):
            yield part
        return
    for a in range(0, max(1, len(batch)), rows):
        yield batch.slice(a, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, with its file system named: ``spark.checkpoint.dir``, or a temporary one in local tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pipeweave-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written as Parquet into the shared folder.

    A written table cuts lineage and survives lost executors. ``keep`` removes what a lazy result
    does not read; the rest goes when the session's JVM ends. Between tables the driver gives freed memory back.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/pipeweave-{name}-{uuid.uuid4().hex[:12]}"
        self.tags: set[str] = set()
        disk, path = self._place(self.root)
        disk.deleteOnExit(path)

    def _place(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(tag))
        self.tags.add(tag)
        release_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        for tag in tags:
            disk, path = self._place(self.path(tag))
            disk.delete(path, True)
            self.tags.discard(tag)

    def keep(self, *tags: str) -> None:
        """Remove every table but these."""
        self.drop(*sorted(self.tags - set(tags)))
        release_driver(self.spark)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def key_crc(key: str) -> Column:
    """crc32 of a key written as text, as an unsigned long."""
    return F.crc32(F.col(key).cast("string"))


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``key``: the same rows wherever they lie."""
    return df.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(limit)


def chosen_labels(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """``k`` (the key as text) and ``y`` (0 or 1) of at most ``limit`` keys, those with the smallest hash.

    A key whose labels contradict each other has none.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("m"))
    agreed = marks.groupBy("k").agg(F.min("m").alias("y"), F.max("m").alias("other")).where("y = other")
    return bounded_sample(agreed.select("k", "y"), "k", limit)


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, label: str, columns: dict[str, Column], limit: int) -> DataFrame:
    """``y`` and ``columns`` of the rows of ``docs`` that ``chosen_labels`` names.

    Of rows that share a key one is taken (the least by the hash of its columns), so what comes out
    stays bounded whatever repeats. Only the chosen keys are broadcast.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row"))
    found = rows.join(F.broadcast(chosen_labels(labels, key, label, limit)), "k")
    one = found.groupBy("k").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("y").alias("y"))
    return one.select("y", *[F.col(f"row.{n}").alias(n) for n in columns])


def release_memory() -> None:
    """Give freed memory back to the system when a task ends: Python workers are kept for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def release_driver(spark: SparkSession) -> None:
    """Give the driver's freed memory back to the system, at most every ``RELEASE_S`` seconds.

    An operator of hundreds of jobs leaves plans, broadcast tables and task results behind. Java's heap grows over them, and the C
    library keeps what planning, compiling and sending freed, unless both are asked. The collection lets Spark drop old broadcasts and shuffles, too.
    """
    if time.monotonic() - _released[0] < RELEASE_S:
        return
    release_memory()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's own class is closed to callers, its interface is not
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = new(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, call)
    except Py4JError:
        pass  # a JVM without this command
    _released[0] = time.monotonic()


def release_executors(spark: SparkSession) -> None:
    """Collect the executors' memory, so that Java's heap there shrinks to what is in use; with local masters, the driver's.

    An executor's heap grows to what the busiest moment took and stays, while Python workers take theirs beside it. One task a core,
    sent while nothing else runs, reaches every executor; collections asked for at the same time become one.
    """
    cores = 1 if spark.sparkContext.master.split("[")[0] == "local" else spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_seed(*parts: object) -> int:
    """A 64-bit seed from any printable parts, equal in every process."""
    raw = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32) | zlib.crc32(raw, 0x9E3779B9)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (last: the constant) of an L2-regularised logistic regression, by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    s = np.ones(len(y)) if weight is None else weight
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (s * (p - y)) + ridge * w
        curve = (a * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / size) if size else 0
        if size < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
