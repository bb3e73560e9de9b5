"""Streams: taps, micro-batch sinks, batching by count, error routing and event-time windows."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipeweave.operators.rel import Rel


def tap(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int | None = None) -> Rel:
    """A stream of files; a directory's new files keep arriving."""
    reader = spark.readStream.format(kind).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return Rel(reader.load(path))


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "earliest") -> Rel:
    """Messages of a topic (the connector's package must be on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()
    return Rel(raw.select("value", "partition", "offset", "key", "timestamp", "headers"))


def kafka_sink(rel: Rel, servers: str, topic: str, value: Column, checkpoint: str, key: Column | None = None, once: bool = True) -> StreamingQuery:
    """Rows as messages of a topic, at least once each (the connector's package must be on the class path)."""
    columns = [value.cast("string").alias("value"), *([] if key is None else [key.cast("string").alias("key")])]
    writer = rel.raw.select(*columns).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def join_table(rel: Rel, table: DataFrame, on: list[str], how: str = "inner") -> Rel:
    """A stream with a table beside it: each event meets the table's rows as they are when its micro-batch runs. ``how``: inner, left or left_semi."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"a stream cannot be the optional side of a {how} join")
    return Rel(rel.raw.join(table, on, how))


def sessions(rel: Rel, time: str, gap: str, late: str, by: list[str], **named: Column) -> DataFrame:
    """Session windows with a watermark: events of a key no further apart than ``gap``."""
    stream = rel.raw.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stream.groupBy(F.session_window(time, gap), *by).agg(*[c.alias(n) for n, c in named.items()])


def socket(spark: SparkSession, host: str, port: int) -> Rel:
    return Rel(spark.readStream.format("socket").option("host", host).option("port", port).load())


def merge(first: Rel, *others: Rel) -> Rel:
    """Streams of one shape as one; events come as they arrive."""
    df = first.collection().df
    for other in others:
        df = df.unionByName(other.collection().df)
    return Rel(df)


def sink(rel: Rel, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch to ``write(batch, number)``; a number that comes again is a repeat."""
    writer = rel.raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sink_parquet(rel: Rel, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly once by the file sink's log."""
    writer = rel.raw.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def batches(rel: Rel, n: int, item: Column, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Lists of n in order of arrival; the last of each micro-batch may be short."""

    def cut(batch: DataFrame, number: int) -> None:
        arrived = batch.withColumn("__arrival", F.monotonically_increasing_id())
        write(Rel.of(arrived, "__arrival").map(*batch.columns).collect(n, item).df, number)

    return sink(rel, cut, checkpoint)


def route(rel: Rel, result: str, good: Callable[[DataFrame], None], bad: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Results of validation to two sinks, each micro-batch evaluated once."""

    def split(batch: DataFrame, _: int) -> None:
        batch.persist()
        good(Rel(batch).oks(result).df)
        bad(Rel(batch).errs(result).df)
        batch.unpersist()

    return sink(rel, split, checkpoint)


def take(rel: Rel, n: int, checkpoint: str, wait: bool = False) -> list:
    """The first n rows; then the stream is stopped and later input is not read.

    Fewer come if the input at hand ends before; ``wait`` goes on until n rows have come.
    """
    got: list = []
    enough = threading.Event()

    def add(batch: DataFrame, _: int) -> None:
        if not enough.is_set():
            got.extend(batch.limit(n - len(got)).collect())
            if len(got) >= n:
                enough.set()

    if n <= 0:
        return got
    query = sink(rel, add, checkpoint, once=not wait)
    while not enough.wait(0.05) and query.isActive:
        pass
    error = None if enough.is_set() else query.exception()
    query.stop()
    if error is not None:
        raise error
    return got


def sample(rel: Rel, n: int, seed: int, checkpoint: str) -> list:
    """n rows drawn by the least hashes: what is held never exceeds n."""
    held: list = []

    def add(batch: DataFrame, _: int) -> None:
        nonlocal held
        h = F.xxhash64(F.lit(seed), F.struct(*batch.columns))
        held += [(r["__h"], r) for r in batch.withColumn("__h", h).orderBy("__h").limit(n).collect()]
        held = sorted(held, key=lambda x: x[0])[:n]

    sink(rel, add, checkpoint).awaitTermination()
    return [r for _, r in held]


def windowed(rel: Rel, time: str, width: str, late: str, by: list[str], **named: Column) -> DataFrame:
    """Event-time windows with a watermark: an extension, on instants only."""
    clock = F.col(time).cast("timestamp")
    stream = rel.raw.withColumn(time, clock).withWatermark(time, late)
    return stream.groupBy(F.window(time, width), *by).agg(*[c.alias(n) for n, c in named.items()])
