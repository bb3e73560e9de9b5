"""The session settings the engine's semantics rest on, and the type map."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic gives overflow and division errors; maps refuse duplicate keys; instants are UTC.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "EXCEPTION",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Logical scalar types and the Spark SQL types that hold them.
TYPES = {
    "Bool": "boolean",
    "Int": "bigint",
    "Float": "double",
    "Decimal": "decimal(38,18)",
    "String": "string",
    "Date": "date",
    "DateTime": "timestamp_ntz",
    "Instant": "timestamp",
    "Duration": "interval day to second",
    "Bytes": "binary",
    "Data": "variant",
}


def session(name: str = "pipeweave", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spark_type(logical: str) -> str:
    """``Int`` to ``bigint``, ``List<Int>`` to ``array<bigint>``, ``Map<K, V>`` to ``map``, ``Option<T>`` to T."""
    logical = logical.strip()
    if logical in TYPES:
        return TYPES[logical]
    head, bracket, rest = logical.partition("<")
    if not bracket or not rest.endswith(">"):
        raise TypeError(f"unknown type {logical}")
    parts, depth, last = [], 0, 0
    inner = rest[:-1]
    for i, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(inner[last:i])
            last = i + 1
    args = [spark_type(p) for p in [*parts, inner[last:]]]
    if head in ("List", "Seq", "Set", "Collection"):
        return f"array<{args[0]}>"
    if head == "Option":
        return args[0]
    if head in ("Map", "OrderedMap", "SortedMap"):
        return f"map<{args[0]},{args[1]}>" if head == "Map" else f"array<struct<key:{args[0]},value:{args[1]}>>"
    if head == "Pair":
        return f"struct<first:{args[0]},second:{args[1]}>"
    if head == "Result":
        return f"struct<is_ok:boolean,ok:{args[0]},err:{args[1]}>"
    raise TypeError(f"unknown type {logical}")
