"""One HTTP exchange as a one-row table, fetched by the driver; many urls go through ``fetch_all``."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from urllib.error import HTTPError, URLError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KIND = "url string, status int, body binary, error string"


def _get(url: str, method: str, headers: dict[str, str], timeout_ms: int, body: bytes | None = None) -> dict[str, object]:
    if not url.lower().startswith(("http://", "https://")):
        return {"url": url, "status": None, "body": None, "error": "not an http url"}
    request = urllib.request.Request(url, data=body, method=method, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as answer:
            return {"url": url, "status": answer.status, "body": answer.read(), "error": None}
    except HTTPError as e:
        return {"url": url, "status": e.code, "body": e.read(), "error": e.reason}
    except (URLError, OSError, ValueError) as e:
        return {"url": url, "status": None, "body": None, "error": str(e)}


def fetch(spark: SparkSession, url: str, method: str = "GET", headers: dict[str, str] | None = None, timeout_ms: int = 30_000) -> DataFrame:
    """``url``, ``status``, ``body`` and ``error`` (absent where the exchange succeeded)."""
    got = _get(url, method, headers or {}, timeout_ms)
    return spark.createDataFrame([tuple(got.values())], _KIND)


def fetch_all(urls: DataFrame, column: str = "url", headers: dict[str, str] | None = None, timeout_ms: int = 30_000) -> DataFrame:
    """The same for each url of a table, by its tasks; a failed exchange is a row with its error."""
    fixed = dict(headers or {})
    kind = pa.schema([("url", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column(0).to_pylist():
                if url is not None:
                    yield pa.RecordBatch.from_pylist([_get(url, "GET", fixed, timeout_ms)], kind)

    return urls.select(column).mapInArrow(run, _KIND)


def send_all(rows: DataFrame, url: str, body: str, method: str = "POST", headers: dict[str, str] | None = None, timeout_ms: int = 30_000) -> DataFrame:
    """The column ``body`` (text or octets) of each row sent to the url in column ``url``, by the tasks: at least once,
    as a repeated task sends again. The answers are rows as in ``fetch_all``."""
    fixed = dict(headers or {})
    kind = pa.schema([("url", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for to, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if to is not None:
                    yield pa.RecordBatch.from_pylist([_get(to, method, fixed, timeout_ms, raw or b"")], kind)

    return rows.select(rows[url], rows[body].cast("binary")).mapInArrow(run, _KIND)
