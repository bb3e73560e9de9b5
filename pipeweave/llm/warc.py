"""Legacy web archives to WARC, and back to pages.

An ARC archive is a version block and records, each a header line and as many bytes as the line
declares. Version 1 lines hold url, IP, date, type and length; version 2 lines add result code,
checksum, location, offset and file name. The converter parses either by the version block's own
field line, takes exactly the declared bytes, and synthesises the WARC side: a ``warcinfo``
record from the version block, then for each record a name-based UUID identifier, an ISO
timestamp, the record type, and SHA-1 digests of block and payload. A payload of ``MIN_REVISIT``
bytes or more that another record holds becomes a ``revisit`` without payload.

Archives are files of a few MB, gzip by record, under names that depend on the task's partition only, so a repeated task
writes the same file again. They lie in the folder that ``folder`` names (any file system), or else in the
shared folder, from which they go with the session.

Defined results: a null page is an empty payload; a null page id makes a response without an id,
which nothing revisits; spaces and line breaks in a url are
percent-encoded in headers; a null url becomes ``about:blank``; repeated page ids are written as
they come, each by its own payload; ids are whole numbers, or text that spells them (other text raises an error in ANSI
mode); pages of any length are written whole; an empty table gives an empty result; extra columns are ignored. A truncated or
malformed ARC record raises ``ArcError`` with its offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import Workspace, slices

MIN_REVISIT = 1000
#: Bytes of payload in one archive file, about.
ARCHIVE_BYTES = 8 << 20
#: Revisits (some 100 bytes each) up to which their table goes to every executor and pages stay where
#: they lie; beyond it both are shuffled by page.
SMALL_REVISITS = 100_000
#: Fixed values of the ARC format: the field line of each version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcError(ValueError):
    pass


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    offset: int


def _percent(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block (with its blank line) and payload of an HTTP message; no header: all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")


def _http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("latin-1").split("\r\n"):
        k, colon, v = line.partition(":")
        if colon and k.strip().lower() == name.lower():
            return v.strip()
    return None


def write_arc(pages: list[tuple[int | None, str | None, bytes]], name: str, version: int = 1, date: str = "20240101000000") -> bytes:
    """An uncompressed ARC archive of HTTP responses; the page id travels in a header of the response."""
    out = io.BytesIO()
    block = f"{version} 0 pipeweave\n{FIELDS[version]}\n".encode()
    extra = " 200 - - 0 %s" % name if version == 2 else ""
    out.write(f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(block)}\n".encode() + block + b"\n")
    for page_id, url, html in pages:
        own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{own}\r\n".encode() + html
        extra = f" 200 {hashlib.md5(content).hexdigest()} - {out.tell()} {name}" if version == 2 else ""
        out.write(f"{_percent(url)} 0.0.0.0 {date} text/html{extra} {len(content)}\n".encode("utf-8", "surrogatepass") + content + b"\n")
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The version block's record, then every record, by declared lengths."""
    names: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no end of header line at {at}")
        line = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r")
        parts = line.split(" ")
        if not names:
            if not line.startswith("filedesc://"):
                raise ArcError(f"no version block at {at}")
            length = parts[-1]
        else:
            if len(parts) < len(names):
                raise ArcError(f"{len(parts)} of {len(names)} fields at {at}: {line[:80]!r}")
            # a url of an old archive may hold spaces: all other fields are taken from the right
            parts = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
            length = parts[-1]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ArcError(f"bad length {length!r} at {at}")
        content = data[end + 1 : end + 1 + int(length)]
        if not names:
            lines = content.decode("utf-8").split("\n")
            version = lines[0].split(" ")[0]
            if version not in ("1", "2") or len(lines) < 2:
                raise ArcError(f"unknown version block at {at}")
            names = lines[1].strip().split(" ")
            yield ArcRecord({"URL": parts[0], "Archive-date": parts[2], "version": version, "Archive-length": length}, content, at)
        else:
            yield ArcRecord(dict(zip(names, parts, strict=True)), content, at)
        at = end + 1 + int(length)


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss (old archives: a date alone) as ISO 8601 in UTC."""
    d = (arc_date + "00000000000000")[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def record_uri(url: str, date: str, key: str) -> str:
    """An identifier that the same record always gets again."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {key}')}>"


def convert(data: bytes, original: Callable[[ArcRecord, bytes], dict[str, str] | None]) -> Iterator[bytes]:
    """WARC records equivalent to those of an ARC archive.

    ``original`` names the earlier record (``WARC-Refers-To`` and so on) that a record revisits, or
    gives None for a response.
    """
    for n, r in enumerate(read_arc(data)):
        date = warc_date(r.fields.get("Archive-date", ""))
        if not n:
            info = f"software: pipeweave\r\nformat: WARC File Format 1.1\r\nconformsTo: ARC version {r.fields['version']}\r\n".encode()
            yield warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_uri(r.fields["URL"], date, "info"), "WARC-Date": date, "Content-Type": "application/warc-fields", "WARC-Block-Digest": warc_digest(info)}, info)
            continue
        head, payload = _split_http(r.content)
        key = _http_field(head, "X-Page-Id") or str(r.offset)
        headers = {"WARC-Type": "response", "WARC-Record-ID": record_uri(r.fields["URL"], date, key), "WARC-Date": date, "WARC-Target-URI": r.fields["URL"], "WARC-IP-Address": r.fields.get("IP-address", "0.0.0.0")}
        headers |= {"Content-Type": "application/http; msgtype=response" if head else r.fields.get("Content-type", "application/octet-stream"), "WARC-Payload-Digest": warc_digest(payload)}
        block = r.content
        if (earlier := original(r, payload)) is not None:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE} | earlier
            block = head
        elif not head:
            headers["WARC-Type"] = "resource"
        yield warc_record(headers | {"WARC-Block-Digest": warc_digest(block)}, block)


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            headers[k.strip()] = v.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def page_of(headers: dict[str, str], block: bytes) -> dict[str, object] | None:
    """What a record says of its page; None for records that are no page."""
    if headers["WARC-Type"] not in ("response", "revisit"):
        return None
    head, payload = _split_http(block)
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    whole = headers["WARC-Type"] == "response"
    if whole and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"digest of {headers['WARC-Record-ID']} is not its payload's")
    own, to = _http_field(head, "X-Page-Id"), headers.get("WARC-Refers-To-Page")
    return {
        "page_id": int(own) if own else None, "payload_bytes": len(payload) if whole else int(_http_field(head, "Content-Length")), "payload_digest": digest,
        "record_type": headers["WARC-Type"], "refers_to": int(to) if to else None, "url": headers["WARC-Target-URI"], "record_id": headers["WARC-Record-ID"], "date": headers["WARC-Date"],
    }


def _open(path: str):
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def _store(path: str, data: bytes, unique: str) -> None:
    """Write under a name of this attempt, then move: readers never see half a file."""
    disk, place = _open(path)
    disk.create_dir(place.rpartition("/")[0], recursive=True)
    with disk.open_output_stream(f"{place}.{unique}", compression=None) as f:
        f.write(data)
    disk.move(f"{place}.{unique}", place)


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Pages of a task: ARC archives, converted to WARC, stored; one row for each archive."""
    from pyspark import TaskContext

    task = TaskContext.get()
    part, unique = task.partitionId(), f"{task.taskAttemptId()}.tmp"
    held: list[tuple[int | None, str | None, bytes]] = []
    marks: list[tuple[int | None, str | None, str]] = []  # what each of ``held`` revisits
    made = size = 0

    def original(turn: Iterator[tuple[int | None, str | None, str]]) -> dict[str, str] | None:
        to, url, date = next(turn)
        if to is None:
            return None
        return {"WARC-Refers-To": record_uri(_percent(url), date, str(to)), "WARC-Refers-To-Target-URI": _percent(url), "WARC-Refers-To-Date": date, "WARC-Refers-To-Page": str(to)}

    def out() -> pa.RecordBatch:
        nonlocal made, size
        name = f"part-{part:06d}-{made:05d}"
        # old crawls come in either version of the format
        arc = write_arc(held, f"{name}.arc", version=1 + made % 2)
        _store(f"{root}/{name}.arc.gz", gzip.compress(arc, 1, mtime=0), unique)
        turn = iter(marks)
        warc = b"".join(gzip.compress(r, 4, mtime=0) for r in convert(arc, lambda *_: original(turn)))
        _store(f"{root}/{name}.warc.gz", warc, unique)
        row = pa.RecordBatch.from_pydict({"path": [f"{root}/{name}.warc.gz"], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(warc)], pa.int64())})
        made, size = made + 1, 0
        held.clear()
        marks.clear()
        return row

    for b in chain.from_iterable(slices(b, 256) for b in batches):
        for page_id, url, html, to, to_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = html.encode("utf-8", "surrogatepass") if html else b""
            held.append((page_id, url, data))
            marks.append((to, to_url, "2024-01-01T00:00:00Z"))
            size += len(data)
            if size >= ARCHIVE_BYTES:
                yield out()
    if held:
        yield out()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("path", pa.string())])
    for b in batches:
        for path in b.column(0).to_pylist():
            disk, place = _open(path)
            rows: list[dict[str, object]] = []
            with disk.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for headers, block in read_warc(stream):
                    if (page := page_of(headers, block)) is not None:
                        rows.append(page | {"path": path})
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, kind)


def write_archives(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write every page into ARC and WARC archives; ``path``, ``records``, ``bytes`` of each WARC file.

    Of pages with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the largest key is
    the response. Only digests are shuffled to find it; the join back is on (digest, salt).
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    light = p.select("id", "url", F.sha1(payload).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= MIN_REVISIT)
    light = space.save(light, "digests")
    last = light.groupBy("d", "n").agg(F.max("id").alias("to"), F.max_by("url", "id").alias("to_url"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    salts = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salted = light.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    again = salted.join(salts, ["d", "n", "salt"]).where(F.col("id") < F.col("to")).select("id", "d", "to", "to_url").dropDuplicates(["id", "d"])
    again = space.save(again, "again")
    if again.count() <= SMALL_REVISITS:
        again = F.broadcast(again)
    rows = p.withColumn("d", F.sha1(payload)).join(again, ["id", "d"], "left").select("id", "url", "html", "to", "to_url")
    root = folder.rstrip("/") if folder else space.path("archives")
    out = space.save(rows.mapInArrow(lambda b: _write(b, root), "path string, records long, bytes long"), "manifest")
    space.keep("manifest")
    return out


def read_archives(archives: DataFrame) -> DataFrame:
    """The pages of WARC archives named by ``path``, read back from the files, digests checked."""
    spark = archives.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, date string, path string"
    return archives.select("path").repartition(tasks, "path").mapInArrow(_read, kind)
