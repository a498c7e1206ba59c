"""WARC archives: writing, normalising whole-file gzip streams, reading by index.

``write_archives`` writes each task's records as one gzip stream (no record can
be reached without inflating all before it).  ``normalise`` inflates such a file
once, as a stream, writes every record as a gzip member of its own and a sidecar
index of (offset, length, record id, type) beside the archive.  ``read_archives``
fetches members by that index.  Files go to the shared folder by the file system
its address names and are moved to their final name when whole.  Only files that a finished task has
listed are read further, so what an interrupted attempt leaves does no harm.

Null payloads are empty.  A page whose payload of at least ``least`` bytes also
belongs to a page with a smaller id becomes a revisit of the smallest one; rows
repeating that smallest id are responses too.  Rows with a null id are always
responses and no page refers to them.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship
from .mixing import ordinals

#: Payloads below this many bytes are never replaced by a revisit.
LEAST = 100
#: Inflated bytes after which a task starts a further archive.
ROLL = 64 << 20
BLOCK = 1 << 20
#: Revisits up to which their table (ids and digests, 100 bytes a row) is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of payloads after which a batch of records that were read is handed on.
HELD = 16 << 20
DATE = "2024-01-01T00:00:00Z"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class _Output:
    """A file under a passing name until it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.passing = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.stream = self.fs.open_output_stream(self.passing, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.passing, self.path)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit carries no payload but the full one's length and digest."""
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)


def records(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a gzip stream with one member or many, inflating as it goes."""
    inflate, held = zlib.decompressobj(31), bytearray()
    packed, need, done = b"", 0, False
    while not done:
        packed = packed or read(BLOCK)
        done = not packed
        if packed:
            held += inflate.decompress(packed)
            packed = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        while len(held) >= max(need, 4):
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            fields = parse(bytes(held[:end]))
            need = end + 4 + int(fields["Content-Length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write rows (page_id, url, html, size, digest, record_type, refers_to); returns (path, n) of whole-stream archives."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run_id, number, out, raw, n = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out, number, raw, n
            out.write(gz.flush())
            out.close()
            done.append((path, n))
            out, number, raw, n = None, number + 1, 0, 0

        for b in batches:
            for at in range(0, b.num_rows, 512):
                for r in b.slice(at, 512).to_pylist():
                    if out is None:
                        path = f"{folder}/raw/part-{part:05d}-{run_id}-{number:03d}.warc.gz"
                        out, gz = _Output(path), zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["size"], r["digest"], r["record_type"], r["refers_to"])
                    out.write(gz.compress(data))
                    raw, n = raw + len(data), n + 1
                    if raw >= roll:
                        close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n": pa.array([d[1] for d in done], pa.int64())}, schema=pa.schema([("path", pa.string()), ("n", pa.int64())]))

    return pages.mapInArrow(run, "path string, n long")


def normalise_file(path: str, target: str) -> int:
    """Inflate once; a member per record; index beside the target.  Returns the number of records."""
    files, at = _fs(path)
    out, index, n = _Output(target), _Output(f"{target}.idx"), 0
    with files.open_input_stream(at, compression=None) as stream:
        for fields, data in records(stream.read):
            gz = zlib.compressobj(4, zlib.DEFLATED, 31)
            member = gz.compress(data) + gz.flush()
            index.write(json.dumps([out.size, len(member), fields["WARC-Record-ID"], fields["WARC-Type"]]).encode() + b"\n")
            out.write(member)
            n += 1
    index.close()
    out.close()
    return n


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, n) of the normalised archives of ``archives``; each is one task's work."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                target = f"{folder}/normal/{posixpath.basename(path)}"
                yield pa.RecordBatch.from_pydict({"path": [target], "n": [normalise_file(path, target)]})

    return archives.select("path").mapInArrow(run, "path string, n long")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record, fetched by the sidecar index: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are computed from the payload and must equal the recorded ones."""
    ship(archives.sparkSession)
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(name: str) -> int | None:
        return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", name)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                files, at = _fs(path)
                with files.open_input_stream(f"{at}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows: list[dict] = []
                held = 0
                with files.open_input_file(at) as f:
                    for offset, length, _, kind in index:
                        f.seek(offset)
                        member = iter((f.read(length), b""))
                        ((head, whole),) = records(lambda _, m=member: next(m))
                        payload = whole[-4 - int(head["Content-Length"]) : -4]
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path} at {offset}: the payload isn't the one that was written")
                        rows.append({"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("WARC-Refers-To", ""))})
                        held += len(payload)
                        if len(rows) >= 1000 or held >= HELD:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return archives.select("path").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def record_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html, size, digest, record_type, refers_to: which record each page becomes."""
    body = F.coalesce(pages[html].cast("string"), F.lit(""))
    base = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    # The bodies stay where they are: ids and digests decide, and only the ids of revisits come back.
    big = base.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    # Written, so that the join may split the ids of a frequent body: an aggregate's own shuffle can't be split.
    first = cut(big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).filter("m > 1").select("digest", "first"), "first", small=True)
    revisits = cut(big.join(first, "digest").filter("page_id > first").distinct(), "revisits", small=True)
    joined = base.join(F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits, ["page_id", "digest"], "left")
    again = F.col("first").isNotNull()
    return joined.select("page_id", "url", F.when(again, None).otherwise(F.col("html")).alias("html"), "size", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _one_a_task(archives: DataFrame, n: int) -> DataFrame:
    """One archive a task, by place: a hash of few paths leaves tasks empty and others with several archives."""
    return ordinals(archives, "path", "_n").repartitionById(n, F.col("_n").cast("int")).drop("_n")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, folder: str | None = None) -> DataFrame:
    """Write the pages as whole-stream archives, normalise these, and read the normalised ones back."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/millrace/warc-{uuid.uuid4().hex}"
    raw = cut(write_archives(record_types(pages, key, url, html, least), folder), "raw", small=True)
    n = max(1, raw.count())
    normal = cut(normalise(_one_a_task(raw, n), folder), "normal", small=True)
    return read_archives(_one_a_task(normal, n))
