"""WARC archives written from and read into tables, payloads as numbered chunks.

Writing compresses each record as a gzip member of its own and takes the payload in slices of the
column's buffer.  Reading streams every archive and makes one row per chunk of a payload, with the
number of bytes and the SHA-1 digest so far, so that no record is ever held whole.  The last chunk
of a record carries its totals.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quaero.llm.joins import join_counted
from quaero.sources.workdir import run_dir, staged


@dataclass(frozen=True)
class WarcParams:
    chunk_bytes: int = 1 << 18
    file_bytes: int = 1 << 28      # an archive is closed beyond this size
    min_bytes: int = 0             # smaller payloads are always written whole
    level: int = 6
    date: str = "2000-01-01T00:00:00Z"


def _open(path: str):
    """File system and path of a URI; ``s3a`` and plain paths are understood too."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(key: str | None, digest: str) -> str:
    """A URI that names a row by its key and payload, and from which both can be read."""
    return f"<urn:quaero:{'n' if key is None else 'k' + quote(key, safe='')}:{digest}>"


def key_of(uri: str | None) -> str | None:
    if not uri or not uri.startswith("<urn:quaero:k"):
        return None
    return unquote(uri.removeprefix("<urn:quaero:k").rpartition(":")[0])


class _Writer:
    """Archives of one task.  Names are fresh, so a repeated attempt never touches another's files."""

    def __init__(self, folder: str, params: WarcParams):
        self.p, self.folder = params, folder
        self.system, self.place = _open(folder)
        self.stream, self.name, self.size = None, "", 0

    def _roll(self) -> None:
        self.close()
        self.name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        self.system.create_dir(self.place, recursive=True)
        self.stream, self.size = self.system.open_output_stream(f"{self.place}/{self.name}", compression=None), 0
        info = b"software: quaero\r\nformat: WARC File Format 1.1\r\n"
        self._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                      ("Content-Type", "application/warc-fields")], info, None)

    def _record(self, fields: list[tuple[str, str]], head: bytes, payload: memoryview | None) -> None:
        z = zlib.compressobj(self.p.level, wbits=31)
        fields = [*fields, ("WARC-Date", self.p.date), ("Content-Length", str(len(head) + len(payload or b"")))]
        top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
        for part in (top.encode(), head, *(payload[i:i + self.p.chunk_bytes] for i in range(0, len(payload or b""), self.p.chunk_bytes)), b"\r\n\r\n"):
            self._put(z.compress(part))
        self._put(z.flush())

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def write(self, key, url, digest, payload: memoryview, refers: tuple | None) -> str:
        if self.stream is None or self.size > self.p.file_bytes:
            self._roll()
        fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(key, digest)),
                  ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
                  ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        if refers:
            fields += [("WARC-Refers-To", record_id(refers[0], digest)),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        self._record(fields, head, None if refers else payload)
        return f"{self.folder}/{self.name}"

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(pages: DataFrame, folder: str | None = None, params: WarcParams = WarcParams(), key: str = "page_id",
                   url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record per row; returns ``file, records``, the archives of the attempts that counted.

    Of rows with equal payloads of ``min_bytes`` or more, those with the smallest key are responses
    and the others revisits of it; null keys sort last.  A null payload is empty.  Repeated rows
    are records each, with equal ids.  Other columns are not read.  ``folder`` must be one that
    executors can write through Arrow's file systems; by default one under the shared folder.
    """
    p = params
    out = run_dir(pages.sparkSession, "warc")
    folder = folder or f"{out}/archives"
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), data.alias("data")).withColumn("digest", F.sha1("data"))
    order = F.struct(F.col("key").isNull().alias("none"), "key")
    narrow = staged(rows.filter(F.octet_length("data") >= p.min_bytes).select("key", "digest").distinct(), "keys", out)
    first = staged(narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first", out)
    again = join_counted(narrow, first, "digest", "n").filter(~F.col("key").eqNullSafe(F.col("first.key")))
    again = again.select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.struct("first.key").alias("refers"))
    todo = rows.join(again, F.expr("digest = _digest AND key <=> _key"), "left").select(
        F.col("key").cast("string").alias("key"), F.col("url").cast("string").alias("url"), "digest", "data",
        F.col("refers.key").cast("string").alias("to"), F.col("refers").isNotNull().alias("revisit"))

    def write(batches):
        writer = _Writer(folder, p)
        written: dict[str, int] = {}
        for batch in batches:
            keys, urls, digests, data, to, revisit = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                refers = (to[i].as_py(),) if revisit[i].as_py() else None
                body = memoryview(data[i].as_buffer())
                name = writer.write(keys[i].as_py(), urls[i].as_py(), base32(digests[i].as_py()), body, refers)
                written[name] = written.get(name, 0) + 1
        writer.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(written, pa.string()), "records": pa.array(written.values(), pa.int64())})

    return staged(todo.mapInArrow(write, "file string, records long"), "manifest", out)


def _fields(stream) -> dict[str, str]:
    """Lines ``name: value`` up to an empty one."""
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """(fields, chunk number, chunk, bytes so far, digest so far, is it the last) of an archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record starts with {line[:40]!r}")
            continue
        fields = _fields(stream)
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            block = _Counted(stream, left)
            block.readline()
            http = _fields(block)
            left -= block.used
            fields["http-length"] = http.get("content-length", "0")
        sha, size, number = hashlib.sha1(), 0, 0
        while True:
            chunk = stream.read(min(left, chunk_bytes))
            if left and not chunk:
                raise ValueError(f"record {fields.get('warc-record-id')} ends early")
            left -= len(chunk)
            size += len(chunk)
            sha.update(chunk)
            yield fields, number, chunk, size, base64.b32encode(sha.digest()).decode(), not left
            number += 1
            if not left:
                break


class _Counted:
    """Lines of a stream, counting bytes, not beyond a limit."""

    def __init__(self, stream, limit: int):
        self.stream, self.limit, self.used = stream, limit, 0

    def readline(self) -> bytes:
        line = self.stream.readline(self.limit - self.used)
        self.used += len(line)
        return line


_CHUNK = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("key", pa.string()),
    ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()),
    ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("intact", pa.bool_())])


def read_archives(files: DataFrame, params: WarcParams = WarcParams(), column: str = "file") -> DataFrame:
    """One row per chunk of each record in the archives that ``files`` names.

    ``record_id, chunk_no, chunk`` with ``bytes_so_far`` and ``digest_so_far`` (base 32 SHA-1); an
    empty payload has one empty chunk.  The ``last`` row of a record also has ``payload_bytes`` and
    ``payload_digest`` of the full payload, for a revisit those that its headers tell, and whether
    a response's payload is ``intact``, that is, has the digest of its header.  ``key`` and
    ``refers_to`` are the keys that `write_archives` put into the record ids, as strings.
    """
    p = params

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _open(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 16)
                    for f, number, chunk, size, digest, last in records(stream, p.chunk_bytes):
                        kind = f.get("warc-type")
                        told = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        again = kind == "revisit"
                        rows.append((
                            path, f.get("warc-record-id"), kind, f.get("warc-target-uri"), key_of(f.get("warc-record-id")),
                            key_of(f.get("warc-refers-to")), number, chunk, size, digest, last,
                            (int(f.get("http-length", 0)) if again else size) if last else None,
                            (told if again else digest) if last else None,
                            None if again or not last or told is None else told == digest))
                        held += len(chunk)
                        if held >= 1 << 22 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNK)], schema=_CHUNK)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNK)], schema=_CHUNK)

    schema = ("file string, record_id string, type string, url string, key string, refers_to string, chunk_no long, chunk binary, "
              "bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string, intact boolean")
    names = files.select(column)
    return names.repartition(max(1, names.count()), column).mapInArrow(read, schema)  # about a task per archive


def page_records(pages: DataFrame, params: WarcParams = WarcParams(), key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write ``pages`` and read them back: one row per record, ``key`` in its own type."""
    files = write_archives(pages, None, params, key, payload=payload)
    kind = pages.schema[key].dataType
    return read_archives(files, params).filter("last AND type IN ('response', 'revisit')").select(
        F.col("key").cast(kind).alias("key"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"), "intact")
