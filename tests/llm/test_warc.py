import base64
import gzip
import hashlib
import io
import random
from collections import Counter
from pathlib import Path

import pytest
from quaero.llm import queries, warc
from quaero.llm.warc import WarcParams

PAGES = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want(rows, least=0):
    """(id, bytes, digest, type, refers) of each row."""
    out = []
    for i, _, html in rows:
        size = len((html or "").encode())
        same = [k for k, _, h in rows if (h or "") == (html or "")]
        first = min((k for k in same if k is not None), default=None)
        again = size >= least and i != first
        out.append((i, size, digest(html), "revisit" if again else "response", first if again else None))
    return Counter(out)


def got(df):
    return Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(i, f"http://h/{i} ü\r\nX: y", r.choice(["", "<p>é漢</p>", "x" * 70_001, None, "\r\n\r\nWARC/1.1\r\n", f"only {i}"])) for i in range(60)]
    return out + [(5, "http://other", "only 5"), (None, None, "x" * 70_001), (None, "u", "none else"), (7, None, "WARC/1.1")] + [out[3]]


@pytest.mark.parametrize("p", [WarcParams(), WarcParams(chunk_bytes=1000, file_bytes=20_000, min_bytes=6)])
def test_round_trip(make, rows, p):
    pages = make(rows, PAGES)
    df = warc.page_records(pages, p)
    assert got(df) == want(rows, p.min_bytes)
    assert {r.intact for r in df.collect() if r.record_type == "response"} == {True}


def test_chunks_carry_running_digests(make, rows, folder):
    p = WarcParams(chunk_bytes=1000)
    files = warc.write_archives(make(rows, PAGES), f"{folder}/out", p)
    chunks = warc.read_archives(files, p).filter("type = 'response'").collect()
    assert max(len(c.chunk) for c in chunks) <= 1000
    html = {(k, digest(h)): (h or "").encode() for k, _, h in rows}
    by = {}
    for c in chunks:
        by.setdefault((c.file, c.record_id), {}).setdefault(c.chunk_no, c)
    for (_, uri), parts in by.items():
        first = parts[max(parts)]
        body = html[first.key and int(first.key), first.payload_digest]
        assert b"".join(parts[i].chunk for i in range(len(parts))) == body
        for i, c in parts.items():
            upto = body[:(i + 1) * 1000]
            assert c.bytes_so_far == len(upto) and c.last == (len(upto) == len(body))
            assert c.digest_so_far == base64.b32encode(hashlib.sha1(upto).digest()).decode()
    assert sum(r.records for r in files.collect()) == len(rows)
    for f in Path(folder, "out").glob("*.warc.gz"):  # a plain reading of the format
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_plain_archives_are_read_and_broken_ones_refused(spark, folder):
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n"
    Path(folder, "a.warc").write_bytes(head % 5 + b"hello\r\n\r\n" + head % 0 + b"\r\n\r\n")
    found = warc.read_archives(spark.createDataFrame([(f"{folder}/a.warc",)], "file string")).collect()
    assert [(r.type, r.chunk, r.payload_bytes) for r in found] == [("resource", b"hello", 5), ("resource", b"", 0)]
    stream = io.BufferedReader(io.BytesIO(head % 50 + b"short"))
    with pytest.raises(ValueError):
        list(warc.records(stream, 10))


def test_registered_query(spark):
    found = queries.op5_warc(spark, "/root/testdata/sf0.001").withColumnRenamed("page_id", "key")
    pages = queries.table(spark, "/root/testdata/sf0.001", "pages").collect()
    assert got(found) == want([(r.page_id, r.url, r.html) for r in pages])


def test_empty_table(make):
    assert warc.page_records(make([], PAGES)).count() == 0
