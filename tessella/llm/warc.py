"""WARC archives, index first: write records with an index of their places, then read the selected ones back in
coalesced byte ranges.

One task writes one archive under a name of its own attempt; each record is a gzip member, so it can be read alone. The
index (path, offset, length, url, digest) is a written table. A reader task sorts its share of the index by path and
offset and joins neighbouring ranges, so that many records cost one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, new_path, written

DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, path string, offset long, length long, url string, digest string, record_type string, refers_to long"
#: A gap that is read over, and the most bytes of a joined read (a larger record is read alone).
GAP, MOST = 64 << 10, 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~-._ ''')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record, checked: lengths, and for a response the digest of its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    number = lambda urn: None if urn == "<urn:page:null>" else int(urn[10:-1])
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload": payload, "payload_bytes": size, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None}
    if out["record_type"] == "response" and (len(payload) != size or digest(payload) != out["payload_digest"]):
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the index.

    Of equal payloads (null: empty) of at least ``least`` bytes that with the smallest id is a response, the others
    revisit it; if rows repeat that id, each is a response. A null id comes last, and a null-id row is a revisit only if
    another id has its payload. An empty table makes no archive. Payloads count as equal if SHA-1, SHA-256 and length are.
    """
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = bounded_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    keyed = rows.withColumn("sha", F.concat(F.sha1("body"), F.sha2("body", 256), F.length("body").cast("string")))
    counted = keyed.where(F.length("body") >= least).groupBy("sha").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    first = written(counted.where("n > 1").select(F.col("sha").alias("__sha"), "least"), "warc-first")
    marked = keyed.join(first, F.col("sha") == F.col("__sha"), "left")
    refers = F.when(F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.col("page_id")), F.col("least"))
    marked = marked.select("page_id", "url", "body", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        out, at, path = None, 0, ""
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            index = []
            for page, url, body, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                payload = body.as_py()
                sha1 = digest(payload)
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = zipped.compress(record(page, url, payload, sha1, refers_to)) + zipped.flush()
                out.write(member)
                index.append((page, path, at, len(member), url, sha1, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            if index:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names)
        if out is not None:
            out.close()

    return written(marked.mapInArrow(write, INDEX), "warc-index")


def spans(places: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[int]]]:
    """Joins sorted (offset, length) places to reads: start, end, and which places each holds."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, n) in enumerate(places):
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= most:
            start, end, held = out[-1]
            out[-1] = start, max(end, at + n), [*held, i] if not held else (held.append(i) or held)
        else:
            out.append((at, at + n, [i]))
    return out


def read_records(index: DataFrame, select: Column | None = None, payloads: bool = False) -> DataFrame:
    """The records that ``select`` (over the index's columns) picks: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with ``payloads`` the bytes of responses (of revisits null).

    One row per record, in any order; a null id comes back null, repeated ids have a row each, an empty index gives none.
    A very large record is read alone. Only the index's own columns are read.
    """
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [x.split()[0] for x in shape.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        path, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            while rows:
                n = next((i for i, r in enumerate(rows) if r[0] != rows[0][0]), len(rows))
                if rows[0][0] != path:
                    path = rows[0][0]
                    if file is not None:
                        file.close()
                    store, place = fs.FileSystem.from_uri(path)
                    file = store.open_input_file(place)
                mine, rows = rows[:n], rows[n:]
                for start, end, held in spans([r[1:] for r in mine]):
                    raw, out = file.read_at(end - start, start), []
                    for i in held:
                        a = mine[i][1] - start
                        got = parse(zlib.decompress(raw[a : a + mine[i][2]], 31))
                        out.append(tuple(got[c] if c != "payload" or got["record_type"] == "response" else None for c in names))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if file is not None:
            file.close()

    chosen = (index.where(select) if select is not None else index).select("path", "offset", "length")
    # a file's records in pieces of 8 MB, so that a large archive is read by many tasks; a fixed number of partitions, as
    # the index's few bytes say nothing of what its rows make a task read
    many = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = chosen.repartition(many, "path", F.floor(F.col("offset") / MOST)).sortWithinPartitions("path", "offset")
    return chosen.mapInArrow(read, shape)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, **columns: str) -> DataFrame:
    """Writes all rows as records and reads each back: one row per input row."""
    return read_records(write_archives(pages, folder or new_path(pages.sparkSession, "warc"), least, **columns))
