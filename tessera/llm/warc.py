"""WARC archives: written with an index, read by coalesced byte ranges of selected records.

Writing: one gzip member a record, and for each record an index row with archive,
offset, length, URL and payload digest. Of records with equal payloads, the one with
the largest id is a response and the others are revisits that refer to it; payloads
below ``revisit_bytes`` are always responses. Payloads are compared by SHA-256, and
travel once, dealt by id, so a payload that many pages share makes no hot task.
Archives of lost attempts have no index rows and are never read.

Reading: selected index rows are sorted by archive and offset, neighbours no more than
``GAP`` apart are read together up to ``SPAN``, and each record's payload is checked
against its digest.

A null payload is empty; a null URL has no target header. Rows that repeat an id and
payload: the first is the response if the id is the largest, the others revisit it. A
null id counts below all others. An empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import open_store, shared_dir

ARCHIVE_BYTES = 128 << 20
SPAN = 8 << 20
GAP = 64 << 10
BLOCK = 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = (("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()))
INDEX_SCHEMA = "archive string, offset long, length long, url string, digest string, page_id long"
RECORDS = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()))
RECORDS_SCHEMA = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, repeat: int = 0) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}" + (f":{repeat}" if repeat else "") + ">"


def _page(urn: str) -> int | None:
    found = urn.strip("<>").split(":")[2]
    return int(found) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, head: int | None, revisit: bool, repeat: int = 0) -> bytes:
    """One gzip-compressed record. The URL's controls and spaces are percent-encoded in its header."""
    digest = payload_digest(payload)
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id, repeat)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if revisit:
        lines[4:4] = [f"WARC-Refers-To: {_urn(head)}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


#: Characters of a URL that stay as they are in a header: all visible ASCII.
SAFE = "".join(map(chr, range(0x21, 0x7F)))


def parse(data: bytes) -> dict[str, object]:
    """Headers by lower-case name, ``block`` and ``payload`` of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    found: dict[str, object] = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(found["content-length"])]
    found |= {"block": block, "payload": block.partition(b"\r\n\r\n")[2]}
    return found


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _writer(folder: str, revisit_bytes: int, archive_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        sink, name, offset, last, repeat = None, "", 0, None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, key, head in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "key", "head")), strict=True):
                page_id, url, payload, head = page_id.as_py(), url.as_py(), payload.as_py(), head.as_py()
                same = (page_id, key.as_py())
                repeat, last = (repeat + 1 if same == last else 0), same
                revisit = len(payload) >= revisit_bytes and (page_id != head or repeat > 0)
                if sink is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{at}/{name}", compression=None)
                data = record(page_id, url, payload, head, revisit, repeat)
                sink.write(data)
                rows.append((name, offset, len(data), url, payload_digest(payload), page_id))
                offset += len(data)
                if offset >= archive_bytes:
                    sink.close()
                    sink = None
            yield _batch(rows, INDEX)
        if sink is not None:
            sink.close()

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives below ``folder``; returns their index, written beside them."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("place", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    heads = rows.groupBy("key").agg(F.max("page_id").alias("head"))
    heads = rows.select("place", "key").distinct().join(heads, "key")
    dealt = rows.repartition("place", "key").join(heads, ["place", "key"]).sortWithinPartitions("place", "key")
    index = dealt.select("page_id", "url", "payload", "key", "head").mapInArrow(_writer(folder, revisit_bytes, archive_bytes), INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _reader(folder: str, span: int, gap: int, payloads: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        name, source = None, None

        def fetch(group: list[tuple]) -> pa.RecordBatch:
            nonlocal name, source
            archive, first = group[0][0], group[0][1]
            if archive != name:
                if source is not None:
                    source.close()
                name, source = archive, store.open_input_file(f"{at}/{archive}")
            data = source.read_at(group[-1][1] + group[-1][2] - first, first)
            rows = []
            for _, offset, length, url, digest in group:
                found = parse(data[offset - first : offset - first + length])
                revisit = found["warc-type"] == "revisit"
                stated = found["warc-payload-digest"].removeprefix("sha1:")
                if stated != digest or not revisit and payload_digest(found["payload"]) != digest:
                    raise ValueError(f"{archive} at {offset}: the payload's digest differs")
                size = int(found["x-payload-length"]) if revisit else len(found["payload"])
                refers = _page(found["warc-refers-to"]) if revisit else None
                rows.append((_page(found["warc-record-id"]), url, found["warc-type"], refers, stated, size, found["payload"] if payloads else None))
            return _batch(rows, RECORDS)

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length", "url", "digest")), strict=True):
                if group and (row[0] != group[-1][0] or row[1] - group[-1][1] - group[-1][2] > gap or row[1] + row[2] - group[0][1] > span):
                    yield fetch(group)
                    group = []
                group.append(row)
        if group:
            yield fetch(group)

    return run


def read_warc(index: DataFrame, folder: str, span: int = SPAN, gap: int = GAP, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows; ``payload`` is null in revisits' bodies and, without ``payloads``, everywhere."""
    block = F.floor(F.col("offset") / F.lit(BLOCK))
    rows = index.select("archive", "offset", "length", "url", "digest").repartition("archive", block).sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(_reader(folder, span, gap, payloads), RECORDS_SCHEMA)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All pages written, and all records read back through the index."""
    folder = shared_dir(spark, "warc")
    return read_warc(write_warc(pages, folder), folder, payloads=False)
