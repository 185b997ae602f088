"""Media columns: payloads stored in archive files, and a data source that reads them by byte range.

``write_archives`` stores each payload as an 8-bit greyscale PNG (``WIDTH`` samples a
row) in ZIP archives below a shared folder and writes a manifest of the archives that
committed tasks made; archives of lost attempts aren't listed and so never read.

The ``media_archive`` source plans ranges (archive, first byte, last byte) of
``RANGE_BYTES`` from sizes alone, and puts several into a partition where a read would
have more than ``MAX_RANGES`` partitions. The driver reads the manifest for that, a row an
archive, and lists each range once. For each range a task reads the archive's directory,
takes the members whose header begins in it, streams them as Arrow batches of at most ``BATCH_BYTES``, and
retries each member alone at its offset. A member that can't be read after
``RETRIES`` attempts gives a row with its error and a null payload; others go on.

Null ids and texts are kept (a null text is an empty payload); repeated rows are
members of their own; an empty table makes no archive and gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.llm.common import open_store, settings, shared_dir, small_batches

WIDTH = 576
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
MAX_RANGES = 100_000
BATCH_BYTES = 8 << 20
RETRIES = 3
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 255 up to a positive multiple of the unit. UTF-8 has no such byte, so the padding can be told apart."""
    n = max(unit, -(-len(data) // unit) * unit)
    return data + b"\xff" * (n - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """One sample a byte, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = np.zeros((len(rows), width + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG with unfiltered rows; checks every chunk."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, packed = 8, 0, 0, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        made, archive, sink, name, members, size = [], None, None, "", 0, 0

        def close() -> None:
            archive.close()
            sink.close()
            made.append((name, members, store.get_file_info(f"{at}/{name}").size))

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    name, members, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    sink = store.open_output_stream(f"{at}/{name}", compression=None)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                image = encode_png(padded(data.as_py() or b""))
                archive.writestr(zipfile.ZipInfo(f"{members:09d}-{'' if doc_id is None else doc_id}.png"), image)
                members, size = members + 1, size + len(image)
                if size >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "members", "bytes"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all rows' payloads below ``folder``, with their manifest."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    with settings(docs.sparkSession, small_batches()):
        rows.mapInArrow(_write(folder, archive_bytes), "archive string, members long, bytes long").write.parquet(f"{folder}/_manifest")


class ByteRanges(InputPartition):
    """One task's ranges, each (archive, first byte, last byte)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRanges]:
        """One row for each archive is read here, never a member's."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, at = open_store(self.folder)
        if store.get_file_info(f"{at}/_manifest").type == fs.FileType.Directory:
            listed = pq.read_table(f"{at}/_manifest", filesystem=store, columns=["archive", "bytes"]).to_pylist()
            sizes = [(r["archive"], r["bytes"]) for r in listed]
        else:
            sizes = [(x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".zip")]
        ranges = [(name, a, min(a + self.range_bytes, size)) for name, size in sorted(sizes) for a in range(0, size, self.range_bytes)]
        each = max(1, -(-len(ranges) // MAX_RANGES))
        return [ByteRanges(ranges[i : i + each]) for i in range(0, len(ranges), each)] or [ByteRanges([])]

    def member(self, source, entry: zipfile.ZipInfo) -> bytes:
        """A member's bytes, from its own offset; checks length and CRC."""
        source.seek(entry.header_offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError("no member header at the offset")
        source.seek(sum(struct.unpack_from("<HH", head, 26)), io.SEEK_CUR)
        data = source.read(entry.compress_size)
        if entry.compress_type == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        if len(data) != entry.file_size or zlib.crc32(data) != entry.CRC:
            raise OSError("damaged member")
        return data

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for archive, start, end in partition.ranges:
            yield from self.read_range(archive, start, end)

    def read_range(self, name: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        store, at = open_store(self.folder)
        path = f"{at}/{name}"
        source = store.open_input_file(path)
        with zipfile.ZipFile(source) as archive:
            entries = sorted((e for e in archive.infolist() if start <= e.header_offset < end), key=lambda e: e.header_offset)
        source = store.open_input_file(path)
        rows, size = [], 0
        for entry in entries:
            data, error = None, None
            for _ in range(self.retries):
                try:
                    data, error = self.member(source, entry), None
                    break
                except (OSError, zlib.error, struct.error) as failed:
                    error = str(failed) or type(failed).__name__
                    source.close()
                    source = store.open_input_file(path)
            rows.append((name, entry.header_offset, entry.filename, data, error))
            size += len(data or b"")
            if size >= self.batch_bytes:
                yield self.batch(rows)
                rows, size = [], 0
        source.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("error", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options ``rangeBytes``, ``batchBytes``, ``retries``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Rows ``(archive, offset, member, media, error)``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def features(samples: np.ndarray) -> str:
    """Shape, mean, spread, entropy and row-to-row change of an image, as text."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    share = counts[counts > 0] / samples.size
    value = np.arange(256.0)
    mean = float((counts * value).sum()) / samples.size
    spread = float(np.sqrt((counts * (value - mean) ** 2).sum() / samples.size))
    entropy = float(-(share * np.log2(share)).sum())
    change = int(np.abs(np.diff(samples.astype(np.int16), axis=0)).sum()) / samples.size
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f};change={change:.4f}"


MEASURES = (
    ("doc_id", pa.int64()),
    ("n_bytes", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()),
    ("feature", pa.string()),
)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for member, media, error in zip(batch.column("member").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
            if error is not None:
                raise OSError(f"{member}: {error}")
            data = media.as_py()
            samples = decode_png(data)
            payload = samples.tobytes()
            owner = member.partition("-")[2].removesuffix(".png")
            rows.append(
                (
                    int(owner) if owner else None,
                    len(payload.rstrip(b"\xff")),
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]),
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    features(samples),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(MEASURES)], [n for n, _ in MEASURES])


def measured(media: DataFrame) -> DataFrame:
    """Digests and features of stored payloads, decoded from the stored bytes; a member's error raises."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("member", "media", "error").mapInArrow(_measure, schema)


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored and measured from what was read back."""
    folder = shared_dir(docs.sparkSession, "media")
    write_archives(docs, folder, id_col, text_col)
    return measured(read_archives(docs.sparkSession, folder))
