"""Packing documents into sequences: shortest-pack-first over the length histogram.

1. Each text becomes ids and the end id; documents are cut into pieces of at most
   ``size`` ids, all full but the last. Pieces are written once.
2. The driver gets the histogram of piece lengths, at most ``size`` numbers, and packs
   it longest lengths first, always into the shortest open pack that fits, updating
   counts of packing patterns rather than packs.
3. Patterns become slots: for a length, ranks ``first .. first + count`` lie at one
   offset of consecutive sequences. Pieces get a rank within their length, counted by
   slices of the hash range so that a common length isn't gathered, and look their
   slot up by binary search.

What is broadcast is the slot table, bounded by ``size`` and not by the data. Sequences
are padded to ``size``, except those whose fill is a power of two (``padded_to``). A
null or empty text is the end id alone. Rows that repeat an id are packed each. Ids
are whole numbers of 64 bits; others raise. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, per_process, ranked, released, settings, small_batches, written
from tessera.llm.tokens import load_encoder

SIZE = 1024
END_ID = 0
SEED = 17
PIECE_SCHEMA = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _pieces(tokenizer: str, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_process(f"encoder {tokenizer}", lambda: load_encoder(tokenizer))
        for batch in batches:
            owner, start, length, crc, total, kept = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                (ids,) = encode([text.as_py() or ""])  # one text's ids at a time: as Python numbers they are large
                data = np.asarray([*ids, end_id], dtype="<u4").tobytes()
                n = len(data) // 4
                for at in range(0, n, size):
                    part = data[4 * at : 4 * (at + size)]
                    owner.append(doc_id)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if keep_ids:
                        kept.append(part)
            columns = [pa.array(owner, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents; ``ids`` holds little-endian unsigned 32-bit ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(_pieces(tokenizer, size, end_id, keep_ids)), PIECE_SCHEMA + (", ids binary" if keep_ids else ""))


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of packing patterns, worst fit on decreasing lengths."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # by room left: [count, lengths]
    full: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left > 0:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                count, lengths, after = left, (length,), size - length
            else:
                found, before = open_packs[room].pop()
                count, lengths, after = min(left, found), (*before, length), room - length
                if found > count:
                    open_packs[room].append([found - count, before])
            left -= count
            if after == 0:
                full.append((count, lengths))
            else:
                open_packs[after].append([count, lengths])
    return full + [(count, lengths) for room in sorted(open_packs) for count, lengths in open_packs[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, first sequences, offsets and padded sizes of its slots."""
    table: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        fill, offset = sum(lengths), 0
        padded = fill if fill & (fill - 1) == 0 else size
        for length in lengths:
            table[length].append((used[length], sequence, offset, padded))
            used[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for length, rows in table.items()}


def _place(table: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            found = np.zeros((3, len(length)), dtype=np.int64)
            for value in np.unique(length):
                own = length == value
                first, sequence, offset, padded = table[int(value)]
                at = np.searchsorted(first, rank[own], side="right") - 1
                found[:, own] = sequence[at] + rank[own] - first[at], offset[at], padded[at]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *map(pa.array, found)], [*kept, "sequence_id", "offset", "padded_to"])

    return run


def pack(parts: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and ``padded_to``. ``parts`` must be a written table.

    Ids, where they are kept, don't travel while pieces are ranked: they join the placed
    pieces by the piece's number, one shuffle.
    """
    if "ids" in parts.columns:
        placed = pack(parts.drop("ids"), size, seed)
        ids = parts.select(F.col("piece").alias("i_piece"), "ids")
        return placed.join(ids, F.col("piece") == F.col("i_piece")).select(*parts.columns, "sequence_id", "offset", "padded_to")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(pack_histogram(histogram, size), size)
    rows = parts.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "start"))
    rows = ranked(rows, ["length"], "order", bucket_count(sum(histogram.values()))).drop("order")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    rows = rows.select(*parts.columns, F.col("rank").cast("bigint").alias("rank"))
    return rows.mapInArrow(released(_place(table)), f"{schema}, sequence_id long, offset long, padded_to long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, **options: object) -> DataFrame:
    """Documents straight to placed pieces."""
    with settings(docs.sparkSession, small_batches()):
        parts = pieces(docs, tokenizer, size=size, **options)
        if "ids" in parts.columns:
            parts = parts.withColumn("piece", F.monotonically_increasing_id())
        parts = written(parts, "pieces", "zstd")  # half of an id's bytes are mostly zero
    return pack(parts, size).drop("piece")
