"""Hard-negative mining: a Voronoi-partitioned, exact nearest-neighbour join.

A row's score for an anchor is the inner product of their whole-number vectors. Vectors
are norm-augmented, ``x -> (x, sqrt(M^2 - |x|^2))`` with ``M`` the largest norm and
anchors ``q -> (q, 0)``, so that higher inner products are smaller Euclidean distances
and the triangle inequality holds.

1. ``PIVOTS`` rows, those with the smallest seeded hashes, are pivots; every row goes to
   the cell of its nearest pivot, every anchor to the group of its nearest pivot.
2. Home join: candidates of a cell meet the anchors of the same group. Each anchor's
   best scores there are a floor under its final ones.
3. Bounds by group, one row a pivot: between which distances from the pivot a candidate
   must lie to enter the results of any of the group's anchors. A candidate is replicated
   only to groups that it might serve, and meets their anchors.
4. What both joins found is merged by rank.

This runs twice: for the positives (same label, best ``n_positives``), and for the negatives
(other labels, with a window of scores for each positive). Both joins are exact; bounds only
spare work, and are widened by ``SLACK`` against rounding.

Rows travel as tiles: matrices of up to ``TILE`` candidates of a cell, made where they are read
and written once for all joins, and of up to ``BLOCK`` anchors of a group, dealt by group and salt so that a group that holds much
of the table is many tiles. Spark joins the tiles of a group, and its adaptive skew join
splits a hot one; a task computes one pair of tiles at a time. What is broadcast is bounded:
pivots, and a row of bounds for each. Where vectors lie so that bounds spare nothing, as
random ones of many dimensions do, the work is anchors times candidates.

A null or non-finite component, a null vector or a null label leaves a row out. A null id is
a candidate, after others of its score, and no anchor. Rows that repeat an id are candidates
of their own; "other" rows have another id; anchor rows alike in id, label and vector are one
anchor, others of that id are further anchors. Shorter vectors count as padded with zeros.
A score beyond a 64-bit integer counts as its largest or smallest value. Empty tables, and
tables without anchors, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import settings, written

PIVOTS = 32
TILE, BLOCK = 1_024, 128
SALT_ROWS = 2_000  # anchors of a salt, all groups together
PAIRS_PER_BATCH = 16  # of tiles, in an Arrow batch
SLACK = 1e-6  # of the largest distance
SEED = 29
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # no floor, no ceiling; MOST also orders a null id last
EXACT = 2.0**53

TILE_FIELDS = pa.schema([("cell", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())])
TILE_SCHEMA = "cell int, width int, ids binary, known binary, labels binary, kind string, vectors binary"
SERVING_FIELDS = pa.schema([*TILE_FIELDS, ("group", pa.int32()), ("serves", pa.binary())])
SERVING_SCHEMA = f"{TILE_SCHEMA}, group int, serves binary"
BLOCK_FIELDS = pa.schema([("group", pa.int32()), ("q_width", pa.int32()), ("q_ids", pa.binary()), ("q_rows", pa.binary()), ("q_labels", pa.binary()), ("q_kind", pa.string()), ("q_vectors", pa.binary()), ("q_low", pa.binary()), ("q_high", pa.binary())])
BLOCK_SCHEMA = "group int, q_width int, q_ids binary, q_rows binary, q_labels binary, q_kind string, q_vectors binary, q_low binary, q_high binary"
FOUND_FIELDS = pa.schema([("anchor", pa.int64()), ("anchor_row", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64())])
FOUND_SCHEMA = "anchor long, anchor_row long, slot int, score long, found_id long"
KEY = ["anchor", "anchor_row", "slot"]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, shorter ones padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(column.value_lengths())
    found = np.zeros((len(size), int(size.max(initial=0))))
    found[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return found


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256) -> DataFrame:
    """``(vec_id, label, vector, norm2)`` of the rows that take part, a component x as floor(scale * x), written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(matrix(batch.column(2)) * scale)
            keep = np.isfinite(values).all(axis=1)
            values = values[keep]
            lists = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))
            ids, labels = (batch.column(i).filter(pa.array(keep)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array((values * values).sum(axis=1))], ["vec_id", "label", "vector", "norm2"])

    own = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    return written(own.mapInArrow(run, "vec_id long, label long, vector array<double>, norm2 double"), "negatives-vectors")


@dataclass
class Cells:
    """Pivots in the augmented space."""

    pivots: np.ndarray
    norm2: float  # the largest

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of each row to each pivot; ``extra`` is the rows' last coordinate."""
        p = self.pivots
        w = min(x.shape[1], p.shape[1])
        square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2.0 * (x[:, :w] @ p[:, :w].T) + (extra[:, None] - self.augmented(p)[None]) ** 2
        return np.sqrt(np.maximum(0.0, square))


def cells_of(vectors: DataFrame, pivots: int = PIVOTS) -> Cells:
    """Distinct vectors of rows with the smallest hashes, and the largest norm. At most four times ``pivots`` rows are fetched."""
    norm2 = vectors.agg(F.max("norm2")).first()[0]
    rows = vectors.orderBy(F.xxhash64(F.lit(SEED), "vec_id", "vector"), "vec_id").select("vector").limit(4 * pivots).collect()
    distinct = list(dict.fromkeys(tuple(r[0]) for r in rows))[:pivots]
    width = max(map(len, distinct), default=0)
    return Cells(np.array([[*v, *[0.0] * (width - len(v))] for v in distinct]).reshape(len(distinct), width), float(norm2 or 0.0))


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers below 2^24 are exact in 32 bits."""
    kind = "<f4" if np.abs(x).max(initial=0.0) < 1 << 24 else "<f8"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def candidate_tiles(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Tiles of the candidates of a cell, each in order of id."""

    def tile(cell: int, parts: list) -> list:
        ids, known, labels, x = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(np.where(known, ids, MOST), kind="stable")  # so that ties are in order of id
        return [cell, x.shape[1], ids[order].tobytes(), known[order].tobytes(), labels[order].tobytes(), *_packed(x[order])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            x = matrix(batch.column(2))
            known = ~np.asarray(batch.column(0).is_null())
            ids, labels = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cell = cells.distances(x, cells.augmented(x)).argmin(axis=1)
            for c in np.unique(cell):
                chosen = np.flatnonzero(cell == c)
                for at in range(0, len(chosen), TILE):
                    own = chosen[at : at + TILE]
                    parts = held.setdefault((int(c), x.shape[1]), [])
                    parts.append((ids[own], known[own], labels[own], x[own]))
                    if sum(len(p[0]) for p in parts) >= TILE:
                        yield _batch([tile(int(c), held.pop((int(c), x.shape[1])))], TILE_FIELDS)
        for (c, _), parts in held.items():
            yield _batch([tile(c, parts)], TILE_FIELDS)

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, TILE_SCHEMA)


def replicated(tiles: DataFrame, cells: Cells, bounds: dict[int, tuple[float, float]]) -> DataFrame:
    """Each tile once for every other group that some of its candidates might serve; ``serves`` tells which ones, a byte each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = SLACK * (1.0 + np.sqrt(cells.norm2))
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.slice(i, 1).to_pylist()[0]
                x = _unpacked(t["kind"], t["vectors"], len(t["known"]), t["width"])
                far = cells.distances(x, cells.augmented(x))
                for group, (low, high) in bounds.items():
                    # a distance that isn't a number is never out of bounds
                    serves = ~(far[:, group] < low - slack) & ~(far[:, group] > high + slack)
                    if group != t["cell"] and serves.any():
                        yield _batch([[*(t[f.name] for f in TILE_FIELDS), group, serves.tobytes()]], SERVING_FIELDS)

    return tiles.mapInArrow(run, SERVING_SCHEMA)


def _batch(rows: list, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def placed_anchors(anchors: DataFrame, cells: Cells) -> DataFrame:
    """Adds each anchor's group and its distance to the group's pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = cells.distances(x := matrix(batch.column("vector")), np.zeros(len(x)))
            group = far.argmin(axis=1)
            columns = [*batch.columns, pa.array(group.astype(np.int32)), pa.array(far[np.arange(len(x)), group])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "group", "radius"])

    return anchors.mapInArrow(run, "anchor long, anchor_row long, label long, vector array<double>, norm2 double, group int, radius double")


def anchor_blocks(anchors: DataFrame, partitions: int, salts: int) -> DataFrame:
    """Blocks of a group's anchors, each with its slots' lowest and highest score."""

    def block(group: int, parts: list) -> list:
        ids, rows, labels, x, low, high = (np.concatenate([p[i] for p in parts]) for i in range(6))
        return [group, x.shape[1], ids.tobytes(), rows.tobytes(), labels.tobytes(), *_packed(x), low.tobytes(), high.tobytes()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            ids, rows, labels, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "anchor_row", "label", "group"))
            x = matrix(batch.column("vector"))
            low, high = (np.stack([np.asarray(r, np.int64) for r in batch.column(c).to_pylist()]) if len(ids) else np.zeros((0, 1), np.int64) for c in ("low", "high"))
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                for at in range(0, len(own), BLOCK):
                    part = own[at : at + BLOCK]
                    key = (int(g), x.shape[1], low.shape[1])
                    held.setdefault(key, []).append((ids[part], rows[part], labels[part], x[part], low[part], high[part]))
                    if sum(len(p[0]) for p in held[key]) >= BLOCK:
                        yield _batch([block(int(g), held.pop(key))], BLOCK_FIELDS)
        for (g, *_), parts in held.items():
            yield _batch([block(g, parts)], BLOCK_FIELDS)

    dealt = anchors.withColumn("salt", F.pmod(F.xxhash64("anchor", "anchor_row"), F.lit(salts))).repartition(partitions, "group", "salt")
    return dealt.select("anchor", "anchor_row", "label", "vector", "group", "low", "high").mapInArrow(run, BLOCK_SCHEMA)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as 64-bit integers."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if np.sqrt((a * a).sum(axis=1).max(initial=0.0) * (b * b).sum(axis=1).max(initial=0.0)) < EXACT:  # then every partial sum is exact
        return (a @ b.T).astype(np.int64)
    large = [[int(v) for v in row] for row in b]
    return np.array([[min(MOST, max(LEAST, sum(int(u) * v for u, v in zip(row, other, strict=True)))) for other in large] for row in a], np.int64)


def best(values: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest allowed values; of equal ones the first columns."""
    n = values.shape[1]
    if n > k:
        shown = np.where(allowed, values, LEAST)
        allowed = allowed & (values >= np.partition(shown, n - k, axis=1)[:, n - k][:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, ~values[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], column[place < k]


def meet(tiles: DataFrame, blocks: DataFrame, same_label: bool, k: int) -> DataFrame:
    """The ``k`` best candidates of each pair of tiles, by anchor and slot."""

    def pair(x: dict) -> pa.RecordBatch:
        q_ids, q_rows, q_labels = (np.frombuffer(x[c], np.int64) for c in ("q_ids", "q_rows", "q_labels"))
        ids, labels, known = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64), np.frombuffer(x["known"], bool)
        low, high = (np.frombuffer(x[c], np.int64).reshape(len(q_ids), -1) for c in ("q_low", "q_high"))
        vectors = _unpacked(x["kind"], x["vectors"], len(ids), x["width"])
        if x["serves"] is not None:
            ids, labels, known, vectors = (v[np.frombuffer(x["serves"], bool)] for v in (ids, labels, known, vectors))
        found = scores(_unpacked(x["q_kind"], x["q_vectors"], len(q_ids), x["q_width"]), vectors)
        fits = (q_labels[:, None] == labels[None]) == same_label
        if same_label:
            fits &= (q_ids[:, None] != ids[None]) | ~known[None]
        parts = []
        for slot in range(low.shape[1]):
            row, column = best(found, fits & (found >= low[:, slot, None]) & (found <= high[:, slot, None]), k)
            parts.append((q_ids[row], q_rows[row], np.full(len(row), slot, np.int32), found[row, column], ids[column], known[column]))
        one = [np.concatenate([p[i] for p in parts]) for i in range(6)]
        return pa.RecordBatch.from_arrays([*map(pa.array, one[:4]), pa.array(one[4], mask=~one[5])], schema=FOUND_FIELDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pair(batch.slice(i, 1).to_pylist()[0])

    return tiles.join(blocks, "group").mapInArrow(run, FOUND_SCHEMA)


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor's slot with their ``rank`` from 1; Spark cuts each task's rows before they are dealt."""
    order = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(anchors: DataFrame, norm2: float) -> dict[int, tuple[float, float]]:
    """Per group the least and largest distance from the pivot at which a candidate could serve one of its anchors."""
    low, high = F.array_min("low"), F.array_max("high")
    far = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + F.lit(norm2) - score.cast("double") * 2))
    most = F.when(low == LEAST, F.lit(float("inf"))).otherwise(far(low))
    least = F.when(high == MOST, F.lit(0.0)).otherwise(far(high))
    r = F.col("radius")
    rows = anchors.groupBy("group").agg(F.min(F.greatest(r - most, least - r)).alias("low"), F.max(r + most).alias("high"))
    return {x["group"]: (x["low"], x["high"]) for x in rows.collect()}  # a row a pivot


def search(tiles: DataFrame, cells: Cells, anchors: DataFrame, slots: DataFrame, same_label: bool, k: int) -> DataFrame:
    """``(anchor, anchor_row, slot, rank, score, found_id)``: the ``k`` best candidates of each slot within its ``low`` and ``high`` scores.

    ``tiles`` and ``anchors`` are written ones, ``slots`` ``(anchor, anchor_row, slot, low, high)``; slots count from 0.
    """
    spark = tiles.sparkSession
    n = anchors.count()
    salts, partitions = max(1, n // SALT_ROWS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (16 * BLOCK))
    width = (slots.agg(F.max("slot")).first()[0] or 0) + 1

    def with_slots(rows: DataFrame) -> DataFrame:
        of = F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "high"))))
        lists = rows.groupBy("anchor", "anchor_row").agg(of.alias("of"))
        # a slot that an anchor hasn't allows no score
        each = [F.array(*(F.coalesce(F.try_element_at("of", F.lit(i))[c], F.lit(none)) for i in range(width))).alias(c) for c, none in (("low", MOST), ("high", LEAST))]
        return written(anchors.join(lists.select("anchor", "anchor_row", *each), ["anchor", "anchor_row"]), "negatives-anchors")

    def found(rows: DataFrame, serving: DataFrame) -> DataFrame:
        # blocks are written, so both sides of the join are plain shuffles, which adaptive execution splits
        blocks = written(anchor_blocks(rows, partitions, salts), "negatives-blocks")
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PAIRS_PER_BATCH)}):
            return written(meet(serving, blocks, same_label, k), "negatives-found")

    home = found(with_slots(slots), tiles.withColumns({"group": F.col("cell"), "serves": F.lit(None).cast("binary")}))
    at_home = ranked_best(home, k)
    floors = at_home.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    raised = slots.join(floors, KEY, "left").select(*KEY, F.when(F.col("n") >= k, F.greatest("low", "least")).otherwise(F.col("low")).alias("low"), "high")
    rows = with_slots(raised)
    rest = found(rows, replicated(tiles, cells, _bounds(rows, cells.norm2)))
    return ranked_best(home.unionByName(rest), k)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, least_share: str = "0.8", pivots: int = PIVOTS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``whole_vectors``.

    Negatives of a positive have another label and from ``least_share`` of its score up to all of it.
    """
    cells = cells_of(vectors, pivots)
    own = vectors.where(is_anchor & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("anchor"), F.xxhash64("label", "vector").alias("anchor_row"), "label", "vector", "norm2")
    anchors = written(placed_anchors(own.dropDuplicates(["anchor", "anchor_row"]), cells), "negatives-placed")
    tiles = written(candidate_tiles(vectors, cells), "negatives-tiles")
    every = anchors.select("anchor", "anchor_row", F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    positives = search(tiles, cells, anchors, every, True, n_positives)
    positives = written(positives.select("anchor", "anchor_row", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    exact = F.col("positive_score").cast("decimal(20,0)")
    windows = positives.where("positive_score >= 0").select(*KEY, F.ceil(exact * F.lit(least_share).cast("decimal(6,4)")).cast("bigint").alias("low"), F.col("positive_score").alias("high"))
    negatives = search(tiles, cells, anchors, windows, False, n_negatives)
    rows = negatives.select(*KEY, "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, KEY)
    return rows.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
