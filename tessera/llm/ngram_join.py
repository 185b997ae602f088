"""Jaccard join of documents on word n-grams, with Bayesian pruning of candidates.

Two documents are linked when the Jaccard similarity of their sets of ``N``-word
shingles (words between white space) is at least ``THRESHOLD``.

1. Every whole text becomes a shingle set, ``BANDS`` x ``ROWS`` MinHash values and one
   key for each band. Documents with equal sets are one class from here on, and one row
   of the class, its node, stands for it.
2. Classes that share a band key are candidates. In each bucket MinHash values are
   compared a stretch at a time; a pair is dropped once the posterior probability that
   its similarity reaches the threshold (uniform prior, binomial matches) is below
   ``TOLERANCE``. What remains is only used as links of coarse groups. A bucket of more
   than ``BLOCK`` classes is one coarse group without being compared here.
3. Inside a coarse group each pair that survives the same pruning is verified on the
   exact sets. A group's texts are shuffled once and cut into pieces of at most
   ``BLOCK`` classes and ``BLOCK_BYTES`` of sets (a longer set is a piece of its own). A
   piece is compared with itself where it is made. Groups of several pieces leave them
   in files below the shared folder, and each pair of pieces whose sizes allow a link is
   compared by a task that reads the two by name, so shuffled bytes grow with the texts
   and not with a group's square. Pairs of documents are counted where they are compared
   and never emitted: a task returns for each class its number of links and one edge.
4. Verified edges give the final groups.

A link of similarity s is a candidate with probability 1 - (1 - s^ROWS)^BANDS, at least
1 - 1e-6, and survives pruning with about 1 - 1e-5.

Texts of fewer than ``N`` words have one shingle, all their words; texts without words
are copies of each other and linked to nothing else. Null texts are empty. Rows are
documents of their own: rows that repeat an id are compared like any others, and rows
without an id link too; a group of such rows alone has a null class. An empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bloom import bloom_of, passing, words_for
from tessera.llm.common import open_store, per_process, released, settings, shared_dir, small_batches, written
from tessera.llm.components import components

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
ROWS, BANDS = 5, 35
VALUES = ROWS * BANDS
STRETCH = 25
BLOCK, BLOCK_BYTES = 256, 8 << 20
PIECES = 4  # of a tile; a task holds two tiles, so at most about 8 * BLOCK_BYTES of shingles
SMALL = 8  # buckets of so few members list their pairs outright
SEED = 29
WORDS_KEPT, WORD_CHARS = 50_000, 64  # word hashes that a worker remembers, of words no longer than this
FEATURES = "k1 long, k2 long, doc_id long, set_hash binary, n_shingles long, signature binary, bands array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted 64-bit hashes, and their MinHash values."""

    def __init__(self, n: int = N, seed: int = SEED):
        import xxhash

        rng = np.random.default_rng(seed)
        odd = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.n, self.place, self.factor, self.mask, self.band = n, odd(n + 1), odd(VALUES), odd(VALUES), odd(ROWS)

        class Words(dict):
            def __missing__(self, word: str) -> int:
                value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
                if len(word) <= WORD_CHARS:
                    if len(self) >= WORDS_KEPT:
                        self.clear()
                    self[word] = value
                return value

        self.words = Words()
        self.digest = xxhash.xxh3_128_digest

    def shingles(self, text: str) -> np.ndarray:
        words = text.split()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        if len(h) < self.n:  # one shingle; its length is part of the hash
            return _mixed(np.array([(h * self.place[: len(h)]).sum() + np.uint64(len(h)) * self.place[self.n]], dtype=np.uint64))
        last = len(h) - self.n + 1
        total = h[:last] * self.place[0]
        for i in range(1, self.n):
            total = total + h[i : last + i] * self.place[i]
        return np.unique(_mixed(total))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            np.minimum(least, ((part[:, None] ^ self.mask) * self.factor).min(axis=0), out=least)
        return least

    def bands(self, minima: np.ndarray) -> np.ndarray:
        keys = (minima.reshape(BANDS, ROWS) * self.band).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        return _mixed(keys).view(np.int64)


def signature(minima: np.ndarray) -> bytes:
    """Eight bits of each value: enough to tell unequal values apart all but once in 256."""
    return ((minima >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, values: int = VALUES, stretch: int = STRETCH) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped).

    With a uniform prior and m of n values equal, the similarity's posterior is
    Beta(m + 1, n - m + 1), and its mass above t is P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(stretch, values + 1, stretch):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        found.append((n, m))
    return found


def survivors(left: np.ndarray, right: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Indexes of the pairs of signature rows that no stretch drops."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    done = 0
    for n, least in limits:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        stay = matches >= least
        alive, matches, done = alive[stay], matches[stay], n
        if not len(alive):
            break
    return alive


def row_keys(ident: Column, text: Column) -> list[Column]:
    """128 bits that tell a row by its id and text; the same wherever they are computed."""
    return [F.xxhash64(F.lit(k), ident, text).alias(f"k{k}") for k in (1, 2)]


def _features(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = per_process("shingler", lambda: Shingler(n), n)
        for batch in batches:
            sets, sizes, signatures, bands = [], [], [], []
            for text in batch.column("text"):
                found = shingler.shingles(text.as_py())
                least = shingler.minima(found)
                sets.append(shingler.digest(found.tobytes()))
                sizes.append(len(found))
                signatures.append(signature(least))
                bands.append(shingler.bands(least) if len(found) else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            columns = [*(batch.column(c) for c in ("k1", "k2", "doc_id")), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "set_hash", "n_shingles", "signature", "bands"])

    return run


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    change = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])]))


def _grouped(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted rows cut between groups: each holds whole groups, and one group at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _runs([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if held and not same:
            yield _one(held)
            held = []
        if len(starts) > 2:  # the last group may go on
            yield _one([*held, batch.slice(0, int(starts[-2]))])
            held = [batch.slice(int(starts[-2]))]
        else:
            held.append(batch)
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), VALUES)


def _bucket_links(limits: list[tuple[int, int]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _grouped(batches, ("key",)):
            signatures, node = _matrix(chunk.column("signature")), chunk.column("node").to_numpy()
            starts = _runs([chunk.column("key").to_numpy()])
            pairs_a, pairs_b, links = [], [], []
            sizes = np.diff(starts)
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
                own = starts[:-1][sizes == size]
                x, y = np.triu_indices(int(size), 1)
                pairs_a.append((own[:, None] + x).ravel())
                pairs_b.append((own[:, None] + y).ravel())
            if pairs_a:
                a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
                stay = survivors(signatures[a], signatures[b], limits)
                links.append(np.stack([node[a[stay]], node[b[stay]]]))
            for k in np.flatnonzero(sizes > SMALL):
                links.append(_spanning(node[starts[k] : starts[k + 1]], signatures[starts[k] : starts[k + 1]], limits))
            found = np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1)
            found = np.unique(np.sort(found, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[1]), pa.array(found[0])], ["a", "b"])

    return run


def _spanning(node: np.ndarray, signatures: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Fewer links than members, that join what any surviving pair joins. Members already together aren't compared again."""
    group = np.arange(len(node))
    links = []
    for a in range(len(node)):
        others = a + 1 + np.flatnonzero(group[a + 1 :] != group[a])
        stay = others[survivors(np.broadcast_to(signatures[a], (len(others), VALUES)), signatures[others], limits)]
        for g in np.unique(group[stay]):
            links.append((node[a], node[stay[group[stay] == g][0]]))
        group[np.isin(group, group[stay])] = group[a]
    return np.array(links, dtype=np.int64).reshape(-1, 2).T


class Piece:
    """Some classes of one coarse group: nodes, copies, signatures and sets."""

    def __init__(self) -> None:
        self.node: list[int] = []
        self.copies: list[int] = []
        self.signature: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.bytes = 0

    def add(self, node: int, copies: int, signature: bytes, shingles: np.ndarray) -> None:
        self.node.append(node)
        self.copies.append(copies)
        self.signature.append(signature)
        self.sets.append(shingles)
        self.bytes += shingles.nbytes

    def __len__(self) -> int:
        return len(self.node)

    def sizes(self) -> list[int]:
        return [len(x) for x in self.sets]

    def save(self, folder: str) -> str:
        """Writes a file of a name of its own; that of a lost attempt is listed nowhere and so never read."""
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        columns = [pa.array(self.node, pa.int64()), pa.array(self.copies, pa.int64()), pa.array(self.signature, pa.binary()), pa.array([x.tobytes() for x in self.sets], pa.large_binary())]
        rows = pa.RecordBatch.from_arrays(columns, ["node", "copies", "signature", "shingles"])
        with store.open_output_stream(f"{at}/{name}", compression=None) as sink, pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        return name

    @staticmethod
    def load(folder: str, name: str) -> Piece:
        store, at = open_store(folder)
        with store.open_input_stream(f"{at}/{name}", compression=None) as source:
            rows = pa.ipc.open_stream(source).read_all()
        found = Piece()
        for node, copies, mark, shingles in zip(*(rows.column(c).to_pylist() for c in rows.schema.names), strict=True):
            found.add(node, copies, mark, np.frombuffer(shingles, np.uint64))
        return found


def compare(left: Piece, right: Piece | None, limits: list[tuple[int, int]], limit: Fraction) -> np.ndarray:
    """Rows ``node, smallest node it is joined to here, links`` for classes with links; ``right`` is None for pairs inside one piece."""
    nodes, copies, marks, sets = (x + (getattr(right, n) if right else []) for n, x in (("node", left.node), ("copies", left.copies), ("signature", left.signature), ("sets", left.sets)))
    node, copies = np.array(nodes, dtype=np.int64), np.array(copies, dtype=np.int64)
    signatures = np.frombuffer(b"".join(marks), np.uint8).reshape(len(node), VALUES)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    up, down = limit.numerator, limit.denominator
    pairs = []
    for a in range(len(left)):
        others = np.arange(len(left) if right else a + 1, len(node))
        others = others[np.minimum(sizes[others], sizes[a]) * down >= np.maximum(sizes[others], sizes[a]) * up]
        others = others[survivors(np.broadcast_to(signatures[a], (len(others), VALUES)), signatures[others], limits)]
        if len(others):
            pairs.append((a, others))
    if not pairs:
        return np.zeros((3, 0), np.int64)
    used = np.unique(np.concatenate([np.array([a for a, _ in pairs]), *(x for _, x in pairs)]))
    words, flat = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    start = np.zeros(len(node), dtype=np.int64)
    start[used] = np.cumsum(sizes[used]) - sizes[used]
    mark = np.zeros(len(words), dtype=bool)
    links, group = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    for a, others in pairs:
        own = flat[start[a] : start[a] + sizes[a]]
        mark[own] = True
        size = sizes[others]
        first = np.cumsum(size) - size
        common = np.add.reduceat(mark[flat[np.repeat(start[others] - first, size) + np.arange(int(size.sum()))]].astype(np.int64), first)
        mark[own] = False
        found = others[common * down >= (size + sizes[a] - common) * up]
        if len(found):
            links[a] += copies[found].sum()
            links[found] += copies[a]
            group[np.isin(group, group[found])] = group[a]
    out = [np.zeros((3, 0), np.int64)]
    linked = np.flatnonzero(links)
    for g in np.unique(group[linked]):
        own = linked[group[linked] == g]
        out.append(np.stack([node[own], np.full(len(own), node[own].min()), links[own]]))
    return np.concatenate(out, axis=1)


FOUND = "a long, b long, links long, root long, piece string, small long, large long"


def _links(found: np.ndarray) -> pa.RecordBatch:
    blank = [pa.nulls(found.shape[1], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*map(pa.array, found), *blank], ["a", "b", "links", "root", "piece", "small", "large"])


def _make_pieces(n: int, limits: list[tuple[int, int]], limit: Fraction, folder: str, block: int, block_bytes: int):
    """Rows sorted by root, block and node: links inside pieces, and the names of pieces that groups of several leave."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = per_process("shingler", lambda: Shingler(n), n)
        piece, root, alone, last = Piece(), None, True, None

        def done(more: bool) -> Iterator[pa.RecordBatch]:
            if not len(piece):
                return
            yield _links(compare(piece, None, limits, limit))
            if more or not alone:
                sizes, none = piece.sizes(), pa.nulls(1, pa.int64())
                place = [pa.array([root]), pa.array([piece.save(folder)]), pa.array([min(sizes)]), pa.array([max(sizes)])]
                yield pa.RecordBatch.from_arrays([none, none, none, *place], ["a", "b", "links", "root", "piece", "small", "large"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "blocks", "node", "copies", "signature", "set_hash")]
            for text, row_root, blocks, node, copies, mark, digest in zip(batch.column("text"), *columns, strict=True):
                if node == last:
                    continue  # rows that repeat an id and text
                shingles = shingler.shingles(text.as_py())
                if shingler.digest(shingles.tobytes()) != digest:
                    continue
                last = node
                if row_root != root:
                    yield from done(False)
                    piece, root, alone = Piece(), row_root, blocks == 1
                elif len(piece) >= block or piece.bytes + shingles.nbytes > block_bytes:
                    yield from done(True)
                    piece, alone = Piece(), False
                piece.add(node, copies, mark, shingles)
        yield from done(False)

    return run


def _cross(limits: list[tuple[int, int]], limit: Fraction, folder: str):
    """Links between two pieces, read by name: each once for a pair of tiles, whose pairs come one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held = None, {}
        for batch in batches:
            for p, q, *own in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "root", "low", "high")), strict=True):
                if own != tiles:
                    tiles, held = own, {}
                for name in (p, q):
                    if name not in held:
                        held[name] = Piece.load(folder, name)
                yield _links(compare(held[p], held[q], limits, limit))

    return run


def piece_pairs(pieces: DataFrame, threshold: float) -> DataFrame:
    """``(p, q, root, low, high)``: pairs of a group's pieces whose set sizes can reach the threshold, and the tiles they are in.

    A tile is about ``PIECES`` pieces of a group. A task takes all pairs of two tiles, so a
    piece is read once for each tile of its group and not for each piece.
    """
    tiles = pieces.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / PIECES).alias("tiles"))
    rows = pieces.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64(F.lit(5), "piece"), F.col("tiles")))
    p, q = rows.alias("p"), rows.alias("q")
    reach = (F.col("p.large") >= F.col("q.small") * threshold) & (F.col("q.large") >= F.col("p.small") * threshold)
    met = p.join(q, (F.col("p.root") == F.col("q.root")) & (F.col("p.piece") < F.col("q.piece")) & reach)
    return met.select(F.col("p.piece").alias("p"), F.col("q.piece").alias("q"), F.col("p.root").alias("root"), F.least("p.tile", "q.tile").alias("low"), F.greatest("p.tile", "q.tile").alias("high"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, class_id, n_links, copy_id, copies)``, one row per document.

    ``class_id`` is the smallest id of the documents that links connect, ``n_links``
    the number of other documents linked to this one, ``copy_id`` the smallest id with
    the same shingle set and ``copies`` how many documents have it.
    """
    return joined_rows(docs, id_col, text_col, n, threshold, tolerance).drop("k1", "k2", "group")


def joined_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """As ``join`` with the row's keys ``k1, k2`` and a number of its ``group``."""
    with settings(docs.sparkSession, small_batches()):  # every Python step below is written at once
        return _join(docs, id_col, text_col, n, threshold, tolerance)


def _classes_of_groups(final: DataFrame, classes: DataFrame) -> DataFrame:
    """``(g_node, group, class_id)`` of classes with links; the group is the root of the verified edges."""
    nodes = final.unionByName(final.select(F.col("root").alias("node"), "root").distinct())
    least = nodes.join(classes.select("node", "cid"), "node").groupBy("root").agg(F.min("cid").alias("class_id"))
    return nodes.join(least, "root").select(F.col("node").alias("g_node"), F.col("root").alias("group"), "class_id")


def _join(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, tolerance: float) -> DataFrame:
    limits, limit = least_matches(threshold, tolerance), Fraction(str(threshold))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*row_keys(F.col(id_col), text), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    features = written(rows.mapInArrow(released(_features(n)), FEATURES).withColumn("row", F.monotonically_increasing_id()), "shingle-features")
    classes = features.groupBy("set_hash").agg(F.min("row").alias("node"), F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "shingle-classes")
    stands = features.join(classes.select("node", "copies"), F.col("row") == F.col("node"))
    stands = written(stands.select("node", "copies", "k1", "k2", "set_hash", "n_shingles", "signature", "bands"), "shingle-stands")

    keys = stands.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least")).where("members > 1")
    buckets = keys.join(shared, "key")
    large = buckets.where((F.col("members") > BLOCK) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    small = buckets.where(F.col("members") <= BLOCK).select("key", "node").join(stands.select("node", "signature"), "node")
    small = small.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_bucket_links(limits), "a long, b long")
    coarse = components(small.unionByName(large))

    coarse = written(coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct()), "coarse-groups")
    members = written(coarse.join(stands.drop("bands"), "node"), "coarse-members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col("n_shingles") * 8) / BLOCK_BYTES)).cast("int")
    members = members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root")
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks"))).drop("n_shingles")
    keys, words = ["k1", "k2"], words_for(coarse.count())
    # texts of documents in no group aren't shuffled, while there are up to some ten million others
    texts = passing(rows.drop("doc_id"), bloom_of(members.select(*keys), keys, words) if words else None, keys, words)
    dealt = texts.join(members, keys).drop(*keys).repartition("root", "block").sortWithinPartitions("root", "block", "node")
    folder = shared_dir(docs.sparkSession, "shingle-pieces")
    found = written(dealt.mapInArrow(released(_make_pieces(n, limits, limit, folder, BLOCK, BLOCK_BYTES)), FOUND), "piece-links")

    pieces = found.where("piece IS NOT NULL")
    tile = ["root", "low", "high"]
    pairs = piece_pairs(pieces, threshold).repartition(*tile).sortWithinPartitions(*tile, "p", "q")
    crossed = written(pairs.mapInArrow(released(_cross(limits, limit, folder)), FOUND), "cross-links")
    verified = found.where("piece IS NULL").unionByName(crossed).select("a", "b", "links")

    final = written(components(verified.select("a", "b")), "verified-groups")
    links = verified.groupBy("a").agg(F.sum("links").alias("links"))
    per_class = classes.join(_classes_of_groups(final, classes), F.col("node") == F.col("g_node"), "left").join(links, F.col("node") == F.col("a"), "left")
    per_class = per_class.select(
        "set_hash",
        F.coalesce("class_id", "cid").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("cid").alias("copy_id"),
        "copies",
        F.coalesce("group", "node").alias("group"),
    )
    return features.select("k1", "k2", "doc_id", "set_hash").join(per_class, "set_hash").drop("set_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row of each linked group, all columns as they were: that of the smallest id (rows without one come last).

    Rows without links stay, also those that repeat another row's id. Of rows of one
    group that repeat the smallest id the order of their keys decides, and of rows alike
    in id and text a hash of all columns.
    """
    names = docs.columns
    found = joined_rows(docs, id_col, text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "k1", "k2"))
    kept = found.groupBy("group").agg(first.alias("first")).select(F.col("first.k1").alias("o_k1"), F.col("first.k2").alias("o_k2"))
    plain = docs.toDF(*(f"in_{n}" for n in names))
    k1, k2 = row_keys(F.col(f"in_{id_col}"), F.coalesce(F.col(f"in_{text_col}"), F.lit("")))
    keyed = plain.select("*", k1, k2)
    chosen = keyed.join(kept, (F.col("k1") == F.col("o_k1")) & (F.col("k2") == F.col("o_k2")), "left_semi")
    order = F.xxhash64(*(F.col(f.name) for f in plain.schema if "map<" not in f.dataType.simpleString()))
    one = chosen.groupBy("k1", "k2").agg(F.min_by(F.struct(*plain.columns), order).alias("one"))
    return one.select(*(F.col(f"one.in_{n}").alias(n) for n in names))
