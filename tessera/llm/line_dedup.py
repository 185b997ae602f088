"""Line deduplication over range-partitioned line hashes, with keep bitmaps as the result.

Main path: DataFrame functions only. A line's key is the line without white space
(``[\\x20\\x09-\\x0D]``) at its ends, A-Z lower-cased. A key of at least
``min_chars`` code points in at least ``min_docs`` documents stays only in the
largest id that holds it, there at every place.

1. Occurrences ``(hash, document, position)`` are written once; texts don't travel.
2. They are range-partitioned by hash and sorted by document (largest first) and
   position, so each hash streams past with the occurrence that stays in front.
3. Hashes of more than about ``HEAVY_ROWS`` lines, which would fill a task, go a second
   way with the same outcome: they are counted with a combiner and joined back, by
   broadcast while there are at most ``MAX_HEAVY`` of them, else by a shuffle whose
   skewed keys adaptive execution splits. A sample decides only which way a hash goes,
   so what a task holds of one hash is bounded by rows and not by a share of the table.
4. Places to drop become one run-length bitmap for each document that loses lines.

Keys are compared by 128 bits of hash. Rows that repeat a document id count as one
document; each row gets the bitmap of its own text. A null id counts as one document
below all others; a null text is one empty line. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, lower_ascii, text_of, written

SAMPLE_ROWS = 1_000_000  # a table of so few rows is counted, of a larger one SHARE at least
SHARE = 0.01
HEAVY_ROWS = 2_000
MAX_HEAVY = 10_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(h1, h2, doc_id, text_key, pos)`` of every line whose key is long enough."""
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), _text_key(text).alias("text_key"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "doc_id", "text_key", "pos")


def _heavy_hashes(occ: DataFrame) -> DataFrame:
    """Hashes of about ``HEAVY_ROWS`` rows or more, as a sample of ``SHARE`` of the rows shows them."""
    fraction = max(SHARE, min(1.0, SAMPLE_ROWS / max(1, occ.count())))
    sample = occ.select("h1", "h2") if fraction == 1.0 else occ.select("h1", "h2").sample(fraction, seed=7)
    return sample.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fraction * HEAVY_ROWS).select("h1", "h2")


def dropped_places(occ: DataFrame, min_docs: int) -> DataFrame:
    """``(doc_id, text_key, pos)`` of lines that go."""
    heavy = written(_heavy_hashes(occ), "heavy-lines")
    few = F.broadcast if heavy.count() <= MAX_HEAVY else lambda df: df
    heavy = few(heavy)

    light = occ.join(heavy, ["h1", "h2"], "left_anti")
    light = light.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos")
    same_key = Window.partitionBy("h1", "h2")
    seen = F.dense_rank().over(same_key.orderBy(F.col("doc_id").desc_nulls_last()))
    light = light.withColumn("seen", seen).withColumn("n_docs", F.max("seen").over(same_key)).where((F.col("seen") > 1) & (F.col("n_docs") >= min_docs))

    common = occ.join(heavy, ["h1", "h2"], "left_semi")
    stays = common.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)
    common = common.join(few(stays), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))

    place = ["doc_id", "text_key", "pos"]
    return light.select(*place).unionByName(common.select(*place))


def _bitmap(drops: Column) -> list[Column]:
    """Runs that stay before each run that goes, and where the last stretch begins."""

    def at(i: Column) -> Column:
        return F.get(drops, i)

    starts = F.filter(drops, lambda p, i: (i == 0) | (at(i - 1) != p - 1))
    ends = F.filter(drops, lambda p, i: (i == F.size(drops) - 1) | (at(i + 1) != p + 1))
    begin = F.transform(starts, lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1))
    runs = F.transform(starts, lambda s, i: F.struct(F.get(begin, i).alias("start"), (s - F.get(begin, i)).alias("length")))
    return [runs.alias("keep_runs"), (F.array_max(drops) + 1).alias("tail"), F.size(drops).cast("bigint").alias("n_dropped")]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, text_key, keep_runs, tail, n_dropped)`` for each document that loses lines.

    The bitmap is run-length coded: lines of ``keep_runs`` stay, and all from ``tail``.
    """
    occ = written(occurrences(docs, id_col, text_col, min_chars), "line-occurrences")
    places = dropped_places(occ, min_docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    return places.select("doc_id", "text_key", *_bitmap(F.col("drops")))


def kept_text(text: Column) -> Column:
    """The text under a joined bitmap; all of it where there is none."""
    lines = lines_of(text)
    slices = F.transform(F.col("keep_runs"), lambda r: F.slice(lines, r["start"] + 1, r["length"]))
    tail = F.slice(lines, F.col("tail") + 1, F.size(lines))
    return F.when(F.col("tail").isNull(), text).otherwise(F.array_join(F.concat(F.flatten(slices), tail), "\n"))


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The documents with their bitmap's columns, prefixed by nothing, null where every line stays."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **limits)
    keyed = docs.withColumn("_text_key", _text_key(text_of(text_col)))
    renamed = bitmaps.withColumnRenamed("doc_id", "_bitmap_id").withColumnRenamed("text_key", "_bitmap_key")
    on = F.col(id_col).eqNullSafe(F.col("_bitmap_id")) & (F.col("_text_key") == F.col("_bitmap_key"))
    return keyed.join(renamed, on, "left").drop("_bitmap_id", "_bitmap_key", "_text_key")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The documents, their other columns as they were, without the lines that go."""
    names = docs.columns
    plain = docs.toDF(*(f"in_{n}" for n in names))  # names that can't clash with the bitmap's
    found = with_bitmaps(plain, f"in_{id_col}", f"in_{text_col}", **limits)
    text = F.when(F.col("tail").isNull(), F.col(f"in_{text_col}")).otherwise(kept_text(text_of(f"in_{text_col}")))
    return found.select(*(text.alias(n) if n == text_col else F.col(f"in_{n}").alias(n) for n in names))
