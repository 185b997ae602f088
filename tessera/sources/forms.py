"""Text forms of the stages, written and read back.

| Form | Line |
|-|-|
| statistics | ``images TAB average length`` |
| term frequencies | ``feature TAB [(tf image)(tf image)...]`` |
| vectors | ``image TAB [(feature w)...]`` |
| vectors with pools | ``image,pool:pool TAB [(feature w)...]`` |
| inverted list | ``feature TAB [(w w_norm image)...]`` |
| candidate pairs | ``(a,b) TAB 1`` |
| edges | ``(a,b) TAB similarity`` |

A list longer than ``CHUNK`` items is several lines of its key, so no row holds the whole
list of a frequent feature; readers give long form, where lines of a key merge. Numbers
are written so that reading gives the same bits. Ids may not hold the marks of the format
(parentheses, and the character that parts them from what follows); the writers raise on
those. Lines that don't fit a form give no rows, or an error if ``strict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a line, about.
CHUNK = 10_000


def _plain(column: str, marks: str) -> Column:
    """An id as text; raises where it holds a mark of the format or is empty."""
    text = F.col(column).cast("string")
    return F.when((text != "") & ~text.rlike(marks), text).otherwise(F.raise_error(F.concat(F.lit(f"{column} can't be written: "), F.coalesce(text, F.lit("null")))))


def _list_lines(rows: DataFrame, key: Column, item: list[Column], chunk: int) -> DataFrame:
    """``key TAB [(item)...]``, about ``chunk`` items a line: a key's rows are dealt over as many lines as its count asks for."""
    items = rows.select(key.alias("key"), F.concat(F.lit("("), F.concat_ws(" ", *item), F.lit(")")).alias("item"))
    counts = items.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("lines")).where("lines > 1")
    dealt = items.join(counts, "key", "left").withColumn("line", F.when(F.col("lines").isNull(), 0).otherwise(F.pmod(F.xxhash64("item"), F.col("lines"))))
    lists = dealt.groupBy("key", "line").agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("items"))
    return lists.select(F.concat("key", F.lit("\t["), "items", F.lit("]")).alias("value"))


def _list_rows(lines: DataFrame, parts: int, strict: bool) -> DataFrame:
    """``(key, item)``, an item as the array of its parts."""
    tab = F.instr("value", "\t")
    key, rest = F.substr("value", F.lit(1), tab - 1), F.substr("value", tab + 1)
    fits = (tab > 1) & rest.rlike(r"^\[(\([^()]*\))*\]$")
    rows = lines.where(F.col("value").isNotNull() & (F.col("value") != ""))
    items = F.when(fits, F.regexp_extract_all(rest, F.lit(r"\(([^()]*)\)"), F.lit(1)))
    rows = rows.select(F.when(fits, key).alias("key"), (items.otherwise(F.raise_error(F.lit("not a list line"))) if strict else items).alias("items"))
    return rows.select("key", F.explode("items").alias("item")).select("key", F.split("item", " ", parts).alias("item"))


def _part(i: int) -> Column:
    return F.get("item", F.lit(i))


def stats_lines(stats: DataFrame) -> DataFrame:
    return stats.select(F.concat_ws("\t", F.col("n_images").cast("string"), F.col("adl").cast("string")).alias("value"))


def parse_stats(lines: DataFrame) -> DataFrame:
    """``(n_images, adl, n_positive)``; the last is unknown, so it counts as one for each image."""
    part = F.split("value", "\t")
    rows = lines.where("value != ''").select(F.get(part, F.lit(0)).cast("bigint").alias("n_images"), F.get(part, F.lit(1)).cast("double").alias("adl"))
    return rows.agg(F.max("n_images").alias("n_images"), F.max("adl").alias("adl")).withColumn("n_positive", F.col("n_images"))


def tf_lines(tf: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return _list_lines(tf, F.col("feature_id").cast("string"), [F.col("tf").cast("string"), _plain("image_id", r"[()\n\r]")], chunk)


def parse_tf(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(image_id, feature_id, tf)``."""
    rows = _list_rows(lines, 2, strict)
    return rows.select(_part(1).alias("image_id"), F.col("key").cast("int").alias("feature_id"), _part(0).cast("float").alias("tf"))


def vector_lines(weights: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return _list_lines(weights, _plain("image_id", r"[()\t\n\r]"), [F.col("feature_id").cast("string"), F.col("w").cast("string")], chunk)


def parse_vectors(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(image_id, feature_id, w)``."""
    rows = _list_rows(lines, 2, strict)
    return rows.select(F.col("key").alias("image_id"), _part(0).cast("int").alias("feature_id"), _part(1).cast("double").alias("w"))


def pooled_vector_lines(weights: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Of ``(image_id, cluster_ids, feature_id, w)``."""
    pools = F.array_join(F.transform("cluster_ids", lambda c: F.when(c.rlike(r"[:\t\n\r]"), F.raise_error(F.concat(F.lit("a pool can't be written: "), c)).cast("string")).otherwise(c)), ":")
    key = F.concat(_plain("image_id", r"[(),\t\n\r]"), F.lit(","), pools)
    return _list_lines(weights, key, [F.col("feature_id").cast("string"), F.col("w").cast("string")], chunk)


def parse_pooled_vectors(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(image_id, cluster_ids, feature_id, w)``."""
    rows = _list_rows(lines, 2, strict)
    key = F.split("key", ",", 2)
    return rows.select(F.get(key, F.lit(0)).alias("image_id"), F.split(F.get(key, F.lit(1)), ":").alias("cluster_ids"), _part(0).cast("int").alias("feature_id"), _part(1).cast("double").alias("w"))


def posting_lines(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return _list_lines(postings, F.col("feature_id").cast("string"), [F.col("w").cast("string"), F.col("w_norm").cast("string"), _plain("image_id", r"[()\n\r]")], chunk)


def parse_postings(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(feature_id, image_id, w, w_norm)``."""
    rows = _list_rows(lines, 3, strict)
    return rows.select(F.col("key").cast("int").alias("feature_id"), _part(2).alias("image_id"), _part(0).cast("double").alias("w"), _part(1).cast("double").alias("w_norm"))


def _pair() -> Column:
    return F.concat(F.lit("("), _plain("image_a", r"[(),\t\n\r]"), F.lit(","), _plain("image_b", r"[(),\t\n\r]"), F.lit(")"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat(_pair(), F.lit("\t1")).alias("value"))


def parse_edges(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(image_a, image_b, similarity)``."""
    form = r"^\(([^(),\t]+),([^(),\t]+)\)\t([^\t]+)$"
    fits = F.col("value").rlike(form)
    rows = lines.where(F.col("value").isNotNull() & (F.col("value") != ""))
    rows = rows.select(F.when(fits, F.col("value")).otherwise(F.raise_error(F.lit("not an edge line")).cast("string")).alias("value")) if strict else rows.where(fits)
    return rows.select(F.regexp_extract("value", form, 1).alias("image_a"), F.regexp_extract("value", form, 2).alias("image_b"), F.regexp_extract("value", form, 3).cast("double").alias("similarity"))


def parse_pairs(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(image_a, image_b)``."""
    return parse_edges(lines, strict).select("image_a", "image_b")
