"""Feature text and cluster text.

A feature line is ``fid:val,fid:val,... %image``; a cluster line is
``prefix:cluster TAB image image ...``. Directories, globs and gzip files are
read by Spark's text source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import DELIMITERS_WIDE, FEATURE_DELIMITERS, split_ids, tokens


def parse_features(lines: DataFrame, line: str = "value", delimiters: str = DELIMITERS_WIDE, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(image_id, feature_id, value)`` from feature lines, after the columns ``keep`` of the lines.

    A line with an image id and no features isn't an image and gives no rows;
    tokens after the second are ignored. Null and blank lines give no rows, or an
    error if ``strict``; so do a trailing feature id without a value (the id is
    left out) and numbers that can't be read (null).
    """
    token = tokens(F.coalesce(F.col(line), F.lit("")), delimiters)
    parts = lines.select(*keep, token.alias("t"))
    if strict:
        parts = parts.select(*keep, F.when(F.size("t") == 0, F.raise_error(F.lit("blank feature line"))).otherwise(F.col("t")).alias("t"))
    usable = parts.where(F.size("t") >= 2).select(*keep, F.get("t", F.lit(1)).alias("image_id"), tokens(F.get("t", F.lit(0)), FEATURE_DELIMITERS).alias("f"))
    pairs = (F.size("f") / F.lit(2)).cast("int")
    if strict:
        odd = F.size("f") % 2 == 1
        usable = usable.select(*keep, "image_id", F.when(odd, F.raise_error(F.lit("feature id without a value"))).otherwise(F.col("f")).alias("f"))

    def number(c: Column, kind: str) -> Column:
        return c.cast(kind) if strict else c.try_cast(kind)

    item = F.transform(
        F.sequence(F.lit(0), pairs - 1),
        lambda i: F.struct(
            number(F.get("f", i * 2), "int").alias("feature_id"),
            number(F.get("f", i * 2 + 1), "double").alias("value"),
        ),
    )
    return usable.where(pairs > 0).select(*keep, "image_id", F.explode(item).alias("x")).select(*keep, "image_id", "x.feature_id", "x.value")


def read_features(spark: SparkSession, path: str | list[str], line_ids: bool = False, keep: tuple[str, ...] = (), **options: object) -> DataFrame:
    """Feature rows of every file under a path.

    With ``line_ids`` rows also have ``line_id``, a number that tells lines apart: the place
    of a line in the files as Spark splits them, the same each time the same files are read.
    """
    lines = spark.read.text(path)
    if "file" in keep:
        lines = lines.withColumn("file", F.col("_metadata.file_path"))
    if line_ids:
        lines, keep = lines.withColumn("line_id", F.monotonically_increasing_id()), (*keep, "line_id")
    return parse_features(lines, keep=keep, **options)


def parse_clusters(lines: DataFrame, line: str = "value", min_size: int = 0, flagged: bool = False, whole_key: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(cluster_id, image_id[, sample_flag])`` from cluster lines, after the columns ``keep`` of the lines.

    A cluster's id is what stands between the first and second colon of the key, or, with
    ``whole_key``, the whole key: then ``a:1`` and ``b:1`` are two clusters. A key without
    a colon is no cluster either way.

    Only pools of more than ``min_size`` listed ids count, duplicates included.
    With ``flagged``, members are ``id#flag`` or ``id%flag``. Lines without a
    cluster id or without members give no rows.
    """
    key = F.split(F.col(line), "\t")
    second = F.get(F.split(F.get(key, F.lit(0)), ":"), F.lit(1))
    cluster_id = F.when(second.isNotNull(), F.get(key, F.lit(0))) if whole_key else second
    rows = (
        lines.where(F.col(line).isNotNull())
        .select(*keep, cluster_id.alias("cluster_id"), split_ids(F.get(key, F.lit(1))).alias("ids"))
        .where(F.col("cluster_id").isNotNull() & F.col("ids").isNotNull() & (F.size("ids") > min_size))
        .select(*keep, "cluster_id", F.explode("ids").alias("image_id"))
        .where(F.col("image_id") != "")
    )
    if not flagged:
        return rows
    part = F.split("image_id", "[#%]")
    return rows.select(*keep, "cluster_id", F.get(part, F.lit(0)).alias("image_id"), F.get(part, F.lit(1)).alias("sample_flag"))


def read_clusters(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Cluster rows of every file under a path."""
    return parse_clusters(spark.read.text(path), **options)


def read_iterated_clusters(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Cluster rows of the folders ``iterate1``, ``iterate2``, ... under a path, with their number as ``iterate``; other files give no rows."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/iterate([0-9]+)/[^/]*$", 1)
    lines = lines.select("value", number.try_cast("int").alias("iterate")).where("iterate IS NOT NULL")
    return parse_clusters(lines, keep=("iterate",), **options)


def tagged_union(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Both inputs as one relation with a ``kind`` column."""
    vectors = features.select(F.lit("vector").alias("kind"), "image_id", "feature_id", "value")
    pools = clusters.select(F.lit("cluster").alias("kind"), "image_id", "cluster_id")
    return vectors.unionByName(pools, allowMissingColumns=True)


def render_features(obs: DataFrame) -> DataFrame:
    """Feature lines, one per image: the inverse of ``parse_features``."""
    item = F.concat(F.col("feature_id").cast("string"), F.lit(":"), F.col("value").cast("string"))
    return obs.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("features")).select(F.concat("features", F.lit(" %"), "image_id").alias("value"))
