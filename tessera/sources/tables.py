"""Binding to order tables: image = order, feature = part, value = summed quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.dealing import dealt
from tessera.operators.weights import Extent, extent_of, vocabulary_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the lines, from the files' footers: no fewer than there are observations."""
    return table(spark, sf_dir, "lineitem").count()


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (image, feature); a row without either is no observation.

    The condition is stated here so that every use of the rows has the same one, and the
    uses share the exchange. Rows are dealt by image before grouping: the grouping hardly shrinks them, and
    lengths and norms per image then need no further shuffle. Many rows are dealt to more tasks.
    """
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_id"), F.col("l_partkey").alias("feature_id"), "l_quantity")
    rows = dealt(rows.where("image_id IS NOT NULL AND feature_id IS NOT NULL"), lines(spark, sf_dir), "image_id")
    return rows.groupBy("image_id", "feature_id").agg(F.sum("l_quantity").alias("value"))


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: an image repeats a feature that several of its lines have."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_id"), F.col("l_partkey").alias("feature_id"), F.col("l_quantity").alias("value"))
    return dealt(rows.where("image_id IS NOT NULL AND feature_id IS NOT NULL"), lines(spark, sf_dir), "image_id")


def vocabulary(spark: SparkSession, sf_dir: str) -> int:
    """About how many features there are, never too few."""
    return vocabulary_of(table(spark, sf_dir, "lineitem"), "l_partkey")


def extent(spark: SparkSession, sf_dir: str) -> Extent:
    """Bounds of the observations' sizes, from the lines they are grouped from."""
    return extent_of(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two memberships per image: its customer's pool and its order date's pool."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("image_id"),
        F.array(
            F.concat(F.lit("c:"), F.col("o_custkey").cast("string")),
            F.concat(F.lit("d:"), F.date_format("o_orderdate", "yyyyMMdd")),
        ).alias("ids"),
        F.when(F.col("o_orderkey") % 2 == 0, "in").otherwise("out").alias("sample_flag"),
    )
    return orders.select("image_id", "sample_flag", F.explode("ids").alias("cluster_id"))


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of pairs from outside the graph: each order with the next one that has the same part, in order of their numbers, repeats included."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
    rows = dealt(rows, lines(spark, sf_dir), "l_partkey").distinct()  # one shuffle, also for the order below
    later = F.lead("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))
    return rows.select(F.col("l_orderkey").cast("string").alias("image_a"), later.cast("string").alias("image_b")).where("image_b IS NOT NULL")


def iterated_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of clustering: customers' pools are the first, dates' pools the second."""
    return pools(spark, sf_dir).select(F.when(F.col("cluster_id").startswith("c:"), 1).otherwise(2).alias("iterate"), "cluster_id", "image_id")


def customer_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in the customer's pool only."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("image_id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("cluster_id"))
