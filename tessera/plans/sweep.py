"""Sweeps over thresholds, and over thresholds and runs of clustering, in one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.candidates import in_first_shared_pool
from tessera.operators.ids import TEXT, Text
from tessera.operators.pairs import contributions, few, meetings
from tessera.operators.weights import Extent


def sweep_edges(postings: DataFrame, thresholds: Sequence[float], ids: Text = TEXT, extent: Extent | None = None) -> DataFrame:
    """``(threshold, image_a, image_b, similarity)`` for every threshold.

    A contribution passes all thresholds below the smaller of its two weights, so
    pairs are made once and summed by highest threshold passed, and running sums over
    the thresholds give each graph, in the tasks that hold a pair's contributions already.
    """
    return ids.restored(_coded_sweep(postings, thresholds, ids, extent), "threshold", "similarity").select("threshold", "image_a", "image_b", "similarity")


def _coded_sweep(postings: DataFrame, thresholds: Sequence[float], ids: Text, extent: Extent | None) -> DataFrame:
    steps = sorted(thresholds)
    rows = postings.where(F.col("w") > steps[0]).withColumn("level", _level(F.col("w"), steps).cast("byte"))
    if not few(extent):
        found, key = contributions(rows, ids=ids, level=True, extent=extent)
        return _running(found.groupBy(*key, "level").agg(F.sum("c").alias("c")), steps, key).drop("part")
    met = meetings(rows, ids=ids, level=True, extent=extent)
    spans = F.slice(F.array(*(F.lit(float(t)) for t in steps)), F.lit(1), F.col("level").cast("int") + 1)
    once = met.where("NOT more").select(F.explode(spans).alias("threshold"), "a", "b", F.col("c").alias("similarity"))
    rest = met.where("more").groupBy("a", "b", "level").agg(F.sum("c").alias("c"))
    return once.unionByName(_running(rest, steps, ("a", "b")))


def _level(w: Column, steps: list[float]) -> Column:
    """Place of the highest threshold that a weight above the lowest exceeds."""
    return sum((F.when(w > t, 1).otherwise(0) for t in steps[1:]), F.lit(0))


def sweep_pool_edges(postings: DataFrame, members: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``(threshold, iterate, image_a, image_b, similarity)``: graphs of pairs that share a pool, for every threshold and run of clustering.

    ``members`` are ``(iterate, cluster_id, image_id)``. One self-join by feature, run and
    pool serves the whole grid, so images meet only where they share both; a pair that
    shares several pools of a run counts in the first of them.
    """
    steps = sorted(thresholds)
    known = members.where("cluster_id IS NOT NULL AND iterate IS NOT NULL").select(F.col("iterate").cast("int").alias("iterate"), "cluster_id", "image_id")
    pools = known.groupBy("iterate", "image_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("pools"))
    pools = pools.select("iterate", "image_id", "pools", F.posexplode("pools").alias("at", "cluster_id"))
    pools = pools.select("iterate", "cluster_id", "image_id", F.slice("pools", F.lit(1), F.col("at")).alias("lower"))
    rows = postings.where(F.col("w") > steps[0]).join(pools, "image_id")
    sums = _by_level(rows, steps, ("cluster_id", "lower"), (F.col("a.cluster_id") == F.col("b.cluster_id")) & in_first_shared_pool(), ("iterate",))
    return _running(sums, steps, ("image_a", "image_b", "iterate"))


def _by_level(postings: DataFrame, steps: list[float], carry: tuple[str, ...] = (), also: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums by pair, further keys and highest threshold passed, from one self-join on feature, keys and ``also``."""
    own = postings.where(F.col("w") > steps[0]).select("feature_id", "image_id", "w", "w_norm", *keys, *carry)
    a, b = own.alias("a"), own.alias("b")
    level = _level(F.least("a.w", "b.w"), steps)
    condition = F.col("a.image_id") < F.col("b.image_id")
    for key in ("feature_id", *keys):
        condition = (F.col(f"a.{key}") == F.col(f"b.{key}")) & condition
    pairs = a.join(b, condition if also is None else condition & also)
    rows = pairs.select(F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b"), level.alias("level"), (F.col("a.w_norm") * F.col("b.w_norm")).alias("c"), *(F.col(f"a.{k}").alias(k) for k in keys))
    return rows.groupBy("image_a", "image_b", *keys, "level").agg(F.sum("c").alias("c"))


def _running(sums: DataFrame, steps: list[float], keys: Sequence[str]) -> DataFrame:
    """Each threshold's sums from those by level."""
    above = Window.partitionBy(*keys).orderBy(F.col("level").desc())
    running = sums.withColumn("similarity", F.sum("c").over(above)).withColumn("next_level", F.lead("level", 1, -1).over(above))
    levels = F.array(*(F.lit(float(t)) for t in steps))
    # a running sum holds from its own level down to just above the next one present
    spans = F.transform(F.sequence(F.col("next_level") + 1, F.col("level")), lambda i: F.element_at(levels, i + 1))
    return running.select(F.explode(spans).alias("threshold"), *keys, "similarity")


def sweep_summary(postings: DataFrame, thresholds: Sequence[float], ids: Text = TEXT, extent: Extent | None = None) -> DataFrame:
    """``(threshold, n_edges, sum_similarity)``; the pairs' ids aren't needed for it."""
    return _summary(_coded_sweep(postings, thresholds, ids, extent), "threshold")


def sweep_pool_summary(postings: DataFrame, members: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``(threshold, iterate, n_edges, sum_similarity)``."""
    return _summary(sweep_pool_edges(postings, members, thresholds), "threshold", "iterate")


def _summary(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("similarity").alias("sum_similarity"))
