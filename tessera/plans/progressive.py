"""A graph that grows by batches of images, kept as a table of edge sums.

A batch brings images with their postings, and their pools if pairs are to share one. Its
edges are those of its images among themselves and with all images before: pairs of two
old images aren't formed again. Each batch's edges are rows of their own, and the graph
is all of them; ``compact`` makes one table of them.

Which batches there are is told by versions, small files written after the rows, so a run
that stops in between changes nothing. A batch added again under its name is compared
with what was added: the same rows change nothing, others are an error, as is an image
that an earlier batch has. Weights must come from one set of statistics (see
``StatisticsStore``); sums already stored aren't weighted again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.candidates import in_first_shared_pool, pools_meet, signed_pools, with_pools
from tessera.stages import Folder

EDGES = "image_a string, image_b string, similarity double"
POSTINGS = "feature_id long, image_id string, w double, w_norm double"
MEMBERS = "cluster_id string, image_id string"


def fresh_edges(new: DataFrame, old: DataFrame, members: DataFrame | None, threshold: float, short: bool = False) -> DataFrame:
    """Sums of pairs of which one image at least is new. The new side drives the join, so old postings that no new image meets go no further.

    Where the caller knows that posting lists are ``short``, images' lists of pools are compared
    where postings meet; else postings are joined by (feature, pool).
    """
    keys, also = ["feature_id"], F.lit(True)
    fresh, rest = (rows.where(F.col("w") > threshold).select("feature_id", "image_id", "w_norm", F.lit(is_old).alias("old")) for rows, is_old in ((new, False), (old, True)))
    if members is not None:
        pools = signed_pools(members) if short else with_pools(members)
        fresh, rest = fresh.join(pools, "image_id"), rest.join(pools, "image_id")
        keys, also = (["feature_id"], pools_meet()) if short else (["feature_id", "cluster_id"], in_first_shared_pool())
    a, b = fresh.alias("a"), fresh.unionByName(rest).alias("b")
    met: Column = (F.col("b.old") | (F.col("a.image_id") < F.col("b.image_id"))) & also
    for key in keys:
        met = (F.col(f"a.{key}") == F.col(f"b.{key}")) & met
    ids = ("a.image_id", "b.image_id")
    rows = a.join(b, met).select(F.least(*ids).alias("image_a"), F.greatest(*ids).alias("image_b"), (F.col("a.w_norm") * F.col("b.w_norm")).alias("contribution"))
    return rows.groupBy("image_a", "image_b").agg(F.sum("contribution").alias("similarity")).where(F.col("similarity") > 0)


class ProgressiveGraph:
    """The stored graph below ``path``. ``threshold`` is that on raw weights; ``pooled`` graphs join images that share a pool."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.0, pooled: bool = True):
        self.spark, self.threshold, self.pooled = spark, threshold, pooled
        self.folder = Folder(spark, path)

    def _version(self) -> tuple[int, list[dict]]:
        """Number and content of the latest version: batches and where their rows are."""
        names = [n for n in self.folder.names("versions") if n.isdigit()]
        if not names:
            return 0, []
        made = json.loads(self.folder.read("versions", names[-1]))
        if (made["threshold"], made["pooled"]) != (self.threshold, self.pooled):
            raise ValueError(f"the stored graph has threshold {made['threshold']} and pooled {made['pooled']}")
        return int(names[-1]), made["batches"]

    def _commit(self, number: int, batches: list[dict]) -> None:
        self.folder.put(json.dumps({"threshold": self.threshold, "pooled": self.pooled, "batches": batches}), "versions", f"{number:09d}")
        for n in self.folder.names("versions"):
            if n != f"{number:09d}":
                self.folder.delete("versions", n)
        used = {at for b in batches for at in (b["rows"], b["edges"])}
        for name in self.folder.names("data"):  # of earlier versions, or of runs that stopped
            if name not in used:
                self.folder.delete("data", name)

    def _read(self, batches: list[dict], kind: str, schema: str) -> DataFrame:
        at = [self.folder.at("data", b["rows" if kind != "edges" else "edges"], kind) for b in batches]
        return self.spark.read.schema(schema).parquet(*dict.fromkeys(at)) if at else self.spark.createDataFrame([], schema)

    def batches(self) -> list[str]:
        return [b["name"] for b in self._version()[1]]

    def add(self, name: str, postings: DataFrame, members: DataFrame | None = None, short: bool = False) -> bool:
        """Adds a batch; False if it is there already, with the same rows. ``short`` is as in ``fresh_edges``."""
        if self.pooled != (members is not None):
            raise ValueError("a pooled graph needs the pools of each batch, another has none")
        number, batches = self._version()
        at = f"rows-{uuid.uuid4().hex}"
        own = postings.select(F.col("feature_id").cast("bigint").alias("feature_id"), F.col("image_id").cast("string").alias("image_id"), F.col("w").cast("double").alias("w"), F.col("w_norm").cast("double").alias("w_norm"))
        own.write.parquet(self.folder.at("data", at, "postings"))
        pools = members.select(F.col("cluster_id").cast("string").alias("cluster_id"), F.col("image_id").cast("string").alias("image_id")).distinct() if members is not None else self.spark.createDataFrame([], MEMBERS)
        pools.write.parquet(self.folder.at("data", at, "members"))
        batch = {"name": name, "rows": at, "edges": f"edges-{uuid.uuid4().hex}"}
        batch["fingerprint"] = self._fingerprint([batch])
        same = [b for b in batches if b["name"] == name]
        if same:
            self.folder.delete("data", at)
            if same[0]["fingerprint"] != batch["fingerprint"]:
                raise ValueError(f"batch {name!r} was added with other rows")
            return False
        new, old = (self._read(x, "postings", POSTINGS) for x in ([batch], batches))
        known = self._images(batches)
        if not self._images([batch]).join(known, "image_id", "left_semi").isEmpty():
            self.folder.delete("data", at)
            raise ValueError(f"batch {name!r} has images of an earlier batch")
        everyone = self._read([*batches, batch], "members", MEMBERS) if self.pooled else None
        fresh_edges(new, old, everyone, self.threshold, short).write.parquet(self.folder.at("data", batch["edges"], "edges"))
        self._commit(number + 1, [*batches, batch])
        return True

    def _images(self, batches: list[dict]) -> DataFrame:
        return self._read(batches, "postings", POSTINGS).select("image_id").unionByName(self._read(batches, "members", MEMBERS).select("image_id")).distinct()

    def _fingerprint(self, batches: list[dict]) -> str:
        """Of a batch's rows, whatever their order: their number and the sum of their hashes."""
        told = []
        for kind, schema in (("postings", POSTINGS), ("members", MEMBERS)):
            rows = self._read(batches, kind, schema)
            r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
            told.append(f"{r.n}:{r.h}")
        return "/".join(told)

    def edges(self) -> DataFrame:
        """The whole graph: each pair is in one batch's rows, that of its later image."""
        return self._read(self._version()[1], "edges", EDGES)

    def compact(self) -> None:
        """Makes one table of all batches' edges; batches and result stay."""
        number, batches = self._version()
        if len({b["edges"] for b in batches}) > 1:
            at = f"edges-{uuid.uuid4().hex}"
            self.edges().repartition("image_a").write.parquet(self.folder.at("data", at, "edges"))
            self._commit(number + 1, [{**b, "edges": at} for b in batches])
