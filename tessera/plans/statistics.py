"""Corpus statistics kept between runs, by the input files they were counted in.

A document is a line, so what a file adds to the corpus doesn't depend on other files:
its lines, their features, and each feature's frequency. These are counted once for a
file and merged by sums; adding files scans those alone. A file is known by path, size
and time of change. One that has changed or gone since it was counted is stale: an error,
unless the caller has it forgotten, and then counted again if it is still there.

The list of counted files is one small marker, replaced as a whole after the counts are
written, so a run that stops in between has counted nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalised_idf
from tessera.sources.text import read_features
from tessera.stages import Folder

MARKER = "files.json"


def _plain_path(path: Column) -> Column:
    """``file:/x`` and ``file:///x`` are one file."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


class StaleInput(ValueError):
    """Files that were counted and have changed or gone since."""


class StatisticsStore:
    """Counts of feature files below ``path``; ``options`` are those of ``read_features``."""

    def __init__(self, spark: SparkSession, path: str, **options: object):
        self.spark, self.options = spark, options
        self.folder = Folder(spark, path)
        self._uris: dict[str, str] = {}

    def _known(self) -> dict[str, dict]:
        return json.loads(self.folder.read(MARKER)) if self.folder.exists(MARKER) else {}

    def _listed(self, pattern: str) -> dict[str, str]:
        """Fingerprint of each input file: size and time of change."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, str] = {}

        def visit(status) -> None:
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                return
            if status.isDirectory():
                for x in store.listStatus(status.getPath()):
                    visit(x)
            else:
                found[status.getPath().toString()] = f"{status.getLen()}-{status.getModificationTime()}"
                self._uris[status.getPath().toString()] = status.getPath().toUri().toString()  # as Spark names the file of a row

        for status in store.globStatus(at) or ():
            visit(status)
        return found

    def update(self, pattern: str, forget_stale: bool = False) -> list[str]:
        """Counts the files of a path or pattern that aren't counted yet; returns them."""
        known, listed = self._known(), self._listed(pattern)
        stale = [f for f, x in known.items() if f in listed and listed[f] != x["fingerprint"] or f not in listed and self._gone(f)]
        if stale and not forget_stale:
            raise StaleInput(f"changed or gone since they were counted: {stale}")
        known = {f: x for f, x in known.items() if f not in set(stale)}
        new = sorted(f for f in listed if f not in known)
        part = f"counts-{uuid.uuid4().hex}"
        if new:
            rows = read_features(self.spark, new, line_ids=True, keep=("file",), **self.options)
            positive = F.col("value") > 0
            by_line = rows.groupBy("file", "line_id").agg(F.count(F.lit(1)).alias("dl"), F.count_if(positive).alias("positive"))
            by_line.groupBy("file").agg(F.count(F.lit(1)).alias("n_images"), F.sum("dl").alias("length"), F.sum("positive").alias("n_positive")).write.parquet(self.folder.at(part, "files"))
            rows.where(positive).groupBy("file", "feature_id").agg(F.count(F.lit(1)).alias("df")).write.parquet(self.folder.at(part, "features"))
        known |= {f: {"fingerprint": listed[f], "part": part, "uri": self._uris[f]} for f in new}
        if new or stale:
            self.folder.put(json.dumps(known), MARKER)
        for name in self.folder.names():  # counts of no known file any more, or of a run that stopped
            if name != MARKER and name not in {x["part"] for x in known.values()}:
                self.folder.delete(name)
        return new

    def _gone(self, file: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        return not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _counts(self, kind: str, schema: str) -> DataFrame:
        known = self._known()
        parts = sorted({x["part"] for x in known.values()})
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(self.folder.at(p, kind) for p in parts)).withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"/(counts-[0-9a-f]+)/", 1))
        # a part may hold files that have been forgotten since
        names = self.spark.createDataFrame([(x["uri"], x["part"]) for x in known.values()], "k_file string, k_part string")
        own = F.col("k_part") == F.col("part")
        return rows.join(F.broadcast(names) if len(known) < 100_000 else names, own & (_plain_path(F.col("file")) == _plain_path(F.col("k_file"))), "left_semi").drop("part")

    def stats(self) -> DataFrame:
        """One row ``(n_images, adl, n_positive)``, as ``corpus_stats`` of all counted files with line ids."""
        rows = self._counts("files", "file string, n_images long, length long, n_positive long")
        return rows.agg(F.coalesce(F.sum("n_images"), F.lit(0)).alias("n_images"), F.try_divide(F.sum("length"), F.sum("n_images")).alias("adl"), F.sum("n_positive").alias("n_positive"))

    def idf(self) -> DataFrame:
        """``(feature_id, df, idf)`` over all counted files."""
        df = self._counts("features", "file string, feature_id int, df long").groupBy("feature_id").agg(F.sum("df").alias("df"))
        return df.crossJoin(F.broadcast(self.stats())).select("feature_id", "df", normalised_idf(F.col("n_images"), F.col("df")).alias("idf"))
