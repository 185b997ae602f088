"""Writers: Parquet for use downstream, and key-tab-value text for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_lines(edges: DataFrame, *keep: Column | str) -> DataFrame:
    """``(a,b) TAB similarity`` lines, after the columns ``keep``."""
    pair = F.concat(F.lit("("), "image_a", F.lit(","), "image_b", F.lit(")"))
    return edges.select(*keep, F.concat(pair, F.lit("\t"), F.col("similarity").cast("string")).alias("value"))


def write_text(lines: DataFrame, path: str, compress: bool = False) -> None:
    """One-column text; ``compress`` writes gzip files."""
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_sweep(edges: DataFrame, path: str, thresholds: dict[float, str], compress: bool = False) -> None:
    """Edge text of a sweep in folders ``threshold_T/min_hash_iterateJ``, thresholds named as given; one write, then renames.

    A run whose graph is empty has no folder.
    """
    spark = edges.sparkSession
    named = F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair))[F.col("threshold")]
    lines = edge_lines(edges, named.alias("threshold"), "iterate")
    lines.write.mode("overwrite").partitionBy("threshold", "iterate").option("compression", "gzip" if compress else "none").text(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    at = spark._jvm.org.apache.hadoop.fs.Path
    for folder in [x.getPath() for x in store.listStatus(root) if x.isDirectory()]:
        for run in [x.getPath() for x in store.listStatus(folder) if x.isDirectory()]:
            store.rename(run, at(folder, run.getName().replace("iterate=", "min_hash_iterate")))
        store.rename(folder, at(root, folder.getName().replace("threshold=", "threshold_")))


def write_edges(edges: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet edges, in folders by the given columns, such as a sweep's threshold."""
    edges.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
