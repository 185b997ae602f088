"""What several operators share: shared folders, materialised steps, ranks without hot groups."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: white space as the contracts define it, ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\f\r"


_roots: list[str] = []  # of open scratch blocks, innermost last


def _base(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import atexit
    import shutil
    import sys
    import tempfile

    module = sys.modules[__name__].__dict__
    if "_local" not in module:  # one for each driver process, removed when it ends
        module["_local"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, module["_local"], ignore_errors=True)
    return f"file://{module['_local']}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only on a local master, as in tests, may the setting be absent; a local folder is used then.
    """
    return f"{_roots[-1] if _roots else _base(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Puts the operators' intermediate tables into one folder and deletes it at the end.

    Results are lazy, so write them inside the block.
    """
    root = f"{_base(spark)}/scratch-{uuid.uuid4().hex}"
    _roots.append(root)
    try:
        yield root
    finally:
        _roots.remove(root)
        remove(spark, root)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts lineage and fixes what later steps see."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for as long as the block lasts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(rows: int = 1_000) -> dict[str, str]:
    """Settings for steps that send texts to Python and are written at once: an Arrow batch of long texts stays small."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}


def text_of(column: str = "text") -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast path, which does the same there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    """Buckets so that each holds about ``per_bucket`` rows; grows with the rows."""
    return max(16, -(-rows // per_bucket))


def ranked(df: DataFrame, keys: list[str], order: str, buckets: int, rank: str = "rank") -> DataFrame:
    """0-based rank by the hash column ``order`` (a bigint, spread evenly) within ``keys``.

    A group that holds much of the data isn't gathered: rows are numbered within
    (keys, slice of the hash range), and the counts of lower slices are added. The
    counts are one row per (keys, slice), combined before their shuffle.
    """
    bits = max(1, (buckets - 1).bit_length())
    part = F.shiftrightunsigned(order, 64 - bits).cast("int")  # ranks follow the hash read as unsigned
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.coalesce(below, F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = F.col(k).eqNullSafe(F.col(f"_k{i}")) & on
    own = Window.partitionBy(*keys, "_part").orderBy(order)
    numbered = rows.withColumn("_row", F.row_number().over(own) - 1)
    return numbered.join(before, on).withColumn(rank, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_p", *(f"_k{i}" for i in range(len(keys))))


def per_process(key: str, make, version: object = None):
    """An object made once in each Python worker, such as a loaded vocabulary.

    A worker serves one operator at a time and keeps the latest object only: another
    key or version replaces it, so the operators of a pipeline don't add up.

    Functions travel by value, so a module's own globals wouldn't last; a module
    entry of the worker's interpreter does.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept")).__dict__
    if kept.get("key") != (key, version):
        kept.pop("value", None)
        kept |= {"value": make(), "key": (key, version)}
    return kept["value"]


def released(run):
    """A step over Arrow batches that gives its free memory back to the system when it ends.

    Workers live on for later steps, and what Arrow and the allocator keep for reuse would
    add up beside the JVM's heap.
    """

    def step(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return step


def open_store(uri: str):
    """File system and path of a URI, in a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
