"""Exact deduplication as two streams with disk-backed keyed state.

Stream 1 turns documents into rows of digest (SHA-256 of the text without white space),
stable identifier, length and content locator (file and row). Stream 2 keeps state by
digest in RocksDB without expiry: the identifier and locator of the row that stays, and
how many rows there are. Rows of a batch are combined before they are dealt by digest,
so a text that much of the corpus repeats costs a task one row for each map task.

Hits are then checked by full bytes: rows of groups with several members fetch their
text by locator and are compared with the one that stays; a Bloom filter of the locators,
of bounded size, keeps other texts out of that shuffle while there are up to some ten million
hits. Texts that differ under one
digest are grouped again by their whole text, so a collision can't drop a document.

The longest original text, then the smallest id, then the locator decides what stays; a
null id comes last. Ids are whole numbers of 64 bits; others raise. A null text is empty. Repeated rows are rows of their own, told apart
by locator. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bloom import bloom_of, passing, words_for
from tessera.llm.common import settings, shared_dir, text_of, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Each state partition is a RocksDB of its own, which otherwise reserves 4 MB of disk for a manifest of a few KB.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 4096
GROUPED = "digest string, best struct<n_points:long,order:long,file:string,row:long,doc_id:long>, members long, batch long"


def normalised(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_rows(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Digest, identifier, length and locator of rows from a file source, streaming or not."""
    text = text_of(text_col)
    return docs.select(
        digest(normalised(text)).alias("digest"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.char_length(text).cast("bigint").alias("n_points"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def best_of(rows: DataFrame) -> DataFrame:
    """State by digest: the row that stays, and the number of rows."""
    # of equal lengths the largest complement of the id, which is null, the smallest value, for a null id
    own = F.struct("n_points", F.bitwise_not("doc_id").alias("order"), "file", "row", "doc_id")
    return rows.groupBy("digest").agg(F.max(own).alias("best"), F.count(F.lit(1)).alias("members"))


def stream_groups(spark: SparkSession, path: str, schema: str, folder: str, id_col: str, text_col: str, digest, files_per_batch: int) -> tuple[DataFrame, DataFrame]:
    """Runs both streams over what ``path`` holds; returns the digest rows and the last state of each digest.

    A later run over the same ``folder`` takes up new files only.
    """
    rows_at, log_at = f"{folder}/digests", f"{folder}/state-log"
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_streamable(spark, path))
    stream = digest_rows(docs, id_col, text_col, digest).writeStream.format("parquet").option("path", rows_at).option("checkpointLocation", f"{folder}/checkpoint-digests")
    stream.trigger(availableNow=True).start().awaitTermination()

    def keep(batch: DataFrame, number: int) -> None:  # writing a batch again replaces it
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{log_at}/batch={number:09d}")

    row_schema = "digest string, doc_id long, n_points long, file string, row long"
    rows = spark.readStream.schema(row_schema).option("maxFilesPerTrigger", files_per_batch).parquet(rows_at)
    with settings(spark, STATE):
        state = best_of(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint-state")
        state.trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(row_schema).parquet(rows_at)
    log = spark.read.schema(GROUPED).option("recursiveFileLookup", "true").parquet(log_at) if _exists(spark, log_at) else spark.createDataFrame([], GROUPED)
    last = log.groupBy("digest").agg(F.max(F.struct("batch", "best", "members")).alias("s")).select("digest", "s.best", "s.members")
    return seen, last


def _streamable(spark: SparkSession, path: str) -> str:
    """A folder as it is; a single file as a pattern, since a stream's plain path must be a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if store.exists(at) and store.getFileStatus(at).isFile() else path


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def unequal_digests(docs: DataFrame, seen: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """Digests under which a row's full normalised bytes differ from those of the row that stays, once for each such row.

    They aren't made distinct here: an aggregate on the join's key would keep a common text in one task.
    """
    several = groups.where(F.col("members") > 1).select("digest", F.col("best.file").alias("k_file"), F.col("best.row").alias("k_row"))
    stays = (F.col("file") == F.col("k_file")) & (F.col("row") == F.col("k_row"))
    hits = written(seen.select("digest", "file", "row").join(several, "digest").select("digest", "file", "row", stays.alias("stays")), "exact-hits")
    place = ["file", "row"]
    words = words_for(hits.count())
    content = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text_of(text_col).alias("text"))
    content = passing(content, bloom_of(hits, place, words) if words else None, place, words)  # before texts are shuffled
    texts = content.join(hits, place).select("digest", "stays", normalised(F.col("text")).alias("text"))
    kept = texts.where("stays").select("digest", F.col("text").alias("kept_text"))
    return texts.where("not stays").join(kept, "digest").where(F.col("text") != F.col("kept_text")).select("digest")


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = FILES_PER_BATCH, folder: str | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest, text_group)``, one row for each document below ``path``.

    ``text_group`` is null but where texts that differ share a digest.
    """
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    folder = folder or shared_dir(spark, "exact-dedup")
    seen, groups = stream_groups(spark, path, schema, folder, id_col, text_col, digest, files_per_batch)
    docs = spark.read.schema(schema).parquet(path)
    groups = written(groups, "exact-groups")
    unequal = written(unequal_digests(docs, seen, groups, text_col), "exact-unequal")
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    result = ("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("members").alias("group_size"), stays.alias("kept"), "digest")
    found = seen.join(groups, "digest").select(*result, F.lit(None).cast("string").alias("text_group"))
    if unequal.isEmpty():
        return found
    rows = digest_rows(docs, id_col, text_col, digest)
    whole = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(text_of(text_col)).alias("text_group"))
    again = rows.join(unequal, "digest", "left_semi").join(whole, ["file", "row"])
    own = F.struct("n_points", F.bitwise_not("doc_id").alias("order"), "file", "row", "doc_id")
    split = again.groupBy("digest", "text_group").agg(F.max(own).alias("best"), F.count(F.lit(1)).alias("members"))
    return found.join(unequal, "digest", "left_anti").unionByName(again.join(split, ["digest", "text_group"]).select(*result, "text_group"))
