"""Image ids as numbers, for joins and sums over pairs.

Pairs are many and ids repeat in each of them, so pairs carry a number where there is one:
``WHOLE`` where the caller knows that every id is a whole number of 64 bits in its usual
form (as keys of tables are), or a ``Dictionary`` from the ids at hand. ``TEXT`` leaves ids
as they are. Whatever the kind, order is that of the ids as text, and ids come back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.stages import shared_folder

#: Rows of (number, id) that may be broadcast: some tens of megabytes.
BROADCAST_IDS = 1_000_000


class Text:
    """Ids as they are."""

    def coded(self, rows: DataFrame) -> DataFrame:
        """Adds ``code``, what pairs carry instead of ``image_id``."""
        return rows.withColumn("code", F.col("image_id"))

    def before(self, a: Column, b: Column) -> Column:
        """Whether the id of one code comes before that of another."""
        return a < b

    def order(self, code: Column) -> Column:
        """What sorts codes as their ids are as text."""
        return code

    def restored(self, pairs: DataFrame, *keep: str) -> DataFrame:
        """``(image_a, image_b)`` and the columns ``keep`` of pairs of codes ``(a, b)``."""
        return pairs.select(F.col("a").alias("image_a"), F.col("b").alias("image_b"), *keep)


class Whole(Text):
    """Ids that are whole numbers: ``cast(cast(id as bigint) as string)`` is the id."""

    def coded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("code", F.col("image_id").cast("bigint"))

    def before(self, a: Column, b: Column) -> Column:
        return a.cast("string") < b.cast("string")

    def order(self, code: Column) -> Column:
        return code.cast("string")

    def restored(self, pairs: DataFrame, *keep: str) -> DataFrame:
        return pairs.select(F.col("a").cast("string").alias("image_a"), F.col("b").cast("string").alias("image_b"), *keep)


class Dictionary(Text):
    """A table of ids and numbers in the same order, written once.

    Ids are range-partitioned and sorted; a number is the partition and the place in it, so
    no task sees all ids. It is written because ranges are drawn from a sample: a second
    evaluation could draw others.
    """

    def __init__(self, ids: DataFrame):
        path = shared_folder(ids.sparkSession, "image-numbers")
        known = ids.select("image_id").where("image_id IS NOT NULL").distinct().repartitionByRange("image_id").sortWithinPartitions("image_id")
        known.select("image_id", F.monotonically_increasing_id().alias("code")).write.parquet(path)
        self.table = ids.sparkSession.read.schema("image_id string, code long").parquet(path)
        self.size = self.table.count()

    def _side(self) -> DataFrame:
        return F.broadcast(self.table) if self.size <= BROADCAST_IDS else self.table

    def coded(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._side(), "image_id")

    def restored(self, pairs: DataFrame, *keep: str) -> DataFrame:
        names = self._side()
        a, b = (names.select(F.col("code").alias(c), F.col("image_id").alias(f"image_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("image_a", "image_b", *keep)


TEXT, WHOLE = Text(), Whole()
