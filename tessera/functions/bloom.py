"""A Bloom filter of bounded size as one row of 64-bit words, built and tested by column expressions.

It travels as a broadcast of that row, at most ``MOST_WORDS`` words, so it may stand in
front of a shuffle: rows that can't match are dropped before they move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 10  # about one key in a hundred passes by mistake
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20  # eight megabytes


def words_for(keys: int) -> int | None:
    """Words for so many keys, a power of two; None where the largest filter would let most rows through."""
    wanted = 1 << max(0, keys * BITS_PER_KEY // 64 - 1).bit_length()
    return min(MOST_WORDS, max(LEAST_WORDS, wanted)) if wanted <= 2 * MOST_WORDS else None


def _places(keys: list[Column | str], words: int) -> list[Column]:
    own = F.xxhash64(*keys)
    return [F.pmod(F.xxhash64(F.lit(i), own), F.lit(64 * words)) for i in range(HASHES)]


def bloom_of(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """One row ``bloom`` of the rows' keys."""
    place = rows.select(F.explode(F.array(*_places(keys, words))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int"))
    found = place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = rows.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    dense = found.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("bloom"))


def might_contain(bloom: Column, keys: list[Column | str], words: int) -> Column:
    """False only for keys that aren't in the filter."""
    tests = [F.getbit(F.get(bloom, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(keys, words)]
    return reduce(lambda a, b: a & b, tests)


def passing(rows: DataFrame, bloom: DataFrame | None, keys: list[Column | str], words: int | None) -> DataFrame:
    """Rows whose keys might be in the filter; all of them without one."""
    if bloom is None or words is None:
        return rows
    names = rows.columns
    return rows.crossJoin(F.broadcast(bloom)).where(might_contain(F.col("bloom"), keys, words)).select(*names)
