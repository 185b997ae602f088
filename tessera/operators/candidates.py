"""Pools of images that may be similar, and the candidate pairs they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dealing import dealt

#: Fixed value: the pool of images without one.
UNKNOWN = "unknown"
#: Members of a pool in one block. Two blocks meet in one row; a task holds the pairs of one member with a block at a time.
BLOCK = 2_048


def cluster_members(pools: DataFrame, min_size: int = 0) -> DataFrame:
    """``(cluster_id, image_id)`` of pools with more than ``min_size`` listed members.

    Sizes are a grouped count joined back, so a pool that holds much of the data
    is never gathered in one place: the count is combined before the shuffle, and
    adaptive execution splits the skewed side of the join.
    """
    if min_size <= 0:
        return pools.select("cluster_id", "image_id")
    kept = pools.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > min_size)
    return pools.join(kept.select("cluster_id"), "cluster_id").select("cluster_id", "image_id")


def with_pools(members: DataFrame, flagged: bool = False) -> DataFrame:
    """``(cluster_id, image_id, lower[, own, flags])``: each distinct membership with the image's smaller pools.

    ``own`` are the image's flags in the pool and ``flags`` those in all its pools. An
    image's own pools are few, so its row stays small.
    """
    lower = F.slice("pools", F.lit(1), F.col("at")).alias("lower")
    if not flagged:
        rows = members.groupBy("image_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("pools"))
        return rows.select(F.posexplode("pools").alias("at", "cluster_id"), "image_id", "pools").select("cluster_id", "image_id", lower)
    each = members.where("cluster_id IS NOT NULL").groupBy("image_id", "cluster_id").agg(F.collect_set("sample_flag").alias("f"))
    rows = each.groupBy("image_id").agg(F.array_sort(F.collect_list("cluster_id")).alias("pools"), F.map_from_entries(F.collect_list(F.struct("cluster_id", "f"))).alias("flags"))
    rows = rows.select(F.posexplode("pools").alias("at", "cluster_id"), "image_id", "pools", "flags")
    return rows.select("cluster_id", "image_id", lower, F.element_at("flags", F.col("cluster_id")).alias("own"), "flags")


def in_first_shared_pool(flagged: bool = False) -> Column:
    """Whether rows ``a`` and ``b`` of ``with_pools`` meet in the smallest pool that counts for the pair.

    A pair that shares several pools meets in each; this lets it count once without a
    distinct over pairs. Most pairs are settled by an empty list.
    """
    first = (F.size("a.lower") == 0) | (F.size("b.lower") == 0) | ~F.arrays_overlap("a.lower", "b.lower")
    if not flagged:
        return first
    counted = F.exists(F.array_intersect("a.lower", "b.lower"), lambda c: eligible_flag_sets(F.element_at("a.flags", c), F.element_at("b.flags", c)))
    single = (F.size("a.own") == 1) & (F.size("b.own") == 1)
    eligible = F.when(single, eligible_flags(F.get("a.own", F.lit(0)), F.get("b.own", F.lit(0)))).otherwise(eligible_flag_sets(F.col("a.own"), F.col("b.own")))
    return eligible & (first | ~counted)


def pool_blocks(members: DataFrame, n_rows: int = 0) -> DataFrame:
    """``(cluster_id, block, ids, larger)``: the distinct members of each pool, dealt by hash to blocks of about ``BLOCK``.

    ``larger`` are the pools of each member that come before this one, larger pools first;
    null where no member of the block has any. A pool's members are never gathered or sorted
    in one task; within a block they are in order. The number of tasks is fixed: Spark would
    merge blocks by their few bytes, of which each becomes many pairs.
    """
    known = members.where("cluster_id IS NOT NULL AND image_id IS NOT NULL")
    sizes = known.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    pools = F.array_sort(F.collect_set(F.struct((-F.col("size")).alias("order"), "cluster_id")))
    rows = known.join(sizes, "cluster_id").groupBy("image_id").agg(pools.alias("pools"))
    rows = rows.select("image_id", F.col("pools.cluster_id").alias("pools"), F.posexplode("pools").alias("at", "pool"))
    block = F.pmod(F.xxhash64("image_id"), F.ceil(-F.col("pool.order") / BLOCK))
    rows = rows.select(F.col("pool.cluster_id").alias("cluster_id"), block.alias("block"), "image_id", F.slice("pools", F.lit(1), F.col("at")).alias("larger"))
    blocks = dealt(rows, n_rows, "cluster_id", "block", fixed=True).groupBy("cluster_id", "block").agg(F.array_sort(F.collect_list(F.struct("image_id", "larger"))).alias("of"), F.max(F.size("larger")).alias("most"))
    return blocks.select("cluster_id", "block", F.col("of.image_id").alias("ids"), F.when(F.col("most") > 0, F.col("of.larger")).alias("larger"))


def _share(a: Column, b: Column) -> Column:
    """``arrays_overlap`` that makes no hash table when one list has one element."""
    first = lambda c: F.get(c, F.lit(0))
    return F.when(F.size(a) == 1, F.array_contains(b, first(a))).when(F.size(b) == 1, F.array_contains(a, first(b))).otherwise(F.arrays_overlap(a, b))


def cluster_pairs(members: DataFrame, n_rows: int = 0) -> DataFrame:
    """Distinct ``(image_a, image_b)``, a before b as strings, that share a pool.

    All pairs of a pool are the result asked for, so its size is the square of a pool's;
    graphs don't need it (their plan ``pools`` lists no pairs). Blocks of a pool are joined
    instead of members, by pool and lower block, so a large pool is dealt over many tasks.
    Where two blocks meet they are merged in order once; a member is then listed with the end of
    the other block beyond it, so no pair is put in order by itself. A pair counts in the largest pool it
    shares: the many pairs of the largest pools need no look at others.
    """
    blocks = pool_blocks(members, n_rows)
    later = blocks.select("cluster_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("block"), F.col("block").alias("b_block"), F.col("ids").alias("b_ids"), F.col("larger").alias("b_larger"))
    met = later.join(blocks, ["cluster_id", "block"]).select((F.col("block") == F.col("b_block")).alias("same"), "ids", "larger", "b_ids", "b_larger")
    # the lambda keeps this explode out of the next one's generated code, which holds all rows that come from one row at a time
    entry = lambda c, first: F.transform(c, lambda x, i: F.struct(x.alias("id"), F.lit(first).alias("first"), i.alias("i")))
    merged = F.when(F.col("same"), entry("ids", True)).otherwise(F.array_sort(F.concat(entry("ids", True), entry("b_ids", False))))
    rows = met.select("same", "ids", "larger", "b_ids", "b_larger", F.posexplode(merged).alias("at", "e"))
    turn = lambda x, y: F.when(F.col("e.first"), F.col(x)).otherwise(F.col(y))
    skip = F.when(F.col("same"), F.col("at") + 1).otherwise(F.col("at") - F.col("e.i"))
    rows = rows.select(F.col("e.id").alias("image_a"), F.get(turn("larger", "b_larger"), F.col("e.i")).alias("own"), turn("b_ids", "ids").alias("others"), turn("b_larger", "larger").alias("larger"), skip.alias("skip"))
    rows = rows.where(F.col("skip") < F.size("others")).select("image_a", "own", "larger", "skip", F.posexplode(F.slice("others", F.col("skip") + 1, F.size("others"))).alias("j", "image_b"))
    new = F.col("own").isNull() | F.col("larger").isNull() | ~_share(F.col("own"), F.get("larger", F.col("skip") + F.col("j")))
    return rows.where(new).select("image_a", "image_b")


def supplied_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct ``(image_a, image_b)``, a before b, of a table of pairs in any order; nulls and an image with itself are no pairs."""
    a, b = F.col("image_a").cast("string"), F.col("image_b").cast("string")
    return pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("image_a"), F.greatest(a, b).alias("image_b")).distinct()


def eligible_flags(a: Column, b: Column) -> Column:
    """Whether a pair is to be computed: flags differ, or both are ``in``."""
    return (a != b) | ((a == "in") & (b == "in"))


def eligible_flag_sets(a: Column, b: Column) -> Column:
    """``eligible_flags`` of some flag of each set; a membership repeated with other flags has several."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_union(a, b)) > 1) | F.array_contains(F.array_intersect(a, b), "in"))


def signed_pools(members: DataFrame, flagged: bool = False, n_rows: int = 0) -> DataFrame:
    """``(image_id, cluster_ids, signature[, flag, flags])``; the signature has a bit for each pool's hash.

    ``flag`` is the image's only flag, where it has the same one in all its pools; others have
    ``flags``, those in each pool.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64("cluster_id"), F.lit(64)).cast("int"))
    known = members.where(F.col("cluster_id").isNotNull())
    if not flagged:
        return known.groupBy("image_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"), F.bit_or(bit).alias("signature"))
    each = dealt(known, n_rows, "image_id").groupBy("image_id", "cluster_id").agg(F.collect_set("sample_flag").alias("f"))
    rows = each.groupBy("image_id").agg(
        F.array_sort(F.collect_list("cluster_id")).alias("cluster_ids"),
        F.bit_or(bit).alias("signature"),
        F.array_distinct(F.flatten(F.collect_list("f"))).alias("every"),
        F.min(F.size("f")).alias("least"),
        F.map_from_entries(F.collect_list(F.struct("cluster_id", "f"))).alias("of"),
    )
    rows = rows.withColumn("flag", F.when((F.size("every") == 1) & (F.col("least") == 1), F.get("every", F.lit(0))))
    return rows.select("image_id", "cluster_ids", "signature", "flag", F.when(F.col("flag").isNull(), F.col("of")).alias("flags"))


def signatures_meet() -> Column:
    """Whether rows ``a`` and ``b`` have a bit in common: if not, they share no pool, and their lists needn't be read."""
    return F.col("a.signature").bitwiseAND(F.col("b.signature")) != 0


def pools_meet(flagged: bool = False) -> Column:
    """Whether rows ``a`` and ``b`` of ``signed_pools`` share a pool that counts for the pair."""
    shared = F.arrays_overlap("a.cluster_ids", "b.cluster_ids")
    if not flagged:
        return signatures_meet() & shared
    of = lambda x, c: F.when(F.col(f"{x}.flag").isNotNull(), F.array(f"{x}.flag")).otherwise(F.element_at(f"{x}.flags", c))
    some = F.exists(F.array_intersect("a.cluster_ids", "b.cluster_ids"), lambda c: eligible_flag_sets(of("a", c), of("b", c)))
    single = F.col("a.flag").isNotNull() & F.col("b.flag").isNotNull()
    return signatures_meet() & F.when(single, eligible_flags(F.col("a.flag"), F.col("b.flag")) & shared).otherwise(some)


def flagged_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs without those whose equal flags aren't ``in``: old against old isn't computed again."""
    rows = with_pools(members, flagged=True)
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.image_id") < F.col("b.image_id")) & in_first_shared_pool(flagged=True)
    return a.join(b, met).select(F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b"))


def cluster_ids(members: DataFrame) -> DataFrame:
    """``(image_id, cluster_ids)``: only membership matters, so ids are a sorted set."""
    return members.groupBy("image_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))


def cluster_join(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of images that have a pool, with the pools' ids."""
    return rows.join(cluster_ids(members), "image_id")


def cluster_left_join(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with one pool each, or ``unknown``.

    Where an image has several pools, the largest id is taken; a rule by arrival
    order would change from run to run.
    """
    one = members.groupBy("image_id").agg(F.max("cluster_id").alias("cluster_id"))
    return rows.join(one, "image_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(UNKNOWN)))
