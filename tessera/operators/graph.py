"""Weighted graphs ``(image_a, image_b, similarity)`` from postings.

Both sides of every self-join are the same plan, so one shuffle by feature serves
both; thresholds filter each side before it. Contributions are multiplied before
the sum's shuffle and partially summed on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bloom import bloom_of, passing, words_for
from tessera.operators.candidates import cluster_left_join, cluster_pairs, flagged_pairs, in_first_shared_pool, pools_meet, signatures_meet, signed_pools, supplied_pairs, with_pools
from tessera.operators.dealing import dealt
from tessera.operators.ids import TEXT, Text
from tessera.operators.pairs import BLOCK, few, pair_sums
from tessera.operators.weights import Extent


def _contributions(postings: DataFrame, keys: list[str], carry: tuple[str, ...] = (), residual: Column | None = None, product: Column | None = None) -> DataFrame:
    own = postings.select(*keys, "image_id", "w_norm", *carry)
    a, b = own.alias("a"), own.alias("b")
    condition = F.col("a.image_id") < F.col("b.image_id")
    for key in keys:
        condition = (F.col(f"a.{key}") == F.col(f"b.{key}")) & condition
    if residual is not None:
        condition = condition & residual
    term = F.col("a.w_norm") * F.col("b.w_norm") if product is None else product
    return a.join(b, condition).select(
        F.col("a.image_id").alias("image_a"),
        F.col("b.image_id").alias("image_b"),
        *(F.col(f"a.{key}").alias(key) for key in keys),
        term.alias("contribution"),
    )


def _summed(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("image_a", "image_b").agg(F.sum("contribution").alias("similarity"))


def similarity_graph(postings: DataFrame, threshold: float = 0.0, edge_threshold: float | None = None, ids: Text = TEXT, extent: Extent | None = None) -> DataFrame:
    """All pairs that share a feature whose raw weights both exceed the threshold; optionally only those whose sum exceeds another, found by bounds."""
    rows = postings.where(F.col("w") > threshold)
    if edge_threshold is None or (few(extent) and extent.most_images <= BLOCK and edge_threshold > 0):  # short vectors and lists: pairs are done where they meet
        return pair_sums(rows, ids=ids, extent=extent, above=edge_threshold)
    return bounded_graph(rows, edge_threshold)


def similarity_graph_bag(postings: DataFrame, threshold: float = 0.0, ids: Text = TEXT, extent: Extent | None = None) -> DataFrame:
    """As ``similarity_graph`` for postings that repeat (image, feature): every repeat counts, and pairs of an image with itself appear."""
    return pair_sums(postings.where(F.col("w") > threshold), ids=ids, extent=extent, same=True)


def cluster_overlap_graph(postings: DataFrame, members: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs whose lists of pools share an id, tested beside the join on the feature."""
    rows = postings.where(F.col("w") > threshold).join(signed_pools(members), "image_id")
    return _summed(_contributions(rows, ["feature_id"], ("cluster_ids", "signature"), signatures_meet() & F.arrays_overlap("a.cluster_ids", "b.cluster_ids")))


def cluster_feature_graph(postings: DataFrame, members: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs joined by (feature, pool); a feature counts once, in the pair's first shared pool, however many the pair shares."""
    return _summed(_pool_contributions(postings.where(F.col("w") > threshold), members))


def overlapping_cluster_graph(postings: DataFrame, members: DataFrame, threshold: float = 0.0, ids: Text = TEXT, extent: Extent | None = None) -> DataFrame:
    """Pairs in the same single pool, images without one sharing ``unknown``; the threshold is on normalised weights."""
    rows = cluster_left_join(postings.where(F.col("w_norm") > threshold), members)
    return pair_sums(rows, ["feature_id", "cluster_id"], ids, extent)


def _pool_contributions(rows: DataFrame, members: DataFrame, flagged: bool = False) -> DataFrame:
    """Pairs joined by (feature, pool), a feature once for each pair: the cost follows pairs that share both, and no candidate pair is listed."""
    own = rows.select("image_id", "feature_id", "w_norm").join(with_pools(members, flagged), "image_id")
    return _contributions(own, ["feature_id", "cluster_id"], ("lower", "own", "flags") if flagged else ("lower",), in_first_shared_pool(flagged))


def _candidate_contributions(rows: DataFrame, candidates: DataFrame, product: Column) -> DataFrame:
    """Candidates joined to both images' postings: the cost follows the candidates' vectors."""
    own = rows.select("feature_id", "image_id", "w_norm")
    left = candidates.join(own.alias("a"), F.col("image_a") == F.col("a.image_id"))
    both = left.join(own.alias("b"), (F.col("image_b") == F.col("b.image_id")) & (F.col("a.feature_id") == F.col("b.feature_id")))
    return both.select("image_a", "image_b", product.alias("contribution"))


def _on_candidates(rows: DataFrame, members: DataFrame, plan: str, flagged: bool = False, n_rows: int = 0) -> DataFrame:
    """Positive sums over pairs that share a pool, by one of four plans with the same result.

    ``pools`` joins by (feature, pool). ``lists`` joins by feature and compares the images' lists of
    pools there, so a posting isn't repeated for each pool; it suits short posting lists. ``candidates`` lists the candidate pairs first,
    which suits small pools and long posting lists. ``features`` joins by feature and
    semi-joins the candidates below the sum, which suits pools that hold most images.
    """
    product = F.col("a.w_norm") * F.col("b.w_norm")
    if plan == "pools":
        return _summed(_pool_contributions(rows, members, flagged)).where(F.col("similarity") > 0)
    if plan == "lists":
        own = dealt(rows.select("image_id", "feature_id", "w_norm").join(signed_pools(members, flagged, n_rows), "image_id"), n_rows, "feature_id")
        return _summed(_contributions(own, ["feature_id"], ("cluster_ids", "signature", *(("flag", "flags") if flagged else ())), pools_meet(flagged))).where(F.col("similarity") > 0)
    pairs = flagged_pairs(members) if flagged else cluster_pairs(members)
    if plan == "candidates":
        found = _candidate_contributions(rows, pairs, product)
    elif plan == "features":
        found = _contributions(rows, ["feature_id"], product=product).join(pairs, ["image_a", "image_b"], "left_semi")
    else:
        raise ValueError(f"no plan {plan!r}")
    return _summed(found).where(F.col("similarity") > 0)


def candidate_graph(postings: DataFrame, members: DataFrame, threshold: float = 0.0, plan: str = "pools") -> DataFrame:
    """Pairs that share a pool, kept where the sum is positive."""
    return _on_candidates(postings.where(F.col("w") > threshold), members, plan)


def short_lists(extent: Extent | None) -> bool:
    """Whether no feature has so many images that its pairs should be formed by (feature, pool)."""
    return extent is not None and extent.most_images <= BLOCK


def progressive_graph(postings: DataFrame, flagged: DataFrame, threshold: float = 0.0, plan: str | None = None, extent: Extent | None = None) -> DataFrame:
    """As ``candidate_graph`` without pairs of two old images. Where lists are short the plan is ``lists``, unless another is named."""
    return _on_candidates(postings.where(F.col("w") > threshold), flagged, plan or ("lists" if short_lists(extent) else "pools"), flagged=True, n_rows=extent.rows if extent else 0)


def candidate_pairs_graph(postings: DataFrame, pairs: DataFrame, threshold: float = 0.0, plan: str = "features", ids: Text = TEXT, n_rows: int = 0) -> DataFrame:
    """Positive sums over the pairs of a table ``(image_a, image_b)``, whatever made it: either order, repeats and pairs of an image with itself allowed.

    ``features`` joins postings by feature; they bring their image's partners, so where two
    meet only what is asked for goes on to be summed, however many pairs there are. Where the
    caller gives no number of rows, a Bloom filter of the pairs' images, if they are few enough
    for it, drops the postings of others first. ``candidates`` starts from
    the pairs and joins both images' postings, which suits few pairs and long posting lists.
    """
    rows = postings.where(F.col("w") > threshold)
    if plan == "candidates":
        found = _candidate_contributions(rows, supplied_pairs(pairs), F.col("a.w_norm") * F.col("b.w_norm"))
        return _summed(found).where(F.col("similarity") > 0)
    if plan != "features":
        raise ValueError(f"no plan {plan!r}")
    if not n_rows and (words := words_for(2 * pairs.count())):
        images = pairs.select(F.explode(F.array(F.col("image_a").cast("string"), F.col("image_b").cast("string"))).alias("image_id"))
        rows = passing(rows, bloom_of(images, ["image_id"], words), ["image_id"], words)
    sums = _partner_contributions(rows, pairs, ids, n_rows).groupBy("a", "b").agg(F.sum("c").alias("similarity"))
    return ids.restored(sums.where(F.col("similarity") > 0), "similarity")


#: Partners of an image in one list; an image with more has several lists, and its postings are repeated for each.
PARTNERS = 1_000


def partner_lists(pairs: DataFrame, ids: Text, n_rows: int = 0) -> DataFrame:
    """``(image_id, list, partners)``: each distinct pair as a code in the list of one of its two images, drawn by hash so that lists are evenly long."""
    names = ("image_a", "image_b")
    a, b = (F.col(c).cast("string") for c in names)
    known = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("image_a"), F.greatest(a, b).alias("image_b"))
    even = F.pmod(F.xxhash64(*names), F.lit(2)) == 0
    known = known.select(F.when(even, F.col("image_a")).otherwise(F.col("image_b")).alias("holder"), F.when(even, F.col("image_b")).otherwise(F.col("image_a")).alias("image_id"))
    held = ids.coded(known).select(F.col("holder").alias("image_id"), F.col("code").alias("partner"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("partner")) - 1
    numbered = dealt(held, n_rows, "image_id").distinct().withColumn("list", F.floor(place / PARTNERS))
    return numbered.groupBy("image_id", "list").agg(F.collect_list("partner").alias("partners"))


def _partner_contributions(rows: DataFrame, pairs: DataFrame, ids: Text, n_rows: int) -> DataFrame:
    """``(a, b, c)``, products of the postings of supplied pairs, by code. Both sides carry the same columns, so one shuffle by feature serves both."""
    own = rows.select("feature_id", "image_id", "w_norm").join(partner_lists(pairs, ids, n_rows), "image_id", "left")
    own = ids.coded(own).select("feature_id", "code", "w_norm", F.coalesce("list", F.lit(0)).alias("list"), "partners")
    own = dealt(own, n_rows, "feature_id")
    a, b = own.alias("a"), own.alias("b")
    holds = lambda x, y: (F.col(f"{y}.list") == 0) & F.array_contains(f"{x}.partners", F.col(f"{y}.code"))
    met = (F.col("a.feature_id") == F.col("b.feature_id")) & (F.col("a.code") < F.col("b.code")) & (holds("a", "b") | holds("b", "a"))
    first, c = ids.before(F.col("a.code"), F.col("b.code")), F.col("a.w_norm") * F.col("b.w_norm")
    ordered = lambda x, y: F.when(first, F.col(f"{x}.code")).otherwise(F.col(f"{y}.code"))
    return a.join(b, met).select(ordered("a", "b").alias("a"), ordered("b", "a").alias("b"), c.alias("c"))


#: What rounding may take off a bound: weights and products are of 32 bits in some graphs.
BOUND_SLACK = 1e-5


def with_rest(rows: DataFrame) -> DataFrame:
    """Adds ``rest``: the norm of an image's vector from this feature on, features read from rare to common.

    All images read in one order, so what a pair can still sum from its first shared
    feature on is at most the product of the two rests there.
    """
    if "df" not in rows.columns:
        rows = rows.join(rows.groupBy("feature_id").agg(F.count(F.lit(1)).alias("df")), "feature_id")
    unread = Window.partitionBy("image_id").orderBy(F.col("df").desc(), F.col("feature_id").desc())
    square = F.col("w_norm").cast("double") * F.col("w_norm").cast("double")
    return rows.withColumn("rest", F.sqrt(F.sum(square).over(unread.rowsBetween(Window.unboundedPreceding, 0))))


def bounded_meetings(rows: DataFrame, edge_threshold: float, members: DataFrame | None = None) -> DataFrame:
    """``(image_a, image_b)`` of every meeting at a feature from which on a pair could still sum to more than the threshold.

    A posting is joined only if its rest could reach the threshold with the best partner
    there is, so the common features at the end of a vector are joined seldom or never.
    A pair above the threshold meets at its first shared feature at least.
    """
    limit = edge_threshold * (1 - BOUND_SLACK)
    rested = with_rest(rows)
    best = rested.agg(F.max("rest").alias("best"))  # one row
    own = rested.crossJoin(F.broadcast(best)).where(F.col("rest") * F.col("best") > limit).select("feature_id", "image_id", "rest")
    keys, first = ["feature_id"], F.lit(True)
    if members is not None:
        own = own.join(with_pools(members), "image_id")
        keys, first = ["feature_id", "cluster_id"], in_first_shared_pool()
    a, b = own.alias("a"), own.alias("b")
    met = (F.col("a.image_id") < F.col("b.image_id")) & (F.col("a.rest") * F.col("b.rest") > limit) & first
    for key in keys:
        met = (F.col(f"a.{key}") == F.col(f"b.{key}")) & met
    return a.join(b, met).select(F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b"))


def bounded_graph(rows: DataFrame, edge_threshold: float, members: DataFrame | None = None) -> DataFrame:
    """Pairs whose sum exceeds a threshold above zero: those that might are found by bounds, their sums are made whole from both vectors."""
    if edge_threshold <= 0:
        raise ValueError("bounds need a threshold above zero")
    pairs = bounded_meetings(rows, edge_threshold, members).distinct()
    found = _candidate_contributions(rows, pairs, F.col("a.w_norm") * F.col("b.w_norm"))
    return _summed(found).where(F.col("similarity") > edge_threshold)


def _float_graph(rows: DataFrame, members: DataFrame, plan: str, edge_threshold: float | None = None) -> DataFrame:
    """Weights and products in 32 bits, summed in 64 so that the result doesn't depend on the order."""
    rows = rows.withColumn("w_norm", F.col("w_norm").cast("float"))
    if edge_threshold is None:
        return _on_candidates(rows, members, plan)
    if plan == "bounds" and edge_threshold > 0:
        return bounded_graph(rows, edge_threshold, members)
    return _on_candidates(rows, members, "pools" if plan == "bounds" else plan).where(F.col("similarity") > edge_threshold)


def filter_graph(postings: DataFrame, members: DataFrame, threshold: float = 0.0, edge_threshold: float | None = None, plan: str | None = None) -> DataFrame:
    """32-bit graph with the threshold on raw and on normalised weights; optionally also on sums.

    With a threshold on sums the plan is ``bounds``, which never forms pairs that can't reach
    it, unless another is named.
    """
    w, wn = F.col("w").cast("float"), F.col("w_norm").cast("float")
    limit = F.lit(threshold).cast("float")
    return _float_graph(postings.where((w > limit) & (wn > limit)), members, plan or ("pools" if edge_threshold is None else "bounds"), edge_threshold)


def filter_precompute_graph(postings: DataFrame, members: DataFrame, threshold: float = 0.0, plan: str = "pools") -> DataFrame:
    """32-bit graph with the threshold on raw weights only."""
    return _float_graph(postings.where(F.col("w").cast("float") > F.lit(threshold).cast("float")), members, plan)
