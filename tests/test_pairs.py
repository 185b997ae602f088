"""Pair sums by posting lists: ids of every kind, hot features, wide images, bounds, supplied pairs."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import bloom
from tessera.operators import candidates as C
from tessera.operators import graph as G
from tessera.operators import pairs as P
from tessera.operators import weights as W
from tessera.operators.ids import TEXT, WHOLE, Dictionary, Text
from tessera.operators.weights import Extent
from tessera.plans.progressive import fresh_edges
from tessera.plans.sweep import sweep_edges


def random_obs(seed, images, features, n, hot=0.0):
    """Rows (image, feature, value) without repeats; ``hot`` is the share of images that have feature 0."""
    rng = random.Random(seed)
    names = [str(rng.randrange(1, 100_000)) for _ in range(images)]
    found = {(rng.choice(names), rng.randrange(1, features)) for _ in range(n)} | {(x, 0) for x in names if rng.random() < hot}
    return [(x, f, float(rng.randrange(1, 9))) for x, f in sorted(found)]


def brute(postings, t):
    """Sums over all pairs by dictionaries."""
    lists = defaultdict(list)
    for r in postings:
        if r.w > t:
            lists[r.feature_id].append((r.image_id, r.w_norm))
    sums = defaultdict(float)
    for own in lists.values():
        for (a, x), (b, y) in combinations(sorted(own), 2):
            if a != b:
                sums[a, b] += x * y
    return sums


def close(got, want):
    got = {(r.image_a, r.image_b): r.similarity for r in got.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.fixture(scope="module")
def hot(spark):
    obs = spark.createDataFrame(random_obs(3, 300, 60, 1_500, 0.5), "image_id string, feature_id long, value double")
    return W.postings_of(obs).cache()


@pytest.mark.parametrize("kind", ["text", "whole", "dictionary"])
@pytest.mark.parametrize(("block", "wide"), [(1_024, 10_000), (7, 3)])
def test_sums_of_any_ids_blocks_and_parts(hot, monkeypatch, kind, block, wide):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "WIDE", wide)
    ids = {"text": TEXT, "whole": WHOLE, "dictionary": None}[kind] or Dictionary(hot)
    rows = hot.collect()
    for extent in (None, W.extent_of(hot)):
        close(G.similarity_graph(hot, 0.05, ids=ids, extent=extent), brute(rows, 0.05))


def test_sizes_are_counted_where_they_are_missing(hot, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 5)
    close(G.similarity_graph(hot.drop("df", "n_features"), 0.0), brute(hot.collect(), 0.0))


def test_thresholds_of_a_sweep_in_blocks(hot, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 9)
    monkeypatch.setattr(P, "WIDE", 4)
    found = sweep_edges(hot, (0.1, 0.02), WHOLE)
    for t in (0.02, 0.1):
        close(found.where(F.col("threshold") == t), brute(hot.collect(), t))


def test_a_feature_in_half_the_images_is_dealt_evenly(spark, monkeypatch):
    """No task makes or sums more than twice the median's pairs."""
    monkeypatch.setattr(P, "BLOCK", 32)
    obs = spark.createDataFrame([(str(k), 0, 1.0) for k in range(1_500)] + [(str(k), k, 1.0) for k in range(1, 3_000)], "image_id string, feature_id long, value double")
    postings = W.postings_of(obs)
    seen = []
    for rows in (_met_blocks(postings), P.contributions(postings, ids=WHOLE)[0]):
        counts = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        seen.append(counts)
        assert counts[-1] <= 2 * counts[len(counts) // 2], counts
    assert sum(seen[1]) == 1_500 * 1_499 // 2


def _met_blocks(postings):
    """A row for each pair of a block pair's cross join, where Spark makes it."""
    lists = P.posting_blocks(postings, ["feature_id"], WHOLE, False, None)
    return P._across(lists, ["feature_id"], WHOLE, False, True).select(F.explode("codes"))


def test_bag_counts_repeats_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 2)
    rows = [("1", x, 0.5, 0.5) for x in "aabbbcd"] + [("2", x, 0.5, 0.25) for x in "abd"]
    postings = spark.createDataFrame(rows, "feature_id string, image_id string, w double, w_norm double")
    got = {(r.image_a, r.image_b): r.similarity for r in G.similarity_graph_bag(postings).collect()}
    want = defaultdict(float)
    for f in "12":
        for (a, x), (b, y) in combinations(sorted((i, w) for g, i, _, w in rows if g == f), 2):
            want[a, b] += x * y
    assert got == want


def test_nulls_share_nothing(spark):
    rows = [("1", "a", 0.5, 0.5), ("1", "b", 0.5, 0.5), (None, "a", 0.5, 0.5), (None, "b", 0.5, 0.5), ("1", None, 0.5, 0.5), ("1", None, 0.5, 0.5)]
    postings = spark.createDataFrame(rows, "feature_id string, image_id string, w double, w_norm double")
    for graph in (G.similarity_graph, G.similarity_graph_bag):
        assert [tuple(r) for r in graph(postings).collect()] == [("a", "b", 0.25)]


def test_dictionary_numbers_are_in_order_of_text(spark):
    ids = [str(k) for k in range(0, 5_000, 7)] + ["", "a", "a b", "\u00fc", "Z", "\U0001f642"]
    rows = spark.createDataFrame([(x,) for x in ids] * 2 + [(None,)], "image_id string").repartition(9)
    found = Dictionary(rows).table.orderBy("code").collect()
    assert [r.image_id for r in found] == sorted(ids, key=lambda x: x.encode()) and len({r.code for r in found}) == len(ids)


def test_large_dictionaries_are_not_broadcast(hot, monkeypatch):
    ids = Dictionary(hot)
    ids.size = 10**9
    close(G.similarity_graph(hot, 0.05, ids=ids), brute(hot.collect(), 0.05))
    assert isinstance(ids, Text)


# thresholds on sums


@pytest.mark.parametrize("edge", [0.05, 0.3, 0.7])
def test_bounded_graph_is_the_plain_one(hot, edge):
    want = {k: s for k, s in brute(hot.collect(), 0.02).items() if s > edge}
    assert want
    close(G.similarity_graph(hot, 0.02, edge), want)


def test_bounds_spare_most_pairs(hot):
    rows = hot.where("w > 0")
    plain = P.contributions(rows, ids=WHOLE)[0].count()
    met, more = (G.bounded_meetings(rows, t).count() for t in (0.9, 0.5))
    assert 0 < met < plain / 10 and met < more < plain / 2, (met, more, plain)


def test_bounded_filter_graph(spark, hot):
    rng = random.Random(5)
    members = spark.createDataFrame([(str(rng.randrange(12)), r.image_id) for r in hot.select("image_id").distinct().collect() for _ in range(2)], "cluster_id string, image_id string")
    for edge in (0.1, 0.4):
        plain = G.filter_graph(hot, members, 0.01, edge, plan="pools")
        assert sorted(map(tuple, _rounded(G.filter_graph(hot, members, 0.01, edge)))) == sorted(map(tuple, _rounded(plain))) and plain.count()
    assert _rounded(G.filter_graph(hot, members, 0.01, 0.0)) == _rounded(G.filter_graph(hot, members, 0.01))


def _rounded(df):
    return sorted((r.image_a, r.image_b, round(r.similarity, 9)) for r in df.collect())


def test_bounds_need_a_threshold(hot):
    with pytest.raises(ValueError):
        G.bounded_graph(hot, 0.0)


def test_lists_of_pools_give_the_same_graph(spark, hot):
    rng = random.Random(5)
    ids = sorted({r.image_id for r in hot.collect()})
    flags = {i: rng.choice(["in", "out", "old"]) for i in ids[::2]}  # one flag for half of the images, any for the others
    rows = [(f"c{rng.randrange(12)}", i, flags.get(i) or rng.choice(["in", "out", "old", None])) for i in ids for _ in range(rng.randrange(5))] + [(None, ids[0], "in")]
    members = spark.createDataFrame(rows, "cluster_id string, image_id string, sample_flag string")
    want = _rounded(G.progressive_graph(hot, members, 0.02, "candidates"))
    assert want and _rounded(G.progressive_graph(hot, members, 0.02, "lists")) == want
    assert _rounded(G.candidate_graph(hot, members, 0.02, "lists")) == _rounded(G.candidate_graph(hot, members, 0.02))
    old, new = hot.where("cast(image_id as long) % 2 = 0"), hot.where("cast(image_id as long) % 2 = 1")
    assert _rounded(fresh_edges(new, old, members, 0.02, short=True)) == _rounded(fresh_edges(new, old, members, 0.02))
    seen = []
    real = G._contributions
    G._contributions = lambda rows, *more: (seen.append(rows), real(rows, *more))[1]
    try:
        G.progressive_graph(hot, members, 0.02, extent=Extent(10, G.BLOCK, 10, 0))
        G.progressive_graph(hot, members, 0.02, extent=Extent(10, G.BLOCK + 1, 10, 0))
    finally:
        G._contributions = real
    short, general = (rows.count() for rows in seen)
    assert 0 < short < general  # a posting isn't repeated for each pool where lists are short


# supplied pairs


@pytest.mark.parametrize("plan", ["features", "candidates"])
def test_supplied_pairs_in_any_order(spark, hot, plan):
    want = brute(hot.collect(), 0.02)
    rng = random.Random(1)
    some = rng.sample(sorted(want), 40)
    table = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in some] + some[:5] + [("1", None), (None, None), ("2", "2"), ("no", "image")]
    pairs = spark.createDataFrame(table, "image_a string, image_b string")
    close(G.candidate_pairs_graph(hot, pairs, 0.02, plan), {k: want[k] for k in some})


def test_pairs_beyond_the_filter(spark, hot, monkeypatch):
    monkeypatch.setattr(G, "words_for", lambda n: None)
    want = brute(hot.collect(), 0.0)
    pairs = spark.createDataFrame(sorted(want)[:9], "image_a string, image_b string")
    close(G.candidate_pairs_graph(hot, pairs, 0.0), {k: want[k] for k in sorted(want)[:9]})
    with pytest.raises(ValueError):
        G.candidate_pairs_graph(hot, pairs, 0.0, "other")
    assert G.candidate_pairs_graph(hot, pairs.where("false"), 0.0).count() == 0


@pytest.mark.parametrize("most", [1, 3, 1_000])
def test_only_supplied_pairs_are_summed(spark, hot, monkeypatch, most):
    monkeypatch.setattr(G, "words_for", lambda n: None)  # too many pairs for a filter: all products were shuffled once
    monkeypatch.setattr(G, "PARTNERS", most)
    rows = hot.collect()
    want, shared = brute(rows, 0.0), {}
    for r in rows:
        shared.setdefault(r.image_id, set()).add(r.feature_id)
    hub = max(shared, key=lambda i: len(shared[i]))
    some = [p for k, p in enumerate(sorted(want)) if hub in p or k % 50 == 0]
    pairs = spark.createDataFrame(some + [(b, a) for a, b in some[::3]], "image_a string, image_b string")
    formed = G._partner_contributions(hot, pairs, G.TEXT, 0)
    assert formed.count() == sum(len(shared[a] & shared[b]) for a, b in some)
    close(G.candidate_pairs_graph(hot, pairs, 0.0), {k: want[k] for k in some})


def test_bloom_filter(spark):
    keys = spark.range(0, 20_000, 10).select(F.col("id").cast("string").alias("x"), F.col("id").alias("y"))
    words = bloom.words_for(2_000)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("x"), F.col("id").alias("y"))
    passed = {r.y for r in bloom.passing(rows, bloom.bloom_of(keys, ["x", "y"], words), ["x", "y"], words).collect()}
    assert passed >= set(range(0, 20_000, 10)) and len(passed) < 2_000 + 0.02 * 18_000
    assert [bloom.words_for(n) for n in (0, 10**6, 10**7, 10**9)] == [1 << 10, 1 << 18, 1 << 20, None]
    assert bloom.passing(rows, None, ["x"], None) is rows


# pools


def test_signatures_spare_the_lists(spark, hot):
    """Of rows that meet at a feature, few reach the comparison of pools."""
    rng = random.Random(9)
    members = spark.createDataFrame([(str(rng.randrange(500)), r.image_id) for r in hot.select("image_id").distinct().collect() for _ in range(2)], "cluster_id string, image_id string")
    rows = hot.join(G.signed_pools(members), "image_id")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.feature_id") == F.col("b.feature_id")) & (F.col("a.image_id") < F.col("b.image_id")))
    total, shown, sharing = (met.where(c).count() for c in (F.lit(True), G.signatures_meet(), F.arrays_overlap("a.cluster_ids", "b.cluster_ids")))
    assert sharing <= shown <= total / 10
    assert met.where(F.arrays_overlap("a.cluster_ids", "b.cluster_ids") & ~G.signatures_meet()).count() == 0
    assert _rounded(G.cluster_overlap_graph(hot, members)) == _rounded(G.candidate_graph(hot, members))


def test_pools_of_null_id_share_nothing(spark, hot):
    names = [r.image_id for r in hot.select("image_id").distinct().limit(3).collect()]
    members = spark.createDataFrame([(None, x) for x in names], "cluster_id string, image_id string")
    assert G.cluster_overlap_graph(hot, members).count() == G.candidate_graph(hot, members).count() == C.cluster_pairs(members).count() == 0


# short vectors


@pytest.mark.parametrize("kind", ["text", "whole", "dictionary"])
@pytest.mark.parametrize("block", [1_024, 7])
def test_short_vectors_are_summed_where_they_meet(spark, monkeypatch, kind, block):
    """Few rows are shuffled by pair; sums, sweeps, bags and thresholds on sums are the plain ones."""
    monkeypatch.setattr(P, "BLOCK", block)
    obs = spark.createDataFrame(random_obs(11, 700, 90, 2_000, 0.05), "image_id string, feature_id long, value double")
    postings = W.postings_of(obs).cache()
    rows, extent = postings.collect(), W.extent_of(obs)
    ids = {"text": TEXT, "whole": WHOLE, "dictionary": None}[kind] or Dictionary(postings)
    assert P.few(extent) and extent.rows == obs.count()
    want = brute(rows, 0.02)
    close(G.similarity_graph(postings, 0.02, ids=ids, extent=extent), want)
    close(G.similarity_graph(postings, 0.02, 0.4, ids, extent), {k: s for k, s in want.items() if s > 0.4})
    found = sweep_edges(postings, (0.1, 0.02), ids, extent)
    for t in (0.02, 0.1):
        close(found.where(F.col("threshold") == t), brute(rows, t))
    met = P.meetings(postings.where("w > 0.02"), ids=ids, extent=extent)
    assert met.where("more").count() < met.count() / 2
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more"), F.min("more").alias("less"))
    assert shared.where("n > 1 AND NOT less").count() == 0 < shared.where("n > 1").count()


def test_repeats_of_short_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 2)
    rows = [("1", x, 0.5, 0.5) for x in "aabbbcd"] + [("2", x, 0.5, 0.25) for x in "abd"]
    postings = spark.createDataFrame(rows, "feature_id string, image_id string, w double, w_norm double")
    got, want = (G.similarity_graph_bag(postings, extent=e).collect() for e in (W.extent_of(postings), None))
    assert sorted(got) == sorted(want) and got
