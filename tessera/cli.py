"""Command line: whole graphs, sweeps, and single stages on stored text.

``python -m tessera.cli base <features> <threshold> <out> [compress]``; the other graphs are
``overlap|feature|single|candidates|filter|precompute|progressive <features> <clusters> <threshold> <min size> <out> [compress]``.
``sweep`` takes thresholds with commas and a folder of ``iterate1``, ``iterate2``, ... and
writes gzip or plain text into ``threshold_T/min_hash_iterateJ`` folders.

``stage`` runs one step on what an earlier one wrote, in the text forms of ``sources/forms``:
``stage adl <features> <out>``, ``stage tf <features> <adl> <out>``, ``stage idf <tf> <adl> <out>``,
``stage pools <idf> <clusters> <min size> <out>``, ``stage list <idf> <out>``, ``stage pairs <clusters> <min size> <out>``,
``stage edges <list> <threshold> <out>`` and ``stage known <list> <pairs> <threshold> <out>``, each with ``[compress]``.
``stage count <features> <store> <out>`` is ``adl`` from counts kept in a store, which scans only files not counted yet.

``grow <store> <batch> <list> <clusters> <threshold> <min size> <out> [compress]`` adds a batch of images, with their
postings and pools, to a stored graph and writes the whole graph.

``feature``, ``single``, ``filter`` and ``precompute`` don't split features from image ids
at tabs, and ``single`` takes a cluster's whole key as its id, as their formats have it.
Each line of features is a document of the statistics.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import DELIMITERS_NARROW, DELIMITERS_WIDE
from tessera.operators import candidates as C
from tessera.operators import graph as G
from tessera.operators import weights as W
from tessera.operators.ids import Dictionary
from tessera.plans.progressive import ProgressiveGraph
from tessera.plans.statistics import StatisticsStore
from tessera.plans.sweep import sweep_pool_edges
from tessera.session import local_session
from tessera.sources import forms
from tessera.sources.sinks import edge_lines, write_sweep, write_text
from tessera.sources.text import read_clusters, read_features, read_iterated_clusters

VARIANTS = {
    "overlap": G.cluster_overlap_graph,
    "feature": G.cluster_feature_graph,
    "single": G.overlapping_cluster_graph,
    "candidates": G.candidate_graph,
    "filter": G.filter_graph,
    "precompute": G.filter_precompute_graph,
    "progressive": G.progressive_graph,
}

NARROW = {"feature", "single", "filter", "precompute"}
WHOLE_KEY = {"single"}


def _features(spark: SparkSession, path: str, narrow: bool = False) -> DataFrame:
    return read_features(spark, path, line_ids=True, delimiters=DELIMITERS_NARROW if narrow else DELIMITERS_WIDE)


def _adl(spark: SparkSession, features: str) -> DataFrame:
    return forms.stats_lines(W.corpus_stats(_features(spark, features)))


def _count(spark: SparkSession, features: str, store: str) -> DataFrame:
    kept = StatisticsStore(spark, store, delimiters=DELIMITERS_WIDE)
    kept.update(features)
    return forms.stats_lines(kept.stats())


def _grown(spark: SparkSession, store: str, batch: str, postings: str, clusters: str, threshold: str, least: str) -> DataFrame:
    stored = ProgressiveGraph(spark, store, float(threshold))
    stored.add(batch, _postings(spark, postings), read_clusters(spark, clusters, min_size=int(least)))
    return edge_lines(stored.edges())


def _tf(spark: SparkSession, features: str, adl: str) -> DataFrame:
    return forms.tf_lines(W.tf_weights(_features(spark, features), forms.parse_stats(spark.read.text(adl))))


def _idf(spark: SparkSession, tf: str, adl: str) -> DataFrame:
    rows = forms.parse_tf(spark.read.text(tf), strict=True)
    return forms.vector_lines(W.tfidf_weights(rows, W.idf_values(rows, forms.parse_stats(spark.read.text(adl))), W.vocabulary_of(rows)))


def _pools(spark: SparkSession, idf: str, clusters: str, least: str) -> DataFrame:
    return forms.pooled_vector_lines(C.cluster_join(forms.parse_vectors(spark.read.text(idf), strict=True), read_clusters(spark, clusters, min_size=int(least))))


def _list(spark: SparkSession, idf: str) -> DataFrame:
    return forms.posting_lines(W.inverted_list(forms.parse_vectors(spark.read.text(idf), strict=True)))


def _pairs(spark: SparkSession, clusters: str, least: str) -> DataFrame:
    return forms.pair_lines(C.cluster_pairs(read_clusters(spark, clusters, min_size=int(least))))


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return forms.parse_postings(spark.read.text(path), strict=True)


def _edges(spark: SparkSession, postings: str, threshold: str) -> DataFrame:
    rows = _postings(spark, postings)
    return edge_lines(G.similarity_graph(rows, float(threshold), ids=Dictionary(rows), extent=W.extent_of(rows)))


def _known(spark: SparkSession, postings: str, pairs: str, threshold: str) -> DataFrame:
    return edge_lines(G.candidate_pairs_graph(_postings(spark, postings), forms.parse_pairs(spark.read.text(pairs), strict=True), float(threshold)))


#: Steps and the number of their arguments, without the last, where they write.
STAGES: dict[str, tuple[Callable[..., DataFrame], int]] = {
    "adl": (_adl, 1),
    "count": (_count, 2),
    "tf": (_tf, 2),
    "idf": (_idf, 2),
    "pools": (_pools, 3),
    "list": (_list, 1),
    "pairs": (_pairs, 2),
    "edges": (_edges, 2),
    "known": (_known, 3),
}


def _arguments(args: list[str]) -> int | None:
    """How many arguments a command takes."""
    if args and args[0] == "stage":
        return STAGES[args[1]][1] + 3 if len(args) > 1 and args[1] in STAGES else None
    return {"base": 4, "grow": 8}.get(args[0], 6 if args[0] in {"sweep", *VARIANTS} else None) if args else None


def main(args: list[str]) -> int:
    args = list(args)
    compress = bool(args) and args[-1] == "compress"
    args = args[: len(args) - compress]
    if len(args) != _arguments(args):
        print(__doc__)
        return 2
    spark = local_session()
    if args[0] == "stage":
        write_text(STAGES[args[1]][0](spark, *args[2:-1]), args[-1], compress)
        return 0
    if args[0] == "grow":
        write_text(_grown(spark, *args[1:-1]), args[-1], compress)
        return 0
    obs = _features(spark, args[1], args[0] in NARROW)
    extent = W.extent_of(obs)
    postings = W.postings_of(obs, extent.features)
    if args[0] == "base":
        edges = G.similarity_graph(postings, float(args[2]), ids=Dictionary(obs), extent=extent)
    elif args[0] == "sweep":
        thresholds = {float(t): t for t in args[3].split(",")}
        edges = sweep_pool_edges(postings, read_iterated_clusters(spark, args[2], min_size=int(args[4])), list(thresholds))
        write_sweep(edges, args[-1], thresholds, compress)
        return 0
    else:
        pools = read_clusters(spark, args[2], min_size=int(args[4]), flagged=args[0] == "progressive", whole_key=args[0] in WHOLE_KEY)
        edges = VARIANTS[args[0]](postings, pools, float(args[3]))
    write_text(edge_lines(edges), args[-1], compress)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
