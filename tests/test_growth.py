"""Graphs and statistics that grow, stages that resume, text forms read back, lines as documents, stage commands."""

import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.cli import main
from tessera.functions import normalised_idf
from tessera.operators import candidates as C
from tessera.operators import graph as G
from tessera.operators import weights as W
from tessera.plans import queries
from tessera.plans.progressive import ProgressiveGraph
from tessera.plans.statistics import StaleInput, StatisticsStore
from tessera.sources import forms
from tessera.sources.sinks import edge_lines, write_text
from tessera.sources.text import parse_features, read_features
from tessera.stages import FREE_SHUFFLES, Stages, shared_folder


def table(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def feature_lines(seed, n, features=30, images=None):
    rng = random.Random(seed)
    return [",".join(f"{f}:{rng.randrange(1, 9)}" for f in rng.sample(range(features), rng.randrange(2, 8))) + f" %i{images[k] if images else k}" for k in range(n)]


def postings_from(spark, lines):
    return W.postings_of(parse_features(spark.createDataFrame([(x,) for x in lines], "value string")))


@pytest.fixture(scope="module")
def postings(spark):
    return postings_from(spark, feature_lines(1, 60)).cache()


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(f"c{rng.randrange(9)}", f"i{k}") for k in range(60) for _ in range(2)], "cluster_id string, image_id string").cache()


# batches


@pytest.mark.parametrize("pooled", [True, False])
def test_batches_make_the_whole_graph(spark, postings, members, pooled):
    stored = ProgressiveGraph(spark, shared_folder(spark, "growing"), 0.02, pooled)
    number = F.regexp_extract("image_id", "[0-9]+", 0).cast("int")
    for k in range(3):
        own = number % 3 == k
        added = (f"batch{k}", postings.where(own), members.where(own) if pooled else None)
        assert stored.add(*added) and not stored.add(*added)  # once more: nothing changes
    want = table(G.candidate_graph(postings, members, 0.02) if pooled else G.similarity_graph(postings, 0.02))
    assert table(stored.edges()) == want and want
    stored.compact()
    assert table(stored.edges()) == want and stored.batches() == ["batch0", "batch1", "batch2"]
    assert table(ProgressiveGraph(spark, stored.folder.path, 0.02, pooled).edges()) == want


def test_batches_that_contradict_are_refused(spark, postings, members):
    stored = ProgressiveGraph(spark, shared_folder(spark, "growing"))
    own = F.col("image_id") < "i3"
    stored.add("one", postings.where(own), members.where(own))
    before = table(stored.edges())
    with pytest.raises(ValueError):
        stored.add("one", postings.where(~own), members.where(~own))
    with pytest.raises(ValueError):
        stored.add("two", postings.where("image_id < 'i4'"), members.where("image_id < 'i4'"))
    with pytest.raises(ValueError):
        stored.add("two", postings.where(~own))
    with pytest.raises(ValueError):
        ProgressiveGraph(spark, stored.folder.path, 0.5).edges()
    assert table(stored.edges()) == before and stored.batches() == ["one"]


def test_a_batch_that_stops_changes_nothing(spark, postings, members, monkeypatch):
    stored = ProgressiveGraph(spark, shared_folder(spark, "growing"))
    own = F.col("image_id") < "i3"
    stored.add("one", postings.where(own), members.where(own))
    before = table(stored.edges())
    monkeypatch.setattr(ProgressiveGraph, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        stored.add("two", postings.where(~own), members.where(~own))
    assert table(stored.edges()) == before
    monkeypatch.undo()
    assert stored.add("two", postings.where(~own), members.where(~own))
    assert table(stored.edges()) == table(G.candidate_graph(postings, members))
    assert len(stored.folder.names("data")) == 4  # rows and edges of two batches; nothing of the stopped run


def test_old_images_are_not_paired_again(spark, postings, members):
    from tessera.plans.progressive import fresh_edges

    own = F.col("image_id") < "i3"
    old = {r.image_id for r in postings.where(own).select("image_id").collect()}
    found = fresh_edges(postings.where(~own), postings.where(own), members, 0.0).collect()
    assert found and not any(r.image_a in old and r.image_b in old for r in found) and any(r.image_a in old or r.image_b in old for r in found)


# statistics


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_statistics_grow_by_files(spark, tmp_path):
    """Each file is scanned once, and what is kept equals a full scan."""
    files = str(tmp_path / "in put+1")
    store = StatisticsStore(spark, f"file://{tmp_path}/kept")
    write_lines(files, "one.txt", feature_lines(1, 20))
    write_lines(files, "two.txt", feature_lines(2, 15))
    assert len(store.update(files)) == 2 and store.update(files) == []
    write_lines(files, "three.txt", [*feature_lines(3, 10), " %none", ""])
    assert [os.path.basename(f) for f in store.update(files)] == ["three.txt"]
    full = read_features(spark, files.replace(" ", " "), line_ids=True)
    stats = W.corpus_stats(full)
    assert table(store.stats()) == table(stats) and store.stats().first().n_images == 45
    assert table(store.idf()) == table(W.idf_values(W.tf_weights(full, stats), stats))


def test_stale_files_are_noticed(spark, tmp_path):
    files = str(tmp_path / "in")
    store = StatisticsStore(spark, f"file://{tmp_path}/kept")
    for k in (1, 2):
        write_lines(files, f"{k}.txt", feature_lines(k, 10 + k))
    store.update(files)
    write_lines(files, "1.txt", feature_lines(7, 5))
    os.utime(f"{files}/1.txt", (time.time() + 60, time.time() + 60))
    with pytest.raises(StaleInput):
        store.update(files)
    assert store.stats().first().n_images == 23  # as it was
    assert len(store.update(files, forget_stale=True)) == 1 and store.stats().first().n_images == 17
    os.remove(f"{files}/2.txt")
    with pytest.raises(StaleInput):
        store.update(files)
    assert store.update(files, forget_stale=True) == [] and store.stats().first().n_images == 5
    full = read_features(spark, files, line_ids=True)
    stats = W.corpus_stats(full)
    assert table(store.idf()) == table(W.idf_values(W.tf_weights(full, stats), stats))


def test_no_files_no_statistics(spark, tmp_path):
    store = StatisticsStore(spark, f"file://{tmp_path}/kept")
    assert store.update(f"{tmp_path}/nothing/*") == [] and store.stats().first().n_images == 0 and store.idf().count() == 0


# stages


def chain(spark, path, made, stop=None, key=""):
    """Four stages; ``made`` notes what is made, ``stop`` fails before its stage."""
    stages = Stages(spark, path, key)

    def step(name, *reads):
        def make(*rows):
            if name == stop:
                raise RuntimeError("stopped")
            made.append(name)
            return spark.range(10) if not rows else rows[0].withColumn("id", F.col("id") + sum(1 for _ in rows))

        stages.add(name, make, *reads)

    step("a")
    step("b", "a")
    step("c", "a", "b")
    step("d", "c")
    return stages


def test_a_stopped_run_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    made = []
    with pytest.raises(RuntimeError):
        chain(spark, path, made, stop="c").run("d")
    assert made == ["a", "b"]
    os.makedirs(f"{tmp_path}/run/c/rows-half")  # written, not committed
    again = chain(spark, path, made)
    with again.result("d") as rows:
        assert made == ["a", "b", "c", "d"] and sorted(r.id for r in rows.collect()) == list(range(3, 13))
        assert os.listdir(tmp_path / "run") == ["d"]  # each stage went when its last reader was committed
    assert not os.path.exists(tmp_path / "run")


def test_committed_stages_are_not_made_again(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    made = []
    chain(spark, path, made).run("d")
    assert made == ["a", "b", "c", "d"] and chain(spark, path, made).run("d").count() == 10 and made == ["a", "b", "c", "d"]
    chain(spark, path, made, key="other inputs").run("d")
    assert made == ["a", "b", "c", "d"] * 2


def test_failed_results_keep_their_folder(spark, tmp_path):
    stages = chain(spark, f"file://{tmp_path}/run", [])
    with pytest.raises(RuntimeError), stages.result("d"):
        raise RuntimeError("not used")
    assert stages.committed() == ["d"]
    for name, reads in (("a", ()), ("x", ("y",)), ("../x", ())):
        with pytest.raises(ValueError):
            stages.add(name, lambda: None, *reads)


def test_a_result_needn_t_be_written(spark, tmp_path):
    made = []
    stages = chain(spark, f"file://{tmp_path}/run", made)
    stages.add("e", lambda c, d: c.union(d), "c", "d")
    found = stages.unwritten("e")
    assert made == ["a", "b", "c", "d"] and sorted(os.listdir(tmp_path / "run")) == ["c", "d"]
    assert sorted(r.id for r in found.collect()) == sorted([*range(2, 12), *range(3, 13)])
    again = chain(spark, f"file://{tmp_path}/run", made)
    assert again.unwritten("d").count() == 10 and made == ["a", "b", "c", "d"]  # committed


def _shuffle_files(spark):
    return [b for b in str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")).split() if b.startswith("shuffle_")]


def test_stages_leave_no_shuffle_files(spark, tmp_path):
    before, setting = len(_shuffle_files(spark)), spark.conf.get(FREE_SHUFFLES, None)
    stages = Stages(spark, f"file://{tmp_path}/run")
    stages.add("a", lambda: spark.range(1_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("id").alias("n")))
    stages.add("b", lambda a: a.groupBy("n").agg(F.count("k").alias("m")), "a")
    assert [tuple(r) for r in stages.run("b").collect()] == [(10, 100)]
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
    for _ in range(50):  # they are deleted in the background
        if len(_shuffle_files(spark)) <= before:
            break
        time.sleep(0.1)
    assert len(_shuffle_files(spark)) <= before


def test_staged_graph_keeps_postings_only(spark, tmp_path, monkeypatch):
    """Edges aren't written a second time, and the postings read back are shuffled once by image and once by feature."""
    monkeypatch.setattr(queries, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    found = queries.q_staged_graph(spark, "/root/testdata/sf0.001")
    assert os.listdir(tmp_path / "staged") == ["postings"]
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    by = [x.split("hashpartitioning(")[1].split("#")[0] for x in plan if x.startswith("   :") and "Exchange" in x]  # of pairs that are done where they meet
    assert by == ["feature_id", "image_id"]
    assert found.count() == queries.q_weight_pruned_graph(spark, "/root/testdata/sf0.001").count() > 0


# text forms


@pytest.mark.parametrize("chunk", [1, 4, 10_000])
def test_forms_read_back(spark, postings, members, tmp_path, chunk):
    obs = parse_features(spark.createDataFrame([(x,) for x in feature_lines(1, 60)], "value string"))
    stats = W.corpus_stats(obs)
    tf = W.tf_weights(obs, stats)
    weights = W.tfidf_weights(tf, W.idf_values(tf, stats)).select("image_id", "feature_id", "w")
    pooled = C.cluster_join(weights, members).select("image_id", "cluster_ids", "feature_id", "w")
    plain = postings.select("feature_id", "image_id", "w", "w_norm")
    edges = G.similarity_graph(postings)
    cases = [
        (forms.tf_lines(tf, chunk), forms.parse_tf, tf.select("image_id", "feature_id", "tf")),
        (forms.vector_lines(weights, chunk), forms.parse_vectors, weights),
        (forms.pooled_vector_lines(pooled, chunk), forms.parse_pooled_vectors, pooled),
        (forms.posting_lines(plain, chunk), forms.parse_postings, plain),
        (forms.pair_lines(C.cluster_pairs(members)), forms.parse_pairs, C.cluster_pairs(members)),
        (edge_lines(edges), forms.parse_edges, edges),
    ]
    for k, (lines, parse, want) in enumerate(cases):
        write_text(lines, f"{tmp_path}/{k}", compress=k % 2 == 0)
        back = parse(spark.read.text(f"{tmp_path}/{k}"), strict=True)
        assert Counter(map(str, back.collect())) == Counter(map(str, want.collect()))  # to the last bit
        if chunk == 1 and k < 4:
            assert spark.read.text(f"{tmp_path}/{k}").count() > spark.read.text(f"{tmp_path}/{k}").select(F.split("value", "\t")[0]).distinct().count()
    write_text(forms.stats_lines(stats), f"{tmp_path}/stats")
    assert table(forms.parse_stats(spark.read.text(f"{tmp_path}/stats")).select("n_images", "adl")) == table(stats.select("n_images", "adl"))


def test_long_lists_are_several_lines(spark):
    rows = spark.createDataFrame([(1, f"i{k}", 0.5, 0.25) for k in range(1_000)] + [(2, "i1", 0.5, 0.25)], "feature_id int, image_id string, w double, w_norm double")
    sizes = [r.n for r in forms.posting_lines(rows, 50).select(F.regexp_count("value", F.lit(r"\(")).alias("n")).collect()]
    assert sum(sizes) == 1_001 and max(sizes) < 100 and len(sizes) > 15


def test_lines_and_ids_that_fit_no_form(spark):
    bad = spark.createDataFrame([("",), (None,), ("1\t[(0.5 x",), ("no tab",), ("\t[]",), ("7\t[(0.5 0.25 a b)]",)], "value string")
    assert [(r.feature_id, r.image_id) for r in forms.parse_postings(bad).collect()] == [(7, "a b")]
    for parse in (forms.parse_postings, forms.parse_edges):
        with pytest.raises(PySparkException):
            parse(bad, strict=True).collect()
    odd = spark.createDataFrame([(1, "a)b", 0.5, 0.5)], "feature_id int, image_id string, w double, w_norm double")
    with pytest.raises(PySparkException):
        forms.posting_lines(odd).collect()
    with pytest.raises(PySparkException):
        forms.vector_lines(odd.withColumn("image_id", F.lit("a\tb"))).collect()


# lines as documents


def test_an_image_on_two_lines_counts_twice(spark, tmp_path):
    """Text path against plain Python: documents are lines, vectors are images."""
    lines = feature_lines(4, 12, images=[0, 1, 2, 0, 3, 1, 4, 5, 6, 7, 8, 0])
    write_lines(str(tmp_path / "in"), "f.txt", lines)
    obs = read_features(spark, str(tmp_path / "in"), line_ids=True)
    docs = [(x.split(" %")[1], [(int(p.split(":")[0]), float(p.split(":")[1])) for p in x.split(" %")[0].split(",")]) for x in lines]
    stats = W.corpus_stats(obs).first()
    assert (stats.n_images, stats.adl) == (12, sum(len(f) for _, f in docs) / 12)
    import numpy as np

    df = Counter(f for _, fs in docs for f, _ in fs)
    vectors = defaultdict(list)
    for image, fs in docs:
        for f, v in fs:
            tf = np.float32(v / (v + 0.5 + 1.5 * (len(fs) / stats.adl)))
            vectors[image].append((f, float(tf) * (np.log(12.5 / df[f]) / np.log(13))))
    want = Counter()
    for image, ws in vectors.items():
        norm = sum(w * w for _, w in ws) ** 0.5
        want.update((image, f, round(w, 9), round(w / norm, 9)) for f, w in ws if w > 0)
    got = Counter((r.image_id, r.feature_id, round(r.w, 9), round(r.w_norm, 9)) for r in W.postings_of(obs).collect())
    assert got == want
    assert W.corpus_stats(obs.drop("line_id")).first().n_images == 9


# stage commands


def test_stage_commands_make_the_whole_run(spark, tmp_path):
    lines = feature_lines(5, 40)
    write_lines(str(tmp_path / "in"), "f.txt", lines)
    write_lines(str(tmp_path / "pools"), "c.txt", [f"x:{k}\t" + " ".join(f"i{j}" for j in range(k, 40, 4)) for k in range(4)])
    at = lambda name: str(tmp_path / name)
    steps = [
        ("adl", at("in"), at("adl")),
        ("tf", at("in"), at("adl"), at("tf")),
        ("idf", at("tf"), at("adl"), at("idf")),
        ("list", at("idf"), at("list"), "compress"),
        ("edges", at("list"), "0.05", at("edges")),
        ("pairs", at("pools"), "2", at("pairs")),
        ("known", at("list"), at("pairs"), "0.05", at("known")),
        ("pools", at("idf"), at("pools"), "2", at("pooled")),
    ]
    for args in steps:
        assert main(["stage", *args]) == 0
    assert main(["base", at("in"), "0.05", at("base")]) == 0
    assert main(["candidates", at("in"), at("pools"), "0.05", "2", at("candidates")]) == 0
    edges = lambda name: table(forms.parse_edges(spark.read.text(at(name)), strict=True))
    assert edges("edges") == edges("base") and edges("known") == edges("candidates") and edges("known")
    assert forms.parse_pooled_vectors(spark.read.text(at("pooled")), strict=True).count() == forms.parse_vectors(spark.read.text(at("idf")), strict=True).count()
    assert main(["stage", "count", at("in"), at("store"), at("counted")]) == 0
    assert table(spark.read.text(at("counted"))) == table(spark.read.text(at("adl")))
    assert main(["grow", at("stored"), "first", at("list"), at("pools"), "0.05", "2", at("grown")]) == 0
    assert edges("grown") == edges("candidates")
    assert main(["stage"]) == main(["stage", "other", "x", "y"]) == main([]) == 2


def test_idf_formula_is_shared(spark):
    row = spark.range(1).select(normalised_idf(F.lit(4), F.lit(2)).alias("x")).first()
    assert round(row.x, 6) == 0.503859
