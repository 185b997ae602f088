"""Hand-computed graphs on four images, quirks, and a brute-force comparison."""

import gzip
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessera.cli import main
from tessera.operators import candidates as C
from tessera.operators import graph as G
from tessera.operators import weights as W
from tessera.plans.sweep import sweep_edges, sweep_pool_edges
from tessera.sources import text as T
from tessera.sources.forms import posting_lines
from tessera.sources.sinks import edge_lines, write_edges, write_text

LINES = ["1:2,2:1,3:1 %a", "1:1,2:3 %b", "2:1,4:2 %c", "4:1,5:1,6:-1 %d", " %z", "", None]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.fixture(scope="module")
def postings(spark):
    return W.postings_of(T.parse_features(lines(spark, LINES))).cache()


def pools(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, image_id string")


def edges(df):
    return {(r.image_a, r.image_b): round(r.similarity, 6) for r in df.collect()}


TWO = [("1", "a"), ("1", "b"), ("2", "b"), ("2", "c")]
ONE = [("1", x) for x in "abcd"]


def test_weights(spark, postings):
    stats = W.corpus_stats(T.parse_features(lines(spark, LINES))).first()
    assert (stats.n_images, stats.adl) == (4, 2.5)
    w = {(r.image_id, r.feature_id): (round(r.w, 6), round(r.w_norm, 6)) for r in postings.collect()}
    assert w[("a", 1)] == (0.234353, 0.624226) and w[("c", 4)] == (0.272356, 0.946023) and len(w) == 9


@pytest.mark.parametrize(
    ("t", "want"),
    [
        (0.0, {("a", "b"): 0.605621, ("a", "c"): 0.065905, ("b", "c"): 0.211566, ("c", "d"): 0.448957}),
        (0.1, {("a", "b"): 0.472881, ("c", "d"): 0.448957}),
        (0.2, {}),
    ],
)
def test_base(postings, t, want):
    assert edges(G.similarity_graph(postings, t)) == want


@pytest.mark.parametrize("build", [G.cluster_overlap_graph, G.cluster_feature_graph, G.candidate_graph])
def test_pruned_by_pools(spark, postings, build):
    assert edges(build(postings, pools(spark, TWO))) == {("a", "b"): 0.605621, ("b", "c"): 0.211566}


@pytest.mark.parametrize("plan", ["candidates", "features"])
def test_plans_agree(spark, postings, plan):
    p = pools(spark, TWO)
    flagged = spark.createDataFrame([(c, x, "in" if x in "ad" else "out") for c, x in [*TWO, *ONE]], "cluster_id string, image_id string, sample_flag string")
    assert edges(G.candidate_graph(postings, p, plan=plan)) == edges(G.candidate_graph(postings, p))
    assert edges(G.progressive_graph(postings, flagged, plan=plan)) == edges(G.progressive_graph(postings, flagged))
    assert edges(G.filter_graph(postings, p, 0.05, plan=plan)) == edges(G.filter_graph(postings, p, 0.05))
    with pytest.raises(ValueError):
        G.candidate_graph(postings, p, plan="other")


def test_progressive(spark, postings):
    flagged = spark.createDataFrame([("1", x, "in" if x in "ad" else "out") for x in "abcd"], "cluster_id string, image_id string, sample_flag string")
    assert edges(G.progressive_graph(postings, flagged)) == {("a", "b"): 0.605621, ("a", "c"): 0.065905, ("c", "d"): 0.448957}


def test_single_pool_with_unknown(spark, postings):
    p = pools(spark, [("1", "a"), ("1", "b")])
    assert edges(G.overlapping_cluster_graph(postings, p)) == {("a", "b"): 0.605621, ("c", "d"): 0.448957}
    assert edges(G.overlapping_cluster_graph(postings, p, 0.5)) == {("a", "b"): 0.472881}


def test_filter(spark, postings):
    want = {("a", "b"): 0.472881, ("c", "d"): 0.448957}
    assert edges(G.filter_graph(postings, pools(spark, ONE), 0.1)) == pytest.approx(want, abs=2e-6)
    assert edges(G.filter_precompute_graph(postings, pools(spark, ONE), 0.1)) == pytest.approx(want, abs=2e-6)
    assert set(edges(G.filter_graph(postings, pools(spark, ONE), 0.1, edge_threshold=0.46))) == {("a", "b")}


def test_sweep_equals_single_runs(postings):
    steps = (0.0, 0.1, 0.2)
    swept = {}
    for r in sweep_edges(postings, steps).collect():
        swept.setdefault(r.threshold, {})[(r.image_a, r.image_b)] = round(r.similarity, 6)
    assert {t: swept.get(t, {}) for t in steps} == {t: edges(G.similarity_graph(postings, t)) for t in steps}


def test_sweep_over_runs_equals_single_runs(spark, postings):
    runs = {1: TWO, 2: ONE, 3: [("9", "a"), ("9", "d"), ("8", "a"), ("8", "d")]}
    members = spark.createDataFrame([(j, c, i) for j, rows in runs.items() for c, i in rows], "iterate int, cluster_id string, image_id string")
    steps, swept = (0.0, 0.1), {}
    for r in sweep_pool_edges(postings, members, steps).collect():
        swept.setdefault((r.threshold, r.iterate), {})[(r.image_a, r.image_b)] = round(r.similarity, 6)
    for t in steps:
        for j, rows in runs.items():
            assert swept.get((t, j), {}) == edges(G.cluster_overlap_graph(postings, pools(spark, rows), t))


def test_sweep_is_published_by_threshold(spark, postings, tmp_path):
    write_edges(sweep_edges(postings, (0.0, 0.1)), str(tmp_path / "sweep"), "threshold")
    assert {p.name for p in (tmp_path / "sweep").glob("threshold=*")} == {"threshold=0.0", "threshold=0.1"}
    assert spark.read.parquet(str(tmp_path / "sweep")).where("threshold = 0.1").count() == 2


def test_parser_quirks(spark):
    got = T.parse_features(lines(spark, ["1:2,1:3\t%e", "1:2,3 %f", "1:2 %g junk", "x:1 %h"])).collect()
    assert sorted((r.image_id, r.feature_id or -1, r.value) for r in got) == [("e", 1, 2.0), ("e", 1, 3.0), ("f", 1, 2.0), ("g", 1, 2.0), ("h", -1, 1.0)]
    with pytest.raises(PySparkException):
        T.parse_features(lines(spark, ["1:2,3 %f"]), strict=True).collect()
    with pytest.raises(PySparkException):
        T.parse_features(lines(spark, [""]), strict=True).collect()
    narrow = T.parse_features(lines(spark, ["1:2 %k\tz"]), delimiters=r"[ %]+").collect()
    assert [r.image_id for r in narrow] == ["k\tz"]


def test_bag_counts_repeats_and_self_pairs(spark):
    p = W.postings_of(T.parse_features(lines(spark, ["1:2,1:3,2:1 %e", "1:1,3:2 %f", "4:1 %g"])))
    got = edges(G.similarity_graph_bag(p))
    assert ("e", "e") in got and ("e", "f") in got
    assert ("e", "e") not in edges(G.similarity_graph(p))


def test_clusters(spark):
    rows = ["p:1\ta b", "p:2\ta  c ", "q:3\tx", "bad", None]
    got = {(r.cluster_id, r.image_id) for r in T.parse_clusters(lines(spark, rows)).collect()}
    assert got == {("1", "a"), ("1", "b"), ("2", "a"), ("2", "c"), ("3", "x")}
    assert {r.cluster_id for r in T.parse_clusters(lines(spark, rows), min_size=2).collect()} == {"2"}
    flagged = T.parse_clusters(lines(spark, ["p:1\ta#in b%out"]), flagged=True).collect()
    assert {(r.image_id, r.sample_flag) for r in flagged} == {("a", "in"), ("b", "out")}
    assert C.cluster_members(pools(spark, TWO), 2).count() == 0
    whole = T.parse_clusters(lines(spark, ["a:1\tx y", "b:1\tz", "plain\tx"]), whole_key=True).collect()
    assert {(r.cluster_id, r.image_id) for r in whole} == {("a:1", "x"), ("a:1", "y"), ("b:1", "z")}


@pytest.mark.parametrize("block", [1, 4, 512])
def test_cluster_pairs_by_blocks(spark, monkeypatch, block):
    """All pairs of pools of one and several blocks, each once, whatever the pools' sizes, order, repeats and nulls."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    rows = [(f"{rng.choice('abc')}:{int(rng.random() ** 2 * 9)}", str(rng.randrange(40))) for _ in range(150)]
    rows += [("z", str(k)) for k in range(30)] + [("y", str(k)) for k in range(10, 40)] + [(None, "1"), (None, "2"), ("z", None), ("y", None), ("é", "Ω"), ("é", "1")]
    members = defaultdict(set)
    for pool, image in rows:
        if pool is not None and image is not None:
            members[pool].add(image)
    want = {(x, y) for of in members.values() for x in of for y in of if x < y}
    df = spark.createDataFrame(rows, "cluster_id string, image_id string")
    got = [tuple(r) for r in C.cluster_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert C.cluster_pairs(df.limit(0)).count() == 0


def test_members_of_a_pool_are_not_sorted_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 50)
    df = spark.createDataFrame([("a", str(i)) for i in range(1_000)] + [("b", "1")], "cluster_id string, image_id string")
    blocks = C.pool_blocks(df)
    assert "Window" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    rows = blocks.collect()
    assert sorted(i for r in rows if r.cluster_id == "a" for i in r.ids) == sorted(str(i) for i in range(1_000)) and max(len(r.ids) for r in rows) < 100
    assert len(rows) == 21 and all(r.ids == sorted(r.ids) for r in rows)


def test_cluster_pairs_join_blocks(spark, monkeypatch):
    """A join of a pool of n members yields pairs of blocks, not of members, and no task has the whole pool."""
    monkeypatch.setattr(C, "BLOCK", 50)
    df = spark.createDataFrame([("p", str(k)) for k in range(1_000)], "cluster_id string, image_id string")
    found = C.cluster_pairs(df)
    assert found.count() == 1_000 * 999 // 2
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert joins and not [x for x in joins if "arrays_overlap" in x or "image_id" in x]
    assert [x for x in joins if "cluster_id" in x and "block" in x]


def test_pairs_are_listed_by_member_in_many_tasks(spark, monkeypatch):
    """Pairs aren't put in order one by one, no row becomes all pairs of two blocks at once, and few bytes don't make few tasks."""
    monkeypatch.setattr(C, "BLOCK", 8)
    monkeypatch.setattr("tessera.operators.dealing.TASK_ROWS", 10)
    found = C.cluster_pairs(spark.createDataFrame([("p", str(k)) for k in range(60)] + [("q", str(k)) for k in range(5)], "cluster_id string, image_id string"), 200)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 and all(a < b for a, b in got)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "least(" not in plan and "greatest(" not in plan
    listed = [x for x in plan.split("\n") if "Generate posexplode" in x]
    stages = [m.group(1) for x in listed if (m := re.search(r"\*\((\d+)\) Generate", x))]
    assert len(listed) >= 2 and len(stages) == len(set(stages))
    assert found.rdd.getNumPartitions() == 20


def test_pairs_that_share_several_pools_count_once(spark, postings):
    p = pools(spark, [*TWO, *ONE, ("3", "a"), ("3", "b"), ("3", "b")])
    assert edges(G.cluster_feature_graph(postings, p)) == edges(G.similarity_graph(postings))
    assert C.cluster_pairs(p).count() == 6
    rows = [("1", "a", "old"), ("1", "b", "old"), ("2", "a", "in"), ("2", "b", "old"), ("3", "a", "in"), ("3", "b", "in"), ("4", "c", "x"), ("4", "d", "x"), ("4", "d", "y"), ("5", "a", None), ("5", "c", "in")]
    flagged = spark.createDataFrame(rows, "cluster_id string, image_id string, sample_flag string")
    assert sorted(map(tuple, C.flagged_pairs(flagged).collect())) == [("a", "b"), ("c", "d")]
    for plan in ("pools", "candidates", "features"):
        assert edges(G.progressive_graph(postings, flagged, plan=plan)) == {("a", "b"): 0.605621, ("c", "d"): 0.448957}


def test_broadcast_and_shuffled_frequencies_agree(spark):
    obs = T.parse_features(lines(spark, LINES))
    n = W.vocabulary_of(obs)
    assert n >= 6
    rows = [sorted((r.image_id, r.feature_id, r.w) for r in W.weights_of(obs, v).collect()) for v in (None, n, W.BROADCAST_FEATURES + 1)]
    assert rows[0] == rows[1] == rows[2]


def test_gzip_input(spark, tmp_path):
    with gzip.open(tmp_path / "f.txt.gz", "wt") as file:
        file.write("\n".join(x for x in LINES if x))
    (tmp_path / "g.txt").write_text("9:1 %y\n")
    got = T.read_features(spark, str(tmp_path)).collect()
    plain = T.parse_features(lines(spark, [*LINES, "9:1 %y"])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))


def test_left_join_default(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "image_id string")
    got = {r.image_id: r.cluster_id for r in C.cluster_left_join(rows, pools(spark, [("1", "a"), ("2", "a")])).collect()}
    assert got == {"a": "2", "z": "unknown"}


def test_empty(spark):
    p = W.postings_of(T.parse_features(lines(spark, ["", " %z"])))
    assert G.similarity_graph(p).count() == 0
    assert G.candidate_graph(p, pools(spark, [])).count() == 0


def test_text_out_and_command_line(spark, tmp_path, postings):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.txt").write_text("\n".join(x for x in LINES if x))
    (tmp_path / "pools").mkdir()
    (tmp_path / "pools/c.txt").write_text("m:1\ta b\nm:2\tb c\n")
    write_text(edge_lines(G.similarity_graph(postings, 0.1)), str(tmp_path / "gz"), compress=True)
    assert list((tmp_path / "gz").glob("*.gz"))
    assert {x.value.split("\t")[0] for x in spark.read.text(str(tmp_path / "gz")).collect()} == {"(a,b)", "(c,d)"}
    assert posting_lines(postings).where("value like '5\t[(%d)]'").count() == 1
    assert main(["base", str(tmp_path / "in"), "0.1", str(tmp_path / "o1")]) == 0
    assert spark.read.text(str(tmp_path / "o1")).count() == 2
    assert main(["overlap", str(tmp_path / "in"), str(tmp_path / "pools"), "0", "0", str(tmp_path / "o2"), "compress"]) == 0
    assert spark.read.text(str(tmp_path / "o2")).count() == 2
    assert main(["nonsense"]) == 2
    for j, rows in ((1, "m:1\ta b\nm:2\tb c\n"), (2, "m:1\tc d\n")):
        (tmp_path / f"runs/iterate{j}").mkdir(parents=True)
        (tmp_path / f"runs/iterate{j}/c.txt").write_text(rows)
    assert main(["sweep", str(tmp_path / "in"), str(tmp_path / "runs"), "0,0.1", "0", str(tmp_path / "o3"), "compress"]) == 0
    found = {str(p.parent.relative_to(tmp_path / "o3")) for p in (tmp_path / "o3").rglob("*.gz")}
    assert found == {f"threshold_{t}/min_hash_iterate{j}" for t in ("0", "0.1") for j in (1, 2)}
    assert [x.value for x in spark.read.text(str(tmp_path / "o3/threshold_0.1/min_hash_iterate2")).collect()][0].startswith("(c,d)\t")


def test_command_line_delimiters_and_keys_by_variant(spark, tmp_path):
    """Some formats split at tabs, others have tabs in image ids; one keeps a cluster's whole key."""
    (tmp_path / "f.txt").write_text("1:2 %a\tx\n1:2 %b\tx\n2:1 %c\n")
    (tmp_path / "c.txt").write_text("p:1\ta b\nq:1\tc\n")
    for variant, want in (("overlap", {"(a,b)"}), ("feature", set()), ("candidates", {"(a,b)"}), ("single", {"(a\tx,b\tx)"})):
        out = str(tmp_path / variant)
        assert main([variant, str(tmp_path / "f.txt"), str(tmp_path / "c.txt"), "0", "0", out]) == 0
        assert {x.value.rpartition("\t")[0] for x in spark.read.text(out).collect()} == want


def brute(obs, t):
    """The same algebra over dictionaries."""
    dl, images = {}, sorted({i for i, _ in obs})
    for i, _ in obs:
        dl[i] = dl.get(i, 0) + 1
    n, adl = len(images), sum(dl.values()) / len(images)
    tf = {k: float(np.float32(v / (v + 0.5 + 1.5 * dl[k[0]] / adl))) for k, v in obs.items() if v > 0}
    df = {}
    for _, f in tf:
        df[f] = df.get(f, 0) + 1
    w = {(i, f): x * math.log((n + 0.5) / df[f]) / math.log(n + 1) for (i, f), x in tf.items()}
    norm = {i: math.sqrt(sum(x * x for (j, _), x in w.items() if j == i)) for i in images}
    out = {}
    for (i, f), x in w.items():
        for (j, g), y in w.items():
            if f == g and i < j and x > max(t, 0) and y > max(t, 0):
                out[(i, j)] = out.get((i, j), 0) + x / norm[i] * (y / norm[j])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    obs = {(f"i{rng.randrange(12)}", rng.randrange(9)): float(rng.randrange(-1, 6)) for _ in range(60)}
    rows = spark.createDataFrame([(i, f, v) for (i, f), v in obs.items()], "image_id string, feature_id int, value double")
    for t in (0.0, 0.15):
        got = {(r.image_a, r.image_b): r.similarity for r in G.similarity_graph(W.postings_of(rows), t).collect()}
        assert got == pytest.approx(brute(obs, t), abs=1e-9)
