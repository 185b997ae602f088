import numpy as np
import pytest

from tessera.llm.components import components
from tessera.llm.ngram_join import BLOCK, _grouped


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(2)
    edges = {
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))],
        "chain": [(int(i), int(i) + 1) for i in rng.permutation(300)],
        "star": [(500, int(i)) for i in range(300)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in components(df).collect()} == brute(edges)


def test_scratch_is_deleted(spark, tmp_path):
    import os

    from tessera.llm.common import scratch, written

    with scratch(spark) as root:
        assert written(spark.range(5), "rows").count() == 5
        assert os.path.isdir(root.removeprefix("file://"))
    assert not os.path.exists(root.removeprefix("file://"))


def test_groups_are_cut_only_between_keys():
    import pyarrow as pa

    rows = sorted((int(k), v) for v, k in enumerate(np.random.default_rng(4).integers(0, 9, 200)))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 7]]) for i in (0, 1)], ["k", "v"]) for at in range(0, 200, 7)]
    chunks = [list(zip(c.column("k").to_pylist(), c.column("v").to_pylist(), strict=True)) for c in _grouped(iter(batches), ("k",))]
    assert [x for c in chunks for x in c] == rows and BLOCK > 1
    assert all(a[-1][0] != b[0][0] for a, b in zip(chunks, chunks[1:], strict=False))


def test_a_cluster_must_name_its_shared_folder(spark):
    import types

    from tessera.llm import common

    def session(master, folder):
        conf = types.SimpleNamespace(get=lambda key, default=None: folder)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        common.shared_dir(session("spark://host:7077", None), "x")
    assert common.shared_dir(session("yarn", "hdfs://h/d/"), "x").startswith("hdfs://h/d/x-")
    assert common.shared_dir(session("local[2]", None), "x").startswith("file:///")


@pytest.mark.parametrize("limit", [3, 50])
def test_components_with_small_forests(spark, monkeypatch, limit):
    from tessera.llm import components as module

    monkeypatch.setattr(module, "NODES", limit)
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(9).integers(0, 200, (150, 2))]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()} == brute(edges)
