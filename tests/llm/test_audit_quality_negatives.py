"""Filter audit, quality ranking and hard negatives against plain Python, on odd rows and on the test tables."""

import math
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F

from odd import LONG, ODD_DOCS
from tessera.llm import filter_audit, hard_negatives, quality
from tessera.llm import queries as Q
from tessera.llm.oracle import ORACLE

AUDIT = "op11_filter_audit"


def views(d, *names):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return con


# op11


def brute_audit(docs, labels):
    """Rows of the audit by applying the filters one after the other, for every order."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", fails, i in good, i in toxic))
    found = set()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                redundant = sum(r[1][f] for r in own) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        found |= {(*s[:-1], shapley[s[-1]]) for s in steps}
    return found


ORDER = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = [(1, 1, 0), (2, None, 1), (4, 1, 1), (8, 1, None), (8, 0, 1), (None, 1, 1), (99, 1, 1), (6, 0, 0)]


def audit_docs():
    words = [f"w{k}" for k in range(250)]
    more = [(20, " ".join(words), "en"), (21, " ".join(words), "fr"), (22, " ".join(words), ""), (23, "UP " * 300, None), (24, " ".join(words) + " |", "en"), (20, " ".join(words), "en"), (25, "same " * 400, "de")]
    return [(r[0], r[1], r[2]) for r in ODD_DOCS] + more


def test_audit_odd(spark, tables):
    docs = audit_docs()
    d = tables(documents=[(i, t, lang, "s", 0, "x", 1, True) for i, t, lang in docs], extra="part string, fails int, good boolean")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    got = Q.QUERIES[AUDIT](spark, d)
    rows = [tuple(r[c] for c in ORDER) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_audit(docs, LABELS)
    assert rows_of(got) == rows_of_sql(views(d, "documents", "labels"), ORACLE[AUDIT])


def test_audit_empty(spark, tables):
    assert Q.QUERIES[AUDIT](spark, tables()).count() == 0


def test_audit_visits_each_set_of_filters_once(spark, monkeypatch):
    """Sixteen and not 65 nodes for four filters, few of them persisted at a time, none left behind."""
    rows = spark.createDataFrame([("p", k % 16, k % 3 == 0, False) for k in range(64)], "part string, fails int, good boolean, toxic boolean")
    seen, held = [], []
    counts = filter_audit._edge_counts

    def counted(survivors, state, free):
        seen.append(state)
        held.append(spark.sparkContext._jsc.sc().getPersistentRDDs().size())
        return counts(survivors, state, free)

    monkeypatch.setattr(filter_audit, "_edge_counts", counted)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    found = filter_audit.audit(rows, "WXYZ").collect()
    assert sorted(seen) == list(range(15)) and max(held) - before <= 4
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    assert len(found) == 24 * 4 and {r.shapley for r in found} == {sum(24 // bin(m).count("1") * (m & 1) for m in range(1, 16)) * 4}


def test_audit_limits(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([], "part string, fails int, good boolean, toxic boolean"), "ABCDEFGHI")


# op12


def brute_features(text):
    words = re.split(r"[\x20\x09-\x0D]+", text.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    n, size, lines = len(words), len(text), text.split("\n")
    share = lambda p: len(re.findall(p, text)) / max(size, 1)
    return [
        math.log1p(size), math.log1p(n), math.log1p(size / n), math.log(len(set(words)) + 1) / math.log(n + 1), len(set(words)) / n, len(lines) / n, len(set(lines)) / len(lines),
        share("[A-Z]"), share("[0-9]"), share(r"[#$%&*|<>{}\[\]\\^~=+@_/]"), share("[.,;:]"), share("[!?]"), share(r"[\x20\x09-\x0D]+"),
    ]


def test_features_of_whole_texts(spark):
    texts = [r[1] for r in ODD_DOCS] + ["A|B {x} [y] \\ ^ ~ 12 !?\n\n A|B"]
    rows = quality.with_features(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), F.col("k")).collect()
    for r in rows:
        assert r.x == pytest.approx(brute_features(texts[r.k] or ""), rel=1e-12)


def test_ranking_minimises_the_pairwise_loss():
    rng = np.random.default_rng(1)
    difference = rng.normal(0.3, 1.0, (500, 6))
    loss = lambda w: np.logaddexp(0.0, -difference @ w).mean() + quality.RIDGE * (w @ w) / 2
    w = quality.bradley_terry(difference)
    assert all(loss(w) <= loss(w + 1e-3 * step) for step in rng.normal(size=(50, 6)))


def test_every_labelled_row_is_in_a_pair():
    good, bad = quality.preference_pairs(70, 30, pairs=100)
    assert len(good) == len(bad) == 100 and set(good) == set(range(70)) and set(bad) == set(range(30))


def test_threshold_is_the_quantile_of_the_scores():
    rng = np.random.default_rng(2)
    good = rng.random(400) < 0.7
    x = rng.normal(size=(400, 3)) + good[:, None]
    model = quality.train(x, good)
    assert (1 / (1 + np.exp(-model.margins(x))) >= quality.THRESHOLD).sum() == good.sum()
    half = quality.train(x, good, good_share=0.4)  # bad rows stand for more labels than the sample has of them
    kept = half.margins(x) >= np.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    weight = np.where(good, 0.4 / good.sum(), 0.6 / (~good).sum())
    assert weight[kept].sum() == pytest.approx(0.4, abs=0.6 / (~good).sum())


def test_scores_in_the_jvm_are_the_model(spark):
    docs = spark.createDataFrame([(k, r[1]) for k, r in enumerate(ODD_DOCS)], "doc_id long, text string")
    x = np.array([brute_features(r[1] or "") for r in ODD_DOCS])
    model = quality.train(x, np.arange(len(x)) % 2 == 0)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert [got[k] for k in range(len(x))] == pytest.approx((1 / (1 + np.exp(-model.margins(x)))).tolist(), rel=1e-9)


@pytest.mark.parametrize(("marks", "want"), [([], 0.5), ([1, 1], 1.0), ([0, 0], 0.0)])
def test_labels_of_one_kind(spark, tables, marks, want):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][: len(marks)]
    d = tables(documents=[(*r, "x", 1) for r in ODD_DOCS], labels=[], extra="score string, x int")
    spark.createDataFrame([(i, m, 0) for i, m in zip(ids, marks, strict=True)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{d}/labels.parquet")
    rows = Q.QUERIES["op12_quality"](spark, d).collect()
    assert len(rows) == len(ODD_DOCS) and all(abs(r.score - want) < 1e-5 and r.predicted == (want >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_empty(spark, tables):
    assert Q.QUERIES["op12_quality"](spark, tables()).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}" if i % 2 else f"### $$$ {i}") for i in range(200)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    models = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, (i % 2) ^ (flip and held(i))) for i in range(200)], "doc_id long, quality int")
        models.append(quality.fit(docs, labels))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].shift == models[1].shift


def test_every_label_is_fitted_on(spark):
    rng = np.random.default_rng(3)
    ids = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 5]  # more than 8,000, at most 4,000 of a kind were taken once
    texts = {i: " ".join(["plain", "#$", "words.", "A1"][k] for k in rng.integers(0, 4, rng.integers(1, 12))) + " x" * (i % 97) for i in ids}
    good = {i: int(rng.random() < 0.8 - 0.6 * (texts[i].count("#") > 2)) for i in ids}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(sorted(good.items()), "doc_id long, quality int")
    model = quality.fit(docs, labels)
    x, y = np.array([brute_features(texts[i]) for i in ids]), np.array([good[i] for i in ids], dtype=bool)
    assert model.low == pytest.approx(x.min(axis=0)) and model.high == pytest.approx(x.max(axis=0))
    z = (x - x.min(axis=0)) / np.where(x.max(axis=0) > x.min(axis=0), x.max(axis=0) - x.min(axis=0), 1.0)
    assert np.abs(model.knots - np.quantile(z, quality.KNOTS, axis=0).T).max() < 2 / quality.BINS
    margins = np.sort(model.margins(x) - np.log(quality.THRESHOLD / (1 - quality.THRESHOLD)))
    share = y.mean()
    weight = np.where(y[np.argsort(model.margins(x), kind="stable")], share / y.sum(), (1 - share) / (~y).sum())
    at = int(np.searchsorted(np.cumsum(weight), 1 - share - 1e-9))
    assert margins[at] <= 1e-9 <= margins[at + 1] + 2e-9  # the threshold parts all labelled rows by their share
    again = quality.fit(docs, labels)
    assert np.array_equal(model.weights, again.weights) and model.shift == again.shift


def test_pairs_use_every_row_and_none_twice(spark):
    rows = spark.createDataFrame([(int(i < 70), [float(i)], (i * 7919 << 40) - (1 << 62)) for i in range(100)], "good int, x array<double>, place long")
    pairs, n = quality._pairs(rows, 70, 30, pairs=500)
    got = [(r.good_x[0], r.bad_x[0]) for r in pairs.collect()]
    assert len(got) == len(set(got)) == n == 560 and {a for a, _ in got} == set(range(70)) and {b for _, b in got} == set(range(70, 100))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_accuracy(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = Q.QUERIES["op12_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    good, bad = ([r.predicted for r in rows if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 5


def test_keep_good(spark):
    rows = [(1, "Plain words of a text, and more of them.", 5, "a"), (2, "$$$ ### $$$", 6, "b"), (3, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int, score string")
    model = quality.train(np.array([brute_features(t) for t in ("some plain words, and more", "a plain text of words", "$$$ ### $$$", "%%% &&& ***")]), np.array([1, 1, 0, 0]))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1} and 2 not in {r.doc_id for r in kept.collect()}


# op13


def brute_negatives(rows, every=100):
    """Rows of the contract, by sorting all rows for each anchor."""
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, v) for i, l, v in whole]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    key = lambda s, i: (-s, i is None, i or 0)
    found = []
    for a, la, va in {(i, l, tuple(v)) for i, l, v in whole if i is not None and i % every == 0}:
        scored = sorted(((dot(va, v), i, l) for i, l, v in whole), key=lambda r: key(r[0], r[1]))
        for ps, p, _ in [r for r in scored if r[2] == la and r[1] != a][:5]:
            fit = [(s, i) for s, i, l in scored if l != la and 80 * ps <= 100 * s <= 100 * ps][:5]
            found += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(fit)]
    return sorted(found, key=repr)


def mined(spark, rows, parts=3):
    from tempfile import mkdtemp

    d = mkdtemp()
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(parts).write.parquet(f"{d}/embeddings.parquet")
    got = Q.QUERIES["op13_hard_negatives"](spark, d)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr), d


def vectors(n, width=8, seed=3, labels=4):
    rng = np.random.default_rng(seed)
    return [(k, int(rng.integers(labels)), [float(np.float32(x)) for x in rng.normal(0, 1, width)]) for k in range(n)]


def test_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(420)
    rows += [(None, 1, rows[100][2]), (None, 2, rows[200][2]), (500, None, [1.0] * 8), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [nan] * 8), (504, 2, [inf] + [0.0] * 7)]
    rows += [(600, 3, []), (700, 1, [0.5, -0.5]), (601, 2, [0.25] * 20), rows[100], (200, 0, rows[200][2]), rows[33], rows[34]]
    rows += [(800 + k, k % 3, rows[100][2]) for k in range(12)]  # ties
    got, d = mined(spark, rows)
    assert got == brute_negatives(rows)


def test_negatives_of_a_vector_that_a_third_has(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "SALT_ROWS", 2)
    rows = vectors(900, seed=5)
    rows = [(i, l, rows[0][2] if i % 3 == 0 else v) for i, l, v in rows]
    assert mined(spark, rows)[0] == brute_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(100, 1, [1.0]), (200, 2, [1.0])]])
def test_negatives_of_few_rows(spark, rows):
    assert mined(spark, rows)[0] == []


def test_scores_beyond_exact_floats(spark):
    big = [(100, 1, [3e15, 1.0]), (101, 1, [3e15, 2.0]), (102, 2, [3e15, 1.5]), (103, 2, [3e15, 0.5]), (104, 2, [1e30, 1.0])]
    a, b = np.array([[2.0**60, 3.0]]), np.array([[2.0, 1.0], [2.0**60, 1.0], [-(2.0**60), 0.0]])
    assert hard_negatives.scores(a, b).tolist() == [[2**61 + 3, hard_negatives.MOST, hard_negatives.LEAST]]
    assert isinstance(mined(spark, big)[0], list)


def test_bounds_replicate_only_what_may_serve(spark):
    """On vectors in far-apart clumps most candidates stay in their cell, and results are those without bounds."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (13, 8))
    centres *= 9 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(k, int(rng.integers(3)), [float(np.float32(x)) for x in centres[k % 13] + rng.normal(0, 0.1, 8)]) for k in range(1_200)]
    served = []
    own = hard_negatives.replicated

    def counting(tiles, cells, bounds):
        found = own(tiles, cells, bounds)
        served.append((sum(sum(r.serves) for r in found.select("serves").collect()), len(bounds)))
        return found

    hard_negatives.replicated = counting
    try:
        assert mined(spark, rows)[0] == brute_negatives(rows)
    finally:
        hard_negatives.replicated = own
    assert all(n < 0.6 * len(rows) * (groups - 1) for n, groups in served), served


def test_best_takes_first_columns_of_ties():
    values = np.array([[5, 7, 7, 1, 7], [2, 2, 2, 2, 2], [9, 8, 7, 6, 5]], np.int64)
    allowed = np.array([[1, 1, 1, 1, 1], [0, 1, 1, 0, 1], [0, 0, 0, 0, 1]], bool)
    row, column = hard_negatives.best(values, allowed, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 4)]


def test_long_text_is_one_document(spark, tables):
    d = tables(documents=[(1, LONG + "x", "de", "s", 1), (2, LONG + "y", "de", "s", 1)])
    assert {r.unique_fails for r in Q.QUERIES[AUDIT](spark, d).where("step = 1 AND filter_order LIKE 'E%'").collect()} == {0}
