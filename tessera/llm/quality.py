"""Quality scores: a Bradley-Terry model of preference pairs, thresholded by score quantile.

A labelled good document is preferred to a labelled bad one. The model gives each
document a score such that the preferred of a pair wins with probability
``logistic(score_i - score_j)``; its weights minimise the logistic loss on feature
differences of seeded pairs, with a small ridge, by Newton steps.

Features are column expressions over the whole text (lengths, shares of kinds of
characters, variety of words and lines), so texts stay in the JVM. Each is cut to the
range of the training rows, scaled, and joined by hinges at its quantiles, so a score
can fall on both sides of a usual range.

The threshold is the quantile of the training scores at the share of bad labels: as
many documents pass as labels say are good. Reported scores are shifted so that this
threshold falls on ``THRESHOLD``.

Fitted on every labelled document outside the held-out fold: features are written once,
ranges, quantiles (counted in ``BINS`` steps of a range) and the threshold (exact) are
those of all of them, and each is in a pair, of which there are ``PAIRS`` at least if
there can be. Tasks sum a Newton step's loss, gradient and curvature over their pairs; the driver
adds these sums up and holds no documents. All documents are scored over their whole text.

A null text is empty and scored as one; a null id is never a training row. Without labels
of both kinds every score is the share of good labels (a half without labels). Of several
labels of an id the smallest counts. Repeated rows give equal scores; an empty table
gives none. Further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bloom import bloom_of, passing, words_for
from tessera.llm.common import SPACE, bucket_count, ranked, released, text_of, written

PAIRS = 40_000
BINS = 1 << 16  # of a feature's range, for its quantiles
CUT_BINS = 1 << 10  # of a range of margins, at each step of the search for the threshold
BROADCAST_ROWS = 50_000  # of features: some megabytes
RIDGE = 1e-3
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)
THRESHOLD = 0.3
SEED = 31
HELD_OUT = (5, 0)  # crc32 of the id as text, modulo the first, is the second


def features(text: Column, words: Column) -> dict[str, Column]:
    """Numbers of a text; ``words`` are its runs without white space (one empty one for a blank text)."""
    length = F.char_length(text).cast("double")
    n = F.size(words).cast("double")
    per_char = lambda c: c / F.greatest(length, F.lit(1.0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    lines = F.split(text, "\n", -1)
    n_lines = F.size(lines).cast("double")
    distinct = F.size(F.array_distinct(words)).cast("double")
    return {
        "length": F.log1p(length),
        "words": F.log1p(n),
        "word_length": F.log1p(length / n),
        "variety": F.log(distinct + 1) / F.log(n + 1),
        "distinct": distinct / n,
        "lines": n_lines / n,
        "line_variety": F.size(F.array_distinct(lines)).cast("double") / n_lines,
        "capitals": per_char(count("[A-Z]")),
        "digits": per_char(count("[0-9]")),
        "symbols": per_char(count(r"[#$%&*|<>{}\[\]\\^~=+@_/]")),
        "stops": per_char(count("[.,;:]")),
        "cries": per_char(count("[!?]")),
        "space": per_char(count(r"[\x20\x09-\x0D]+")),
    }


def with_features(docs: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``x``, the features as an array."""
    rows = docs.select(*keep, text_of(text_col).alias("q_text"))
    rows = rows.withColumn("q_words", F.split(F.btrim(F.col("q_text"), F.lit(SPACE)), r"[\x20\x09-\x0D]+"))
    x = F.array(*features(F.col("q_text"), F.col("q_words")).values())
    return rows.select(*(c for c in rows.columns if c not in ("q_text", "q_words")), x.alias("x"))


@dataclass
class Model:
    """Score = logistic(weights . basis(x) + shift)."""

    shift: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # feature by (itself and hinges)
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Scaled features and their hinges, feature by feature."""
        z = (np.clip(x, self.low, self.high) - self.low) / np.where(self.high > self.low, self.high - self.low, 1.0)
        return np.concatenate([z[:, :, None], np.maximum(0.0, z[:, :, None] - self.knots[None])], axis=2).reshape(len(x), -1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights.ravel() + self.shift

    def margin(self, x: Column) -> Column:
        """The same as a column: sums of hinges, inside the JVM."""
        terms = [F.lit(float(self.shift))]
        for i, w in enumerate(self.weights):
            span = float(self.high[i] - self.low[i]) or 1.0
            z = (F.least(F.greatest(F.get(x, F.lit(i)), F.lit(float(self.low[i]))), F.lit(float(self.high[i]))) - float(self.low[i])) / span
            terms += [z * float(w[0]), *(F.greatest(F.lit(0.0), z - float(k)) * float(v) for k, v in zip(self.knots[i], w[1:], strict=True))]
        return reduce(lambda a, b: a + b, terms)

    def score(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-self.margin(x)))


def preference_pairs(n_good: int, n_bad: int, pairs: int = PAIRS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad row of each seeded pair; every row is in some pair, as far as ``pairs`` goes."""
    rng = np.random.default_rng(seed)
    each = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-pairs // n))])[:pairs]
    return each(n_good), each(n_bad)


def loss_sums(difference: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over pairs, in one row: log(1 + exp(-w . difference)), its gradient and its curvature."""
    margin = difference @ w
    lost = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
    curve = (difference * (lost * (1 - lost))[:, None]).T @ difference
    return np.concatenate([[np.logaddexp(0.0, -margin).sum()], -difference.T @ lost, curve.ravel()])


def minimised(sums: Callable[[np.ndarray], np.ndarray], pairs: int, size: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean loss of so many pairs + ridge |w|^2 / 2, by Newton steps; ``sums`` gives ``loss_sums`` of all pairs."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = sums(w) / pairs
        return mean[0] + ridge * (w @ w) / 2, mean[1 : size + 1] + ridge * w, mean[size + 1 :].reshape(size, size) + ridge * np.eye(size)

    w = np.zeros(size)
    now, gradient, curve = at(w)
    for _ in range(100):
        step, length = np.linalg.solve(curve, gradient), 1.0
        if step @ gradient < 2e-12:  # twice what is left to gain
            break
        while (then := at(w - length * step))[0] > now and length > 1e-6:
            length /= 2
        if then[0] > now:
            break
        w = w - length * step
        now, gradient, curve = then
    return w


def bradley_terry(difference: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of pairs at hand."""
    return minimised(lambda w: loss_sums(difference, w), len(difference), difference.shape[1], ridge)


def constant(share: float) -> Model:
    """Every score is the share of good labels."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(float(np.log(p / (1 - p))))


def train(x: np.ndarray, good: np.ndarray, good_share: float | None = None) -> Model:
    """Model of labelled feature rows at hand; ``good_share`` is the share of good labels where that of the rows differs."""
    good = good.astype(bool)
    share = float(good.mean()) if good_share is None and len(good) else 0.5 if good_share is None else good_share
    if len(set(good.tolist())) < 2:
        return constant(share)
    low, high = x.min(axis=0), x.max(axis=0)
    z = (x - low) / np.where(high > low, high - low, 1.0)
    model = Model(0.0, low=low, high=high, knots=np.quantile(z, KNOTS, axis=0).T.copy())
    basis = model.basis(x)
    first, second = preference_pairs(int(good.sum()), int((~good).sum()))
    model.weights = bradley_terry(basis[good][first] - basis[~good][second]).reshape(x.shape[1], -1)
    margin = model.margins(x)
    # quantile of the labelled rows, each kind weighing as among all labels: the middle of the gap that parts the shares
    weight = np.where(good, share / good.sum(), (1 - share) / (~good).sum())
    order = np.argsort(margin, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weight[order]), 1 - share - 1e-9)), len(order) - 2)
    cut = (margin[order[at]] + margin[order[at + 1]]) / 2
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return model


def held_out(id_column: Column) -> Column:
    """Rows that are never trained on."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def _ranges(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest value of each feature, and its quantiles ``KNOTS`` on that range."""
    every = [F.get("x", F.lit(i)) for i in range(len(features(F.lit(""), F.array(F.lit("")))))]
    found = rows.agg(F.array(*(F.min(c) for c in every)).alias("low"), F.array(*(F.max(c) for c in every)).alias("high")).first()
    low, high = np.array(found["low"]), np.array(found["high"])
    steps = [F.floor((c - float(a)) / (float(b - a) or 1.0) * BINS) for c, a, b in zip(every, low, high, strict=True)]
    counts = rows.select(F.posexplode(F.array(*steps)).alias("feature", "step")).groupBy("feature", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("feature").orderBy("step")))  # BINS rows of a feature at most
    place = np.array(KNOTS) * (n - 1)
    at = lambda k: F.min(F.when(F.col("upto") > min(int(k), n - 1), F.col("step"))) / BINS
    ends = upto.groupBy("feature").agg(F.array(*(at(k) for k in place)).alias("a"), F.array(*(at(k + 1) for k in place)).alias("b")).orderBy("feature").collect()
    a, b = np.array([r["a"] for r in ends]), np.array([r["b"] for r in ends])
    return low, high, a + (b - a) * (place % 1)


def _pairs(rows: DataFrame, n_good: int, n_bad: int, pairs: int = PAIRS) -> tuple[DataFrame, int]:
    """``(good_x, bad_x)`` of seeded pairs, and their number: every row of the commoner kind with so many of the other, in a circle, that there are ``pairs``."""
    many, few = max(n_good, n_bad), min(n_good, n_bad)
    rounds = min(few, -(-pairs // many))
    sides = ("good_x", "bad_x") if n_good >= n_bad else ("bad_x", "good_x")
    numbered = ranked(rows, ["good"], "place", bucket_count(n_good + n_bad))
    kind = F.col("good") == (1 if n_good >= n_bad else 0)
    common = numbered.where(kind).select("rank", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"), F.col("x").alias(sides[0]))
    rare = numbered.where(~kind).select(F.col("rank").alias("other"), F.col("x").alias(sides[1]))
    met = common.withColumn("other", (F.col("rank") + F.col("round")) % few).join(F.broadcast(rare) if few <= BROADCAST_ROWS else rare, "other")
    return met.sortWithinPartitions("rank", "round").select("good_x", "bad_x"), many * rounds  # in order, so sums are the same in each run


def _summed(pairs: DataFrame, model: Model, w: np.ndarray) -> np.ndarray:
    """``loss_sums`` of all pairs: one row of sums comes from each task."""

    def step(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            good, bad = (model.basis(batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1)) for c in ("good_x", "bad_x"))
            found = loss_sums(good - bad, w)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    return np.sum([r["sums"] for r in pairs.mapInArrow(released(step), "sums array<double>").collect()], axis=0)


def _cut(rows: DataFrame, share: float, n_good: int, n_bad: int) -> float:
    """The quantile of ``margin`` at the share of bad labels, each kind weighing as among all labels: the middle of the gap that parts the shares.

    Found exactly by counting in ever smaller ranges: each step fetches ``CUT_BINS`` rows at most.
    """
    good, bad = share / n_good, (1 - share) / n_bad
    target, below = 1 - share - 1e-9, 0.0
    low, high = rows.agg(F.min("margin"), F.max("margin")).first()
    while True:
        at = F.least(F.floor((F.col("margin") - low) / ((high - low) or 1.0) * CUT_BINS), F.lit(CUT_BINS - 1))
        count = lambda k: F.count_if(F.col("good") == k)
        counts = rows.where(F.col("margin").between(low, high)).groupBy(at.alias("at")).agg(count(1).alias("good"), count(0).alias("bad"), F.min("margin").alias("low"), F.max("margin").alias("high"))
        bins = sorted(counts.collect())
        for r in bins:
            own = r["good"] * good + r["bad"] * bad
            if below + own >= target or r is bins[-1]:
                low, high = r["low"], r["high"]
                break
            below += own
        if low == high:
            break
    ends = rows.agg(F.max(F.when(F.col("margin") < low, F.col("margin"))).alias("before"), F.min(F.when(F.col("margin") > low, F.col("margin"))).alias("after")).first()
    other = ends["after"] if ends["after"] is not None else ends["before"]
    return low if other is None else (low + other) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model of all labelled rows outside the held-out fold.

    Texts of documents without a label are dropped by a Bloom filter of the labels' ids before
    their features are computed, and what is shuffled are features, not texts.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("good")).where("label_id IS NOT NULL AND good IS NOT NULL").where(~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.min("good").alias("good")).where("good IN (0, 1)")
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return constant(counts.get(1, 0) / total if total else 0.5)
    share, words = counts[1] / total, words_for(total)
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    key = [F.col("label_id").cast("string")]  # the same hash whatever the columns' types
    own = passing(own, bloom_of(known, key, words) if words else None, key, words)
    rows = with_features(own, F.col("label_id")).join(known, "label_id").distinct()
    rows = written(rows.select("good", "x", F.xxhash64(F.lit(SEED), "label_id", "x").alias("place")), "quality-features")
    found = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(found) < 2:
        return constant(share)
    low, high, knots = _ranges(rows, found[0] + found[1])
    model = Model(0.0, low=low, high=high, knots=knots)
    pairs, n_pairs = _pairs(rows, found[1], found[0])
    pairs = written(pairs, "quality-pairs")
    size = len(low) * (1 + len(KNOTS))
    model.weights = minimised(lambda w: _summed(pairs, model, w), n_pairs, size).reshape(len(low), -1)
    cut = _cut(rows.select("good", model.margin(F.col("x")).alias("margin")), share, found[1], found[0])
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text."""
    rows = with_features(docs, F.col(id_col).alias("doc_id"), text_col=text_col).select("doc_id", model.score(F.col("x")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents at or above the threshold, all columns as they were."""
    names = docs.columns
    plain = docs.toDF(*(f"in_{n}" for n in names))
    found = with_features(plain, *(F.col(f"in_{n}") for n in names), text_col=f"in_{text_col}")
    return found.where(model.score(F.col("x")) >= THRESHOLD).select(*(F.col(f"in_{n}").alias(n) for n in names))
