"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed into ``BUCKETS``
rows), a bag the mean of its words, and a softmax over the bag gives the class. Vectors
and softmax are trained together, so a misspelling or an inflection never seen shares
n-grams with words that were.

Documents are read as overlapping bags of ``WINDOW`` words and a document's score
comes from its most toxic bag, so one passage shows in a text of any length. Labels
are given for documents only: in training, the bag that scores highest stands for its
document, beside a random one of clean documents. Vectors start from the n-grams' log
odds, less what chance explains, so the first bags picked are telling ones.

Training is cross-fitted: each of ``FOLDS`` models leaves one fold out, the model used
is their mean, and a logistic fit turns margins into probabilities on the margins that
every labelled document got from the model that didn't see it.

The model is fitted on the driver from at most ``TOXIC_DOCS`` and ``CLEAN_DOCS``
labelled documents, those with the smallest seeded hash of their id, whole texts, of at
most ``TEXT_BYTES`` each and ``TRAIN_BYTES`` together. All documents are scored, over
their whole text: the model that travels is one number for each n-gram bucket. Texts
are hashed a slice of ``SLICE`` code points at a time and no word is remembered, so a
worker's memory follows the longest text and not the vocabulary.

A null text is empty; an empty text has one empty bag and a defined score; a null id is
never a training row. Without labels of both kinds every score is the share of toxic
labels (0 without labels). Repeated rows give equal scores; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import released

BUCKETS = 1 << 17  # a power of two
WINDOW, STRIDE = 40, 20
LEAST_WORDS = 8  # a shorter bag counts as this many, the rest zero vectors
GRAMS = (3, 4, 5)
DIM, EPOCHS, BATCH, UPDATES, RATE = 8, 4, 128, 150, 0.5
FOLDS = 3
PRIOR, CHANCE, START = 4.0, 2.0, 30.0  # documents that the log odds are drawn by, standard errors taken off, weight in the first vectors
EMPTY_SHARE = 0.15
MIN_DOCS = 5  # n-grams of fewer training documents have no vector: they could only memorise
FLOOR = 1e-2  # squared gradients that every n-gram starts from: higher damps those of few documents
TOXIC_DOCS, CLEAN_DOCS = 2_000, 6_000
TEXT_BYTES, TRAIN_BYTES = 1 << 18, 1 << 25
THRESHOLD = 0.3
SEED = 23
EDGES = ".,;:!?\"'()[]{}<>*%&$#|_-…«»“”"
SLICE = 1 << 16
#: Odd multipliers of the n-gram hash, from a seed.
FACTOR, SPREAD, PLACE = (int(x) * 2 + 1 for x in np.random.default_rng(SEED).integers(1 << 61, 1 << 62, 3))


def fresh_words(text: str) -> list[str]:
    """Lower-cased words without marks at their ends; one that repeats the word before it is empty, so it says nothing a second time."""
    words = [w.strip(EDGES) or w for w in text.lower().split()]
    return [*words[:1], *("" if w == before else w for before, w in pairwise(words))]


def gram_counts(words: list[str]) -> np.ndarray:
    """N-grams of each word between ``<`` and ``>``, and the word itself; an empty word has none."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.where(size > 0, sum(np.maximum(size + 3 - n, 0) for n in GRAMS) + 1, 0)


def gram_slices(words: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(bucket, word, valid)`` for n-grams of one size that begin in one slice, sorted by word; last the words themselves."""
    shift, factor = np.uint64(64 - (buckets - 1).bit_length()), np.uint64(FACTOR)
    size = np.fromiter(map(len, words), np.int64, len(words))
    size[size > 0] += 2
    ends = np.cumsum(size)
    starts = ends - size
    text = "".join([f"<{w}>" for w in words if w])
    whole = np.zeros(len(words), dtype=np.uint64)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first, last = np.searchsorted(ends, [at, at + len(codes) - 1], side="right")
        own = np.arange(first, last + 1)
        inside = np.minimum(ends[own], at + len(codes)) - np.maximum(starts[own], at)
        word = np.repeat(own, inside)
        here = min(SLICE, len(codes))
        mixed = (codes[:here] + np.uint64(1)) * factor + (np.arange(at, at + here) - starts[word[:here]]).astype(np.uint64) * np.uint64(PLACE)
        mixed ^= mixed >> np.uint64(29)
        new = np.flatnonzero(np.diff(word[:here], prepend=-1))
        whole[word[new]] += np.add.reduceat(mixed * np.uint64(SPREAD), new)
        h = codes
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * factor + codes[n - 1 :]
            if n in GRAMS and len(h):
                m = min(here, len(h))
                yield (((h[:m] ^ (h[:m] >> np.uint64(31))) * np.uint64(SPREAD)) >> shift).astype(np.int64), word[:m], word[:m] == word[n - 1 : n - 1 + m]
    present = np.flatnonzero(size)
    yield ((whole[present] * factor) >> shift).astype(np.int64), present, np.ones(len(present), dtype=bool)


def word_values(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of each word's n-grams; 0 for an empty word."""
    total = np.zeros(len(words))
    for bucket, word, valid in gram_slices(words, len(weights)):
        if len(word):
            new = np.flatnonzero(np.diff(word, prepend=-1))
            total[word[new]] += np.add.reduceat(np.where(valid, weights[bucket], 0.0), new)
    return total / np.maximum(gram_counts(words), 1)


def windows(n: int) -> list[tuple[int, int]]:
    """Bags of a text of ``n`` words; the last one reaches the end."""
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def bag_means(values: np.ndarray) -> np.ndarray:
    """Mean of word values over every bag."""
    n = len(values)
    if n <= WINDOW:
        return np.array([values.sum() / max(n, LEAST_WORDS)])
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return (total[starts + WINDOW] - total[starts]) / WINDOW


@dataclass
class Model:
    """Score = logistic(slope * top + shift); top is the highest bag's mean of ``weights`` plus ``bias``."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        """Score of each text. Short texts share a slice of hashing."""
        weights = self.weights.astype(np.float64)
        held: list[list[str]] = []
        size = 0

        def flush() -> Iterator[float]:
            values = word_values([w for words in held for w in words], weights)
            at = 0
            for words in held:
                margin = float(bag_means(values[at : at + len(words)]).max()) + self.bias
                at += len(words)
                yield float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60.0, 60.0))))

        for text in texts:
            held.append(fresh_words(text))
            size += len(text)
            if size >= SLICE:
                yield from flush()
                held, size = [], 0
        yield from flush()


class _Corpus:
    """Training texts as word numbers, and each word's n-gram buckets in one flat array."""

    def __init__(self, texts: Iterable[str], buckets: int):
        number: dict[str, int] = {"": 0}
        self.docs = []
        for text in texts:
            words = fresh_words(text)
            self.docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        words = list(number)
        del number
        self.size = np.maximum(gram_counts(words), 1)
        flat, kept = [], []
        for at in range(0, len(words), SLICE):  # some words at a time: the lists of all n-grams' words would be large
            own = words[at : at + SLICE]
            parts = [(bucket[valid].astype(np.int32), word[valid].astype(np.int32)) for bucket, word, valid in gram_slices(own, buckets)]
            bucket, word = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            flat.append(bucket[np.argsort(word, kind="stable")])
            kept.append(np.bincount(word, minlength=len(own)))
        self.flat, self.kept = np.concatenate(flat), np.concatenate(kept)
        self.start = np.cumsum(self.kept) - self.kept

    def document_counts(self, docs: np.ndarray, buckets: int) -> np.ndarray:
        """In how many of the documents each bucket occurs."""
        found = np.zeros(buckets, dtype=np.int64)
        for d in docs:
            words = np.unique(self.docs[d])
            found[np.unique(self.features(words)[0])] += 1
        return found

    def word_values(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.kept))
        for at in range(0, len(total), SLICE):  # some words at a time: weights of all n-grams would be large
            own = slice(at, at + SLICE)
            some = np.flatnonzero(self.kept[own]) + at
            if len(some):
                first, end = self.start[some[0]], self.start[some[-1]] + self.kept[some[-1]]
                total[some] = np.add.reduceat(weights[self.flat[first:end]].astype(np.float64), self.start[some] - first)
        return total / self.size

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of a run of words, and which word each belongs to."""
        size = self.kept[words]
        owner = np.repeat(np.arange(len(words)), size)
        first = np.repeat(self.start[words] - (np.cumsum(size) - size), size)
        return self.flat[first + np.arange(len(owner))], owner


def _top_bag(values: np.ndarray) -> tuple[int, int]:
    return windows(len(values))[int(bag_means(values).argmax())]


def _logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, drawn lightly towards slope 1 and shift 0."""
    scale = float(margin.std()) or 1.0
    x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    theta, centre = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + 0.1 * (theta - centre)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log odds of an n-gram's documents, less ``CHANCE`` standard errors."""
    expected = PRIOR * n_toxic / (n_toxic + n_clean)
    a, b = toxic + expected, clean + PRIOR - expected
    odds = np.log(a / (n_toxic + PRIOR)) - np.log(b / (n_clean + PRIOR))
    return np.sign(odds) * np.maximum(np.abs(odds) - CHANCE * np.sqrt(1 / a + 1 / b), 0.0)


def _fit_vectors(corpus: _Corpus, label: np.ndarray, fitted: np.ndarray, buckets: int, seed: int) -> tuple[np.ndarray, float]:
    """One weight for each bucket, and the bias, from vectors and softmax trained together on the documents ``fitted``."""
    rng = np.random.default_rng(seed)
    share = label[fitted].mean()
    toxic, clean = (corpus.document_counts(fitted[label[fitted] == k], buckets) for k in (1, 0))
    common = np.flatnonzero(toxic + clean >= MIN_DOCS)
    row = np.full(buckets, -1, dtype=np.int64)  # only common n-grams have a vector
    row[common] = np.arange(len(common))
    e = rng.normal(0, 0.1, (len(common), DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    seen_e, seen_w, seen_b = np.full_like(e, FLOOR), np.full_like(w, FLOOR), np.full_like(b, FLOOR)
    # start along one axis from the log odds, so the first bags picked are telling ones
    w[0] = -1.0, 1.0
    e[:, 0] += START * _log_odds(toxic[common], clean[common], *np.bincount(label[fitted], minlength=2)[::-1])
    boost = np.where(label == 1, min(4.0, (1 - share) / share), 1.0)
    batch = BATCH if len(fitted) > 4_000 else BATCH // 4
    rounds = max(EPOCHS, -(-UPDATES * batch // len(fitted)))  # few labels are gone through more often
    for epoch in range(rounds):
        weights = np.zeros(buckets)
        weights[common] = e @ (w[:, 1] - w[:, 0])
        values = corpus.word_values(weights)
        bags = []
        for d in fitted:
            words = corpus.docs[d]
            spans = windows(len(words))
            random_one = spans[rng.integers(len(spans))]
            chosen = [_top_bag(values[words])]
            if label[d] == 0:  # clean bags of every length, and empty ones
                a, z = random_one
                chosen.append((a, a + rng.integers(z - a + 1)))
            bags += [(words[a:z], int(label[d]), boost[d] / len(chosen)) for a, z in chosen]
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / rounds)
        for at in range(0, len(order), batch):
            part = [bags[i] for i in order[at : at + batch]]
            words = np.concatenate([x[0] for x in part])
            if not len(words):
                continue
            owner = np.repeat(np.arange(len(part)), [len(x[0]) for x in part])
            share_of_word = 1.0 / np.maximum([len(x[0]) for x in part], LEAST_WORDS)[owner]
            grams, word = corpus.features(words)
            known = row[grams] >= 0
            grams, word = row[grams[known]], word[known]
            factor = (share_of_word / corpus.size[words])[word].astype(np.float32)
            bag = owner[word]
            mean = np.stack([np.bincount(bag, e[grams, k] * factor, len(part)) for k in range(DIM)], axis=1)
            logits = mean @ w + b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [x[1] for x in part]] -= 1.0
            delta = p * np.array([x[2] for x in part])[:, None]
            to_mean = delta @ w.T
            grad_e = np.stack([np.bincount(grams, to_mean[bag, k] * factor, len(common)) for k in range(DIM)], axis=1).astype(np.float32)
            grad_w, grad_b = (mean.T @ delta).astype(np.float32), delta.sum(axis=0).astype(np.float32)
            for value, seen, grad in ((e, seen_e, grad_e), (w, seen_w, grad_w), (b, seen_b, grad_b)):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
    weights = np.zeros(buckets)
    weights[common] = e @ (w[:, 1] - w[:, 0])
    return weights, float(b[1] - b[0])


def train(texts: Iterable[str], labels: list[int], toxic_share: float | None = None, buckets: int = BUCKETS, seed: int = SEED) -> Model:
    """Cross-fitted model. ``toxic_share`` is the share among labels where the sample's differs."""
    label = np.array(labels, dtype=np.int64)
    share = float(label.mean()) if len(label) else 0.0
    if share in (0.0, 1.0):
        at = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(np.zeros(buckets, np.float32), 0.0, 0.0, float(at))
    corpus = _Corpus(texts, buckets)
    fold = np.empty(len(label), dtype=np.int64)
    for k in (0, 1):  # both kinds are dealt evenly
        own = np.flatnonzero(label == k)
        fold[own] = np.arange(len(own)) % FOLDS
    fitted_by = [np.flatnonzero(fold != k) for k in range(FOLDS)]
    if any(len(set(label[f])) < 2 for f in fitted_by):
        fitted_by = [np.arange(len(label))] * FOLDS
    weights, bias, margin = np.zeros(buckets), 0.0, np.zeros(len(label))
    for k, fitted in enumerate(fitted_by):
        own_weights, own_bias = _fit_vectors(corpus, label, fitted, buckets, seed + k)
        values = corpus.word_values(own_weights)
        for d in np.flatnonzero(fold == k):
            margin[d] = bag_means(values[corpus.docs[d]]).max() + own_bias
        weights += own_weights / FOLDS
        bias += own_bias / FOLDS
    known = share if toxic_share is None else toxic_share
    weight = np.where(label == 1, known / share, (1 - known) / (1 - share))
    # an empty text counts as clean rows, so that saying nothing can't look toxic
    weight = np.append(weight, EMPTY_SHARE * weight[label == 0].sum())
    slope, shift = _logistic(np.append(margin, bias), np.append(label, 0).astype(float), weight)
    return Model(weights.astype(np.float32), bias, slope, shift)


def held_out(id_column: Column) -> Column:
    """Rows that are never trained on: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """Model from a bounded sample of labelled rows outside the held-out fold.

    The sample's ids are chosen from the labels alone, so only its own texts move.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = known.withColumn("place", F.xxhash64(F.lit(SEED), "label_id"))
    chosen = [ids.where(F.col("toxic") == k).orderBy("place", "label_id").limit(n) for k, n in ((1, toxic_docs), (0, clean_docs))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most toxic_docs + clean_docs ids
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("label_id"), text.alias("text")).where(F.octet_length("text") <= TEXT_BYTES).join(sample, "label_id")
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("place", "label_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    found = found.distinct().withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_BYTES // 2)  # repeated rows are one
    # sorted, so the order of arrival changes nothing
    rows = sorted((tuple(r) for r in found.select("place", "label_id", "toxic", "text").collect()), reverse=True)
    labels_of, total = [r[2] for r in reversed(rows)], sum(counts.values())
    texts = (rows.pop()[3] for _ in labels_of)  # each text is let go once it is read
    return train(texts, labels_of, counts.get(1, 0) / total if total else None)


def scored(text: Column, model: Model) -> Column:
    """Score of a text column. Only the text reaches Python; other columns stay in the JVM."""
    sent = SparkContext.getOrCreate().broadcast(model)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(list(sent.value.scores(t.as_py() or "" for t in batch)), pa.float64())

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(each)(batches)

    return run(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents below the threshold, all columns as they were."""
    names = docs.columns
    plain = docs.toDF(*(f"in_{n}" for n in names))
    clean = plain.withColumn("score", scored(F.col(f"in_{text_col}"), model)).where(F.col("score") < THRESHOLD)
    return clean.select(*(F.col(f"in_{n}").alias(n) for n in names))
