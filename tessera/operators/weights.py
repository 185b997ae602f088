"""Corpus statistics and weights of observations ``(image_id, feature_id, value)``.

Contract: (image_id, feature_id) is unique, unless observations tell the lines of an
image apart by ``line_id``: then each line is a document of its own in the statistics, in
lengths and in frequencies, while an image's vector is that of all its lines. Non-positive
values count in a document's length and give no weight.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normalised_idf, saturated_tf
from tessera.operators.dealing import dealt, tasks_for

#: Rows of (feature, frequency) that may be broadcast: some tens of megabytes.
BROADCAST_FEATURES = 1_000_000
#: Holds wherever there is a weight. Every use of the statistics states it, so all read the same columns and one computation serves them.
_ALL_STATS = "n_positive > 0 AND n_images > 0 AND adl > 0"


class Extent(NamedTuple):
    """Counted sizes that plans are chosen by; bounds from above."""

    features: int
    most_images: int  # of a feature
    most_features: int  # of an image
    rows: int = 0


def extent_of(rows: DataFrame, feature: str = "feature_id", image: str = "image_id") -> Extent:
    """One job: rows by feature and by image, counted before they are shuffled."""
    n = F.count(F.lit(1)).alias("n")
    by_feature = rows.where(F.col(feature).isNotNull()).groupBy(feature).agg(n).agg(F.count(F.lit(1)).alias("features"), F.max("n").alias("most_images"))
    by_image = rows.where(F.col(image).isNotNull()).groupBy(image).agg(n).agg(F.max("n").alias("most_features"), F.sum("n").alias("n_rows"))
    found = by_feature.crossJoin(by_image).first()  # one row and one row
    return Extent(found.features, found.most_images or 0, found.most_features or 0, found.n_rows or 0)


def vocabulary_of(rows: DataFrame, feature: str = "feature_id") -> int:
    """About how many features there are: one column read, no shuffle of rows. Six standard errors are added, so it errs upwards."""
    return int(rows.agg(F.approx_count_distinct(feature, 0.05)).first()[0] * 1.3) + 1


def unit_of(obs: DataFrame) -> list[str]:
    """What one document of the corpus is: an image, or a line of it."""
    return ["image_id", "line_id"] if "line_id" in obs.columns else ["image_id"]


def doc_lengths(obs: DataFrame) -> DataFrame:
    """``(image_id[, line_id], dl)``: features per document, whatever their value."""
    return obs.groupBy(*unit_of(obs)).agg(F.count(F.lit(1)).alias("dl"))


def corpus_stats(obs: DataFrame) -> DataFrame:
    """One row ``(n_images, adl, n_positive)``: images (or their lines), their average length, and observations that can have a weight."""
    by_image = obs.groupBy(*unit_of(obs)).agg(F.count(F.lit(1)).alias("dl"), F.count_if(F.col("value") > 0).alias("positive"))
    return by_image.agg(F.count(F.lit(1)).alias("n_images"), F.avg("dl").alias("adl"), F.sum("positive").alias("n_positive"))


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Attaches the corpus scalars. ``stats`` is a global aggregate, so one row is all that is broadcast."""
    return rows.crossJoin(F.broadcast(stats))


def tf_weights(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """``(image_id, feature_id, tf)`` of positive values."""
    dl = F.count(F.lit(1)).over(Window.partitionBy(*unit_of(obs)))
    rows = with_stats(obs.withColumn("dl", dl).where(F.col("value") > 0), stats).where(_ALL_STATS)
    return rows.select("image_id", "feature_id", saturated_tf(F.col("value"), F.col("dl"), F.col("adl")).alias("tf"))


def idf_values(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """``(feature_id, df, idf)``."""
    df = tf.groupBy("feature_id").agg(F.count(F.lit(1)).alias("df"))
    return with_stats(df, stats).where(_ALL_STATS).select("feature_id", "df", normalised_idf(F.col("n_images"), F.col("df")).alias("idf"))


def tfidf_weights(tf: DataFrame, idf: DataFrame, vocabulary: int | None = None, n_rows: int = 0) -> DataFrame:
    """``(image_id, feature_id, w[, df])``.

    ``vocabulary`` is the counted number of features, where it is known: up to
    ``BROADCAST_FEATURES`` frequencies are broadcast, so rows dealt by image stay so and
    norms need no further shuffle. Unknown or larger ones are joined by a shuffle, to more
    tasks where the number of rows is known to be large.
    """
    shuffled = vocabulary is None or vocabulary > BROADCAST_FEATURES
    many = shuffled and tasks_for(tf, n_rows) > tasks_for(tf, 0)
    frequencies = idf.select("feature_id", "idf", *(["df"] if "df" in idf.columns else []))
    if not shuffled:
        frequencies = F.broadcast(frequencies)
    rows = (dealt(tf, n_rows, "feature_id") if many else tf).join(frequencies, "feature_id")
    rows = dealt(rows, n_rows, "image_id") if many else rows
    return rows.select("image_id", "feature_id", (F.col("tf").cast("double") * F.col("idf")).alias("w"), *(["df"] if "df" in idf.columns else []))


def l2_norms(weights: DataFrame) -> DataFrame:
    """``(image_id, norm, n_features)`` over all of an image's weights."""
    return weights.groupBy("image_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count(F.lit(1)).alias("n_features"))


def inverted_list(weights: DataFrame) -> DataFrame:
    """``(feature_id, image_id, w, w_norm, n_features[, df])`` of positive weights, in long form.

    The norm covers all weights of the image and precedes every threshold; so does the
    number of its features.
    """
    own = Window.partitionBy("image_id")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))
    rows = weights.withColumns({"norm": norm, "n_features": F.count(F.lit(1)).over(own)}).where(F.col("w") > 0)
    return rows.select("feature_id", "image_id", "w", (F.col("w") / F.col("norm")).alias("w_norm"), "n_features", *(["df"] if "df" in weights.columns else []))


def weights_of(obs: DataFrame, vocabulary: int | None = None, n_rows: int = 0) -> DataFrame:
    """Weights straight from observations.

    Frequencies are counted from the observations that get a weight, which are the rows of
    the term frequencies, so they needn't wait for the statistics.
    """
    stats = corpus_stats(obs)
    return tfidf_weights(tf_weights(obs, stats), idf_values(obs.where(F.col("value") > 0), stats), vocabulary, n_rows)


def postings_of(obs: DataFrame, vocabulary: int | None = None, n_rows: int = 0) -> DataFrame:
    """Postings straight from observations."""
    return inverted_list(weights_of(obs, vocabulary, n_rows))


def image_vectors(weights: DataFrame) -> DataFrame:
    """Nested view: one row per image with its vector, sorted by feature. The array is as long as the image's own features."""
    return weights.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "w"))).alias("vector"))
