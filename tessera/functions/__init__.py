"""Column expressions of the weighting scheme. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Saturation constants of the term-frequency formula.
TF_BIAS = 0.5
TF_LENGTH = 1.5

#: Delimiters between features and image id; the narrow set leaves out the tab.
DELIMITERS_WIDE = r"[ \t%]+"
DELIMITERS_NARROW = r"[ %]+"
#: Delimiters inside a feature list.
FEATURE_DELIMITERS = r"[ :,]+"


def tokens(line: Column, delimiters: str) -> Column:
    """Tokens between runs of delimiters, without empty ones."""
    return F.filter(F.split(line, delimiters), lambda x: x != "")


def saturated_tf(value: Column, doc_length: Column, avg_length: Column) -> Column:
    """Length-normalised, saturated term frequency, narrowed to 32 bits.

    The narrowing is observable in every weight, so it is part of the formula.
    """
    ratio = doc_length.cast("double") / avg_length
    return (value / (value + F.lit(TF_BIAS) + F.lit(TF_LENGTH) * ratio)).cast("float")


def normalised_idf(n_images: Column, df: Column) -> Column:
    """``ln((N + 0.5) / df) / ln(N + 1)``."""
    n = n_images.cast("double")
    return F.log((n + F.lit(0.5)) / df.cast("double")) / F.log(n + F.lit(1.0))


def split_ids(ids: Column) -> Column:
    """Members of a pool: split at single spaces; inner empty strings stay, trailing ones go."""
    return F.split(F.rtrim(ids), " ")


def rounded(column: str, digits: int = 6) -> Column:
    """A float as the queries return it; adding zero turns -0.0 into 0.0."""
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(column)
