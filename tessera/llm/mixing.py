"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words (runs of ``[^\\x20\\x09-\\x0D]``). Documents
are counted by (source, exact size). For each source the budget beyond whole copies
is met by length counts: every length gives its proportional share of all but the last
``DP_LIMIT`` words, what rounding left is filled by longest lengths, and
bounded-knapsack dynamic programming fits the rest, exactly where a subset allows.
Which documents of a length are taken is decided by rank of a seeded hash of their id and text.

The driver holds one row for each source name, and a task one source's histogram (a
row for each distinct size); documents stay distributed, and ranks within a length
are counted by slices of the hash range, so a length shared by much of a source
isn't gathered. Null sources form one source, the last; null texts have size 0 and
are never needed. Rows that repeat an id are documents of their own. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, bucket_count, ranked, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
DP_LIMIT = 1 << 16


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words by source: shares by weight, capped at ``most`` times the source, the excess shared again by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    left, free, found = share * sum(sizes.values()), list(names), dict.fromkeys(names, 0.0)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > cap[s]]
        if not above:
            found |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            found[s] = cap[s]
        left -= sum(cap[s] for s in above)
        free = [s for s in free if s not in set(above)]
    return found


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Copies of each length, within its count, whose sum is as near below the budget as any."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return taken
    first = np.full(budget + 1, -1, dtype=np.int32)
    reach = np.zeros(budget + 1, dtype=bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        rest, step = int(min(counts[i], budget // lengths[i])) if lengths[i] else 0, 1
        while rest > 0 and not reach[budget]:
            n = min(step, rest)
            w = n * int(lengths[i])
            if w > budget:
                break
            new = reach[: budget + 1 - w] & ~reach[w:]
            first[w:][new] = len(items)
            reach[w:] |= new
            items.append((int(i), n))
            rest, step = rest - n, step * 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = items[first[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = DP_LIMIT) -> np.ndarray:
    """Documents to take of each length for a budget of words."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    shared = max(0, budget - limit)  # the rest is left to the knapsack, which needs room to fit exactly
    taken = np.array([int(n) * shared // total for n in counts], dtype=np.int64)  # Python integers: the product may pass 64 bits
    rest = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= limit:
            break
        if lengths[i]:
            n = min(int(counts[i] - taken[i]), -(-(rest - limit) // int(lengths[i])), rest // int(lengths[i]))
            taken[i] += n
            rest -= n * int(lengths[i])
    return taken + knapsack(lengths, counts - taken, rest)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    lengths, counts = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
    whole = min(int(MOST), int(target // total)) if total else 0
    extra = fit_budget(lengths, counts, int(round(target - whole * total))) if total else counts * 0
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "whole": whole, "extra": extra})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 13, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``(doc_id, source, text_key, size, source_size, target, copies)``, one row per input row."""
    text = text_of(text_col)
    sizes = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(text).alias("text_key"),
            word_count(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text)).alias("order"),
        ),
        "mix-sizes",
    )
    histogram = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    words = {r["source"]: r["words"] for r in by_source}
    goal = targets(words, weights, share)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, words[s], goal[s]) for s in words], "goal_source string, source_size long, target double")
    with_goal = histogram.join(plan, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    fitted = with_goal.groupBy("source").applyInPandas(_fit, "source string, size long, whole long, extra long")
    per_length = fitted.join(plan, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        F.col("source").alias("l_source"), F.col("size").alias("l_size"), "whole", "extra", "source_size", "target"
    )
    places = ranked(sizes, ["source", "size"], "order", bucket_count(sum(r["rows"] for r in by_source)))
    on = F.col("source").eqNullSafe(F.col("l_source")) & (F.col("size") == F.col("l_size"))
    copies = F.col("whole") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    return places.join(per_length, on).select("doc_id", "source", "text_key", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The documents, each as many times as the mix takes it."""
    names = docs.columns
    rows = docs.toDF(*(f"in_{n}" for n in names)).withColumn("m_text", F.xxhash64(text_of(f"in_{text_col}")))
    own = Window.partitionBy(f"in_{id_col}", "m_text", f"in_{source_col}").orderBy(F.lit(1))
    rows = rows.withColumn("m_row", F.row_number().over(own) - 1)
    # rows that are alike in all three keys share an entry; each takes its own element
    plan = mix(docs, id_col, text_col, source_col, **options).groupBy("doc_id", "text_key", "source").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    on = F.col(f"in_{id_col}").eqNullSafe(F.col("doc_id")) & (F.col("m_text") == F.col("text_key")) & F.col(f"in_{source_col}").eqNullSafe(F.col("source"))
    taken = rows.join(plan, on).withColumn("m_copies", F.get("copies", F.col("m_row"))).where(F.col("m_copies") > 0)
    return taken.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select(*(F.col(f"in_{n}").alias(n) for n in names))
