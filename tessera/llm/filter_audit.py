"""Filter interaction audit: what each filter removes in every order of applying them.

Every order is a path from the root of a permutation trie. The trie is walked depth
first: at a node the surviving rows are a persisted DataFrame, each edge below applies
one more filter to it and counts what that removes. Orders that have applied the same
filters share their survivors whatever the sequence, so a set of applied filters is
visited once and remembered: n filters have 2^n nodes instead of n! paths. Only the
nodes on the way to the current one are persisted, and they can be rebuilt from the
written table of failures if an executor is lost.

1. One pass over the texts writes a slim row for each document: id, part, a bit for
   each filter that it fails, digest of the text.
2. Repeated texts: the smallest id of each digest that several ids share, joined back.
3. The trie: per node one aggregate by part over the survivors counts all its edges;
   counts are written beside each other and nothing is gathered on the driver.
4. The orders (a constant table, n! * n rows) are joined to the counts.

Filters of ``standard_failures``: A under 200 words, B few distinct words, C many
capitals, D symbols, E the text of a smaller id. Texts are compared by SHA-256. A null
text is empty, a null part the empty string; a null id repeats nothing and has no
labels; ids that repeat don't repeat each other's texts, and several labels of an id
count as their largest. A part's rows are there for every order and step, zeros
included; an empty table gives no rows. Further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, shared_dir, text_of, written

EDGES = "part string, state int, filter int, n long, removed long, good_lost long, toxic_lost long"
REPEATED = "E"
MOST_FILTERS = 8  # 8! orders of 8 steps are some 320,000 rows a part


def standard_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure of the filters that read one document, by letter. ``words`` are its words, or one empty string."""
    return {
        "A": (F.size(words) < 200) | (text == ""),
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.char_length(text).cast("bigint") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(failures: dict[str, Column], letters: Sequence[str]) -> Column:
    bits = [F.when(failures[x], 1 << i).otherwise(0) for i, x in enumerate(letters) if x in failures]
    return sum(bits, F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, letters: Sequence[str] = "ABCDE", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", of=standard_failures) -> DataFrame:
    """``(part, fails, good, toxic)`` of every document, written: ``fails`` has bit i for the i-th letter.

    ``of`` gives the failures by letter from the text and its words; the letter ``E``, where asked for and not given, is the repeated text.
    """
    words = F.split(F.btrim(F.col("a_text"), F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    rows = docs.select(F.col(id_col).alias("a_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("a_text"))
    rows = rows.withColumn("a_words", words)
    own = of(F.col("a_text"), F.col("a_words"))
    slim = written(rows.select("a_id", "part", _mask(own, letters).alias("fails"), F.unhex(F.sha2("a_text", 256)).alias("digest")), "audit-rows")
    # written, so both sides of each join are plain shuffles, which adaptive execution splits where a text has many copies
    first = slim.groupBy("digest").agg(F.min("a_id").alias("first"), F.max("a_id").alias("last")).where("first < last")
    first = written(first.select(F.col("digest").alias("f_digest"), "first"), "audit-first")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id"))
    known = written(known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "audit-labels")
    bit = 1 << list(letters).index(REPEATED) if REPEATED in letters and REPEATED not in own else 0
    repeated = F.when(F.col("first") < F.col("a_id"), bit).otherwise(0)
    found = slim.join(first, F.col("digest") == F.col("f_digest"), "left").join(known, F.col("a_id") == F.col("l_id"), "left")
    no = F.lit(False)
    return written(found.select("part", (F.col("fails") + repeated).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "audit-failures")


def _edge_counts(survivors: DataFrame, state: int, free: list[int]) -> DataFrame:
    """What each filter still to come removes from the survivors, by part."""
    fails = {i: F.col("fails").bitwiseAND(1 << i) != 0 for i in free}
    one = [F.count(F.lit(1)).alias("n")]
    for i, f in fails.items():
        one += [F.count_if(f).alias(f"r{i}"), F.count_if(f & F.col("good")).alias(f"g{i}"), F.count_if(f & F.col("toxic")).alias(f"t{i}")]
    edge = F.explode(F.array(*(F.struct(F.lit(i).alias("filter"), F.col(f"r{i}").alias("removed"), F.col(f"g{i}").alias("good_lost"), F.col(f"t{i}").alias("toxic_lost")) for i in free)))
    rows = survivors.groupBy("part").agg(*one).select("part", F.lit(state).alias("state"), "n", edge.alias("e"))
    return rows.select("part", "state", "e.filter", "n", "e.removed", "e.good_lost", "e.toxic_lost")


def edges(rows: DataFrame, n_filters: int) -> DataFrame:
    """Counts at every edge of the trie: ``(part, state, filter, n, removed, good_lost, toxic_lost)``, ``state`` being the bits applied before."""
    folder = shared_dir(rows.sparkSession, "audit-edges")
    visited: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        free = [i for i in range(n_filters) if not state >> i & 1]
        if state in visited or not free:
            return
        visited.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _edge_counts(survivors, state, free).write.parquet(f"{folder}/state-{state}")
            for i in free:
                visit(state | 1 << i, survivors.where(F.col("fails").bitwiseAND(1 << i) == 0))
        finally:
            survivors.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema(EDGES).option("recursiveFileLookup", "true").parquet(folder)


def audit(rows: DataFrame, letters: Sequence[str] = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters, and step in it, from the table ``failures`` gives.

    ``kept`` and ``removed`` are those after and at the step; ``redundant`` fail its filter but
    went before; ``unique_fails`` fail its filter only; ``good_lost`` and ``toxic_lost`` are
    removed ones with that label; ``shapley`` is what its filter removes, summed over all orders.
    """
    n = len(letters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters, not {n}")
    found = edges(rows, n)
    orders = [("".join(letters[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step]) for order in permutations(range(n)) for step in range(n)]
    orders = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, o_state int, o_filter int")
    size = F.bit_count("state")
    paths = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)  # orders that pass an edge
    only = size == n - 1  # all other filters came before
    total = lambda when: F.sum(F.when(when, F.col("removed")).otherwise(0))
    by_filter = found.groupBy(F.col("part").alias("p_part"), F.col("filter").alias("p_filter")).agg(
        total(F.col("state") == 0).alias("failing"), total(only).alias("unique_fails"), F.sum(paths * F.col("removed")).alias("shapley")
    )
    places = by_filter.join(F.broadcast(orders), F.col("p_filter") == F.col("o_filter"))  # every part has the root's edges, so every filter
    on = (F.col("p_part") == F.col("part")) & (F.col("o_state") == F.col("state")) & (F.col("o_filter") == F.col("filter"))
    joined = places.join(found, on, "left").fillna(0, ["n", "removed", "good_lost", "toxic_lost"])
    return joined.select(
        F.col("p_part").alias("part"), "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
