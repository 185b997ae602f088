"""Every pipeline stage against plain Python on what the stage before kept, and the whole run."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from odd import ODD_DOCS
from tessera.llm import mixing, toxicity
from tessera.llm.common import written
from test_documents import brute_join, check_packing


def bare_lines(rows):
    """Kept text by plain Python: the rule of op6."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc_id)
    low = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=low) for k, v in holders.items() if len(v) >= 3}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i)) for i, t in rows]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def run_stages(spark, d):
    docs = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in P.STAGES:
        docs.append(written(stage(spark, docs[-1], d), name.replace(" ", "-")))
    return docs


def check(spark, d):
    docs = run_stages(spark, d)
    names = docs[0].columns
    assert all(x.columns == names and x.dtypes == docs[0].dtypes for x in docs[1:5])

    model = toxicity.fit(docs[0], spark.read.parquet(f"{d}/labels.parquet"))
    rows = docs[0].collect()
    assert Counter(docs[1].collect()) == Counter(r for r, s in zip(rows, model.scores(r.text or "" for r in rows), strict=True) if s < toxicity.THRESHOLD)

    assert Counter(rows_of(docs[2])) == Counter(bare_lines(rows_of(docs[1])))
    assert docs[2].where("text IS NOT NULL").where(F.char_length("text") != F.col("n_chars")).count() == 0

    before, kept = rows_of(docs[2]), rows_of(docs[3])
    groups = brute_join([(k, t) for k, (_, t) in enumerate(before)])
    low = lambda i: (i is None, i or 0)
    own = {}
    for k, row in enumerate(before):
        own.setdefault(groups[k][0], []).append(row)
    assert not Counter(kept) - Counter(before) and len(kept) == len(own)
    for rows in own.values():  # one of each group's rows with the smallest id
        assert any(i == min((x for x, _ in rows), key=low) and (i, t) in kept for i, t in rows)

    sizes = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs[3].collect()]
    words = Counter()
    for _, s, n in sizes:
        words[s] += n
    goal = mixing.targets(dict(words))
    mixed = Counter(docs[4].collect())
    once = Counter(docs[3].collect())
    assert all(n <= 2 * once[r] for r, n in mixed.items())
    taken = Counter()
    for r, n in mixed.items():
        taken[r.source] += n * len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for s in words:
        whole = int(goal[s] // words[s]) if words[s] else 0
        sums, budget = {0}, round(goal[s] - whole * words[s])
        for n in (n for _, x, n in sizes if x == s):
            sums |= {a + n for a in sums if a + n <= budget}
        assert taken[s] == whole * words[s] + max(sums)

    packed = docs[5].collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in packed)
    check_packing(rows_of(docs[4]), packed)
    assert sum(r.start == 0 for r in packed) == docs[4].count()
    return docs


def test_stages_on_table(spark, sf_dir):
    docs = check(spark, sf_dir)
    whole = P.run(spark, sf_dir)
    assert Counter(whole.select("doc_id", "start", "length", "ids_crc32").collect()) == Counter(docs[5].select("doc_id", "start", "length", "ids_crc32").collect())


def test_stages_on_odd_rows(spark, tables):
    check(spark, tables(documents=[(*r, "x", 1, 2) for r in ODD_DOCS], extra="score string, root int, size int"))


def test_line_stage_without_lengths(spark):
    docs = spark.createDataFrame([(1, "a line that all three of them have\nx"), (2, "a line that all three of them have"), (3, "a line that all three of them have")], "doc_id long, text string")
    assert sorted(map(tuple, P.drop_repeated_lines(spark, docs, "").collect())) == [(1, "x"), (2, ""), (3, "a line that all three of them have")]


def test_empty(spark, tables):
    assert P.run(spark, tables()).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_order(k):
    assert P.STAGES[k][0] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"][k]
