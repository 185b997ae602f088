"""URL verdicts: host and path rules, and gradient-boosted trees for URLs that no rule fits.

Main path: DataFrame functions and MLlib's DataFrame API only. The trees see lexical
features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of
the host's suffix (how often it occurs among labelled URLs and how often blocked).
The labelled URLs are those that a rule decides, or the caller's. Trees are fitted on
at most ``TRAIN_ROWS`` distinct ones, those with the smallest seeded hash; suffix
statistics cover all labelled rows.

A labelled URL must not see its own label: it is shown to the trees with the suffix
statistics of the other ``FOLDS`` - 1 folds, dealt by hash of its host, and one fold is
shown as of unknown suffix, so the trees learn what the characters alone tell. A suffix
without labels has the overall share of blocked URLs.

A list of at most ``MAX_RULES`` rules is compiled into the plan. Longer lists, and rules
given as a table, are joined by host suffix and path prefix, with the same result.

Null URLs, and those without ``://``, have an empty host and path, fit no rule, and go
to the trees. Where labelled URLs are missing or all alike, the verdict is theirs, or
``allow`` without any. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, written

Rule = tuple[str, str]

TRAIN_ROWS = 20_000
MAX_RULES = 1_000  # compiled into the plan; more are joined
MAX_SUFFIXES = 10_000  # whose statistics are broadcast; more are joined with a salt
SALTS = 64
FOLDS = 5
TREES, DEPTH, SEED = 12, 4, 5
FEATURES = ("n_url", "n_host", "n_path", "n_query", "depth", "labels", "digits", "hyphens", "entropy", "params", "pairs", "marks", "secure", "suffix_n", "suffix_blocked")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return lower_ascii(_split(url, 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return _split(url, 2)


def _split(url: Column, part: int) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", part)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule, as ``struct(rule, verdict)``, or null.

    Rules are grouped by host in a literal map, so a URL looks up its own suffixes only.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(_lower(name), []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entry = lambda p, r, v: F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    table = F.create_map(*chain.from_iterable((F.lit(h), F.array(*(entry(*x) for x in xs))) for h, xs in by_host.items()))
    found = F.flatten(F.filter(F.transform(host_suffixes(host), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda x: path.startswith(x["path"]))
    return F.array_max(F.transform(fits, lambda x: F.struct(F.char_length(x["rule"]).alias("size"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))))


def _lower(name: str) -> str:
    """A-Z only, as in the URLs' hosts."""
    return "".join(c.lower() if c.isascii() else c for c in name)


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def joined_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``u_rule`` as ``matched_rule`` makes it, by joins: for a table ``(verdict, rule)`` of any length.

    Distinct (host, path) pairs meet the lengths of rule paths of each host suffix, and
    the path's prefixes of those lengths meet the rules by equality, so no list of a
    host's rules is gathered. A host with many URLs has one row of lengths; adaptive
    execution splits its side of the join. Rules without a verdict or rule are left out.
    """
    slash = F.instr("rule", "/")
    name = F.when(slash > 0, F.substr("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    table = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").select(
        lower_ascii(name).alias("r_host"), F.when(slash > 0, F.substr("rule", slash)).otherwise("").alias("r_path"), F.struct(F.char_length("rule").alias("size"), "rule", "verdict").alias("r")
    )
    table = table.groupBy("r_host", "r_path").agg(F.max("r").alias("r"))
    lengths = table.select(F.col("r_host").alias("l_host"), F.char_length("r_path").alias("l")).distinct()
    pairs = rows.select(F.col("u_host").alias("p_host"), F.col("u_path").alias("p_path")).distinct()
    tried = pairs.select("p_host", "p_path", F.explode(host_suffixes(F.col("p_host"))).alias("s")).join(lengths, F.col("s") == F.col("l_host")).where(F.char_length("p_path") >= F.col("l"))
    tried = tried.withColumn("prefix", F.substr("p_path", F.lit(1), F.col("l")))
    best = tried.join(table, (F.col("s") == F.col("r_host")) & (F.col("prefix") == F.col("r_path"))).groupBy("p_host", "p_path").agg(F.max("r").alias("u_rule"))
    return rows.join(best, (F.col("u_host") == F.col("p_host")) & (F.col("u_path") == F.col("p_path")), "left").drop("p_host", "p_path")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL's characters."""
    u = F.coalesce(url, F.lit(""))
    n = F.char_length(u)

    def count(pattern: str, c: Column = u) -> Column:
        return F.char_length(F.regexp_replace(c, f"[^{pattern}]", ""))

    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    # Shannon entropy: log2 n - sum(c log2 c) / n over the distinct characters' counts
    repeats = F.transform(F.array_distinct(F.split(u, "")), lambda ch: (n - F.char_length(F.replace(u, ch))).cast("double"))
    bits = F.aggregate(repeats, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return {
        "n_url": n,
        "n_host": F.char_length(host),
        "n_path": F.char_length(path),
        "n_query": F.char_length(query),
        "depth": count("/", path),
        "labels": F.size(F.split(host, r"\.", -1)),
        "digits": F.when(n > 0, count("0-9") / n).otherwise(0.0),
        "hyphens": count(r"\-"),
        "entropy": F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0),
        "params": F.when(query == "", 0).otherwise(count("&", query) + 1),
        "pairs": count("=", query),
        "marks": count("#"),
        "secure": F.when(u.startswith("https"), 1).otherwise(0),
    }


def _hosted(rows: DataFrame, url: Column) -> DataFrame:
    rows = rows.withColumn("u_host", host_of(url)).withColumn("u_path", path_of(url))
    return rows.withColumn("u_suffix", F.substring_index("u_host", ".", -1)).withColumn("u_fold", F.pmod(F.xxhash64(F.lit(SEED), "u_host"), F.lit(FOLDS)).cast("int"))


def _lexical(rows: DataFrame, url: Column) -> DataFrame:
    return rows.withColumns({f"u_{k}": c.cast("double") for k, c in lexical(url, F.col("u_host"), F.col("u_path")).items()})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """By suffix of labelled rows: how many and how many blocked, in all and by fold."""
    by = [F.count(F.lit(1)).alias("s_n"), F.sum("u_label").alias("s_blocked")]
    for k in range(FOLDS):
        own = F.col("u_fold") == k
        by += [F.count_if(own).alias(f"s_n{k}"), F.sum(F.when(own, F.col("u_label")).otherwise(0.0)).alias(f"s_blocked{k}")]
    found = labelled.groupBy(F.col("u_suffix").alias("s_suffix")).agg(*by)
    return found.select("s_suffix", "s_n", "s_blocked", F.array(*(f"s_n{k}" for k in range(FOLDS))).alias("s_ns"), F.array(*(f"s_blocked{k}" for k in range(FOLDS))).alias("s_blockeds"))


def with_suffix(rows: DataFrame, stats: DataFrame, share: float, small: bool, training: bool) -> DataFrame:
    """Adds ``u_suffix_n`` and ``u_suffix_blocked``; in training without the row's own fold, and nothing for the last fold."""
    if small:
        joined = rows.join(F.broadcast(stats), F.col("u_suffix") == F.col("s_suffix"), "left")
    else:
        salted = rows.withColumn("u_salt", F.pmod(F.xxhash64(F.lit(7), "u_host", "u_path"), F.lit(SALTS)).cast("int"))
        copies = stats.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, (F.col("u_suffix") == F.col("s_suffix")) & (F.col("u_salt") == F.col("s_salt")), "left").drop("u_salt", "s_salt")
    n, blocked = F.col("s_n"), F.col("s_blocked")
    if training:
        hidden = F.col("u_fold") == FOLDS - 1
        n = F.when(hidden, 0).otherwise(n - F.get("s_ns", F.col("u_fold")))
        blocked = F.when(hidden, 0.0).otherwise(blocked - F.get("s_blockeds", F.col("u_fold")))
    n, blocked = F.coalesce(n, F.lit(0)), F.coalesce(blocked, F.lit(0.0))
    found = joined.withColumns({"u_suffix_n": F.log2(n + 1.0), "u_suffix_blocked": (blocked + 2.0 * share) / (n + 2.0)})
    return found.drop("s_suffix", "s_n", "s_blocked", "s_ns", "s_blockeds")


def _kept_names(names: list[str]) -> list[str]:
    """The pages' column names; one that a result has goes with ``page_`` before it."""
    taken = {"host", "path", "rule", "verdict", "block_probability"}
    found = []
    for n in names:
        while n in taken:
            n = f"page_{n}"
        taken.add(n)
        found.append(n)
    return found


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url_col: str = "url", label_col: str | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability`` (null where a rule decides).

    ``rules`` are (verdict, rule) pairs or a table with these columns. ``label_col``
    names 0/1 labels (1: block); without it the rules' verdicts are the labels. Columns
    of the pages stay; one with a result's name is returned as ``page_`` and that name.
    """
    plain = pages.toDF(*(f"in_{n}" for n in pages.columns))
    url = F.col(f"in_{url_col}")
    rows = _hosted(plain, url)
    if isinstance(rules, DataFrame) or len(rules) > MAX_RULES:
        table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
        rows = joined_rule(rows, table)
    else:
        rows = rows.withColumn("u_rule", matched_rule(F.col("u_host"), F.col("u_path"), rules))
    rule_label = F.when(F.col("u_rule.verdict") == "block", 1.0).when(F.col("u_rule.verdict") == "allow", 0.0)
    rows = rows.withColumn("u_label", rule_label if label_col is None else F.col(f"in_{label_col}").cast("double"))
    labelled = rows.where(F.col("u_label").isNotNull()).select(url.alias("u_url"), "u_host", "u_path", "u_suffix", "u_fold", "u_label")
    stats = written(suffix_statistics(labelled), "url-suffixes")
    seen = stats.agg(F.count(F.lit(1)).alias("suffixes"), F.sum("s_n").alias("n"), F.sum("s_blocked").alias("blocked")).first()
    small, share = seen["suffixes"] <= MAX_SUFFIXES, (seen["blocked"] / seen["n"] if seen["n"] else 0.0)
    if 0.0 < share < 1.0:
        inputs = [f"u_{f}" for f in FEATURES]
        sample = labelled.distinct().withColumn("u_hash", F.xxhash64(F.lit(SEED), "u_url")).orderBy("u_hash", "u_url", "u_label").limit(train_rows)
        sample = with_suffix(_lexical(sample, F.col("u_url")), stats, share, small, training=True).select("u_label", *inputs)
        sample = written(sample, "url-sample").coalesce(1).persist()  # at most train_rows rows of numbers
        assembled = VectorAssembler(inputCols=inputs, outputCol="u_vector")
        trees = GBTClassifier(featuresCol="u_vector", labelCol="u_label", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        model = trees.fit(assembled.transform(sample)) if len(sample.select("u_label").distinct().take(2)) == 2 else None
        sample.unpersist()
    else:
        model = None
    if model is not None:
        judged = with_suffix(_lexical(rows, url), stats, share, small, training=False)
        judged = model.transform(assembled.transform(judged)).withColumn("u_block", F.get(vector_to_array("probability"), F.lit(1)))
    else:
        judged = rows.withColumn("u_block", F.lit(float(share >= 0.5)))
    verdict = F.coalesce("u_rule.verdict", F.when(F.col("u_block") >= 0.5, "block").otherwise("allow"))
    return judged.select(
        *(F.col(f"in_{n}").alias(k) for n, k in zip(pages.columns, _kept_names(pages.columns), strict=True)),
        F.col("u_host").alias("host"),
        F.col("u_path").alias("path"),
        F.col("u_rule.rule").alias("rule"),
        verdict.alias("verdict"),
        F.when(F.col("u_rule").isNull(), F.col("u_block")).alias("block_probability"),
    )
