"""Products of all pairs in posting lists, summed by pair.

1. A feature's postings are one sorted list, or, in a feature of more than ``BLOCK`` images,
   several blocks by the image's hash: no row holds a long list, and no task makes a
   frequent feature's pairs alone. Blocks of one feature meet by (feature, block, block).
2. An image of a list goes to the task that sums its pairs together with the list's rest
   beyond it: codes and weights as two arrays. A contribution so costs a code and a weight
   in the shuffle; the first image's code and its weight are sent once for the rest.
3. There the rest is multiplied out and summed, with no further shuffle. An image of more
   than ``WIDE`` features is dealt over several tasks by the hash of its partner.

Postings need ``df`` and ``n_features`` for that, upper bounds of a list's and a vector's
length; ``with_sizes`` adds them where they are missing. Where the counted ``Extent`` of the
data shows that no list and no vector is that long, the plan has neither step; its rows are
the same.

Where it shows that vectors are short (``FEW``), nearly all pairs share one feature only, and
their sum is that one product. A posting then carries a signature of its image's other
features, and pairs whose signatures have no bit in common are done where they meet; only
the rest is shuffled to be summed (``meetings``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dealing import dealt
from tessera.operators.ids import TEXT, Text
from tessera.operators.weights import Extent

BLOCK = 1_024
WIDE = 10_000
FEW = 64
#: Words of a signature of an image's features.
WORDS = 4


def with_sizes(postings: DataFrame) -> DataFrame:
    """Postings with ``df`` and ``n_features``, counted where they aren't known."""
    if "df" not in postings.columns:
        postings = postings.join(postings.groupBy("feature_id").agg(F.count(F.lit(1)).alias("df")), "feature_id")
    if "n_features" not in postings.columns:
        postings = postings.join(postings.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_features")), "image_id")
    return postings


def _heavy(extent: Extent | None) -> bool:
    return extent is None or extent.most_images > BLOCK


def _wide(extent: Extent | None) -> bool:
    return extent is None or extent.most_features > WIDE


def _arrays(level: bool) -> list[str]:
    return ["codes", "weights", *(["levels"] if level else [])]


def posting_blocks(rows: DataFrame, keys: Sequence[str], ids: Text, level: bool, extent: Extent | None) -> DataFrame:
    """``(*keys, block, blocks, codes, weights[, levels][, parts])``: lists in order of image, in blocks."""
    heavy, wide = _heavy(extent), _wide(extent)
    rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "image_id")))  # nulls share nothing
    rows = ids.coded(with_sizes(rows) if heavy or wide else rows)
    blocks = F.ceil(F.col("df") / BLOCK).cast("int") if heavy else F.lit(1)
    block = F.when(blocks <= 1, 0).otherwise(F.pmod(F.xxhash64("image_id"), blocks).cast("int"))
    parts = [F.ceil(F.col("n_features") / WIDE).cast("int").alias("parts")] if wide else []
    entry = F.struct("image_id", "code", "w_norm", *(["level"] if level else []), *parts)
    if not heavy:
        lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    else:
        lists = rows.withColumns({"block": block, "blocks": blocks}).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.max("blocks").alias("blocks"))
    more = {"levels": "level", "parts": "parts"}
    own = [F.col(f"e.{more[c]}").alias(c) for c in ("levels", "parts") if (level if c == "levels" else wide)]
    return lists.select(*keys, *(["block", "blocks"] if heavy else []), F.col("e.code").alias("codes"), F.col("e.w_norm").alias("weights"), *own)


def _first(of: str, level: bool, wide: bool) -> list[Column]:
    """What the image at place ``i`` of a list brings to its pairs."""
    at = lambda c: F.get(f"{of}{c}", F.col("i"))
    return [F.col("a"), at("weights").alias("wa"), *([at("levels").alias("la")] if level else []), *([at("parts").alias("k")] if wide else [])]


def _within(lists: DataFrame, level: bool, wide: bool) -> DataFrame:
    """Each image of a list with the images after it."""
    arrays = _arrays(level)
    rows = lists.select(F.posexplode("codes").alias("i", "a"), *arrays, *(["parts"] if wide else []))
    return rows.where(F.col("i") < F.size("codes") - 1).select(*_first("", level, wide), *(F.slice(c, F.col("i") + 2, F.size(c)).alias(c) for c in arrays))


def _across(lists: DataFrame, keys: Sequence[str], ids: Text, level: bool, wide: bool) -> DataFrame:
    """Each image of a block with the images after it in the feature's other blocks."""
    arrays = _arrays(level)
    many = lists.where("blocks > 1")
    block = F.struct(*arrays, *(["parts"] if wide else []))
    low = many.where("block < blocks - 1").select(*keys, F.col("block").alias("x"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("y"), block.alias("p"))
    high = many.where("block > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("x"), F.col("block").alias("y"), block.alias("q"))
    met = low.join(high, [*keys, "x", "y"])
    turn = lambda one, other: F.struct(F.col(one).alias("one"), F.col(other).alias("other"))
    both = met.select(F.explode(F.array(turn("p", "q"), turn("q", "p"))).alias("z")).select(F.posexplode("z.one.codes").alias("i", "a"), F.col("z.one").alias("one"), *(F.col(f"z.other.{c}").alias(c) for c in arrays))
    # lists are sorted, so what comes after an image is the end of the other list
    both = both.withColumn("skip", F.size(F.filter("codes", lambda b: ~ids.before(F.col("a"), b)))).where(F.col("skip") < F.size("codes"))
    return both.select(*_first("one.", level, wide), *(F.slice(c, F.col("skip") + 1, F.size(c)).alias(c) for c in arrays))


def contributions(postings: DataFrame, keys: Sequence[str] = ("feature_id",), ids: Text = TEXT, level: bool = False, extent: Extent | None = None, same: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows ``(a, b, c[, part][, level])``, products by pair of codes, a before b; and the names of the pair's key, by which they are dealt.

    With ``level`` postings have a level, and a pair's is the lower of its two. Repeats of an
    image in a list count each; with ``same`` they also make pairs of the image with itself.
    """
    wide = _wide(extent)
    lists = posting_blocks(postings, keys, ids, level, extent)
    if _heavy(extent):
        lists = lists.where("blocks > 0")  # always; both uses so read the same columns, and share one exchange
        rows = _within(lists, level, wide).unionByName(_across(lists, keys, ids, level, wide))
    else:
        rows = _within(lists, level, wide)
    arrays, first, key = _arrays(level), ["a", "wa", *(["la"] if level else [])], ["a"]
    if wide:
        key = ["a", "part"]
        # the whole list's codes go by another name: inside the lambda, "codes" would be the column made beside it
        rows = rows.select(*first, "k", *arrays, F.col("codes").alias("every"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
        mine = lambda c: F.filter(c, lambda _, i: F.pmod(F.xxhash64(F.get("every", i)), F.col("k")) == F.col("part"))
        rows = rows.select(*first, "part", *(F.when(F.col("k") <= 1, F.col(c)).otherwise(mine(c)).alias(c) for c in arrays))
    # a number of partitions, so that none are merged for their few bytes: each byte becomes many rows there
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    pairs = rows.select(*first, *key[1:], *arrays[1:], F.posexplode("codes").alias("j", "b"))
    pairs = pairs if same else pairs.where("a != b")
    lower = [F.least("la", F.get("levels", F.col("j"))).alias("level")] if level else []
    return pairs.select(*key, "b", (F.col("wa") * F.get("weights", F.col("j"))).alias("c"), *lower), [*key, "b"]


def few(extent: Extent | None) -> bool:
    """Whether no vector is long, so that pairs seldom share two features."""
    return extent is not None and extent.most_features <= FEW


def with_others(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``s0`` and so on, the bits of the image's other rows, and ``again``, whether one of them has this row's bit."""
    place = F.pmod(F.xxhash64(*keys), F.lit(64 * WORDS)).cast("int")
    rows = rows.withColumn("place", place)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % 64)
    words = [F.when(F.floor(F.col("place") / 64) == k, bit).otherwise(F.lit(0).cast("bigint")) for k in range(WORDS)]
    image = Window.partitionBy("image_id")
    rows = rows.withColumns({f"s{k}": F.bit_or(w).over(image).bitwiseXOR(w) for k, w in enumerate(words)})
    # after the image's bits: rows dealt by image are also together by image and place
    return rows.withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("image_id", "place")) > 1).drop("place")


def meetings(postings: DataFrame, keys: Sequence[str] = ("feature_id",), ids: Text = TEXT, level: bool = False, extent: Extent | None = None, same: bool = False) -> DataFrame:
    """Rows ``(a, b, c, more[, level])``, as of ``contributions``, where lists or blocks meet.

    Without ``more`` the two images share nothing else, and ``c`` is their sum.
    """
    heavy, signature = _heavy(extent), [f"s{k}" for k in range(WORDS)]
    rows = postings.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "image_id")))
    rows = with_others(ids.coded(with_sizes(rows) if heavy else rows), keys)
    columns = ["code", "w_norm", *(["level"] if level else []), "again", *signature]
    names = [*keys]
    if heavy:
        blocks = F.ceil(F.col("df") / BLOCK).cast("int")
        rows = rows.withColumns({"blocks": blocks, "block": F.when(blocks <= 1, 0).otherwise(F.pmod(F.xxhash64("image_id"), blocks).cast("int"))})
        names += ["block"]
    ordered = lambda e: F.struct(ids.order(e["code"]).alias("order"), *(e[c].alias(c) for c in columns))
    e = F.array_sort(F.transform(F.collect_list(F.struct(*columns)), ordered)).alias("e")
    lists = dealt(rows.select(*names, *(["blocks"] if heavy else []), *columns), extent.rows if extent else 0, *names, fixed=True)
    lists = lists.groupBy(*names).agg(e, *([F.max("blocks").alias("blocks")] if heavy else []))
    arrays = (["order"] if heavy else []) + columns
    lists = lists.select(*names, *(["blocks"] if heavy else []), *(F.col(f"e.{c}").alias(c) for c in arrays))
    if heavy:
        lists = lists.where("blocks > 0")  # always; both uses so read the same columns, and share one exchange
    own = lists.select(*columns, *(F.col(c).alias(f"other_{c}") for c in columns))
    pairs = _met(own, columns).where("i < j").drop("i", "j")
    if heavy:
        many = lists.where("blocks > 1")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        low = many.select(*keys, F.col("block").alias("x"), every.alias("y"), *arrays).where("x < y")
        high = many.select(*keys, every.alias("x"), F.col("block").alias("y"), *(F.col(c).alias(f"other_{c}") for c in arrays)).where("x < y")
        met = _met(low.join(high, [*keys, "x", "y"]), arrays)
        first = F.col("a_order") < F.col("b_order")
        turned = {"a_code": F.when(first, F.col("a_code")).otherwise(F.col("b_code")), "b_code": F.when(first, F.col("b_code")).otherwise(F.col("a_code"))}
        pairs = pairs.unionByName(met.withColumns(turned).drop("i", "j", "a_order", "b_order"))
    pairs = pairs if same else pairs.where("a_code != b_code")
    more = reduce(lambda x, y: x | y, (F.col(f"a_{s}").bitwiseAND(F.col(f"b_{s}")) != 0 for s in signature), F.col("a_again") | F.col("b_again"))
    lower = [F.least("a_level", "b_level").alias("level")] if level else []
    return pairs.select(F.col("a_code").alias("a"), F.col("b_code").alias("b"), (F.col("a_w_norm") * F.col("b_w_norm")).alias("c"), more.alias("more"), *lower)


def _met(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each place of the arrays ``columns`` with each of the arrays ``other_``."""
    others = [f"other_{c}" for c in columns]
    rows = rows.select(F.posexplode("code").alias("i", "a_code"), *(c for c in columns if c != "code"), *others)
    rows = rows.select("i", "a_code", *(F.get(c, F.col("i")).alias(f"a_{c}") for c in columns if c != "code"), *others)
    left = [c for c in rows.columns if not c.startswith("other_")]
    rows = rows.select(*left, *(o for o in others if o != "other_code"), F.posexplode("other_code").alias("j", "b_code"))
    return rows.select(*left, "j", "b_code", *(F.get(f"other_{c}", F.col("j")).alias(f"b_{c}") for c in columns if c != "code"))


def pair_sums(postings: DataFrame, keys: Sequence[str] = ("feature_id",), ids: Text = TEXT, extent: Extent | None = None, same: bool = False, above: float | None = None) -> DataFrame:
    """``(image_a, image_b, similarity)``: sums over what two images share; optionally only those above a threshold."""
    if few(extent):
        met = meetings(postings, keys, ids, extent=extent, same=same)
        once = met.where("NOT more").select("a", "b", F.col("c").alias("similarity"))
        sums = once.unionByName(met.where("more").groupBy("a", "b").agg(F.sum("c").alias("similarity")))
    else:
        rows, key = contributions(postings, keys, ids, extent=extent, same=same)
        sums = rows.groupBy(*key).agg(F.sum("c").alias("similarity"))
    return ids.restored(sums if above is None else sums.where(F.col("similarity") > above), "similarity")
