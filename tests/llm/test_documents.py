"""Document operators against plain Python, on the test tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import LONG, ODD_DOCS
from tessera.llm import exact_dedup, line_dedup, media, mixing, ngram_join, packing, tokens, toxicity
from tessera.llm import queries as Q

SPACE = " \t\n\x0b\x0c\r"


def docs_of(spark, d):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


@pytest.fixture
def odd(tables):
    return tables(documents=[(*r, "x", 1) for r in ODD_DOCS], extra="score string, size int")


@pytest.fixture
def empty(tables):
    return tables()


NAMES = [n for n in Q.QUERIES if n.split("_")[0] in ("op2", "op4", "op5", "op6", "op7", "op8", "op10")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


# op2


def brute_exact(rows):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append(i)
    out = []
    for b, members in groups.items():
        rank = lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0)
        first = min(members, key=rank)
        for i in members:
            out.append((rows[i][0], rows[first][0], len(members), hashlib.sha256(b.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_takes_ids_of_any_64_bits(spark, tables):
    least = -(1 << 63)
    d = tables(documents=[(i, "same text", "en", "s", 1) for i in (least, 5, (1 << 63) - 1)])
    assert {(r.doc_id, r.keep_id) for r in Q.QUERIES["op2_exact_dedup"](spark, d).collect()} == {(i, least) for i in (least, 5, (1 << 63) - 1)}


def test_exact_dedup_odd(spark, odd):
    got = Q.QUERIES["op2_exact_dedup"](spark, odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(docs_of(spark, odd))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})  # one row of repeated ones too


def test_exact_dedup_over_batches_and_reruns(spark, sf_dir, tmp_path):
    rows = docs_of(spark, sf_dir)
    at = str(tmp_path / "docs")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id % 3 > 0").repartition(3).write.parquet(at)
    folder = f"file://{tmp_path}/state"
    first = exact_dedup.dedup(spark, at, files_per_batch=1, folder=folder).count()
    docs.where("doc_id % 3 = 0").repartition(2).write.mode("append").parquet(at)
    got = exact_dedup.dedup(spark, at, files_per_batch=1, folder=folder).collect()  # state goes on from the first run
    assert first < len(got)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == brute_exact(rows)


def test_exact_dedup_state_reserves_no_disk(spark, sf_dir):
    """State takes disk by its rows, not some MB for each partition."""
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    found = lambda: {p: p.stat().st_blocks * 512 for p in Path(local).rglob("MANIFEST-*")}
    made = {}
    for _ in range(3):  # Spark may delete the folders of ended streams at any time
        before = found()
        exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet").count()
        made = {p: n for p, n in found().items() if p not in before}
        if made:
            break
    assert made and max(made.values()) < 1 << 20


def test_exact_dedup_survives_collisions(spark, sf_dir):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)  # noqa: E731  sixteen digests for all texts
    got = exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet", digest=weak).collect()
    want = brute_exact(docs_of(spark, sf_dir))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter({k[:3]: n for k, n in want.items()})


# op4


def check_packing(rows, got, size=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = {(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc_id]}
        at = 0
        for start, length, crc, total in sorted(own):
            assert start == at and total == len(ids)
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length, r.padded_to))
    for row in places.values():
        at = 0
        for offset, length, _ in sorted(row):
            assert offset == at
            at += length
        assert at <= size and {p for *_, p in row} == {at if at & (at - 1) == 0 else size}
    return sum(r.length for r in got) / sum(max(p for *_, p in row) for row in places.values())


def test_packing(spark, sf_dir):
    assert check_packing(docs_of(spark, sf_dir), Q.QUERIES["op4_packing"](spark, sf_dir).collect()) > 0.9


def test_packing_odd(spark, odd):
    got = Q.QUERIES["op4_packing"](spark, odd).collect()
    check_packing(docs_of(spark, odd), got)
    assert sum(r.start == 0 for r in got) == len(ODD_DOCS)


def test_packing_returns_ids(spark):
    docs = spark.createDataFrame([(1, "some words to encode " * 30)], "doc_id long, text string")
    parts = packing.pack_documents(docs, tokens.default_tokenizer(), size=64).collect()
    ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(parts, key=lambda p: p.start)])
    from tokenizers import Tokenizer

    assert ids.tolist() == [*Tokenizer.from_file(tokens.default_tokenizer()).encode("some words to encode " * 30, add_special_tokens=False).ids, 0]


def test_histogram_packing_places_every_piece():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in enumerate(rng.integers(0, 50, 101)) if n and c}
    patterns = packing.pack_histogram(histogram, 100)
    used = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += count
    assert used == histogram


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>", "naïve Ærø ſ", "日本語 🙂", "x" * 3000, "don't I'LL", "\x85\u2028 \u00a0z", "1234,5 %%% &&&", "Éa̐ ⅷ"]
    slow = Tokenizer.from_file(path)
    assert tokens.load_encoder(path)(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]


# op5


def test_toxicity_learns_and_keeps_the_fold_apart(spark, tables):
    rng = np.random.default_rng(3)
    stems = ["idiot", "moron", "scum", "loser"]
    syllables = ["ta", "re", "on", "el", "vi", "su", "ke", "ma", "no", "ri"]
    docs, labels = [], []
    for i in range(1500):
        words = ["".join(rng.choice(syllables, 3)) for _ in range(int(rng.integers(5, 300)))]
        bad = bool(rng.random() < 0.25)
        if bad:
            for at in rng.integers(0, len(words), 3):
                words[at] = str(rng.choice(stems)) + str(rng.choice(syllables))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs += [(9001, "ta re on " * 2000 + "what an idiotel and moronvi scumma " + "el vi su " * 2000, "en", "s", 1), (9002, "", "en", "s", 1), (9003, None, "en", "s", 1), (None, "idiotvi idiotvi", "en", "s", 1)]
    d = tables(documents=docs, labels=labels)
    got = {r.doc_id: r for r in Q.QUERIES["op5_toxicity"](spark, d).collect()}
    truth = {i: t for i, _, t in labels}
    folds = {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out and i in truth} == folds
    right = np.mean([got[i].predicted == truth[i] for i in folds])
    assert right > 0.95
    assert got[9001].predicted == 1  # a passage deep in a long text
    assert got[9002].predicted == got[9003].predicted == 0 and got[9002].score == got[9003].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # labels of the held-out fold change nothing
    d = tables(documents=docs, labels=[(i, q, 1 - t if i in folds else t) for i, q, t in labels])
    again = {r.doc_id: r.score for r in Q.QUERIES["op5_toxicity"](spark, d).collect()}
    assert again == {i: r.score for i, r in got.items()}


@pytest.mark.parametrize(("sf", "recall", "precision"), [("sf0.01", 0.6, 0.7), ("sf0.1", 0.65, 0.9)])
def test_toxicity_on_the_held_out_fold(spark, sf, recall, precision):
    """Fitted as the query fits it, judged on the fold that training never sees."""
    d = f"/root/testdata/{sf}"
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    texts = {i: t or "" for i, t in docs_of(spark, d) if i in truth}
    called = {i for i, s in zip(texts, model.scores(texts.values()), strict=True) if s >= toxicity.THRESHOLD}
    toxic = {i for i in texts if truth[i]}
    assert len(called & toxic) >= recall * len(toxic) and len(called & toxic) >= precision * len(called)
    assert next(model.scores([""])) < toxicity.THRESHOLD


def brute_word(word, weights):
    """Mean weight of the n-grams, each hashed on its own."""
    low, shift = (1 << 64) - 1, 64 - (len(weights) - 1).bit_length()
    codes = [ord(c) for c in f"<{word}>"]
    found = []
    for n in toxicity.GRAMS:
        for at in range(len(codes) - n + 1):
            h = codes[at]
            for c in codes[at + 1 : at + n]:
                h = (h * toxicity.FACTOR + c) & low
            found.append(((h ^ (h >> 31)) * toxicity.SPREAD & low) >> shift)
    whole = 0
    for i, c in enumerate(codes):
        h = ((c + 1) * toxicity.FACTOR + i * toxicity.PLACE) & low
        whole += (h ^ (h >> 29)) * toxicity.SPREAD
    found.append((whole & low) * toxicity.FACTOR % (1 << 64) >> shift)
    return float(np.mean([weights[g] for g in found]))


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_word_values_match_single_ngrams(monkeypatch, size):
    monkeypatch.setattr(toxicity, "SLICE", size)
    weights = np.random.default_rng(6).normal(size=1 << 10)
    words = ["a", "", "bc", "x" * 300, "naïve", "", "日本語🙂", "z", "\ud800a"]
    got = toxicity.word_values(words, weights)
    assert got == pytest.approx([brute_word(w, weights) if w else 0.0 for w in words])
    assert toxicity.gram_counts(words).tolist() == [len(w) and sum(max(0, len(w) + 3 - n) for n in (3, 4, 5)) + 1 for w in words]


def test_texts_without_spaces_leave_no_memory():
    """A text of one word is hashed by slices: nothing of it stays, and its score doesn't depend on its neighbours."""
    model = toxicity.Model(np.random.default_rng(7).normal(size=1 << 12).astype(np.float32), 0.0, 1.0, 0.0)
    texts = ["".join(map(str, range(k, k + 40_000))) for k in range(4)] + ["", "two words"]
    assert list(model.scores(texts)) == pytest.approx([next(model.scores([t])) for t in texts])


def test_toxicity_without_labels(spark, odd):
    got = Q.QUERIES["op5_toxicity"](spark, odd).collect()
    assert len(got) == len(ODD_DOCS) and {r.predicted for r in got} == {0}


def test_keep_clean_keeps_columns(spark, tables):
    model = toxicity.Model(np.zeros(16, np.float32), 0.0, 0.0, -9.0)
    docs = spark.read.parquet(tables(documents=[(*r, "x", 1) for r in ODD_DOCS], extra="score string, size int") + "/documents.parquet")
    assert Counter(toxicity.keep_clean(docs, model).collect()) == Counter(docs.collect())


# op6


def brute_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    low = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=low) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("which", "heavy", "most"), [("odd", 10_000, 10_000), ("hot", 10_000, 10_000), ("hot", 20, 10_000), ("hot", 20, 0)])
def test_lines(spark, tables, monkeypatch, which, heavy, most):
    monkeypatch.setattr(line_dedup, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(line_dedup, "MAX_HEAVY", most)
    rows = ODD_DOCS
    if which == "hot":  # one line in every document, so common that it goes the second way
        rows = [(i, f"A line that every document has\nown line number {i} and more words\nA line that every document has\nshared by some {i % 40} of them all\nx", "en", "s", 1) for i in range(300)]
    d = tables(documents=rows)
    got = Q.QUERIES["op6_line_dedup"](spark, d).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines([r[:2] for r in rows])


def test_lines_keep_other_columns(spark, tables):
    docs = spark.read.parquet(tables(documents=[(*r, 1, 2, "k") for r in ODD_DOCS], extra="pos int, tail int, keep_runs string") + "/documents.parquet")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts[1] == "short" and texts[2] == "other words here" and texts[3] == "\tA first line that is long enough" and texts[5] is None


# op7


def brute_media(rows):
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        out.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    return Counter(out)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_media(spark, sf_dir, odd, which):
    d = sf_dir if which == "table" else odd
    rows = docs_of(spark, d)
    got = Q.QUERIES["op7_media"](spark, d).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == brute_media(rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def brute_feature(payload):
    from collections import Counter
    from math import log2, sqrt

    n, counts = len(payload), Counter(payload)
    mean = sum(payload) / n
    spread = sqrt(sum(c * (b - mean) ** 2 for b, c in counts.items()) / n)
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    change = sum(abs(payload[i + 576] - payload[i]) for i in range(n - 576)) / n
    return 576, n // 576, mean, spread, entropy, change


def test_media_feature_matches_plain_python(spark, odd, sf_dir):
    for d in (odd, sf_dir):
        texts = {hashlib.sha256(media.padded((t or "").encode())).hexdigest(): media.padded((t or "").encode()) for _, t in docs_of(spark, d)}
        for r in Q.QUERIES["op7_media"](spark, d).dropDuplicates(["payload_sha256"]).collect():
            width, height, *numbers = map(float, re.fullmatch(r"(\d+)x(\d+);mean=(.*);spread=(.*);entropy=(.*);change=(.*)", r.feature).groups())
            assert (width, height, *numbers) == pytest.approx(brute_feature(texts[r.payload_sha256]), abs=1e-4)


def test_media_ranges_and_damage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"file://{tmp_path}/media"
    media.write_archives(docs.coalesce(1), folder, archive_bytes=60_000)
    archives = sorted((tmp_path / "media").glob("*.zip"))
    assert len(archives) > 1
    found = media.read_archives(spark, folder, rangeBytes=7_000, batchBytes=5_000)
    assert found.rdd.getNumPartitions() > len(archives)
    assert found.where("error IS NULL").count() == docs.count()
    data = bytearray(archives[0].read_bytes())
    at = data.index(b"IDAT")
    data[at + 8] ^= 255
    archives[0].write_bytes(data)
    assert found.where("error IS NOT NULL").count() == 1 and found.where("error IS NULL").count() == docs.count() - 1


# op8


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mix(spark, sf_dir, odd, which):
    d = sf_dir if which == "table" else odd
    table = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in table.collect()]
    words = Counter()
    for _, s, n in rows:
        words[s] += n
    goal = mixing.targets(dict(words))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(words.values()))
    assert all(goal[s] <= 2 * words[s] + 1e-6 for s in words)
    got = Q.QUERIES["op8_source_mix"](spark, d).collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in got) == sorted((str(i), n, words[s], round(goal[s], 6)) for i, s, n in rows)
    assert all(r.taken <= 2 * r["size"] for r in got)
    owner = {i: s for i, s, _ in rows}
    taken = Counter()
    for r in got:
        taken[owner[r.doc_id]] += r.taken
    for s in words:  # whole copies, then the best sum of single documents
        whole = int(goal[s] // words[s]) if words[s] else 0
        budget = round(goal[s] - whole * words[s])
        sums = {0}
        for n in (n for _, x, n in rows if x == s):
            sums |= {a + n for a in sums if a + n <= budget}
        assert taken[s] == whole * words[s] + max(sums), s
    again = Q.QUERIES["op8_source_mix"](spark, d).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, "c": 100, None: 0}) == pytest.approx({"a": 200.0, "b": 166.667, "c": 83.333, None: 0.0}, abs=1e-2)


def test_knapsack_reaches_the_best_sum():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 120))
        taken = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        assert (taken <= counts).all() and (taken * lengths).sum() == max(s for s in sums if s <= budget)


def test_budget_beyond_the_table_limit():
    lengths, counts = np.array([100, 37, 3]), np.array([5000, 4000, 10])
    taken = mixing.fit_budget(lengths, counts, 400_001, limit=5_000)
    assert (taken <= counts).all() and (taken * lengths).sum() == 400_001


def test_mixed_documents_repeat_rows(spark, tables):
    docs = spark.read.parquet(tables(documents=[(*r, 1, 2) for r in ODD_DOCS], extra="copies int, size int") + "/documents.parquet")
    plan = mixing.mix(docs).collect()
    want = sum(r.copies for r in plan)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.count() == want
    per_id = Counter()
    for r in plan:
        per_id[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in per_id.items() if v})


# op10


def brute_join(rows, threshold=(4, 5)):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").split()
        sets[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    parent, links = {i: i for i in ids}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both * threshold[1] >= threshold[0] * (len(sets[a]) + len(sets[b]) - both) > 0:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in ids}


@pytest.mark.parametrize(("block", "block_bytes"), [(512, 1 << 20), (9, 1 << 20), (100, 2_000)])
def test_join_matches_brute_force(spark, tables, monkeypatch, block, block_bytes):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [[word() for _ in range(int(rng.integers(3, 120)))] for _ in range(30)]
    texts = []
    for k, words in enumerate(base):
        texts.append(" ".join(words))
        for _ in range(40 if k == 0 else int(rng.integers(0, 5))):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 6))):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += ["", " ", None, "a b", "a b", "a  b", "b a"]
    order = rng.permutation(len(texts))
    rows = [(int(i) * 3, texts[p], "en", "s", 1) for i, p in enumerate(order)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in Q.QUERIES["op10_ngram_join"](spark, tables(documents=rows)).collect()}
    assert got == brute_join([r[:2] for r in rows])


def test_join_on_table(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    got = {r.doc_id: (r.class_id, r.n_links) for r in Q.QUERIES["op10_ngram_join"](spark, sf_dir).collect()}
    assert got == brute_join(rows)


def test_join_odd(spark, odd):
    got = Q.QUERIES["op10_ngram_join"](spark, odd).collect()
    assert len(got) == len(ODD_DOCS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].class_id == by_id[7].class_id == 6 and by_id[4].class_id == by_id[9].class_id == 4
    assert by_id[8].n_links == 1 and by_id[None].class_id is None and by_id[10].n_links == 0


A, B, C = ("one two three four five six seven eight nine ten " + x for x in ("eleven", "twelve thirteen fourteen fifteen sixteen", "eleven"))
UNLIKE = "quite another text that shares no run of words with those above"
REPEATED = [(1, A), (1, UNLIKE), (2, C), (3, B), (3, UNLIKE + " at all"), (1, A), (4, A + " extra"), (None, A), (None, "lone text without id"), (None, "lone text without id"), (5, None), (6, "")]


def brute_rows(rows):
    """Class and links of each row, rows compared and not ids."""
    low = lambda i: (i is None, i or 0)
    found = brute_join([(k, t) for k, (_, t) in enumerate(rows)])
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[found[k][0]].append(i)
    return [(rows[k][0], min(ids[found[k][0]], key=low), found[k][1]) for k in range(len(rows))], [found[k][0] for k in range(len(rows))]


def test_join_takes_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string")
    want, groups = brute_rows(REPEATED)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(docs.repartition(5)).collect()) == Counter(want)
    for _ in range(2):
        kept = [(r.doc_id, r.text or "") for r in ngram_join.keep_one(docs.repartition(3)).collect()]
        assert len(kept) == len(set(groups))
        low = lambda r: (r[0] is None, r[0] or 0)
        for g in set(groups):
            own = [(i, t or "") for (i, t), x in zip(REPEATED, groups, strict=True) if x == g]
            assert sum((r in own) for r in kept) == 1 and any(r in own and low(r) == min(map(low, own)) for r in kept)


def test_join_of_one_group_with_half_the_rows(spark, tmp_path, monkeypatch):
    """Links are right, and what is shuffled grows with the rows, not with the group's square."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    words = [f"w{k}" for k in range(120)]

    def rows(n):
        rng, found = np.random.default_rng(n), []
        for k in range(n):
            own = list(words) if k % 2 else [f"x{k}_{j}" for j in range(120)]
            own[int(rng.integers(120))] = f"y{k}"
            found.append((k, " ".join(own)))
        return found

    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows(300), "doc_id long, text string")).collect()}
    assert got == brute_join(rows(300)) and got[1][1] > 100
    shuffled = []
    for n in (400, 1_200):
        last = max(shuffle_bytes(spark), default=-1)
        ngram_join.join(spark.createDataFrame(rows(n), "doc_id long, text string")).write.mode("overwrite").format("noop").save()
        shuffled.append(sum(size for stage, size in shuffle_bytes(spark).items() if stage > last))
    assert 0 < shuffled[0] and 0 < shuffled[1] < 1.3 * 3 * shuffled[0]


def shuffle_bytes(spark):
    """Bytes by stage, of those that the status store still holds: it drops old ones."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_long_words_are_not_remembered():
    shingler = ngram_join.Shingler()
    shingler.shingles(" ".join([*("z" * 70 + str(k) for k in range(50)), "short"]))
    assert list(shingler.words) == ["short"]


def test_keep_one(spark, tables):
    docs = spark.read.parquet(tables(documents=[(*r, 1, "k") for r in ODD_DOCS], extra="class_id int, root string") + "/documents.parquet")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 8, None, 10]))


def test_pruning_limits_hold_the_tolerance():
    from math import comb

    for n, least in ngram_join.least_matches():
        mass = lambda m: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))  # noqa: B023, E731
        assert mass(least) >= ngram_join.TOLERANCE and (least == 0 or mass(least - 1) < ngram_join.TOLERANCE)


def test_long_text_is_read_to_the_end(spark, tables):
    d = tables(documents=[(1, LONG + "end one", "de", "s", 1), (2, LONG + "end two", "de", "s", 1)])
    assert len({r.payload_sha256 for r in Q.QUERIES["op7_media"](spark, d).collect()}) == 2
    assert len({r.kept_sha256 for r in Q.QUERIES["op6_line_dedup"](spark, d).collect()}) == 2
    assert {r.group_size for r in Q.QUERIES["op2_exact_dedup"](spark, d).collect()} == {1}


def test_archives_share_partitions_beyond_the_limit(spark, tmp_path, monkeypatch):
    """The plan has at most ``MAX_RANGES`` partitions, however many archives there are, and reads every member once."""
    docs = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(60)], "doc_id long, text string").repartition(11)
    media.write_archives(docs, f"file://{tmp_path}/media")
    monkeypatch.setattr(media, "MAX_RANGES", 3)
    plan = media.ArchiveReader({"path": f"file://{tmp_path}/media"}).partitions()
    assert len(plan) == 3 and sum(len(p.ranges) for p in plan) == 11
    rows = media.measured(media.read_archives(spark, f"file://{tmp_path}/media"))
    assert rows.rdd.getNumPartitions() <= 3 and sorted(r.doc_id for r in rows.collect()) == list(range(60))


def test_mix_picks_the_same_text_of_rows_that_repeat_an_id(spark):
    rows = [(1, f"word{k} " * 5, "s") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    picked = [sorted((r.text, r.doc_id) for r in mixing.mixed_documents(docs.repartition(n), share=0.5).collect()) for n in (1, 7)]
    assert picked[0] == picked[1] and 0 < len(picked[0]) < 40


def test_pieces_are_read_once_a_tile(spark, monkeypatch):
    """Every pair of a group's pieces once; a piece is read for each tile of its group, not for each piece."""
    reads = {}
    for n in (24, 96):
        pieces = spark.createDataFrame([(1, f"p{k:03d}", 10, 12) for k in range(n)] + [(2, "alone", 10, 12), (3, "small", 10, 12), (3, "large", 90, 99)], "root long, piece string, small long, large long")
        pairs = ngram_join.piece_pairs(pieces, 0.8).collect()
        assert sorted(tuple(sorted((r.p, r.q))) for r in pairs) == [(f"p{a:03d}", f"p{b:03d}") for a in range(n) for b in range(a + 1, n)]
        tiles = defaultdict(set)
        for r in pairs:
            tiles[r.root, r.low, r.high] |= {r.p, r.q}
        reads[n] = sum(map(len, tiles.values()))
        assert reads[n] <= 2 * n * (n / ngram_join.PIECES + 1), (n, reads[n])
    assert reads[96] < 96 * 96 / 2  # a read for each pair would be that many, and one more for each piece


def test_texts_without_hits_are_not_shuffled(spark, tmp_path):
    """What op2 shuffles follows the copies and not the table."""
    text = " ".join(f"word{k}" for k in range(2_000))
    rows = [(k, f"{text} {k if k > 20 else 0}") for k in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d.parquet")
    last = max(shuffle_bytes(spark), default=-1)
    assert exact_dedup.dedup(spark, f"{tmp_path}/d.parquet").where("not kept").count() == 20
    moved = sum(size for stage, size in shuffle_bytes(spark).items() if stage > last)
    assert 0 < moved < 800 * len(text) / 20  # 21 texts twice, and rows of digests
