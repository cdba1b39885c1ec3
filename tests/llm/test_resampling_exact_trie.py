"""Importance resampling, exact duplicates and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, prefix_trie, resampling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- importance resampling ----------------------------------------------------------------------------------------------


def plain_scores(docs, target, longest, buckets, percent, least_words, seed):
    """Every occurrence of every run hashed by itself."""

    def runs(text):
        words = WORD.findall((text or "").translate(LOWER))
        return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        words, found = runs(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least_words])
    can = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(can):
        r[4] = n + 1 if n < len(can) * percent // 100 else None
    return sorted((tuple(r[:4] + [r[4] if r in can else None]) for r in rows), key=repr)


def texts(rng, n):
    words = ["alpha", "Beta", "ÉTÉ", "été", "x1", "naïve", "🙂", "the", "THE", "of"] + [f"w{i}" for i in range(60)]
    some = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    return [*some, None, "", " \n.,;", "a\x00b\x7fc\x80d", "the " * 500, "same words here", "same words here"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_by_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    rng = random.Random(longest)
    docs = [(i, t) for i, t in enumerate(texts(rng, 80))] + [(None, "no id at all " * 10), (3, "an id again " * 9)]
    target = texts(rng, 10)
    how = dict(longest=longest, buckets=97, percent=25, least_words=15, seed=5)
    df = spark.createDataFrame([(t, i, {"a": i or 0}, 1) for i, t in docs], "text string, doc_id long, weight map<string,long>, gram int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_scores(docs, target, **how)
    drawn = resampling.resampled(df, goal, **how)
    assert drawn.columns == df.columns
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r["doc_id"] for r in got if r["rank"])


def test_resampling_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    got = resampling.resample(some, none, percent=100).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_scores([(1, "a b " * 20), (2, None)], [], 1, resampling.BUCKETS, 100, 20, 2024)


def test_words_of_long_texts(monkeypatch):
    """Split part by part, also where a word is longer than a part."""
    monkeypatch.setattr(resampling, "PART_BYTES", 16)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["a", "B", "é", " ", "longword" * 5, ".", "\n"], k=rng.randint(0, 40)))
        assert [w.decode() for part in resampling.split_words(text.encode()) for w in part] == WORD.findall(text.translate(LOWER))


def test_each_tuple_is_hashed_once(spark):
    """Repeats change counts, not the number of rows that are hashed."""
    rows = spark.range(40).select(F.lit(False).alias("target"), F.col("id").alias("row"), F.col("id").alias("doc_id"), F.lit("one two three " * 50).alias("text"))
    found = resampling.blocks(rows, 2)
    tables = found.filter("words is not null").collect()
    assert all(len(r["words"]) == 3 and len(r["tuples"]) == 6 for r in tables)
    assert sum(sum(r["counts"]) for r in tables) == 40 * (150 + 149)


# --- exact duplicates -----------------------------------------------------------------------------------------------------


def odd_documents():
    rows = [(i, t) for i, t in enumerate([None, "", "A", "a", "Ä", "ä", "same", "SAME", "same ", " same", "long " * 20_000, "LONG " * 20_000])]
    rows += [(100 + i, "hot text") for i in range(300)] + [(500 + i, f"own {i}") for i in range(100)]
    return [*rows, (None, "same"), (None, "nobody"), (None, "nobody"), (7, "SAME"), (105, "hot text")]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("run_rows", [3, 40, 16384])
def test_exact_duplicates_by_brute_force(spark, largest, run_rows):
    rows = odd_documents()
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    df = spark.createDataFrame([(t, {"k": 1}, i, "x") for i, t in rows], "text string, digest map<string,int>, doc_id long, kept string").repartition(7)
    got = exact_dedup.exact_duplicates(df, largest=largest, run_rows=run_rows).collect()
    want, kept = [], Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        kept[keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert sorted((repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got)) == sorted(map(repr, want))
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got if r["kept"]) == kept
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    left = exact_dedup.without_exact_duplicates(df, largest=largest, run_rows=run_rows)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest()) for r in left.collect()) == kept


def test_exact_duplicates_of_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(none).collect() == [] and exact_dedup.without_exact_duplicates(none).collect() == []


def test_a_round_meets_few_partitions(spark):
    """In a round a partition's run goes to the partitions that differ in that round's bits alone."""
    bits, n = 8, 256
    for done in range(0, bits, exact_dedup.ROUND_BITS):
        mask = ((1 << exact_dedup.ROUND_BITS) - 1) << done
        met = {(at & (n - 1 - mask)) | (bucket & mask) for bucket in range(n) for at in [37]}
        assert len(met) == exact_dedup.FAN and all((m ^ 37) & ~mask == 0 for m in met)
    assert [exact_dedup._bits_at(r, 16384) for r in (0, 1, 16384 * 8, 16384 * 8 + 1, 16384 * 1000)] == [3, 3, 3, 4, 10]


# --- the trie of conversations ----------------------------------------------------------------------------------------------


def plain_trie(sequences):
    """Nodes of a trie grown turn by turn. ``sequences``: conversation → its turns (role, text)."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children[node]), sum(n not in children or not children[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def sequences_of(rows, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    if not rebuilt:
        return own
    gone = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: own.get(c - c % 20, [])[: gone(c)] + v[gone(c) :] for c, v in own.items()}


def conversations(rng):
    rows = []
    for c in range(120):
        said = ["hello there"] if rng.random() < 0.7 else [rng.choice("ab")]
        said += [rng.choice(["yes", "no no", "", "x y z"]) for _ in range(rng.choice([0, 1, 2, 3, 6]))]
        rows += [(c, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(said)]
    rows += [(c, n, "user", f"line {n}") for c in range(200, 240) for n in range(5)]  # many alike
    rows += [(300, n, None, f"turn {n}") for n in range(400)] + [(301, n, None, f"turn {n}") for n in range(350)]  # long
    rows += [(320, None, "user", "x"), (320, None, "user", "x"), (320, 0, None, None), (320, 0, "user", None), (320, 0, "user", "b"), (None, 1, "user", "lost"), (333, 5, "user", "only")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuilt", [True, False])
@pytest.mark.parametrize("stretch", [7, 1024])
def test_trie_by_brute_force(spark, monkeypatch, rebuilt, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "IDS", 5)
    rows = conversations(random.Random(stretch))
    df = spark.createDataFrame([(*r, {"k": 1}, 0) for r in rows], "conv_id long, turn long, role string, text string, digest map<string,int>, depth int").repartition(5)
    got = prefix_trie.trie(*prefix_trie.rebuilt_turns(df)) if rebuilt else prefix_trie.prefix_trie(df)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == plain_trie(sequences_of(rows, rebuilt))


def test_trie_asks_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """Whatever counts as often asked for, rows are the same."""
    rows = conversations(random.Random(3))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_trie(sequences_of(rows, False))
    for often in (1, 20, 10**9):
        monkeypatch.setattr(prefix_trie, "OFTEN", often)
        assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr) == want


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).collect() == [] and prefix_trie.trie(*prefix_trie.rebuilt_turns(none)).collect() == []
    lost = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    # Conversation 1 has lost its one turn, if its checksum says so, and borrows from nobody.
    assert sorted((tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt_turns(lost)).collect()), key=repr) == plain_trie(sequences_of([(1, 0, "user", "x")], True))
