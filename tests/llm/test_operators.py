"""The corpus operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import boosting, chat_format, fingerprints, language_id, licenses, metric_search, mixing, near_dedup, packing, personal_data, queries, secrets, shared

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", " \n\t", "one", "Hello, wörld! don't ### x.", LONG, "same text here for all of us", "same text here for all of us", "🙂 ΣΑΣ ﬁ é", "12 34 5678 9012 3456 7890"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 0, "x", "y", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without an id", None, None, None, None, None, None), rows[4]]
    # Columns that operators might use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, lang_pred string, size int")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# --- every operator on odd rows and on none -------------------------------------------------------------------------

OPERATORS = {
    "secrets": lambda d: secrets.scan_secrets(d, VOCABULARY),
    "redact": lambda d: secrets.redact_secrets(d, VOCABULARY),
    "language": lambda d: language_id.predict(d, language_id.train(d)),
    "in_a_language": lambda d: language_id.in_a_language(d, language_id.train(d)),
    "personal": personal_data.find_personal_data,
    "fingerprints": fingerprints.fingerprint_edits,
    "mix": lambda d: mixing.mix(d)[0],
    "mixed": mixing.mixed_documents,
    "pack": lambda d: packing.pack(d, WORDS, window=64),
    "near": near_dedup.near_duplicates,
    "deduplicated": near_dedup.without_near_duplicates,
    "licenses": licenses.scan_licenses,
}
ONE_EACH = ("secrets", "redact", "language", "personal", "fingerprints", "mix", "near", "licenses")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []
    rows = OPERATORS[name](docs).collect()
    if name in ONE_EACH:
        assert len(rows) == len(TEXTS) + 2


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_secrets():
    e = secrets._encoding(VOCABULARY)
    find = lambda t: [(k, t[a:b]) for k, a, b in secrets.find_secrets(t, e)]
    assert find('a PASSWORD = "abc12345" b') == [("assign", 'PASSWORD = "abc12345')]
    assert find("password=short") == []
    assert find("AKIAABCDEFGHIJKL AKIAABC") == [("access", "AKIAABCDEFGHIJKL")]
    assert find("x 0123456789abcdef0123456789abcdef") == [("hex", "0123456789abcdef0123456789abcdef")]
    assert find("key zX9q4LmP2vRt8WnB5kYc here") == [("dense", "zX9q4LmP2vRt8WnB5kYc")]
    assert find("paſſword=abcdefgh1") == []  # letters in either case are ASCII letters
    for known in ("550e8400-e29b-41d4-a716-446655440000", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "internationalization", "getUserAccountByIdentifier2", "1234567890123456", "2024-01-01-2024-02-02"):
        assert find(f"see {known} there") == [], known


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_random_strings_of_any_alphabet(alphabet):
    """The ratio alone decides on random strings; most are found."""
    rng, e = random.Random(8), secrets._encoding(VOCABULARY)
    keys = ["".join(rng.choices(alphabet, k=rng.randint(20, 40))) for _ in range(400)]
    dense = [len(k) / len(e.encode_ordinary(k)) <= secrets.MOST_PER_TOKEN for k in keys]
    found = [bool(secrets.find_secrets(k, e)) for k in keys]
    assert found == dense and sum(found) > 0.8 * len(keys)


def plain_secrets(text, e):
    """The contract's patterns one by one, and a scanner that looks at each string of the dense alphabet that no base span covers."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        found += [("assign", m.start(), m.end())] if len(m[2]) >= 8 else []
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    taken, start = {i for _, a, b in found for i in range(a, b)}, None
    for i in range(len(text) + 1):
        inside = i < len(text) and i not in taken and (text[i].isascii() and text[i].isalnum() or text[i] in "+/_=-")
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            found += [("dense", start + a, start + b) for a, b in plain_random(text[start:i], e)]
            start = None
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex", "dense"].index(x[0])))


def plain_tokens(s, e):
    return [len(e.decode_single_token_bytes(t)) for k in range(0, len(s), 1024) for t in e.encode_ordinary(s[k : k + 1024])]


def plain_dense(s, e):
    return len(s) >= 16 and any(c.isalnum() for c in s) and len(s) / len(plain_tokens(s, e)) <= 2.0 and not plain_name(s, e)


def plain_windows(s, e):
    """Every window of whole tokens, no longer than need be, looked at by itself; the characters that they cover."""
    sizes, covered = plain_tokens(s, e), []
    starts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    for i in range(len(sizes)):
        j = next((j for j in range(i, len(sizes) + 1) if starts[j] - starts[i] >= 16), None)
        if j is not None and (starts[j] - starts[i]) / (j - i) <= 1.6:
            if covered and starts[i] <= covered[-1][1]:
                covered[-1][1] = starts[j]
            else:
                covered.append([starts[i], starts[j]])
    return [(a, b) for a, b in covered if not plain_name(s[a:b], e)]


def plain_random(s, e):
    if len(s) < 16:
        return []
    for a, b in itertools.combinations(range(len(s) + 1), 2):
        if b - a in (32, 36, 40, 56, 64, 96, 128) and not (a and s[a - 1].isalnum()) and not (b < len(s) and s[b].isalnum()) and plain_digest(s[a:b]):
            return plain_random(s[:a], e) + [(b + x, b + y) for x, y in plain_random(s[b:], e)]
    if plain_dense(s, e):
        return [(0, len(s))]
    parts = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", s)]
    word = lambda p: p[0].isalpha() and (len(plain_tokens(p, e)) == 1 or len(p) > 2.0 * len(plain_tokens(p, e)) and plain_name(p, e))
    within = lambda a, b: [(a + x, a + y) for x, y in plain_windows(s[a:b], e)] if b - a > 16 else []
    found = []
    for is_word, group in itertools.groupby(parts, key=lambda p: word(s[p[0] : p[1]])):
        group = list(group)
        a, b = group[0][0], group[-1][1]
        if is_word:
            found += [x for p in group for x in within(*p)]
        elif b - a >= 16 and plain_dense(s[a:b], e):
            found.append((a, b))
        elif b - a >= 16 and not plain_name(s[a:b], e):
            found += [x for p in group for x in ([p] if plain_dense(s[p[0] : p[1]], e) else within(*p))]
    return found


def plain_digest(s):
    return bool(re.fullmatch("[0-9a-fA-F]+", s) and len(s) in (32, 40, 56, 64, 96, 128) or re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))


def plain_name(s, e):
    if plain_digest(s):
        return True
    if not any(c.isalpha() for c in s):
        return True
    for m in re.finditer("[0-9]+", s):
        if len(m[0]) > 4 or m.start() == 0 or not s[m.start() - 1].isalpha():
            return False
    words = re.findall("[A-Z]?[a-z]+|[A-Z]+", s)
    return sum(map(len, words)) >= 3 * len(words) and sum(map(len, words)) > 2.0 * sum(len(e.encode_ordinary(w)) for w in words)


def test_secrets_by_brute_force(spark, corpus):
    rng = random.Random(12)
    bits = ["token", "API_key", "=", ": ", '"', " ", "\n", "é", "AKIA", "Z9Q4", "deadbeef", "0123456789abcdef", "zX9q4LmP2vRt8WnB", "someOtherName", "user_id", "-", "/", "12", "20240131", ".", "word", "TLS"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(1500)] + [r["text"] for r in corpus.select("text").collect()] + [None, ""]
    e = secrets._encoding(VOCABULARY)
    got = by_id(secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY), "spans")
    want = {i: plain_secrets(t or "", e) for i, t in enumerate(texts)}
    assert {i: [tuple(x) for x in s] for i, s in got.items()} == want
    assert {k for s in want.values() for k, _, _ in s} == set(secrets.KINDS)


@pytest.mark.parametrize("before", ["https://hooks.example.com/services/production/notifications/messages/{}", "GET /api/v1/customers/accounts/transactions/{}", "config-option-name-for-production-{}", "user_access_credential_{}", "/download/{}/reports/january", "prefixproductionnotification{}", "token=abcdefgh1234&callback/{}"])
def test_keys_behind_readable_text(before):
    """A key is found by its own tokens, whatever readable text stands beside it in one run."""
    rng, e = random.Random(3), secrets._encoding(VOCABULARY)
    hits = 0
    for _ in range(300):
        key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=24))
        text = before.format(key)
        at = text.index(key)
        hits += any(k == "dense" and min(b, at + 24) - max(a, at) >= 16 for k, a, b in secrets.find_secrets(text, e))
    assert hits > 0.95 * 300


def test_readable_paths_are_no_secrets():
    e = secrets._encoding(VOCABULARY)
    for text in ("https://docs.example.com/en/latest/getting-started/installation/requirements", "src/main/java/org/example/project/configuration/ApplicationConfiguration", "users/550e8400-e29b-41d4-a716-446655440000/settings", "releases/2024-01-31/notes", "getUserAccountByIdentifierAndPasswordReset", "/home/user/documents/photos/2023/summer/image_0042"):
        assert secrets.find_secrets(text, e) == [], text


def test_secrets_in_long_strings():
    """Each takes a time in proportion to its length, or would not end."""
    e = secrets._encoding(VOCABULARY)
    for text in ("q" * 40 + "12345", "x" * 1000 + "12345", "k9" * 20 + " token=abcdefgh12 " * 500):
        assert secrets.find_secrets(text, e) == plain_secrets(text, e), text[:50]
    for text, kinds in (("x" * 10_000 + "12345", []), ("aB3" * 200_000, ["dense"]), ("1-" * 200_000, []), ("secret" + " " * 50_000, []), ("f" * 500_000, ["hex"]), ("/word" * 100_000, []), ("production" * 50_000, [])):
        assert [k for k, _, _ in secrets.find_secrets(text, e)] == kinds, text[:50]


def test_secret_columns(spark):
    text = "é🙂 secret:abcdefgh1 and AKIAABCDEFGHIJKLMN"
    r = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), VOCABULARY).select("doc_id", *secrets.span_columns(secrets.KINDS, secrets.BASE)).first()
    spans = "assign:3:19,access:24:42"
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (1, 1, 0, spans)
    assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_redaction(spark):
    d = spark.createDataFrame([(1, "a token=abcdefgh12 b"), (2, "clean")], "doc_id long, text string")
    assert by_id(secrets.redact_secrets(d, VOCABULARY), "text") == {1: "a [SECRET] b", 2: "clean"}


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).round(2)
    vectors[100:180] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [float("nan")] * 8), (1003, [None] * 8), (None, [0.0] * 8), (1050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in metric_search.top_k(df, F.col("vec_id") % 50 == 0, in_tree=64, in_block=4).collect()}
    q = np.floor(vectors * 256).astype(int)
    want = {}
    for i in range(0, 300, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want


def test_top_k_of_repeated_ids(spark):
    """Every other row is a candidate, also one of the query's own id; queries that share an id are each answered."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [0.5, 0.5]), (9, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in metric_search.top_k(df, F.col("vec_id") % 50 == 0, in_tree=3, in_block=1).collect())
    want = []
    for q in rows[:2]:
        scored = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q[1], v)), n) for n, v in rows if v is not q[1])[:5]
        want += [(0, k + 1, n, -s) for k, (s, n) in enumerate(scored)]
    assert got == sorted(want)


def test_large_components_stay_exact():
    vectors = np.asarray([[2**30, 1], [2**30, 2], [2**30 - 1, 3], [-5, 7]], np.int64)
    for tree_of, query in ((vectors, vectors[0]), (vectors >> 12, vectors[1])):
        scores = sorted(((-int(s), j) for j, s in enumerate(tree_of @ query)))[:3]
        assert metric_search.MTree(np.arange(4), tree_of, page=2).search(query, 3) == [(-s, j) for s, j in scores]


def test_tree_skips_pages():
    """On clustered vectors the stored distances save most of the work, and the result stays exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 500
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    tree = metric_search.MTree(np.arange(4000), vectors, page=64)
    for i in (0, 7, 1999):
        scores = vectors @ vectors[i]
        want = sorted(((-int(s), j) for j, s in enumerate(scores) if j != i))[:5]
        assert tree.search(vectors[i], 5, i) == [(-s, j) for s, j in want]


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_language_accuracy(corpus):
    trees = language_id.train(corpus.filter(~language_id.held_out()))
    found = language_id.predict(corpus, trees, keep=("doc_id", "lang", "text")).filter(language_id.held_out()).collect()
    assert len(found) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_code_lengths(corpus):
    """The compiled tables give every byte of every language the cost that a walk down its contexts gives it."""
    pdf = language_id.gram_counts(corpus.limit(40)).toPandas()
    trees = language_id.ByteTrees.compiled(pdf)
    assert len(trees.langs) > 1
    texts = ["the and of zq", "Größe über alles, niño! où êtes-vous", "漢字 🙂 \x00\xff", "a", "", corpus.first()["text"][:3000], "\n\n\n zzzzzzz"]
    for k, lang in enumerate(trees.langs):
        counts: dict = {}
        for r in pdf[pdf.lang == lang].itertuples():
            g = bytes((r.gram >> s) & 255 for s in (24, 16, 8, 0))
            for n in range(4):
                d = counts.setdefault(g[3 - n : 3], {})
                d[g[3]] = d.get(g[3], 0) + r.n

        def p(context, c):
            if context is None:
                return 1 / 256
            shorter, d = context[1:] if context else None, counts.get(context)
            if not d:
                return p(shorter, c)
            n, kinds = sum(d.values()), len(d)
            return d[c] / (n + kinds) if c in d else kinds / (n + kinds) * p(shorter, c)

        for text in texts:
            data = language_id._bytes(text).tobytes()
            want = -sum(np.log2(p(data[i - 3 : i], data[i])) for i in range(3, len(data)))
            assert trees.bits(text)[0][k] == pytest.approx(want, rel=1e-4)


def test_undetermined(spark, corpus):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and"), (5, "½ ² ① 12 _")], "doc_id long, text string")
    assert by_id(language_id.predict(d, language_id.train(corpus)), "lang_pred") == {1: "und", 2: "und", 3: "und", 4: "en", 5: "und"}
    assert {k: v for k, v in by_id(language_id.predict(d, None), "lang_pred", "score").items()} == dict.fromkeys((1, 2, 3, 4, 5), ("und", 0.0))


def test_texts_in_no_language_go(spark):
    """Clean documents stay, whatever their length; other languages, other scripts and noise go."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language_id.train(corpus)
    assert language_id.in_a_language(corpus, trees).count() >= 0.995 * corpus.count()
    foreign = ["Wczoraj poszedłem do sklepu i kupiłem chleb oraz mleko dla dzieci, a potem wróciłem do domu", "漢字仮名交じり文です" * 5, "вчера я ходил в магазин и купил хлеб", "xkq zvbw qpwj kkzx vvqz jwxz qqkx " * 4, "0x3f;;;{{#if}} <div class='x'>$(document).ready()</div>", "1234 5678", "", None]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(foreign)], "doc_id long, text string, lang_pred int")
    assert language_id.in_a_language(rows, trees).collect() == []
    assert language_id.in_a_language(corpus, None).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def cheapest(roles):
    """All repairs of a short conversation, tried one by one."""
    if not roles:
        return 0
    best = 99
    for new in itertools.product((1, 2, 3), repeat=len(roles)):
        cost = sum(chat_format.RELABEL for r, n in zip(roles, new) if r != chat_format.ROLES[n - 1])
        for merged in itertools.product((False, True), repeat=len(roles)):
            state, total = 0, cost
            for n, m in zip(new, merged):
                if m:
                    total += chat_format.MERGE if n == state else 99
                else:
                    total += chat_format.INSERT * len(chat_format._BETWEEN[state, n]) if (state, n) in chat_format._BETWEEN else 99
                state = n
            best = min(best, total + chat_format.INSERT * len(chat_format._CLOSING[state]))
    return best


@pytest.mark.parametrize("n", range(1, 5))
def test_repairs_are_cheapest(n):
    for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
        assert chat_format.ends(chat_format.matrix(roles))[1] == cheapest(roles), roles


def test_chunks_change_nothing(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a", "", None])) for c in range(6) for t in range(rng.choice([1, 3, 40]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    one = sorted(map(repr, chat_format.repair(df).collect()))
    assert len(one) == len(rows)
    costs = {}
    for chunk in (3, 5, chat_format.CHUNK):
        got = chat_format.repair(df, chunk=chunk).collect()
        for r in got:
            k = (chunk, r["conv_id"])
            costs[k] = costs.get(k, 0) + chat_format.MERGE * ("merge" in r["action"]) + chat_format.RELABEL * ("relabel" in r["action"]) + chat_format.INSERT * len(r["inserted"])
        text = {c: "".join(r["piece"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["turn"])) for c in range(6)}
        for t in text.values():
            opened = re.findall(r"<\|(system|user|assistant)\|>", t)
            turns = opened[1:] if opened[0] == "system" else opened
            assert turns == ["user", "assistant"] * (len(turns) // 2) and turns
            assert t.count("<|end|>") == len(opened)
        for c, t in text.items():
            # Empty turns behind the last one are seen in the text alone.
            shown = t.count("<|end|>") - sum(len(r["inserted"]) + ("merge" not in r["action"]) for r in got if r["conv_id"] == c)
            costs[chunk, c] += chat_format.INSERT * shown
    for c in range(6):
        roles = tuple(r[2] for r in rows if r[0] == c)
        least = cheapest(roles) if len(roles) < 4 else chat_format.ends(chat_format.matrix(roles))[1]
        assert {costs[k, c] for k in (3, 5, chat_format.CHUNK)} == {least}


def test_odd_conversations(spark):
    """Null ids and turns, repeated rows, unknown roles; every row gets its own, and the whole is legal."""
    rows = [(None, 1, "user", "a"), (None, None, None, None), (None, 0, "tool", "b"), (5, None, "assistant", "x"), (5, None, "assistant", "x"), (5, 2, "user", ""), (6, 1, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("state", F.lit("s"))
    for chunk in (1, 2, 512):
        got = chat_format.repair(df, chunk=chunk).collect()
        assert sorted(map(repr, ((r["conv_id"], r["turn"], r["role"]) for r in got))) == sorted(repr(r[:3]) for r in rows)
        assert [r["new_role"] for r in got if r["conv_id"] is None and r["turn"] == 0] == ["user"] or len(got) == len(rows)
        for c in (None, 5, 6):
            own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: (r["turn"] is None, r["turn"] or 0))
            opened = re.findall(r"<\|(system|user|assistant)\|>", "".join(r["piece"] for r in own))
            assert sorted(opened[opened[0] == "system" :]) == sorted(["user", "assistant"] * ((len(opened) - (opened[0] == "system")) // 2))


def test_no_conversations(spark):
    assert chat_format.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# --- 5 ---------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else 2 * x % 10 + 2 * x // 10 for i, x in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_base(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "%d@e.f", "x.y@z", "@", ".", "+", "-", " ", "1", "256", "10.0.0.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 555-0000", "5", "é", "🙂", "word", "001.2.3.4", "4111111111111111"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)] + ["1.2.3.4 " * 1500]
    without = ["a" * 50_000 + "@", "1" * 50_000]  # plain patterns would take their square
    df = spark.createDataFrame(list(enumerate(texts + without)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"] if x["kind"] in PLAIN] for r in personal_data.find_personal_data(df).collect()}
    assert got[len(texts)] == got[len(texts) + 1] == []
    for i, t in enumerate(texts):
        order = {k: n for n, k in enumerate(PLAIN)}
        assert sorted(got[i], key=lambda s: (order[s[0]], s[1])) == base_spans(t), t[:200]


def test_personal_data_added(spark):
    """What the strict patterns miss is found by format and context; look-alikes are left alone; nothing overlaps."""
    rng = random.Random(21)
    digits = lambda f: "".join(rng.choice("0123456789") if c == "#" else rng.choice("abcdefghij") if c == "?" else c for c in f)
    personal = ["phone (###) ###-#### today", "reach us: ###-###-####.", "mobile ##########", "write to ????? (at) ?????.com now", "SSN ###-##-####", "Tel. 0### / ######", "x ###-###-#### / ###-###-####"]
    other = ["on 2021-05-17 at", "ISBN 978-3-16-148410-#", "order ##########", "total 1 250 300", "version 1.2.10.2021a", "see pages 1990 - 1999", "id ################ end", "a @mention of it", "plain words only"]
    rows = [(i, digits(f)) for i, f in enumerate(personal * 40)] + [(1000 + i, digits(f)) for i, f in enumerate(other * 40)]
    got = by_id(personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")), "spans")
    added = {i: [x for x in spans if x["kind"] not in PLAIN] for i, spans in got.items()}
    assert np.mean([bool(added[i]) for i, _ in rows if i < 1000]) > 0.9
    assert np.mean([bool(added[i]) for i, _ in rows if i >= 1000]) < 0.05
    # Two numbers in a row are two spans, but where one of them ends like a year.
    assert np.mean([len(added[i]) == 2 for i, t in rows if t.startswith("x ") and i < 1000]) > 0.9
    for spans in got.values():
        wide = sorted((x["start"], x["end"]) for x in spans if x["kind"] not in PLAIN)
        assert all(b <= c for (_, b), (c, _) in zip(wide, wide[1:]))
        assert not any(x["start"] < b and a < x["end"] for x in spans if x["kind"] in PLAIN for a, b in wide)
        assert all(0 < x["score"] <= 1 for x in spans)


def _otherwise(kind, value, rng):
    """A strict value as people write it otherwise."""
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return rng.choice(["/", "."]).join(re.findall("....?", digits)[:4]) if len(digits) == 16 else None
    return {"email": value.replace("@", rng.choice([" (at) ", "(at)"])), "ip": value.replace(".", "-"), "phone": value[1:]}[kind]


def test_personal_data_written_otherwise(spark):
    """In every other document the strict values are rewritten, in their own contexts: they are found, and hardly anything else is."""
    rng = random.Random(2)
    rows, planted = [], {}
    for n, r in enumerate(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect()):
        text = r["text"] or ""
        spans = base_spans(text)
        if not spans and n % 20:
            continue
        if n % 2:
            for kind, a, b in sorted(spans, key=lambda x: -x[1]):
                value = _otherwise(kind, text[a:b], rng)
                if value:
                    text = text[:a] + value + text[b:]
                    planted.setdefault(n, []).append((a, len(value)))
            # Of several in one text the places have moved: these teach, and are not counted.
            if len(planted.get(n, [])) > 1:
                planted[n] = []
        rows.append((n, text))
    got = by_id(personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")), "spans")
    spots = [(n, a, a + size) for n, at in planted.items() for a, size in at]
    hit = [any(x["kind"] in personal_data.ADDED and min(x["end"], b) - max(x["start"], a) >= 0.8 * (b - a) for x in got[n]) for n, a, b in spots]
    added = [(n, x) for n, spans in got.items() for x in spans if x["kind"] in personal_data.ADDED and (not n % 2 or planted.get(n))]
    right = [any(n == m and min(x["end"], b) > max(x["start"], a) for m, a, b in spots) for n, x in added]
    assert len(spots) > 100 and np.mean(hit) > 0.85 and np.mean(right) > 0.95


def test_personal_data_by_brute_force(spark):
    """The generators by Python's patterns, and the sweep by comparing every span with every other, with the scores of the fitted trees."""
    rng = random.Random(6)
    bits = ["555-123-4567", "(555) 123-4567", "5551234567", "12 34 56", "2021-05-17", "a@b.c", "bob (at) mail.org", "10.0.0.1", "+1 (234) 555-0000", "4111/1111/1111/1111", "x", " ", ", ", "/", " - ", "(", ")", "é", "7", "phone "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = shared.written(personal_data.candidates(df).withColumn("row", F.monotonically_increasing_id()))
    wide = {r["doc_id"]: [(x["k"], x["v"], x["s"], x["e"], x["b"], x["a"]) for x in r["wide"]] for r in found.collect()}
    for i, t in enumerate(texts):
        want = []
        for k, kind in enumerate(personal_data.ADDED):
            ms = list(re.finditer(personal_data.PATTERNS[kind], t))
            for j, m in enumerate(ms):
                before = t[ms[j - 1].end() if j else 0 : m.start()]
                after = t[m.end() : ms[j + 1].start() if j + 1 < len(ms) else len(t)]
                want.append((k, m[0], m.start(), m.end(), before[-24:], after[:1]))
        assert wide[i] == want, t
    model, least = personal_data.trained(spark, real=personal_data.real_examples(found))
    scored = {}
    for r in found.select("doc_id", F.inline("wide")).select("doc_id", "k", "s", "e", F.expr(personal_data._features()).alias("f")).collect():
        o = float(model.score(np.asarray([r["f"]]))[0])
        if o >= least:
            scored.setdefault(r["doc_id"], []).append((r["s"], r["e"], r["k"], o))
    got = by_id(personal_data.find_personal_data(df), "spans")
    n = 0
    for i, t in enumerate(texts):
        spans = [(a, b, -1, 0.0) for _, a, b in base_spans(t)] + scored.get(i, [])
        chain = list(range(len(spans)))
        for _ in spans:
            for x, y in itertools.combinations(range(len(spans)), 2):
                if spans[x][0] < spans[y][1] and spans[y][0] < spans[x][1]:
                    chain[x] = chain[y] = min(chain[x], chain[y])
        want = []
        for c in set(chain):
            own = [s for s, d in zip(spans, chain, strict=True) if d == c]
            if min(k for *_, k, _ in own) >= 0:
                best = max(own, key=lambda s: (s[3], -s[0], s[1], -s[2]))[2]
                want += [(personal_data.ADDED[best], a, b) for a, b, k, _ in own if k == best]
        assert sorted((x["kind"], x["start"], x["end"]) for x in got[i] if x["kind"] in personal_data.ADDED) == sorted(want), t
        n += len(want)
    assert n > 30


def test_personal_data_in_crowded_texts(spark):
    """The work grows with the text: hundreds of candidates in a short one, tens of thousands in a long one."""
    texts = ["10.0.0.1 " * 200, "+1 (234) 555-0000, " * 200, "555-123-4567 " * 20_000, "a (at) b.com " * 5000, "1 " * 100_000]
    got = by_id(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    assert sum(x["kind"] == "ip" for x in got[0]) == 200 and sum(x["kind"] == "phone" for x in got[1]) == 200
    assert len(got[2]) > 0


def test_boosting_separates():
    x = np.asarray(list(itertools.product(range(3), range(3), range(2))))
    total = np.full(len(x), 50.0)
    positive = np.where((x[:, 0] >= 2) & (x[:, 1] >= 1), 49.0, 1.0)
    model = boosting.Boosted.fitted(x, positive, total)
    least = boosting.threshold(model.score(x), positive, total, 0.95)
    assert ((model.score(x) >= least) == (positive > 25)).all()
    values = ", ".join(f"array({', '.join(map(str, r))})" for r in x)
    got = duckdb.sql(f"select {model.sql('f').replace('[', '[1 + ').replace('D', '')} from (select unnest([{values.replace('array(', '[').replace(')', ']')}]) as f)").fetchall()
    assert [float(g[0]) for g in got] == pytest.approx(list(model.score(x)))


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_phrases():
    assert fingerprints.phrases("aababcabcd", set()) == (["a", "ab", "abc", "abcd"], "")
    seen: set = set()
    first, last = fingerprints.phrases("abracadab", seen)
    rest, _ = fingerprints.phrases("racadabra", seen, last)
    assert first + rest == fingerprints.phrases("abracadabracadabra", set())[0]


def plain_signature(text):
    """The least of 64 hashes of the phrases of an LZ78 parse, written out one by one."""
    import xxhash

    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    hashes = [xxhash.xxh64_intdigest(p) for p in seen]
    return [min([(h * int(m) + int(a)) % 2**64 for h in hashes], default=2**64 - 1) for m, a in zip(fingerprints._MULTIPLY, fingerprints._ADD)]


def test_fingerprints(spark, docs):
    repeated = [(50, f"a text of many under one id, number {k * k}") for k in range(40)] + [(None, f"none {k}") for k in range(5)]
    rows = docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame(repeated, "doc_id long, text string").withColumn("size", F.lit(1)))
    rows = rows.filter("text is null or text not like 'Hello%'").filter("length(text) < 5000 or text is null").dropDuplicates(["doc_id", "text"])
    h = {(r["doc_id"], r["t"]): r["h"] for r in rows.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(h, key=lambda k: (k[0] is not None, k[0] or 0, h[k]), reverse=True)
    got = fingerprints.fingerprint_edits(rows).collect()
    want = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        n = len(a)
        edited = a[: n - n // 3] + b[: n // 3]
        x, y, z = (plain_signature(t) for t in (a, edited, b))
        shown = ["".join(f"{v >> 48:04x}" for v in w) for w in (x, y)]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), *shown, sum(p == q for p, q in zip(x, y)) / 64, sum(p == q for p, q in zip(x, z)) / 64))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fingerprints_of_equal_and_long_texts(docs):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[7]["near_next"] == 1.0 and got[5]["n_chars"] == len(LONG)


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_mix_and_schedule(spark, corpus):
    sized, mixed = mixing.mix(corpus, block=16)
    total = sized.agg(F.sum("size")).first()[0]
    per = sized.groupBy("source_no").agg(F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    taken = {r["source_no"]: r["w"] for r in mixed.groupBy("source_no").agg(F.sum("words").alias("w")).collect()}
    assert sum(r["t"] for r in per) == pytest.approx(1.5 * total)
    assert all(abs(taken.get(r["source_no"], 0) - r["t"]) <= 1 and r["t"] <= 2 * r["s"] for r in per)
    slots = mixed.groupBy("slot").agg(F.countDistinct("source_no").alias("n"), F.sum("words").alias("w")).collect()
    assert all(r["n"] == 1 and r["w"] <= 16 for r in slots)
    # After any number of slots each source has about its share.
    order = sorted((r["slot"], r["source_no"]) for r in mixed.select("slot", "source_no").distinct().collect())
    want = {r["source_no"]: r["t"] / (1.5 * total) for r in per}
    seen: dict = {}
    for n, (_, s) in enumerate(order[: len(order) * 3 // 4], 1):
        seen[s] = seen.get(s, 0) + 1
        if n % 50 == 0:
            assert all(abs(seen.get(k, 0) - n * w) <= 6 for k, w in want.items())


def test_mixed_documents(corpus):
    rows = mixing.mixed_documents(corpus)
    assert rows.columns == corpus.columns
    sized, mixed = mixing.mix(corpus)
    assert rows.select(F.sum(mixing.words())).first()[0] == mixed.agg(F.sum("words")).first()[0]


def test_mixed_documents_stand_in_slot_order(corpus):
    """After any number of documents each source has had about its share, within the longest document."""
    rows = mixing.mixed_documents(corpus, block=16).select("source", mixing.words().alias("n")).collect()
    sized, _ = mixing.mix(corpus, block=16)
    targets = {r["source_no"]: r["t"] for r in sized.groupBy("source_no").agg(F.first("target").alias("t")).collect()}
    names = sorted({r["source"] for r in corpus.select("source").collect()})
    share = {s: targets[k + 1] / sum(targets.values()) for k, s in enumerate(names)}
    longest, had, total = max(r["n"] for r in rows), dict.fromkeys(names, 0), 0
    for r in rows:
        had[r["source"]] += r["n"]
        total += r["n"]
        assert all(abs(had[s] - share[s] * total) <= 2 * longest + 200 for s in names)


def test_mix_of_rows_that_share_an_id_and_a_text(spark):
    rows = [(1, "a b c", "s1", "x"), (1, "a b c", "s2", "x"), (1, "a b c", "s2", "w"), (2, "d e f g", "s2", "y"), (3, None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __h string")
    first = sorted(map(tuple, mixing.mixed_documents(df).collect()))
    assert first == sorted(map(tuple, mixing.mixed_documents(df.repartition(5)).collect()))
    assert {r[2] for r in first} == {"s1", "s2"} and ("w" in {r[3] for r in first})


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs):
    tokenizer = packing.WordEncoder(WORDS)._tokenizer
    pieces = packing.pack(docs, WORDS, window=64).collect()
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for n, s in sequences.items():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(itertools.accumulate([0] + [r["length"] for r in s[:-1]]))
        assert sum(r["length"] for r in s) == 64 or n == max(sequences)
    ids: dict = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        if r["doc_id"] != 4:  # twice in the table
            ids.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4"))
    for i, t in enumerate(TEXTS):
        if i != 4:
            assert np.concatenate(ids[i]).tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_word_encoder():
    encoder = packing.WordEncoder(WORDS)
    odd = ["a\x1cb c", "don't they'll ###, x.́ İstanbul ΣΑΣ ΟΔΟΣ. <|endoftext|> foo<|startoftext|>bar", " x y\u0085z w é ́e ﬁ 한국어 日本語 12345 a1b2 🙂🙂", "", "  ", "ÉTÉ été Été, straße STRASSE ÿ Ÿ ×÷ a×b", "x'S 's 'll. !!' wow!!! a.b,c;d"]
    want = [e.ids for e in encoder._tokenizer.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(odd)] == want


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_near_duplicates_lose_no_link(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", "", "one", "One", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(df), "class_id")
    idf = near_dedup.inverse_frequencies(df)
    sets = [near_dedup.weighted(t or "", idf) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if same or len(sets[a][0]) and len(sets[b][0]) and near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8:
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_ids(spark):
    """Texts decide, not ids: each of three texts under one id has its own class and its own near copy."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (5, c), (None, c), (None, "alone without an id"), (3, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("kept", F.lit(0))
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(map(repr, ((r["doc_id"], r["class_id"]) for r in got))) == sorted(map(repr, [(3, 3), (5, 3), (5, 5), (9, 5), (5, 5), (None, 5), (None, None), (3, 3)]))
    assert sum(r["kept"] for r in got) == 4
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [(3, a), (5, b), (5, c), (None, "alone without an id")]))


def test_near_duplicates_recall(spark):
    """Of thousands of planted links of weighted similarity 0.8 and more, nearly all are found."""
    rng = random.Random(7)
    texts, pairs = [], []
    for k in range(1200):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 240]))]
        first = len(texts)
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            pairs.append((first, len(texts)))
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(df)
    sets = [near_dedup.weighted(t, idf) for t in texts]
    near = [(a, b) for a, b in pairs if near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    got = by_id(near_dedup.near_duplicates(df), "class_id")
    assert len(near) > 1500
    assert np.mean([got[a] == got[b] for a, b in near]) > 0.99


def test_near_duplicates_hold_a_star_together(spark):
    """Copies that are like their original and not like one another, more than a block holds; the original has any id."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(304)]
    texts = []
    for k in range(1100):
        copy = list(base)
        for i in rng.sample(range(5, 295), 5):
            copy[i] = f"e{k}x{i}"
        texts.append(" ".join(copy))
    texts.insert(613, " ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(df)
    sets = [near_dedup.weighted(t, idf) for t in texts]
    near = [i for i, s in enumerate(sets) if near_dedup.weighted_jaccard(sets[613], s) >= 0.8]
    assert len(near) > 1000
    assert sum(near_dedup.weighted_jaccard(a, b) >= 0.8 for a, b in zip(sets[:600], sets[1:601])) < 10
    got = by_id(near_dedup.near_duplicates(df), "class_id")
    assert {got[i] for i in near} == {0}


def test_weights_of_long_documents_differ(spark):
    """Common shingles are light and rare ones are not, however many a document has; counts are exact."""
    rng = random.Random(5)
    line = [f"common{i}" for i in range(40)]
    words = [[f"w{rng.randrange(10**6)}" for _ in range(5000)] + (line if i % 2 else []) for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(df)
    held = [set(near_dedup.shingles(" ".join(w)).tolist()) for w in words]
    n = {h: sum(h in s for s in held) for s in held[:2] for h in s}
    found, weights = near_dedup.weighted(" ".join(words[1]), idf)
    want = [np.clip(np.log1p(60 / n[h]) / np.log1p(60), near_dedup.LEAST_IDF, 1) for h in found.tolist()]
    assert np.allclose(weights, want, rtol=1e-6)
    assert (weights == 1).sum() > 4900 and (weights == np.float32(near_dedup.LEAST_IDF)).sum() >= 36


def test_what_unlike_documents_share_is_light_and_copies_are_not(spark):
    """Documents that share a passage and nothing else weigh it little; a large group of near copies keeps its weights, and together."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = words(40), words(200)
    unlike = [words(40) + passage + words(40) for _ in range(400)]
    copies = [base[:i] + words(1) + base[i + 1 :] for i in rng.choices(range(10, 190), k=400)]
    alone = [words(100) for _ in range(3200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(unlike + copies + alone)], "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(df)
    weight = lambda w: near_dedup.weighted(" ".join(w), idf)[1]
    assert weight(passage).max() < 0.45
    assert weight(base).min() > 0.9
    got = by_id(near_dedup.near_duplicates(df), "class_id")
    assert {got[i] for i in range(400, 800)} == {400}
    assert all(got[i] == i for i in [*range(400), *range(800, 4000)])


def test_block_pairs_are_exact():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        h = np.sort(rng.choice(40, rng.integers(20, 40), replace=False)).astype(np.uint64)
        sets.append((h, rng.choice(np.asarray([0.9, 1.0, 1.69], np.float32), len(h))))
    wanted = np.triu(np.ones((60, 60), bool), 1)
    for least in (0.5, 0.6):
        want = [(i, j) for i, j in itertools.combinations(range(60), 2) if near_dedup.weighted_jaccard(sets[i], sets[j]) >= least]
        assert want and list(map(tuple, near_dedup.similar_pairs(sets, wanted, least, slab=16).tolist())) == want


def test_samples_follow_the_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a = h[:300], rng.uniform(0.5, 2, 300).astype(np.float32)
    b = h[50:350], np.concatenate([a[1][50:], rng.uniform(0.5, 2, 50).astype(np.float32)])
    order = np.argsort(a[0]), np.argsort(b[0])
    a, b = (tuple(x[o] for x in s) for s, o in zip((a, b), order))
    s = near_dedup.samples([a, b], 1000)
    assert abs((s[0] == s[1]).mean() - near_dedup.weighted_jaccard(a, b)) < 0.05


def test_shingles():
    words = "a bb ccc dddd e ff".split()
    assert len(near_dedup.shingles(" ".join(words))) == 2
    assert near_dedup.shingles("A  bb\nccc dddd e").tolist() == near_dedup.shingles(" a bb ccc dddd e ").tolist()
    assert len(near_dedup.shingles("a b")) == 1 and len(near_dedup.shingles(" ")) == 0


# --- 10 and the rest -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.sql(queries.oracle_sql()[name]).description]
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_license_labels(spark):
    texts = {1: "Released under the MIT License.", 2: "see the Apache-License and GNU General Public License", 3: "Licensed under CC BY-NC 4.0.", 4: "permission is hereby granted, free of charge, to any person obtaining a copy", 5: None, 6: "a mit b license", **{i: f"plain text number {i}" for i in range(7, 40)}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: ({b["label"] for b in r["base"]}, {f["label"] for f in r["found"]}) for r in licenses.scan_licenses(df).collect()}
    assert got[1] == ({"mit"}, {"mit"}) and got[2][0] == {"apache", "gpl"} and got[3] == (set(), {"cc-by-nc"})
    assert "mit" in got[4][1] and got[5] == (set(), set()) and got[6] == (set(), set()) and got[20] == (set(), set())


def test_license_notices_displace_none(spark):
    """A file that holds all notices, verbatim, has each of them found in whole."""
    text = ". ".join(notice for _, notice, _ in licenses.TEMPLATES)
    df = spark.createDataFrame([(0, text), *((i, f"plain row {i}") for i in range(1, 6))], "doc_id long, text string")
    found = {(f["label"], f["word"]): f["share"] for f in licenses.scan_licenses(df).filter("doc_id = 0").first()["found"]}
    begin = 0
    for label, notice, key in licenses.TEMPLATES:
        _, words, _, at = licenses._places(label, notice, key)
        assert found[label, begin + at] == 1.0, notice
        begin += len(words)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_license_notice_in_every_row(spark, n):
    df = spark.createDataFrame([(i, "Redistribution and use in source and binary forms, with or without modification, are permitted") for i in range(n)], "doc_id long, text string")
    assert all([f["label"] for f in r["found"]] == ["bsd"] for r in licenses.scan_licenses(df).collect())


def test_license_notices_in_a_long_text(spark):
    """A long text that repeats rare words and notices: each place once, in linear time; the SQL agrees."""
    notice = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    text = "merchant purpose fee granted apache license " * 20_000 + (notice + " . ") * 2000
    df = spark.createDataFrame([(0, text), (1, None), (2, "license " * 50_000)], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(df), "found")
    assert sum(f["label"] == "isc" for f in got[0]) == 2000 and got[1] == [] and got[2] == []


@pytest.mark.parametrize("others", [0, 1, 3])
def test_license_notices_common_in_the_table(spark, others):
    """Whole notices are found however large a part of the rows holds them."""
    rows = [(i, notice) for i, (_, notice, _) in enumerate(licenses.TEMPLATES) if others or i == 1]
    copies = [(100 + i, licenses.TEMPLATES[1][1]) for i in range(others * 6)]
    df = spark.createDataFrame(rows + copies + [(200 + i, "plain") for i in range(others)], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(df), "found")
    for i, text in rows + copies:
        label = next(label for label, notice, _ in licenses.TEMPLATES if notice == text)
        assert (label, 1.0) in {(f["label"], f["share"]) for f in got[i]}, text
    assert all(got[200 + i] == [] for i in range(others))


def test_pipeline_stages(spark):
    """Each stage on what the one before it has kept, written and read again."""
    docs = shared.written(spark.read.parquet(f"{SF}/documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() > 0, name
    pieces = shared.written(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n <> 4096").count() <= 1
    assert pieces.filter("begins").count() == docs.count()


def test_columns_that_have_no_order(spark, docs):
    """Maps and the like go through the stages that choose among equal rows."""
    rows = docs.withColumn("extra", F.create_map(F.lit("a"), F.col("size"))).withColumn("a.b", F.array(F.create_map(F.lit(1), F.lit("x"))))
    for out in (near_dedup.without_near_duplicates(rows), mixing.mixed_documents(rows)):
        assert out.columns == rows.columns and out.count() > 0


def test_written_tables_go(spark):
    table = shared.written(spark.range(5))
    folder, files = shared._folder(spark, table.inputFiles()[0].rpartition("/")[0])
    assert files.exists(folder)
    shared.discard(table)
    assert not files.exists(folder)


def test_what_chats_remember_is_bounded():
    rng = random.Random(9)
    before = chat_format._matrix.cache_info().currsize
    for _ in range(300):
        roles = tuple(rng.choice(["user", "assistant", "system", None, "x" * rng.randint(1, 50)]) for _ in range(512))
        chat_format.repaired(roles, 0, chat_format.ends(chat_format.matrix(roles))[0])
    # Of long rows nothing is kept but the matrices of their single turns.
    assert chat_format._matrix.cache_info().currsize <= before + 4
    assert chat_format._matrix.cache_info().maxsize * chat_format.REMEMBERED <= 320_000


def test_pipeline_on_odd_rows(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = shared.written(stage(spark, table, SF))
            assert table.columns == rows.columns
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
