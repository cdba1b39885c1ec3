"""Secret scans by token efficiency.

A vocabulary learnt from ordinary text spells ordinary strings with few, long tokens. A string whose
characters per token stay low is unlike anything in that text: a key, a password, a random identifier.
Known digests, numbers and identifiers of readable words, which can be as dense but are no secrets, are excluded.
Fixed patterns for assignments, access keys and long hexadecimal strings come beside it.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, slices

KINDS = ("assign", "access", "hex", "dense")
BASE = KINDS[:3]
#: Characters per token up to which a string counts as random; prose has 2.5 to 5, base-64 text 1.2 to 1.9.
MOST_PER_TOKEN = 2.0
#: The same for a window of a string that is readable on the whole.
WINDOW_PER_TOKEN = 1.6
MIN_LENGTH = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole: one of 32 or more begins and ends where the shorter pattern's does
_DENSE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Digests by their length in hexadecimal digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and UUIDs.
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
#: One of them within a longer string, between marks.
_DIGEST_WITHIN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})(?![A-Za-z0-9])")
#: The parts of a string: words, also in camel case, numbers, and marks. Each character is looked at once.
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_=-]+")
#: What stands between marks.
_PIECES = re.compile(r"[A-Za-z0-9]+")
#: Digits that a word of an identifier may have behind it.
MOST_DIGITS = 4
#: Characters that are encoded at once; longer strings in stretches, as the vocabulary's own merging takes more than linear time.
STRETCH = 1024
_ALNUM = re.compile(r"[A-Za-z0-9]")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(s: str, encoding) -> int:
    """The number of tokens that spell ``s``, summed over stretches of ``STRETCH`` characters."""
    return sum(len(encoding.encode_ordinary(s[i : i + STRETCH])) for i in range(0, len(s), STRETCH))


def known_name(s: str, encoding, most_per_token: float = MOST_PER_TOKEN) -> bool:
    """Whether ``s`` is a digest, a number or a readable identifier.

    Numbers hold digits and marks alone, such as dates. An identifier is words of three letters on average that
    are not dense themselves, joined by marks or in camel case, each with at most ``MOST_DIGITS`` digits behind it.
    """
    if _DIGEST.match(s):
        return True
    words, before, lettered = [], "", any(map(str.isalpha, s))
    for part in _PARTS.findall(s):
        first = part[0]
        if first.isalpha():
            words.append(part)
        elif lettered and first.isdigit() and (len(part) > MOST_DIGITS or not before.isalpha()):
            return False  # beside words, digits that stand alone make no identifier
        before = part
    letters = sum(map(len, words))
    return not words or letters >= 3 * len(words) and letters > most_per_token * sum(n_tokens(w, encoding) for w in words)


def _dense(s: str, encoding, most_per_token: float) -> bool:
    """Whether a string of letters, digits and marks is random by its tokens, and no known name."""
    return len(s) >= MIN_LENGTH and bool(_ALNUM.search(s)) and len(s) / n_tokens(s, encoding) <= most_per_token and not known_name(s, encoding, most_per_token)


def _readable(part: str, encoding, most_per_token: float) -> bool:
    """Whether a part between marks is a word or a name: letters with few digits behind, spelt by long tokens or by one."""
    n = n_tokens(part, encoding)
    return part[0].isalpha() and (n == 1 or (len(part) > most_per_token * n and known_name(part, encoding, most_per_token)))


def _windows(s: str, encoding) -> Iterator[tuple[int, int]]:
    """The random stretches of a string without marks, where it is readable on the whole.

    Every window of MIN_LENGTH characters and more, token by token, that has WINDOW_PER_TOKEN characters a token at most;
    windows that overlap are one. The time is linear.
    """
    ends = [0]
    for i in range(0, len(s), STRETCH):
        for token in encoding.encode_ordinary(s[i : i + STRETCH]):
            ends.append(ends[-1] + len(encoding.decode_single_token_bytes(token)))
    start = end = None
    j = 0
    for i in range(len(ends) - 1):
        while j < len(ends) and ends[j] - ends[i] < MIN_LENGTH:
            j += 1
        if j == len(ends):
            break
        if ends[j] - ends[i] <= WINDOW_PER_TOKEN * (j - i):
            if start is not None and ends[i] > end:
                yield start, end
                start = None
            start, end = ends[i] if start is None else start, ends[j]
    if start is not None:
        yield start, end


def random_strings(s: str, encoding, most_per_token: float = MOST_PER_TOKEN) -> Iterator[tuple[int, int]]:
    """The random strings in a run of letters, digits and marks: the whole, or what stands in and between readable parts.

    Digests and UUIDs between marks are cut out first.
    A run that isn't random on the whole is parted by its marks. Parts that no readable one separates are taken together, then
    each by itself; of a part that is readable, or not random on the whole, windows.
    """
    if len(s) < MIN_LENGTH:
        return
    known = [m.span() for m in _DIGEST_WITHIN.finditer(s)]
    if known:
        for a, b in _outside(known, 0, len(s)):
            yield from ((a + x, a + y) for x, y in random_strings(s[a:b], encoding, most_per_token))
        return
    if _dense(s, encoding, most_per_token):
        yield 0, len(s)
        return

    def inside(a: int, b: int) -> Iterator[tuple[int, int]]:
        if b - a > MIN_LENGTH:
            yield from ((a + x, a + y) for x, y in _windows(s[a:b], encoding) if not known_name(s[a + x : a + y], encoding, most_per_token))

    group: list[tuple[int, int]] = []
    for m in [*_PIECES.finditer(s), None]:
        if m is not None and not _readable(m[0], encoding, most_per_token):
            group.append(m.span())
            continue
        if group and group[-1][1] - group[0][0] >= MIN_LENGTH:
            a, b = group[0][0], group[-1][1]
            if _dense(s[a:b], encoding, most_per_token):
                yield a, b
            elif not known_name(s[a:b], encoding, most_per_token):
                for a, b in group:
                    if _dense(s[a:b], encoding, most_per_token):
                        yield a, b
                    else:
                        yield from inside(a, b)
        group = []
        if m is not None:
            yield from inside(*m.span())


def _outside(merged: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """What of the span none of ``merged``, sorted and apart, covers."""
    k = max(0, bisect_left(merged, (start, 0)) - 1)
    while k < len(merged) and merged[k][0] < end:
        if merged[k][1] > start:
            if merged[k][0] > start:
                yield start, merged[k][0]
            start = merged[k][1]
        k += 1
    if start < end:
        yield start, end


def find_secrets(text: str, encoding, most_per_token: float = MOST_PER_TOKEN) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then by kind; dense ones touch no other."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    base: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if base and a <= base[-1][1]:
            base[-1] = base[-1][0], max(base[-1][1], b)
        else:
            base.append((a, b))
    for m in _DENSE.finditer(text):
        for a, b in _outside(base, m.start(), m.end()):
            found += [("dense", a + x, a + y) for x, y in random_strings(text[a:b], encoding, most_per_token)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, vocabulary: str, most_per_token: float = MOST_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end).

    Null and empty texts have no spans; a null id stays null, repeated rows are scanned each for itself, an
    empty table gives no rows, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py() or "", encoding, most_per_token)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact_secrets(docs: DataFrame, vocabulary: str, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with ``mark`` in place of every secret; all columns stay, texts without secrets are untouched.

    Spans that overlap get one mark. Null and empty texts stay as they are; repeated rows are each masked; an
    empty table gives no rows; no other column is looked at, whatever its name.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in slices(batches):
            texts = []
            for text in batch.column(at).to_pylist():
                parts, end = [], 0
                for _, a, b in find_secrets(text or "", encoding):
                    if b > end:
                        parts += [text[end:a], mark] if a >= end else []  # a span that begins within the last one only lengthens it
                        end = b
                texts.append(text if not parts else "".join(parts) + text[end:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    for_python(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def span_columns(kinds: tuple[str, ...], base: tuple[str, ...]) -> list:
    """Counts by kind of ``base``, the digest of their spans, and all spans as text; of no spans 0 and the empty text."""
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in base]
    return [*counts, F.sha2(shown(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", *span_columns(KINDS, BASE))
