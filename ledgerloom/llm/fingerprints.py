"""Document fingerprints from Lempel-Ziv phrases.

Each text is parsed as the LZ78 compressor would: the next phrase is the shortest one not yet in the
dictionary. The set of phrases is hashed, and a minimum-hash signature of it compares documents about as
well as compressing one with the other's dictionary would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, partitions, slices, written

#: Minimum hashes of a signature, each kept to 16 bits.
HASHES = 64
#: Bytes of text in a range of documents, about; ranges at most; and ids of each that are sampled to find the ranges' ends.
RANGE_BYTES = 64 << 20
MOST_RANGES = 4096
SAMPLED = 64
_RNG = np.random.default_rng(20240611)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_NONE = np.full(HASHES, 2**64 - 1, np.uint64)


def phrases(text: str, seen: set[str], last: str = "") -> tuple[list[str], str]:
    """The phrases that ``text`` adds to the dictionary ``seen``, and the unfinished one at its end."""
    new: list[str] = []
    add, keep = seen.add, new.append
    for c in text:
        last += c
        if last not in seen:
            add(last)
            keep(last)
            last = ""
    return new, last


def signature(found: list[str]) -> np.ndarray:
    """Minimum hashes of a set of phrases; of an empty one, the largest values."""
    import xxhash

    best, one = _NONE, xxhash.xxh64_intdigest
    for i in range(0, len(found), 2000):
        h = np.fromiter(map(one, found[i : i + 2000]), np.uint64)
        best = np.minimum(best, (h[:, None] * _MULTIPLY + _ADD).min(axis=0))
    return best


def shown(sig: np.ndarray) -> str:
    """The upper 16 bits of each minimum, in hexadecimal."""
    return (sig >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal minima: an estimate of the phrase sets' Jaccard similarity."""
    return float(np.count_nonzero(a == b)) / HASHES


def _range_of(cuts: list[tuple[bool, int, int]]) -> Column:
    """How many of the sorted ``cuts`` the column ``key`` isn't below: first among every so many, then among those between."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    shown = lambda c: f"named_struct('known', {str(c[0]).lower()}, 'id', cast('{c[1]}' as bigint), 'h', cast('{c[2]}' as bigint))"
    groups = [", ".join(map(shown, cuts[i : i + step])) for i in range(0, len(cuts), step)]
    firsts = ", ".join(map(shown, cuts[::step]))
    top = f"size(filter(array({firsts}), c -> c <= key))"
    inner = f"size(filter(array({', '.join(f'array({g})' for g in groups)})[t - 1], c -> c <= key))"
    return F.expr(f"transform(array({top}), t -> if(t = 0, 0, (t - 1) * {step} + {inner}))[0]")


def ordered_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt to ranges of descending id, each range followed by a copy of the document after it.

    Columns: dest (the range), tail (true for that copy), doc_id, text; sorted within each partition, which holds
    one range. Rows that share an id stand by their texts' hashes, null ids after all others likewise, and both
    are dealt to as many ranges as they need. There are as many ranges as the bytes of text ask for; their ends
    come from a sample of ids and hashes, and one row per range is all else that reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h")))
    keys = written(rows.select("key", F.octet_length("text").alias("bytes")))
    size, count = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    n = min(MOST_RANGES, max(partitions(spark), -(-size // RANGE_BYTES)))
    share = min(2**30, SAMPLED * n * 2**30 // max(count, 1))
    sample = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(2**30)) < share).select("key.*").collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    at = _range_of(cuts)
    heads = keys.groupBy(at.alias("range")).agg(F.max("key").alias("head")).collect()
    below = sorted(((r["range"], tuple(r["head"])) for r in heads), reverse=True)
    # The head of each range follows the range above it; the first of all follows the last.
    follows = [(r, *head, below[k - 1][0]) for k, (r, head) in enumerate(below)]
    table = spark.createDataFrame(follows, "range int, known boolean, id long, h long, above int").select("range", F.struct("known", "id", "h").alias("head"), "above")
    marked = rows.withColumn("range", at).join(F.broadcast(table), "range")  # MOST_RANGES rows at most
    own = F.struct(F.col("range").alias("dest"), F.lit(False).alias("tail"))
    to = F.when(F.col("key") == F.col("head"), F.array(own, F.struct(F.col("above").alias("dest"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    dealt = marked.select(F.inline(to), "doc_id", "text", F.col("key.h").alias("h"))
    return dealt.repartitionById(n, F.col("dest")).sortWithinPartitions("dest", "tail", F.col("doc_id").desc_nulls_last(), F.col("h").desc()).select("dest", "tail", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document, and of the same with its last third taken from the next document.

    One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty. Empty texts have the fingerprint of no phrases and are alike. Rows that
    repeat an id or have none follow one another by their texts' hashes; a single document is its own next one.
    An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # (range, id, text, signature, signature of the part that edits keep, its dictionary and last phrase)
        for batch in slices(batches):
            out = []
            for dest, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and (held is None or held[0] != dest):
                    continue  # an equal copy of the row that has just served
                n = len(text)
                cut = n - n // 3
                seen: set[str] = set()
                kept, last = phrases(text[:cut], seen)
                kept_sig = signature(kept)
                whole = seen if tail else set(seen)
                sig = np.minimum(kept_sig, signature(phrases(text[cut:], whole, last)[0]))
                if held is not None and held[0] == dest:
                    _, of, before, own, own_kept, own_seen, own_last = held
                    third = len(before) // 3
                    end = text[:third]
                    edited = np.minimum(own_kept, signature(phrases(end, own_seen, own_last)[0]))
                    sha = hashlib.sha256((before[: len(before) - third] + end).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((of, len(before), sha, shown(own), shown(edited), likeness(own, edited), likeness(own, sig)))
                held = None if tail else (dest, doc_id, text, sig, kept_sig, seen, last)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    for_python(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered_with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
