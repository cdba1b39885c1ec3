"""Exact duplicates by a tree of merges over sorted runs of digests.

Every partition of the table is a leaf with a run: its rows' digests, sorted, equal ones made one entry with
their number and the row that stays. Leaves then exchange runs in binomial rounds, as a butterfly does: in
each round a partition deals its run among the partitions whose numbers differ from its own in that round's
bits alone, by the same bits of the digests, and merges what it gets, up to ``FAN`` runs at once. After the
last round a digest stands in one partition, and no partition has ever held more than a share of the runs.
A text that a third of all rows repeat is one entry of each leaf.

All of it is DataFrame operations; a merge is a sort and an aggregation over sorted entries.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import discard, written

#: Rows of a partition of the tree, about, and partitions of the smallest tree.
RUN_ROWS = 16384
LEAST_RUNS = 8
#: Bits of a round: a partition exchanges with so many others, two to this power.
ROUND_BITS = 4
FAN = 1 << ROUND_BITS
#: What tells texts apart: the SHA-256 of a text, and, to verify it, the text's length and another hash.
_TEXT = ["digest", "bytes", "check"]


def normalised(text_col: str = "text") -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _bits_at(rows: int, run_rows: int) -> int:
    """Bits of a partition's number in a tree for so many rows."""
    return max(LEAST_RUNS - 1, -(-rows // run_rows) - 1).bit_length()


def _merged(entries: DataFrame, n: int, best: Column, count: Column) -> DataFrame:
    """One entry for each text of each partition ``at``, of ``n``: the runs that a partition gets, sorted and merged."""
    return entries.repartitionById(n, F.col("at")).groupBy("at", *_TEXT).agg(best.alias("best"), count.alias("n"))


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, carry: bool = False, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of each row; with ``carry`` also ``own``, the row's columns.

    ``run_rows`` is about how many rows a partition of the tree begins with.
    """
    text, every = normalised(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("bytes"),
        F.xxhash64(text).alias("check"),
        F.monotonically_increasing_id().alias("row"),
        *([every.alias("own"), F.xxhash64(F.to_json(every)).alias("tie")] if carry else [F.lit(0).cast("long").alias("tie")]),
    )
    # Once written, a row keeps its number, whatever is run again.
    rows = written(rows)
    bits = _bits_at(rows.count(), run_rows)
    n = 1 << bits
    bucket = F.pmod(F.col("check"), F.lit(n)).cast("int")
    # The high part of a row's number is the partition that it was read in.
    leaf = F.pmod(F.shiftright("row", 33), F.lit(n)).cast("int")
    known = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    choose = F.max if largest else F.min
    rows = rows.withColumn("at", leaf)
    leaves = written(_merged(rows, n, choose(F.struct(known.alias("known"), F.col("doc_id").alias("id"), "tie", "row")), F.count("*")))
    top, done = leaves, 0
    while done < bits:
        step = min(ROUND_BITS, bits - done)
        mask = ((1 << step) - 1) << done
        dealt = F.col("at").bitwiseAND(F.lit(n - 1 - mask)).bitwiseOR(bucket.bitwiseAND(F.lit(mask)))
        top, done = _merged(top.withColumn("at", dealt), n, choose("best"), F.sum("n")), done + step
    # A text that stands once needs no answer. A text of many rows has one entry a leaf, and there one answer.
    classes = top.filter("n > 1").select(*_TEXT, F.col("best").alias("kept_row"), F.col("n").alias("size"))
    answers = written(leaves.select("at", *_TEXT).join(classes, _TEXT))
    discard(leaves)
    both = rows.join(answers, ["at", *_TEXT], "left")
    one = F.col("size").isNull()
    return both.select(
        *(["own"] if carry else []),
        "doc_id",
        "digest",
        F.when(one, F.col("doc_id")).otherwise(F.col("kept_row.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("row") == F.col("kept_row.row"))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after A-Z became a-z; nulls are empty texts, and all empty texts equal. Of
    equal texts the row with the largest id stays, or the smallest if not ``largest``; a row without an id stays only
    if all have none. Of rows that agree in id and text exactly one is kept. An empty table gives no rows; other
    columns are ignored. Digests are verified by the texts' lengths and a second hash, not by the texts themselves.
    """
    found = classed(docs, id_col, text_col, largest, run_rows=run_rows)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, run_rows: int = RUN_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of whatever types and names.

    As ``exact_duplicates`` has it; of rows that agree in id and text, the one whose columns, as JSON, have the largest
    hash (the smallest if not ``largest``) stays.
    """
    found = classed(docs, id_col, text_col, largest, carry=True, run_rows=run_rows)
    return found.filter("kept").select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its text."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
window w as (partition by text_sha256)
"""
