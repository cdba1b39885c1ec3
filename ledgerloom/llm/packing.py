"""Packing by concatenate and cut.

Every document is tokenised once. The first pass writes the ids with their start inside their scan
partition; the partitions' totals, summed in partition order, place each partition in one endless stream
of tokens; the second pass cuts the stream at multiples of the window. A document that crosses such a
boundary gets one record on either side. Only the last sequence of the stream is short.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, slices, written

WINDOW = 4096
END_ID = 2
#: Words with the marks behind them, and words without, whose ids one Python worker remembers at most of each, beyond
#: those of the ``TOGETHER`` texts at hand; then it forgets all of that sort. No result depends on either.
REMEMBERED = 600_000
TOGETHER = 100

#: White space to str.split(), yet not to tokenizers: texts with one of these are parted by the pattern.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_PARTS = re.compile(r"[^ \t\n\r]+")
#: Letters, and marks that never join them: both are tokenised alike apart and together.
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,!?;:|*$%#&]*)\Z")


class WordEncoder:
    """Ids of whole texts by way of the ids of their words, which the tokenizer gives once for each word.

    Only for tokenizers that drop white space and never join what it parts (``word_bpe_49k.json``).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {ord(c): shown.pre_tokenize_str(c)[0][0] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}
        self._known: dict[str, bytes] = {}
        self._cores: dict[str, bytes] = {}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, words: list[str], together: int = 64) -> None:
        """Encode ``words``, many in one text; a token belongs to the word in which it starts."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        for group, e in zip(groups, self._tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            starts = np.cumsum([0] + [len(w) + 1 for w in group])
            ids = np.asarray(e.ids, "<u4")
            cuts = np.searchsorted([a for a, _ in e.offsets], starts)
            for word, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                self._known[word] = ids[a:b].tobytes()

    def _learn(self, words: set[str]) -> None:
        """Plain words are lower-cased, freed of the marks behind them and merged by the vocabulary's own rules."""
        known, cores, letters, merge, odd, marked = self._known, self._cores, self._letters, self._tokenizer.model.tokenize, [], []
        plain = _PLAIN.match
        for word in words:
            m = plain(word)
            if not m:
                odd.append(word)
                continue
            core, marks = m[1].lower(), m[2]
            ids = cores.get(core)
            if ids is None:
                ids = cores[core] = self._ids([t.id for t in merge(core if core.isascii() else core.translate(letters))])
            if not marks:
                known[word] = ids
            else:
                marked.append((word, ids, marks))
        self._encode(list({m for _, _, m in marked}.difference(known)) + odd)
        for word, ids, marks in marked:
            known[word] = ids + known[marks]

    def forget(self) -> None:
        """Forget all words, at the end of a task: its worker may do other work next, and keep what it holds for long."""
        self._known.clear()
        self._cores.clear()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for i in range(0, len(texts), TOGETHER) for ids in self._some(texts[i : i + TOGETHER])]

    def _some(self, texts: list[str]) -> list[bytes]:
        parted = [_PARTS.findall(t) if any(c in t for c in _ODD) else t.split() for t in texts]
        known = self._known
        for sort in (known, self._cores):
            if len(sort) > REMEMBERED:
                sort.clear()
        new = set().union(*parted).difference(known)
        if new:
            self._learn(new)
        return [b"".join([known[p] for p in parts]) for parts in parted]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``part``, ``local_start``, ``tokens``, ``ids`` (16-bit where they fit, else 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        try:
            for batch in slices(batches):
                starts, counts, blobs = [], [], []
                for blob in encode.batch([t or "" for t in batch.column(1).to_pylist()]):
                    ids = np.frombuffer(blob + end, "<u4")
                    starts.append(at)
                    counts.append(len(ids))
                    at += len(ids)
                    blobs.append(ids.astype("<u2").tobytes() if ids.max() < 65536 else ids.tobytes())
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([part] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "part", "local_start", "tokens", "ids"],
                )
        finally:
            encode.forget()

    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part long, local_start long, tokens long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences of exactly ``window`` tokens, the last one excepted.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, begins, ends
    (whether the piece holds its document's first and last id) and, with ``with_ids``, ids (32-bit
    little-endian). Null and empty texts are the end id alone. Rows that repeat an id are documents of
    their own. A null id stays null. An empty table gives no rows. Extra columns are ignored.
    """
    table = written(tokenised(docs, tokenizer_path, end_id, id_col, text_col))
    # One row per scan task: their number is that of the input splits, not of the rows.
    totals = table.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, start, length, crc, whole, seq, offset, blobs = [], [], [], [], [], [], [], []
            for d, at, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                s = 0
                while s < n:
                    take = min(n - s, window - (at + s) % window)
                    blob = ids[s : s + take].tobytes()
                    doc.append(d)
                    start.append(s)
                    length.append(take)
                    crc.append(zlib.crc32(blob))
                    whole.append(n)
                    seq.append((at + s) // window)
                    offset.append((at + s) % window)
                    if with_ids:
                        blobs.append(blob)
                    s += take
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, whole, seq, offset)]
            columns += [pa.array([s == 0 for s in start], pa.bool_()), pa.array([s + k == n for s, k, n in zip(start, length, whole, strict=True)], pa.bool_())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "begins", "ends"]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, begins boolean, ends boolean"
    return placed.mapInArrow(run, schema + ", ids binary" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, packed."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
