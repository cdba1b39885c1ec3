"""Language identification by partial matching.

For each language a tree of byte contexts up to ``ORDER`` long is counted on labelled documents. A byte
costs what its longest known context gives it; where the context has never been followed by that byte, the
escape probability is paid and the context shortened, down to a uniform code over all bytes (method C
escapes, no exclusions). The statistics are frozen after training, so a byte's cost depends on the bytes
just before it alone, and the costs of all runs of bytes that training has seen are compiled into sorted
tables that score whole texts by lookups. The language whose code is shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, slices

#: Bytes of context at most.
ORDER = 3
#: Documents that are counted, about, drawn by a hash: of each language, and of all languages together.
TRAIN_DOCS = 1500
TRAIN_TOTAL = 24_000
#: One in so many of them isn't counted, but tells what documents that training hasn't seen cost; and how far above the
#: dearest of these, of its length or longer, a document in one of the languages may be.
CALIBRATE = 5
MARGIN = 1.25

_PIECE = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the document is kept out of training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + text.lower().encode("utf-8", "replace"), np.uint8)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class ByteTrees:
    """The compiled trees of all languages: costs in bits of the runs of up to four bytes that training has seen.

    ``grams`` and ``triples`` are sorted runs of four and three bytes, as numbers, with their costs by language;
    ``pairs`` has the costs of all runs of two. Escapes stand by context: ``contexts`` are the sorted runs of three
    bytes that have one; all runs of two have.
    """

    def __init__(self, langs, grams, gram_cost, contexts, context_escape, triples, triple_cost, pair_escape, pairs):
        self.langs, self.grams, self.gram_cost, self.contexts, self.context_escape = langs, grams, gram_cost, contexts, context_escape
        self.triples, self.triple_cost, self.pair_escape, self.pairs = triples, triple_cost, pair_escape, pairs
        self.limits = np.full(64, np.inf)  # bits a byte that a text of 2**k bytes and more may cost in its language

    @classmethod
    def compiled(cls, counts: pd.DataFrame) -> ByteTrees:
        """``counts``: lang, gram (four bytes as one number, the last byte lowest), n."""
        langs = sorted(counts.lang.unique())
        gram, n = counts.gram.to_numpy(np.int64), counts.n.to_numpy(np.float64)
        lang = np.searchsorted(langs, counts.lang.to_numpy(object))

        def level(keys: np.ndarray, of: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Costs of the ``keys`` (context and byte), their contexts, and the contexts' escapes; ``of``: each count's key."""
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            cost, escape = np.empty((len(keys), len(langs)), np.float32), np.empty((len(contexts), len(langs)), np.float32)
            for k in range(len(langs)):
                seen = np.bincount(of[lang == k], n[lang == k], len(keys))
                total, kinds = np.bincount(at, seen, len(contexts)), np.bincount(at[seen > 0], minlength=len(contexts))
                whole = np.maximum(total + kinds, 1)
                escape[:, k] = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
                cost[:, k] = np.where(seen > 0, -np.log2(np.maximum(seen, 1) / whole[at]), escape[at, k] + lower[:, k])
            return cost, contexts, escape

        uniform = np.full((256, len(langs)), 8.0, np.float32)
        single, _, _ = level(np.arange(256), gram & 255, uniform)
        every = np.arange(1 << 16)
        pairs, _, _ = level(every, gram & 0xFFFF, single[every & 255])
        triples, of = np.unique(gram & 0xFFFFFF, return_inverse=True)
        triple_cost, twos, two_escape = level(triples, of, pairs[triples & 0xFFFF])
        pair_escape = np.zeros((1 << 16, len(langs)), np.float32)
        pair_escape[twos] = two_escape
        grams, of = np.unique(gram, return_inverse=True)
        gram_cost, contexts, context_escape = level(grams, of, triple_cost[np.searchsorted(triples, grams & 0xFFFFFF)])
        return cls(langs, grams, gram_cost, contexts, context_escape, triples, triple_cost, pair_escape, pairs)

    def bits(self, text: str) -> tuple[np.ndarray, int]:
        """Code lengths by language, and the number of bytes."""
        data, total = _bytes(text), np.zeros(len(self.langs))
        for i in range(0, len(data) - ORDER, _PIECE):
            b = data[i : i + _PIECE + ORDER].astype(np.int64)
            gram, n = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
            at, known = _found(self.grams, gram)
            total += n[known] @ self.gram_cost[at[known]].astype(np.float64)
            gram, n = gram[~known], n[~known]
            # Shorter contexts, each after the escape from the one before it.
            at, known = _found(self.contexts, gram >> 8)
            total += n[known] @ self.context_escape[at[known]].astype(np.float64)
            at, known = _found(self.triples, gram & 0xFFFFFF)
            total += n[known] @ self.triple_cost[at[known]].astype(np.float64)
            gram, n = gram[~known], n[~known]
            total += n @ (self.pair_escape[(gram >> 8) & 0xFFFF] + self.pairs[gram & 0xFFFF]).astype(np.float64)
        return total, len(data) - ORDER

    def calibrate(self, dearest: dict[int, float], margin: float = MARGIN) -> None:
        """``dearest``: the most bits a byte of any known document of 2**k to 2**(k+1) bytes. Texts shorter than all of these have no limit."""
        most = 0.0
        for k in range(max(dearest, default=-1), min(dearest, default=0) - 1, -1):
            most = max(most, dearest.get(k, 0.0))
            self.limits[k] = margin * most
        self.limits[max(dearest, default=63) + 1 :] = margin * dearest[max(dearest)] if dearest else np.inf

    def knows(self, text: str | None) -> bool:
        """Whether a text is in one of the languages: it has a letter, and its shortest code isn't too long."""
        if not text or not has_letter(text):
            return False
        bits, n = self.bits(text)
        return float(bits.min()) / n <= self.limits[n.bit_length() - 1]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` stands among the sorted ``keys``, and whether it does."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_counts(docs: DataFrame) -> DataFrame:
    """Counts of all runs of four bytes by language, from columns lang and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (batch.iloc[i : i + 1000] for batch in batches for i in range(0, len(batch), 1000)):
            for lang, texts in rows.groupby("lang").text:
                found = []
                for text in texts:
                    b = _bytes(text).astype(np.int64)
                    found.append(((b[:-3] << 24) | (b[1:-2] << 16)) | ((b[2:-1] << 8) | b[3:]))
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    for_python(docs.sparkSession)
    return docs.select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id") -> ByteTrees | None:
    """Trees from about ``train_docs`` whole documents of each language, ``TRAIN_TOTAL`` in all; None if nothing is labelled.

    Columns used: ``id_col``, lang, text. Rows with a null lang or text take no part. What reaches the driver is one
    row for each language, and the counts of the drawn documents' runs of four bytes.
    """
    rows = labelled.filter("lang is not null and text is not null and text <> ''").select(F.col(id_col).alias("i"), F.col("lang").cast("string").alias("lang"), "text")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    each = min(train_docs, TRAIN_TOTAL / len(per))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, int(min(1.0, each / n) * 2**30))]), F.col("lang"))
    drawn = rows.filter(F.pmod(F.xxhash64("i", "lang", "text"), F.lit(2**30)) < share)
    aside = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(CALIBRATE)) == 0
    counts = gram_counts(drawn.filter(~aside)).toPandas()
    if not len(counts):
        return None
    trees = ByteTrees.compiled(counts)
    trees.calibrate({r["k"]: r["rate"] for r in _rates(drawn.filter(aside), trees).groupBy("k").agg(F.max("rate").alias("rate")).collect()})
    return trees


def _rates(docs: DataFrame, trees: ByteTrees) -> DataFrame:
    """k and rate: the logarithm of each text's number of bytes, and the bits a byte of its shortest code."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(n.bit_length() - 1, float(bits.min()) / n) for bits, n in map(shared.value.bits, filter(has_letter, batch.column(0).to_pylist()))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([r for _, r in found], pa.float64())], names=["k", "rate"])

    return docs.select("text").mapInArrow(run, "k int, rate double")


def predict(docs: DataFrame, trees: ByteTrees | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, lang_pred, score and bits_per_byte.

    lang_pred is ``und``, with score 0, where the text is null, empty or without a letter, or nothing was
    learnt. score is the share of the winner among all languages' probabilities of the text. Ties go to the
    language first by code point. Texts of any length count whole.
    """
    spark = docs.sparkSession
    # The text comes last unless it is kept; it is sent to Python once.
    at = keep.index(text_col) if text_col in keep else len(keep)
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            langs, scores, rates = [], [], []
            for text in batch.column(at).to_pylist():
                if not text or model is None or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    rates.append(None)
                    continue
                bits, n = model.bits(text)
                best = int(bits.argmin())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum()))
                rates.append(float(bits[best] / n))
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *added], names=schema.names)

    for_python(spark)
    return rows.mapInArrow(run, schema)


def in_a_language(docs: DataFrame, trees: ByteTrees | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the languages.

    Rejected are texts that ``predict`` calls ``und``, null and empty ones among them, and those that cost more bits
    a byte in their best language than known documents of their length do, by ``MARGIN``. Repeated rows are each
    judged; where nothing was learnt no row stays; no other column is looked at, whatever its name.
    """
    spark = docs.sparkSession
    at, shared = docs.columns.index(text_col), spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([model is not None and model.knows(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    for_python(spark)
    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = train(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, trees, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
