"""Near duplicates by improved consistent weighted sampling.

Documents are weighted sets of shingles of five words: damped term frequency times inverse document frequency,
the latter from counts, over all documents, of every shingle that is common. Copies of one document count as one
there: else a large group of near copies would make its own shingles light and every edit in it heavy, and so tear
itself apart. What unlike documents share is light: a passage in every tenth document weighs a third of a rare one.
Consistent weighted samples of these sets (Ioffe 2010) agree with the probability of the sets' weighted Jaccard
similarity. Bands of samples propose pairs, and the exact weighted Jaccard similarity of the two texts decides.

Within a band's bucket each text is first held against two pivots of the bucket. Buckets of two neighbouring
bands together give every text further, closer pivots. Linked texts form classes; equal texts share a class
before anything is compared. A bucket that still holds more than one class is then compared whole, in blocks:
every two of its texts that are of different classes. Most buckets are of one class after the pivots; one
whose texts are all unlike takes the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import discard, for_python, slices, written

SIMILARITY = 0.8
WIDTH = 5
BANDS = 12
ROWS = 3
#: Share of the documents up to which a shingle has full weight, and the weight of those that a fifth of them hold and more.
RARE = 0.001
LEAST_IDF = 0.27
#: Bands of plain minimum hashes, and hashes in one, by which copies are told where documents with a shingle are counted.
COPY_BANDS = 16
COPY_ROWS = 5
#: Documents and distinct shingles in which common shingles are first looked for at a time.
COUNTED_DOCS = 8192
COUNTED_SHINGLES = 1 << 22
#: Texts of a bucket that make a side of a block, about.
BLOCK = 128

_RNG = np.random.default_rng(19541)
_LETTERS = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _RNG.integers(0, 2**63, 1024, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: 65,536 equally likely values of a Gamma(2, 1) variable in an order without meaning, and of the logarithm of another.
_GAMMA = _RNG.gamma(2.0, 1.0, 65536).astype(np.float32)
_LOG_GAMMA = np.log(_RNG.gamma(2.0, 1.0, 65536)).astype(np.float32)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; of fewer words, one hash of them all; of none, none.

    Words are lower-cased runs between white space.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    space = np.concatenate([[True], _SPACE[data], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)])])
    words = _mixed((sums[ends] - sums[starts]) * down[starts])
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total += words[k : k + n] * _PLACES[k]
    return _mixed(total + np.uint64(min(width, len(words))))


Idf = tuple[np.ndarray, np.ndarray]


def weighted(text: str, idf: Idf, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, sorted, and their weights. ``idf``: the common shingles, sorted, and theirs; all others have 1."""
    found, n = np.unique(shingles(text, width), return_counts=True)
    weights = (1 + np.log(n)).astype(np.float32)
    common, light = idf
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        weights *= np.where(common[at] == found, light[at], np.float32(1))
    return found, weights


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights through sum of the greater ones; 1 for two empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / whole if whole > 0 else 1.0


def samples(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """``k`` consistent weighted samples of each set (none may be empty), as hashes."""
    h, w = np.concatenate([s for s, _ in sets]), np.log(np.concatenate([w for _, w in sets]))
    sizes = np.asarray([len(s) for s, _ in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), k), np.uint64)
    low = np.uint64(65535)
    for i in range(k):
        m = (h ^ _SEEDS[i]) * np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        r = _GAMMA[m & low]
        beta = ((m >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(w / r + beta)
        a = _LOG_GAMMA[(m >> np.uint64(16)) & low] - r * (t - beta + np.float32(1))
        least = np.repeat(np.minimum.reduceat(a, starts), sizes)
        hits = np.flatnonzero(a == least)
        first = hits[np.searchsorted(hits, starts)]
        out[:, i] = _mixed(h[first] ^ _mixed(t[first].astype(np.int64).view(np.uint64) + _SEEDS[i]))
    return out


def _banded(s: np.ndarray) -> np.ndarray:
    """One hash of each band; ``s``: samples by set, band and row."""
    one = np.zeros(s.shape[:2], np.uint64)
    for k in range(s.shape[2]):
        one = _mixed(one * np.uint64(31) + s[:, :, k])
    return _mixed(one + np.arange(s.shape[1], dtype=np.uint64))


def _copy_bands(sets: list[np.ndarray]) -> np.ndarray:
    """``COPY_BANDS`` hashes of each set (none may be empty), whatever its weights: each from its ``COPY_ROWS`` minimum hashes."""
    h, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), COPY_BANDS * COPY_ROWS), np.uint64)
    for i in range(least.shape[1]):
        m = (h ^ _SEEDS[i]) * np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xD6E8FEB86659FD93)
        least[:, i] = np.minimum.reduceat(m, starts)
    return _banded(least.reshape(len(sets), COPY_BANDS, COPY_ROWS))


def _grouped(texts: list[str], idf: Idf, width: int, most: int = 60_000) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Weighted sets of the texts that have any words, some ten thousand shingles at a time."""
    at, sets, n = [], [], 0
    for i, text in enumerate(texts):
        s = weighted(text, idf, width)
        if len(s[0]):
            at.append(i)
            sets.append(s)
            n += len(s[0])
        if n > most:
            yield at, sets
            at, sets, n = [], [], 0
    if sets:
        yield at, sets


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Every shingle that more than ``RARE`` of the documents may hold, sorted.

    One that is that common is so in some stretch of documents too, so that each stretch tells those that are in its own,
    and in two documents at least. Of all documents that makes some thousand times as many as a document has, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[n >= max(2, int(RARE * len(held)) + 1)].view(np.int64))], names=["shingle"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append(np.unique(shingles(text or "", width)))
                size += len(held[-1])
                if size >= COUNTED_SHINGLES or len(held) >= COUNTED_DOCS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = docs.select("text").mapInArrow(run, "shingle long").distinct().toPandas()["shingle"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _holders(docs: DataFrame, common, width: int, most: int = 60_000) -> DataFrame:
    """row, places and bands: which of the ``common`` shingles each document has, and the bands by which its copies are told.

    Documents with none make no rows, but are counted: a row without bands has how many documents a task has seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = common.value, 0
        ids, sets, places, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            bands = _copy_bands(sets).view(np.int64).tolist()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))], names=["row", "places", "bands"])

        for batch in slices(batches):
            rows += batch.num_rows
            if len(table):
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = np.unique(shingles(text or "", width))
                    at = np.minimum(np.searchsorted(table, found), len(table) - 1)
                    at = at[table[at] == found]
                    if len(at):
                        ids.append(row)
                        sets.append(found)
                        places.append(at.astype(np.int32))
                        n += len(found)
                    if n > most:
                        yield out()
                        ids, sets, places, n = [], [], [], 0
        if sets:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int64()))], names=["row", "places", "bands"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, "row long, places array<int>, bands array<long>")


def inverse_frequencies(docs: DataFrame, width: int = WIDTH) -> Idf:
    """The common shingles, sorted, and their weights: log(1 + documents / documents with the shingle) over its value at
    ``RARE`` of all documents (or at one document, in small tables), kept between ``LEAST_IDF`` and 1.

    Counted over all rows of ``docs`` (column text). Of documents that share a band of plain minimum hashes only the first
    counts as one with the shingle: copies of Jaccard similarity 0.85 share one with probability 0.9999, documents with a
    fifth of their shingles in common, that is of similarity 0.11, with 0.0003. Of what remains rare nothing is kept.
    """
    spark = docs.sparkSession
    asked = spark.sparkContext.broadcast(_common(docs, width))
    seen = written(_holders(docs, asked, width))
    total = float(seen.filter("bands is null").agg(F.sum("row")).first()[0] or 0)
    held = seen.filter("bands is not null")
    # Rows that are the first in each of their bands; no bucket is ever gathered.
    firsts = held.select("row", F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.min("row").alias("first")).groupBy("first").agg(F.count("*").alias("n"))
    alone = firsts.filter(F.col("n") == COPY_BANDS)
    counted = held.select("row", "places").hint("merge").join(alone, F.col("row") == F.col("first"), "left_semi")
    inner = counted.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n")).toPandas()
    discard(seen)
    common, n = asked.value[inner.place.to_numpy(np.int64)], inner.n.to_numpy(np.float64)
    idf = np.clip(np.log1p(total / np.maximum(n, 1)) / np.log1p(total / max(1.0, RARE * total)), LEAST_IDF, 1).astype(np.float32)
    order = np.argsort(common)
    order = order[idf[order] < 1]
    return common[order], idf[order]


def _signed(docs: DataFrame, idf, bands: int, rows: int, width: int) -> DataFrame:
    """row, doc_id, key and ``bands``: the hashes of each band and of each two neighbours; empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in slices(batches):
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for at, sets in _grouped([t or "" for t in batch.column(3).to_pylist()], table, width):
                one = _banded(samples(sets, bands * rows).reshape(len(sets), bands, rows))
                two = _mixed(one * np.uint64(3) + np.roll(one, -1, axis=1))
                for i, b in zip(at, np.concatenate([one, two], axis=1).view(np.int64).tolist(), strict=True):
                    found[i] = b
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["row", "doc_id", "key", "bands"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "text").mapInArrow(run, "row long, doc_id long, key binary, bands array<long>")


def _proposed(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that share a bucket, each text with its bucket's two pivots."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    # A text's number, mixed with its bucket, takes another place in each bucket's order, and can be got back.
    mixed = F.col("rep").bitwiseXOR(F.col("bucket"))
    pivots = rows.groupBy("bucket").agg(F.min(mixed).alias("p"), F.max(mixed).alias("q")).filter("p <> q")
    pivots = pivots.select("bucket", F.explode(F.array(F.col("p").bitwiseXOR(F.col("bucket")), F.col("q").bitwiseXOR(F.col("bucket")))).alias("pivot"))
    pairs = rows.join(pivots, "bucket").filter("rep <> pivot")
    return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float, width: int) -> DataFrame:
    """The pairs whose texts' weighted Jaccard similarity is ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = idf.value, (None, None)
        for batch in slices(batches):
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            keep = []
            for i in range(batch.num_rows):
                if last[0] != a[i]:
                    last = a[i], weighted(batch.column(2)[i].as_py(), table, width)
                keep.append(weighted_jaccard(last[1], weighted(batch.column(3)[i].as_py(), table, width)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # All sides of these joins grow with the documents: they are merged, never broadcast, at any size.
    with_b = pairs.hint("merge").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.hint("merge").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long")


def similar_pairs(sets: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, similarity: float, slab: int = 2048) -> np.ndarray:
    """Those of the ``wanted`` pairs (upper triangle of a boolean matrix) whose similarity is ``similarity`` or more, as rows (i, j)."""
    weight = np.asarray([w.sum(dtype=np.float64) for _, w in sets])
    wanted = wanted & (np.minimum.outer(weight, weight) >= (similarity - 1e-6) * np.maximum.outer(weight, weight))
    if wanted.sum() > 4 * len(sets):
        # Of all pairs at once, sums of the lesser weights of shared shingles, or somewhat more: at least what the exact ones are.
        column, place = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        weights = np.concatenate([w for _, w in sets])
        row = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
        shared = np.bincount(place, minlength=len(column)) > 1
        # The square root of a product is never below the lesser factor.
        root = np.sqrt(weights)
        use = shared[place]
        number = np.cumsum(shared) - 1
        column, row, root = number[place[use]], row[use], root[use]
        order = np.argsort(column, kind="stable")
        column, row, root = column[order], row[order], root[order]
        both = np.zeros((len(sets), len(sets)))
        for first in range(0, int(shared.sum()), slab):
            i, j = np.searchsorted(column, (first, first + slab))
            dense = np.zeros((len(sets), slab), np.float32)
            dense[row[i:j], column[i:j] - first] = root[i:j]
            both += dense @ dense.T
        whole = np.add.outer(weight, weight) - both
        wanted = wanted & (both >= (similarity - 1e-3) * whole)
    pairs = np.argwhere(wanted)
    return pairs[[weighted_jaccard(sets[i], sets[j]) >= similarity for i, j in pairs.tolist()]] if len(pairs) else pairs


def _open_members(reps: DataFrame, links: DataFrame, bands: int) -> DataFrame:
    """rep, root, sig, band, bucket and counts of the texts in single-band buckets that hold more than one class.

    In a bucket of three each text has met both others as pivots.
    """
    own = F.slice("bands", 1, bands)
    rooted = reps.join(links, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"), own.alias("sig"))
    rows = rooted.select("rep", "root", F.posexplode("sig").alias("band", "bucket"))
    per_root = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    per_bucket = per_root.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
    unsettled = per_bucket.filter("n > 3 and roots > 1").select("bucket", F.col("most.root").alias("main"), F.col("most.n").alias("n_main"), (F.col("n") - F.col("most.n")).alias("n_rest"))
    return rows.join(unsettled, "bucket").join(rooted.select("rep", "sig"), "rep")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """rep, root, sig, band, bucket, text and the block (i, j) for every block that the text is in.

    Texts of the bucket's largest class, which needn't meet one another, are dealt to chunks of their own, with
    numbers below 0; blocks are two chunks, of which the first isn't of these.
    """
    rest, main = (F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int") for n in ("n_rest", "n_main"))
    h = F.xxhash64("rep", "bucket")
    chunk = F.when(F.col("root") == F.col("main"), -1 - F.pmod(h, main)).otherwise(F.pmod(h, rest)).cast("int")
    rows = members.withColumn("chunk", chunk)
    others = F.transform(F.sequence(F.lit(0), rest - 1), lambda j: F.struct(F.greatest(j, F.col("chunk")).alias("i"), F.least(j, F.col("chunk")).alias("j")))
    mains = F.transform(F.sequence(-main, F.lit(-1)), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j")))
    both = F.when(F.col("chunk") < 0, others).otherwise(F.concat(others, mains))
    return rows.withColumn("at", F.explode(both)).select("rep", "root", "sig", "band", "bucket", "text", F.col("at.i").alias("i"), F.col("at.j").alias("j"))


def _block_links(members: DataFrame, texts: DataFrame, idf, similarity: float, width: int, block: int) -> DataFrame:
    """The links between texts of different classes in ``members``' buckets, all compared; each pair in its first shared band."""

    def run(table: pa.Table) -> pa.Table:
        rep, root = (np.asarray(table.column(k).to_pylist(), np.int64) for k in ("rep", "root"))
        sig = np.asarray(table.column("sig").to_pylist(), np.int64)
        equal = sig[:, None, :] == sig[None, :, :]
        wanted = np.triu((root[:, None] != root[None, :]) & (equal.argmax(axis=2) == table.column("band")[0].as_py()), 1)
        need = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
        pairs = np.empty((0, 2), np.int64)
        if len(need):
            sets = [weighted(table.column("text")[int(i)].as_py(), idf.value, width) for i in need]
            pairs = need[similar_pairs(sets, wanted[np.ix_(need, need)], similarity)]
        return pa.table({"u": rep[pairs[:, 0]], "v": rep[pairs[:, 1]]})

    rows = members.hint("merge").join(texts, "rep")
    return _blocks(rows, block).groupBy("bucket", "i", "j").applyInArrow(run, "u long, v long")


def _texts(table: DataFrame, reps: DataFrame, needed: DataFrame) -> DataFrame:
    """rep and text of the ``needed`` reps, from the first row that has the text."""
    wanted = reps.hint("merge").join(needed.select("rep").distinct(), "rep").select("rep", F.col("key").alias("_key"), F.col("first.doc_id").alias("_id"))
    return table.hint("merge").join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("rep").agg(F.min("text").alias("text"))


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.unhex(F.md5("text")))


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the text), class_id, the smallest id among its near duplicates, and kept.

    Texts alone decide. Null texts count as empty. Equal texts share a class whatever they hold; texts without words
    are alike only if equal. Rows that repeat an id, or have none, are documents of their own; where different texts
    share an id, two classes may have the same smallest id. A class whose rows all lack an id has a null one. ``kept``
    is true for one row of each class: the first by id (nulls last), and of equal ids any one row of the text with
    the smallest key. An empty table gives no rows; other columns are ignored. A pair of similarity s, at least
    ``similarity``, shares a bucket, and so a class, with probability 1 - (1 - s**rows)**bands: 0.9998 at 0.8.
    """
    spark = docs.sparkSession
    for_python(spark)
    table = _table(docs, id_col, text_col)
    idf = spark.sparkContext.broadcast(inverse_frequencies(table, width))
    signed = written(_signed(table, idf, bands, rows, width))
    # Each different text once, with a number of its own and its first row.
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    reps = written(signed.groupBy("key").agg(F.min(first).alias("first"), F.any_value("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()))
    pairs = written(_proposed(reps))
    texts = _texts(table, reps, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))))
    links = components(_verified(pairs, texts, idf, similarity, width))
    members = written(_open_members(reps, links, bands))
    if not members.isEmpty():
        more = written(_block_links(members, _texts(table, reps, members), idf, similarity, width, block))
        if not more.isEmpty():
            links = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    rooted = reps.join(links, F.col("rep") == F.col("node"), "left").select("key", "first", F.coalesce("root", "rep").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct("first.without", "first.doc_id", "key", "first.row")).alias("least"))
    classes = rooted.join(least, "root").select("key", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("_kept"))
    return signed.select("row", "doc_id", "key").join(classes, "key").select("doc_id", "key", "class_id", (F.col("row") == F.col("_kept")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one each, with all columns.

    A class keeps the text of its smallest id. Of rows that repeat that id and text the one stays whose columns, as JSON,
    have the smallest hash. Columns may be of any type and name.
    """
    # Joined and numbered by the same two columns, so that the texts are dealt once; a copy of another id goes elsewhere.
    same = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).filter("kept").select(F.col("key").alias("kept_key"), same("doc_id").alias("kept_id"))
    # Below one name the columns of ``docs`` clash with none.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), same(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"))
    rows = keyed.hint("merge").join(kept, (F.col("key") == F.col("kept_key")) & (F.col("id") == F.col("kept_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("key", "id").orderBy(F.xxhash64(F.to_json("row"))))
    return rows.withColumn("nth", nth).filter("nth = 1").select("row.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it is the one that stays."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "kept")
