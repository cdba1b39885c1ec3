"""Importance resampling of documents towards a target distribution, by hashed features and an integer word dictionary.

Texts are read in blocks. A block numbers its own words and runs of words and passes them on once each, however
often they occur; its documents keep numbers. Distinct words of all blocks become one dictionary of ids, runs of
words tuples of ids. Each distinct tuple's bytes are put together and hashed once, its counts over all documents
and all target texts make the gain of its bucket, and gains go back to the blocks, where they are summed over
each document's features. So strings are moved and hashed by distinct words and tuples, not by occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, partitions, slices, written

#: Words of a feature at most, and buckets of features.
LONGEST = 1
BUCKETS = 10_000
#: Of the documents with so many words, so many of a hundred are drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text and documents of a block, about; and of the part of a long text that is split at a time.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 65536
PART_BYTES = 1 << 20
#: Bytes of words in lower case; all others part words.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Numbers(dict):
    """Numbers its keys in the order in which they are asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def split_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, A-Z lower-cased, part by part, so that a long text's are never all there at once."""
    start, size = 0, len(text)
    while start < size:
        end = min(start + PART_BYTES, size)
        part = text[start:end].translate(_WORDS)
        if end < size and not part.endswith(b" "):
            # The last word may go on: it begins the next part, unless it is all of this one.
            cut = part.rfind(b" ") + 1
            while cut == 0 and end < size:
                more = text[end : end + PART_BYTES].translate(_WORDS)
                stop = more.find(b" ")
                part, end = part + (more if stop < 0 else more[:stop]), min(end + (len(more) if stop < 0 else stop), size)
                if stop >= 0:
                    break
            if cut:
                part, end = part[:cut], start + cut
        yield part.split()
        start = end


class Block:
    """The dictionary of a block: numbers of its words, and of its runs of words as tuples of these."""

    def __init__(self, longest: int):
        self.longest, self.words, self.runs = longest, Numbers(), Numbers()
        self.counts = np.zeros(1024, np.int64)
        self.bytes = self.rows = 0

    def features(self, text: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Words, features, and the numbers of the different features with how often each occurs."""
        self.bytes, self.rows = self.bytes + len(text), self.rows + 1
        parts = [np.fromiter(map(self.words.__getitem__, p), np.int32, len(p)) for p in split_words(text)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        if self.longest == 1:
            found, size = ids, len(self.words)
        else:
            own = ids.tolist()
            runs = [np.fromiter(map(self.runs.__getitem__, zip(*(own[j:] for j in range(k)), strict=False)), np.int32) for k in range(1, self.longest + 1)]
            found, size = np.concatenate(runs), len(self.runs)
        different, times = np.unique(found, return_counts=True)
        if size > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(2 * size - len(self.counts), np.int64)])
        self.counts[different] += times
        return len(ids), len(found), different, times.astype(np.int32)

    def table(self) -> dict:
        """The words in the order of their numbers, the tuples, and how often each occurs."""
        tuples = [[i] for i in range(len(self.words))] if self.longest == 1 else [list(t) for t in self.runs]
        return {"words": list(self.words), "tuples": tuples, "counts": self.counts[: len(tuples)].tolist()}


def blocks(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Texts in blocks, written. ``rows``: target (boolean), row, doc_id, text.

    Rows of documents: block, target, row, doc_id, n_words, n_features, grams (numbers within the block), times. One more
    row for each block: block, target, words, tuples (numbers of words), counts. No block holds both sides.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, target boolean, row long, doc_id {id_type}, n_words long, n_features long, grams array<int>, times array<int>, words array<binary>, tuples array<array<int>>, counts array<long>"
    wanted = rows.select("target", "row", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        block, side = Block(longest), None
        kinds = dict(zip(["block", "target", "row", "n_words", "n_features", "grams", "times", "words", "tuples", "counts"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())], strict=True))

        def out(doc_ids: pa.Array, **columns) -> pa.RecordBatch:
            n = len(doc_ids)
            found = {c: columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()}
            found["doc_id"] = doc_ids
            names = ["block", "target", "row", "doc_id", *list(kinds)[3:]]
            return pa.RecordBatch.from_arrays([found[c] for c in names], names=names)

        def lists(arrays: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32), pa.int32()))

        kind = None
        for batch in slices(batches, 500):
            kind = batch.column("doc_id").type
            ids, sides, own, texts = batch.column("doc_id"), batch.column("target").to_pylist(), batch.column("row"), batch.column("text")
            done, held = 0, []
            for i in range(batch.num_rows + 1):
                # A block ends with its bytes, its rows or its side; what it has so far goes out first.
                ends = i < batch.num_rows and side is not None and (sides[i] != side or block.bytes >= BLOCK_BYTES or block.rows >= BLOCK_ROWS)
                if held and (ends or i == batch.num_rows):
                    w, f, d, t = zip(*held, strict=True)
                    yield out(ids.slice(done, len(held)), block=[first + made] * len(held), target=[side] * len(held), row=own.slice(done, len(held)), n_words=list(w), n_features=list(f), grams=lists(list(d)), times=lists(list(t)))
                    done, held = i, []
                if ends:
                    yield out(pa.nulls(1, kind), block=[first + made], target=[side], **{c: [v] for c, v in block.table().items()})
                    block, made = Block(longest), made + 1
                if i < batch.num_rows:
                    side = sides[i]
                    held.append(block.features(texts[i].as_py()))
        if side is not None:
            yield out(pa.nulls(1, kind), block=[first + made], target=[side], **{c: [v] for c, v in block.table().items()})

    for_python(rows.sparkSession)
    return written(wanted.mapInArrow(run, schema))


def gains(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """block and its features' gains, in the order of their numbers. ``found``: what ``blocks`` gives."""
    tables = found.filter("words is not null")
    words = tables.select("block", F.posexplode("words").alias("local", "word"))
    dictionary = written(words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("id")))
    ids = words.join(dictionary, "word").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", "id"))), lambda x: x["id"]).alias("ids"))
    own = tables.select("block", "target", "tuples", "counts").join(ids, "block")
    own = own.select("block", "target", F.posexplode(F.arrays_zip(F.expr("transform(tuples, t -> transform(t, i -> ids[i]))").alias("tuple"), "counts")).alias("gram", "x"))
    own = written(own.select("block", "target", "gram", "x.tuple", F.col("x.counts").alias("n")))
    count = lambda side: F.coalesce(F.sum(F.when(F.col("target") == side, F.col("n"))), F.lit(0))
    distinct = own.groupBy("tuple").agg(count(False).alias("s"), count(True).alias("t"))
    # Each distinct tuple's bytes are put together and hashed here, and nowhere else.
    places = distinct.select("tuple", "s", "t", F.posexplode("tuple").alias("place", "id")).join(dictionary, "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ")
    hashed = places.groupBy("tuple").agg(F.first("s").alias("s"), F.first("t").alias("t"), F.crc32(text.cast("binary")).alias("crc"))
    hashed = written(hashed.select("tuple", "s", "t", F.pmod("crc", F.lit(buckets)).cast("int").alias("bucket")))
    sums = hashed.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    every, target = (float(x) for x in hashed.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first())
    ratio = (F.col("t") + 1.0) * (every + buckets) / ((F.col("s") + 1.0) * (target + buckets))
    by_bucket = sums.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("int").alias("gain"))
    by_tuple = hashed.select("tuple", "bucket").join(F.broadcast(by_bucket), "bucket").select("tuple", "gain")  # one row a bucket
    back = own.filter("not target").join(by_tuple, "tuple").select("block", "gram", "gain")
    return back.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "gain"))), lambda x: x["gain"]).alias("gains"))


def weighed(found: DataFrame, gain: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of each document: the sum of its features' gains."""
    docs = found.filter("words is null and not target").select("block", "row", "doc_id", "n_words", "n_features", "grams", "times")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        worth = right["gains"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        grams, times = left["grams"].combine_chunks(), left["times"].combine_chunks()
        if isinstance(grams, pa.ChunkedArray):
            grams, times = pa.concat_arrays(grams.chunks), pa.concat_arrays(times.chunks)
        sizes = np.diff(grams.offsets.to_numpy(zero_copy_only=False)) if len(grams) else np.empty(0, np.int64)
        # Sums between the ends of each document's stretch, so that empty ones give 0.
        upto = np.concatenate([[0], np.cumsum(worth[grams.flatten().to_numpy()] * times.flatten().to_numpy())]) if len(worth) else np.zeros(1, np.int64)
        ends = np.cumsum(sizes)
        weight = upto[ends] - upto[ends - sizes]
        return left.select(["row", "doc_id", "n_words", "n_features"]).append_column("weight", pa.array(weight, pa.int64()))

    out = f"row long, doc_id {id_type}, n_words long, n_features long, weight long"
    return docs.groupBy("block").cogroup(gain.groupBy("block")).applyInArrow(run, out)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (doc_id, n_words, score, …) with rank: 1, 2, 3 … of those drawn, by falling score and then by id.

    Rows are dealt by ranges of that order and numbered range by range; only the ranges' sizes are added up at one place.
    """
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    can = rows.filter(F.col("n_words") >= least_words)
    can = written(can.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    sizes = can.groupBy("part").agg(F.count("*").alias("n"))
    most = (sizes.agg(F.sum("n")).first()[0] or 0) * percent // 100
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    can = can.join(F.broadcast(starts), "part").withColumn("rank", nth.cast("long"))
    can = can.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).select(*rows.columns, "rank")
    rest = rows.filter(~F.coalesce(F.col("n_words") >= least_words, F.lit(False)))
    return can.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """row, doc_id, n_features, weight, score, rank of each row of ``docs``; rank is null where it isn't drawn.

    Features are all runs of 1 to ``longest`` words; a bucket's gain compares its share in ``target`` with that in
    ``docs``, and a document's weight is the sum over its features. Scores add a draw from a Gumbel distribution, by a
    hash of ``seed`` and the id, so that the highest are a sample in proportion to the weights' exponents. Null texts
    have no features, weight 0 and are not drawn; a null id counts as an empty one and comes last among ties; rows that
    repeat an id are documents of their own. Either table may be empty. Other columns are ignored. A block's words are
    held at one place, and a word or the numbers of one text's words whole.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    own = docs.select(F.lit(False).alias("target"), number.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    none = F.lit(None)
    goal = target.select(F.lit(True).alias("target"), none.cast("long").alias("row"), none.cast(own.schema["doc_id"].dataType).alias("doc_id"), F.col(target_col).cast("string").alias("text"))
    found = blocks(own.unionByName(goal), longest)
    rows = weighed(found, gains(found, buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))
    rows = written(rows.withColumn("score", (F.col("weight") + noise).cast("long")))
    return ranked(rows, percent, least_words).select("row", "doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns, of whatever names and types; in no order."""
    kept = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")))
    id_col, text_col = how.pop("id_col", "doc_id"), how.pop("text_col", "text")
    rows = kept.select("row", F.col("own").getField(id_col).alias("doc_id"), F.col("own").getField(text_col).alias("text"))
    drawn = resample(rows, target, row="row", **how).filter("rank is not null").select("row")
    return kept.join(drawn, "row").select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and rank towards the benchmark's texts."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark")).drop("row")


OP11_SQL = r"""
with crc as (
  select list(c order by n) as t from (
    select n, list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n) as c from range(256) r(n))),
w as (
  select doc_id, false as target, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
d as (select doc_id, unnest(words) as word from w),
u as (
  select word, sum(s) as s, sum(t) as t from (
    select word, 1 as s, 0 as t from d union all select unnest(words), 0, 1 from b) group by word),
h as (
  select word, u.s, u.t,
         xor(list_reduce(list_transform(range(cast(octet_length(encode(word)) as bigint)), lambda i: cast('0x' || substr(hex(encode(word)), 2 * i + 1, 2) as bigint)),
                         lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket
  from u, crc),
n as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from h),
g as (
  select bucket, cast(floor(1000 * ln((sum(h.t) + 1) * (any_value(n.s) + 10000) / ((sum(h.s) + 1) * (any_value(n.t) + 10000)))) as bigint) as gain
  from h, n group by bucket),
x as (select doc_id, count(*) as n_features, sum(gain) as weight from d join h using (word) join g using (bucket) group by doc_id),
y as (
  select doc_id, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from documents left join x using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from y where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select count(*) from r) * 10 // 100 then rank end as rank
from y left join r using (doc_id)
"""
