"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, each a block of ``block`` words of one source. Slot t takes the point
frac((t + 1/2) * golden ratio) through the cumulative weights of the sources, so that after any number of
slots each source has had its share up to a few slots. A source's documents are shuffled by a hash, laid
end to end, twice over, and cut into such blocks; its k-th slot takes its k-th block, up to its target.
All of it is DataFrame operations. Ranks and running totals are taken in two steps, by bucket and within
it, so that a source that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import partitions, written

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK = 128
#: What the mix takes, in sizes of the whole input, and how often a source may be read.
SHARE = 1.5
EPOCHS = 2
WEIGHTS = (5.0, 2.0, 1.0)
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Documents and slots that one bucket holds, about.
_IN_BUCKET = 4096
#: Slots of a file of mixed documents, about.
_IN_FILE = 65536


def words(text: str | Column = "text") -> Column:
    """The number of words: runs of anything but blanks and the control characters from tab to return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with weight and target; one row per source, in one task.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes; no target
    exceeds ``epochs`` times its source's size. A source is full once the level L, words per unit of weight,
    reaches its limit over its weight; in the order of these ratios, running sums of limits and weights
    give the level at which all is shared out. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("limit", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.lit(share) * F.sum("source_size").over(every))
    full, light = F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if exactly the sources before this one were full; it holds for the first
    # source whose ratio is not below it, and falls from there on.
    t = t.withColumn("level", (F.col("total") - full) / (F.sum("weight").over(every) - light))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    t = t.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))))
    return t.select("source", "source_size", "weight", "target")


def _running(rows: DataFrame, group: str, bucket: str, value: str, order: list, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same group that come before, by bucket and then by ``order``."""
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col(group).alias("_group"), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = placed.join(bases, (F.col(group) == F.col("_group")) & (F.col(bucket) == F.col("_bucket")))
    return joined.withColumn(out, F.col(out) + F.col("_base")).drop("_group", "_bucket", "_base")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source_no, rank: which block of which source each slot takes. ``sources``: source_no, target.

    There are as many slots as blocks. A source's share of them may differ from its weight by a few: slots
    beyond its target are left out, and blocks without a slot follow after the last one.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("target") / block).cast("long")
    slots = sources.agg(F.sum(blocks)).first()[0] or 0
    every, before = Window.partitionBy(), Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = (F.sum("target").over(before) / F.sum("target").over(every)).alias("high")
    bounds = sources.filter("target > 0").select("source_no", blocks.alias("blocks"), high)
    bounds = bounds.select("source_no", "blocks", "high", F.lag("high", 1, 0.0).over(Window.orderBy("source_no")).alias("low"))
    points = spark.range(0, slots, 1, max(1, min(slots // 100_000 + 1, 10 * partitions(spark)))).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN}D").alias("x"))
    points = points.select("slot", (F.col("x") - F.floor("x")).alias("x"), F.floor(F.col("slot") / _IN_BUCKET).alias("bucket"))
    # Equal strips of [0, 1): a point meets the sources of its strip alone.
    strips = 1024
    strip = bounds.select("*", F.explode(F.sequence(F.floor(F.col("low") * strips), F.least(F.floor(F.col("high") * strips), F.lit(strips - 1)))).alias("strip"))
    dealt = points.withColumn("strip", F.floor(F.col("x") * strips)).join(strip, "strip").filter("x >= low and x < high")
    ranked = _running(dealt.select("slot", "bucket", "source_no", "blocks", F.lit(1).cast("long").alias("one")), "source_no", "bucket", "one", ["slot"], "rank")
    ranked = written(ranked.filter("rank < blocks").select("slot", "source_no", "rank"))
    had = ranked.groupBy("source_no").agg(F.count("*").alias("had"))
    short = sources.select("source_no", blocks.alias("blocks")).join(had, "source_no", "left").fillna(0, ["had"]).filter("had < blocks")
    late = short.select("source_no", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank"))
    late = late.select((F.row_number().over(Window.orderBy("source_no", "rank")) + (slots - 1)).cast("long").alias("slot"), "source_no", "rank")
    return ranked.unionByName(late)


def _digest(id_col: str, text_col: str, source_col: str) -> Column:
    """What documents are shuffled by. Rows that agree in id, source and text are alike to the mix."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col)]
    return F.md5(F.concat_ws("|", *own, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def mix(
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    weights: tuple[float, ...] = WEIGHTS,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes, and the mix.

    Documents: h, doc_id, source_no, at, size, source_size, target. Mix: slot, source_no, at, h, doc_id, epoch,
    first, words: the slot's words come from that pass over the document, from word ``first`` on. ``at`` is
    a document's place in its source, and tells documents that are taken apart. Null and blank texts have
    size 0 and are never taken; a null source is a source of its own; rows that repeat an id are documents
    of their own. An empty table gives two empty ones. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), _digest(id_col, text_col, source_col).alias("h"))
    rows = written(rows)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")).drop("source_rows"), share, epochs, weights)
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "_source")
    sources = sources.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sources = written(sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    # As many buckets for a source as its rows need, by the first digits of the hash.
    sized = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("n") / _IN_BUCKET))
    sized = _running(sized.withColumn("bucket", bucket), "source_no", "bucket", "size", ["h", "doc_id"], "at")
    sized = written(sized.select("h", "doc_id", "source_no", "at", "size", "source_size", "target"))
    cut = F.floor(F.col("target")).cast("long")
    passes = sized.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("start", F.col("at") + F.col("epoch") * F.col("source_size"))
    passes = passes.withColumn("end", F.least(F.col("start") + F.col("size"), cut)).filter("start < end")
    pieces = passes.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("rank"))
    lo, hi = F.greatest("start", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = pieces.select("source_no", "rank", "at", "h", "doc_id", "epoch", (lo - F.col("start")).alias("first"), (hi - lo).alias("words"))
    mixed = pieces.join(schedule(sources.select("source_no", "target"), block), ["source_no", "rank"])
    return sized, mixed.select("slot", "source_no", "at", "h", "doc_id", "epoch", "first", "words")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, block: int = BLOCK, **how) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each pass over a document, in the order of the schedule.

    A document stands where the first of its blocks does: partitions, and so files, hold consecutive stretches of
    slots, sorted. Where a source's target ends within a document, the text is cut to the words that are taken.
    Null and blank texts are never taken. Rows that agree in id, source and text, whatever their other columns
    hold, are each taken as often as the mix takes them, with the columns of the one whose columns, as JSON, have the
    smallest hash. An empty table gives no rows; no other column's name or type matters.
    """
    spark = docs.sparkSession
    sized, mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, share=share, block=block, **how)
    taken = mixed.groupBy("source_no", "at", "h", "epoch").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot")).select("h", "taken", "slot")
    # Below one name the columns of ``docs`` clash with none.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _digest(id_col, text_col, source_col).alias("digest"))
    texts = rows.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy(F.xxhash64(F.to_json("row"))))).filter("nth = 1")
    both = texts.hint("merge").join(taken, F.col("digest") == F.col("h"))
    own = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < words(own), cut).otherwise(own)
    slots = int(share * (sized.agg(F.sum("size")).first()[0] or 0) / block) + 1
    n = max(partitions(spark), slots // _IN_FILE + 1)
    part = F.least(F.floor(F.col("slot") * F.lit(n) / slots), F.lit(n - 1)).cast("int")
    placed = both.select("row", text.alias("text"), "slot", "h", part.alias("part")).repartitionById(n, F.col("part")).sortWithinPartitions("slot", "h")
    return placed.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and in which slots: the first, the last and how many blocks."""
    sized, mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mixed.groupBy("source_no", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("n_blocks"))
    # Documents of size 0 share their place with the one behind them and are never taken.
    own = lambda c: F.when(F.col("size") > 0, F.col(c))
    zero = lambda c: F.coalesce(own(c), F.lit(0)).cast("long").alias(c)
    return sized.join(taken, ["source_no", "at"], "left").select("doc_id", "size", "source_size", "target", zero("taken"), own("first_slot").alias("first_slot"), own("last_slot").alias("last_slot"), zero("n_blocks"))


OP7_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(concat_ws('|', coalesce(cast(doc_id as varchar), ''), coalesce(source, ''), md5(coalesce(text, '')))) as h
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as no
  from d group by source),
w as (
  select *, case (no - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as lim
  from s),
l as (
  select *, (1.5::double * (select sum(source_size) from s) - coalesce(sum(lim) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
  from w window b as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (
  select no, source, source_size,
         least(lim, coalesce((select max(level) from l where level <= lim / weight) * weight, lim)) as target
  from l),
p as (
  select t.no, d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) over (partition by d.source order by h, d.doc_id rows between unbounded preceding and 1 preceding), 0) as pos
  from d join t on d.source is not distinct from t.source),
c as (select no, cast(ceil(target / 128) as bigint) as blocks, sum(target) over (order by no) / sum(target) over () as high from t where target > 0),
b as (select *, coalesce(lag(high) over (order by no), 0.0::double) as low from c),
n as (select coalesce(cast(sum(blocks) as bigint), 0) as slots from c),
x as (select i as slot, (i + 0.5::double) * 0.6180339887498949::double as x from range((select slots from n)) g(i)),
k as (
  select slot, no, rank from (
    select slot, no, blocks, row_number() over (partition by no order by slot) - 1 as rank
    from x join b on x - floor(x) >= low and x - floor(x) < high)
  where rank < blocks),
late as (
  select (select slots from n) + row_number() over (order by no, rank) - 1 as slot, no, rank
  from (select no, unnest(range(coalesce((select count(*) from k where k.no = b.no), 0), blocks)) as rank from b)),
z as (select * from k union all select * from late),
e as (
  select *, row_number() over () as r,
         least(pos + size, floor(target)) as end0, least(pos + source_size + size, floor(target)) as end1, pos + source_size as pos1
  from p),
q as (
  select r, no, min(a) as a, max(o) as o, sum(o - a + 1) as n from (
    select r, no, cast(pos // 128 as bigint) as a, cast(end0 - 1 as bigint) // 128 as o from e where size > 0 and pos < end0
    union all
    select r, no, cast(pos1 // 128 as bigint), cast(end1 - 1 as bigint) // 128 from e where size > 0 and pos1 < end1)
  group by r, no)
select doc_id, size, source_size, target,
       cast(greatest(0, end0 - pos) + greatest(0, end1 - pos1) as bigint) as taken, f.slot as first_slot, g.slot as last_slot, cast(coalesce(n, 0) as bigint) as n_blocks
from e left join q using (r) left join z f on f.no = q.no and f.rank = q.a left join z g on g.no = q.no and g.rank = q.o
"""
