"""The trie of conversations' common beginnings, with sums over its subtrees by heavy paths.

A node is a distinct sequence of first turns. It is known by the sum of hashes of its turns and their places,
so that a conversation's nodes are running sums, taken in two steps, however long it is. The child of a node
with most conversations is its heavy one. Each node that isn't a heavy child begins a path, which goes down
by heavy children to a leaf; as a light child has half of its parent's conversations at most, a way from the
root meets no more light children than the logarithm of the conversations. Subtree sums are suffix sums along
the paths: those furthest from the root, by light children, come first, and what they give is attached to
their parents, which stand on paths of the next round.

No step goes through the depths one by one. A node that many rows ask about is sent to them; there are fewer
than ``OFTEN`` such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import discard, for_python, partitions, slices, written

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that borrow turns do so from the first of so many, up to so many less one.
FAMILY = 20
BORROWED = 4
#: Turns of a conversation, and nodes of a path, that are summed up at a time.
STRETCH = 1024
#: A row of a table that is asked for by more than this part of all askers is broadcast: fewer than so many rows are.
OFTEN = 1000
#: Identifiers that are joined to one string before they are hashed.
IDS = 10_000
_ROOT = "unhex(md5('0|0|0'))"


def _asked(rows: DataFrame, answers: DataFrame, on: str, hits: str, total: int) -> DataFrame:
    """``rows`` joined with the row of ``answers`` for their ``on``; rows without one go.

    ``answers`` has one row for each key, and in ``hits`` how many rows ask for it; these sum up to ``total`` at most. So
    fewer than OFTEN keys are asked for by more than an OFTENth of all, and these are broadcast.
    """
    often = F.col(hits) * OFTEN > total
    few = answers.filter(often)
    rest = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(answers.filter(~often), on)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def _running(rows: DataFrame, group: str, place: str, sums: dict[str, Column], down: bool = False) -> DataFrame:
    """``rows`` with running sums over each group in the order of ``place``, own row included; ``down`` from the largest.

    In two steps, so that a group of any size is spread over tasks: by stretches of STRETCH places, and within each.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(place) / STRETCH))
    parts = rows.groupBy(F.col(group).alias("_group"), F.col("_stretch").alias("_at")).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    order = lambda c: F.col(c).desc() if down else F.col(c).asc()
    before = Window.partitionBy("_group").orderBy(order("_at")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    bases = parts.select("_group", "_at", *[F.coalesce(F.sum(f"_{n}").over(before), zero).alias(f"_{n}") for n in sums])
    within = Window.partitionBy(group, "_stretch").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    both = rows.join(bases, (F.col(group) == F.col("_group")) & (F.col("_stretch") == F.col("_at")))
    return both.withColumns({n: (F.col(n) + F.col(f"_{n}")) for n in sums}).drop("_group", "_at", "_stretch", *[f"_{n}" for n in sums])


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns, dealt by ranges: conv_id, part, turn, digest, words; and how many each part has: conv_id, part, n.

    Turns go by number, null first, and then by the digest of role and text. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()))
    return dealt, dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))


def _placed(dealt: DataFrame, sizes: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns with ``at``, their number in the conversation from 1, and the columns of ``convs``."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(convs, "conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return dealt.withColumn("nth", nth).join(starts, ["conv_id", "part"]).withColumn("at", (F.col("nth") + F.col("before")).cast("long"))


def own_turns(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation as it is: its turns (conv_id, depth, digest, words), and all conversations (conv_id)."""
    dealt, sizes = ordered_turns(conversations, **columns)
    convs = sizes.select("conv_id").distinct()
    return _placed(dealt, sizes, convs).select("conv_id", F.col("at").alias("depth"), "digest", "words"), convs


def rebuilt_turns(conversations: DataFrame, family: int = FAMILY, borrowed: int = BORROWED, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first turns replaced by those of the first of its family of ``family`` ids.

    As many as the checksum of its id says, fewer than ``borrowed``: its own first ones go, and the other's come, as far as
    it has them. Returns turns and conversations as ``own_turns`` does; a conversation may be left without turns.
    """
    dealt, sizes = ordered_turns(conversations, **columns)
    sizes = written(sizes)
    convs = sizes.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed).alias("gone"))
    lengths = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("has"))
    convs = written(convs.join(lengths, "first", "left").select("conv_id", "first", "gone", F.least("gone", F.coalesce("has", F.lit(0))).alias("come")))
    placed = written(_placed(dealt, sizes, convs).select("conv_id", "at", "gone", "come", "digest", "words"))
    own = placed.filter("at > gone").select("conv_id", (F.col("come") + F.col("at") - F.col("gone")).alias("depth"), "digest", "words")
    heads = placed.filter((F.col("at") < borrowed) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("first"), F.col("at").alias("depth"), "digest", "words")
    come = convs.join(heads, "first").filter("depth <= come").select("conv_id", "depth", "digest", "words")
    return own.unionByName(come), convs.select("conv_id")


def _members(turns: DataFrame) -> DataFrame:
    """A row for each turn of each conversation: conv_id, depth, key and parent (of the nodes), words."""
    mark = F.sha2(F.concat_ws("|", F.col("depth").cast("string"), F.hex("digest")), 256)
    number = lambda i: F.conv(F.substring(mark, i, 15), 16, 10).cast("decimal(38,0)")
    rows = turns.select("conv_id", "depth", "words", number(1).alias("a"), number(16).alias("b"))
    rows = _running(rows, "conv_id", "depth", {"x": F.col("a"), "y": F.col("b")})
    key = lambda *of: F.unhex(F.md5(F.concat_ws("|", *[c.cast("string") for c in of])))
    whole = [F.col(c).cast("decimal(38,0)") for c in ("x", "y")]
    less = [(F.col(c) - F.col(o)).cast("decimal(38,0)") for c, o in (("x", "a"), ("y", "b"))]
    return rows.select("conv_id", "depth", "words", key(F.col("depth"), *whole).alias("key"), key(F.col("depth") - 1, *less).alias("parent"))


def _ends(members: DataFrame, convs: DataFrame) -> DataFrame:
    """key and ends_sha256: the hash of the ids of the conversations that end at each node.

    Ids are sorted by ranges and joined to strings of IDS ids there. A hash takes its strings in order, one by one.
    """
    last = members.groupBy("conv_id").agg(F.max(F.struct("depth", "key"))["key"].alias("key"))
    rows = convs.join(last, "conv_id", "left").select(F.coalesce("key", F.expr(_ROOT)).alias("key"), "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, ids = TaskContext.get().partitionId() << 33, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([at], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "at", "ids"])

        for batch in slices(batches, IDS):
            for k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (k != key or len(ids) == IDS):
                    yield out()
                    at, ids = at + 1, []
                key = k
                ids.append(i)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in slices(batches, 64):
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    done += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for_python(members.sparkSession)
    sorted_ = rows.repartitionByRange(partitions(members.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    strings = sorted_.mapInArrow(joined, "key binary, at long, ids string")
    return strings.repartition("key").sortWithinPartitions("key", "at").mapInArrow(hashed, "key binary, ends_sha256 string")


def _nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes with their parents, and with the paths that they stand on: head, and light, the number of light children on the way."""
    total = members.count()
    nodes = members.groupBy("key", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    none = F.lit(None)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.expr(_ROOT).alias("key"), none.cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    nodes = written(nodes.unionByName(root))
    # Of equally large children the one with the smallest conversation is heavy.
    children = nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.min(F.struct((-F.col("n_convs")).alias("n"), "conv_id"))["conv_id"].alias("heavy"))
    parents = written(nodes.join(children.withColumnRenamed("parent", "key"), "key").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children", "heavy"))
    counts = nodes.join(parents.select(F.col("parent").alias("key"), "n_children"), "key", "left").fillna(0, ["n_children"])
    n = nodes.count()
    asked = _asked(counts.filter("depth > 0").withColumnRenamed("n_children", "own_children"), parents, "parent", "n_children", n)
    light = F.col("conv_id") != F.col("heavy")
    below = asked.select("key", "parent", "depth", "words", "conv_id", "n_convs", "parent_conv_id", F.col("own_children").alias("n_children"), light.alias("is_light"))
    top = counts.filter("depth = 0").select("key", "parent", "depth", "words", "conv_id", "n_convs", none.cast("long").alias("parent_conv_id"), "n_children", F.lit(False).alias("is_light"))
    nodes = written(below.unionByName(top))
    # A conversation meets few light nodes: their depths and keys, in order.
    met = _asked(members.select("conv_id", "key"), nodes.filter("is_light").select("key", "depth", "n_convs"), "key", "n_convs", total)
    ways = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "key"))).alias("way"))
    stood = nodes.groupBy("conv_id").agg(F.count("*").alias("stood"))
    ways = written(stood.join(ways, "conv_id", "left").select("conv_id", "stood", F.coalesce("way", F.array().cast("array<struct<depth:bigint,key:binary>>")).alias("way")))
    nodes = _asked(nodes, ways, "conv_id", "stood", n)
    upto = F.filter("way", lambda x: x["depth"] <= F.col("depth"))
    nodes = nodes.withColumn("light", F.size(upto)).withColumn("head", F.when(F.col("light") > 0, F.element_at(upto, -1)["key"]).otherwise(F.expr(_ROOT)))
    saved = (F.col("n_convs") - 1) * F.col("words")
    return written(nodes.select("key", "parent", "head", "light", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", saved.alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, depth (1, 2, 3 … without gaps), digest, words; ``convs``: conv_id, once each, turnless ones too. A
    node's conv_id is the smallest of its conversations; with the depth it names the node. The root has depth 0 and no
    parent. saved_tokens sums, over the subtree, the words of a node's last turn times its conversations less one. Without
    conversations there are no nodes. Two sequences count as one if two sums of 60-bit hashes agree.
    """
    members = written(_members(turns))
    convs = written(convs)
    nodes = _nodes(members, convs)
    rounds = nodes.agg(F.max("light")).first()[0]
    done, given = [], None
    for light in range(rounds if rounds is not None else -1, -1, -1):
        rows = nodes.filter(F.col("light") == light)
        if given is not None:
            rows = rows.join(given, "key", "left")
            rows = rows.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("saved", "leaves")}).drop("more_saved", "more_leaves")
        sums = written(_running(rows, "head", "depth", {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")}, down=True))
        heads = sums.filter("key = head and depth > 0")
        given = heads.groupBy(F.col("parent").alias("key")).agg(F.sum("saved_tokens").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))
        done.append(sums)
    every = done[0] if done else nodes.withColumns({"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")})
    for sums in done[1:]:
        every = every.unionByName(sums)
    every = every.join(_ends(members, convs), "key", "left")
    whole = lambda c: F.col(c).cast("long").alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    out = every.select("conv_id", whole("depth"), "parent_conv_id", "n_convs", whole("n_children"), whole("n_leaves"), whole("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    out = written(out)
    discard(members, convs, nodes, *done)
    return out


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they are, as ``trie`` has it.

    Null roles and texts are empty, null turns come first, turns of one number stand by a digest of role and text, and rows
    that repeat a turn are turns of their own. Rows without a conversation are left out; other columns are ignored.
    """
    return trie(*own_turns(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of its family's first."""
    return trie(*rebuilt_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP13_SQL = r"""
with crc as (
  select list(c order by n) as t from (
    select n, list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n) as c from range(256) r(n))),
t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, dg) as at, dg, words from (
    select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as dg, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null)),
c as (
  select conv_id, n, conv_id - conv_id % 20 as b,
         xor(list_reduce(list_transform(range(cast(octet_length(encode(cast(conv_id as varchar))) as bigint)), lambda i: cast('0x' || substr(hex(encode(cast(conv_id as varchar))), 2 * i + 1, 2) as bigint)),
                         lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 4 as h
  from (select conv_id, count(*) as n from t group by conv_id), crc),
e as (select c.conv_id, c.b, c.h, least(c.h, coalesce(o.n, 0)) as m from c left join c o on o.conv_id = c.b),
r as (
  select e.conv_id, t.at as d, dg, words from e join t on t.conv_id = e.b and t.at <= e.m
  union all select e.conv_id, m + t.at - h, dg, words from e join t on t.conv_id = e.conv_id and t.at > h),
p as (
  select conv_id, d, words, md5(string_agg(dg, '') over (partition by conv_id order by d)) as key from r
  union all select conv_id, 0, 0, 'root' from e),
q as (select *, lag(key) over (partition by conv_id order by d) as parent, d = max(d) over (partition by conv_id) as last from p),
n as (select key, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved, any_value(parent) as parent from q group by key, d),
k as (select parent, count(*) as n_children from n where d > 0 group by parent),
s as (select q.key, sum(n.saved) as saved_tokens, count(*) filter (where n.key not in (select parent from k)) as n_leaves from n join q on q.conv_id = n.conv_id and q.d <= n.d group by q.key),
z as (select key, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends_sha256 from q where last group by key)
select n.conv_id, n.d as depth, o.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from n left join n o on o.key = n.parent left join k on k.parent = n.key join s on s.key = n.key left join z on z.key = n.key
"""
