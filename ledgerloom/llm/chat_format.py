"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, from a user
turn to an assistant turn. Turns that break this are merged into the turn before, given another role, or
parted by an empty turn; dynamic programming over the automaton finds the cheapest such repairs.

Turns are range-partitioned and sorted, and cut into chunks of bounded length. A chunk's costs between all
pairs of states form a matrix, and such matrices compose; so a conversation of any length is solved by
composing chunks level by level, fixing the states where chunks meet from the top down, and then repairing
each chunk by itself. The rendered conversation is the concatenation of its turns' pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import for_python, partitions, slices, written

#: States are the role of the last turn; 0 is the beginning.
ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
#: Turns of a chunk, and chunks that are composed at once.
CHUNK = 512
#: Characters of a chunk's texts, about, and turns up to which what is worked out is remembered.
CHUNK_CHARS = 4 << 20
REMEMBERED = 16
_FAR = 1 << 60
#: Empty turns that must stand between a state and the next role; a pair that is missing cannot follow.
_BETWEEN = {(0, 1): (), (0, 2): (), (0, 3): (2,), (1, 2): (), (1, 3): (2,), (2, 3): (), (2, 2): (3,), (3, 2): (), (3, 3): (2,)}
#: Empty turns that close a conversation.
_CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


@lru_cache(maxsize=256)
def moves(role: str | None) -> tuple[tuple[int, int, int, bool, tuple[int, ...]], ...]:
    """What a turn of that role can do: (state before, state after, cost, merged, roles inserted before it)."""
    found = []
    for to, name in enumerate(ROLES, 1):
        new = 0 if role == name else RELABEL
        for state in range(4):
            ways = [(new + MERGE, True, ())] if state == to else []
            if (state, to) in _BETWEEN:
                ways.append((new + INSERT * len(_BETWEEN[state, to]), False, _BETWEEN[state, to]))
            if ways:
                found.append((state, to, *min(ways)))
    return tuple(found)


def _known(roles: tuple[str | None, ...]) -> tuple[str, ...]:
    """The roles with one name for all that are unknown, so that few short rows of roles differ."""
    return tuple(r if r in ROLES else "" for r in roles)


def matrix(roles: tuple[str | None, ...]) -> tuple[int, ...]:
    """Least costs from each state to each, row by row, over these turns; remembered for short rows of turns alone."""
    return (_matrix if len(roles) <= REMEMBERED else _matrix.__wrapped__)(_known(roles))


@lru_cache(maxsize=20_000)
def _matrix(roles: tuple[str, ...]) -> tuple[int, ...]:
    out = []
    for start in range(4):
        cost = [_FAR] * 4
        cost[start] = 0
        for role in roles:
            new = [_FAR] * 4
            for a, b, c, _, _ in moves(role):
                if cost[a] + c < new[b]:
                    new[b] = cost[a] + c
            cost = new
        out += cost
    return tuple(min(c, _FAR) for c in out)


def composed(matrices: list[list[int]]) -> list[int]:
    """The matrix of a row of matrices."""
    total = [0 if a == b else _FAR for a in range(4) for b in range(4)]
    for m in matrices:
        total = [min(min(total[4 * a + k] + m[4 * k + b] for k in range(4)), _FAR) for a in range(4) for b in range(4)]
    return total


def ends(m: list[int]) -> tuple[int, int]:
    """The cheapest last state of a whole conversation, and its cost."""
    cost, state = min((m[b] + INSERT * len(_CLOSING[b]), b) for b in range(4))
    return state, cost


def between(matrices: list[list[int]], start: int, end: int) -> list[int]:
    """The states before each of the matrices on a cheapest way from ``start`` to ``end``, and ``end``."""
    cost, back = [0 if s == start else _FAR for s in range(4)], []
    for m in matrices:
        best = [min((min(cost[a] + m[4 * a + b], _FAR), a) for a in range(4)) for b in range(4)]
        cost = [c for c, _ in best]
        back.append([a for _, a in best])
    way = [end]
    for b in reversed(back):
        way.append(b[way[-1]])
    return way[::-1]


def repaired(roles: tuple[str | None, ...], start: int, end: int) -> tuple[tuple[int, bool, tuple[int, ...]], ...]:
    """(new role, merged, roles inserted before) of each turn, at the least cost from ``start`` to ``end``; remembered likewise."""
    return (_repaired if len(roles) <= REMEMBERED else _repaired.__wrapped__)(_known(roles), start, end)


@lru_cache(maxsize=20_000)
def _repaired(roles: tuple[str, ...], start: int, end: int) -> tuple[tuple[int, bool, tuple[int, ...]], ...]:
    way = between([list(matrix((r,))) for r in roles], start, end)
    out = []
    for role, a, b in zip(roles, way, way[1:], strict=False):
        _, to, _, merged, inserted = next(m for m in moves(role) if m[0] == a and m[1] == b)
        out.append((to, merged, inserted))
    return tuple(out)


def _opened(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


_CLOSED = "<|end|>\n"


def _pieces(texts: list[str], fixes, start: int, last: bool) -> list[str]:
    out, state = [], start
    for text, (to, merged, inserted) in zip(texts, fixes, strict=True):
        piece = "\n" if merged else (_CLOSED if state else "") + "".join(_opened(r) + _CLOSED for r in inserted) + _opened(to)
        out.append(piece + text)
        state = to
    if last and out:
        out[-1] += _CLOSED + "".join(_opened(r) + _CLOSED for r in _CLOSING[state])
    return out


def _chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """conv_id, part, no (both in order), turns, roles, texts, m: sorted turns of one conversation, ``chunk`` at most."""
    kind = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("no", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("m", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, conv, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in slices(batches):
            done = []
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (c != conv or len(held) == chunk or size > CHUNK_CHARS):
                    done.append((conv, held))
                    held, size = [], 0
                conv, size = c, size + len(row[-1])
                held.append(row)
            if done:
                yield emitted(done, part, no)
                no += len(done)
        if held:
            yield emitted([(conv, held)], part, no)

    def emitted(done, part, no) -> pa.RecordBatch:
        rows = []
        for k, (c, held) in enumerate(done):
            t, roles, texts = zip(*held, strict=True)
            rows.append({"conv_id": c, "part": part, "no": no + k, "turns": t, "roles": roles, "texts": texts, "m": matrix(roles)})
        return pa.RecordBatch.from_pylist(rows, schema=kind)

    order = ["conv_id", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text")]
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order, "text")
    return dealt.mapInArrow(run, "conv_id long, part long, no long, turns array<long>, roles array<string>, texts array<string>, m array<long>")


def _solved(rows: DataFrame, together: int) -> DataFrame:
    """``rows`` (conv, i, m; several a conversation) with start and end: the states around each, level by level."""
    grouped = rows.withColumn("up", F.floor(F.col("i") / together))

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        ms = table.sort_by("i")["m"].to_pylist()
        return pa.table({"conv": pa.array([key[0].as_py()], pa.int64()), "i": pa.array([key[1].as_py()], pa.int64()), "m": pa.array([composed(ms)], pa.list_(pa.int64()))})

    up = written(grouped.groupBy("conv", "up").applyInArrow(compose, "conv long, i long, m array<long>"))
    if up.groupBy("conv").count().filter("count > 1").isEmpty():
        closing = ", ".join(str(INSERT * len(_CLOSING[b])) for b in range(4))
        end = F.expr(f"array_min(transform(array({closing}), (c, b) -> named_struct('cost', m[b] + c, 'b', b))).b")  # as ``ends``
        above = up.select(F.col("conv"), F.col("i").alias("up"), F.lit(0).alias("start"), end.alias("end"))
    else:
        above = _solved(up, together).select("conv", F.col("i").alias("up"), "start", "end")
    joined = grouped.join(above.withColumnRenamed("conv", "_conv").withColumnRenamed("up", "_up"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("up") == F.col("_up")))

    def split(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        way = between(table["m"].to_pylist(), table["start"][0].as_py(), table["end"][0].as_py())
        return pa.table({"conv": table["conv"], "i": table["i"], "start": pa.array(way[:-1], pa.int32()), "end": pa.array(way[1:], pa.int32())})

    return written(joined.groupBy("conv", "up").applyInArrow(split, "conv long, i long, start int, end int"))


def repair(turns: DataFrame, chunk: int = CHUNK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, inserted, piece.

    action is keep, relabel, merge or relabel+merge; inserted names the empty turns before this one; piece is
    the turn's part of the rendered conversation, in which the last one closes it, with empty turns if need
    be. Turns stand in the order of turn and role, nulls last, and then of the texts' hashes; equal rows are
    turns of their own. Unknown and null roles are relabelled; null texts are empty; rows with a null conversation form one
    conversation. An empty table gives no rows; extra columns are ignored.
    """
    for_python(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = written(_chunks(rows, chunk))
    # Only conversations that a chunk or a partition cuts need more than their own chunk; all else is solved at once.
    several = chunks.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.struct("part", "no")).alias("first")).filter("n > 1").select(F.col("conv_id").alias("conv"), "n")
    cut = chunks.select("conv_id", "part", "no", "m").join(several, F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi")
    cut = written(_numbered(cut))
    states = _solved(cut.select(F.col("conv_id").alias("conv"), "i", "m"), max(2, chunk)) if not cut.isEmpty() else None
    if states is not None:
        placed = cut.join(states.withColumnRenamed("i", "_i"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("i") == F.col("_i"))).select(F.col("part").alias("_part"), F.col("no").alias("_no"), "start", "end", "last")
        chunks = chunks.join(placed, (F.col("part") == F.col("_part")) & (F.col("no") == F.col("_no")), "left")
    else:
        chunks = chunks.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("boolean").alias("last"))

    kind = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.list_(pa.string())), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns: list[list] = [[] for _ in kind]
            for conv, turn, roles, texts, m, start, end, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if start is None:
                    start, end, last = 0, ends(m)[0], True
                fixes = repaired(tuple(roles), start, end)
                for values in zip([conv] * len(turn), turn, roles, fixes, _pieces(texts, fixes, start, last), strict=True):
                    c, t, role, (to, merged, inserted), piece = values
                    new = ROLES[to - 1]
                    action = "+".join(x for x, on in (("relabel", new != role), ("merge", merged)) if on) or "keep"
                    for column, value in zip(columns, (c, t, role, new, action, [ROLES[r - 1] for r in inserted], piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    picked = chunks.select("conv_id", "turns", "roles", "texts", "m", "start", "end", "last")
    return picked.mapInArrow(run, "conv_id long, turn long, role string, new_role string, action string, inserted array<string>, piece string")


def _numbered(cut: DataFrame) -> DataFrame:
    """``i``: a chunk's number in its conversation, and whether it is the last; counted by partition first.

    A conversation has its chunks in consecutive partitions, so those before a chunk are the ones in earlier
    partitions and the earlier ones in its own.
    """
    per = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("no").alias("from"))
    w = Window.partitionBy("conv_id").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "from", (F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"), F.sum("n").over(Window.partitionBy("conv_id")).alias("all"))
    joined = cut.join(bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    i = F.col("base") + F.col("no") - F.col("from")
    return joined.select("conv_id", "part", "no", "m", i.alias("i"), (i == F.col("all") - 1).alias("last"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
