"""Rules that depend on the order of events, in batch: duplicate receipts, held repeats of cash, pairing of names.

Each is a fold over the events of one key. A key's events fall into stretches that nothing links: where no event
lies within a window's length of the operations' times. Stretches are folded apart, in as many tasks as there are;
one is folded in one pass over its sorted rows, batch by batch, in the order in which they were recorded where a rule
asks what was known by then. The state of a fold is one stretch's originals.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.session import ship


def stretches(rows: DataFrame, key: list[str], time: str, gap: int) -> DataFrame:
    """``rows`` with ``stretch``: rows of one key in different stretches are more than ``gap`` apart.

    Time is cut into cells as long as the gap; a stretch is a run of cells that hold events. Only the cells in use,
    once each, are ordered by key, not the rows.
    """
    rows = rows.withColumn("_cell", F.floor(F.col(time) / F.lit(max(gap, 1))))
    cells = rows.select(*key, "_cell").distinct()
    by = Window.partitionBy(*key).orderBy("_cell")
    begins = F.when(F.lag("_cell").over(by) == F.col("_cell") - 1, None).otherwise(F.col("_cell"))
    cells = cells.withColumn("_begin", begins).withColumn("stretch", F.last("_begin", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    named = cells.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_cell").alias("_c"), "stretch")
    same = F.col("_cell") == F.col("_c")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same).select(*rows.columns, "stretch").drop("_cell")


def folded(rows: DataFrame, key: list[str], order: list[str], fold, schema: str, keep: list[str], gap: int | None = None) -> DataFrame:
    """``fold`` makes a function from one row to its result for each new key; rows come by key and order.

    Rows are dealt by key, and stretch if a ``gap`` in units of the first of ``order`` is given, and sorted within
    partitions, so that a key is a stretch of its partition and is never held in memory as a whole.
    """
    ship(rows.sparkSession)
    if gap is not None:
        rows = stretches(rows, key, order[0], gap)
        key = [*key, "stretch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = tuple(getattr(row, c) for c in key)
                if k != last:
                    last, step = k, fold()
                out.append(step(row))
            yield batch[keep].assign(result=out)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


class Originals:
    """The originals of one group and amount by the time of their operation: a window on both sides is a stretch of a sorted list.

    Found by client, or by what is printed of the recipient, as the receipt that looks for one has it.
    """

    def __init__(self):
        self.by: dict[tuple, list] = {}

    @staticmethod
    def _keys(r) -> list[tuple]:
        return [(n, v) for n, v in (("contact", r.contact), ("recipient", r.recipient)) if v]

    def add(self, r) -> None:
        for key in self._keys(r):
            insort(self.by.setdefault(key, []), (r.s, r.id, r.doc, r.auth))

    def remove(self, r) -> None:
        for key in self._keys(r):
            rows = self.by[key]
            del rows[bisect_left(rows, (r.s, r.id, r.doc, r.auth))]

    def has_like(self, r, window: int) -> bool:
        """Whether one lies within the window, before or after, whose numbers don't contradict."""
        rows = self.by.get(("contact", r.contact) if r.contact else ("recipient", r.recipient), [])
        for i in range(bisect_left(rows, (r.s - window,)), len(rows)):
            s, _, doc, auth = rows[i]
            if s > r.s + window:
                return False
            if (not r.doc or not doc or r.doc == doc) and (not r.auth or not auth or r.auth == auth):
                return True
        return False


def duplicate_receipts(receipts: DataFrame, window_seconds: int = 300, revoked: DataFrame | None = None) -> DataFrame:
    """id, is_copy and freed: whether a receipt repeated a live one when it was recorded, and whether it has become an original since.

    Receipts are taken in the order in which they were recorded (created_at, id), whatever the times of their operations. One
    is a copy if a live original of its group and amount lies within the window on either side, of its client (or, for a
    receipt without one, with the same recipient printed), and neither document nor authorisation numbers contradict. Copies are
    no originals. ``revoked`` (raw_message_id, at) takes messages back: their originals no longer count, and of each one's copies
    the newest that is live becomes an original (``freed``): one with the same document or authorisation, or of its client within
    the window. Of copies with another amount than the original's, ``promoted`` tells.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = receipts.filter("not ignored and amount > 0").select(
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
        F.lit(0).alias("nth"),
        "id",
        F.coalesce("group_jid", F.lit("")).alias("g"),
        F.col("amount").cast("string").alias("a"),
        F.unix_seconds(F.coalesce("tx_date", "created_at").cast("timestamp")).alias("s"),
        filled("contact_id").alias("contact"),
        filled("recipient_raw").alias("recipient"),
        filled("doc_number").alias("doc"),
        filled("auth_code").alias("auth"),
        "raw_message_id",
    )
    rows = stretches(rows, ["g", "a"], "s", window_seconds)
    if revoked is not None:
        gone = revoked.groupBy("raw_message_id").agg(F.min(F.unix_micros(F.col("at").cast("timestamp"))).alias("_at"))
        gone = rows.join(gone, "raw_message_id").withColumns({"at": F.greatest("at", "_at"), "nth": F.lit(1)}).select(*rows.columns)
        rows = rows.unionByName(gone)

    def fold():
        originals, copies, lost = Originals(), {}, set()

        def taken_back(r) -> dict:
            lost.add(r.id)
            if copies.pop(r.id, None) is not None:
                return {"is_copy": None, "freed": None}
            originals.remove(r)
            like = lambda c: (r.doc and c.doc == r.doc) or (r.auth and c.auth == r.auth) or (r.contact and c.contact == r.contact and abs(c.s - r.s) <= window_seconds)
            best = max((c for c in copies.values() if like(c)), key=lambda c: (c.at, c.id), default=None)
            if best is None:
                return {"is_copy": None, "freed": None}
            originals.add(copies.pop(best.id))
            return {"is_copy": None, "freed": best.id}

        def step(r) -> dict:
            if r.nth:
                return taken_back(r)
            same = originals.has_like(r, window_seconds)
            if same:
                copies[r.id] = r
            else:
                originals.add(r)
            return {"is_copy": same, "freed": None}

        return step

    out = folded(rows, ["g", "a", "stretch"], ["at", "nth", "id"], fold, "id long, result struct<is_copy:boolean,freed:long>", ["id"])
    freed = out.filter("result.freed is not null").select(F.col("result.freed").alias("_id"))
    was = out.filter("result.is_copy is not null").select("id", "result.is_copy")
    return was.join(freed, F.col("id") == F.col("_id"), "left").select("id", "is_copy", F.col("_id").isNotNull().alias("freed"))


def held_cash(transactions: DataFrame, groups: DataFrame, days: int = 30, answers: DataFrame | None = None) -> DataFrame:
    """id, held and answer: whether a cash payment was held back when it was recorded, and what was said of it.

    ``groups``: id, wa_group_jid of the messages. Payments are taken in the order in which they were recorded (created_at, id).
    One is held if a counted one of its client, amount and group, recorded by then, is dated on its day or up to ``days`` before.
    Held ones don't count until an answer says so. ``answers``: id, at, answer (text); ``new`` lets a held payment count from
    then on, ``same`` drops it, anything else changes nothing; the first clear one holds.
    """
    m = groups.select(F.col("id").alias("_mid"), "wa_group_jid")
    rows = transactions.filter("is_cash and not ignored and amount > 0 and contact_id is not null").join(m, F.col("raw_message_id") == F.col("_mid"))
    rows = rows.select(F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.lit("").alias("answer"), "id", F.col("wa_group_jid").alias("g"), F.col("contact_id").alias("who"), F.col("amount").cast("string").alias("a"), F.datediff("tx_date", F.lit("1970-01-01")).alias("d"))
    rows = stretches(rows, ["g", "who", "a"], "d", days)
    if answers is not None:
        said = answers.select(F.col("id").alias("_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("_at"), fn.dup_answer("answer").alias("_said")).filter("_said <> 'unclear'")
        said = said.groupBy("_id").agg(F.min(F.struct("_at", "_said")).alias("first"))
        said = rows.join(said, F.col("id") == F.col("_id")).withColumns({"at": F.greatest("at", "first._at"), "answer": F.col("first._said")}).select(*rows.columns)
        rows = rows.unionByName(said)

    def fold():
        counted: list[int] = []
        held: set[int] = set()

        def step(r) -> str | None:
            if r.answer:
                if r.id not in held:
                    return None
                held.remove(r.id)
                if r.answer == "new":
                    insort(counted, r.d)
                return r.answer
            i = bisect_left(counted, r.d - days)
            if i < len(counted) and counted[i] <= r.d:
                held.add(r.id)
                return "held"
            insort(counted, r.d)
            return ""

        return step

    out = folded(rows, ["g", "who", "a", "stretch"], ["at", "answer", "id"], fold, "id long, answer string, result string", ["id", "answer"])
    first = out.filter("answer = ''").select("id", (F.col("result") == "held").alias("held"))
    said = out.filter("answer <> '' and result is not null").select(F.col("id").alias("_id"), "result")
    return first.join(said, F.col("id") == F.col("_id"), "left").select("id", "held", F.coalesce("result", F.lit("")).alias("answer"))


def pair_names(events: DataFrame, ttl_seconds: int = 360, most: int = 20) -> DataFrame:
    """The receipt of each name, first in first out, by group and sender.

    ``events``: id, grp, sender, ts, kind (``name`` or ``receipt``), text. A name waits for a receipt, or
    goes to the oldest receipt that still waits for one; both wait ``ttl_seconds`` at most, and ``most``
    names at a time. One row per receipt: id, name (null if none came).
    """
    rows = events.select("id", "grp", "sender", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "kind", "text")
    ttl = ttl_seconds * 1_000_000

    def fold():
        names: deque = deque()
        receipts: deque = deque()

        def step(r) -> str | None:
            for waiting in (names, receipts):
                while waiting and r.at - waiting[0][0] > ttl:
                    waiting.popleft()
            if r.kind == "name":
                if receipts:
                    return f"{receipts.popleft()[1]}\t{r.text}"
                if len(names) == most:
                    names.popleft()
                names.append((r.at, r.text))
            elif names:
                return f"{r.id}\t{names.popleft()[1]}"
            else:
                receipts.append((r.at, r.id))
            return None

        return step

    pairs = folded(rows, ["grp", "sender"], ["at", "id"], fold, "id long, result string", ["id"], ttl).filter("result is not null")
    found = pairs.select(F.split_part("result", F.lit("\t"), F.lit(1)).cast("long").alias("_id"), F.split_part("result", F.lit("\t"), F.lit(2)).alias("name"))
    return events.filter("kind = 'receipt'").select("id").join(found, F.col("id") == F.col("_id"), "left").select("id", "name")


def false_duplicates(receipts: DataFrame, window_seconds: int = 300) -> DataFrame:
    """The ids of receipts marked as copies that have no original in their group; unmarking them twice changes nothing.

    An original has the same document, or the same authorisation, or the client and amount within the window:
    three joins on equal keys, one after the other.
    """
    group = F.coalesce("group_jid", F.lit(""))
    marked = receipts.filter("is_duplicate").withColumn("_g", group)
    originals = receipts.filter("not is_duplicate").withColumn("g", group)
    for number in ("doc_number", "auth_code"):
        known = originals.filter(F.col(number) != "").select("g", F.col(number).alias("n")).distinct()
        marked = marked.join(known, (F.col("_g") == F.col("g")) & (F.col(number) == F.col("n")), "left_anti")
    near = originals.select("g", F.col("contact_id").alias("c"), F.col("amount").alias("a"), F.unix_seconds(F.col("tx_date").cast("timestamp")).alias("s"))
    apart = F.abs(F.unix_seconds(F.col("tx_date").cast("timestamp")) - F.col("s")) <= window_seconds
    return marked.join(near, (F.col("_g") == F.col("g")) & (F.col("contact_id") == F.col("c")) & (F.col("amount") == F.col("a")) & apart, "left_anti").select("id")


def promoted(receipts: DataFrame, deleted: DataFrame, window_seconds: int = 300) -> DataFrame:
    """The newest live copy of each original whose message was revoked: original, id. ``deleted``: raw_message_id.

    A copy has the original's group and its document, or its authorisation, or its client and amount within the
    window: three joins on equal keys, united.
    """
    group = F.coalesce("group_jid", F.lit(""))
    s = F.unix_seconds(F.col("tx_date").cast("timestamp"))
    gone = receipts.filter("not is_duplicate and not ignored").join(deleted, "raw_message_id", "left_semi")
    gone = gone.select(F.col("id").alias("original"), group.alias("g"), F.col("contact_id").alias("c"), F.col("amount").alias("a"), s.alias("s"), F.col("doc_number").alias("doc"), F.col("auth_code").alias("auth"))
    copies = receipts.filter("is_duplicate and not ignored").join(deleted, "raw_message_id", "left_anti").withColumn("_g", group).withColumn("_s", s)
    same = F.col("_g") == F.col("g")
    ways = [
        copies.filter("doc_number <> ''").join(gone, same & (F.col("doc_number") == F.col("doc"))),
        copies.filter("auth_code <> ''").join(gone, same & (F.col("auth_code") == F.col("auth"))),
        copies.join(gone, same & (F.col("contact_id") == F.col("c")) & (F.col("amount") == F.col("a")) & (F.abs(F.col("_s") - F.col("s")) <= window_seconds)),
    ]
    pairs = ways[0].unionByName(ways[1]).unionByName(ways[2])
    newest = F.row_number().over(Window.partitionBy("original").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return pairs.withColumn("nth", newest).filter("nth = 1").select("original", "id")


def corrected(rows: DataFrame, corrections: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` after the last correction of each field. ``corrections``: id, seq, field, value (text)."""
    last = corrections.groupBy("id", "field").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy("id").pivot("field", columns).agg(F.first("value"))
    wide = wide.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(wide, F.col("id") == F.col("_id"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def latest(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last version of each key: an upsert, read from its log."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(seq).desc()))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def forwarded(events: DataFrame, rules: DataFrame) -> DataFrame:
    """What the rules send on. ``events``: wa_message_id, source, group; ``rules``: source, target_jid."""
    pairs = events.join(rules, "source").filter("target_jid <> grp")
    return pairs.select(F.concat_ws("-fwd-", "wa_message_id", F.split_part("target_jid", F.lit("@"), F.lit(1))).alias("wa_message_id"), F.col("target_jid").alias("grp"))
