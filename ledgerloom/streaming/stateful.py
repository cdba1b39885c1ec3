"""Small memories of the ledger as streams with state: upload buffers, cooldowns, asked questions, watches, and retractions."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.session import ship, ship_code
from ledgerloom.streaming.flows import with_rocks
from ledgerloom.streaming.ordered import Ordered, in_order


def _timed(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumns({"s": F.unix_seconds(F.col(time).cast("timestamp")), "us": F.unix_micros(F.col(time).cast("timestamp"))})


class Uploads(Ordered):
    """A chat's upload buffer: the last ``most`` uploads, given out and forgotten at a command."""

    events = {"id": "long", "s": "long", "us": "long", "kind": "string", "target": "string"}
    order = ("us", "id")
    gives = {"flush": "long", "target": "string", "nth": "long", "id": "long"}

    def __init__(self, most: int):
        self.most = most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "id long")

    def take(self, key: tuple, due: list[SimpleNamespace]) -> list[tuple]:
        held, out = [i for (i,) in self.buffer.get()], []
        for r in due:
            if r.kind == "upload":
                held = [*held, r.id][-self.most :]
            else:
                out += [(r.id, r.target, n + 1, i) for n, i in enumerate(held)]
                held = []
        if held:
            self.buffer.put([(i,) for i in held])
        else:
            self.buffer.clear()
        return out


def flushed(events: DataFrame, most: int = 300, late: str = "1 minute") -> DataFrame:
    """flush, target, nth and id of the uploads that each command takes. ``events``: chat, id, ts, kind (upload or flush), target (of a flush)."""
    return in_order(_timed(events, "ts"), "chat", Uploads(most), late)


class Cooldown(Ordered):
    """When a chat was last answered unasked."""

    events = {"id": "long", "s": "long"}
    gives = {"id": "long"}

    def __init__(self, seconds: int):
        self.seconds = seconds

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "s long")

    def take(self, key: tuple, due: list[SimpleNamespace]) -> list[tuple]:
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for r in due:
            if last is None or r.s - last >= self.seconds:
                last = r.s
                out.append((r.id,))
        if out:
            self.last.update((last,))
        return out


def spaced(events: DataFrame, seconds: int = 90, late: str = "1 minute") -> DataFrame:
    """The ids of the events that may be answered unasked. ``events``: chat, id, ts."""
    return in_order(_timed(events, "ts"), "chat", Cooldown(seconds), late)


class Asked(Ordered):
    """The questions of a kind that replies may be about: the last ``most``, by when they were first asked."""

    events = {"id": "long", "s": "long", "us": "long", "what": "string", "ask_id": "string", "about": "long"}
    gives = {"id": "long", "about": "long"}
    order = ("us", "id")

    def __init__(self, most: int):
        self.most = most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "ask_id string, about string")

    def take(self, key: tuple, due: list[SimpleNamespace]) -> list[tuple]:
        known, out = dict(self.known.get()), []
        for r in due:
            if not r.ask_id:
                continue
            if r.what == "reply":
                about = known.get(r.ask_id)
                out.append((r.id, None if about is None else int(about)))
                continue
            known[r.ask_id] = None if r.about is None else str(r.about)
            if len(known) > self.most:
                del known[next(iter(known))]
        if known:
            self.known.put(list(known.items()))
        return out


def replies_about(events: DataFrame, most: int = 500, late: str = "1 minute") -> DataFrame:
    """id and about of each reply: what the question was about, null if it is unknown or forgotten.

    ``events``: kind (of question), id, ts, what (ask or reply), ask_id, about (of an ask).
    """
    return in_order(_timed(events, "ts"), "kind", Asked(most), late)


#: Into how many buckets watches and messages fall by their hash. A batch reads and writes the buckets of its rows, whole.
BUCKETS = 1024


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def _wake(handle: StatefulProcessorHandle, at: int | None) -> None:
    """One timer, at that millisecond."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if at is not None:
        handle.registerTimer(at)


class Watches(StatefulProcessor):
    """A bucket of watches: each due once, so long after it began, unless it is settled by then; and forgotten ``keep`` seconds later. One timer, at the next that is due."""

    NEVER = -(2**62)

    def __init__(self, seconds: int, keep: int, by_clock: bool):
        self.seconds, self.keep, self.by_clock = seconds, keep, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "id long, began long, settled long, fired long")

    def _waits(self, began: int, settled: int) -> bool:
        return began != self.NEVER and (settled == self.NEVER or settled >= began + self.seconds)

    def _at(self, began: int, settled: int, fired: int) -> int:
        """When this one is looked at again."""
        if fired:
            return began + self.seconds + self.keep
        return began + self.seconds if self._waits(began, settled) else max(began, settled) + self.seconds + self.keep

    def _put(self, known: dict[int, tuple[int, int, int]], least: int) -> None:
        if known:
            self.rows.put([(i, *v) for i, v in known.items()])
        else:
            self.rows.clear()
        _wake(self.handle, max(least, 1000 * min(self._at(*v) for v in known.values())) if known else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {i: tuple(v) for i, *v in self.rows.get()}
        first = lambda a, b: b if a == self.NEVER else min(a, b)
        for batch in rows:
            for i, kind, s in zip(*(batch[c].tolist() for c in ("id", "kind", "s")), strict=True):
                began, settled, fired = known.get(i, (self.NEVER, self.NEVER, 0))
                if not fired:
                    known[i] = (first(began, s), settled, 0) if kind == "watch" else (began, first(settled, s), 0)
        self._put(known, 0)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        known, due = {}, []
        for i, *v in self.rows.get():
            if 1000 * self._at(*v) > now:
                known[i] = tuple(v)
            elif not v[2] and self._waits(v[0], v[1]):
                due.append((i, v[0] + self.seconds))
                known[i] = (v[0], v[1], 1)
        self._put(known, now + 1)
        if due:
            yield pd.DataFrame({"id": [i for i, _ in due], "due": pd.to_datetime([s for _, s in due], unit="s")})

    def close(self) -> None:
        pass


def due_watches(events: DataFrame, seconds: int = 24 * 3600, late: str = "1 minute", by_clock: bool = True, keep_days: int = 30) -> DataFrame:
    """id and due of each watch that isn't settled within ``seconds`` after it began: once, when the time has come, by its own timer.

    ``events``: id, ts, kind (``watch`` begins one, anything else settles it; the earliest of each holds, for ``keep_days``). Time is the clock's,
    or with ``by_clock`` false the events'. Of other watches, those of the same bucket are looked at.
    """
    spark = events.sparkSession
    ship(spark)
    ship_code(__name__, Ordered.__module__)
    with_rocks(spark)
    rows = _timed(events, "ts").filter("id is not null and s is not null").select(_bucket("id"), "id", "kind", "s", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows if by_clock else rows.withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(Watches(seconds, keep_days * 86400, by_clock), outputStructType="id long, due timestamp", outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime")


class Signed(StatefulProcessor):
    """A bucket of messages: their payments with a plus, and once a message is revoked all of its with a minus."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "message string, id string, day string, kind string, amount string, s long")

    def _load(self) -> tuple[dict, dict]:
        """The payments of each message by id, none at all of one that is revoked; and when each had its last event."""
        paid, last = {}, {}
        for message, i, day, kind, amount, s in self.rows.get():
            last[message] = s
            if i is None:
                paid[message] = None
            else:
                paid.setdefault(message, {})[i] = (day, kind, amount)
        return paid, last

    def _put(self, paid: dict, last: dict, least: int) -> None:
        rows = [(m, i, *v, last[m]) for m, own in paid.items() for i, v in ([(None, (None, None, None))] if own is None else own.items())]
        if rows:
            self.rows.put(rows)
        else:
            self.rows.clear()
        _wake(self.handle, max(least, (min(last.values()) + self.keep) * 1000) if last else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (paid, last), out = self._load(), []
        for batch in rows:
            for message, i, what, day, kind, amount, s in zip(*(batch[c].tolist() for c in ("message", "id", "what", "day", "kind", "amount", "s")), strict=True):
                last[message] = max(s, last.get(message, s))
                own = paid.setdefault(message, {})
                if what == "revoke":
                    out += [(-1, *v) for v in (own or {}).values()]
                    paid[message] = None
                elif own is not None and i not in own:
                    own[i] = (day, kind, amount)
                    out.append((1, day, kind, amount))
        self._put(paid, last, timerValues.getCurrentWatermarkInMs() + 1)
        if out:
            yield pd.DataFrame(out, columns=["sign", "day", "kind", "amount"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        paid, last = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        stay = {m: s for m, s in last.items() if (s + self.keep) * 1000 > now}
        self._put({m: own for m, own in paid.items() if m in stay}, stay, now + 1)
        yield from ()

    def close(self) -> None:
        pass


def signed(events: DataFrame, keep_days: int = 30, late: str = "1 minute") -> DataFrame:
    """sign, day, kind, amount: +1 rows for payments as they come, and -1 rows for the payments of a message that is revoked.

    ``events``: message, id, what (payment or revoke), ts, day, kind, amount. Payments and revocations that come again give
    nothing, and neither do payments of a message that is revoked already. A message is forgotten ``keep_days`` after its last event.
    """
    spark = events.sparkSession
    ship(spark)
    ship_code(__name__, Ordered.__module__)
    with_rocks(spark)
    rows = events.select(_bucket("message"), "message", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "what", F.col("day").cast("string").alias("day"), "kind", F.col("amount").cast("string").alias("amount"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    out = rows.groupBy("bucket").transformWithStateInPandas(Signed(keep_days * 86400), outputStructType="sign long, day string, kind string, amount string", outputMode="Append", timeMode="EventTime")
    return out.select("sign", F.to_date("day").alias("day"), "kind", F.col("amount").cast("decimal(18,2)").alias("amount"))
