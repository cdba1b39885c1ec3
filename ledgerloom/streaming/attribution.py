"""The rule of names, receipts, payments and pictures of cash as a stream with state, chat by chat.

The four waiting places of each sender, and the receipts that replies may quote, are state variables of their own,
so that a chat reads and writes those of its active senders alone.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ledgerloom.operators.attribution import Limits, Waiting, rows_of
from ledgerloom.streaming.ordered import Ordered, in_order

_HOUR = 3600


class _Loaded:
    """A map in state, read once a key and written back once a key, however many events touch it."""

    def __init__(self, state, none):
        self.state, self.none, self.held = state, none, {}

    def __getitem__(self, key):
        if key not in self.held:
            found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.held[key] = self.none() if found is None else found
        return self.held[key]

    def __setitem__(self, key, value):
        self.held[key] = value

    def write(self, empty) -> None:
        for key, value in self.held.items():
            if empty(value):
                if self.state.containsKey((key,)):
                    self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), value)


class Chat(Ordered):
    """One chat. Effects as the batch form has them."""

    events = {"id": "long", "sender": "string", "s": "long", "kind": "string", "name": "string", "amount": "double", "paired": "boolean", "message": "string", "quoted": "string"}
    gives = {"id": "long", "what": "string", "about": "long", "name": "string", "amount": "double"}

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "sender string", "at array<long>, name array<string>, amount array<double>")
        self.receipts = handle.getMapState("receipts", "sender string", "at array<long>, id array<long>")
        self.payments = handle.getMapState("payments", "sender string", "at array<long>, id array<long>")
        self.pictures = handle.getMapState("pictures", "sender string", "at long")
        self.sent = handle.getMapState("sent", "message string", "at long, id long, sender string")
        self.hours = handle.getMapState("hours", "hour long", "messages array<string>")

    def take(self, key: tuple, due: list[SimpleNamespace]) -> list[tuple]:
        senders, sent, hours = {}, _Loaded(self.sent, lambda: None), _Loaded(self.hours, lambda: ([],))
        out = []
        for r in due:
            if r.quoted and r.name and r.kind in ("name", "payment"):
                found = sent[r.quoted]
                if found is not None and r.s - found[0] <= self.limits.quotes:
                    r.kind, r.about, r.sender = "bound", found[1], found[2]
                else:
                    r.kind = "queue"
            elif r.kind == "receipt" and not r.paired and r.message:
                sent[r.message] = (r.s, r.id, r.sender)
                hours[r.s // _HOUR] = ([*hours[r.s // _HOUR][0], r.message],)
            if r.sender not in senders:
                senders[r.sender] = self._load(r.sender)
            found = senders[r.sender].step(r, self.limits)
            if found:
                out.append((r.id, *found))
        if due:
            self._forget(due[-1].s, sent, hours)
        sent.write(lambda v: v is None)
        hours.write(lambda v: not v[0])
        for sender, waiting in senders.items():
            self._store(sender, waiting)
        return out

    def _load(self, sender: str) -> Waiting:
        of = lambda state: state.getValue((sender,)) if state.containsKey((sender,)) else None
        names, receipts, payments, picture = (of(s) for s in (self.names, self.receipts, self.payments, self.pictures))
        rows = lambda v: [tuple(x) for x in zip(*v, strict=True)] if v else []
        return Waiting(rows(names), rows(receipts), rows(payments), picture[0] if picture else None)

    def _store(self, sender: str, w: Waiting) -> None:
        columns = lambda rows: tuple(list(c) for c in zip(*rows, strict=True))
        picture = None if w.picture is None else (w.picture,)
        for state, value in ((self.names, columns(w.names)), (self.receipts, columns(w.open_receipts())), (self.payments, columns(w.payments)), (self.pictures, picture)):
            if value:
                state.updateValue((sender,), value)
            elif state.containsKey((sender,)):
                state.removeKey((sender,))

    def _forget(self, now: int, sent: _Loaded, hours: _Loaded) -> None:
        """Receipts that no reply may find any more go, by the hours in which they were sent."""
        last = (now - self.limits.quotes) // _HOUR
        for (hour,) in list(self.hours.keys()):
            if hour < last:
                for message in hours[hour][0]:
                    if sent[message] is not None and sent[message][0] // _HOUR == hour:
                        sent[message] = None
                hours[hour] = ([],)


def attributed(events: DataFrame, limits: Limits = Limits(), late: str = "1 minute") -> DataFrame:
    """The stream of effects; ``events`` as in the batch form, which gives the same rows. Events later than ``late`` are dropped.

    A chat's state is what waits in it, the events that the watermark has not passed, and a row for each receipt of the days
    in which replies may find it.
    """
    return in_order(rows_of(events), "grp", Chat(limits), late, Waiting.__module__)


def paired_names(events: DataFrame, ttl_seconds: int = 360, most: int = 20, late: str = "1 minute") -> DataFrame:
    """Names and receipts of a sender in a group, paired first in first out: id of the receipt, name.

    ``events``: id, grp, sender, ts, kind (``name`` or ``receipt``), text (a name). Nothing else than ``attributed`` with names
    and receipts alone.
    """
    none = F.lit(None).cast("string")
    rows = events.select("id", "grp", "sender", "ts", "kind", F.when(F.col("kind") == "name", F.col("text")).alias("name"), F.lit(0.0).alias("amount"), F.lit(False).alias("paired"), none.alias("message"), none.alias("quoted"))
    return attributed(rows, Limits(names=ttl_seconds, most=most), late).filter("what = 'named'").select(F.col("about").alias("id"), "name")
