"""Streams whose rules ask for the order of events: each key's events wait until the watermark has passed them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.session import ship, ship_code
from ledgerloom.streaming.flows import with_rocks

HOUR = 3600
#: How many events of a key are held before they are written to state, and taken at a time.
MOST = 100_000


def _of(kind: str, value):
    """A value as Spark has it: pandas makes nulls of numbers to NaN, and whole numbers beside them to floats."""
    if value is None or value != value:
        return None
    return int(value) if kind == "long" else value


class Ordered(StatefulProcessor):
    """Takes the events of a key in the order of time (s, in seconds) and id, whatever the order in which they come.

    A subclass names the columns of its events, of which id and s are never null, and of what it gives, opens its state variables, and takes events that are
    due. State: the events ahead of the watermark, hour by hour, in parts as they came; one timer, set at the first of them.
    Hours are taken together up to ``MOST`` events, so that so many and an hour's are in memory at a time, however many wait.
    """

    events: dict[str, str]
    gives: dict[str, str]
    #: What orders events; within a second s doesn't.
    order: tuple[str, ...] = ("s", "id")

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Get the state variables."""

    def take(self, key: tuple, due: list[SimpleNamespace]) -> list[tuple]:
        """The rows that these events, one at least, give."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "hour long", "n long")
        self.ahead = handle.getMapState("ahead", "hour long, part long", "rows string")
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, at, kinds = None, list(self.events).index("s"), list(self.events.values())
        new, held, parts = {}, 0, {}
        for batch in rows:
            for x in zip(*(batch[c].tolist() for c in self.events), strict=True):
                row = [_of(k, v) for k, v in zip(kinds, x, strict=True)]
                new.setdefault(row[at] // HOUR, []).append(row)
                first = row[at] if first is None else min(first, row[at])
            held += len(batch)
            if held >= MOST:
                self._keep(new, parts)
                new, held = {}, 0
        self._keep(new, parts)
        for hour, n in parts.items():
            self.parts.updateValue((hour,), (n,))
        if first is not None:
            self._wake(first)
        yield from ()

    def _keep(self, new: dict[int, list], parts: dict[int, int]) -> None:
        for hour, some in new.items():
            if hour not in parts:
                parts[hour] = self.parts.getValue((hour,))[0] if self.parts.containsKey((hour,)) else 0
            self.ahead.updateValue((hour, parts[hour]), (json.dumps(some),))
            parts[hour] += 1

    def _wake(self, second: int) -> None:
        """Have a timer at this second at the latest, and one timer only."""
        at, set_ = second * 1000, list(self.handle.listTimers())
        if not set_ or at < min(set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at, order = timerValues.getCurrentWatermarkInMs(), list(self.events).index("s"), [list(self.events).index(c) for c in self.order]
        following, due = None, []
        for hour in sorted(h for (h,) in list(self.parts.keys())):
            if hour * HOUR * 1000 > now:
                following = hour * HOUR if following is None else following
                break
            parts = [(hour, p) for p in range(self.parts.getValue((hour,))[0])]
            every = sorted((x for p in parts for x in json.loads(self.ahead.getValue(p)[0])), key=lambda x: [x[i] for i in order])
            rest = [x for x in every if x[at] * 1000 > now]
            due += every[: len(every) - len(rest)]
            for p in parts:
                self.ahead.removeKey(p)
            if rest:
                self.ahead.updateValue((hour, 0), (json.dumps(rest),))
                self.parts.updateValue((hour,), (1,))
                following = rest[0][at]
            else:
                self.parts.removeKey((hour,))
            if len(due) >= MOST:
                yield from self._given(key, due)
                due = []
        yield from self._given(key, due)
        if following is not None:
            self.handle.registerTimer(following * 1000)

    def _given(self, key: tuple, due: list[list]) -> Iterator[pd.DataFrame]:
        out = self.take(key, [SimpleNamespace(**dict(zip(self.events, x, strict=True))) for x in due]) if due else []
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype=object if t not in ("long",) or None in v else "int64") for (c, t), v in zip(self.gives.items(), zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, processor: Ordered, late: str, *modules: str) -> DataFrame:
    """The stream of what ``processor`` gives for each ``key``. Events later than ``late`` are dropped.

    ``modules``: those whose code it uses, beside its own. State is kept in RocksDB, by a setting of the session.
    """
    spark = events.sparkSession
    ship(spark)
    ship_code(__name__, type(processor).__module__, *modules)
    with_rocks(spark)
    # Whole numbers that may be null go as text, so that none becomes a float on its way.
    own = [F.col(c).cast("string").alias(c) if t == "long" and c not in ("id", "s") else F.col(c) for c, t in processor.events.items() if c != key]
    rows = events.select(key, *own, F.timestamp_seconds("s").alias("_ts")).withWatermark("_ts", late)
    out = ", ".join(f"{c} {t}" for c, t in processor.gives.items())
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
