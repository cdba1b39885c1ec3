"""Streams with state, and tables that streams keep up to date, over several batches, restarts and late events."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import updates
from ledgerloom.streaming import flows, snapshots, stateful

T0 = 1_700_000_000


def feed(spark, folder, parts, schema):
    """A stream of ``parts``, a file each, read one by one; each has a column s (seconds), which becomes ts."""
    timed = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + T0)).drop("s")
    have = len(list(folder.glob("*.parquet"))) if folder.exists() else 0
    for k, part in enumerate(parts):
        before = set(folder.glob("*.parquet"))
        timed(part).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:
            os.utime(f, (T0 + 60 * (have + k),) * 2)
    return spark.readStream.schema(timed(parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


# --- tables kept up to date --------------------------------------------------------------------------------------------------


def users(spark, tmp_path, name="users"):
    return snapshots.Snapshot(spark, str(tmp_path / name), "user long, seq long, what string, first string", ["user"], snapshots.last_by(["user"], "seq", keep=("first",)), 4)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = users(spark, tmp_path)
    batch = lambda rows: spark.createDataFrame(rows, "user long, seq long, what string, first string")
    assert table.read().collect() == []
    table.put(batch([(1, 1, "a", "x"), (1, 3, "c", "y"), (2, 2, "b", "z")]), 0)
    one = sorted(map(tuple, table.read().collect()))
    assert one == [(1, 3, "c", "x"), (2, 2, "b", "z")]
    table.put(batch([(1, 9, "never", "w")]), 0)
    assert sorted(map(tuple, table.read().collect())) == one
    table.put(batch([(1, 4, "d", "w"), (2, 1, "old", "v"), (None, 5, "e", "u")]), 1)
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(1, 4, "d", "x"), (2, 2, "b", "z"), (None, 5, "e", "u")], key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = users(spark, tmp_path)
    rows = lambda ids, n: spark.createDataFrame([(i, n, "x", "x") for i in ids], "user long, seq long, what string, first string")
    table.put(rows(range(100), 0), 0)
    table.put(rows([7], 1), 1)
    assert len(list((tmp_path / "users/rows/batch=1").glob("bucket=*"))) == 1
    for n in range(2, 6):
        table.put(rows(range(100), n), n)
    assert table.read().count() == 100 and {r["seq"] for r in table.read().collect()} == {5}
    # What no kept version reads is gone.
    assert sorted(p.name for p in (tmp_path / "users/commits").glob("[0-9]*")) == ["4", "5"]
    assert not list((tmp_path / "users/rows/batch=0").glob("bucket=*")) and not list((tmp_path / "users/rows/batch=2").glob("bucket=*"))


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_stream_gives_the_same_table(spark, tmp_path, when):
    """Killed in a batch, before its rows are the table's or just after; the batch is run again."""
    rng = random.Random(4)
    parts = [[(rng.randint(0, 20), 10 * k + i, rng.choice("abc"), f"f{k}", 0) for i in range(10)] for k in range(4)]
    source = feed(spark, tmp_path / "in", parts, "user long, seq long, what string, first string, s long").drop("ts")
    whole = users(spark, tmp_path, "whole")
    snapshots.upserted(source, whole, str(tmp_path / "whole-state")).awaitTermination()

    class Dies(snapshots.Snapshot):
        def _commit(self, n, versions):
            if when == "after" or n != 2 or self.survives:
                super()._commit(n, versions)
            if n == 2 and not self.survives:
                self.survives = True
                raise RuntimeError("killed")

    table = users(spark, tmp_path)
    table.__class__, table.survives = Dies, False
    with pytest.raises(Exception, match="killed"):
        snapshots.upserted(source, table, str(tmp_path / "state")).awaitTermination()
    assert table.survives
    snapshots.upserted(source, table, str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, whole.read().collect()))
    last = {}
    for u, seq, what, first, _ in sum(parts, []):
        last[u] = (u, seq, what, last[u][3] if u in last else first)
    assert sorted(map(tuple, table.read().collect())) == sorted(last.values())


def test_arrivals_say_what_existed(spark, tmp_path):
    table = snapshots.Arrivals(spark, str(tmp_path / "t"), "m string, seq long, body string", ["m"], "seq", 4)
    batch = lambda rows: spark.createDataFrame(rows, "m string, seq long, body string")
    table.put(batch([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")]), 0)
    for _ in range(2):
        table.put(batch([("b", 4, "w"), ("c", 5, "v"), (None, 6, "u"), (None, 7, "t")]), 1)
    assert {(r["m"], r["seq"]): r["existed"] for r in table.told().collect()} == {("a", 1): False, ("a", 2): True, ("b", 3): False, ("b", 4): True, ("c", 5): False, (None, 6): False, (None, 7): True}
    assert {(r["m"], r["body"]) for r in table.read().collect()} == {("a", "x"), ("b", "z"), ("c", "v"), (None, "u")}


# --- retraction --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_after_random_revokes(spark, tmp_path, seed):
    """Payments and revocations in any order, some of them twice, over several batches: the totals are those of a recount."""
    rng = random.Random(seed)
    rows = [(f"m{i // 2}", i, "payment", f"2024-01-0{rng.randint(1, 4)}", rng.choice("ab"), float(rng.randint(1, 9)), rng.randint(0, 5000)) for i in range(120)]
    gone = {f"m{rng.randint(0, 59)}" for _ in range(20)}
    events = rows + rng.sample(rows, 20) + [(m, 0, "revoke", None, None, None, rng.randint(0, 5000)) for m in sorted(gone) for _ in range(rng.randint(1, 2))]
    rng.shuffle(events)
    parts = [events[i::4] for i in range(4)]
    stream = feed(spark, tmp_path / "in", parts, "message string, id long, what string, day string, kind string, amount double, s long")
    table = snapshots.Snapshot(spark, str(tmp_path / "t"), "day date, kind string, cnt long, total decimal(28,2)", ["day", "kind"], snapshots.summed(["day", "kind"], cnt="cnt", total="total"), 3)
    signed = stateful.signed(stream, late="2 days")
    snapshots.upserted(signed.select("day", "kind", F.col("sign").alias("cnt"), (F.col("sign") * F.col("amount")).alias("total")), table, str(tmp_path / "state")).awaitTermination()
    want = {}
    for m, _, _, day, kind, amount, _ in rows:
        if m not in gone:
            n, total = want.get((day, kind), (0, 0))
            want[day, kind] = (n + 1, total + amount)
    assert {(str(r["day"]), r["kind"]): (r["cnt"], float(r["total"])) for r in table.read().filter("cnt > 0").collect()} == want


# --- timers ------------------------------------------------------------------------------------------------------------------


def test_a_watch_fires_once_by_the_clock(spark, tmp_path):
    """Two runs of one stream, a few seconds apart; nobody asks about the watches in between."""
    now = int(time.time())
    rows = [(1, "watch", now - 100 - T0), (2, "watch", now - 100 - T0), (2, "settled", now - 95 - T0), (3, "watch", now + 12 - T0)]
    schema, out = "id long, kind string, s long", tmp_path / "out"

    def run(part):
        stream = stateful.due_watches(feed(spark, tmp_path / "in", [part], schema), seconds=6)
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        query.awaitTermination(9)  # the clock goes on for ever
        query.stop()
        return sorted((r["id"], int(r["due"].timestamp())) for r in spark.read.parquet(str(out)).collect())

    assert run(rows) == [(1, now - 94)]
    time.sleep(max(0.0, now + 19 - time.time()))
    assert run([(1, "watch", now - 100 - T0), (4, "settled", now - T0)]) == [(1, now - 94), (3, now + 18)]


def test_watches_by_the_times_of_events(spark, tmp_path):
    parts = [[(1, "watch", 0), (2, "settled", 50), (3, "watch", 0)], [(2, "watch", 0), (3, "settled", 200), (4, "watch", 300), (1, "watch", 10)], [(9, "watch", 10**8)]]
    stream = stateful.due_watches(feed(spark, tmp_path / "in", parts, "id long, kind string, s long"), 100, late="1 hour", by_clock=False)
    assert {r["id"]: int(r["due"].timestamp()) - T0 for r in flows.drained(stream).collect()} == {1: 100, 3: 100, 4: 400}


# --- small memories ------------------------------------------------------------------------------------------------------------


def test_uploads_wait_for_the_command(spark, tmp_path):
    parts = [[("c", 1, "upload", None, 0), ("c", 3, "upload", None, 20), ("d", 4, "upload", None, 5)], [("c", 2, "upload", None, 10), ("c", 5, "flush", "g1", 30), ("c", 6, "upload", None, 40)], [("c", 7, "flush", "g2", 50), ("c", 8, "flush", "g3", 60), ("z", 9, "upload", None, 10**8)]]
    schema = "chat string, id long, kind string, target string, s long"
    got = flows.drained(stateful.flushed(feed(spark, tmp_path / "in", parts, schema), most=2, late="1 minute")).collect()
    batch = spark.createDataFrame(sum(parts, []), schema).withColumn("ts", F.timestamp_seconds(F.col("s") + T0))
    want = updates.flushed(batch, 2).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) == [(5, "g1", 1, 2), (5, "g1", 2, 3), (7, "g2", 1, 6)]


def test_saved_uploads_skip_what_the_group_has(spark):
    of = lambda rows, extra: spark.createDataFrame(rows, "id long, s long, contact_id long, amount double" + extra).select("id", F.col("id").alias("raw_message_id"), F.timestamp_seconds(F.col("s") + T0).alias("tx_date"), "contact_id", F.lit("r").alias("recipient_raw"), F.col("amount").cast("decimal(12,2)").alias("amount"), F.lit("").alias("doc_number"), F.lit("").alias("auth_code"), F.lit(False).alias("ignored"), *(["group_jid"] if extra else []))
    receipts = of([(1, 0, 5, 10.0, "g1"), (2, 0, 6, 10.0, "g2")], ", group_jid string").withColumns({"created_at": F.timestamp_seconds(F.lit(T0)), "is_duplicate": F.lit(False)})
    uploads = of([(1, 60, 5, 10.0), (2, 60, 6, 10.0), (3, 90, 6, 10.0), (4, 9000, 5, 10.0)], "")
    taken = spark.createDataFrame([(50, "g1", i, i) for i in (1, 2, 3, 4)], "flush long, target string, nth long, id long")
    at = spark.createDataFrame([(50, 10_000)], "flush long, s long").select("flush", F.timestamp_seconds(F.col("s") + T0).alias("ts"))
    got = {r["id"]: r["status"] for r in updates.saved_uploads(taken, uploads, receipts, at).collect()}
    assert got == {1: "skipped", 2: "saved", 3: "skipped", 4: "saved"}


def test_questions_are_forgotten_in_order(spark, tmp_path):
    rows = [("k", i, "ask", f"q{i}", 100 + i, i) for i in range(4)] + [("k", 10, "ask", "q1", 500, 10), ("k", 11, "reply", "q0", None, 11), ("k", 12, "reply", "q1", None, 12), ("k", 13, "ask", "q9", 9, 13), ("k", 14, "reply", "q1", None, 14), ("k", 15, "ask", "q1", 7, 15), ("k", 16, "reply", "q1", None, 16), ("k", 17, "reply", "q2", None, 17)]
    schema = "kind string, id long, what string, ask_id string, about long, s long"
    want = {11: None, 12: 500, 14: None, 16: 7, 17: None}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + T0))
    assert {r["id"]: r["about"] for r in updates.replies_about(batch, 3).collect()} == want
    parts = [rows[:3], rows[3:8], rows[8:], [("z", 99, "ask", "q", 1, 10**8)]]
    assert {r["id"]: r["about"] for r in flows.drained(stateful.replies_about(feed(spark, tmp_path / "in", parts, schema), 3)).collect()} == want


def test_cooldown_over_batches(spark, tmp_path):
    parts = [[("c", 1, 0), ("c", 3, 89)], [("c", 2, 50), ("c", 4, 90), ("d", 5, 91)], [("c", 6, 179), ("c", 7, 180), ("z", 9, 10**8)]]
    stream = stateful.spaced(feed(spark, tmp_path / "in", parts, "chat string, id long, s long"), 90)
    assert sorted(r["id"] for r in flows.drained(stream).collect()) == [1, 4, 5, 7]
