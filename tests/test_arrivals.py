"""Rules on the order of arrival, and names, receipts and cash by one rule in batch and as a stream, on made-up cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution, folds
from ledgerloom.streaming import attribution as attribution_stream
from ledgerloom.streaming import flows

T0 = 1_700_000_000

# --- duplicates and holds -----------------------------------------------------------------------------------------------------


def receipts(spark, rows):
    """id, created (s), operation (s), contact, recipient, doc, auth, amount"""
    df = spark.createDataFrame(rows, "id long, created long, s long, contact_id long, recipient_raw string, doc_number string, auth_code string, amount double")
    return df.select("id", F.col("id").alias("raw_message_id"), F.timestamp_seconds(F.col("created") + T0).alias("created_at"), F.timestamp_seconds(F.col("s") + T0).alias("tx_date"), F.lit("g").alias("group_jid"), "contact_id", "recipient_raw", "doc_number", "auth_code", F.col("amount").cast("decimal(12,2)").alias("amount"), F.lit(False).alias("ignored"))


def plain_copies(rows, revoked, window=300):
    """Receipt by receipt, each against all that live by then."""
    events = [(created, 0, i, r) for r in rows for i, created in [(r[0], r[1])]]
    events += [(max(at, r[1]), 1, r[0], r) for r in rows for m, at in revoked if m == r[0]]
    originals, copies, was, freed = {}, {}, {}, set()
    for _, gone, i, r in sorted(events, key=lambda e: e[:3]):
        _, _, s, contact, raw, doc, auth, amount = r
        agree = lambda a, b: not a or not b or a == b
        if not gone:
            who = (lambda o: o[3] == contact) if contact is not None else (lambda o: o[4] == raw)
            was[i] = any(o[7] == amount and abs(o[2] - s) <= window and who(o) and agree(o[5], doc) and agree(o[6], auth) for o in originals.values())
            (copies if was[i] else originals)[i] = r
        elif copies.pop(i, None) is None:
            del originals[i]
            like = [c for c in copies.values() if c[7] == amount and ((doc and c[5] == doc) or (auth and c[6] == auth) or (contact is not None and c[3] == contact and abs(c[2] - s) <= window))]
            if like:
                best = max(like, key=lambda c: (c[1], c[0]))
                freed.add(best[0])
                originals[best[0]] = copies.pop(best[0])
    return {i: (w, i in freed) for i, w in was.items()}


def test_the_earlier_arrival_stays(spark):
    rows = [(1, 300, 240, 5, "r", "", "", 10.0), (2, 3600, 0, 5, "r", "", "", 10.0), (3, 4000, -200, 5, "r", "", "", 10.0)]
    got = {r["id"]: (r["is_copy"], r["freed"]) for r in folds.duplicate_receipts(receipts(spark, rows)).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, False)}


def test_a_revoked_original_frees_its_newest_copy(spark):
    rows = [(1, 0, 0, 5, "r", "", "", 10.0), (2, 100, 10, 5, "r", "", "", 10.0), (3, 200, 20, 5, "r", "", "", 10.0), (4, 900, 30, 5, "r", "", "", 10.0)]
    revoked = spark.createDataFrame([(1, 500)], "raw_message_id long, s long").select("raw_message_id", F.timestamp_seconds(F.col("s") + T0).alias("at"))
    got = {r["id"]: (r["is_copy"], r["freed"]) for r in folds.duplicate_receipts(receipts(spark, rows), revoked=revoked).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True), 4: (True, False)}


def test_an_unknown_client_is_told_by_the_recipient(spark):
    """Also where the receipt it repeats has a client by now; a receipt with a client is told by that alone."""
    rows = [(1, 0, 0, 5, "r", "", "", 10.0), (2, 100, 10, None, "r", "", "", 10.0), (3, 200, 20, None, "q", "", "", 10.0), (4, 300, 30, 6, "r", "", "", 10.0)]
    assert {r["id"]: r["is_copy"] for r in folds.duplicate_receipts(receipts(spark, rows)).collect()} == {1: False, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 3000), rng.randint(0, 3000), rng.choice([None, 1, 2]), rng.choice(["a", "b"]), rng.choice(["", "", "d1", "d2"]), rng.choice(["", "x", "y"]), rng.choice([10.0, 20.0])) for i in range(400)]
    revoked = [(i, rng.randint(0, 4000)) for i in range(0, 400, 5)]
    gone = spark.createDataFrame(revoked, "raw_message_id long, s long").select("raw_message_id", F.timestamp_seconds(F.col("s") + T0).alias("at"))
    got = {r["id"]: (r["is_copy"], r["freed"]) for r in folds.duplicate_receipts(receipts(spark, rows), revoked=gone).collect()}
    assert got == plain_copies(rows, revoked)
    assert sum(c for c, _ in got.values()) > 50 and sum(f for _, f in got.values()) > 5


def test_cash_is_held_by_arrival(spark):
    """What is recorded by then counts, up to 30 days back and not ahead; an answer lets a held payment count."""
    rows = [(1, 0, "2024-02-10"), (2, 10, "2024-02-01"), (3, 20, "2024-03-11"), (4, 30, "2024-03-12"), (5, 40, "2024-03-20"), (6, 90, "2024-04-18")]
    df = spark.createDataFrame(rows, "id long, created long, tx_date string")
    df = df.select("id", F.col("id").alias("raw_message_id"), F.timestamp_seconds(F.col("created") + T0).alias("created_at"), F.to_date("tx_date").alias("tx_date"), F.lit(1).cast("long").alias("contact_id"), F.lit(7).cast("decimal(12,2)").alias("amount"), F.lit(True).alias("is_cash"), F.lit(False).alias("ignored"))
    groups = df.select("id", F.lit("g").alias("wa_group_jid"))
    said = spark.createDataFrame([(3, 25, "хз"), (5, 50, "новый"), (5, 60, "тот же"), (1, 70, "тот же"), (4, 80, "нет")], "id long, s long, answer string").select("id", F.timestamp_seconds(F.col("s") + T0).alias("at"), "answer")
    got = {r["id"]: (r["held"], r["answer"]) for r in folds.held_cash(df, groups, answers=said).collect()}
    # 2 is dated before 1, which was recorded first; 3 is 30 days after 1; 4 is 31 days after 1 and 40 after 2, as 3 doesn't count.
    assert got == {1: (False, ""), 2: (False, ""), 3: (True, ""), 4: (False, ""), 5: (True, "new"), 6: (True, "")}


# --- names, receipts and cash -----------------------------------------------------------------------------------------------


def said(spark, rows):
    """id, sender, s, kind, name, amount, paired, quoted; a message has its event's number."""
    df = spark.createDataFrame(rows, "id long, sender string, s long, kind string, name string, amount double, paired boolean, quoted string")
    return df.select("id", F.lit("g").alias("grp"), "sender", F.timestamp_seconds(F.col("s") + T0).alias("ts"), "kind", "name", "amount", "paired", F.concat(F.lit("m"), "id").alias("message"), "quoted")


def effects(df):
    return {r["id"]: (r["what"], r["about"], r["name"], r["amount"]) for r in df.collect()}


CHAT = [
    (1, "a", 0, "name", "Ким", None, None, None),
    (2, "a", 10, "receipt", None, None, None, None),
    (3, "a", 20, "receipt", None, None, None, None),
    (4, "a", 30, "receipt", None, None, None, None),
    (5, "b", 40, "name", "Ли", None, None, "m4"),
    (6, "a", 50, "name", "Пак", None, None, "m99"),
    (7, "a", 60, "name", "Чо", None, None, None),
    (8, "a", 70, "name", "Юн", None, None, None),
    (9, "a", 80, "receipt", None, None, None, None),
    (10, "c", 100, "photo", None, None, None, None),
    (11, "c", 220, "name", "Иванов Иван", 500.0, None, None),
    (12, "c", 300, "payment", None, 70.0, None, None),
    (13, "c", 310, "photo", "Пак", 30.0, None, None),
    (14, "c", 320, "photo", None, None, None, None),
    (15, "c", 321, "payment", "Ли", 60.0, None, None),
    (16, "c", 1000, "receipt", None, None, None, None),
    (17, "c", 1360, "name", "Чо", None, None, None),
]
WANT = {
    1: ("queued", 1, "Ким", 0.0),
    2: ("named", 2, "Ким", None),
    5: ("named", 4, "Ли", None),  # a reply names another sender's receipt, which then no longer waits
    6: ("queued", 6, "Пак", 0.0),  # a reply to something else waits
    7: ("named", 3, "Чо", None),
    8: ("queued", 8, "Юн", 0.0),
    9: ("named", 9, "Пак", None),
    10: ("waits", 10, None, None),
    11: ("recorded", 11, "Иванов Иван", 500.0),  # a name with an amount after a picture of cash is cash
    13: ("marked", 12, None, None),
    14: ("waits", 14, None, None),
    15: ("cash", 15, None, None),
    17: ("queued", 17, "Чо", 0.0),  # the receipt has waited its six minutes
}


def test_attribution(spark):
    assert effects(attribution.attributed(said(spark, CHAT))) == WANT


def streamed(spark, folder, parts, limits=attribution.Limits(), late="1 minute"):
    """The stream's effects over ``parts``, a file each, read one by one; an event long after them lets the watermark pass."""
    for k, part in enumerate([*parts, [(9999, "z", 10**8, "payment", None, None, True, None)]]):
        before = set(folder.glob("*.parquet"))
        said(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:
            os.utime(f, (T0 + 60 * k,) * 2)  # files are read in the order of their times
    schema = said(spark, parts[0]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return flows.drained(attribution_stream.attributed(stream, limits, late))


def test_attribution_as_a_stream(spark, tmp_path):
    """Batch by batch, with state between them, and with events that come before earlier ones."""
    parts = [CHAT[:4] + [CHAT[6]], [CHAT[5], CHAT[4], CHAT[8], CHAT[7]], CHAT[9:13], [CHAT[14], CHAT[13]], CHAT[15:]]
    assert effects(streamed(spark, tmp_path / "in", parts)) == WANT


def random_chat(rng, n):
    rows, s = [], 0
    for i in range(1, n + 1):
        s += rng.choice([0, 5, 60, 200, 700])
        kind = rng.choice(["name", "name", "receipt", "receipt", "payment", "photo"])
        name = rng.choice(["Ким", "Ли", "Пак"]) if kind == "name" or rng.random() < 0.2 else None
        quoted = f"m{rng.randint(max(1, i - 6), i + 2)}" if kind in ("name", "payment") and rng.random() < 0.4 else None
        rows.append((i, rng.choice("ab"), s, kind, name, rng.choice([None, 0.0, 50.0]), rng.random() < 0.2, quoted))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_stream_is_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, limits = random_chat(rng, 200), attribution.Limits(names=300, cash=400, most=3, quotes=5 * 3600)
    parts = [rows[i : i + 50] for i in range(0, 200, 50)]
    for part in parts:
        rng.shuffle(part)
    got = effects(streamed(spark, tmp_path / "in", parts, limits, "1 day"))
    assert got == effects(attribution.attributed(said(spark, rows), limits))
    assert {"named", "queued", "recorded", "marked", "cash", "waits"} <= {v[0] for v in got.values()}
