"""Cases that larger tables brought up: events within one second, and rules by brute force."""

import random
import re
import statistics
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution, folds, parsers, updates
from ledgerloom.plans import reports
from ledgerloom.streaming import flows, stateful

T0 = 1_700_000_000


def at(ms):
    """A time, in thousandths of a second."""
    return F.timestamp_millis(F.col(ms) + 1000 * T0)


def test_names_pair_within_a_second(spark):
    """Of one second's events the earlier is first, whatever its id; waiting ends to the fraction of a second."""
    rows = [(5, 100, "name", "A"), (2, 900, "receipt", None), (1, 999, "receipt", None), (7, 20_000, "receipt", None), (8, 30_300, "name", "B"), (9, 40_000, "name", "C"), (10, 50_100, "receipt", None)]
    df = spark.createDataFrame(rows, "id long, ms long, kind string, text string").withColumns({"ts": at("ms"), "grp": F.lit("g"), "sender": F.lit("x")})
    assert {r["id"]: r["name"] for r in folds.pair_names(df, ttl_seconds=10).collect()} == {2: "A", 1: None, 7: None, 10: None}


def test_cooldown_within_a_second(spark):
    """A chat is free again to the fraction of a second, and of one second's events the earlier is answered."""
    rows = [(2, 100), (1, 900), (3, 90_050), (4, 90_100), (5, 180_099), (6, 180_100)]
    df = spark.createDataFrame(rows, "id long, ms long").select(F.lit("c").alias("chat"), "id", at("ms").alias("ts"))
    assert sorted(r["id"] for r in updates.spaced(df, 90).collect()) == [2, 4, 6]


@pytest.mark.parametrize("seed", range(3))
def test_a_growing_histogram_has_the_median(seed):
    """The median of what was added so far, whatever the order, without looking at it all again."""
    rng, seen, every = random.Random(seed), reports.Histogram(), []
    for _ in range(400):
        amount, n = float(rng.randint(1, rng.choice([3, 40]))), rng.randint(1, 4)
        seen.add(amount, n)
        every += [amount] * n
        if rng.random() < 0.5:
            assert (seen.n, seen.median()) == (len(every), statistics.median(every))


def test_commands_take_uploads_of_cells_before(spark):
    """Uploads go to the next command however far off, in the order of time within a second as well."""
    rng = random.Random(5)
    kinds = [(rng.choice("ab"), "flush" if rng.random() < 0.1 else "upload") for _ in range(300)]
    times = [rng.randint(0, 200) * 100 + rng.choice([0, 0, 5_000_000]) for _ in kinds]
    rows = [(c, i, k, "g" if k == "flush" else None, t) for i, ((c, k), t) in enumerate(zip(kinds, times, strict=True))]
    want, held = [], {"a": [], "b": []}
    for c, i, k, target, _ in sorted(rows, key=lambda r: (r[4], r[1])):
        if k == "upload":
            held[c].append(i)
        else:
            want += [(i, target, n + 1, u) for n, u in enumerate(held[c][-6:])]
            held[c] = []
    df = spark.createDataFrame(rows, "chat string, id long, kind string, target string, ms long").withColumn("ts", at("ms"))
    assert sorted(map(tuple, updates.flushed(df, 6).collect())) == sorted(want)


def test_names_beside_receipts_by_brute_force(spark):
    """The newest name among the sender's last texts; texts meet receipts in blocks of them, not each with each."""
    rng, most = random.Random(6), 4
    bodies = ["Анна Ким", "Пётр Петров", "ок", "500\nОля Белова", "12"]
    name = {"Анна Ким": "Анна Ким", "Пётр Петров": "Пётр Петров", "500\nОля Белова": "Оля Белова"}
    texts = [(i, rng.choice("xy"), rng.randint(0, 4000) * 1000, rng.choice(bodies)) for i in range(400)]
    asks = [(i, rng.choice("xyz"), rng.choice(["", "анна ким"]), rng.randint(0, 4100) * 1000) for i in range(150)]
    want = {}
    for i, sender, owner, t in asks:
        near = sorted((m, n, b) for n, s, m, b in texts if s == sender and t - 60_000 <= m <= t)[-most:]
        found = [name[b] for _, _, b in near if b in name and name[b].lower() != owner]
        if found:
            want[i] = found[-1]
    messages = spark.createDataFrame(texts, "id long, sender_jid string, ms long, body string").select("id", "sender_jid", "body", F.lit("g").alias("wa_group_jid"), at("ms").alias("received_at"), F.lit(False).alias("deleted"))
    waiting = spark.createDataFrame(asks, "id long, sender string, card_owner string, ms long").select("id", "sender", "card_owner", F.lit("g").alias("grp"), at("ms").alias("at"))
    got = updates.silently_resolved(waiting, messages, spark.createDataFrame([], "alias string, canonical string"), minutes=1, most=most)
    assert {r["id"]: r["name"] for r in got.collect()} == want
    assert "block" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("common", [1, 3, 2000])
def test_names_are_looked_up_by_brute_force(spark, monkeypatch, common):
    """Whole names and words, in any case, within the clients' names; each client that meets a part holds it."""
    monkeypatch.setattr(updates, "COMMON", common)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abAé") for _ in range(rng.randint(1, 5)))
    clients = [(i, " ".join(word() for _ in range(3))) for i in range(60)]
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(80)} | {clients[3][1].upper(), ""})
    want = {}
    for name in names:
        whole = [i for i, full in clients if name and name.lower() in full.lower()]
        words = [i for i, full in clients if any(len(w) >= 3 and w.lower() in full.lower() for w in name.split(" "))]
        ids = whole or words
        want[name] = (len(ids), ids[0] if len(ids) == 1 else None, bool(whole))
    c = spark.createDataFrame(clients, "id long, full_name string")
    got = updates.looked_up(spark.createDataFrame([(n,) for n in names], "name string"), c)
    assert {r["name"]: (r["n"], r["client_id"], r["exact"]) for r in got.collect()} == want
    # By runs of three characters every name "Customer#…" met many others before their texts were compared.
    numbered = spark.range(300).select("id", F.format_string("Customer#%09d", "id").alias("full_name"))
    pairs = updates._clients_with(numbered.select(F.col("full_name").alias("part")), numbered)
    assert pairs.count() == 300 and "contains" not in pairs._jdf.queryExecution().optimizedPlan().toString().lower()


def test_streams_order_events_within_a_second(spark, tmp_path):
    """Of one second's events the earlier is first, whatever its id, for upload buffers and questions."""
    rows = [("k", 2, "upload", "ask", "q", 2, 100), ("k", 1, "upload", "ask", "q", 1, 900), ("k", 3, "flush", "reply", "q", None, 950), ("z", 9, "upload", "ask", "q", 9, 10**11)]
    df = spark.createDataFrame(rows, "chat string, id long, kind string, what string, ask_id string, about long, ms long").select("*", F.lit("g").alias("target"), at("ms").alias("ts")).drop("ms")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    taken = flows.drained(stateful.flushed(stream, 5)).collect()
    assert sorted((r["flush"], r["nth"], r["id"]) for r in taken) == [(3, 1, 2), (3, 2, 1)]
    asked = df.withColumn("kind", F.col("chat"))
    assert [(r["id"], r["about"]) for r in updates.replies_about(asked, 5).collect()] == [(3, 1)]


def test_watches_and_messages_share_buckets():
    """No state of its own for each watch or message, which took a call or more for each."""
    assert stateful.BUCKETS == 1024 and "bucket" in str(stateful._bucket("id"))


def test_lines_without_a_label_are_held_against_one_pattern(monkeypatch):
    """A receipt's label patterns are tried one by one only on lines, and values, that begin with a label."""
    tried = []

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, line):
            tried.append(line)
            return self.pattern.match(line)

    monkeypatch.setattr(parsers, "_LABELS", [(f, Counting(r)) for f, r in parsers._LABELS])
    text = "Банк\n" + "просто строка\n" * 50 + "Получатель\nТестов Тест\nСумма перевода: 500 ₽\nСтатус\nСумма"
    assert parsers._fields(text) == {"recipient": "Тестов Тест", "amount": "500 ₽"}
    assert set(tried) == {"Получатель", "Сумма перевода: 500 ₽", "Статус", "Сумма"}


def test_an_event_takes_as_long_however_many_wait():
    """100,000 receipts and payments that wait, some named by replies, oldest first; step by step as by plain lists."""
    n, limits = 100_000, attribution.Limits(names=10**9, cash=10**9)
    event = lambda i, kind, **more: SimpleNamespace(**{"s": i, "id": i, "kind": kind, "name": "", "amount": 0.0, "paired": False, "about": None} | more)
    waiting, began = attribution.Waiting(), time.process_time()
    for i in range(n):
        assert waiting.step(event(i, "payment" if i % 2 else "receipt"), limits) is None
    for i in range(0, n, 4):
        assert waiting.step(event(n, "bound", name="A", about=i), limits) == ("named", i, "A", None)
    assert len(waiting.open_receipts()) == n // 4
    assert [waiting.step(event(n + 1, "name", name="B"), limits)[1] for _ in range(n // 4)] == list(range(2, n, 4))
    assert waiting.step(event(n + 1, "photo"), limits) == ("marked", n - 1, None, None)
    assert waiting.step(event(n + 1, "name", name="C"), limits)[0] == "queued"
    assert time.process_time() - began < 20


def test_a_task_gets_a_number_of_messages(spark, monkeypatch):
    """What a model read meets its messages sorted, in tasks of so many of them, however small Spark takes the tables to be."""
    monkeypatch.setattr(parsers, "MESSAGES", 20, raising=False)
    messages = spark.range(300).select("id", F.lit("Анна Ким 500р").alias("body"), (F.col("id") % 5 == 0).alias("cash_hint"))
    payments = F.format_string('Вот: {"payments":[{"name":" Оля ","amount":%d},{"name":" ","amount":5},{"name":"Ян","amount":2}]}', "id")
    replies = spark.range(400).filter("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 0, payments).otherwise("не знаю").alias("reply"))
    want = [(i, 0, "Анна Ким", 500.0, i % 5 == 0, False) for i in range(300) if i % 3]
    want += [(i, 0, "Оля", float(i), i % 5 == 0, True) for i in range(3, 300, 3)] + [(i, 2, "Ян", 2.0, i % 5 == 0, True) for i in range(0, 300, 3)]
    got = parsers.model_payments(messages, replies)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("id", "line_no", "raw_name", "amount", "is_cash", "by_model").collect())) == sorted(want)
    assert "Broadcast" not in plan and set(re.findall(r"hashpartitioning\(id#\w+, (\d+)\)", plan)) == {"16"}
