"""Paged lists from a stub of another program, trailing histograms, and the parts of a reconciliation, by brute force."""

import json
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import parsers, updates
from ledgerloom.plans import reports
from ledgerloom.sources import remote
from ledgerloom.sources.ledger import Ledger


def stub(folder, n, limit, lasting=3):
    """Pages of ``n`` items in ``folder``, and a program that serves them to tokens that last for so many requests."""
    folder.mkdir()
    for page in range(-(-n // limit)):
        items = [{"id": str(i), "full_name": f"Имя {i}", "extra": {"x": i}} for i in range(page * limit, min(n, (page + 1) * limit))]
        if page == 1:
            items += [{"id": "", "full_name": "nobody"}]
            items.pop(0)
        (folder / f"{page}.json").write_text(json.dumps([items, {"items": items}, {"total": n, "data": items}][page % 3]))
    used = {}

    def fetch(page, size, token):
        used[token] = used.get(token, 0) + 1
        if used[token] > lasting:
            raise remote.Unauthorized(token)
        file = folder / f"{page}.json"
        return file.read_text() if file.exists() else "[]"

    def login():
        return f"t{len(used)}"

    return fetch, login


@pytest.mark.parametrize("n", [0, 1, 10, 95, 100])
def test_paged_list(spark, tmp_path, n):
    fetch, login = stub(tmp_path / "pages", n, 10)
    rows = remote.paged(spark, f"stub{n}", remote.CLIENTS, fetch, login, limit=10, tasks=3).collect()
    assert sorted(int(r["id"]) for r in rows) == [i for i in range(n) if i != 10]
    assert all(r["full_name"] == f"Имя {r['id']}" and r["phone"] is None for r in rows)


def test_a_token_that_is_never_good(spark, tmp_path):
    fetch, login = stub(tmp_path / "pages", 5, 10, lasting=0)
    with pytest.raises(Exception, match="refused with a new token"):
        remote.paged(spark, "stub_refused", remote.CLIENTS, fetch, login).collect()


def test_loose_answers():
    assert remote.items('{"results":[{"a":1},2]}') == [{"a": 1}] and remote.items("oops") == remote.items('{"other":[1]}') == remote.items("3") == []


def test_trailing_counts(spark):
    rng = random.Random(7)
    days = {}
    for _ in range(300):
        key = (rng.choice("ab"), date(2024, 1, 1) + timedelta(days=rng.randint(0, 40)), rng.randint(1, 6))
        days[key] = days.get(key, 0) + rng.randint(1, 3)
    asked = {(g, date(2024, 1, 1) + timedelta(days=a), date(2024, 1, 1) + timedelta(days=a + w)) for g in "abc" for a, w in [(0, 0), (0, 41), (5, 7), (5, 20), (30, 3), (12, 1)]}
    got = reports.trailing_counts(spark.createDataFrame([(*k, n) for k, n in days.items()], "g string, day date, amount int, n long"), spark.createDataFrame(list(asked), "g string, since date, until date"))
    want = {}
    for g, since, until in asked:
        for (h, day, amount), n in days.items():
            if h == g and since <= day < until:
                want[g, since, until, amount] = want.get((g, since, until, amount), 0) + n
    assert {(r["g"], r["since"], r["until"], r["amount"]): r["n"] for r in got.collect()} == want


def ledger(spark, receipts, payments):
    """A ledger of one client. receipts: id, day, amount; payments: id, day, amount."""
    at = lambda d: F.expr(f"timestamp '2024-01-01' + make_dt_interval({d})")
    r = spark.createDataFrame(receipts, "id long, d int, amount double").select("id", F.col("id").alias("raw_message_id"), F.lit(1).cast("long").alias("contact_id"), F.lit("x").alias("recipient_raw"), F.col("amount").cast("decimal(12,2)").alias("amount"), at("d").alias("tx_date"), F.lit("g").alias("group_jid"), *[F.lit(v).alias(c) for c, v in (("doc_number", ""), ("auth_code", ""), ("submitted_by", ""), ("is_duplicate", False), ("ignored", False), ("needs_review", False))], at("d").alias("created_at"))
    m = r.select("id", F.lit("g").alias("wa_group_jid"), F.concat(F.lit("m"), "id").alias("wa_message_id"), F.lit("s@x").alias("sender_jid"), F.lit("S").alias("sender_name"), F.lit(None).cast("string").alias("media_path"), F.col("created_at").alias("received_at"), F.lit(False).alias("deleted"))
    p = spark.createDataFrame(payments, "payment_id long, d int, amount long").select("payment_id", F.lit(1).cast("long").alias("client_id"), "amount", at("d").alias("paid_at"))
    people = spark.createDataFrame([(1, "Ким Анна")], "id long, canonical_name string")
    return Ledger(receipts=r, messages=m, payments=p, contacts=people, clients=people.select("id", F.col("canonical_name").alias("full_name")), owners=spark.createDataFrame([], "phone string, owner string"))


@pytest.mark.parametrize("least", [0.2, 3.0])
def test_reconciliation_in_parts(spark, least):
    """One client with many amounts: each part takes its payments as one pass over all would."""
    rng = random.Random(int(least))
    amounts = [least, 1.5, 3.0, 3.4, 10.0, 10.5, 100.0, 300.0, 1000.0, 1050.0, 2999.5, 5000.0, 12345.67, 500000.0]
    receipts = [(i, rng.randint(8, 10), rng.choice(amounts)) for i in range(120)]
    payments = [(i, rng.randint(5, 15), int(rng.choice(amounts) * rng.choice([1, 100]) + 0.5)) for i in range(120)]
    got = {r["id"]: r["payment_id"] for r in reports.reconcile(ledger(spark, receipts, payments), datetime(2024, 1, 1), datetime(2024, 2, 1)).collect()}
    newest, want = max(d for _, d, _ in receipts), {}
    free = sorted((p for p in payments if abs(p[1] - newest) <= 5), key=lambda p: (p[1], p[0]))
    for i, _, amount in sorted(receipts, key=lambda r: (-r[1], r[0])):
        units = {int(amount + 0.5), int(amount * 100 + 0.5)}
        hit = next((p for p in free if p[2] in units), None)
        want[i] = hit and hit[0]
        if hit:
            free.remove(hit)
    assert got == want and sum(v is not None for v in want.values()) > 30


def test_amounts_fall_into_one_part_with_their_hundredths(spark):
    rows = spark.range(1, 200_000, 37).select((F.col("id") / 100).cast("decimal(12,2)").alias("a")).filter("a >= 2")
    both = rows.select(reports.amount_part(updates.units("a")[0]).alias("x"), reports.amount_part((F.col("a") * 100).cast("long")).alias("y"))
    assert both.filter("x <> y").count() == 0 and both.select("x").distinct().count() > 50


def test_names_hold_over_long_messages(spark):
    body = "\n".join(line for i in range(300) for line in (f"Имя {'абвгд'[i % 5]}", "", f"{i + 1}00", "700"))
    rows = parsers.parse_messages(spark.createDataFrame([(1, body), (2, "100\nИмя\n200\r\n\r\nДругой\n300")], "id long, body string"))
    got = {(r["id"], r["line_no"]): (r["raw_name"], r["amount"], r["unparsed"]) for r in rows.collect()}
    assert sum(1 for k in got if k[0] == 1) == 600 and got[1, 2] == ("Имя а", 100.0, None) and got[1, 1199] == ("Имя д", 700.0, None)
    assert [got[2, n] for n in (0, 2, 5)] == [(None, None, "100 (сумма без имени)"), ("Имя", 200.0, None), ("Другой", 300.0, None)]
    assert statistics.mean(v[1] for k, v in got.items() if k[0] == 1) > 700
