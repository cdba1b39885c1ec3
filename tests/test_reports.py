"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerloom.plans import cases, catalogue, changes, checks, oracle, reports, streams, tools
from ledgerloom.sources.ledger import from_events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalogue.queries() | checks.QUERIES | cases.QUERIES | changes.QUERIES | streams.QUERIES
ORACLES = oracle.oracle_sql() | checks.ORACLES | cases.ORACLES | changes.ORACLES | streams.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat()
    return int(v) if isinstance(v, np.integer) else v if isinstance(v, (int, str, bool)) else str(v)


def rows(df):
    return sorted(repr([norm(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_report_has_sql():
    assert set(catalogue.REPORTS) == set(oracle.oracle_sql())


def test_summary_and_exclusions_hold_each_other(spark):
    """The sum of a finance report is the sum of its clients, and no less than without the clients' receipts."""
    l = from_events(spark, SF)
    rows = reports.finance_report(l, *catalogue.PERIOD).collect()
    total = {(r["section"], r["label"]): r["total"] for r in rows}
    clients = sum(v for (s, _), v in total.items() if s == "client")
    assert clients == pytest.approx(total["sum", "total"])
    assert total["sum", "maximum"] == pytest.approx(total["sum", "total"] + total["left_out", "needs_review"] + total["left_out", "held_cash"])


def test_tools(spark):
    l = from_events(spark, SF)
    assert tools.call(l, "cards_report", start="2024-01-05", end="2024-01-19").count() == reports.card_totals(l, *catalogue.PERIOD).count()
    assert tools.visible(False) == ["person_report"]
    for bad in ({"tool": "nothing"}, {"tool": "cards_report"}, {"tool": "cards_report", "start": "x", "end": "2024-01-01"}, {"tool": "cards_report", "admin": False, "start": "2024-01-01", "end": "2024-01-01"}):
        with pytest.raises(tools.BadCall):
            tools.call(l, **bad)
    fixed = tools.call(l, "correct_operation", kind="receipt", id=l.receipts.first()["id"], field="bank", value="Bank X")
    assert [r["bank"] for r in fixed.collect()] == ["Bank X"]


def test_tools_that_change_things(spark):
    l = from_events(spark, SF)
    call = lambda tool, **k: tools.call(l, tool, **k)
    assert {"recount_everything", "cmf_resolve"} <= set(tools.visible(True))
    assert [(r["canonical"], r["amount"], r["is_cash"], r["group_jid"]) for r in call("record_payment", text="Милана\n5000").collect()] == [("Милана", 5000.0, False, "g2")]
    assert call("record_expense", amount=5, note="такси", date="2024-01-02").count() == l.expenses.count() + 1
    one = l.receipts.filter("needs_review").first()["id"]
    fixed = call("fix_receipt", code=f"receipt:{one}", name="Customer#000000001", amount=12).first()
    assert (fixed["recipient_raw"], fixed["contact_id"], float(fixed["amount"]), fixed["needs_review"]) == ("Customer#000000001", 1, 12.0, False)
    assert call("fix_receipt", code="message:40", name="X").count() == 1
    assert call("assign_receipt_collector", who="Оля", group="g1").filter("submitted_by = 'Оля'").count() == 1
    assert call("manage_receipt_forwarding", action="add", source="личка", target="ASIA").filter("source = 'dm'").count() == 1
    assert call("manage_receipt_forwarding", action="remove").count() == 0 and call("manage_receipt_forwarding", action="list").count() == l.rules.count()
    assert call("phone_memory", action="set", phone="8 900 000-00-09", name="Оля").filter("phone = '79000000009'").count() == 1
    assert call("phone_memory", action="remove", phone="79000000001").count() == l.owners.count() - 1
    assert call("set_main_group", value="asia").filter("key = 'main_group'").first()["value"] == "g2"
    watch = l.watches.filter("status = 'ambiguous'").first()["id"]
    assert call("cmf_resolve", watch=watch, client=1).first()["status"] == "watch"
    sent = spark.createDataFrame([("c", i, f"m{i}") for i in range(30)], "chat string, seq long, message_id string")
    assert {r["seq"] for r in call("delete_my_messages", sent=sent, n=2).collect()} == {28, 29}
    assert call("recount_everything").count() > 0
    for bad in ({"tool": "fix_receipt", "code": "x"}, {"tool": "phone_memory", "action": "set", "phone": "12"}, {"tool": "set_main_group", "value": "nowhere"}):
        with pytest.raises(tools.BadCall):
            tools.call(l, **bad)
