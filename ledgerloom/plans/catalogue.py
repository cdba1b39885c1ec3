"""The reports over the driver tables, by name, with the parameters that the checks use."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import updates
from ledgerloom.operators.rules import LIVE
from ledgerloom.plans import reports as rp
from ledgerloom.plans import tools
from ledgerloom.plans.oracle import EARLY, END, LATE, LATE_END, MONTH, MONTH_END, START
from ledgerloom.sources.ledger import Ledger, from_events

_d = datetime.fromisoformat
PERIOD, THE_MONTH, THE_LATE = (_d(START), _d(END)), (_d(MONTH), _d(MONTH_END)), (_d(LATE), _d(LATE_END))

def _misread(l: Ledger) -> Ledger:
    """Some receipts with zeros too many."""
    l.receipts = l.receipts.withColumn("amount", F.when(F.col("id") % 50 == 0, F.col("amount") * 10000).otherwise(F.col("amount")))
    return l


def _same_as_first(l: Ledger) -> DataFrame:
    """What the first numbered receipt would be a copy of."""
    r = rp.full_receipts(l).filter(f"{LIVE} and doc_number <> '' and contact_id is not null").orderBy("id").first()
    return updates.same_as(l, r["group_jid"], str(r["contact_id"]), r["amount"], r["tx_date"], doc=r["doc_number"], seconds=20 * 86400)


def _first_with_file(rows: DataFrame) -> int:
    return rows.filter("media_path <> ''").agg(F.min("id")).first()[0]


REPORTS: dict[str, Callable[[Ledger], DataFrame]] = {
    "rp01_summary_for_period": lambda l: rp.summary_for_period(l, *PERIOD),
    "rp02_summary_by_chat": lambda l: rp.summary_by_chat(l, *THE_LATE, *THE_MONTH),
    "rp03_old_operations": lambda l: rp.old_operations(l, *THE_LATE, _d("2024-01-20"), _d(MONTH_END)),
    "rp04_sender_stats": lambda l: rp.sender_stats(l, *PERIOD),
    "rp05_sender_stats_by_chat": lambda l: rp.sender_stats_by_chat(l, *THE_LATE, *THE_MONTH),
    "rp06_card_totals": lambda l: rp.card_totals(l, *PERIOD),
    "rp07_person_report": lambda l: rp.person_report(l, "1"),
    "fn28_cards_of_named_groups": lambda l: rp.card_totals(l, *PERIOD, groups=tools.resolve_groups(l, "asia и Euro")),
    "rp08_receipts_ledger": lambda l: rp.receipts_ledger(l, *PERIOD),
    "rp09_missing_in_group": lambda l: rp.missing_in_group(l, "g1", *PERIOD),
    "rp10_exclusions": lambda l: rp.exclusions(l, *PERIOD),
    "rp11_recent_outside_period": lambda l: rp.recent_outside_period(l, _d("2024-01-10"), *PERIOD),
    "rp12_receipts_for_period": lambda l: rp.receipts_for_period(l, *PERIOD),
    "rp13_receipt_details": lambda l: rp.receipt_details(l, "customer%1"),
    "rp14_receipt_files": lambda l: rp.receipt_files(l, "1"),
    "rp15_find_operations": lambda l: rp.find_operations(l, 10),
    "rp16_unclear_items": lambda l: rp.unclear_items(l),
    "rp17_group_medians": lambda l: rp.group_medians(l, _d(MONTH)),
    "rp18_suspicious_amounts": lambda l: rp.suspicious_amounts(l, _d(MONTH), least=20, times=3),
    "rp18_suspicious_by_default": lambda l: rp.suspicious_amounts(_misread(l)),
    **{f"rp19_queue_{k}": partial(rp.clarification_queue, kind=k, now=_d(LATE_END), most=1000) for k in rp.QUESTIONS},
    # Early on some groups' queues are short enough to be asked about, and some are not.
    **{f"rp19_gated_{k}": partial(rp.clarification_queue, kind=k, now=_d(LATE if k == "cash_repeat" else EARLY)) for k in rp.QUESTIONS},
    "rp19_cycle": lambda l: rp.clarification_cycle(l, _d(EARLY)),
    "rp01_in_groups": lambda l: rp.summary_for_period(l, *PERIOD, groups=["g1", "g3"]),
    "rp04_by_name_or_phone": lambda l: rp.sender_stats(l, *PERIOD, groups=["g2", "g3"], query="er 1"),
    "rp07_bounded": lambda l: rp.person_report(l, "2", *PERIOD, group="g2"),
    "rp08_of_a_person": lambda l: rp.receipts_ledger(l, *PERIOD, person="customer#00000001_", groups=["g0", "g2"], limit=20),
    "rp16_of_a_group": lambda l: rp.unclear_items(l, group="g2", limit=5),
    "rp21_unconfirmed_from": lambda l: updates.unconfirmed_from(l, _d("2024-02-20")),
    "rp22_watch_list": lambda l: rp.watch_list(l, ["ambiguous", "unmatched"]),
    "rp22_due_watches": lambda l: rp.due_watches(l, _d(LATE)),
    "rp22_latest_noname": lambda l: rp.latest_noname_watches(l, _d(START)),
    "rp23_reconcile_group": lambda l: rp.reconcile(l, *PERIOD, group="g1"),
    "rp26_phone_owners": lambda l: l.owners,
    "rp26_rules": lambda l: l.rules,
    "rp26_settings": lambda l: l.settings,
    "rp27_finance_report_with_notes": lambda l: rp.finance_report(l, *PERIOD, now=_d("2024-01-21")),
    "rp27_finance_report_by_chat": lambda l: rp.finance_report_by_chat(l, *THE_LATE),
    "rp29_month_context": lambda l: rp.month_context(l, _d("2024-01-15")),
    "rp30_same_as": lambda l: _same_as_first(l),
    "rp31_media_path": lambda l: rp.media_path(l, f"message:{_first_with_file(l.messages)}").unionByName(rp.media_path(l, f"receipt:{_first_with_file(rp.full_receipts(l))}")),
    "rp20_unparsed_messages": lambda l: rp.unparsed_messages(l),
    "rp20_unresolved_receipts": lambda l: rp.unresolved_receipts(l),
    "rp21_recent_sender_texts": lambda l: rp.recent_sender_texts(l, "79000000001@s.example", "g1", *PERIOD),
    "rp23_reconcile": lambda l: rp.reconcile(l, *PERIOD),
    "rp24_has_payment_around": lambda l: rp.has_payment_around(l, *PERIOD),
    "rp25_expenses": lambda l: rp.expenses_for_period(l, *PERIOD),
    "rp26_contacts": lambda l: l.contacts,
    "rp27_finance_report": lambda l: rp.finance_report(l, *PERIOD),
    "rp28_monthly_report": lambda l: rp.summary_for_period(l, *THE_MONTH),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(from_events(spark, sf_dir))) for name, f in REPORTS.items()}
