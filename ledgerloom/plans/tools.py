"""The reports and corrections as named, typed table functions: name, parameters, who may call, and a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import folds, parsers, updates
from ledgerloom.plans import reports as rp
from ledgerloom.plans import tables
from ledgerloom.sources.ledger import Ledger


@dataclass(frozen=True)
class Tool:
    """``params``: name to (type, required). Types: str, float, int, date (periods end with theirs), groups and table."""

    run: Callable[..., DataFrame]
    params: dict[str, tuple[str, bool]]
    for_all: bool = False


class BadCall(ValueError):
    """A call with an unknown tool, a missing parameter or one of the wrong type."""


def resolve_groups(l: Ledger, names: str) -> list[str]:
    """The groups that a list of names means: each part must be in exactly one group's name, whatever its case."""
    parts = [p.strip() for p in re.split(r"[,;+]|\s+и\s+|\s+плюс\s+", names) if p.strip()]
    asked = l.groups.sparkSession.createDataFrame([Row(part=p) for p in parts], "part string")
    found = asked.join(l.groups, F.lower("name").contains(F.lower("part")), "left").groupBy("part").agg(F.collect_set("group_jid").alias("jids")).collect()
    for r in found:
        if len(r["jids"]) != 1:
            raise BadCall(f"{r['part']!r} means {len(r['jids'])} groups")
    return sorted({r["jids"][0] for r in found})


def _value(l: Ledger, name: str, kind: str, value):
    try:
        if kind == "date":
            return datetime.fromisoformat(value) if isinstance(value, str) else datetime.combine(value, datetime.min.time()) if type(value) is date else value
        if kind == "groups":
            return resolve_groups(l, value) if isinstance(value, str) else list(value)
        return {"str": str, "float": float, "int": int, "table": lambda x: x}[kind](value)
    except BadCall:
        raise
    except (TypeError, ValueError) as e:
        raise BadCall(f"{name}: {value!r} is no {kind}") from e


def call(l: Ledger, tool: str, admin: bool = True, **given) -> DataFrame:
    """Run a tool by name. Periods are given by inclusive dates ``start`` and ``end``."""
    if tool not in TOOLS or not (admin or TOOLS[tool].for_all):
        raise BadCall(f"no tool {tool!r}")
    t = TOOLS[tool]
    if unknown := set(given) - set(t.params):
        raise BadCall(f"{tool} has no {sorted(unknown)}")
    if missing := {n for n, (_, must) in t.params.items() if must} - set(given):
        raise BadCall(f"{tool} needs {sorted(missing)}")
    values = {n: _value(l, n, t.params[n][0], v) for n, v in given.items() if v is not None}
    if "end" in values:
        values["end"] += timedelta(days=1)
    return t.run(l, **values)


def visible(admin: bool) -> list[str]:
    return sorted(n for n, t in TOOLS.items() if admin or t.for_all)


def _cards(l: Ledger, start, end, groups=None, card: str = "") -> DataFrame:
    rows = rp.card_totals(l, start, end, groups)
    return rows.filter(F.lower("card_owner").contains(card.lower())) if card else rows


def _correction(l: Ledger, kind: str, id: int, field: str, value: str) -> DataFrame:
    table = {"receipt": l.receipts, "transaction": l.transactions}.get(kind)
    if table is None or field not in table.columns:
        raise BadCall(f"nothing to correct: {kind} {field}")
    log = table.sparkSession.createDataFrame([(id, 1, field, value)], "id long, seq int, field string, value string")
    return folds.corrected(table, log, [field]).filter(F.col("id") == id)


def _rows(l: Ledger, schema: str, *rows: tuple) -> DataFrame:
    """What a call itself says, as a table of a row or two."""
    return l.messages.sparkSession.createDataFrame(list(rows), schema)


def _aliases(l: Ledger) -> DataFrame:
    return parsers.with_built_in(l.contacts.select(F.lower("canonical_name").alias("alias"), F.col("canonical_name").alias("canonical")))


def _payments(l: Ledger, text: str, group: str = "") -> DataFrame:
    """The payments to be recorded for a text: client, amount, note, card, whether cash, and the group."""
    said = _rows(l, "id long, body string", (0, text))
    rows = updates.recount_messages(said, _aliases(l))
    return rows.withColumn("group_jid", F.lit(group) if group else _setting(l, "working_group"))


def _setting(l: Ledger, key: str):
    """A setting's value, empty where it isn't set."""
    found = l.settings.filter(F.col("key") == key).select("value").first()
    return F.lit(found["value"] if found else "")


def _code(code: str) -> tuple[str, int]:
    kind, _, num = code.partition(":")
    if kind not in ("receipt", "message") or not num.isdigit():
        raise BadCall(f"{code!r} is no code")
    return kind, int(num)


def _unclear(l: Ledger, code: str) -> DataFrame:
    kind, num = _code(code)
    return rp.every_unclear_item(l).filter((F.col("kind") == kind) & (F.col("id") == num))


def _unclear_files(l: Ledger, group: str = "", limit: int = 10) -> DataFrame:
    return rp.unclear_items(l, group, limit).filter("media_path <> ''")


def _fix(l: Ledger, code: str, name: str = "", amount: float = 0.0, date=None) -> DataFrame:
    """The receipt after the fix, or the new one on top of a message."""
    kind, num = _code(code)
    contact = l.contacts.filter(F.col("canonical_name") == name).agg(F.min("id").alias("c")).first()["c"] if name else None
    fix = _rows(l, "id long, name string, contact long, new_amount double, new_date timestamp", (num, name, contact, amount, date))
    if kind == "message":
        return updates.receipts_from_messages(l.messages, fix)
    return updates.fixed_receipts(l.receipts, fix).filter(F.col("id") == num)


def _recount(l: Ledger) -> DataFrame:
    """All that a recount finds: receipts whose client is known by now, and payments in messages that became nothing."""
    receipts = updates.recount_receipts(l.receipts, _aliases(l), l.contacts)
    messages = updates.recount_messages(rp.unparsed_messages(l), _aliases(l))
    return receipts.select(F.lit("receipt").alias("kind"), "id", "canonical", F.lit(None).cast("double").alias("amount")).unionByName(messages.select(F.lit("payment").alias("kind"), F.col("raw_message_id").alias("id"), "canonical", "amount"))


def _expense(l: Ledger, amount: float, note: str = "", date=None) -> DataFrame:
    """The expenses with one more."""
    new = _rows(l, "amount double, note string, spent_at timestamp", (amount, note, date or datetime.now()))
    return l.expenses.unionByName(new.crossJoin(l.expenses.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))).select("id", F.col("amount").cast("decimal(12,2)").alias("amount"), "note", "spent_at"))


def _collector(l: Ledger, who: str, message: str = "", group: str = "", amount: float = 0.0) -> DataFrame:
    """The receipts after one, by its message or the group's latest, has got its collector."""
    if message:
        return updates.collected_by_message(l.receipts, l.messages, _rows(l, "wa_message_id string, who string", (message, who)))
    return updates.collected_latest(l.receipts, _rows(l, "claim long, grp string, what double, who string", (0, group, amount, who)))


def _forwarding(l: Ledger, action: str, source: str = "", target: str = "") -> DataFrame:
    """The rules: as they are (list), with one more (add) or without those of a source, or of all (remove)."""
    if action == "add":
        from_ = "dm" if source.strip().lower() in fn.V.PRIVATE_CHATS else resolve_groups(l, source)[0]
        return updates.upserted(l.rules, _rows(l, "source string, source_name string, target_jid string, target_name string, seq long", (from_, source, resolve_groups(l, target)[0], target, 0)), ["source", "target_jid"], ("source_name",))
    if action == "remove":
        return updates.without_keys(l.rules, _rows(l, "source string", (resolve_groups(l, source)[0] if source else "",)), "source", all_if_empty=True)
    return l.rules.orderBy("source", "target_jid")


def _phones(l: Ledger, action: str = "list", phone: str = "", name: str = "") -> DataFrame:
    """The owners of phones: as they are (list), with one set or one removed."""
    number = l.owners.sparkSession.range(1).select(fn.extract_phone(F.lit(phone)).alias("p")).first()["p"]
    if action != "list" and not number:
        raise BadCall(f"{phone!r} is no phone")
    if action == "set":
        return updates.upserted(l.owners, _rows(l, "phone string, owner string, seq long", (number, name, 0)), ["phone"])
    if action == "remove":
        return updates.without_keys(l.owners, _rows(l, "phone string", (number,)), "phone")
    return l.owners.orderBy("owner", "phone")


def _set(key: str, of_group: bool) -> Callable[..., DataFrame]:
    def run(l: Ledger, value: str) -> DataFrame:
        jid = resolve_groups(l, value)[0] if of_group else value
        return updates.upserted(l.settings, _rows(l, "key string, value string, seq long", (key, jid, 0)), ["key"])

    return run


def _pending(l: Ledger, uploads: DataFrame, group: str = "") -> DataFrame:
    """What is saved of a chat's buffered uploads, in the group that was named or the main one."""
    return updates.pending_receipts(uploads).withColumn("group_jid", F.lit(resolve_groups(l, group)[0]) if group.strip().lower() not in fn.V.MAIN_GROUP else _setting(l, "main_group"))


def _add_payment(l: Ledger, watch: int) -> DataFrame:
    return tables.payment_requests(l.watches.filter(F.col("id") == watch), l.contracts)


def _resolve_watch(l: Ledger, watch: int, client: int) -> DataFrame:
    return updates.resolved_watch(l.watches, l.clients, _rows(l, "id long, client long", (watch, client))).filter(F.col("id") == watch)


_PERIOD = {"start": ("date", True), "end": ("date", True), "groups": ("groups", False)}

TOOLS: dict[str, Tool] = {
    "send_finance_report": Tool(rp.finance_report, _PERIOD),
    "cards_report": Tool(_cards, _PERIOD | {"card": ("str", False)}),
    "senders_report": Tool(rp.sender_stats, _PERIOD | {"query": ("str", False)}),
    "person_report": Tool(rp.person_report, {"query": ("str", True), "start": ("date", False), "end": ("date", False), "group": ("str", False)}, for_all=True),
    "correct_operation": Tool(_correction, {"kind": ("str", True), "id": ("int", True), "field": ("str", True), "value": ("str", True)}),
    "find_operations": Tool(rp.find_operations, {"amount": ("float", True), "person": ("str", False), "start": ("date", False), "end": ("date", False), "group": ("str", False)}),
    "list_unclear_receipts": Tool(rp.unclear_items, {"group": ("str", False), "limit": ("int", False)}),
    "send_unclear_file": Tool(_unclear, {"code": ("str", True)}),
    "send_client_receipt": Tool(rp.receipt_files, {"person": ("str", True), "limit": ("int", False)}),
    "receipts_ledger": Tool(rp.receipts_ledger, _PERIOD | {"person": ("str", False), "limit": ("int", False)}),
    "missing_in_group": Tool(lambda l, target, **k: rp.missing_in_group(l, target, **k), {"target": ("str", True), "start": ("date", True), "end": ("date", True), "sources": ("groups", False), "person": ("str", False), "limit": ("int", False)}),
    "receipt_details": Tool(rp.receipt_details, {"person": ("str", True), "limit": ("int", False)}),
    "recount_everything": Tool(_recount, {}),
    "record_payment": Tool(_payments, {"text": ("str", True), "group": ("str", False)}),
    "record_expense": Tool(_expense, {"amount": ("float", True), "note": ("str", False), "date": ("date", False)}),
    "fix_receipt": Tool(_fix, {"code": ("str", True), "name": ("str", False), "amount": ("float", False), "date": ("date", False)}),
    "assign_receipt_collector": Tool(_collector, {"who": ("str", True), "message": ("str", False), "group": ("str", False), "amount": ("float", False)}),
    "manage_receipt_forwarding": Tool(_forwarding, {"action": ("str", True), "source": ("str", False), "target": ("str", False)}),
    "set_main_group": Tool(_set("main_group", True), {"value": ("str", True)}),
    "cmf_set_unmatched_branch": Tool(_set("unmatched_branch", False), {"value": ("str", True)}),
    "cmf_add_payment": Tool(_add_payment, {"watch": ("int", True)}),
    "cmf_resolve": Tool(_resolve_watch, {"watch": ("int", True), "client": ("int", True)}),
    "send_unclear_files": Tool(_unclear_files, {"group": ("str", False), "limit": ("int", False)}),
    "make_custom_pdf": Tool(lambda l, sections: tables.printed(sections), {"sections": ("table", True)}),
    "save_pending_receipts": Tool(_pending, {"uploads": ("table", True), "group": ("str", False)}),
    "delete_my_messages": Tool(lambda l, sent, n=1: tables.last_sent(sent, n), {"sent": ("table", True), "n": ("int", False)}),
    "expenses_report": Tool(rp.expenses_for_period, {"start": ("date", True), "end": ("date", True)}),
    "phone_memory": Tool(_phones, {"action": ("str", False), "phone": ("str", False), "name": ("str", False)}),
    "cmf_check_receipts": Tool(rp.reconcile, {"start": ("date", True), "end": ("date", True), "days": ("int", False)}),
}
