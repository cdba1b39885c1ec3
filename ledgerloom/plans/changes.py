"""Arrivals, corrections, answers, watches, sinks and extractions over the driver tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import folds, parsers, updates
from ledgerloom.plans import layouts, tables
from ledgerloom.plans import reports as rp
from ledgerloom.plans.oracle import END, START, _countable, _first, _in, _with
from ledgerloom.sources.ledger import Ledger, from_events

NOW = datetime(2024, 2, 15)
_R = ["id", "recipient_raw", "card_owner", "contact_id", "needs_review", "client_confirmed"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _double(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount", F.col("amount").cast("double"))


def _receipts_sent(l: Ledger, when: str, *more: Column) -> DataFrame:
    return l.messages.filter("has_media").filter(when).select("wa_message_id", *more)


def _new_name() -> Column:
    return _text("New ", F.col("id") % 3)


def _fixes(l: Ledger) -> DataFrame:
    named = F.when(F.col("id") % 2 == 0, _text("Fixed ", F.col("id") % 3)).otherwise("")
    return l.receipts.filter("id % 7 = 0").select("id", named.alias("name"), F.when(F.col("id") % 3 == 0, F.lit(77)).cast("long").alias("contact"), F.when(F.col("id") % 4 == 0, 12.5).otherwise(0).alias("new_amount"), F.when(F.col("id") % 5 == 0, F.lit("2024-01-15").cast("timestamp")).alias("new_date"))


def _since(l: Ledger) -> DataFrame:
    senders = l.messages.select(F.col("wa_group_jid").alias("grp"), F.col("sender_jid").alias("sender")).distinct()
    return senders.select("*", F.lit(START).cast("timestamp").alias("since"), F.lit("Named").alias("name"), F.lit(5).cast("long").alias("contact"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = F.when(F.col("k") % 5 == 0, "status@broadcast").when(F.col("k") % 5 == 1, _text("u", F.col("k") % 9, "@s.example")).otherwise(_text("g", F.col("k") % 4, "@g.example"))
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("k") % 7 == 0).alias("from_me"), chat.alias("chat"), (F.col("k") % 5 > 1).alias("is_group"), _text("u", F.col("k") % 9).alias("phone"), F.when(F.col("k") % 11 == 0, "m1").alias("revoked_id"))
    return updates.routed(rows, ["g1@g.example", "g2@g.example"], ["u1", "u3"]).select("id", "route")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cells = F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("x"))
    wide = F.slice(F.array(F.lit("Name"), F.lit("No"), F.lit("Mark")), 1, F.col("n_nationkey") % 4)
    title = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    total = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("sum"))).otherwise(F.array().cast("array<string>"))
    rows = n.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("section"), title.alias("title"), wide.alias("columns"), F.array(cells, F.array(F.lit("only"))).alias("rows"), total.alias("total"))
    return tables.printed(rows).select("doc", "section", "title", "nth", F.array_join("cells", "|").alias("cells"), F.element_at("widths", 1).alias("first_width"), F.size("widths").alias("columns"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of each event; amounts and fields differ by rule."""
    e = _events(spark, sf_dir).filter("event_id % 4 = 0").select(F.col("event_id").alias("id"), "k", F.floor("value").cast("double").alias("v"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("nth"))
    amount = F.when((F.col("k") + F.col("nth")) % 3 == 0, F.col("v") + F.col("nth")).when(F.col("k") % 7 == 0, 0.0).otherwise(F.col("v"))
    some = lambda c, m, r: F.when((F.col("k") + F.col("nth")) % m != r, _text(c, F.col("nth"))).otherwise("")
    kind = F.when((F.col("k") % 10 < 2) & (F.col("nth") < F.col("k") % 10 + 1), "cash").otherwise("receipt")
    return e.select("id", "nth", kind.alias("kind"), amount.alias("amount"), some("r", 2, 0).alias("recipient"), some("t", 3, 1).alias("datetime"), some("s", 4, 1).alias("sender"), some("b", 5, 2).alias("bank"), some("u", 2, 1).alias("status"), some("d", 3, 0).alias("doc_number"), some("q", 4, 2).alias("recipient_bank"))


def _receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    full = _text("СберБанк\nЧек по операции\nДата ", F.lpad((k % 28 + 1).cast("string"), 2, "0"), " июня 2026 14:05\nПолучатель: Тест ", k % 7, "\nОтправитель\nИванов И.\nКомиссия 0,00\nСумма перевода\n", k + 1, " 000,50 ₽\nНомер документа: ", F.col("event_id"), "\nСтатус: Исполнен")
    plain = _text("Исходящий перевод\nТестов Тест\n", k + 100, " ₽")
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(k % 2 == 0, full).otherwise(plain).alias("text"))
    return parsers.parse_receipts(e).withColumn("tx_time", F.col("tx_time").cast("string"))


def _messages_and_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    body = F.when(F.col("k") % 2 == 0, _text("Анна Ким ", F.col("k") + 1, "р аванс")).otherwise("у Ани забрали всё")
    messages = e.select(F.col("event_id").alias("id"), body.alias("body"), (F.col("k") % 5 == 0).alias("cash_hint"))
    payment = _text('Вот: {"payments":[{"name":" Ким ","amount":', F.col("k"), ',"cash":', F.when(F.col("k") % 4 == 0, "true").otherwise("false"), ',"collector":"Оля","note":"","card":""}],"clarify":""} готово')
    replies = e.filter("k % 3 <> 2").select(F.col("event_id").alias("id"), F.when(F.col("k") % 3 == 0, payment).otherwise("не знаю {плохо").alias("reply"))
    return parsers.model_payments(messages, replies)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    aliases = c.filter("c_custkey % 3 <> 0").select(F.lower("c_name").alias("alias"), F.col("c_name").alias("canonical"))
    raw = F.when(F.col("c_custkey") % 4 == 0, _text("  ", F.upper("c_name"), " ")).when(F.col("c_custkey") % 4 == 1, _text("г-н ", F.col("c_name"), ", К.")).when(F.col("c_custkey") % 4 == 2, "Милана Н.").otherwise(_text(F.col("c_name"), " Ахмед"))
    return parsers.resolve_names(c.select(F.col("c_custkey").alias("id"), raw.alias("raw")), parsers.with_built_in(aliases))


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.when(k % 6 == 0, 0.0).otherwise(F.floor("value").cast("double")).alias("amount"), F.when(k % 2 == 0, "").otherwise("Тестов Т.").alias("recipient"), F.when(k % 3 == 0, "").otherwise("Ким А.").alias("payer"),
        F.when(k % 5 == 0, "").otherwise("d1").alias("doc_number"), F.when(k % 4 == 0, None).otherwise(F.col("ts").cast("timestamp")).alias("tx_time"), (k % 7 != 0).alias("has_media"), F.when(k % 8 == 0, "чек по операции").otherwise("кот").alias("text"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.lit(1))).alias("received_at"),
    )
    return updates.gated(rows).select("id", "outcome", "needs_review", "client", "tx_date")


def _named_texts(l: Ledger) -> DataFrame:
    """Messages some of which name a client."""
    body = F.when(F.col("id") % 3 == 0, _text("Тестов Имя", F.element_at(F.array(F.lit("аа"), F.lit("бб")), (F.col("id") % 2 + 1).cast("int")))).when(F.col("id") % 3 == 1, "ок спасибо").otherwise(_text("500\nПетров Пётр"))
    return l.messages.withColumn("body", body)


def _silent(l: Ledger) -> DataFrame:
    waiting = rp.full_receipts(l).filter("not client_confirmed").select("id", F.col("group_jid").alias("grp"), F.col("sender_jid").alias("sender"), F.when(F.col("id") % 2 == 0, "тестов имяаа").otherwise("").alias("card_owner"), (F.col("received_at") + F.make_dt_interval(hours=F.lit(20))).alias("at"))
    aliases = l.contacts.filter("id < 0").select(F.col("canonical_name").alias("alias"), F.col("canonical_name").alias("canonical"))
    return updates.silently_resolved(waiting, _named_texts(l), aliases, minutes=20 * 60)


def _l(run: Callable[[Ledger], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(from_events(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sc02_routed": _chat_events,
    "sc06_message_text": lambda s, d: _events(s, d).select("event_id", fn.message_text(F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(_text("c", F.col("k"))), F.when(F.col("k") % 2 == 0, F.lit("ext")), F.lit("cap")).alias("text")),
    "sc09_json_items": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.explode(fn.json_items(F.when(F.col("c_custkey") % 3 == 0, _text('[{"id":', F.col("c_custkey"), '},{"id":7}]')).when(F.col("c_custkey") % 3 == 1, _text('{"clients":[{"id":', F.col("c_custkey"), "}]}")).otherwise('{"other":1}'), "struct<id:bigint>")).alias("x")).select("c_custkey", "x.id"),
    "sc10_json_block": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", fn.json_block(F.when(F.col("c_custkey") % 3 == 0, _text("so: ", '{"a": [', F.col("c_custkey"), "]} ok")).when(F.col("c_custkey") % 3 == 1, _text('x [{"a": ', F.col("c_custkey"), "}] y")).otherwise("none")).alias("block")),
    "sc11_chat_histories": _l(lambda l: rp.chat_histories(l).select("chat_key", "n", F.array_join("turns", "|").alias("turns"))),
    "sk01_arrived": _l(lambda l: updates.arrived(l.messages.withColumn("wa_message_id", _text("m", F.floor(F.col("id") / 3))), l.messages.filter("id % 15 = 0").select(_text("m", F.floor(F.col("id") / 3)).alias("wa_message_id"))).select("wa_message_id", "id")),
    "sk03_receipts_to_insert": _l(lambda l: updates.receipts_to_insert(l.receipts.select("id", "doc_number", "auth_code", "recipient_bank", "card_owner"))),
    "sk04_upserted_rules": _l(lambda l: updates.upserted(l.rules, l.rules.filter("source <> 'g1'").select("source", F.lit("other").alias("source_name"), F.col("target_jid"), F.explode(F.array(F.lit("one"), F.lit("two"))).alias("target_name")).withColumn("seq", F.when(F.col("target_name") == "one", 1).otherwise(2)), ["source", "target_jid"], ("source_name",))),
    "sk05_deleted_owners": _l(lambda l: updates.without_keys(l.owners, l.owners.filter("phone like '%2'").select("phone"), "phone")),
    "sk05_deleted_rules": _l(lambda l: updates.without_keys(l.rules, l.rules.limit(1).select(F.lit("").alias("source")), "source", all_if_empty=True).groupBy().agg(F.count("*").alias("n"))),
    "sk07_report_tables": _l(lambda l: rp.report_tables(l, datetime.fromisoformat(START), datetime.fromisoformat(END))),
    "sk08_printed": _sections,
    "sk09_last_sent": _l(lambda l: tables.last_sent(l.history.select(F.col("chat_key").alias("chat"), "seq", _text("m", F.col("seq")).alias("message_id")), 5, 3)),
    "sk11_payment_requests": _l(lambda l: tables.payment_requests(l.watches.filter("client_id is not null"), l.contracts)),
    "sk12_recorded_expenses": _l(lambda l: _double(l.expenses.unionByName(l.expenses.filter("id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), F.lit(5).cast("decimal(12,2)").alias("amount"), F.lit("new").alias("note"), "spent_at")))),
    "fn09_looks_messy": lambda s, d: parsers.looks_messy(_shapes(s, d)),
    "fn14_resolve_names": _names,
    "fn32_unclear_reason": _l(rp.unclear_with_reason),
    "tv02_parse_receipts": _receipt_texts,
    "tv02_receipt_layouts": layouts.receipt_layouts,
    "tv03_model_payments": _messages_and_replies,
    "tv04_merge_receipts": _l(lambda l: parsers.merge_receipts(l.receipts.select("id", "doc_number", "auth_code"), l.receipts.select("id", F.lit("m").alias("doc_number"), F.when(F.col("id") % 2 == 0, "n").otherwise("").alias("auth_code")), ["doc_number", "auth_code"], False).unionByName(parsers.merge_receipts(l.receipts.select((-F.col("id")).alias("id"), "doc_number", "auth_code"), l.receipts.select((-F.col("id")).alias("id"), F.lit("m").alias("doc_number"), F.when(F.col("id") % 2 == 0, "n").otherwise("").alias("auth_code")), ["doc_number", "auth_code"], True))),
    "tv05_caption_names": lambda s, d: parsers.caption_names(_events(s, d).select(F.col("event_id").alias("id"), F.when(F.col("k") % 2 == 0, "Тестов Тест 500").otherwise("что это?").alias("caption"))),
    "ag10_consensus_records": lambda s, d: parsers.consensus_records(_reads(s, d)),
    "j10_previous_cash": _l(lambda l: updates.previous_cash(l.transactions).withColumn("previous", F.col("previous").cast("timestamp"))),
    "j14_looked_up": _l(lambda l: updates.looked_up(l.clients.select(F.col("full_name").alias("name")).union(l.contacts.select("canonical_name")).union(l.contacts.filter("id < 40").select(_text("Recipient ", F.col("id")))).union(l.contacts.filter("id < 5").select(_text("No", F.col("id")))).distinct(), l.clients)),
    "st04_held_resolved": _l(lambda l: updates.held_resolved(l.transactions, l.transactions.filter("dup_pending").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("новый").alias("answer")), F.struct(F.lit(2).alias("seq"), F.when(F.col("id") % 3 == 0, "тот же").when(F.col("id") % 3 == 1, "хз").otherwise("да").alias("answer")))).alias("a")).select("id", "a.*")).select("id", "ignored", "dup_pending")),
    "st04_asked_payment": _l(lambda l: updates.asked_payment(l.transactions.select(_text("q", F.col("id") % 50).alias("ask_id"), "id"), l.transactions)),
    "st08_fixed_receipts": _l(lambda l: _double(updates.fixed_receipts(l.receipts, _fixes(l)).select(*_R, "amount", "tx_date"))),
    "st08_receipts_from_messages": _l(lambda l: updates.receipts_from_messages(l.messages, l.messages.filter("id % 50 = 0").select("id", F.when(F.col("id") % 100 == 0, "A").otherwise("").alias("name"), F.lit(3).cast("long").alias("contact"), F.lit(9.0).alias("new_amount"), F.lit(None).cast("timestamp").alias("new_date")))),
    "st08_filled_by_reply": _l(lambda l: _double(updates.filled_by_reply(l.receipts, l.messages, _receipts_sent(l, "id % 6 = 0", F.when(F.col("id") % 4 == 0, _new_name()).otherwise("").alias("name"), F.lit(7).cast("long").alias("contact"), F.when(F.col("id") % 3 == 0, 3.0).otherwise(0.0).alias("new_amount"))).select(*_R, "amount"))),
    "st08_reattributed": _l(lambda l: updates.reattributed(l.receipts, l.messages, _receipts_sent(l, "id % 6 = 1", _new_name().alias("name"), F.lit(7).cast("long").alias("contact"))).select(*_R)),
    "st08_reattributed_oldest": _l(lambda l: updates.reattributed_oldest(l.receipts, l.messages, _since(l)).select(*_R)),
    "st08_not_duplicates": _l(lambda l: updates.not_duplicates(l.receipts, l.contacts, l.receipts.filter("is_duplicate").select("amount").distinct().select(F.col("amount").alias("claim"), F.col("amount").alias("what"), F.lit("1").alias("person"), F.lit("").alias("grp"))).select("id", "is_duplicate", "ignored")),
    "st08_ignored_set": _l(lambda l: updates.ignored_set(l.receipts, l.receipts.filter("id in (104, 105, 106, 107, 108)").filter("not ignored").groupBy().agg(F.min("id").alias("id")).join(l.receipts.select("id", "ignored"), "id").select(F.lit("receipt").alias("kind"), "id", "ignored"), True).select("id", "ignored").filter("id between 90 and 110")),
    "st08_collected_by_message": _l(lambda l: updates.collected_by_message(l.receipts, l.messages, _receipts_sent(l, "id % 8 = 3", F.lit("Оля").alias("who"))).select("id", "submitted_by")),
    "st08_collected_latest": _l(lambda l: updates.collected_latest(l.receipts, l.groups.select(F.col("group_jid").alias("claim"), F.col("group_jid").alias("grp"), F.when(F.col("group_jid") == "g1", 10).otherwise(0).cast("decimal(12,2)").alias("what"), F.lit("Оля").alias("who"))).select("id", "submitted_by")),
    "st08_cash_collected": _l(lambda l: updates.cash_collected(l.transactions, l.transactions.filter("is_cash and id % 3 = 0").select("id", F.lit(1).alias("seq"), F.when(F.col("id") % 2 == 0, "у Дени").otherwise("наличка").alias("answer"))).select("id", "collector")),
    "st09_recount_receipts": _l(lambda l: updates.recount_receipts(l.receipts, l.contacts.filter("id = 3").select(F.lit("recipient").alias("alias"), F.col("canonical_name").alias("canonical")), l.contacts)),
    "st09_recount_messages": _l(lambda l: updates.recount_messages(l.messages.filter("not parsed and not has_media and not deleted").withColumn("body", F.when(F.col("id") % 2 == 0, _text("Анна Ким нал\n", F.col("id") % 90 + 10)).otherwise("привет всем")), l.contacts.filter("id = 1").select(F.lit("анна").alias("alias"), F.lit("Ким А.").alias("canonical")))),
    "st11_pending_receipts": _l(lambda l: updates.pending_receipts(l.messages.filter("has_media").select(F.col("wa_group_jid").alias("chat"), F.col("id").alias("seq")), 30)),
    "st12_checked_watches": _l(lambda l: updates.checked(l.watches, l.payments, NOW).select("id", "status")),
    "st13_spaced": _l(lambda l: updates.spaced(l.messages.select(F.col("wa_group_jid").alias("chat"), F.col("received_at").alias("ts"), "id"), 5 * 3600)),
    "st14_remembered_asks": _l(lambda l: updates.remembered_asks(l.messages.select(F.col("wa_group_jid").alias("kind"), _text("q", F.floor(F.col("id") / 2)).alias("ask_id"), F.col("id").alias("seq"), F.col("id").alias("about")), 40)),
    "st15_watched": _l(lambda l: updates.watched(l.watches, l.clients).select("id", "status", "client_id")),
    "st15_named_watch": _l(lambda l: updates.named_watch(l.watches, _since(l).drop("contact")).select("id", "status", "client_text")),
    "st15_resolved_watch": _l(lambda l: updates.resolved_watch(l.watches, l.clients, l.watches.filter("id % 2 = 0").select("id", F.lit(1).cast("long").alias("client"))).select("id", "status", "client_id", "client_text")),
    "st16_silently_resolved": _l(_silent),
    "st17_gated": _gates,
    "st06_revoked_counts": _l(lambda l: updates.revoked(l, l.messages.filter("id % 9 = 0").select("wa_message_id"))),
}


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.plans.checks import bodies

    return bodies(spark, sf_dir)


_TAKEN = "coalesce(nullif(card_owner, ''), nullif(recipient_raw, ''))"
_K = "select *, cast(json_extract(props, '$.k') as int) as k from events"

ORACLES: dict[str, str] = {
    "tv02_receipt_layouts": layouts.LAYOUTS_SQL,
    "sc02_routed": f"""with e as ({_K}) select event_id as id, case when k % 11 = 0 then 'revoke' when k % 5 > 1 then 'group' else 'private' end as route from e
      where k % 7 <> 0 and k % 5 <> 0 and (k % 11 = 0 or (k % 5 > 1 and k % 4 in (1, 2)) or (k % 5 = 1 and k % 9 in (1, 3)))""",
    "sc06_message_text": f"with e as ({_K}) select event_id, case when k % 3 <> 0 then 'c' || k when k % 2 = 0 then 'ext' else 'cap' end as text from e",
    "sc09_json_items": "select c_custkey, c_custkey as id from customer where c_custkey % 3 < 2 union all select c_custkey, 7 from customer where c_custkey % 3 = 0",
    "sc10_json_block": """select c_custkey, case c_custkey % 3 when 0 then '{"a": [' || c_custkey || ']}' when 1 then '[{"a": ' || c_custkey || '}]' else '' end as block from customer""",
    "sc11_chat_histories": "select conv_id as chat_key, count(*) as n, string_agg(text, '|' order by turn) as turns from conversations group by 1",
    "sk01_arrived": "select 'm' || (event_id // 3) as wa_message_id, arg_min(event_id, (ts + to_hours(k % 9 + case when k % 11 = 0 then 960 else 0 end), event_id)) as id from (" + _K + ") group by 1 having 'm' || (event_id // 3) not in (select 'm' || (event_id // 3) from events where event_id % 15 = 0)",
    "sk03_receipts_to_insert": _with("select id, nullif(doc_number, '') as doc_number, nullif(auth_code, '') as auth_code, nullif(recipient_bank, '') as recipient_bank, nullif(card_owner, '') as card_owner from br"),
    "sk04_upserted_rules": "select 'g' || r_regionkey as source, r_name as source_name, 'g' || ((r_regionkey + 1) % 4) as target_jid, case when r_regionkey = 1 then lower(r_name) else 'two' end as target_name from region",
    "sk05_deleted_owners": _with("select * from owners where phone not like '%2'"),
    "sk05_deleted_rules": "select cast(0 as bigint) as n",
    "sk07_report_tables": _with(
        "select section, row_number() over (partition by section order by last, case when section = 2 then -total end, label) as nth, label, cnt, cast(total as double) as total from z",
        f"""x as (
          select canonical_name, coalesce(nullif(card_to, ''), 'не указано') as card, amount, 0 as branch, id from t where {_in("tx_date")} and not ignored and not deleted and canonical_name is not null and {_countable("tx_date", START, END)}
          union all
          select canonical_name, coalesce(nullif(bank, ''), 'не указано'), amount, 1, id from {_first("key1", _in("tx_date") + " and live and not needs_review and canonical_name is not null")})""",
        """z as (
          select 1 as section, card as label, cast(null as bigint) as cnt, sum(amount) as total, 0 as last from x group by card
          union all select 2, first(canonical_name order by branch, id), count(*), sum(amount), 0 from x group by lower(canonical_name)
          union all select s, 'ИТОГО', null, coalesce(sum(amount), 0), 1 from (values (1), (2)) v(s) left join x on true group by s)""",
    ),
    "sk08_printed": """with s as (select n_regionkey as doc, n_nationkey as section, n_name, n_nationkey as k, n_nationkey % 4 as n from nation where n_nationkey % 4 > 0),
      l as (
        select *, 0 as nth, ['Name', 'No', 'Mark'] as line from s union all select *, 1, [n_name, cast(k as varchar), 'x'] from s union all select *, 2, ['only'] from s
        union all select *, 3, ['sum'] from s where k % 3 = 0)
      select doc, section, case when k % 2 = 0 then section || '. ' || n_name else '' end as title, nth,
             array_to_string([coalesce(line[i], '') for i in range(1, n + 1)], '|') as cells, case when n = 1 then 170.0::double else 76.5::double end as first_width, n as columns from l""",
    "sk09_last_sent": "select conv_id as chat, turn as seq, 'm' || turn as message_id from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
    "sk11_payment_requests": _with(
        """select w.id, case when n is null then 'none' when n = 1 then 'ready' else 'several' end as status, case when n = 1 then contract_id end as contract_id, case when n = 1 then branch_id end as branch_id, cast(floor(w.amount + 0.5) as bigint) as amount, w.tx_date as paid_at
        from watches w left join o using (client_id) where w.client_id is not null""",
        "o as (select client_id, count(*) as n, min(id) as contract_id, arg_min(branch_id, id) as branch_id from contracts where remaining > 0 group by 1)",
    ),
    "sk12_recorded_expenses": _with("select id, cast(amount as double) as amount, note, spent_at from expenses union all select id + 1000000, 5, 'new', spent_at from expenses where id % 2 = 0"),
    "fn09_looks_messy": f"with e as ({_K}) select event_id as id, k % 4 in (0, 2) as messy from e",
    "fn14_resolve_names": """with c as (select c_custkey as id, c_name, c_custkey % 4 as m, c_custkey % 3 <> 0 as known from customer)
      select id, case when m = 2 then 'Милана' when m = 3 and not known then 'Ахмед' when m in (0, 1) and known then c_name when m = 0 then '  ' || upper(c_name) || ' ' when m = 1 then 'г-н ' || c_name || ', К.' else c_name || ' Ахмед' end as canonical,
             m = 2 or (m = 3 and not known) or (m in (0, 1) and known) as matched from c""",
    "fn32_unclear_reason": _with(
        """select kind, id, case when kind = 'message' then 'фото/файл без распознанной операции' when amount = 0 and name = '' then 'не распознались ни сумма, ни получатель' when amount = 0 then 'получатель "' || name || '", сумма не распозналась'
        else 'получатель "' || name || '" — незнакомое имя, ' || cast(amount as bigint) || ' ₽' end as reason from x""",
        "x as (select 'receipt' as kind, id, recipient_raw as name, amount from r where needs_review and live union all select 'message', id, '', 0 from messages where has_media and not deleted and media_path <> '' and id not in (select id from br) and id not in (select id from tr))",
    ),
    "tv02_parse_receipts": f"""with e as ({_K})
      select event_id as id, 'Сбербанк' as bank, 'Тест ' || (k % 7) as recipient, 'Иванов И.' as sender, (k + 1) * 1000 + 0.5::double as amount, 0.0::double as commission, cast(event_id as varchar) as doc_number, '' as auth_code, 'Исполнен' as status, '2026-06-' || lpad(cast(k % 28 + 1 as varchar), 2, '0') || ' 14:05:00' as tx_time from e where k % 2 = 0
      union all select event_id, 'ВТБ', 'Тестов Тест', '', k + 100, 0, '', '', '', null from e where k % 2 = 1""",
    "tv03_model_payments": f"""with e as ({_K})
      select event_id as id, 0 as line_no, 'Ким' as raw_name, k * 1.0::double as amount, '' as note, case when k % 4 = 0 or k % 5 = 0 or k % 2 = 1 then 'наличные' else '' end as card_to, k % 4 = 0 or k % 5 = 0 or k % 2 = 1 as is_cash, 'Оля' as collector, true as by_model from e where k % 3 = 0 and k > 0
      union all select event_id, 0, 'Анна Ким', k + 1, 'аванс', '', k % 5 = 0, '', false from e where (k % 3 <> 0 or k = 0) and k % 2 = 0""",
    "tv04_merge_receipts": _with("select id, coalesce(nullif(doc_number, ''), 'm') as doc_number, coalesce(nullif(auth_code, ''), case when id % 2 = 0 then 'n' else '' end) as auth_code from br union all select -id, 'm', case when id % 2 = 0 then 'n' else auth_code end from br"),
    "tv05_caption_names": f"with e as ({_K}) select event_id as id, case when k % 2 = 0 then 'Тестов Тест' end as name from e",
    "ag10_consensus_records": f"""with e as ({_K}),
      x as (
        select event_id as id, nth, case when k % 10 < 2 and nth < k % 10 + 1 then 'cash' else 'receipt' end as kind,
               case when (k + nth) % 3 = 0 then floor(value) + nth when k % 7 = 0 then 0 else floor(value) end as amount,
               case when (k + nth) % 2 <> 0 then 'r' || nth else '' end as recipient, case when (k + nth) % 3 <> 1 then 't' || nth else '' end as datetime, case when (k + nth) % 4 <> 1 then 's' || nth else '' end as sender,
               case when (k + nth) % 5 <> 2 then 'b' || nth else '' end as bank, case when (k + nth) % 2 <> 1 then 'u' || nth else '' end as status, case when (k + nth) % 3 <> 0 then 'd' || nth else '' end as doc_number, case when (k + nth) % 4 <> 2 then 'q' || nth else '' end as recipient_bank
        from e, (values (0), (1), (2)) t(nth) where event_id % 4 = 0),
      y as (select *, (recipient <> '')::int + (datetime <> '')::int + (sender <> '')::int + (bank <> '')::int + (status <> '')::int + (doc_number <> '')::int as score, count(*) filter (kind = 'cash') over (partition by id) > count(*) filter (kind <> 'cash') over (partition by id) as is_cash from x),
      votes as (select id, amount, count(*) as n from y where kind <> 'cash' and amount > 0 group by 1, 2),
      w as (select id, case when max(n) >= 2 then first(amount order by n desc, amount) else (list_sort(list(amount)))[cast((count(*) + 1) // 2 as int)] end as winner from votes group by id),
      used as (
        select y.*, row_number() over (partition by y.id order by case when winner is null then 0 else -score end, nth) as o
        from y left join w using (id) where (is_cash and kind = 'cash') or (not is_cash and kind <> 'cash' and (winner is null or amount = winner))
        qualify case when is_cash then row_number() over (partition by y.id order by nth desc) = 1 when winner is null then row_number() over (partition by y.id order by nth) = 1 else true end)
      select id, case when any_value(is_cash) then 'cash' else 'receipt' end as kind, first(amount order by o) as amount, coalesce(first(recipient order by o) filter (recipient <> ''), '') as recipient, coalesce(first(datetime order by o) filter (datetime <> ''), '') as datetime,
             coalesce(first(sender order by o) filter (sender <> ''), '') as sender, coalesce(first(bank order by o) filter (bank <> ''), '') as bank, coalesce(first(status order by o) filter (status <> ''), '') as status, coalesce(first(doc_number order by o) filter (doc_number <> ''), '') as doc_number,
             coalesce(first(recipient_bank order by o) filter (recipient_bank <> ''), '') as recipient_bank from used group by id""",
    "j10_previous_cash": _with("select id, (select cast(max(p.tx_date) as timestamp) from tr p where p.contact_id = tr.contact_id and p.amount = tr.amount and p.is_cash and not p.ignored and not p.dup_pending and p.tx_date < tr.tx_date) as previous from tr where is_cash and not ignored"),
    "j14_looked_up": _with(
        """select name, case when w.n > 0 then w.n else coalesce(v.n, 0) end as n, case when w.n = 1 then w.client_id when coalesce(w.n, 0) = 0 and v.n = 1 then v.client_id end as client_id, coalesce(w.n, 0) > 0 as exact
        from names left join w using (name) left join v using (name)""",
        "names as (select full_name as name from clients union select c_name from customer union select 'Recipient ' || c_custkey from customer where c_custkey < 40 union select 'No' || c_custkey from customer where c_custkey < 5)",
        "w as (select name, count(*) as n, min(id) as client_id from names join clients on contains(lower(full_name), lower(name)) group by 1)",
        "v as (select name, count(distinct id) as n, min(id) as client_id from (select name, unnest(string_split(name, ' ')) as word from names where name not in (select name from w)) join clients on length(word) >= 3 and contains(lower(full_name), lower(word)) group by 1)",
    ),
    "st04_held_resolved": _with("select id, ignored or (dup_pending and id % 3 = 0) as ignored, false as dup_pending from tr"),
    "st04_asked_payment": _with("select 'q' || (id % 50) as ask_id, max(id) as id from tr where dup_pending and not ignored group by 1"),
    "st08_fixed_receipts": _with(f"""select id, case when id % 14 = 0 then 'Fixed ' || (id % 3) else recipient_raw end as recipient_raw, case when id % 14 = 0 then {_TAKEN} else card_owner end as card_owner, case when id % 21 = 0 then 77 else contact_id end as contact_id,
      needs_review and id % 7 <> 0 as needs_review, client_confirmed, case when id % 28 = 0 then 12.5 else cast(amount as double) end as amount, case when id % 35 = 0 then timestamp '2024-01-15' else tx_date end as tx_date from br"""),
    "st08_receipts_from_messages": _with("select id as raw_message_id, case when id % 100 = 0 then 'A' end as recipient_raw, cast(3 as bigint) as contact_id, 9.0::double as amount, received_at as tx_date, wa_group_jid as group_jid from messages where id % 50 = 0"),
    "st08_filled_by_reply": _with(
        f"""select id, case when hit and name <> '' then name else recipient_raw end as recipient_raw, case when hit and name <> '' then {_TAKEN} else card_owner end as card_owner, case when hit and name <> '' then 7 else contact_id end as contact_id, needs_review and not hit as needs_review,
        case when hit then (case when name = '' and money > 0 then client_confirmed else true end) else client_confirmed end as client_confirmed, case when hit and money > 0 then money else cast(amount as double) end as amount from x""",
        "x as (select *, id % 6 = 0 and not is_duplicate as hit, case when id % 4 = 0 then 'New ' || (id % 3) else '' end as name, case when id % 3 = 0 then 3.0::double else 0 end as money from br)",
    ),
    "st08_reattributed": _with(f"select id, case when hit then 'New ' || (id % 3) else recipient_raw end as recipient_raw, case when hit then {_TAKEN} else card_owner end as card_owner, case when hit then 7 else contact_id end as contact_id, needs_review and not hit as needs_review, client_confirmed or hit as client_confirmed from (select *, id % 6 = 1 and not is_duplicate as hit from br)"),
    "st08_reattributed_oldest": _with(
        f"select br.id, case when x.id is not null then 'Named' else recipient_raw end as recipient_raw, case when x.id is not null then {_TAKEN} else card_owner end as card_owner, case when x.id is not null then 5 else contact_id end as contact_id, needs_review and x.id is null as needs_review, client_confirmed or x.id is not null as client_confirmed from br left join x using (id)",
        f"x as (select id from r where not client_confirmed and not is_duplicate and not ignored and created_at > timestamp '{START}' qualify row_number() over (partition by group_jid, sender_jid order by created_at, id) = 1)",
    ),
    "st08_not_duplicates": _with("select br.id, is_duplicate and x.id is null as is_duplicate, ignored and x.id is null as ignored from br left join x using (id)", "x as (select id from r where is_duplicate and coalesce(canonical_name, recipient_raw, '') ilike '%1%' qualify row_number() over (partition by amount order by tx_date desc, id desc) = 1)"),
    "st08_collected_by_message": _with("select id, case when id % 8 = 3 then 'Оля' else submitted_by end as submitted_by from br"),
    "st08_collected_latest": _with("select br.id, case when x.id is not null then 'Оля' else submitted_by end as submitted_by from br left join x using (id)", "x as (select id from br where not is_duplicate and not ignored and (group_jid <> 'g1' or amount = 10) and group_jid in (select 'g' || r_regionkey from region) qualify row_number() over (partition by group_jid order by created_at desc, id desc) = 1)"),
    "st08_cash_collected": _with("select id, case when is_cash and id % 6 = 0 then 'Дени' else collector end as collector from tr"),
    "st09_recount_receipts": _with("select id, (select c_name from customer where c_custkey = 3) as canonical, cast(3 as bigint) as contact_id from br where contact_id is null and not ignored and not is_duplicate"),
    "st09_recount_messages": _with("select id as raw_message_id, 1 as line_no, 'Анна Ким нал' as raw_name, 'Ким А.' as canonical, cast(id % 90 + 10 as double) as amount, '' as note, '' as card_to, true as is_cash from messages where not parsed and not has_media and not deleted and id % 2 = 0"),
    "st08_ignored_set": _with("select id, ignored or id = (select min(id) from br where id between 104 and 108 and not ignored) as ignored from br where id between 90 and 110"),
    "st13_spaced": _with(
        "select id from w where free",
        "x as (select id, wa_group_jid as c, epoch(received_at) as s, row_number() over (partition by wa_group_jid order by received_at, id) as n from messages)",
        "w as (select c, cast(0 as bigint) as n, cast(null as bigint) as id, cast(-1e18 as double) as last, false as free from x group by 1 union all select x.c, x.n, x.id, case when x.s - w.last >= 18000 then x.s else w.last end, x.s - w.last >= 18000 from w join x on x.c = w.c and x.n = w.n + 1)",
    ).replace("with ", "with recursive ", 1),
    "st11_pending_receipts": _with("select wa_group_jid as chat, id as seq from messages where has_media qualify row_number() over (partition by wa_group_jid order by id desc) <= 30"),
    "st12_checked_watches": _with(
        "select w.id, case when d.id is null then w.status when exists (select 1 from payments p where p.client_id = d.client_id and p.amount in (cast(floor(d.amount + 0.5) as bigint), cast(floor(d.amount * 100 + 0.5) as bigint)) and cast(p.paid_at as date) between cast(d.tx_date as date) - 5 and cast(d.tx_date as date) + 5) then 'found' else 'reminded' end as status from watches w left join d using (id)",
        f"d as (select * from watches where status = 'watch' and created_at < timestamp '{NOW}' - interval 24 hour order by created_at, id limit 30)",
    ),
    "st14_remembered_asks": _with("select kind, ask_id, about from (select wa_group_jid as kind, 'q' || (id // 2) as ask_id, min(id) as f, max(id) as about from messages group by 1, 2) qualify row_number() over (partition by kind order by f desc, ask_id desc) <= 40"),
    "st15_watched": _with(
        "select w.id, case when status <> 'lookup' then status when coalesce(n, 0) = 0 then 'unmatched' when n = 1 then 'watch' else 'ambiguous' end as status, case when status = 'lookup' and n = 1 then c else client_id end as client_id from watches w left join m on m.name = w.client_text",
        "m as (select name, count(*) as n, min(id) as c from (select distinct client_text as name from watches where client_text <> '') join clients on contains(lower(full_name), lower(name)) group by 1)",
    ),
    "st15_named_watch": _with("select w.id, case when x.id is not null then 'lookup' else status end as status, case when x.id is not null then 'Named' else client_text end as client_text from watches w left join x using (id)", f"x as (select id from watches where status = 'noname' and created_at > timestamp '{START}' qualify row_number() over (partition by group_jid, sender_jid order by created_at desc, id desc) = 1)"),
    "st15_resolved_watch": _with("select id, case when hit then 'watch' else status end as status, case when hit then 1 else client_id end as client_id, case when hit then coalesce(nullif(client_text, ''), (select full_name from clients where id = 1)) else client_text end as client_text from (select *, status in ('ambiguous', 'unmatched', 'noname') and id % 2 = 0 as hit from watches)"),
    "st16_silently_resolved": _with(
        "select id, name from x where row_number = 1",
        "b as (select *, case id % 3 when 0 then 'Тестов Имя' || ['аа', 'бб'][id % 2 + 1] when 2 then 'Петров Пётр' end as name from messages where not deleted)",
        """x as (select r.id, b.name, row_number() over (partition by r.id order by b.received_at desc, b.id desc) as row_number
          from r join (select *, row_number() over () as z from b) b on b.wa_group_jid = r.group_jid and b.sender_jid = r.sender_jid and b.received_at between r.received_at and r.received_at + interval 20 hour
          where not r.client_confirmed and b.name is not null and not (r.id % 2 = 0 and lower(b.name) = 'тестов имяаа')
            and (select count(*) from b o where o.wa_group_jid = b.wa_group_jid and o.sender_jid = b.sender_jid and o.received_at <= r.received_at + interval 20 hour and (o.received_at, o.id) > (b.received_at, b.id)) < 15)""",
    ),
    "st17_gated": f"""with e as ({_K}),
      x as (select event_id as id, k, ts, case when k % 6 = 0 then 0 else floor(value) end as amount, case when k % 3 <> 0 then 'Ким А.' when k % 2 = 0 then '' else 'Тестов Т.' end as client from e),
      y as (select *, case when amount > 0 and k % 4 = 0 and k % 7 <> 0 and k % 5 = 0 and client = '' then 'incomplete' when amount = 0 or client = '' then (case when k % 8 = 0 or amount > 0 or client <> '' or k % 5 <> 0 then 'unknown' else 'no_receipt' end) else 'receipt' end as outcome from x)
      select id, outcome, outcome <> 'receipt' or k % 3 = 0 as needs_review, client, case when k % 4 = 0 then ts + interval 1 hour else ts end as tx_date from y""",
    "st06_revoked_counts": _with("select wa_message_id, (select count(*) from tr where tr.id = m.id and not ignored) as transactions, (select count(*) from br where br.id = m.id and not ignored and not is_duplicate) as receipts from messages m where m.id % 9 = 0"),
}
