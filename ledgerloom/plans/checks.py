"""Parsers, folds, sinks and streams over the driver tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import folds, parsers
from ledgerloom.plans.oracle import LEDGER
from ledgerloom.sources.ledger import from_events
from ledgerloom.streaming import flows

DAY = 86400


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of the events, each of one of four shapes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, n = F.get_json_object("props", "$.k").cast("int"), (F.floor("value") + 1).cast("string")
    body = F.when(k % 4 == 0, F.concat(F.lit("Иван Петров\n"), n, F.lit("\n\n"), n, F.lit("т премия")))
    body = body.when(k % 4 == 1, F.concat(F.lit("Анна Ким "), n, F.lit("р аванс"))).when(k % 4 == 2, n).otherwise(F.concat(F.lit("скинул на карту сбер 1."), F.lpad(n, 3, "0"), F.lit(" вчера")))
    return e.select(F.col("event_id").alias("id"), body.alias("body"))


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in three habits, read back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("v"))
    plain, european = F.col("v").cast("string"), F.translate(F.format_number("v", 2), ",.", ".,")
    spaced = F.translate(F.format_number("v", 2), ",.", " ,")
    return o.select("o_orderkey", fn.parse_money(F.concat(plain, F.lit(" руб"))).alias("plain"), fn.parse_money(F.concat(european, F.lit(" ₽"))).alias("european"), fn.parse_money(spaced).alias("spaced"))


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("n"))
    written = F.concat(F.lit("8 9"), F.substring("n", 1, 2), F.lit(" "), F.substring("n", 3, 3), F.lit("-"), F.substring("n", 6, 4))
    return c.select("c_custkey", fn.normalize_phone(written).alias("phone"), fn.extract_phone(F.concat(F.lit("тел. "), written)).alias("found"))


def _stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flows.event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.floor("value").cast("decimal(12,2)").alias("amount"))
    return flows.drained(flows.daily_totals(e), "complete")


def _stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that each come twice, once."""
    e = flows.event_stream(spark, sf_dir).select(F.concat(F.lit("m"), F.floor(F.col("event_id") / 2)).alias("wa_message_id"), F.col("ts").cast("timestamp").alias("received_at"))
    return flows.drained(flows.messages_once(e, late="60 days")).select("wa_message_id")


def _pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as receipts and clicks as names."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type in ('purchase', 'click')")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("g"), k % 4).alias("grp"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("sender"), "ts", F.when(F.col("event_type") == "click", "name").otherwise("receipt").alias("kind"), F.concat(F.lit("Name "), "user_id").alias("text"))


def _revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some messages, taken back two days after they were recorded."""
    return from_events(spark, sf_dir).receipts.filter("id % 9 = 0").select("raw_message_id", (F.col("created_at") + F.make_dt_interval(days=F.lit(2))).alias("at"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of some payments a day later: new, the same, or nothing clear."""
    said = F.when(F.col("id") % 4 == 2, "хз").when(F.col("id") % 8 == 1, "новый").otherwise("тот же")
    return from_events(spark, sf_dir).transactions.filter("id % 4 in (1, 2)").select("id", (F.col("created_at") + F.make_dt_interval(days=F.lit(1))).alias("at"), said.alias("answer"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fn01_parse_money": _money,
    "fn22_phones": _phones,
    "fn09_consensus_amount": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.collect_list(F.floor("value").cast("double")).alias("v")).select("user_id", fn.consensus_amount("v").alias("amount")),
    "fn23_format_money": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fn.format_money("o_totalprice").alias("shown")),
    "tv01_parse_messages": lambda s, d: parsers.parse_messages(bodies(s, d)),
    "st01_pair_names": lambda s, d: folds.pair_names(_pair_events(s, d), ttl_seconds=3 * 3600),
    "st02_duplicate_receipts": lambda s, d: folds.duplicate_receipts(from_events(s, d).receipts, 5 * DAY, _revoked(s, d)),
    "st03_held_cash": lambda s, d: folds.held_cash(from_events(s, d).transactions, from_events(s, d).messages, answers=_answers(s, d)),
    "st06_promoted": lambda s, d: folds.promoted(from_events(s, d).receipts, from_events(s, d).receipts.filter("id % 3 = 0").select("raw_message_id"), 20 * DAY),
    "st07_false_duplicates": lambda s, d: folds.false_duplicates(from_events(s, d).receipts, DAY),
    "st08_corrected": lambda s, d: folds.corrected(
        from_events(s, d).receipts.select("id", "bank", "amount", "needs_review"),
        from_events(s, d).receipts.filter("id % 5 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("bank").alias("field"), F.lit("Fixed").alias("value")), F.struct(F.lit(2).alias("seq"), F.lit("amount").alias("field"), F.lit("7.5").alias("value")), F.struct(F.lit(3).alias("seq"), F.lit("bank").alias("field"), F.lit("Last").alias("value")))).alias("c")).select("id", "c.*"),
        ["bank", "amount", "needs_review"],
    ).withColumn("amount", F.col("amount").cast("double")),
    "st10_forwarded": lambda s, d: folds.forwarded(
        from_events(s, d).messages.select("wa_message_id", F.col("wa_group_jid").alias("source"), F.col("wa_group_jid").alias("grp")),
        from_events(s, d).groups.select(F.col("group_jid").alias("source"), F.lit("g2").alias("target_jid")),
    ),
    "st20_stream_daily_totals": _stream_days,
    "sk01_messages_once": _stream_once,
    "sk04_latest": lambda s, d: folds.latest(from_events(s, d).messages.withColumn("half", F.floor(F.col("id") / 2)), ["half"], "id").select("half", "id"),
    "sk06_history_last_n": lambda s, d: folds.last_n(from_events(s, d).history, "chat_key", "seq", 3).select("chat_key", "seq", "from_user"),
}

# Both by the statements that look for an original at insertion: live rows recorded before, on either side of the operation's time.
_FOLD = f"""with recursive {LEDGER},
i as (
  select group_jid || '/' || amount as key, epoch_us(created_at) as seen, 0 as nth, id, cast(epoch(tx_date) as bigint) as s, contact_id as contact, recipient_raw as raw, doc_number as doc, auth_code as auth
  from br where not ignored and amount > 0),
x as (
  select *, row_number() over (partition by key order by seen, nth, id) as n
  from (select * from i union all select * replace (seen + {2 * DAY * 1000000} as seen, 1 as nth) from i where id % 9 = 0)),
w as (
  select distinct key, cast(0 as bigint) as n, cast(null as bigint) as id, 0 as nth, false as is_copy, cast(null as bigint) as freed,
         cast([] as struct(seen bigint, id bigint, s bigint, contact bigint, raw varchar, doc varchar, auth varchar)[]) as org, cast([] as struct(seen bigint, id bigint, s bigint, contact bigint, raw varchar, doc varchar, auth varchar)[]) as cop from x
  union all
  select key, n, id, nth, nth = 0 and hit, case when was_org then best.id end,
         case when nth = 0 and not hit then list_append(org, own) when was_org and best is not null then list_append(list_filter(org, lambda o: o.id <> z.id), best) when was_org then list_filter(org, lambda o: o.id <> z.id) else org end,
         case when nth = 0 and hit then list_append(cop, own) when was_org and best is not null then list_filter(cop, lambda o: o.id <> best.id) when nth = 1 then list_filter(cop, lambda o: o.id <> z.id) else cop end
  from (
    select x.*, w.org, w.cop, {{'seen': x.seen, 'id': x.id, 's': x.s, 'contact': x.contact, 'raw': x.raw, 'doc': x.doc, 'auth': x.auth}} as own,
           nth = 1 and len(list_filter(w.org, lambda o: o.id = x.id)) > 0 as was_org,
           len(list_filter(w.org, lambda o: abs(x.s - o.s) <= {5 * DAY} and (case when x.contact is not null then coalesce(o.contact = x.contact, false) else o.raw = x.raw end) and (o.doc = '' or x.doc = '' or o.doc = x.doc) and (o.auth = '' or x.auth = '' or o.auth = x.auth))) > 0 as hit,
           list_reverse_sort(list_filter(w.cop, lambda o: (x.doc <> '' and o.doc = x.doc) or (x.auth <> '' and o.auth = x.auth) or (coalesce(o.contact = x.contact, false) and abs(x.s - o.s) <= {5 * DAY})))[1] as best
    from (select key, n, org, cop from w) w join x on x.key = w.key and x.n = w.n + 1) z)
select id, is_copy, id in (select freed from w where freed is not null) as freed from w where id is not null and nth = 0"""

_HELD = f"""with recursive {LEDGER},
i as (
  select wa_group_jid || '/' || contact_id || '/' || amount as key, epoch_us(created_at) as seen, '' as answer, id, tx_date as d
  from t where is_cash and not ignored and amount > 0),
x as (
  select *, row_number() over (partition by key order by seen, answer, id) as n
  from (select * from i union all select * replace (seen + {DAY * 1000000} as seen, case when id % 8 = 1 then 'new' else 'same' end as answer) from i where id % 4 = 1)),
w as (
  select distinct key, cast(0 as bigint) as n, cast(null as bigint) as id, '' as answer, '' as result, cast([] as date[]) as counted, cast([] as bigint[]) as held from x
  union all
  select key, n, id, answer, case when answer = '' then (case when hit then 'held' else '' end) when was then answer else '' end,
         case when (answer = '' and not hit) or (was and answer = 'new') then list_append(counted, d) else counted end,
         case when answer = '' and hit then list_append(held, id) when answer <> '' then list_filter(held, lambda h: h <> z.id) else held end
  from (select x.*, w.counted, w.held, x.answer <> '' and list_contains(w.held, x.id) as was, len(list_filter(w.counted, lambda c: c between x.d - 30 and x.d)) > 0 as hit
        from (select key, n, counted, held from w) w join x on x.key = w.key and x.n = w.n + 1) z)
select a.id, a.result = 'held' as held, coalesce(b.result, '') as answer from w a left join w b on b.id = a.id and b.answer <> '' where a.id is not null and a.answer = ''"""

_PAIRS = """with recursive x as (
  select event_id as id, 'g' || (cast(json_extract(props, '$.k') as int) % 4) || '/s' || (user_id % 10) as key, epoch(ts) as s, event_type = 'click' as is_name, 'Name ' || user_id as t,
         row_number() over (partition by cast(json_extract(props, '$.k') as int) % 4, user_id % 10 order by epoch(ts), event_id) as n
  from events where event_type in ('purchase', 'click')),
w as (
  select distinct key, cast(0 as bigint) as n, cast(null as bigint) as rid, cast(null as varchar) as name, cast([] as struct(s double, t varchar)[]) as names, cast([] as struct(s double, id bigint)[]) as waits from x
  union all
  select key, n, case when is_name and len(rc) > 0 then rc[1].id when not is_name and len(nm) > 0 then id end, case when is_name and len(rc) > 0 then t when not is_name and len(nm) > 0 then nm[1].t end,
         case when is_name then (case when len(rc) > 0 then nm else list_append(nm, {'s': s, 't': t})[-20:] end) else nm[2:] end,
         case when is_name then rc[2:] when len(nm) > 0 then rc else list_append(rc, {'s': s, 'id': id}) end
  from (select x.*, list_filter(w.names, lambda a: x.s - a.s <= 10800) as nm, list_filter(w.waits, lambda a: x.s - a.s <= 10800) as rc from w join x on x.key = w.key and x.n = w.n + 1))
select event_id as id, w.name from events left join w on w.rid = event_id where event_type = 'purchase'"""

ORACLES: dict[str, str] = {
    "st01_pair_names": _PAIRS,
    "fn01_parse_money": "select o_orderkey, cast(round(o_totalprice, 2) as double) as plain, cast(round(o_totalprice, 2) as double) as european, cast(round(o_totalprice, 2) as double) as spaced from orders",
    "fn22_phones": "select c_custkey, '79' || lpad(cast(c_custkey as varchar), 9, '0') as phone, '79' || lpad(cast(c_custkey as varchar), 9, '0') as found from customer",
    "fn09_consensus_amount": """with v as (select user_id, floor(value) as x, count(*) as n from events group by 1, 2),
      b as (select user_id, first(x order by n desc, x) as best, max(n) as most from v group by 1)
      select b.user_id, case when most >= 2 then best else (select quantile_disc(floor(value), 0.5) from events e where e.user_id = b.user_id) end as amount from b""",
    "fn23_format_money": "select o_orderkey, replace(format('{:,}', cast(round_even(o_totalprice, 0) as bigint)), ',', ' ') as shown from orders",
    "tv01_parse_messages": """with e as (select event_id as id, cast(json_extract(props, '$.k') as int) % 4 as m, cast(floor(value) + 1 as bigint) as n from events)
      select id, 1 as line_no, 'Иван Петров' as raw_name, cast(n as double) as amount, '' as note, '' as card_to, null as unparsed from e where m = 0
      union all select id, 3, 'Иван Петров', case when n < 1000 then n * 1.0 else n end, 'премия', '', null from e where m = 0
      union all select id, 0, 'Анна Ким', n, 'аванс', '', null from e where m = 1
      union all select id, 0, null, null, null, null, n || ' (сумма без имени)' from e where m = 2
      union all select id, 0, '(не указано)', 1000 + n, '', 'сбер', null from e where m = 3""",
    "st02_duplicate_receipts": _FOLD,
    "st03_held_cash": _HELD,
    "st06_promoted": f"with {LEDGER} select o.id as original, c.id from br o join br c on c.is_duplicate and not c.ignored and c.id % 3 <> 0 and c.group_jid = o.group_jid and ((c.doc_number <> '' and c.doc_number = o.doc_number) or (c.auth_code <> '' and c.auth_code = o.auth_code) or (c.contact_id = o.contact_id and c.amount = o.amount and abs(epoch(c.tx_date) - epoch(o.tx_date)) <= {20 * DAY})) where not o.is_duplicate and not o.ignored and o.id % 3 = 0 qualify row_number() over (partition by o.id order by c.created_at desc, c.id desc) = 1",
    "st07_false_duplicates": f"with {LEDGER} select id from br b where is_duplicate and not exists (select 1 from br o where not o.is_duplicate and o.group_jid = b.group_jid and ((b.doc_number <> '' and o.doc_number = b.doc_number) or (b.auth_code <> '' and o.auth_code = b.auth_code) or (o.contact_id = b.contact_id and o.amount = b.amount and abs(epoch(o.tx_date) - epoch(b.tx_date)) <= {DAY})))",
    "st08_corrected": f"with {LEDGER} select id, case when id % 5 = 0 then 'Last' else bank end as bank, case when id % 5 = 0 then 7.5 else cast(amount as double) end as amount, needs_review from br",
    "st10_forwarded": f"with {LEDGER} select wa_message_id || '-fwd-g2' as wa_message_id, 'g2' as grp from messages where wa_group_jid <> 'g2' and wa_group_jid in (select 'g' || r_regionkey from region)",
    "st20_stream_daily_totals": "select date_trunc('day', ts) as day, event_type as kind, count(*) as cnt, cast(sum(cast(floor(value) as decimal(12,2))) as double) as total from events group by 1, 2",
    "sk01_messages_once": "select distinct 'm' || (event_id // 2) as wa_message_id from events",
    "sk04_latest": "select event_id // 2 as half, max(event_id) as id from events group by 1",
    "sk06_history_last_n": "select conv_id as chat_key, turn as seq, role = 'user' as from_user from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
}
