"""The reports in the SQL that checks them, over the same derived ledger."""

from __future__ import annotations

START, END = "2024-01-05", "2024-01-20"
MONTH, MONTH_END = "2024-01-01", "2024-02-01"
LATE, LATE_END = "2024-02-01", "2024-03-01"
EARLY = "2024-01-01 12:00:00"

LEDGER = """
ev as (
  select event_id, ts, user_id, event_type, cast(json_extract(props, '$.k') as int) as k, cast(floor(value) as decimal(12,2)) as amount
  from events),
e as (select *, ts + to_hours(k % 9 + case when k % 11 = 0 then 960 else 0 end) as received_at, event_type in ('purchase', 'view') as pic from ev),
messages as (
  select event_id as id, case when k % 20 = 10 then 'm' || (event_id - 1) || '-fwd-g1' else 'm' || event_id end as wa_message_id, 'g' || (k % 4) as wa_group_jid, '7900' || lpad(cast(k % 12 as varchar), 7, '0') || '@s.example' as sender_jid,
         '7900' || lpad(cast(k % 12 as varchar), 7, '0') as phone, 'Sender ' || (k % 12) as sender_name, 'message ' || k as body, pic as has_media,
         case when pic and k % 2 = 0 then 'media/' || event_id end as media_path, received_at, k % 23 <> 0 as parsed, k = 77 as deleted
  from e),
owners as (select '7900' || lpad(cast(n_nationkey as varchar), 7, '0') as phone, n_name as owner from nation where n_nationkey < 6),
br as (
  select event_id as id, case when k <> 33 then user_id end as contact_id, 'Recipient ' || (k % 7) as recipient_raw, amount, ts as tx_date, 'g' || (k % 4) as group_jid,
         case when k % 3 = 0 then '' else 'd' || user_id || '-' || cast(amount as bigint) end as doc_number, case when k % 4 = 0 then 'a' || user_id else '' end as auth_code,
         'Bank' || (k % 5) as bank, case when k % 4 = 0 then '' else 'RBank' || (k % 3) end as recipient_bank,
         case when k % 5 = 0 then '' when k % 2 = 1 then lower('Card Owner ' || (k % 6)) else 'Card Owner ' || (k % 6) end as card_owner,
         case when k % 6 = 0 then 'Submitter ' || (k % 5) else '' end as submitted_by, k % 10 = 0 as needs_review, k = 55 as is_duplicate, k = 13 as ignored,
         k % 10 <> 0 as client_confirmed, k % 17 = 0 as clarify_asked, received_at as created_at
  from e where pic and k <> 44),
tr as (
  select event_id as id, user_id as contact_id, 'Raw ' || user_id as raw_name, amount, cast(ts as date) as tx_date, case when event_type = 'signup' then 'cash' else '' end as card_to,
         case when k % 8 = 0 then 'Collector ' || (k % 3) else '' end as collector, event_type = 'signup' as is_cash, k = 21 as dup_pending, k % 19 = 0 as collector_asked, event_id % 3 = 0 as dup_asked, k = 13 as ignored, received_at as created_at
  from e where not pic and k % 23 <> 0),
payments as (
  select event_id as payment_id, user_id as client_id, cast(amount as bigint) * case when k % 7 = 0 then 100 else 1 end as amount, ts + to_days(k % 8) as paid_at
  from e where pic and k % 4 <> 1),
clients as (
  select c_custkey as id, c_name as full_name from customer where c_custkey % 7 <> 0
  union all select c_custkey + 10000000, c_name || ' Jr' from customer where c_custkey % 11 = 0 union all select 20000000, 'Old Recipient'),
contracts as (select o_orderkey as id, o_custkey as client_id, 'b' || (o_orderkey % 3) as branch_id, case when o_orderstatus = 'O' then cast(floor(o_totalprice) as bigint) else 0 end as remaining from orders),
watches as (
  select event_id as id, 'g' || (k % 4) as group_jid, '7900' || lpad(cast(k % 12 as varchar), 7, '0') || '@s.example' as sender_jid,
         case when k % 5 = 0 then '' else 'Customer#' || lpad(cast(user_id as varchar), 9, '0') end as client_text, case when k % 5 = 2 then user_id end as client_id,
         amount, ts as tx_date, ['noname', 'lookup', 'watch', 'ambiguous', 'unmatched'][k % 5 + 1] as status, received_at as created_at
  from e where pic and k % 3 = 1),
expenses as (select event_id as id, amount, 'note ' || (k % 4) as note, ts as spent_at from e where event_type = 'error' and k % 5 = 0),
r as (
  select br.*, m.wa_message_id, m.wa_group_jid, m.sender_jid, m.phone, m.sender_name, m.media_path, m.received_at, m.deleted, c.c_name as canonical_name, o.owner,
         not is_duplicate and not ignored and not deleted as live,
         coalesce(cast(contact_id as varchar), '') || '|' || amount || '|' || coalesce(nullif(doc_number, ''), cast(tx_date as varchar)) as key1,
         coalesce(cast(contact_id as varchar), recipient_raw, '') || '|' || amount || '|' || coalesce(nullif(doc_number, ''), cast(tx_date as varchar)) as key2
  from br join messages m using (id) left join customer c on c.c_custkey = contact_id left join owners o on o.phone = m.phone),
t as (
  select tr.*, m.wa_group_jid, m.sender_jid, m.phone, m.sender_name, m.received_at, m.deleted, c.c_name as canonical_name, o.owner
  from tr join messages m using (id) left join customer c on c.c_custkey = contact_id left join owners o on o.phone = m.phone)
"""

PAIRED = "exists (select 1 from r b where b.contact_id = t.contact_id and b.amount = t.amount and not b.needs_review and not b.is_duplicate and not b.ignored and b.group_jid = t.wa_group_jid and b.{date} >= timestamp '{a}' and b.{date} < timestamp '{b}')"


def _in(column: str, a: str = START, b: str = END) -> str:
    return f"{column} >= timestamp '{a}' and {column} < timestamp '{b}'"


def _countable(date: str, a: str, b: str) -> str:
    return "not dup_pending and (is_cash or not " + PAIRED.format(date=date, a=a, b=b) + ")"


def _first(key: str, where: str, order: str = "created_at, id") -> str:
    return f"(select * from r where {where} qualify row_number() over (partition by {key} order by {order}) = 1)"


def _with(body: str, *more: str) -> str:
    return "with " + ",".join([LEDGER, *more]) + body


def _summary(texts: str, receipts: str) -> str:
    rows = f"""x as (
      select canonical_name, coalesce(nullif(card_to, ''), 'не указано') as card, amount, 0 as branch, id from t where {texts}
      union all
      select canonical_name, coalesce(nullif(bank, ''), 'не указано'), amount, 1, id from {receipts}),
    y as (select lower(canonical_name) as key, card, sum(amount) as amount, count(*) as n, min((branch, id, canonical_name)) as first from x group by all)"""
    return _with("select min(first)[3] as name, cast(sum(amount) as double) as total, cast(sum(n) as bigint) as cnt, string_agg(card || '=' || amount, ';' order by card || '=' || amount) as by_card from y group by key", rows)


def _senders(receipts: str, texts: str, where: str = "true") -> str:
    rows = f"""x as (
      select coalesce(nullif(owner, ''), nullif(submitted_by, ''), nullif(sender_name, ''), '') as sender, phone, amount from {_first('key2', receipts + ' and live and amount > 0')}
      union all
      select coalesce(nullif(collector, ''), nullif(owner, ''), nullif(sender_name, ''), ''), phone, amount from t where {texts} and not ignored and not deleted and amount > 0)"""
    return _with(f"select sender, phone, count(*) as cnt, cast(sum(amount) as double) as total from x where {where} group by all", rows)


_NAMED = "group_jid in (select 'g' || r_regionkey from region where r_name ilike '%asia%' or r_name ilike '%euro%')"
_NAME = "coalesce(canonical_name, recipient_raw, '')"
_BY = "coalesce(nullif(submitted_by, ''), nullif(sender_name, ''), nullif(phone, ''), '')"

_LEDGER_ROWS = f"""x as (
  select 'чек' as kind, id, {_NAME} as client, cast(amount as double) as amount, tx_date, {_BY} as submitted_by, '' as collector, group_jid as grp, bank, card_owner
  from r where {_in('tx_date')} and live and amount > 0
  union all
  select case when is_cash then 'наличка' else 'перевод' end, id, coalesce(canonical_name, raw_name, ''), cast(amount as double), cast(tx_date as timestamp), sender_name, collector, wa_group_jid, card_to, ''
  from t where {_in('tx_date')} and not ignored and not deleted and amount > 0 and {_countable('tx_date', START, END)})"""

_EXCLUDED = f"""x as (
  select 'needs_review' as bucket, amount from (
    select * from r where {_in('tx_date')} and (needs_review or contact_id is null) and live and amount > 0
      and not exists (select 1 from t where t.contact_id = r.contact_id and t.amount = r.amount and not t.ignored and not t.dup_pending and not t.deleted and {_in('t.tx_date')} and t.wa_group_jid = r.group_jid)
      and not exists (select 1 from r o where o.id <> r.id and not o.needs_review and o.live and {_in('o.tx_date')} and ((r.doc_number <> '' and o.doc_number = r.doc_number) or starts_with(r.wa_message_id, o.wa_message_id || '-fwd-')))
    qualify row_number() over (partition by key2 order by created_at, id) = 1)
  union all
  select 'held_cash', amount from t where {_in('tx_date')} and is_cash and dup_pending and not ignored and not deleted and amount > 0
  union all
  select 'text_duplicate', amount from t where {_in('tx_date')} and not is_cash and not dup_pending and not ignored and not deleted and amount > 0 and {PAIRED.format(date='tx_date', a=START, b=END)}),
ex as (select b.bucket, count(x.amount) as cnt, cast(coalesce(sum(x.amount), 0) as double) as total from (values ('needs_review'), ('held_cash'), ('text_duplicate')) b(bucket) left join x using (bucket) group by 1)"""


_UNCLEAR = "x as (select 'receipt' as kind, id, group_jid as grp, recipient_raw as name, cast(amount as double) as amount, tx_date as happened_at, coalesce(media_path, '') as media_path, sender_name as who from r where needs_review and live union all select 'message', id, wa_group_jid, '', 0.0::double, received_at, media_path, sender_name from messages where has_media and not deleted and media_path <> '' and id not in (select id from br) and id not in (select id from tr))"

_QUESTIONS = {
    "unconfirmed": ("r", "group_jid", "live and not client_confirmed and not clarify_asked and amount > 0"),
    "collector": ("t", "wa_group_jid", "is_cash and not ignored and not deleted and collector = '' and not dup_pending and not collector_asked and amount > 0"),
    "cash_repeat": ("t", "wa_group_jid", "is_cash and not ignored and not deleted and dup_pending and not dup_asked and amount > 0"),
    "unrecognized": ("r", "group_jid", "live and not clarify_asked and amount <= 0"),
}


def _waiting(kind: str, now: str) -> str:
    table, group, where = _QUESTIONS[kind]
    return f"select id, {group} as grp, cast(amount as double) as amount, created_at, count(*) over (partition by {group}) as waiting, row_number() over (partition by {group} order by created_at, id) as nth from {table} where {where} and created_at < timestamp '{now}' - interval 90 second"


def _queue(kind: str, now: str = LATE_END, most: int = 1000) -> str:
    gate = "" if kind == "cash_repeat" else f"and waiting <= {most}"
    return _with(f"select id, grp, amount, waiting from x where nth <= 2 {gate}", f"x as ({_waiting(kind, now)})")


def _suspicious(where: str, least: float, times: float, r: str = "r") -> str:
    return _with(
        f"select id, group_jid, cast(amount as double) as amount, n, median from x where n >= 30 and median > 0 and amount > {times} * median",
        f"""x as (select a.id, a.group_jid, a.amount, count(*) as n, cast(quantile_cont(cast(b.amount as double), 0.5) as double) as median
          from (select * from {r} where live and amount >= {least} and {where}) a join (select * from {r} where live and amount > 0) b on b.group_jid = a.group_jid and b.created_at >= cast(cast(a.created_at as date) - interval 3 month as date) and b.created_at <= a.created_at
          group by 1, 2, 3)""",
    )


def _cycle(now: str) -> str:
    every = " union all ".join(f"select {n} as q, '{k}' as question, * from ({_waiting(k, now)}) {'' if k == 'cash_repeat' else 'where waiting <= 6'}" for n, k in enumerate(_QUESTIONS))
    return _with("select grp, question, id, amount from x order by grp, q, created_at, id limit 2", f"x as ({every})")


def _reconcile(where: str) -> str:
    """Receipts take payments one by one, by recursion over each client's receipts."""
    return _with(
        """select n.id, n.name, case when k = 1 then n.c end as client_id, case when k = 1 and exact then w.payment_id end as payment_id,
                  case when k = 1 and exact then (case when w.payment_id is null then 'missing' else 'added' end) else 'attention' end as status,
                  case when k = 0 then 'no client' when k > 1 then 'several clients' when not exact then 'alike' else '' end as why
           from n left join w on w.id = n.id""",
        f"rc as (select id, {_NAME} as name, amount, tx_date from r where live and amount > 0 and {_NAME} <> '' and {where})",
        "whole as (select name, count(*) as k, min(c.id) as c from (select distinct name from rc) join clients c on contains(lower(full_name), lower(name)) group by 1)",
        "byword as (select name, count(distinct c.id) as k, min(c.id) as c from (select name, unnest(string_split(name, ' ')) as word from (select distinct name from rc) where name not in (select name from whole)) join clients c on length(word) >= 3 and contains(lower(full_name), lower(word)) group by 1)",
        "n as (select rc.*, coalesce(a.k, b.k, 0) as k, coalesce(a.c, b.c) as c, a.k is not null as exact from rc left join whole a using (name) left join byword b using (name))",
        "sure as (select *, row_number() over (partition by c order by tx_date desc, id) as i, max(tx_date) over (partition by c) as newest from n where k = 1 and exact)",
        """avail as (select s.c, list({'id': p.payment_id, 'a': p.amount} order by p.paid_at, p.payment_id) as free
                     from (select distinct c, newest from sure) s join payments p on p.client_id = s.c and cast(p.paid_at as date) between cast(newest as date) - 5 and cast(newest as date) + 5 group by 1)""",
        """z as (
             select s.c, cast(0 as bigint) as i, cast(null as bigint) as id, cast(null as bigint) as payment_id, coalesce(free, []) as free from (select distinct c from sure) s left join avail using (c)
             union all
             select c, i, id, pick.id, case when pick is null then free else list_filter(free, lambda x: x.id <> pick.id) end
             from (select s.c, s.i, s.id, z.free, list_filter(z.free, lambda x: x.a = cast(floor(s.amount + 0.5) as bigint) or x.a = cast(floor(s.amount * 100 + 0.5) as bigint))[1] as pick from z join sure s on s.c = z.c and s.i = z.i + 1))""",
        "w as (select * from z where id is not null)",
    ).replace("with ", "with recursive ", 1)


_PEOPLE = f"""p as (select 'client' as section, name as label, cnt, total from ({_summary(f"{_in('tx_date')} and not ignored and not deleted and canonical_name is not null and " + _countable('tx_date', START, END), _first('key1', _in('tx_date') + ' and live and not needs_review and canonical_name is not null'))}))"""


def oracle_sql() -> dict[str, str]:
    texts = "not ignored and not deleted and canonical_name is not null and "
    return {
        "rp01_summary_for_period": _summary(_in("tx_date") + " and " + texts + _countable("tx_date", START, END), _first("key1", _in("tx_date") + " and live and not needs_review and canonical_name is not null")),
        "rp02_summary_by_chat": _summary(_in("received_at", LATE, LATE_END) + " and " + texts + _countable("received_at", LATE, LATE_END), _first("key1", _in("received_at", LATE, LATE_END) + " and " + _in("tx_date", MONTH, MONTH_END) + " and live and not needs_review and canonical_name is not null")),
        "rp03_old_operations": _with(f"select {_NAME} as name, cast(amount as double) as amount, tx_date, coalesce(nullif(submitted_by, ''), nullif(sender_name, ''), '') as submitted_by from {_first('key2', _in('received_at', LATE, LATE_END) + ' and not (' + _in('tx_date', '2024-01-20', MONTH_END) + ') and live and not needs_review and amount > 0', 'tx_date, created_at, id')} order by key2 limit 15"),
        "rp04_sender_stats": _senders(_in("tx_date"), _in("tx_date") + " and " + _countable("tx_date", START, END)),
        "rp05_sender_stats_by_chat": _senders(_in("received_at", LATE, LATE_END) + " and " + _in("tx_date", MONTH, MONTH_END), _in("received_at", LATE, LATE_END) + " and " + _countable("received_at", LATE, LATE_END)),
        "rp06_card_totals": _with(f"select min_by(card, (created_at, id)) as card_owner, coalesce(min_by(bank, (created_at, id)) filter (bank <> ''), '') as bank, count(*) as cnt, cast(sum(amount) as double) as total from (select coalesce(nullif(card_owner, ''), nullif(recipient_raw, ''), 'не распознано') as card, coalesce(nullif(recipient_bank, ''), nullif(bank, ''), '') as bank, amount, created_at, id from {_first('key2', _in('tx_date') + ' and live and amount > 0')}) group by lower(card)"),
        "fn28_cards_of_named_groups": _with(f"select min_by(card, (created_at, id)) as card_owner, coalesce(min_by(bank, (created_at, id)) filter (bank <> ''), '') as bank, count(*) as cnt, cast(sum(amount) as double) as total from (select coalesce(nullif(card_owner, ''), nullif(recipient_raw, ''), 'не распознано') as card, coalesce(nullif(recipient_bank, ''), nullif(bank, ''), '') as bank, amount, created_at, id from {_first('key2', _in('tx_date') + ' and live and amount > 0 and ' + _NAMED)}) group by lower(card)"),
        "rp07_person_report": _with(
            """select c_name as name, coalesce(r_cnt, 0) as receipt_cnt, cast(coalesce(r_total, 0) as double) as receipt_total, coalesce(t_cnt, 0) as payment_cnt, cast(coalesce(t_total, 0) as double) as payment_total, least(r_first, t_first) as first_op, greatest(r_last, t_last) as last_op
            from customer left join a on c_custkey = a.contact_id left join b on c_custkey = b.contact_id
            where c_name ilike '%1%' and (coalesce(r_cnt, 0) > 0 or coalesce(t_cnt, 0) > 0) order by coalesce(r_total, 0) + coalesce(t_total, 0) desc, c_custkey limit 5""",
            "a as (select contact_id, count(*) as r_cnt, sum(amount) as r_total, min(tx_date) as r_first, max(tx_date) as r_last from r where live group by 1)",
            "b as (select contact_id, count(*) as t_cnt, sum(amount) as t_total, cast(min(tx_date) as timestamp) as t_first, cast(max(tx_date) as timestamp) as t_last from t where not ignored and not deleted group by 1)",
        ),
        "rp08_receipts_ledger": _with("select * exclude (nth), (select count(*) from x) > 200 as truncated from (select *, row_number() over (order by tx_date desc, kind, id) as nth from x) where nth <= 200", _LEDGER_ROWS),
        "rp09_missing_in_group": _with(
            "select * from x order by tx_date desc, kind, id limit 200",
            f"""x as (
              select 'чек' as kind, id, {_NAME} as client, cast(amount as double) as amount, tx_date, group_jid as grp, {_BY} as who, doc_number as doc
              from r where {_in('tx_date')} and live and not needs_review and amount > 0 and group_jid <> 'g1'
                and not exists (select 1 from r o where o.group_jid = 'g1' and o.live and not o.needs_review and ((r.doc_number <> '' and o.doc_number = r.doc_number)
                  or (r.doc_number = '' and o.contact_id = r.contact_id and o.amount = r.amount and o.tx_date between r.tx_date - interval 3 day and r.tx_date + interval 3 day)))
              union all
              select 'наличка', id, coalesce(canonical_name, raw_name, ''), cast(amount as double), cast(tx_date as timestamp), wa_group_jid, coalesce(nullif(collector, ''), nullif(sender_name, ''), phone), ''
              from t where {_in('tx_date')} and is_cash and not ignored and not deleted and not dup_pending and amount > 0 and wa_group_jid <> 'g1' and contact_id is not null
                and not exists (select 1 from t o where o.wa_group_jid = 'g1' and o.is_cash and not o.ignored and not o.deleted and o.contact_id = t.contact_id and o.amount = t.amount and o.tx_date between t.tx_date - interval 3 day and t.tx_date + interval 3 day))""",
        ),
        "rp10_exclusions": _with("select * from ex", _EXCLUDED),
        "rp11_recent_outside_period": _with(f"select {_NAME} as name, cast(amount as double) as amount, tx_date from r where live and amount > 0 and {_NAME} <> '' and created_at >= timestamp '2024-01-10' and not ({_in('tx_date')}) order by created_at desc, id limit 12"),
        "rp12_receipts_for_period": _with(f"select id, {_NAME} as name, cast(amount as double) as amount, tx_date, group_jid from r where live and amount > 0 and {_in('tx_date')}"),
        "rp13_receipt_details": _with(f"select id, {_NAME} as name, cast(amount as double) as amount, tx_date, bank, recipient_raw, recipient_bank, card_owner, doc_number, auth_code, needs_review, client_confirmed, group_jid, {_BY} as submitted_by from r where not is_duplicate and not ignored and {_NAME} ilike '%customer%1%' order by tx_date desc, id limit 40"),
        "rp14_receipt_files": _with(f"select id, {_NAME} as name, cast(amount as double) as amount, tx_date, media_path from r where live and media_path <> '' and {_NAME} ilike '%1%' order by tx_date desc, id limit 15"),
        "rp15_find_operations": _with("select kind, id, name, cast(amount as double) as amount, tx_date, grp, ignored from x where amount = 10 order by tx_date desc, kind, id limit 10", f"x as (select 'transaction' as kind, id, coalesce(canonical_name, raw_name) as name, amount, cast(tx_date as timestamp) as tx_date, wa_group_jid as grp, ignored from t where not deleted union all select 'receipt', id, {_NAME}, amount, tx_date, group_jid, ignored from r where not is_duplicate and not deleted)"),
        "rp16_unclear_items": _with("select * from x order by happened_at desc, kind, id limit 50", _UNCLEAR),
        "rp17_group_medians": _with("select group_jid, count(*) as n, cast(quantile_cont(cast(amount as double), 0.5) as double) as median from r where live and amount > 0 and created_at >= timestamp '2024-01-01' group by 1"),
        "rp18_suspicious_amounts": _suspicious("created_at >= timestamp '2024-01-01'", 20, 3),
        "rp18_suspicious_by_default": _suspicious("true", 100000, 12, "(select * replace (case when id % 50 = 0 then amount * 10000 else amount end as amount) from r)"),
        **{f"rp19_queue_{k}": _queue(k) for k in _QUESTIONS},
        **{f"rp19_gated_{k}": _queue(k, LATE if k == "cash_repeat" else EARLY, 6) for k in _QUESTIONS},
        "rp19_cycle": _cycle(EARLY),
        "rp01_in_groups": _summary(_in("tx_date") + " and wa_group_jid in ('g1', 'g3') and " + texts + _countable("tx_date", START, END), _first("key1", _in("tx_date") + " and group_jid in ('g1', 'g3') and live and not needs_review and canonical_name is not null")),
        "rp04_by_name_or_phone": _senders(_in("tx_date") + " and group_jid in ('g2', 'g3')", _in("tx_date") + " and wa_group_jid in ('g2', 'g3') and " + _countable("tx_date", START, END), "sender ilike '%er 1%' or phone like '%er 1%'"),
        "rp07_bounded": _with(
            """select c_name as name, coalesce(r_cnt, 0) as receipt_cnt, cast(coalesce(r_total, 0) as double) as receipt_total, coalesce(t_cnt, 0) as payment_cnt, cast(coalesce(t_total, 0) as double) as payment_total, least(r_first, t_first) as first_op, greatest(r_last, t_last) as last_op
            from customer left join a on c_custkey = a.contact_id left join b on c_custkey = b.contact_id
            where c_name ilike '%2%' and (coalesce(r_cnt, 0) > 0 or coalesce(t_cnt, 0) > 0) order by coalesce(r_total, 0) + coalesce(t_total, 0) desc, c_custkey limit 5""",
            f"a as (select contact_id, count(*) as r_cnt, sum(amount) as r_total, min(tx_date) as r_first, max(tx_date) as r_last from r where live and group_jid = 'g2' and {_in('tx_date')} group by 1)",
            f"b as (select contact_id, count(*) as t_cnt, sum(amount) as t_total, cast(min(tx_date) as timestamp) as t_first, cast(max(tx_date) as timestamp) as t_last from t where not ignored and not deleted and wa_group_jid = 'g2' and {_in('tx_date')} group by 1)",
        ),
        "rp08_of_a_person": _with("select * exclude (nth), (select count(*) from y) > 20 as truncated from (select *, row_number() over (order by tx_date desc, kind, id) as nth from y) where nth <= 20", _LEDGER_ROWS, "y as (select * from x where client ilike '%customer#00000001_%' and grp in ('g0', 'g2'))"),
        "rp16_of_a_group": _with("select * from x where grp = 'g2' order by happened_at desc, kind, id limit 5", _UNCLEAR),
        "rp21_unconfirmed_from": _with("select distinct group_jid as grp, sender_jid as sender from r where not client_confirmed and not is_duplicate and not ignored and created_at > timestamp '2024-02-20'"),
        "rp22_watch_list": _with("select * replace (cast(amount as double) as amount) from watches where status in ('ambiguous', 'unmatched') order by created_at desc, id desc limit 50"),
        "rp22_due_watches": _with(f"select * replace (cast(amount as double) as amount) from watches where status = 'watch' and created_at < timestamp '{LATE}' - interval 24 hour order by created_at, id limit 30"),
        "rp22_latest_noname": _with(f"select group_jid, sender_jid, arg_max(id, (created_at, id)) as id from watches where status = 'noname' and created_at > timestamp '{START}' group by all"),
        "rp26_phone_owners": _with("select * from owners"),
        "rp26_rules": "select 'g' || r_regionkey as source, r_name as source_name, 'g' || ((r_regionkey + 1) % 4) as target_jid, lower(r_name) as target_name from region",
        "rp26_settings": "select ['main_group', 'working_group', 'unmatched_branch'][r_regionkey + 1] as key, 'g' || (r_regionkey + 1) as value from region where r_regionkey < 3",
        "rp27_finance_report_with_notes": f"with {_PEOPLE}, l as (with {LEDGER}, {_EXCLUDED} select 'left_out' as section, bucket as label, cnt, total from ex), o as (with {LEDGER} select * from r where live and amount > 0 and {_NAME} <> '' and created_at >= timestamp '2024-01-20 12:00:00' and not ({_in('tx_date')}) order by created_at desc, id limit 12) select * from p union all select * from l union all select 'outside', {_NAME}, count(*), cast(sum(amount) as double) from o group by all union all select 'sum', 'total', sum(cnt), sum(total) from p union all select 'sum', 'maximum', sum(cnt), sum(total) from (select cnt, total from p union all select cnt, total from l where label <> 'text_duplicate')",
        "rp27_finance_report_by_chat": f"""with p as (select 'client' as section, name as label, cnt, total from ({_summary(_in("received_at", LATE, LATE_END) + " and " + texts + _countable("received_at", LATE, LATE_END), _first("key1", _in("received_at", LATE, LATE_END) + " and " + _in("tx_date", LATE, LATE_END) + " and live and not needs_review and canonical_name is not null"))})),
          o as (with {LEDGER} select {_NAME} as label, amount from {_first('key2', _in('received_at', LATE, LATE_END) + ' and not (' + _in('tx_date', LATE, LATE_END) + ') and live and not needs_review and amount > 0', 'tx_date, created_at, id')} order by key2 limit 50)
          select * from p union all select 'old', label, count(*), cast(sum(amount) as double) from o group by 2 union all select 'sum', 'old', count(*), cast(sum(amount) as double) from o having count(*) > 0 union all select 'sum', 'total', coalesce(sum(cnt), 0), coalesce(sum(total), 0) from p""",
        "rp29_month_context": f"""with p as (select name as label, cnt, total from ({_summary(_in("tx_date", MONTH, MONTH_END) + " and " + texts + _countable("tx_date", MONTH, MONTH_END), _first("key1", _in("tx_date", MONTH, MONTH_END) + " and live and not needs_review and canonical_name is not null"))}))
          select 'client' as section, label, cnt, total from p union all select 'sum', 'total', sum(cnt), sum(total) from p union all select 'group', r_name, null, null from region union all select 'person', c_name, null, null from customer
          union all select 'rule', r_name || ' > ' || lower(r_name), null, null from region union all select 'setting', ['main_group', 'working_group', 'unmatched_branch'][a.r_regionkey + 1] || '=' || b.r_name, null, null from region a join region b on b.r_regionkey = a.r_regionkey + 1 where a.r_regionkey < 3""",
        "rp30_same_as": _with(
            "select r.id, r.tx_date from r, p where r.live and r.group_jid = p.group_jid and coalesce(cast(r.contact_id as varchar), r.recipient_raw) = cast(p.contact_id as varchar) and r.amount = p.amount and (r.doc_number = '' or r.doc_number = p.doc_number) and abs(epoch(r.tx_date) - epoch(p.tx_date)) <= 1728000 order by r.tx_date, r.id limit 1",
            "p as (select * from r where live and doc_number <> '' and contact_id is not null order by id limit 1)",
        ),
        "rp31_media_path": _with("select 'message' as kind, id, media_path from messages where id = (select min(id) from messages where media_path <> '') union all select 'receipt', br.id, media_path from br join messages using (id) where br.id = (select min(br.id) from br join messages using (id) where media_path <> '')"),
        "rp20_unparsed_messages": _with("select id, wa_group_jid, body, received_at from messages where not parsed and not has_media and not deleted and id not in (select id from tr where ignored is null) and id not in (select id from tr) order by received_at, id limit 100"),
        "rp20_unresolved_receipts": _with("select id, recipient_raw, group_jid from br where contact_id is null and not ignored and not is_duplicate"),
        "rp21_recent_sender_texts": _with(f"select id, body, received_at from messages where sender_jid = '79000000001@s.example' and wa_group_jid = 'g1' and {_in('received_at')} and not deleted order by received_at desc, id limit 15"),
        "rp23_reconcile": _reconcile(_in("tx_date")),
        "rp23_reconcile_group": _reconcile(_in("tx_date") + " and group_jid = 'g1'"),
        "rp24_has_payment_around": _with(f"select id from r where {_in('tx_date')} and live and amount > 0 and exists (select 1 from payments p where p.client_id = r.contact_id and (p.amount = r.amount or p.amount = r.amount * 100) and cast(p.paid_at as date) between cast(r.tx_date as date) - 5 and cast(r.tx_date as date) + 5)"),
        "rp25_expenses": _with(f"select id, cast(amount as double) as amount, note, spent_at from expenses where {_in('spent_at')} union all select null, cast(coalesce(sum(amount), 0) as double), 'total', null from expenses where {_in('spent_at')}"),
        "rp26_contacts": "select c_custkey as id, c_name as canonical_name from customer",
        "rp27_finance_report": f"with {_PEOPLE}, l as (with {LEDGER}, {_EXCLUDED} select 'left_out' as section, bucket as label, cnt, total from ex) select * from p union all select * from l union all select 'sum', 'total', sum(cnt), sum(total) from p union all select 'sum', 'maximum', sum(cnt), sum(total) from (select cnt, total from p union all select cnt, total from l where label <> 'text_duplicate')",
        "rp28_monthly_report": _summary(_in("tx_date", MONTH, MONTH_END) + " and " + texts + _countable("tx_date", MONTH, MONTH_END), _first("key1", _in("tx_date", MONTH, MONTH_END) + " and live and not needs_review and canonical_name is not null")),
    }
