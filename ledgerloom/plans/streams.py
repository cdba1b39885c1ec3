"""Rules on arrivals, as folds and as streams with state, over the driver tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from glob import glob
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import attribution, updates
from ledgerloom.plans.oracle import LEDGER
from ledgerloom.sources import remote
from ledgerloom.sources.ledger import from_events
from ledgerloom.session import scratch
from ledgerloom.streaming import attribution as attribution_stream
from ledgerloom.streaming import flows, snapshots, stateful

HOUR, DAY = 3600, 86400
PHOTOS = attribution.Limits(cash=8 * HOUR)
LIMITS = attribution.Limits(names=3 * HOUR, cash=5 * HOUR, most=3, quotes=20 * DAY)


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def chat_events(events: DataFrame) -> DataFrame:
    """What is said and sent in the chats: names, with amounts and without, receipts, payments, pictures of cash, and replies."""
    k, kind = _k(), F.col("event_type")
    what = F.when(kind.isin("click", "error"), "name").when(kind == "signup", "payment").when((kind == "view") & (k % 3 == 0), "photo").otherwise("receipt")
    name = F.when(kind.isin("click", "error"), F.concat(F.lit("Name "), "user_id")).when((kind == "signup") & (k % 5 == 0), F.concat(F.lit("Line "), "user_id"))
    name = name.when(kind.isin("view", "purchase") & (k % 9 == 0), F.concat(F.lit("Written "), k))
    amount = F.when(kind.isin("error", "signup") | ((kind == "view") & (k % 12 == 0)), F.floor("value").cast("double"))
    reply = F.when(kind.isin("click", "error", "signup") & (F.col("event_id") % 2 == 0), F.concat(F.lit("m"), F.col("event_id") - 1 - k % 3))
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("g"), k % 4).alias("grp"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("sender"), F.col("ts").cast("timestamp").alias("ts"), what.alias("kind"), name.alias("name"), amount.alias("amount"), (F.col("event_id") % 6 == 0).alias("paired"), F.concat(F.lit("m"), "event_id").alias("message"), reply.alias("quoted"))


def _attributed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = flows.with_a_last_beat(chat_events(flows.event_stream(spark, sf_dir)), "grp")
    return flows.drained(attribution_stream.attributed(events, LIMITS))


def uploads(events: DataFrame) -> DataFrame:
    """Uploads into four chats, and now and then a command that saves them to a group."""
    flush = F.col("event_id") % 40 == 0
    return events.select(F.concat(F.lit("c"), _k() % 4).alias("chat"), F.col("event_id").alias("id"), "ts", F.when(flush, "flush").otherwise("upload").alias("kind"), F.when(flush, F.concat(F.lit("g"), _k() % 3)).alias("target"))


def asks(events: DataFrame) -> DataFrame:
    """Questions of four kinds, some asked again, and replies to questions of before."""
    reply = F.col("event_id") % 3 == 0
    ask = F.floor(F.col("event_id") / 5) - F.when(reply, _k()).otherwise(0)
    return events.select(F.concat(F.lit("k"), _k() % 4).alias("kind"), F.col("event_id").alias("id"), "ts", F.when(reply, "reply").otherwise("ask").alias("what"), F.concat(F.lit("q"), ask).alias("ask_id"), F.col("event_id").alias("about"))


def watched(events: DataFrame) -> DataFrame:
    """A watch for each event, half of them begun twice, and a third settled after some hours."""
    of = lambda kind, hours: F.struct(F.lit(kind).alias("kind"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=hours)).alias("ts"))
    some = F.when(F.col("event_id") % 3 == 0, F.array(of("watch", F.lit(0)), of("settled", _k()))).when(F.col("event_id") % 3 == 1, F.array(of("watch", F.lit(0)), of("watch", F.lit(5))))
    return events.select(F.col("event_id").alias("id"), F.inline(F.coalesce(some, F.array(of("watch", F.lit(0))))))


def paid_and_revoked(events: DataFrame) -> DataFrame:
    """Payments, two to a message and some of them twice, and revocations of messages before and behind."""
    text = lambda c: F.concat(F.lit("m"), F.floor(c / 2))
    pay = F.struct(text(F.col("event_id")).alias("message"), F.col("event_id").alias("id"), F.lit("payment").alias("what"))
    revoke = F.struct(text(F.col("event_id") - 9 + _k()).alias("message"), F.col("event_id").alias("id"), F.lit("revoke").alias("what"))
    rows = F.when(_k() % 7 == 0, F.array(pay, revoke)).when(_k() % 7 == 1, F.array(pay, pay)).otherwise(F.array(pay))
    return events.select(F.inline(rows), "ts", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.floor("value").cast("decimal(18,2)").alias("amount"))


def _stream(events: Callable[[DataFrame], DataFrame], key: str, rule: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flows.drained(rule(flows.with_a_last_beat(events(flows.event_stream(spark, sf_dir)), key)))


def _totals_after_revokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals that payments enter and, revoked, leave again, batch by batch in a table of their own."""
    path = scratch(spark)
    table = snapshots.Snapshot(spark, path, "day date, kind string, cnt long, total decimal(28,2)", ["day", "kind"], snapshots.summed(["day", "kind"], cnt="cnt", total="total"), 8)
    rows = stateful.signed(flows.with_a_last_beat(paid_and_revoked(flows.event_stream(spark, sf_dir)), "message"))
    snapshots.upserted(rows.filter("day is not null").select("day", "kind", F.col("sign").alias("cnt"), (F.col("sign") * F.col("amount")).alias("total")), table, f"{path}-state").awaitTermination()
    return table.read().filter("cnt > 0").select(F.col("day").cast("timestamp").alias("day"), "kind", "cnt", F.col("total").cast("double").alias("total"))


def in_files(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The events as a stream of ``n`` files, one a batch, in their order: files are read as they were written, one after another."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path, last = scratch(spark), events.agg(F.max("event_id")).first()[0]
    for i in range(n):
        events.filter(F.floor(F.col("event_id") * n / (last + 1)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _upserted_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last that each user did, with when they were first seen, kept up to date over four batches."""
    path = scratch(spark)
    table = snapshots.Snapshot(spark, path, "user_id long, event_id long, event_type string, first_id long", ["user_id"], snapshots.last_by(["user_id"], "event_id", keep=("first_id",)), 8)
    rows = in_files(spark, sf_dir, 4).select("user_id", "event_id", "event_type", F.col("event_id").alias("first_id"))
    snapshots.upserted(rows, table, f"{path}-state").awaitTermination()
    return table.read()


def _arrived_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many deliveries each message had, and how many of them it existed at, over four batches."""
    path = scratch(spark)
    table = snapshots.Arrivals(spark, path, "wa_message_id string, seq long", ["wa_message_id"], "seq", 8)
    rows = in_files(spark, sf_dir, 4).select(F.concat(F.lit("m"), F.floor(F.col("event_id") / 3) % 500).alias("wa_message_id"), F.col("event_id").alias("seq"))
    snapshots.upserted(rows, table, f"{path}-state").awaitTermination()
    told = table.told().groupBy("wa_message_id").agg(F.count("*").alias("n"), F.count_if("existed").alias("existed"))
    return told.join(table.read().select("wa_message_id"), "wa_message_id")


def _paged_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other program's clients, from a folder of pages that stands for it: its tokens last for three pages, and its lists are wrapped now and then."""
    clients, limit = from_events(spark, sf_dir).clients, 40
    path = scratch(spark)
    nth = F.row_number().over(Window.orderBy("id"))
    pages = clients.select(F.col("id").cast("string").alias("id"), "full_name", F.floor((nth - 1) / limit).alias("page"))
    pages = pages.groupBy("page").agg(F.to_json(F.collect_list(F.struct("id", "full_name"))).alias("list"))
    body = F.when(F.col("page") % 3 == 0, F.col("list")).when(F.col("page") % 3 == 1, F.concat(F.lit('{"items":'), "list", F.lit("}"))).otherwise(F.concat(F.lit('{"total":1,"data":'), "list", F.lit("}")))
    pages.select(body.alias("value"), "page").repartition("page").write.partitionBy("page").text(path)
    folder, used = path.removeprefix("file://"), {}

    def fetch(page: int, size: int, token: str) -> str:
        used[token] = used.get(token, 0) + 1
        if used[token] > 3:
            raise remote.Unauthorized(token)
        files = glob(f"{folder}/page={page}/part-*")
        return Path(files[0]).read_text("utf-8") if files else '{"items":[]}'

    rows = remote.paged(spark, f"pages_{path[-8:]}", remote.CLIENTS, fetch, lambda: uuid4().hex, limit, tasks=4)
    return rows.select(F.col("id").cast("long").alias("id"), "full_name", "phone")


def _cash_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's messages: those with a payment as payments, others as pictures of cash and names."""
    l = from_events(spark, sf_dir)
    paid = l.transactions.select(F.col("raw_message_id").alias("id"), F.col("amount").alias("a"))
    kind = F.when(F.col("a").isNotNull(), "payment").when(F.col("id") % 2 == 0, "photo").otherwise("name")
    text = F.when(F.col("id") % 3 == 0, "Ким").when(kind == "name", "Имя")
    rows = l.messages.join(paid, "id", "left").select("id", F.col("wa_group_jid").alias("grp"), F.col("sender_jid").alias("sender"), F.col("received_at").alias("ts"), kind.alias("kind"), text.alias("text"), F.coalesce("a", F.col("id") % 7).alias("amount"), (F.col("id") % 4 == 0).alias("paired"))
    return attribution.cash_photos(rows, PHOTOS.cash)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "st01_attributed": lambda s, d: attribution.attributed(chat_events(_events(s, d)), LIMITS),
    "st01_attributed_stream": _attributed_stream,
    "st05_cash_photos": _cash_photos,
    "st06_totals_after_revokes": _totals_after_revokes,
    "st11_flushed": lambda s, d: updates.flushed(uploads(_events(s, d)), 30),
    "st11_flushed_stream": _stream(uploads, "chat", lambda x: stateful.flushed(x, 30)),
    "st12_due_watches_stream": _stream(watched, "id", lambda x: stateful.due_watches(x, DAY, by_clock=False).filter("id >= 0")),
    "st13_spaced_stream": _stream(lambda e: e.select(F.concat(F.lit("g"), _k() % 4).alias("chat"), F.col("event_id").alias("id"), "ts"), "chat", lambda x: stateful.spaced(x, 5 * HOUR).filter("id >= 0")),
    "st14_replies": lambda s, d: updates.replies_about(asks(_events(s, d)), 20),
    "st14_replies_stream": _stream(asks, "kind", lambda x: stateful.replies_about(x, 20)),
    "sc08_paged_clients": _paged_clients,
    "sk01_arrivals_stream": _arrived_messages,
    "sk04_upserted_stream": _upserted_senders,
}

def _attributed(events: str, limits: attribution.Limits) -> str:
    """The effects, by recursion over each sender's events. ``events``: tables, the last of which is said (id, grp, sender, s, kind, name, amount, paired, message, quoted)."""
    return f"""with recursive {events},
hit as (
  select e.id, max(struct_pack(s := r.s, id := r.id, sender := r.sender)) as r
  from said e join said r on r.grp = e.grp and r.message = e.quoted
  where e.quoted <> '' and e.name <> '' and e.kind in ('name', 'payment') and r.kind = 'receipt' and not r.paired and (r.s < e.s or (r.s = e.s and r.id < e.id)) and e.s - r.s <= {limits.quotes} group by e.id),
y as (
  select e.id, grp, coalesce(r.sender, sender) as sender, e.s, case when r is not null then 'bound' when quoted <> '' and name <> '' and kind in ('name', 'payment') then 'queue' else kind end as kind, name, amount, paired, r.id as target
  from said e left join hit using (id)),
x as (select *, row_number() over (partition by grp, sender order by s, id) as n from y),
w as (
  select distinct grp, sender, cast(0 as bigint) as n, cast(null as bigint) as id, cast(null as varchar) as act, cast(null as bigint) as about, cast(null as varchar) as said, cast(null as double) as money,
         cast([] as struct(s bigint, name varchar, amount double)[]) as names, cast([] as struct(s bigint, id bigint)[]) as recs, cast([] as struct(s bigint, id bigint)[]) as pays, cast(null as bigint) as pic
  from x
  union all
  select grp, sender, n, id, act,
         case act when 'named by it' then id when 'waits' then id when 'recorded' then id when 'from queue' then id when 'cash' then id when 'queued' then id when 'marked' then pays[-1].id when 'names' then recs[1].id when 'bound' then target end,
         case act when 'named by it' then payer when 'recorded' then coalesce(payer, name) when 'from queue' then pick.name when 'names' then name when 'bound' then name when 'queued' then name end,
         case act when 'recorded' then amt when 'from queue' then pick.amount when 'queued' then amount end,
         case act when 'queued' then list_append(names, {{'s': s, 'name': name, 'amount': amount}})[-{limits.most}:] when 'from queue' then list_filter(names, lambda a, i: i <> pick.i) else names end,
         case act when 'names' then recs[2:] when 'bound' then list_filter(recs, lambda a: a.id <> target) when 'a receipt' then (case when paired then recs else list_append(recs, {{'s': s, 'id': id}}) end) else recs end,
         case act when 'marked' then pays[:-2] when 'a payment' then (case when paired then pays else list_append(pays, {{'s': s, 'id': id}}) end) else pays end,
         case when act = 'waits' then s when kind = 'payment' and act <> 'names' then null when kind = 'name' and act <> 'names' and amount > 0 then null else pic end
  from (
    select *, case when kind = 'receipt' then (case when payer is not null then 'named by it' else 'a receipt' end)
                   when kind = 'photo' then (case when len(pays) > 0 then 'marked' when payer is not null and amt > 0 then 'recorded' when pick is not null then 'from queue' else 'waits' end)
                   when kind = 'bound' then 'bound' when kind = 'queue' then 'queued'
                   when len(recs) > 0 and name <> '' then 'names'
                   when kind = 'name' then (case when amount > 0 and s - pic <= {limits.cash} then 'recorded' else 'queued' end)
                   when s - pic <= {limits.cash} then 'cash' else 'a payment' end as act
    from (
      select grp, sender, n, id, s, kind, name, paired, target, amount, recs, pays, pic, case when kind in ('receipt', 'photo') then (case when name <> '' then name when len(nm) > 0 then nm[1].name end) end as payer,
             case when amount <> 0 or kind <> 'photo' then amount when name = '' and len(nm) > 0 then nm[1].amount else 0 end as amt,
             case when kind in ('receipt', 'photo') and name = '' then nm[2:] else nm end as names,
             list_filter(list_transform(case when name = '' then nm[2:] else nm end, lambda a, i: {{'i': i, 's': a.s, 'name': a.name, 'amount': a.amount}}), lambda a: a.amount > 0 and x.s - a.s <= {limits.cash})[1] as pick
      from (
        select x.*, w.pic, list_filter(w.recs, lambda a: x.s - a.s < {limits.names}) as recs, list_filter(w.pays, lambda a: x.s - a.s <= {limits.cash}) as pays,
               case when x.kind in ('receipt', 'photo') and x.name = '' then list_filter(w.names, lambda a: x.s - a.s <= {limits.names}) else w.names end as nm
        from w join x on x.grp = w.grp and x.sender = w.sender and x.n = w.n + 1) x) z) q)
select id, case act when 'named by it' then 'named' when 'names' then 'named' when 'bound' then 'named' when 'from queue' then 'recorded' else act end as what, about, said as name, money as amount
from w where act is not null and act not in ('a receipt', 'a payment')"""


_CHATS = """ev as (select *, cast(json_extract(props, '$.k') as int) as k from events),
said as (
  select event_id as id, 'g' || (k % 4) as grp, 's' || (user_id % 10) as sender, cast(floor(epoch(ts)) as bigint) as s,
         case when event_type in ('click', 'error') then 'name' when event_type = 'signup' then 'payment' when event_type = 'view' and k % 3 = 0 then 'photo' else 'receipt' end as kind,
         case when event_type in ('click', 'error') then 'Name ' || user_id when event_type = 'signup' and k % 5 = 0 then 'Line ' || user_id when event_type in ('view', 'purchase') and k % 9 = 0 then 'Written ' || k else '' end as name,
         case when event_type in ('error', 'signup') or (event_type = 'view' and k % 12 = 0) then floor(value) else 0 end as amount, event_id % 6 = 0 as paired, 'm' || event_id as message,
         case when event_type in ('click', 'error', 'signup') and event_id % 2 = 0 then 'm' || (event_id - 1 - k % 3) else '' end as quoted
  from ev)"""

_PHOTOS = f"""{LEDGER.strip()},
said as (
  select m.id, wa_group_jid as grp, sender_jid as sender, cast(floor(epoch(received_at)) as bigint) as s, case when tr.id is not null then 'payment' when m.id % 2 = 0 then 'photo' else 'name' end as kind,
         case when m.id % 3 = 0 then 'Ким' when tr.id is null and m.id % 2 = 1 then 'Имя' else '' end as name, cast(coalesce(tr.amount, m.id % 7) as double) as amount, m.id % 4 = 0 as paired, '' as message, '' as quoted
  from messages m left join tr using (id))"""

_E = "e as (select *, cast(json_extract(props, '$.k') as int) as k from events)"

_FLUSHED = f"""with {_E},
u as (select 'c' || (k % 4) as chat, event_id as id, ts, event_id % 40 = 0 as flush, 'g' || (k % 3) as target from e),
f as (select *, sum(flush::int) over (partition by chat order by ts, id rows between unbounded preceding and 1 preceding) as n from u),
l as (select chat, coalesce(n, 0) as n, id as flush, target from f where flush),
r as (select chat, coalesce(n, 0) as n, id, row_number() over (partition by chat, coalesce(n, 0) order by ts desc, id desc) as back, row_number() over (partition by chat, coalesce(n, 0) order by ts, id) as place from f where not flush)
select l.flush, target, row_number() over (partition by l.flush order by place) as nth, r.id from r join l using (chat, n) where back <= 30"""

_REPLIES = f"""with recursive {_E},
x as (
  select 'k' || (k % 4) as kind, event_id as id, event_id % 3 = 0 as reply, 'q' || (event_id // 5 - case when event_id % 3 = 0 then k else 0 end) as ask_id, row_number() over (partition by k % 4 order by ts, event_id) as n from e),
w as (
  select distinct kind, cast(0 as bigint) as n, cast(null as bigint) as id, false as reply, cast(null as bigint) as about, cast([] as struct(q varchar, a bigint)[]) as known from x
  union all
  select kind, n, id, reply, case when reply then hit end,
         case when reply then known when hit is not null then list_transform(known, lambda v: case when v.q = z.ask_id then {{'q': v.q, 'a': z.id}} else v end) else list_append(known, {{'q': ask_id, 'a': id}})[-20:] end
  from (select x.*, w.known, list_filter(w.known, lambda v: v.q = x.ask_id)[1].a as hit from (select kind, n, known from w) w join x on x.kind = w.kind and x.n = w.n + 1) z)
select id, about from w where reply"""

_REVOKED = f"""with {_E},
gone as (select distinct 'm' || cast(floor((event_id - 9 + k) / 2) as bigint) as message from e where k % 7 = 0)
select date_trunc('day', ts) as day, event_type as kind, count(*) as cnt, cast(sum(floor(value)) as double) as total
from e where 'm' || (event_id // 2) not in (select message from gone) group by 1, 2"""

_DUE = f"""with {_E}
select event_id as id, cast(date_trunc('second', ts) as timestamp) + interval 24 hour as due from e where event_id % 3 <> 0 or k >= 24"""

_SPACED = f"""with recursive {_E},
x as (select event_id as id, k % 4 as c, cast(floor(epoch(ts)) as bigint) as s, row_number() over (partition by k % 4 order by floor(epoch(ts)), event_id) as n from e),
w as (
  select c, cast(0 as bigint) as n, cast(null as bigint) as id, cast(-1000000000000 as bigint) as last, false as free from x group by 1
  union all
  select x.c, x.n, x.id, case when x.s - w.last >= 18000 then x.s else w.last end, x.s - w.last >= 18000 from w join x on x.c = w.c and x.n = w.n + 1)
select id from w where free"""

ORACLES: dict[str, str] = {
    "st06_totals_after_revokes": _REVOKED,
    "st11_flushed": _FLUSHED,
    "st11_flushed_stream": _FLUSHED,
    "st12_due_watches_stream": _DUE,
    "st13_spaced_stream": _SPACED,
    "st14_replies": _REPLIES,
    "st14_replies_stream": _REPLIES,
    "sc08_paged_clients": f"with {LEDGER} select id, full_name, cast(null as varchar) as phone from clients",
    "sk01_arrivals_stream": "select 'm' || ((event_id // 3) % 500) as wa_message_id, count(*) as n, count(*) - 1 as existed from events group by 1",
    "sk04_upserted_stream": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, min(event_id) as first_id from events group by 1",
    "st01_attributed": _attributed(_CHATS, LIMITS),
    "st01_attributed_stream": _attributed(_CHATS, LIMITS),
    "st05_cash_photos": f"select id, case what when 'marked' then 'mark:' || about when 'recorded' then 'record:' || name || ':' || cast(amount as bigint) when 'waits' then 'wait' else 'cash' end as result from ({_attributed(_PHOTOS, PHOTOS)}) where what in ('marked', 'recorded', 'waits', 'cash')",
}
