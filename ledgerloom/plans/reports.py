"""The reports, each a function from a ledger and its parameters to a DataFrame."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from datetime import datetime, timedelta
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import updates
from ledgerloom.operators.folds import folded
from ledgerloom.operators.rules import LIVE, countable, distinct_on, filled, full_receipts, full_transactions, in_groups, name_key, same_receipt, within
from ledgerloom.sources.ledger import Ledger

NO_CARD = "не указано"
NO_BANK = "банк не указан"
NO_OWNER = "не распознано"
RECEIPT, CASH, TRANSFER = "чек", "наличка", "перевод"

BUCKETS = ("needs_review", "held_cash", "text_duplicate")

#: Which copy of a receipt stands for all where nothing else decides.
COPY = ["created_at", "id"]


def money(column: str | Column) -> Column:
    """Decimal sums as doubles, at the edge only."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("double")


def _cards(texts: DataFrame, receipts: DataFrame) -> DataFrame:
    """What each client (key) gave to each card: amount, n and first, which holds the spelling that stands for the client."""
    rows = texts.select("canonical_name", F.col("card_to").alias("card"), "amount", F.lit(0).alias("branch"), "id").unionByName(
        receipts.select("canonical_name", F.coalesce("bank", F.lit(NO_BANK)).alias("card"), "amount", F.lit(1).alias("branch"), "id")
    )
    rows = rows.withColumn("key", name_key("canonical_name")).withColumn("card", filled("card", default=NO_CARD))
    return rows.groupBy("key", "card").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.min(F.struct("branch", "id", "canonical_name")).alias("first"))


def _summary(cards: DataFrame) -> DataFrame:
    # By client and card first, then by client: this second step sees a few rows a client.
    people = cards.groupBy("key").agg(
        F.min("first")["canonical_name"].alias("name"),
        money("amount").alias("total"),
        F.sum("n").alias("cnt"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "card", F.col("amount").cast("string")))), ";").alias("by_card"),
    )
    return people.select("name", "total", "cnt", "by_card")


def _counted(l: Ledger, start, end, groups: list[str] | None) -> DataFrame:
    """The cards of all that counts, by the operations' dates."""
    texts = full_transactions(l).filter(within("tx_date", start, end)).filter("not ignored and not deleted and canonical_name is not null").filter(in_groups("wa_group_jid", groups))
    receipts = full_receipts(l).filter(within("tx_date", start, end)).filter(f"{LIVE} and not needs_review and canonical_name is not null").filter(in_groups("group_jid", groups))
    return _cards(countable(texts, l, start, end), distinct_on(receipts, [same_receipt(False)], COPY))


def _counted_by_chat(l: Ledger, start, end, month_start, month_end, groups: list[str] | None) -> DataFrame:
    texts = full_transactions(l).filter(within("received_at", start, end)).filter("not ignored and not deleted and canonical_name is not null").filter(in_groups("wa_group_jid", groups))
    receipts = full_receipts(l).filter(within("received_at", start, end) & within("tx_date", month_start, month_end))
    receipts = receipts.filter(f"{LIVE} and not needs_review and canonical_name is not null").filter(in_groups("group_jid", groups))
    return _cards(countable(texts, l, start, end, by_chat=True), distinct_on(receipts, [same_receipt(False)], COPY))


def summary_for_period(l: Ledger, start, end, groups: list[str] | None = None) -> DataFrame:
    """Per client: total, count and totals by card, by the operations' dates."""
    return _summary(_counted(l, start, end, groups))


def summary_by_chat(l: Ledger, start, end, month_start, month_end, groups: list[str] | None = None) -> DataFrame:
    """The same by the dates of posting; receipts' operations must be in the month."""
    return _summary(_counted_by_chat(l, start, end, month_start, month_end, groups))


def report_tables(l: Ledger, start, end, groups: list[str] | None = None) -> DataFrame:
    """The printed report's two tables: cards by name and clients by total, each with its last row, the sum of all. ``nth`` is a row's place."""
    cards = _counted(l, start, end, groups)
    by_card = cards.groupBy(F.col("card").alias("label")).agg(F.sum("amount").alias("total"))
    by_person = cards.groupBy("key").agg(F.min("first")["canonical_name"].alias("label"), F.sum("n").alias("cnt"), F.sum("amount").alias("total"))
    card_rows = by_card.select(F.lit(1).alias("section"), "label", F.lit(None).cast("long").alias("cnt"), "total", F.lit(0).alias("last"))
    person_rows = by_person.select(F.lit(2).alias("section"), "label", "cnt", "total", F.lit(0).alias("last"))
    grand = by_card.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    sums = grand.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("section"), F.lit("ИТОГО").alias("label"), F.lit(None).cast("long").alias("cnt"), "total", F.lit(1).alias("last"))
    rows = card_rows.unionByName(person_rows).unionByName(sums)
    order = Window.partitionBy("section").orderBy("last", F.when(F.col("section") == 2, -F.col("total")), "label")
    return rows.select("section", F.row_number().over(order).alias("nth"), "label", "cnt", F.col("total").cast("double").alias("total"))


def old_operations(l: Ledger, start, end, month_start, month_end, groups: list[str] | None = None, limit: int = 15) -> DataFrame:
    """Receipts posted in the period whose operation lies outside the months."""
    rows = full_receipts(l).filter(within("received_at", start, end)).filter((F.col("tx_date") < F.lit(month_start)) | (F.col("tx_date") >= F.lit(month_end)))
    rows = rows.filter(f"{LIVE} and not needs_review and amount > 0").filter(in_groups("group_jid", groups)).withColumn("key", same_receipt(True))
    rows = distinct_on(rows, ["key"], ["tx_date", *COPY]).orderBy("key").limit(limit) if limit else distinct_on(rows, ["key"], ["tx_date", *COPY])
    return rows.select(F.coalesce("canonical_name", "recipient_raw", F.lit("")).alias("name"), F.col("amount").cast("double").alias("amount"), "tx_date", filled("submitted_by", "sender_name").alias("submitted_by"))


def _senders(receipts: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    receipts = distinct_on(receipts.filter(f"{LIVE} and amount > 0"), [same_receipt(True)], COPY)
    rows = receipts.select(filled("owner", "submitted_by", "sender_name").alias("sender"), "phone", "amount").unionByName(
        texts.select(filled("collector", "owner", "sender_name").alias("sender"), "phone", "amount")
    )
    if query:
        rows = rows.filter(F.col("sender").ilike(f"%{query}%") | F.col("phone").like(f"%{query}%"))
    return rows.groupBy("sender", "phone").agg(F.count("*").alias("cnt"), money("amount").alias("total"))


def sender_stats(l: Ledger, start, end, groups: list[str] | None = None, query: str = "") -> DataFrame:
    """Who collected how much, by the operations' dates."""
    receipts = full_receipts(l).filter(within("tx_date", start, end)).filter(in_groups("group_jid", groups))
    texts = full_transactions(l).filter(within("tx_date", start, end)).filter("not ignored and not deleted and amount > 0").filter(in_groups("wa_group_jid", groups))
    return _senders(receipts, countable(texts, l, start, end), query)


def sender_stats_by_chat(l: Ledger, start, end, month_start, month_end, groups: list[str] | None = None, query: str = "") -> DataFrame:
    """Who collected how much, by the dates of posting."""
    receipts = full_receipts(l).filter(within("received_at", start, end) & within("tx_date", month_start, month_end)).filter(in_groups("group_jid", groups))
    texts = full_transactions(l).filter(within("received_at", start, end)).filter("not ignored and not deleted and amount > 0").filter(in_groups("wa_group_jid", groups))
    return _senders(receipts, countable(texts, l, start, end, by_chat=True), query)


def card_totals(l: Ledger, start, end, groups: list[str] | None = None) -> DataFrame:
    """What each card got."""
    rows = full_receipts(l).filter(within("tx_date", start, end)).filter(f"{LIVE} and amount > 0").filter(in_groups("group_jid", groups))
    rows = distinct_on(rows, [same_receipt(True)], COPY)
    rows = rows.select(filled("card_owner", "recipient_raw", default=NO_OWNER).alias("card"), filled("recipient_bank", "bank").alias("bank"), "amount", F.struct(*COPY).alias("at"))
    return rows.groupBy(name_key("card").alias("key")).agg(
        F.min_by("card", "at").alias("card_owner"),
        F.coalesce(F.min_by("bank", F.when(F.col("bank") != "", F.col("at"))), F.lit("")).alias("bank"),
        F.count("*").alias("cnt"),
        money("amount").alias("total"),
    ).drop("key")


def person_report(l: Ledger, query: str, start=None, end=None, group: str = "", limit: int = 5) -> DataFrame:
    """Receipts and text payments of the clients whose name holds ``query``; neither weighs the other."""
    sums = lambda p: [F.count("*").alias(f"{p}_cnt"), F.sum("amount").alias(f"{p}_total"), F.min("tx_date").cast("timestamp").alias(f"{p}_first"), F.max("tx_date").cast("timestamp").alias(f"{p}_last")]
    people = l.contacts.filter(F.col("canonical_name").ilike(f"%{query}%"))
    receipts = full_receipts(l).filter(LIVE).filter(within("tx_date", start, end))
    texts = full_transactions(l).filter("not ignored and not deleted").filter(within("tx_date", start, end))
    if group:
        receipts, texts = receipts.filter(F.col("group_jid") == group), texts.filter(F.col("wa_group_jid") == group)
    r = receipts.groupBy(F.col("contact_id").alias("id")).agg(*sums("r"))
    t = texts.groupBy(F.col("contact_id").alias("id")).agg(*sums("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = people.join(r, "id", "left").join(t, "id", "left").filter((zero("r_cnt") > 0) | (zero("t_cnt") > 0))
    rows = rows.orderBy((zero("r_total") + zero("t_total")).desc(), "id").limit(limit)
    return rows.select(
        F.col("canonical_name").alias("name"),
        zero("r_cnt").alias("receipt_cnt"),
        zero("r_total").cast("double").alias("receipt_total"),
        zero("t_cnt").alias("payment_cnt"),
        zero("t_total").cast("double").alias("payment_total"),
        F.least("r_first", "t_first").alias("first_op"),
        F.greatest("r_last", "t_last").alias("last_op"),
    )


def receipts_ledger(l: Ledger, start, end, person: str = "", groups: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Every payment of the period, latest first. ``truncated`` says that there are more than ``limit``."""
    receipts = full_receipts(l).filter(within("tx_date", start, end)).filter(f"{LIVE} and amount > 0").filter(in_groups("group_jid", groups))
    receipts = receipts.select(
        F.lit(RECEIPT).alias("kind"), "id", F.coalesce("canonical_name", "recipient_raw", F.lit("")).alias("client"), "amount", "tx_date",
        filled("submitted_by", "sender_name", "phone").alias("submitted_by"), F.lit("").alias("collector"),
        F.coalesce("group_jid", "wa_group_jid", F.lit("")).alias("grp"), F.coalesce("bank", F.lit("")).alias("bank"), F.coalesce("card_owner", F.lit("")).alias("card_owner"),
    )
    texts = full_transactions(l).filter(within("tx_date", start, end)).filter("not ignored and not deleted and amount > 0").filter(in_groups("wa_group_jid", groups))
    texts = countable(texts, l, start, end).select(
        F.when(F.col("is_cash"), CASH).otherwise(TRANSFER).alias("kind"), "id", F.coalesce("canonical_name", "raw_name", F.lit("")).alias("client"), "amount", F.col("tx_date").cast("timestamp").alias("tx_date"),
        filled("sender_name", "phone").alias("submitted_by"), F.coalesce("collector", F.lit("")).alias("collector"),
        F.coalesce("wa_group_jid", F.lit("")).alias("grp"), F.coalesce("card_to", F.lit("")).alias("bank"), F.lit("").alias("card_owner"),
    )
    rows = receipts.unionByName(texts)
    if person:
        rows = rows.filter(F.col("client").ilike(f"%{person}%"))
    # One row more than asked for tells whether there are more; only these few are numbered.
    few = rows.orderBy(F.col("tx_date").desc(), "kind", "id").limit(limit + 1)
    few = few.withColumn("nth", F.row_number().over(Window.orderBy(F.col("tx_date").desc(), "kind", "id"))).withColumn("truncated", F.max("nth").over(Window.partitionBy()) > limit)
    return few.filter(F.col("nth") <= limit).drop("nth").withColumn("amount", F.col("amount").cast("double"))


def missing_in_group(l: Ledger, target: str, start, end, sources: list[str] | None = None, person: str = "", limit: int = 200, days: int = 3) -> DataFrame:
    """Payments that are in other groups and not in ``target``.

    A receipt with a document number is looked for by it alone, one without by client, amount and time; the
    two cases are joined one after the other, each on its own keys.
    """
    where = F.coalesce("group_jid", "wa_group_jid", F.lit(""))
    known = full_receipts(l).filter(f"{LIVE} and not needs_review")
    there = known.filter(where == target)
    rows = known.filter(within("tx_date", start, end)).filter((F.col("amount") > 0) & (where != target) & in_groups(where, sources))
    rows = rows.withColumn("doc", F.nullif("doc_number", F.lit("")))
    docs = there.select(F.col("doc_number").alias("_doc")).filter("_doc <> ''").distinct()
    rows = rows.join(docs, F.col("doc") == F.col("_doc"), "left_anti")
    near = there.select(F.col("contact_id").alias("_c"), F.col("amount").alias("_a"), F.col("tx_date").alias("_t"))
    span = F.make_dt_interval(days=F.lit(days))
    rows = rows.join(near, F.col("doc").isNull() & (F.col("contact_id") == F.col("_c")) & (F.col("amount") == F.col("_a")) & F.col("_t").between(F.col("tx_date") - span, F.col("tx_date") + span), "left_anti")
    receipts = rows.select(F.lit(RECEIPT).alias("kind"), "id", F.coalesce("canonical_name", "recipient_raw", F.lit("")).alias("client"), "amount", "tx_date", where.alias("grp"), filled("submitted_by", "sender_name", "phone").alias("who"), F.coalesce("doc_number", F.lit("")).alias("doc"))
    group = F.coalesce("wa_group_jid", F.lit(""))
    cash = full_transactions(l).filter("is_cash and not ignored and not deleted")
    there = cash.filter(group == target).select(F.col("contact_id").alias("_c"), F.col("amount").alias("_a"), F.col("tx_date").alias("_t"))
    rows = cash.filter(within("tx_date", start, end)).filter((F.col("amount") > 0) & ~F.col("dup_pending") & F.col("contact_id").isNotNull() & (group != target) & in_groups(group, sources))
    rows = rows.join(there, (F.col("contact_id") == F.col("_c")) & (F.col("amount") == F.col("_a")) & F.col("_t").between(F.date_sub("tx_date", days), F.date_add("tx_date", days)), "left_anti")
    cash = rows.select(F.lit(CASH).alias("kind"), "id", F.coalesce("canonical_name", "raw_name", F.lit("")).alias("client"), "amount", F.col("tx_date").cast("timestamp").alias("tx_date"), group.alias("grp"), filled("collector", "sender_name", "phone").alias("who"), F.lit("").alias("doc"))
    both = receipts.unionByName(cash)
    if person:
        both = both.filter(F.col("client").ilike(f"%{person}%"))
    return both.withColumn("amount", F.col("amount").cast("double")).orderBy(F.col("tx_date").desc(), "kind", "id").limit(limit)


def exclusions(l: Ledger, start, end, groups: list[str] | None = None) -> DataFrame:
    """What a total leaves out: receipts under review, held repeats of cash, and texts that a receipt stands for."""
    rows = _left_out(l, start, end, groups).groupBy("bucket").agg(F.sum("n").alias("cnt"), money("amount").alias("total"))
    return rows.select("bucket", F.col("cnt").cast("long").alias("cnt"), "total")


def _left_out(l: Ledger, start, end, groups: list[str] | None) -> DataFrame:
    """bucket, n and amount: what is left out, row by row, and an empty row for each bucket."""
    every = full_receipts(l)
    rows = every.filter(within("tx_date", start, end)).filter(f"(needs_review or contact_id is null) and {LIVE} and amount > 0").filter(in_groups("group_jid", groups))
    texts = full_transactions(l).filter(within("tx_date", start, end)).filter("not ignored and not deleted")
    counted = texts.filter("not dup_pending").select(F.col("contact_id").alias("_c"), F.col("amount").alias("_a"), F.coalesce("wa_group_jid", F.lit("")).alias("_g"))
    rows = rows.join(counted, (F.col("contact_id") == F.col("_c")) & (F.col("amount") == F.col("_a")) & (F.coalesce("group_jid", F.lit("")) == F.col("_g")), "left_anti")
    copies = every.filter(within("tx_date", start, end)).filter(f"not needs_review and {LIVE}").filter(in_groups("group_jid", groups))
    docs = copies.filter("doc_number <> ''").select(F.col("doc_number").alias("_doc")).distinct()
    rows = rows.join(docs, F.col("doc_number") == F.col("_doc"), "left_anti")
    # A forwarded message's id begins with its original's.
    origin = copies.select(F.col("wa_message_id").alias("_origin")).filter("_origin <> ''").distinct()
    rows = rows.join(origin, F.col("wa_message_id").contains("-fwd-") & (F.split_part("wa_message_id", F.lit("-fwd-"), F.lit(1)) == F.col("_origin")), "left_anti")
    of = lambda bucket, x: x.select(F.lit(bucket).alias("bucket"), F.lit(1).alias("n"), "amount")
    review = of("needs_review", distinct_on(rows, [same_receipt(True)], COPY))
    texts = texts.filter("amount > 0").filter(in_groups("wa_group_jid", groups))
    held = of("held_cash", texts.filter("is_cash and dup_pending"))
    paired = l.receipts.filter("not needs_review and not is_duplicate and not ignored").filter(within("tx_date", start, end))
    paired = paired.select(F.col("contact_id").alias("_c"), F.col("amount").alias("_a"), F.coalesce("group_jid", F.lit("")).alias("_g"))
    match = (F.col("contact_id") == F.col("_c")) & (F.col("amount") == F.col("_a")) & (F.coalesce("wa_group_jid", F.lit("")) == F.col("_g"))
    twice = of("text_duplicate", texts.filter("not is_cash and not dup_pending").join(paired, match, "left_semi"))
    empty = l.receipts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"), F.lit(0).alias("n"), F.lit(0).cast("decimal(12,2)").alias("amount"))
    return review.unionByName(held).unionByName(twice).unionByName(empty)


def _named(l: Ledger) -> DataFrame:
    return full_receipts(l).filter(f"{LIVE} and amount > 0").withColumn("name", F.coalesce("canonical_name", "recipient_raw", F.lit(""))).filter("name <> ''").withColumn("amount", F.col("amount").cast("double"))


def recent_outside_period(l: Ledger, since, start, end, groups: list[str] | None = None, limit: int = 12) -> DataFrame:
    """Receipts recorded since ``since`` whose operation lies outside the period."""
    rows = _named(l).filter(F.col("created_at") >= F.lit(since)).filter((F.col("tx_date") < F.lit(start)) | (F.col("tx_date") >= F.lit(end))).filter(in_groups("group_jid", groups))
    return rows.orderBy(F.col("created_at").desc(), "id").limit(limit).select("name", "amount", "tx_date")


def receipts_for_period(l: Ledger, start, end, group: str = "") -> DataFrame:
    """Live receipts with a name."""
    rows = _named(l).filter(within("tx_date", start, end))
    rows = rows.filter(F.col("group_jid") == group) if group else rows
    return rows.select("id", "name", "amount", "tx_date", F.coalesce("group_jid", F.lit("")).alias("group_jid"))


def receipt_details(l: Ledger, person: str, limit: int = 40) -> DataFrame:
    """All that is known of a client's latest receipts, also of deleted messages."""
    rows = full_receipts(l).filter("not is_duplicate and not ignored").withColumn("name", F.coalesce("canonical_name", "recipient_raw", F.lit(""))).filter(F.col("name").ilike(f"%{person}%"))
    rows = rows.orderBy(F.col("tx_date").desc(), "id").limit(limit)
    return rows.select("id", "name", F.col("amount").cast("double").alias("amount"), "tx_date", "bank", "recipient_raw", "recipient_bank", "card_owner", "doc_number", "auth_code", "needs_review", "client_confirmed", "group_jid", filled("submitted_by", "sender_name", "phone").alias("submitted_by"))


def receipt_files(l: Ledger, person: str, limit: int = 15) -> DataFrame:
    """The stored files of a client's receipts."""
    rows = full_receipts(l).filter(LIVE).filter("media_path <> ''").withColumn("name", F.coalesce("canonical_name", "recipient_raw", F.lit(""))).filter(F.col("name").ilike(f"%{person}%"))
    return rows.orderBy(F.col("tx_date").desc(), "id").limit(limit).select("id", "name", F.col("amount").cast("double").alias("amount"), "tx_date", "media_path")


def find_operations(l: Ledger, amount: float, person: str = "", start=None, end=None, group: str = "", limit: int = 10) -> DataFrame:
    """Operations of exactly that amount, latest first, ignored ones too."""
    t = full_transactions(l).filter(~F.col("deleted")).select(F.lit("transaction").alias("kind"), "id", F.coalesce("canonical_name", "raw_name").alias("name"), "amount", F.col("tx_date").cast("timestamp").alias("tx_date"), F.coalesce("wa_group_jid", F.lit("")).alias("grp"), "ignored")
    r = full_receipts(l).filter("not is_duplicate and not deleted").select(F.lit("receipt").alias("kind"), "id", F.coalesce("canonical_name", "recipient_raw", F.lit("")).alias("name"), "amount", "tx_date", F.coalesce("group_jid", F.lit("")).alias("grp"), "ignored")
    rows = t.unionByName(r).filter(F.col("amount") == F.lit(amount)).filter(within("tx_date", start, end))
    rows = rows.filter(F.col("name").ilike(f"%{person}%")) if person else rows
    rows = rows.filter(F.col("grp") == group) if group else rows
    return rows.orderBy(F.col("tx_date").desc(), "kind", "id").limit(limit).withColumn("amount", F.col("amount").cast("double"))


def every_unclear_item(l: Ledger) -> DataFrame:
    """Receipts under review, and pictures that became nothing."""
    r = full_receipts(l).filter(f"needs_review and {LIVE}").select(F.lit("receipt").alias("kind"), "id", F.coalesce("group_jid", F.lit("")).alias("grp"), F.coalesce("recipient_raw", F.lit("")).alias("name"), F.coalesce("amount", F.lit(0)).cast("double").alias("amount"), F.col("tx_date").alias("happened_at"), F.coalesce("media_path", F.lit("")).alias("media_path"), filled("sender_name", "phone").alias("who"))
    m = l.messages.filter("has_media and not deleted and media_path <> ''")
    used = l.receipts.select(F.col("raw_message_id").alias("id")), l.transactions.select(F.col("raw_message_id").alias("id"))
    m = m.join(used[0], "id", "left_anti").join(used[1], "id", "left_anti")
    m = m.select(F.lit("message").alias("kind"), "id", F.col("wa_group_jid").alias("grp"), F.lit("").alias("name"), F.lit(0.0).alias("amount"), F.col("received_at").alias("happened_at"), "media_path", filled("sender_name", F.split_part("sender_jid", F.lit("@"), F.lit(1))).alias("who"))
    return r.unionByName(m)


def unclear_items(l: Ledger, group: str = "", limit: int = 50) -> DataFrame:
    """The latest of them, of one group if it is named."""
    rows = every_unclear_item(l)
    rows = rows.filter(F.col("grp") == group) if group else rows
    return rows.orderBy(F.col("happened_at").desc(), "kind", "id").limit(limit)


def group_medians(l: Ledger, since) -> DataFrame:
    """Count and median of each group's live amounts; equal amounts are counted before they meet."""
    rows = full_receipts(l).filter(f"{LIVE} and amount > 0").filter(F.col("created_at") >= F.lit(since))
    rows = rows.groupBy("group_jid", "amount").agg(F.count("*").alias("n"))
    return rows.groupBy("group_jid").agg(F.sum("n").alias("n"), F.expr("percentile(amount, 0.5, n)").alias("median"))


def trailing_counts(days: DataFrame, asked: DataFrame) -> DataFrame:
    """g, since, until, amount and n: how often each amount occurs in a group on the whole days from ``since`` to before ``until``.

    ``days``: g, day, amount, n (a histogram a day); ``asked``: g, since, until, once each. Histograms are summed up along
    the days once, amount by amount; a stretch of days is the difference of two sums, whatever its length.
    """
    amounts = days.select("g", "amount").distinct()
    ends = asked.select("g", "since", "until", F.inline(F.array(F.struct(F.date_sub("until", 1).alias("day"), F.lit(1).alias("sign")), F.struct(F.date_sub("since", 1).alias("day"), F.lit(-1).alias("sign")))))
    marks = ends.join(amounts, "g").select("g", "amount", "day", F.lit(0).cast("long").alias("n"), "sign", "since", "until")
    rows = days.select("g", "amount", "day", "n", F.lit(0).alias("sign"), F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until")).unionByName(marks)
    upto = F.sum("n").over(Window.partitionBy("g", "amount").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sums = rows.withColumn("upto", upto).filter("sign <> 0")
    return sums.groupBy("g", "since", "until", "amount").agg(F.sum(F.col("sign") * F.col("upto")).alias("n")).filter("n > 0")


class Histogram:
    """How often each amount occurs, to which amounts are added; the median is found by few steps from where it last was."""

    def __init__(self):
        self.amounts: list[float] = []
        self.counts: dict[float, int] = {}
        self.n = self.at = self.below = 0

    def add(self, amount: float, n: int) -> None:
        if amount not in self.counts:
            i = bisect_left(self.amounts, amount)
            self.amounts.insert(i, amount)
            self.counts[amount] = 0
            self.at += self.n > 0 and i <= self.at
        self.counts[amount] += n
        self.n += n
        self.below += n if amount < self.amounts[self.at] else 0

    def median(self) -> float:
        low, high = (self.n - 1) // 2, self.n // 2
        while self.below > low:
            self.at -= 1
            self.below -= self.counts[self.amounts[self.at]]
        while self.below + self.counts[self.amounts[self.at]] <= low:
            self.below += self.counts[self.amounts[self.at]]
            self.at += 1
        here = self.amounts[self.at]
        return here if high < self.below + self.counts[here] else 0.5 * here + 0.5 * self.amounts[self.at + 1]


def suspicious_amounts(l: Ledger, start=None, end=None, least: float = 100_000, times: float = 12, least_n: int = 30, months: int = 3) -> DataFrame:
    """Receipts recorded in the period that lie far above the median of their group's ``months`` before, themselves included.

    Whole days come as histograms, put together once for each group and day on which there is a large receipt; that day's
    receipts enter them one by one, as they were recorded, and the median is looked up in passing.
    """
    live = full_receipts(l).filter(f"{LIVE} and amount > 0").select("id", F.col("group_jid").alias("g"), "amount", "created_at", F.to_date("created_at").alias("day")).filter("g is not null")
    large = live.filter(within("created_at", start, end)).filter(F.col("amount") >= least)
    days = live.groupBy("g", "day", "amount").agg(F.count("*").alias("n"))
    asked = large.select("g", F.add_months("day", -months).alias("since"), F.col("day").alias("until")).distinct()
    of = lambda rows, kind, at, i, n: rows.select("g", "day", F.lit(kind).alias("kind"), at.alias("at"), i.alias("id"), F.col("amount").cast("double").alias("amount"), n.cast("long").alias("n"))
    at, own = F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id").cast("long")
    before = of(trailing_counts(days, asked).withColumnRenamed("until", "day"), 0, F.lit(-(2**63)).cast("long"), F.lit(-1).cast("long"), F.col("n"))
    same = of(live.join(asked.select("g", F.col("until").alias("day")), ["g", "day"], "left_semi"), 1, at, own, F.lit(1))
    rows = before.unionByName(same).unionByName(of(large, 2, at, own, F.lit(0)))

    def fold():
        seen = Histogram()

        def step(r) -> dict | None:
            if r.kind < 2:
                seen.add(r.amount, r.n)
                return None
            median = seen.median()
            return {"n": seen.n, "median": median} if seen.n >= least_n and median > 0 and r.amount > times * median else None

        return step

    out = folded(rows, ["g", "day"], ["at", "kind", "id"], fold, "id long, g string, amount double, result struct<n:long,median:double>", ["id", "g", "amount"])
    return out.filter("result is not null").select("id", F.col("g").alias("group_jid"), "amount", "result.n", "result.median")


#: The questions, in the order in which they are asked.
QUESTIONS = ("unconfirmed", "collector", "cash_repeat", "unrecognized")


def _waiting(l: Ledger, kind: str, now, grace_seconds: int) -> DataFrame:
    """id, grp, sender_jid, card_owner, amount, created_at of what waits to be asked about."""
    ripe = F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(grace_seconds))
    if kind in ("unconfirmed", "unrecognized"):
        rows = full_receipts(l).filter(LIVE).filter(ripe).filter("not clarify_asked").withColumn("grp", F.coalesce("group_jid", "wa_group_jid"))
        rows = rows.filter("not client_confirmed and amount > 0" if kind == "unconfirmed" else "amount <= 0")
    else:
        rows = full_transactions(l).filter("is_cash and not ignored and not deleted and amount > 0").filter(ripe).withColumn("grp", F.col("wa_group_jid")).withColumn("card_owner", F.lit(""))
        rows = rows.filter("dup_pending and not dup_asked" if kind == "cash_repeat" else "coalesce(collector, '') = '' and not dup_pending and not collector_asked")
    return rows.select("id", "grp", "sender_jid", "card_owner", F.col("amount").cast("double").alias("amount"), "created_at")


def _queues(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """grp and waiting: the groups that are asked, and how much waits in each."""
    waiting = rows.filter("grp is not null").groupBy("grp").agg(F.count("*").alias("waiting"))
    return waiting if kind == "cash_repeat" else waiting.filter(F.col("waiting") <= most)


def clarification_queue(l: Ledger, kind: str, now, grace_seconds: int = 90, most: int = 6, per_group: int = 2) -> DataFrame:
    """What to ask next in each group, by one of ``QUESTIONS``.

    A group whose queue is longer than ``most`` isn't asked at all, but for repeats of cash.
    """
    rows = _waiting(l, kind, now, grace_seconds)
    # Each task keeps a group's first few alone; how many there are is counted apart.
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("created_at", "id"))
    first = rows.select("id", "grp", "amount", nth.alias("nth")).filter(F.col("nth") <= per_group)
    return first.join(_queues(rows, kind, most), "grp").select("id", "grp", "amount", "waiting")


def clarification_cycle(l: Ledger, now, aliases: DataFrame | None = None, grace_seconds: int = 90, most: int = 6, per_cycle: int = 2) -> DataFrame:
    """The ``per_cycle`` questions of one round: by group, then by the order of ``QUESTIONS``, the oldest first.

    Receipts whose client the sender has named beside them aren't asked about.
    """
    queues = []
    for nth, kind in enumerate(QUESTIONS):
        rows = _waiting(l, kind, now, grace_seconds)
        rows = rows.join(_queues(rows, kind, most), "grp")
        if kind == "unconfirmed" and aliases is not None:
            asked = rows.select("id", "grp", F.col("sender_jid").alias("sender"), "card_owner", F.lit(now).cast("timestamp").alias("at"))
            rows = rows.join(updates.silently_resolved(asked, l.messages, aliases).select("id"), "id", "left_anti")
        queues.append(rows.select(F.lit(nth).alias("nth"), F.lit(kind).alias("question"), "id", "grp", "amount", "created_at"))
    every = queues[0].unionByName(queues[1]).unionByName(queues[2]).unionByName(queues[3])
    return every.orderBy("grp", "nth", "created_at", "id").limit(per_cycle).select("grp", "question", "id", "amount")


def watch_list(l: Ledger, statuses: list[str], limit: int = 50) -> DataFrame:
    """The watches of these statuses, the latest first."""
    return l.watches.filter(F.col("status").isin(statuses)).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit).withColumn("amount", F.col("amount").cast("double"))


def due_watches(l: Ledger, now, hours: int = 24, limit: int = 30) -> DataFrame:
    """The watches whose payment should be there by now, the oldest first."""
    due = l.watches.filter("status = 'watch'").filter(F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    return due.orderBy("created_at", "id").limit(limit).withColumn("amount", F.col("amount").cast("double"))


def latest_noname_watches(l: Ledger, since) -> DataFrame:
    """Of each sender in each group, the latest watch since then that has no name."""
    open_ = l.watches.filter("status = 'noname'").filter(F.col("created_at") > F.lit(since))
    return open_.groupBy("group_jid", "sender_jid").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def unparsed_messages(l: Ledger, limit: int = 100) -> DataFrame:
    """Messages of text alone that became nothing yet."""
    rows = l.messages.filter("not parsed and not has_media and not deleted and body <> ''")
    rows = rows.join(l.transactions.select(F.col("raw_message_id").alias("id")), "id", "left_anti")
    return rows.orderBy("received_at", "id").limit(limit).select("id", "wa_group_jid", "body", "received_at")


def unresolved_receipts(l: Ledger) -> DataFrame:
    """Receipts without a client that are neither ignored nor copies."""
    return l.receipts.filter("contact_id is null and not ignored and not is_duplicate").select("id", "recipient_raw", "group_jid")


def recent_sender_texts(l: Ledger, sender_jid: str, group: str, start, end, limit: int = 15) -> DataFrame:
    """What a sender wrote in a group in a stretch of time, latest first."""
    rows = l.messages.filter((F.col("sender_jid") == sender_jid) & (F.col("wa_group_jid") == group)).filter(within("received_at", start, end)).filter("not deleted and body <> ''")
    return rows.orderBy(F.col("received_at").desc(), "id").limit(limit).select("id", "body", "received_at")


def expenses_for_period(l: Ledger, start, end) -> DataFrame:
    """The expenses, and their total in a row without id."""
    rows = l.expenses.filter(within("spent_at", start, end)).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    total = rows.agg(F.lit(None).cast("long").alias("id"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.lit("total").alias("note"), F.lit(None).cast("timestamp").alias("spent_at"))
    return rows.select("id", "amount", "note", "spent_at").unionByName(total).withColumn("amount", F.col("amount").cast("double"))


def amount_part(units: Column) -> Column:
    """One of a hundred parts of all amounts, so that an amount in units and the same in hundredths are in one: hundredths of hundredths, rounded, down to below a hundred."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), units.cast("long"), lambda x, _: F.when(x >= 100, F.floor((x + 50) / 100).cast("long")).otherwise(x))


def reconcile(l: Ledger, start, end, group: str = "", days: int = 5) -> DataFrame:
    """The period's receipts against the payments of the other program: added, missing, or to be looked at (attention).

    A receipt's client is looked up by name; only a find of one client by the whole name is sure. A client's receipts,
    the latest first, each take the first payment left of their amount, in units or hundredths, among those within
    ``days`` of the client's first receipt in that order. The rule is sequential where receipts may want the same payment:
    a client's receipts and payments fall into parts, by ``amount_part``, that are folded each in a task of its own.
    """
    receipts = receipts_for_period(l, start, end, group).withColumn("units", updates.units("amount"))
    found = updates.looked_up(receipts.select("name").distinct(), l.clients)
    rows = receipts.join(found, "name")
    sure = rows.filter("n = 1 and exact").select("id", "client_id", "tx_date", "units")
    first = sure.groupBy("client_id").agg(F.to_date(F.max("tx_date")).alias("_day"))
    day = F.to_date("paid_at")
    paid = l.payments.join(first, "client_id").filter(day.between(F.date_sub("_day", days), F.date_add("_day", days)))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # A receipt below one unit in hundredths may want what no other of its part does: such a client is one part.
    tiny = sure.groupBy("client_id").agg(F.min(F.element_at("units", 1)).alias("_least")).filter("_least < 2").select("client_id", F.lit(True).alias("_tiny"))
    events = paid.select("client_id", F.lit(0).alias("kind"), seconds("paid_at").alias("nth"), F.col("payment_id").alias("id"), F.array("amount").alias("units"))
    events = events.unionByName(sure.select("client_id", F.lit(1).alias("kind"), (-seconds("tx_date")).alias("nth"), "id", "units"))
    events = events.join(tiny, "client_id", "left").withColumn("part", F.when(F.col("_tiny"), 0).otherwise(amount_part(F.element_at("units", 1)))).drop("_tiny")

    def fold():
        left: dict[int, deque] = {}  # (place, payment) by amount; payments come before receipts
        n = count()

        def step(r) -> int | None:
            if r.kind == 0:
                left.setdefault(int(r.units[0]), deque()).append((next(n), r.id))
                return None
            queues = [q for u in r.units if (q := left.get(int(u)))]
            return min(queues, key=lambda q: q[0]).popleft()[1] if queues else None

        return step

    pairs = folded(events, ["client_id", "part"], ["kind", "nth", "id"], fold, "kind int, id long, result long", ["kind", "id"]).filter("kind = 1").select("id", F.col("result").alias("payment_id"))
    status = F.when((F.col("n") == 1) & F.col("exact"), F.when(F.col("payment_id").isNull(), "missing").otherwise("added")).otherwise("attention")
    why = F.when(F.col("n") == 0, "no client").when(F.col("n") > 1, "several clients").when(~F.col("exact"), "alike").otherwise("")
    return rows.join(pairs, "id", "left").select("id", "name", "client_id", "payment_id", status.alias("status"), why.alias("why"))


def has_payment_around(l: Ledger, start, end, days: int = 5) -> DataFrame:
    """The receipts with at least one payment of their amount, in either unit, at most ``days`` days before or behind."""
    receipts = full_receipts(l).filter(within("tx_date", start, end)).filter(f"{LIVE} and amount > 0").select("id", "contact_id", F.to_date("tx_date").alias("day"), F.explode(updates.units("amount")).alias("units"))
    paid = l.payments.select("client_id", F.col("amount").alias("paid"), F.to_date("paid_at").alias("on"))
    found = receipts.join(paid, (F.col("contact_id") == F.col("client_id")) & (F.col("units") == F.col("paid")) & F.col("on").between(F.date_sub("day", days), F.date_add("day", days)), "left_semi")
    return found.select("id").distinct()


def _totals(rows: DataFrame, most: tuple[str, ...]) -> DataFrame:
    """section, label, cnt, total of ``rows`` (section, label, n, amount), with the clients' sum, and the most it could be, in one pass."""
    client, left = F.col("section") == "client", F.col("label").isin(*most)
    own = F.struct("section", "label")
    of = lambda s, label: F.struct(F.lit(s).alias("section"), F.lit(label).alias("label"))
    also = F.array(F.when(F.col("section") != "none", own), F.when(client | (F.col("section") == "none"), of("sum", "total")), F.when(client | (left & (F.col("section") == "left_out")) | (F.col("section") == "none"), of("sum", "maximum")))
    each = rows.select(F.explode(F.filter(also, lambda x: x.isNotNull())).alias("x"), "n", "amount")
    return each.groupBy("x.section", "x.label").agg(F.sum("n").cast("long").alias("cnt"), money("amount").alias("total"))


def _people(cards: DataFrame) -> DataFrame:
    rows = cards.groupBy("key").agg(F.min("first")["canonical_name"].alias("label"), F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    return rows.select(F.lit("client").alias("section"), "label", "n", F.col("amount").cast("decimal(22,2)").alias("amount"))


def _nothing(l: Ledger) -> DataFrame:
    """A row that adds nothing, so that the sums are there without any client."""
    return l.receipts.sparkSession.range(1).select(F.lit("none").alias("section"), F.lit("").alias("label"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(22,2)").alias("amount"))


def _noted(section: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.col("name").alias("label"), F.lit(1).cast("long").alias("n"), F.col("amount").cast("decimal(22,2)").alias("amount"))


def finance_report(l: Ledger, start, end, groups: list[str] | None = None, now=None) -> DataFrame:
    """The summary, what it leaves out and the most it could be, as sections of labelled sums.

    With ``now``: what was recorded in the twelve hours before and lies outside the period, the latest twelve, as section ``outside``.
    """
    left = _left_out(l, start, end, groups).select(F.lit("left_out").alias("section"), F.col("bucket").alias("label"), F.col("n").cast("long").alias("n"), F.col("amount").cast("decimal(22,2)").alias("amount"))
    rows = _people(_counted(l, start, end, groups)).unionByName(left).unionByName(_nothing(l))
    if now is not None:
        rows = rows.unionByName(_noted("outside", recent_outside_period(l, now - timedelta(hours=12), start, end, groups)))
    return _totals(rows, ("needs_review", "held_cash"))


def months_of(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """From the first day of the period's first month to the first day after its last one."""
    last = end - timedelta(days=1)
    return start.replace(day=1), last.replace(year=last.year + last.month // 12, month=last.month % 12 + 1, day=1)


def finance_report_by_chat(l: Ledger, start: datetime, end: datetime, groups: list[str] | None = None) -> DataFrame:
    """The summary by the dates of posting, and the receipts of other months that were posted in the period, as section ``old``, with their sum."""
    months = months_of(start, end)
    old = _noted("old", old_operations(l, start, end, *months, groups, limit=50))
    rows = _people(_counted_by_chat(l, start, end, *months, groups)).unionByName(old).unionByName(old.select(F.lit("sum").alias("section"), F.lit("old").alias("label"), "n", "amount")).unionByName(_nothing(l))
    return _totals(rows, ()).filter("label <> 'maximum' or section <> 'sum'")


def month_context(l: Ledger, now: datetime) -> DataFrame:
    """What an assistant is told of the month: its clients and sum, the groups, the known people, the rules and the settings."""
    start = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    month = finance_report(l, start, months_of(start, start + timedelta(days=1))[1]).filter("section = 'client' or label = 'total'").select("section", "label", "cnt", "total")
    plain = lambda section, rows, label: rows.select(F.lit(section).alias("section"), label.alias("label"), F.lit(None).cast("long").alias("cnt"), F.lit(None).cast("double").alias("total"))
    named = l.settings.join(l.groups, F.col("value") == F.col("group_jid"), "left").select("key", F.coalesce("name", "value").alias("shown"))
    return (
        month.unionByName(plain("group", l.groups, F.col("name")))
        .unionByName(plain("person", l.contacts, F.col("canonical_name")))
        .unionByName(plain("rule", l.rules, F.concat_ws(" > ", "source_name", "target_name")))
        .unionByName(plain("setting", named, F.concat_ws("=", "key", "shown")))
    )


def media_path(l: Ledger, code: str) -> DataFrame:
    """kind, id and media_path of the unclear item with this code (``kind:id``); no row without a file."""
    kind, _, num = code.partition(":")
    m = l.messages.select(F.col("id").alias("_mid"), "media_path")
    rows = m.select(F.col("_mid").alias("id"), "media_path") if kind == "message" else l.receipts.select("id", "raw_message_id").join(m, F.col("raw_message_id") == F.col("_mid")).select("id", "media_path")
    return rows.filter((F.col("id") == int(num)) & (F.col("media_path") != "")).select(F.lit(kind).alias("kind"), "id", "media_path")


def chat_histories(l: Ledger) -> DataFrame:
    """The turns of each chat, in order."""
    return l.history.groupBy("chat_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "from_user", "body"))), lambda x: x["body"]).alias("turns"), F.count("*").alias("n"))


def unclear_with_reason(l: Ledger) -> DataFrame:
    """All unclear items with the reason in words."""
    return every_unclear_item(l).select("kind", "id", fn.unclear_reason("kind", "amount", "name").alias("reason"))
