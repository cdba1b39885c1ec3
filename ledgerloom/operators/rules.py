"""Rules that the reports share: liveness, keys of one and the same receipt, and which text payments count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.ledger import Ledger


def filled(*columns: str | Column, default: str = "") -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(default))


def name_key(name: str | Column) -> Column:
    """Lower case, runs of white space as one blank."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^[\s\u00a0]+|[\s\u00a0]+$", ""), r"[\s\u00a0]+", " "))


def within(column: str, start, end) -> Column:
    """start <= column < end; a bound that is None doesn't bind."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= F.lit(start))
    if end is not None:
        test = test & (F.col(column) < F.lit(end))
    return test


def distinct_on(rows: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", first).filter("_nth = 1").drop("_nth")


def full_receipts(l: Ledger) -> DataFrame:
    """Receipts with their message, contact and the owner of the sender's phone."""
    return _full(l, "receipts", ["wa_message_id", "wa_group_jid", "sender_jid", "sender_name", "media_path", "received_at", "deleted"])


def full_transactions(l: Ledger) -> DataFrame:
    """Text payments with their message, contact and the owner of the sender's phone."""
    return _full(l, "transactions", ["wa_group_jid", "sender_jid", "sender_name", "received_at", "deleted"])


def _full(l: Ledger, table: str, of_message: list[str]) -> DataFrame:
    """The joined table, made once for a ledger, however often a report asks for it."""
    if (known := l.__dict__.get(f"_full_{table}")) is not None:
        return known
    m = l.messages.select(F.col("id").alias("_mid"), *of_message)
    c = l.contacts.select(F.col("id").alias("_cid"), "canonical_name")
    rows = getattr(l, table).join(m, F.col("raw_message_id") == F.col("_mid"), "left").join(c, F.col("contact_id") == F.col("_cid"), "left")
    rows = rows.withColumn("phone", F.split_part(F.coalesce("sender_jid", F.lit("")), F.lit("@"), F.lit(1)))
    rows = rows.join(l.owners, "phone", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    l.__dict__[f"_full_{table}"] = rows
    return rows


#: Not a duplicate, not ignored, its message not deleted.
LIVE = "not is_duplicate and not ignored and not deleted"


def same_receipt(with_recipient: bool) -> Column:
    """One and the same receipt wherever it was posted: client, amount and document, or else its time.

    A null amount makes the whole key null, so that all such rows are one.
    """
    who = F.coalesce(F.col("contact_id").cast("string"), *([F.col("recipient_raw")] if with_recipient else []), F.lit(""))
    return F.concat(who, F.lit("|"), F.col("amount").cast("string"), F.lit("|"), F.coalesce(F.nullif("doc_number", F.lit("")), F.col("tx_date").cast("string")))


def countable(texts: DataFrame, l: Ledger, start, end, by_chat: bool = False) -> DataFrame:
    """Text payments that no recognised receipt of the same client, amount, group and period stands for.

    Cash always counts; held repeats never do. The receipts' own deletion doesn't matter here.
    """
    paired = l.receipts.filter("not needs_review and not is_duplicate and not ignored")
    if by_chat:
        m = l.messages.select(F.col("id").alias("_mid"), "received_at")
        paired = paired.join(m, F.col("raw_message_id") == F.col("_mid")).filter(within("received_at", start, end))
    else:
        paired = paired.filter(within("tx_date", start, end))
    paired = paired.select(F.col("contact_id").alias("_c"), F.col("amount").alias("_a"), F.coalesce("group_jid", F.lit("")).alias("_g"))
    match = (F.col("contact_id") == F.col("_c")) & (F.col("amount") == F.col("_a")) & (F.coalesce("wa_group_jid", F.lit("")) == F.col("_g")) & ~F.col("is_cash")
    return texts.filter("not dup_pending").join(paired, match, "left_anti")


def in_groups(column: str | Column, groups: list[str] | None) -> Column:
    """Whether the group is one of ``groups``; None means all."""
    return F.lit(True) if groups is None else (F.col(column) if isinstance(column, str) else column).isin(groups)
