"""The payment ledger: its tables, and an adapter that derives one from the ``events`` and ``customer`` tables.

Tables are plain DataFrames with soft-state flags; nothing is updated in place. The adapter is deterministic:
``k`` is the number in ``props``, purchases and views are bank receipts, all other events text payments.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """The tables, each made when it is first asked for. A ledger of one's own has these names as attributes.

    messages, receipts and transactions; contacts, groups, owners of phones, expenses, history of chats; the other
    program's clients, contracts and payments; watches on receipts that it should know; rules and settings.
    """

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class EventsLedger(Ledger):
    """The ledger of the driver tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        events = self._read("events").select("event_id", "ts", "user_id", "event_type", k.alias("k"), F.floor("value").cast("decimal(12,2)").alias("amount"))
        hours = F.col("k") % 9 + F.when(F.col("k") % 11 == 0, 960).otherwise(0)
        return events.withColumn("received_at", F.col("ts") + F.make_dt_interval(hours=hours))

    @cached_property
    def messages(self) -> DataFrame:
        return self._events.select(
            F.col("event_id").alias("id"),
            F.when(F.col("k") % 20 == 10, _text("m", F.col("event_id") - 1, "-fwd-g1")).otherwise(_text("m", F.col("event_id"))).alias("wa_message_id"),
            _group().alias("wa_group_jid"),
            _text("7900", F.lpad((F.col("k") % 12).cast("string"), 7, "0"), "@s.example").alias("sender_jid"),
            _text("Sender ", F.col("k") % 12).alias("sender_name"),
            _text("message ", F.col("k")).alias("body"),
            _picture().alias("has_media"),
            F.when(_picture() & (F.col("k") % 2 == 0), _text("media/", F.col("event_id"))).alias("media_path"),
            "received_at",
            (F.col("k") % 23 != 0).alias("parsed"),
            (F.col("k") == 77).alias("deleted"),
        )

    @cached_property
    def receipts(self) -> DataFrame:
        owner = _text("Card Owner ", F.col("k") % 6)
        return self._events.filter(_picture() & (F.col("k") != 44)).select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("raw_message_id"),
            F.when(F.col("k") != 33, F.col("user_id")).alias("contact_id"),
            _text("Recipient ", F.col("k") % 7).alias("recipient_raw"),
            "amount",
            F.col("ts").alias("tx_date"),
            _group().alias("group_jid"),
            F.when(F.col("k") % 3 == 0, "").otherwise(_text("d", F.col("user_id"), "-", F.col("amount").cast("long"))).alias("doc_number"),
            F.when(F.col("k") % 4 == 0, _text("a", F.col("user_id"))).otherwise("").alias("auth_code"),
            _text("Bank", F.col("k") % 5).alias("bank"),
            F.when(F.col("k") % 4 == 0, "").otherwise(_text("RBank", F.col("k") % 3)).alias("recipient_bank"),
            F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 2 == 1, F.lower(owner)).otherwise(owner).alias("card_owner"),
            F.when(F.col("k") % 6 == 0, _text("Submitter ", F.col("k") % 5)).otherwise("").alias("submitted_by"),
            (F.col("k") % 10 == 0).alias("needs_review"),
            (F.col("k") == 55).alias("is_duplicate"),
            (F.col("k") == 13).alias("ignored"),
            (F.col("k") % 10 != 0).alias("client_confirmed"),
            (F.col("k") % 17 == 0).alias("clarify_asked"),
            F.col("received_at").alias("created_at"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self._events.filter(~_picture() & (F.col("k") % 23 != 0)).select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("raw_message_id"),
            F.col("user_id").alias("contact_id"),
            _text("Raw ", F.col("user_id")).alias("raw_name"),
            "amount",
            F.to_date("ts").alias("tx_date"),
            F.when(F.col("event_type") == "signup", "cash").otherwise("").alias("card_to"),
            F.when(F.col("k") % 8 == 0, _text("Collector ", F.col("k") % 3)).otherwise("").alias("collector"),
            (F.col("event_type") == "signup").alias("is_cash"),
            (F.col("k") == 21).alias("dup_pending"),
            (F.col("k") % 19 == 0).alias("collector_asked"),
            (F.col("event_id") % 3 == 0).alias("dup_asked"),
            (F.col("k") == 13).alias("ignored"),
            F.col("received_at").alias("created_at"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self._events.filter(_picture() & (F.col("k") % 4 != 1)).select(
            F.col("event_id").alias("payment_id"),
            F.col("user_id").alias("client_id"),
            (F.col("amount").cast("long") * F.when(F.col("k") % 7 == 0, 100).otherwise(1)).alias("amount"),
            (F.col("ts") + F.make_dt_interval(days=F.col("k") % 8)).alias("paid_at"),
        )

    @cached_property
    def expenses(self) -> DataFrame:
        return self._events.filter((F.col("event_type") == "error") & (F.col("k") % 5 == 0)).select(F.col("event_id").alias("id"), "amount", _text("note ", F.col("k") % 4).alias("note"), F.col("ts").alias("spent_at"))

    @cached_property
    def watches(self) -> DataFrame:
        return self._events.filter(_picture() & (F.col("k") % 3 == 1)).select(
            F.col("event_id").alias("id"),
            _group().alias("group_jid"),
            _text("7900", F.lpad((F.col("k") % 12).cast("string"), 7, "0"), "@s.example").alias("sender_jid"),
            F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).alias("client_text"),
            F.when(F.col("k") % 5 == 2, F.col("user_id")).alias("client_id"),
            "amount",
            F.col("ts").alias("tx_date"),
            F.element_at(F.array(*map(F.lit, ("noname", "lookup", "watch", "ambiguous", "unmatched"))), (F.col("k") % 5 + 1).cast("int")).alias("status"),
            F.col("received_at").alias("created_at"),
        )

    @cached_property
    def contacts(self) -> DataFrame:
        return self._read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))

    @cached_property
    def groups(self) -> DataFrame:
        return self._read("region").select(_text("g", F.col("r_regionkey")).alias("group_jid"), F.col("r_name").alias("name"))

    @cached_property
    def owners(self) -> DataFrame:
        return self._read("nation").filter("n_nationkey < 6").select(_text("7900", F.lpad(F.col("n_nationkey").cast("string"), 7, "0")).alias("phone"), F.col("n_name").alias("owner"))

    @cached_property
    def history(self) -> DataFrame:
        return self._read("conversations").select(F.col("conv_id").alias("chat_key"), F.col("turn").alias("seq"), (F.col("role") == "user").alias("from_user"), F.col("text").alias("body"))

    @cached_property
    def clients(self) -> DataFrame:
        """Some customers are missing, some have a namesake, and one has a name in common with unknown recipients."""
        customers = self._read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"))
        namesakes = customers.filter("id % 11 = 0").select((F.col("id") + 10_000_000).alias("id"), F.concat("full_name", F.lit(" Jr")).alias("full_name"))
        other = customers.filter("id = 1").select(F.lit(20_000_000).cast("long").alias("id"), F.lit("Old Recipient").alias("full_name"))
        return customers.filter("id % 7 <> 0").unionByName(namesakes).unionByName(other)

    @cached_property
    def contracts(self) -> DataFrame:
        remaining = F.when(F.col("o_orderstatus") == "O", F.floor("o_totalprice")).otherwise(0).cast("long")
        return self._read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client_id"), _text("b", F.col("o_orderkey") % 3).alias("branch_id"), remaining.alias("remaining"))

    @cached_property
    def rules(self) -> DataFrame:
        return self._read("region").select(_text("g", F.col("r_regionkey")).alias("source"), F.col("r_name").alias("source_name"), _text("g", (F.col("r_regionkey") + 1) % 4).alias("target_jid"), F.lower("r_name").alias("target_name"))

    @cached_property
    def settings(self) -> DataFrame:
        key = F.element_at(F.array(*map(F.lit, ("main_group", "working_group", "unmatched_branch"))), (F.col("r_regionkey") + 1).cast("int"))
        return self._read("region").filter("r_regionkey < 3").select(key.alias("key"), _text("g", F.col("r_regionkey") + 1).alias("value"))


def _picture() -> Column:
    return F.col("event_type").isin("purchase", "view")


def _group() -> Column:
    return _text("g", F.col("k") % 4)


def from_events(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger of the driver tables."""
    return EventsLedger(spark, sf_dir)
