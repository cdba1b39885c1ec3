"""Payments out of messages, and fields out of receipts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.functions import vocabulary as V
from ledgerloom.session import ship


def parse_messages(messages: DataFrame, id_col: str = "id", body_col: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per payment or unclear line: id, line_no, raw_name, amount, note, card_to, unparsed (null for payments), and what to ``keep`` of its message.

    Each line is classed by itself; a name holds for the amounts below it, until the next name, blank lines
    or not. A message's names are looked through before its lines are dealt out, so that nothing is shuffled; the work
    is its lines times its names.
    """
    numbered = F.transform(F.split(F.coalesce(body_col, F.lit("")), "\r?\n"), lambda x, i: F.struct(i.alias("line_no"), fn.trimmed(x).alias("line")))
    # Amounts have digits, so that a line without one is a name by its words alone.
    a_name = lambda line: ~line.rlike(r"\d") & F.size(fn.words_of(line)).between(1, 4)
    rows = messages.select(F.col(id_col).alias("id"), F.filter(numbered, lambda x: x["line"] != "").alias("lines"), *keep)
    rows = rows.withColumn("names", F.filter("lines", lambda x: a_name(x["line"])))
    lines = rows.select("id", *keep, "names", F.inline("lines"))
    above = F.element_at(F.filter("names", lambda x: x["line_no"] < F.col("line_no")), -1)["line"]
    lines = lines.filter(~a_name(F.col("line"))).select("id", *keep, "line_no", "line", F.when(F.exists("names", lambda x: x["line_no"] < F.col("line_no")), above).alias("name"))
    part = lambda k: F.regexp_extract("line", V.NAME_AMOUNT, k)
    inline_name, inline_number = fn.trimmed(part(1)), fn.trimmed(part(2))
    acts = F.exists(F.lit(list(V.ACTIONS)), lambda a: F.lower(inline_name).contains(a))
    inline = F.coalesce(fn.thousands(F.concat(inline_number, F.lit(" "))), fn.parse_money(inline_number))
    lines = lines.withColumn("inline", F.when((inline_name != "") & ~acts & (inline > 0), inline))
    number = F.regexp_extract("line", r"^(\d[\d\s.,]*)", 1)
    prefix = F.when(number != "", fn.parse_money(number))
    lines = lines.withColumn("amount_line", F.coalesce(fn.thousands("line"), F.when(prefix > 0, prefix)))
    lines = lines.withColumn("free", fn.freeform_amount("line"))
    kind = F.when(F.col("inline").isNotNull(), "inline").when(F.col("amount_line").isNotNull(), F.when(F.col("name").isNull(), "nameless").otherwise("amount")).when(F.col("free").isNotNull(), "free").otherwise("unparsed")
    lines = lines.withColumn("kind", kind)
    paid = ~F.col("kind").isin("nameless", "unparsed")
    return lines.select(
        "id",
        "line_no",
        F.when(F.col("kind") == "inline", inline_name).when(F.col("kind") == "amount", F.col("name")).when(F.col("kind") == "free", F.coalesce("name", F.lit(V.UNNAMED))).alias("raw_name"),
        F.when(paid, F.coalesce("inline", "amount_line", "free")).alias("amount"),
        F.when(F.col("kind") == "inline", part(4)).when(paid, fn.extract_note("line")).alias("note"),
        F.when(paid, fn.extract_card("line")).alias("card_to"),
        F.when(F.col("kind") == "nameless", F.concat("line", F.lit(V.NO_NAME))).when(F.col("kind") == "unparsed", F.col("line")).alias("unparsed"),
        *keep,
    )


def looks_messy(messages: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """id and ``messy``: whether the message needs a second look."""
    open_lines = parse_messages(messages, id_col, body_col).filter("unparsed is not null").groupBy("id").agg(F.max(F.col("unparsed").rlike("[0-9]") | F.col("unparsed").contains(V.NO_NAME.strip(" ()"))).alias("open"))
    rows = messages.select(F.col(id_col).alias("id"), F.coalesce(body_col, F.lit("")).alias("body")).join(open_lines, "id", "left")
    signs = fn.is_cash("body") | F.col("body").rlike(V.COLLECTED) | F.col("body").rlike(V.SHORTHAND)
    return rows.select("id", (signs | F.coalesce("open", F.lit(False))).alias("messy"))


_LABELS = [(field, re.compile(rf"(?i)^{label}\s*{'№?' if label == 'квитанция' else ':?'}\s*(.*)$")) for field, label in V.FIELDS]
#: What a line with any label begins with.
_ANY_LABEL = re.compile("(?i)" + "|".join(f"(?:{label})" for _, label in V.FIELDS))
_FIELD_NAMES = ("recipient", "sender", "amount", "commission", "doc", "auth", "status")


def _fields(text: str) -> dict[str, str]:
    """The value of each field: the first label of an open field decides a line, and takes its rest or the next line."""
    lines = [line.strip() for line in text.splitlines()]
    found: dict[str, str] = {}
    for i, line in enumerate(lines):
        hit = next(((f, m[1].strip()) for f, r in _LABELS if f not in found and (m := r.match(line))), None) if _ANY_LABEL.match(line) else None
        if hit:
            value = hit[1] or next((x for x in lines[i + 1 :] if x), "")
            if value and not (_ANY_LABEL.match(value) and any((m := r.match(value)) and not m[1].strip() for _, r in _LABELS)):
                found[hit[0]] = value
    return found


def parse_receipts(receipts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per receipt: id, bank, recipient, sender, amount, commission, doc_number, auth_code, status, tx_time.

    Only the labels are read line by line; bank, times and amounts are columns.
    """
    ship(receipts.sparkSession)

    @F.pandas_udf("struct<recipient string, sender string, amount string, commission string, doc string, auth string, status string>")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{f: x.get(f, "") for f in _FIELD_NAMES} for x in map(_fields, texts)], columns=list(_FIELD_NAMES))

    rows = receipts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("f", labelled("text"))
    lines = F.transform(F.split("text", "\r?\n"), fn.trimmed)
    rows = rows.withColumn("head", fn.detect_bank(fn.header_lines("text"))).withColumn("lines", lines)
    rows = rows.withColumn("bank", F.when(F.col("head") != "", F.col("head")).otherwise(fn.detect_bank("text")))
    bank, lines = F.col("bank"), F.col("lines")
    # Without a labelled recipient: the line below the words for an outgoing transfer.
    outgoing = F.array_position(F.transform(lines, lambda x: F.lower(x).contains("исходящий перевод")), True).cast("int")
    below = F.get(F.filter(F.slice(lines, outgoing + 1, F.size(lines)), lambda x: x != ""), 0)
    unlabelled = (F.col("f.recipient") == "") & (outgoing > 0)
    recipient = F.when(F.col("f.recipient") != "", F.col("f.recipient")).when(unlabelled & fn.looks_like_fio(below), below).otherwise("")
    alone = r"(?iu)^(\d[\d\s.,]*)\s*(₽|руб\.?|р\.?)$"
    largest = F.array_max(F.transform(F.filter(lines, lambda x: x.rlike(alone)), lambda x: fn.parse_money(F.regexp_extract(x, alone, 1))))
    amount = fn.parse_money("f.amount")
    return rows.select(
        "id",
        F.when((bank == "") & unlabelled, "ВТБ").otherwise(bank).alias("bank"),
        recipient.alias("recipient"),
        F.col("f.sender").alias("sender"),
        F.when(amount > 0, amount).otherwise(F.coalesce(largest, F.lit(0.0))).alias("amount"),
        fn.parse_money("f.commission").alias("commission"),
        F.col("f.doc").alias("doc_number"),
        F.col("f.auth").alias("auth_code"),
        F.col("f.status").alias("status"),
        fn.tx_time("text").alias("tx_time"),
    )


def merge_receipts(rules: DataFrame, model: DataFrame, columns: list[str], authoritative: bool, id_col: str = "id") -> DataFrame:
    """Two readings of receipts in one: the model's values win, or only fill what the rules left empty."""
    other = model.select(id_col, *[F.col(c).alias(f"_{c}") for c in columns])
    pick = lambda c: F.coalesce(*[F.nullif(x, F.lit("")) for x in ((F.col(f"_{c}"), F.col(c)) if authoritative else (F.col(c), F.col(f"_{c}")))], F.lit(""))
    return rules.join(other, id_col, "left").select(id_col, *[pick(c).alias(c) for c in columns])


def resolve_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (id, raw) with canonical and matched; ``aliases``: alias, canonical.

    The whole name may be an alias; or else exactly one canonical name may be meant by its words of three
    letters and more. Whatever isn't found stays as it is.
    """
    key = lambda c: F.lower(F.regexp_replace(fn.trimmed(c), r"[\s\u00a0]+", " "))
    known = aliases.select(key("alias").alias("alias"), "canonical").distinct()
    rows = names.select("id", "raw", key("raw").alias("key"))
    exact = rows.join(known, F.col("key") == F.col("alias"), "left").groupBy("id", "raw", "key").agg(F.min("canonical").alias("exact"))
    words = rows.select("id", F.explode(F.split("key", " ")).alias("w")).select("id", F.regexp_replace("w", "^[.,]+|[.,]+$", "").alias("w")).filter("length(w) >= 3")
    by_word = words.join(known, F.col("w") == F.col("alias")).groupBy("id").agg(F.min("canonical").alias("lo"), F.max("canonical").alias("hi"))
    rows = exact.join(by_word, "id", "left").withColumn("found", F.coalesce("exact", F.when(F.col("lo") == F.col("hi"), F.col("lo"))))
    return rows.select("id", F.coalesce("found", "raw").alias("canonical"), F.col("found").isNotNull().alias("matched"))


def with_built_in(aliases: DataFrame) -> DataFrame:
    """``aliases`` (alias, canonical) and the built-in ones; of an alias in both the given one holds."""
    spark = aliases.sparkSession
    known = [(a, c) for c, names in V.BUILT_IN_ALIASES.items() for a in names]
    fixed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for a, c in known])))
    own = aliases.select("alias", "canonical")
    return own.unionByName(fixed.join(own.select(F.lower("alias").alias("_own")).distinct(), F.col("alias") == F.col("_own"), "left_anti"))


def caption_names(captions: DataFrame, extract=None, id_col: str = "id", text_col: str = "caption") -> DataFrame:
    """id and name: the client that a picture's caption names, by ``extract`` (a column function, such as a model's) or else by its form."""
    found = fn.client_name(text_col) if extract is None else F.coalesce(F.nullif(extract(F.col(text_col)), F.lit("")), fn.client_name(text_col))
    return captions.select(F.col(id_col).alias("id"), found.alias("name"))


#: What a model says of a message.
REPLY = "struct<payments:array<struct<name:string,amount:double,cash:boolean,collector:string,note:string,card:string>>,clarify:string>"

#: About as many messages as a task of ``model_payments`` sorts, whatever the number of all.
MESSAGES = 50_000


def model_payments(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """The payments in messages as a model read them, or as the rules do where it found none.

    ``messages``: id, body, cash_hint. ``replies``: id, reply, in which a JSON object is looked for. One row per payment:
    id, line_no, raw_name, amount, note, card_to, is_cash, collector, by_model.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    payments = F.transform(F.from_json(fn.json_block("reply"), REPLY)["payments"], lambda p, i: F.struct(i.alias("line_no"), fn.trimmed(p["name"]).alias("name"), *[p[c].alias(c) for c in ("amount", "cash", "collector", "note", "card")]))
    read = replies.select("id", F.filter(payments, lambda p: (p["amount"] > 0) & (p["name"] != "")).alias("payments")).filter("payments is not null and size(payments) > 0")
    # Sorted, not broadcast: ids and texts are far larger than their compressed columns, by which Spark would choose.
    # So are they when partitions are put together by their compressed bytes; therefore a task gets a number of messages.
    n = 1 + messages.count() // MESSAGES
    said = messages.filter("id is not null").repartition(n, "id").join(read.repartition(n, "id").hint("merge"), "id", "left")
    each = said.select("id", "body", "cash_hint", F.inline("payments"))
    cash = F.coalesce("cash", F.lit(False)) | F.col("cash_hint") | fn.is_cash(F.concat_ws(" ", text("body"), text("note"), text("card")))
    model = each.withColumn("is_cash", cash).select(
        "id", "line_no", F.col("name").alias("raw_name"), "amount", text("note").alias("note"),
        F.when(F.col("is_cash") & (text("card") == ""), V.CASH_CARD).otherwise(text("card")).alias("card_to"), "is_cash", fn.trimmed(text("collector")).alias("collector"), F.lit(True).alias("by_model"),
    )
    rest = said.filter("payments is null").select("id", "body", (fn.is_cash(text("body")) | F.col("cash_hint")).alias("is_cash"))
    plain = parse_messages(rest, keep=("is_cash",)).filter("unparsed is null")
    return model.unionByName(plain.select("id", "line_no", "raw_name", "amount", "note", "card_to", "is_cash", F.lit("").alias("collector"), F.lit(False).alias("by_model")))


#: The fields of a reading; those of the first list say how full it is.
_SCORED = ("recipient", "datetime", "sender", "bank", "status", "doc_number")
_FILLED = (*_SCORED, "recipient_bank")


def consensus_records(reads: DataFrame) -> DataFrame:
    """One row per receipt from several readings: id, kind, amount and the fields.

    ``reads``: id, nth, kind (cash or receipt), amount and the fields. Cash wins if more readings say so than say
    receipt. Else, of the readings with the amount that most agree on, the fullest counts, and what it lacks comes from
    the others; where none has an amount, the first reading. A receipt is read a few times, so its readings fit in a row.
    """
    texts = [F.coalesce(fn.trimmed(c), F.lit("")).alias(c) for c in _FILLED]
    score = sum(F.when(F.coalesce(fn.trimmed(c), F.lit("")) != "", 1).otherwise(0) for c in _SCORED)
    rows = reads.select("id", "kind", F.struct((-score).alias("score"), "nth", F.coalesce("amount", F.lit(0.0)).alias("amount"), *texts).alias("x"))
    cash = F.col("kind") == "cash"
    seen = rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(~cash, F.col("x")))).alias("r"),
        F.count_if(cash).alias("cash"),
        F.max(F.when(cash, F.struct(F.col("x.nth").alias("nth"), F.col("x").alias("x")))).alias("last"),
    )
    seen = seen.withColumn("winner", fn.consensus_amount(F.filter(F.transform("r", lambda x: x["amount"]), lambda a: a > 0)))
    agreed = F.filter("r", lambda x: x["amount"] == F.col("winner"))
    first = F.array(F.get(F.array_sort(F.transform("r", lambda x: F.struct(x["nth"].alias("nth"), x.alias("x")))), F.lit(0))["x"])
    is_cash = F.col("cash") > F.size("r")
    seen = seen.withColumn("used", F.when(is_cash, F.array(F.col("last.x"))).when(F.col("winner") > 0, agreed).otherwise(first))
    value = lambda c: F.coalesce(F.get(F.filter(F.transform("used", lambda x: x[c]), lambda v: v != ""), F.lit(0)), F.lit("")).alias(c)
    return seen.select("id", F.when(is_cash, "cash").otherwise("receipt").alias("kind"), F.get("used", F.lit(0))["amount"].alias("amount"), *[value(c) for c in _FILLED])
