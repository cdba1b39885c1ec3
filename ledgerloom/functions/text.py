"""Functions of text, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import vocabulary as V

_NBSP = "\u00a0"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(_col(c), r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def words_of(c: str | Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(_col(c), r"[\s\u00a0]+"), lambda w: w != "")


def parse_money(c: str | Column) -> Column:
    """The first number of a text, in either habit of writing thousands and decimals; 0 where there is none."""
    number = F.replace(F.replace(F.regexp_extract(_col(c), r"(\d[\d\s.,]*\d|\d)", 1), F.lit(" "), F.lit("")), F.lit(_NBSP), F.lit(""))
    both = number.contains(".") & number.contains(",")
    plain = F.when(both, F.translate(F.translate(number, ".", ""), ",", ".")).when(number.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.translate(number, ".,", "")).otherwise(F.translate(number, ",", "."))
    # White space other than blanks stays in the number and spoils it.
    return F.when(plain.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), plain.try_cast("double")).otherwise(0.0)


def thousands(c: str | Column) -> Column:
    """The value of a text that begins with a number of thousands; else null."""
    n = F.regexp_extract(F.lower(_col(c)), V.THOUSANDS, 1)
    return F.when(n != "", F.translate(n, ",", ".").try_cast("double") * 1000)


def extract_amount(c: str | Column) -> Column:
    """A number with a word for thousands or millions behind it, or else the first number."""
    c = _col(c)
    unit = F.lower(F.regexp_extract(c, V.SHORTHAND, 2))
    times = F.when((unit == "кк") | unit.startswith("млн") | unit.startswith("лям"), 1_000_000.0).otherwise(1000.0)
    return F.when(unit != "", parse_money(F.regexp_extract(c, V.SHORTHAND, 1)) * times).otherwise(parse_money(c))


def is_cash(c: str | Column) -> Column:
    return _col(c).rlike(V.CASH)


def extract_note(c: str | Column) -> Column:
    """The first note word, in order of preference, that the text holds."""
    low = F.lower(_col(c))
    return F.coalesce(*[F.when(low.contains(n), n) for n in V.NOTES], F.lit(""))


def extract_card(c: str | Column) -> Column:
    """The card that a text names."""
    low = F.lower(_col(c))
    named = F.regexp_extract(low, V.CARD, 0)
    return F.when(named != "", named).when(low.contains("карту") | low.contains("карта"), V.CARD_WITHOUT_BANK).when(low.contains("нал"), V.CASH_CARD).otherwise("")


def freeform_amount(c: str | Column) -> Column:
    """Thousands at the start, or else the largest number from 100 on; null where there is none."""
    c = _col(c)
    numbers = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d.,]*)"), F.lit(1)), parse_money), lambda v: v >= 100)
    return F.coalesce(thousands(c), F.array_max(numbers))


def normalize_phone(c: str | Column) -> Column:
    n = F.translate(F.regexp_replace(trimmed(c), r"^\+", ""), " -", "")
    return F.when((F.length(n) == 11) & n.startswith("8"), F.concat(F.lit("7"), F.substring(n, 2, 10))).otherwise(n)


def extract_phone(c: str | Column) -> Column:
    """The digits of a phone number, or nothing."""
    n = F.regexp_replace(_col(c), "[^0-9]", "")
    n = F.when((F.length(n) == 11) & n.startswith("8"), F.concat(F.lit("7"), F.substring(n, 2, 10))).otherwise(n)
    return F.when(F.length(n).between(10, 15), n).otherwise("")


def dup_answer(c: str | Column) -> Column:
    """``same``, ``new`` or ``unclear``."""
    t = F.lower(trimmed(c))
    holds = lambda marks: F.exists(F.lit(list(marks)), lambda m: t.contains(m))
    return F.when(holds(V.SAME_ANSWERS) | (t == "нет"), "same").when(holds(V.NEW_ANSWERS) | (t == "да"), "new").otherwise("unclear")


def collector_name(c: str | Column) -> Column:
    """What is left without markers and words with digits."""
    bare = lambda w: F.lower(F.regexp_replace(w, r'^[.,!?()«»"]+|[.,!?()«»"]+$', ""))
    return F.array_join(F.filter(words_of(c), lambda w: ~bare(w).isin("", *V.COLLECTOR_MARKERS) & ~w.rlike("[0-9]")), " ")


def client_name(c: str | Column) -> Column:
    """A name of two to five words, or null."""
    t = trimmed(c)
    kept = F.filter(words_of(t), lambda w: ~w.rlike("[0-9]") & w.rlike(r"\p{L}") & ~F.lower(w).isin(*V.NAME_STOPWORDS))
    return F.when((t != "") & (F.length(t) <= 60) & ~t.rlike(r"[?/\n@]") & F.size(kept).between(2, 5), F.array_join(kept, " "))


def first_name_line(c: str | Column) -> Column:
    """The first line that is a client's name."""
    return F.get(F.filter(F.transform(F.split(_col(c), "\n"), client_name), lambda x: x.isNotNull()), 0)


def looks_like_fio(c: str | Column) -> Column:
    """Two to four capitalised words without digits."""
    w = words_of(c)
    return ~_col(c).rlike(r"\d") & F.size(w).between(2, 4) & F.forall(w, lambda x: x.rlike("^[АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯA-Z]"))


def header_lines(c: str | Column, n: int = 5) -> Column:
    lines = F.filter(F.transform(F.split(_col(c), "\r?\n"), trimmed), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, n), "\n")


#: Any bank's mark, in lower-cased text.
_ANY_BANK = "|".join(f"(?:{p})" for _, p in V.BANKS)


def _literals(pattern: str) -> list[str]:
    """For each way to fit a bank's pattern, letters that are then in the text: the longest that stand together, and others than those of most."""
    bare = re.sub(r"\([^()]*\)\??", " ", pattern)
    return [max(re.findall(r"[^\W\d_]+", re.sub(r"\[[^]]*\]|\\.|\.", " ", way)), key=lambda x: (x not in ("банк", "bank"), len(x))) for way in bare.split("|")]


def _bears(low: Column, pattern: str) -> Column:
    """Whether the pattern is in lower-cased text; it is tried only where its letters are."""
    some = [low.contains(x) for x in _literals(pattern)]
    return reduce(Column.__or__, some) & low.rlike(pattern)


def detect_bank(c: str | Column) -> Column:
    """The first bank, in order, whose mark the text bears; else a word that ends like a bank's name; else nothing."""

    def found(low: Column) -> Column:
        generic = F.regexp_extract(low, V.GENERIC_BANK, 1)
        word = F.when((generic != "") & ~generic.isin(*V.NOT_BANKS), F.concat(F.upper(F.substring(generic, 1, 1)), F.substr(generic, F.lit(2))))
        return F.coalesce(*[F.when(_bears(low, p), bank) for bank, p in V.BANKS], word, F.lit(""))

    # As an element the lower-cased text is computed once.
    return F.get(F.transform(F.array(F.lower(_col(c))), found), F.lit(0))


def looks_like_receipt(c: str | Column) -> Column:
    phrases = "|".join(re.escape(p) for p in V.RECEIPT_PHRASES)
    return F.lower(_col(c)).rlike(f"{phrases}|{_ANY_BANK}")


def line_time(c: str | Column) -> Column:
    """The time in a line; days beyond a month's end run on into the next."""
    c = _col(c)
    part = lambda p, k: F.regexp_extract(c, p, k)
    number = lambda p, k: F.coalesce(part(p, k).try_cast("int"), F.lit(0))

    def stamp(p: str, month: Column) -> Column:
        day = F.date_add(F.make_date(number(p, 3), month, F.lit(1)), number(p, 1) - 1)
        return day.cast("timestamp") + F.make_dt_interval(F.lit(0), number(p, 4), number(p, 5), number(p, 6).cast("decimal(18,6)"))

    named = F.array_position(F.lit(list(V.MONTHS)), F.lower(part(V.NAMED_TIME, 2))).cast("int")
    numeric = number(V.NUMERIC_TIME, 2)
    return F.when(named > 0, stamp(V.NAMED_TIME, F.greatest(named, F.lit(1)))).when(numeric.between(1, 12), stamp(V.NUMERIC_TIME, F.greatest(F.least(numeric, F.lit(12)), F.lit(1))))


def tx_time(c: str | Column) -> Column:
    """The first time in a line about the date, or else in any line."""
    # Few lines hold a time; only these are taken apart.
    lines = F.filter(F.split(_col(c), "\r?\n"), lambda x: x.rlike(f"{V.NAMED_TIME}|{V.NUMERIC_TIME}"))
    first = lambda x: F.get(F.filter(F.transform(x, line_time), lambda t: t.isNotNull()), 0)
    return F.coalesce(first(F.filter(lines, lambda x: F.lower(x).contains("дата"))), first(lines))


def format_money(c: str | Column) -> Column:
    """Whole units, halves to even, thousands apart."""
    return F.regexp_replace(F.bround(_col(c).cast("decimal(20,4)"), 0).cast("decimal(18,0)").cast("string"), r"(?<=\d)(?=(\d{3})+$)", " ")


def unclear_code(c: str | Column) -> Column:
    """(kind, id) of ``kind:id``; null where it is none."""
    kind, num = F.split_part(_col(c), F.lit(":"), F.lit(1)), F.split_part(_col(c), F.lit(":"), F.lit(2)).try_cast("long")
    return F.when(kind.isin("receipt", "message") & num.isNotNull(), F.struct(kind.alias("kind"), num.alias("id")))


def json_items(c: str | Column, schema: str) -> Column:
    """The elements of a JSON array, bare or below one of the usual keys."""
    c = _col(c)
    found = [F.from_json(F.get_json_object(c, f"$.{k}"), f"array<{schema}>") for k in ("items", "data", "clients", "results")]
    return F.coalesce(F.when(trimmed(c).startswith("["), F.from_json(c, f"array<{schema}>")), *found, F.array().cast(f"array<{schema}>"))


def json_block(c: str | Column) -> Column:
    """The outermost object or array in noisy text, whichever begins first."""
    c = _col(c)
    brace, bracket = F.locate("{", c), F.locate("[", c)
    obj, arr = F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when((brace > 0) & ((bracket == 0) | (brace < bracket)), obj).otherwise(arr)


def consensus_amount(values: str | Column) -> Column:
    """The value that most give, if two do (ties: the smaller); else the lower median; 0 of none."""
    v = F.array_sort(F.filter(_col(values), lambda x: x.isNotNull()))
    votes = F.transform(F.array_distinct(v), lambda x: F.struct((-F.size(F.filter(v, lambda y: y == x))).alias("n"), x.alias("x")))
    best = F.array_min(votes)
    return F.when(F.size(v) == 0, F.lit(0.0)).when(best["n"] <= -2, best["x"]).otherwise(F.element_at(v, F.greatest(F.expr("1"), ((F.size(v) + 1) / 2).cast("int"))))


def parse_datetime(c: str | Column) -> Column:
    """The time of a text in one of the known layouts; else null."""
    t = trimmed(c)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(layout))) for layout, shape in V.DATE_LAYOUTS])


def without_name(c: str | Column, name: str) -> Column:
    """What is said to ``name``, in any case, at the beginning; a greeting if nothing is; null if it isn't addressed."""
    t = trimmed(c)
    n = len(name)
    after = F.substring(t, n + 1, 1)
    addressed = (F.lower(F.substring(t, 1, n)) == name.lower()) & ((after == "") | after.rlike("[ \t,:;!?.—-]"))
    rest = F.regexp_replace(F.substr(t, F.lit(n + 1)), "^[ \t,:;!?.—-]+", "")
    return F.when(addressed & F.lit(n > 0), F.when(rest == "", V.GREETING).otherwise(rest))


def looks_like_silence(c: str | Column) -> Column:
    """Whether a reply says that there is nothing to say."""
    low = F.lower(_col(c))
    return (F.length(low) <= V.SILENCE_LENGTH) & F.exists(F.lit(list(V.SILENCE)), lambda p: low.contains(p))


def worth_a_word(c: str | Column, least: int = 6) -> Column:
    """Whether a message is long enough to be answered unasked."""
    return F.length(trimmed(c)) >= least


def means_main_group(c: str | Column) -> Column:
    return F.lower(trimmed(c)).isin(*V.MAIN_GROUP)


def forward_source(c: str | Column) -> Column:
    """``dm`` for private chats; null where a group is meant."""
    return F.when(F.lower(trimmed(c)).isin(*V.PRIVATE_CHATS), "dm")


def file_name(c: str | Column, most: int = 60) -> Column:
    """A title as a safe file name."""
    safe = F.left(F.regexp_replace(trimmed(c), r'[/\\:*?"<>|\n\t]', "_"), F.lit(most))
    return F.when(safe == "", V.UNTITLED).otherwise(safe)


def truncated(c: str | Column, most: int) -> Column:
    """At most ``most`` bytes, with dots behind what is cut; a character that the cut parts is lost."""
    c = _col(c)
    cut = F.decode(F.substring(F.encode(c, "UTF-8"), 1, most), "UTF-8") if most else F.lit("")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.regexp_replace(cut, "\ufffd+$", ""), F.lit("...")))


def unclear_reason(kind: str | Column, amount: str | Column, recipient: str | Column) -> Column:
    """Why an item is unclear, in words."""
    kind, amount, recipient = _col(kind), _col(amount), _col(recipient)
    named = F.concat(F.lit('получатель "'), recipient, F.lit('"'))
    whole = F.bround(amount.cast("decimal(20,4)"), 0).cast("decimal(18,0)").cast("string")
    return F.when(kind == "message", V.UNCLEAR_MESSAGE).when((amount == 0) & (recipient == ""), V.UNCLEAR_ALL).when(amount == 0, F.concat(named, F.lit(", сумма не распозналась"))).otherwise(F.concat(named, F.lit(" — незнакомое имя, "), whole, F.lit(" ₽")))


def is_report_command(c: str | Column) -> Column:
    return _col(c).isin(*V.REPORT_COMMANDS)


def is_pdf(mime: str | Column, name: str | Column) -> Column:
    return F.lower(_col(mime)).contains("pdf") | F.lower(_col(name)).endswith(".pdf")


def has_digit(c: str | Column) -> Column:
    return _col(c).rlike(r"\p{Nd}")


def message_text(conversation: str | Column, extended: str | Column, caption: str | Column) -> Column:
    """The text of a message: what was written, else the extended text if there is one at all, else the picture's caption."""
    return F.coalesce(F.nullif(_col(conversation), F.lit("")), _col(extended), _col(caption), F.lit(""))
