"""Functions of text and parsers on synthetic cases."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn
from ledgerloom.operators import attribution, folds, parsers
from ledgerloom.sources import files
from ledgerloom.streaming import attribution as attribution_stream
from ledgerloom.streaming import flows

CASES = [
    (fn.parse_money, [("30 000 Р", 30000), ("79 650,00 ₽", 79650), ("35.000", 35000), ("1.234,56", 1234.56), ("2.500.000", 2500000), ("844,03", 844.03), ("79\u00a0650,00", 79), ("нет", 0), ("", 0), ("1\t2", 0)]),
    (fn.extract_amount, [("22т", 22000), ("5к", 5000), ("3 млн", 3000000), ("нет суммы", 0), ("2 кк", 2000000), ("1500 р", 1500)]),
    (fn.is_cash, [("Тест 5000 офис", True), ("через интернет-банк 5000", False), ("НАЛИЧКА", True), ("нал 500", True), ("канал 500", False), ("у Ани", True)]),
    (fn.normalize_phone, [("80000000000", "70000000000"), ("+7 000 000-00-00", "70000000000")]),
    (fn.extract_phone, [("тел 8 (000) 000-00-00", "70000000000"), ("12345", "")]),
    (fn.dup_answer, [("не новый", "same"), ("новый", "new"), ("хз", "unclear"), ("нет", "same"), ("да", "new")]),
    (fn.collector_name, [("взял Тест Тестов 500", "Тест Тестов"), ("у Ани", "Ани")]),
    (fn.client_name, [("Тестов Тест Тестович", "Тестов Тест Тестович"), ("ок спасибо", None), ("Тест Тестов 5000", "Тест Тестов"), ("что?", None), ("Тест", None)]),
    (fn.detect_bank, [("перевод СБЕРБАНК онлайн", "Сбербанк"), ("Т-Банк", "Т-Банк"), ("Ромашкабанк", "Ромашкабанк"), ("мобильный-банк", ""), ("ничего", "")]),
    (fn.format_money, [("1234567.5", "1 234 568"), ("2.5", "2"), ("-1000", "-1 000")]),
    (fn.looks_like_fio, [("Тестов Тест", True), ("тестов тест", False), ("Тест", False), ("Тест 5", False)]),
    (fn.json_block, [('so: {"a": [1]} ok', '{"a": [1]}'), ('x [{"a": 1}] y', '[{"a": 1}]'), ("none", "")]),
]


@pytest.mark.parametrize("function,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_function(spark, function, cases):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = [r["x"] for r in df.select("i", function("s").alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]
    assert spark.range(1).select(function(F.lit(None).cast("string")).alias("x")).count() == 1


def test_times(spark):
    cases = [("Дата 26 июня 2026 14:05:09", "2026-06-26 14:05:09"), ("26 июня 2026", "2026-06-26 00:00:00"), ("31 июня 2026", "2026-07-01 00:00:00"), ("01.02.2026, 9:30", "2026-02-01 09:30:00"), ("01.02.2026", None), ("01.13.2026 10:00", None), ("x\n05.05.2026 10:00\nдата 06.05.2026 11:00", "2026-05-06 11:00:00")]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = [r["x"] for r in df.select("i", fn.tx_time("s").cast("string").alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


@pytest.mark.parametrize("values,want", [([130.0, 140.0, 1300.0], 140), ([15.0, 18.0], 15), ([5.0, 5.0, 9.0], 5), ([], 0), ([2.0, 2.0, 1.0, 1.0], 1)])
def test_consensus(spark, values, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(fn.consensus_amount("v")).first()[0] == want


def test_messages(spark):
    bodies = ["Имя\n100\n\n200", "500", "Тест Тестов 5к аванс", "скинул на карту сбер 1500 вчера", "раз два три четыре пять шесть", None, ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {(r["id"], r["line_no"]): (r["raw_name"], r["amount"], r["unparsed"]) for r in parsers.parse_messages(df).collect()}
    assert got == {
        (0, 1): ("Имя", 100.0, None),
        (0, 3): ("Имя", 200.0, None),
        (1, 0): (None, None, "500 (сумма без имени)"),
        (2, 0): ("Тест Тестов", 5000.0, None),
        (3, 0): ("(не указано)", 1500.0, None),
        (4, 0): (None, None, "раз два три четыре пять шесть"),
    }


def test_receipts(spark):
    text = "СберБанк\nЧек по операции\n26 июня 2026 14:05\nПолучатель: Тестов Т.\nОтправитель\nИванов И.\nКомиссия 0,00\nСумма перевода\n30 000 ₽\nНомер документа: 77\nСтатус: Исполнен"
    other = "Исходящий перевод\nТестов Тест\n1 500 ₽"
    got = {r["id"]: r.asDict() for r in parsers.parse_receipts(spark.createDataFrame([(1, text), (2, other), (3, None)], "id int, text string")).collect()}
    assert (got[1]["bank"], got[1]["recipient"], got[1]["sender"], got[1]["amount"], got[1]["doc_number"], got[1]["status"]) == ("Сбербанк", "Тестов Т.", "Иванов И.", 30000.0, "77", "Исполнен")
    assert str(got[1]["tx_time"]) == "2026-06-26 14:05:00"
    assert (got[2]["bank"], got[2]["recipient"], got[2]["amount"]) == ("ВТБ", "Тестов Тест", 1500.0)
    assert got[3]["amount"] == 0


def test_names(spark):
    aliases = spark.createDataFrame([("тест", "Тестов Т."), ("тестов тест", "Тестов Т."), ("ива", "Иванов И.")], "alias string, canonical string")
    names = spark.createDataFrame([(1, " Тестов  Тест "), (2, "Тест какой-то"), (3, "Тест Ива"), (4, "Никто")], "id int, raw string")
    got = {r["id"]: (r["canonical"], r["matched"]) for r in parsers.resolve_names(names, aliases).collect()}
    assert got == {1: ("Тестов Т.", True), 2: ("Тестов Т.", True), 3: ("Тест Ива", False), 4: ("Никто", False)}


def test_duplicate_chain(spark):
    rows = [(i, s, "", "") for i, s in enumerate((0, 240, 480))]
    df = spark.createDataFrame(rows, "id long, s long, doc_number string, auth_code string").select("id", F.timestamp_seconds("s").alias("tx_date"), "doc_number", "auth_code", F.lit("g").alias("group_jid"), F.lit(1).cast("long").alias("contact_id"), F.lit("r").alias("recipient_raw"), F.lit(10).cast("decimal(12,2)").alias("amount"), F.lit(False).alias("ignored"), F.timestamp_seconds("s").alias("created_at"), F.col("id").alias("raw_message_id"))
    assert {r["id"]: r["is_copy"] for r in folds.duplicate_receipts(df).collect()} == {0: False, 1: True, 2: False}


EVENTS = [(1, 0, "name", "A"), (2, 10, "receipt", None), (3, 20, "receipt", None), (4, 30, "name", "B"), (5, 40, "name", "C"), (6, 1000, "receipt", None)]


def _events(spark, rows):
    df = spark.createDataFrame(rows, "id long, s long, kind string, text string")
    return df.select("id", F.lit("g").alias("grp"), F.lit("x").alias("sender"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "kind", "text")


def test_pairing_in_batch_and_stream(spark, tmp_path):
    batch = {r["id"]: r["name"] for r in folds.pair_names(_events(spark, EVENTS)).collect()}
    assert batch == {2: "A", 3: "B", 6: None}
    for k, part in enumerate((EVENTS[:3], EVENTS[3:])):
        before = set((tmp_path / "in").glob("*.parquet"))
        _events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)  # files are read in the order of their times
    schema = _events(spark, EVENTS).schema
    stream = attribution_stream.paired_names(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert {r["id"]: r["name"] for r in flows.drained(stream).collect()} == {2: "A", 3: "B"}


def test_messages_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "wa_message_id string, s long").select("wa_message_id", F.timestamp_seconds("s").alias("received_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = flows.messages_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert sorted(r["wa_message_id"] for r in flows.drained(stream).collect()) == ["a", "b"]


def test_cash_photos(spark):
    """A photo marks the newest open payment, or records its payer's or a waiting name's cash, or waits for the next payment."""
    rows = [
        (1, 0, "payment", None, 100.0, False), (2, 60, "payment", None, 200.0, True), (3, 120, "photo", None, None, None),
        (4, 180, "photo", "Ким", 50.0, None), (5, 240, "name", "Оля", 30.0, None), (6, 300, "photo", None, None, None),
        (7, 360, "photo", None, None, None), (8, 420, "payment", None, 70.0, False), (9, 480, "photo", None, None, None), (10, 5000, "payment", None, 5.0, False),
    ]
    df = spark.createDataFrame(rows, "id long, s long, kind string, text string, amount double, paired boolean")
    df = df.select("id", F.lit("g").alias("grp"), F.lit("x").alias("sender"), F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "kind", "text", "amount", "paired")
    got = {r["id"]: r["result"] for r in attribution.cash_photos(df).collect()}
    assert got == {3: "mark:1", 4: "record:Ким:50", 6: "record:Оля:30", 7: "wait", 8: "cash", 9: "wait"}


def test_stretches_change_nothing(spark):
    """Folds of a key dealt by stretches give what one fold over the whole key gives, with gaps at and around the window."""
    times = [0, 300, 301, 601, 1200, 1500, 1801, 5000, 5299, 5601]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, s long").withColumn("k", F.lit("a"))

    def fold():
        last: list[int] = []

        def step(r) -> bool:
            hit = bool(last) and r.s - last[0] <= 300
            if not hit:
                last[:] = [r.s]
            return hit

        return step

    whole, parts = ({r["id"]: r["result"] for r in folds.folded(df, ["k"], ["s", "id"], fold, "id long, result boolean", ["id"], gap).collect()} for gap in (None, 300))
    assert whole == parts


def test_files_with_text(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.png").write_bytes(b"two")
    found = files.media(spark, str(tmp_path))
    got = {r["name"]: (r["is_pdf"], r["text"]) for r in files.with_text(found, lambda content, pdf: content.decode() if pdf else "").collect()}
    assert got == {"a.PDF": (True, "one"), "b.png": (False, "")}
    assert {r["text"] for r in files.with_text(found).collect()} == {""}
