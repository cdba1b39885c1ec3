"""Receipts in the layouts of several banks, with made-up names, over the events; and what is to be read from each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import parsers

RECIPIENT, SENDER = "Тестов Имя А.", "Пробный Сидор Б."

#: Text, bank, recipient, sender, amount over the thousands (null: no amount), commission, doc, auth, status, time. ``@``
#: stands for thousands, ``#`` for the event, ``R`` and ``S`` in braces for the names.
LAYOUTS = (
    ("Альфа-Банк\n\nПолучатель\n{R}\n\nСколько\n@ 000 Р\n\nКомиссия\n0 Р\n\nНомер документа\nd#\n\nКод авторизации\n000111", "Альфа-Банк", RECIPIENT, "", 0, 0, "d#", "000111", "", None),
    ("Исходящий перевод СБП\n{R}\n\nСтатус\nВыполнено", "ВТБ", RECIPIENT, "", None, 0, "", "", "Выполнено", None),
    ("СБЕРБАНК\nЧек по операции\n26 июня 2026 22:58:35 (МСК)\n\nОперация\nПеревод по СБП\n\nФИО получателя перевода\n{R}\n\nНомер телефона получателя\n+7 900 000-00-00\n\nБанк получателя\nТ-Банк\n\nФИО отправителя\n{S}\n\nКарта отправителя\n•• 0000\n\nСумма перевода\n@000.00 ₽\n\nКомиссия\n0.00 ₽\n\nНомер операции в СБП\nA#", "Сбербанк", RECIPIENT, SENDER, 0, 0, "A#", "", "", "2026-06-26 22:58:35"),
    ("Операция\nПеревод клиенту СберБанка\nФИО получателя\n{R}\nТелефон получателя\n+7(900) 000-00-00\nНомер счёта получателя\n**** 0000\n\nФИО отправителя\n{S}\nСчёт отправителя\n**** 0001\nСумма перевода\n@ 650,00 ₽\nКомиссия\n844,03 ₽\n\nНомер документа\n#", "Сбербанк", RECIPIENT, SENDER, 650, 844.03, "#", "", "", None),
    ("Т-Банк\nПеревод выполнен\n\nОтправитель\n{S}\n\nПолучатель\n{R}\n\nИтого\n@ 000 ₽\n\nКомиссия\n0 ₽", "Т-Банк", RECIPIENT, SENDER, 0, 0, "", "", "", None),
    ("Озон Банк\nСумма операции\n@ 500,00 ₽\nПолучатель перевода\n{R}\nСтатус операции\nИсполнено\nНомер операции\n#", "Озон Банк", RECIPIENT, "", 500, 0, "#", "", "Исполнено", None),
    ("Россельхозбанк\nПеревод по СБП\nКому\n{R}\nСумма\n@ 000 руб.\nСумма комиссии\n0 руб.", "Россельхозбанк", RECIPIENT, "", 0, 0, "", "", "", None),
    ("Получатель\n{R}\nСумма комиссии\n150 руб.\nСумма\n@ 000 руб.", "", RECIPIENT, "", 0, 150, "", "", "", None),
    ("ПСБ\nЧек по операции\nИтого @ 000 р.\nПолучатель перевода {R}\nТелефон получателя +7 (900) 000-00-00\nБанк получателя Т-Банк\nСумма @ 000 р.\nКомиссия 0 р.\nКарта списания ** 0000\nСчет списания ** 0001\nID операции СБП А#\nДата операции 27.06.2026 11:43:33\nПАО «Банк ПСБ»\nУСПЕШНО", "ПСБ", RECIPIENT, "", 0, 0, "СБП А#", "", "", "2026-06-27 11:43:33"),
    ("РСХБ\nПеревод по номеру телефона через СБП\nИсполнен\n@000 ₽\n02.06.2026, 14:12\nКомиссия\n0 ₽\nСчёт списания\n40817...0000\nПолучатель\n{R}\nНомер телефона получателя\n79000000000\nБанк получателя\nСбербанк\nИдентификатор операции в СБП", "Россельхозбанк", RECIPIENT, "", 0, 0, "", "", "", "2026-06-02 14:12:00"),
    ("ozon банк\nПеревод 26.06.2026 12:51\nИтого @ 000 ₽\nСтатус Успешно\nСчёт списания Основной счёт\nСумма @ 000 ₽\nКомиссия Без комиссии\nПолучатель {R}\nТелефон получателя +7 (900) 000-00-00\nБанк получателя Т-Банк\nОтправитель {S}\nID операции А#\nООО «ОЗОН БАНК»", "Озон Банк", RECIPIENT, SENDER, 0, 0, "А#", "", "Успешно", "2026-06-26 12:51:00"),
    ("Квитанция\n22.06.2026 23:03:45\nИтого @ 000 ₽\nПеревод По номеру телефона\nСтатус Успешно\nСумма @ 000 ₽\nКомиссия 0 ₽\nОтправитель {S}\nТелефон получателя +7 (900) 000-00-00\nПолучатель {R}\nАО «ТБАНК»\nКвитанция № 1-#", "Т-Банк", RECIPIENT, SENDER, 0, 0, "22.06.2026 23:03:45", "", "Успешно", "2026-06-22 23:03:45"),
    ("ВТБ\nИсходящий перевод СБП\n{R}\nСтатус Выполнено\nДата операции 20.06.2026, 16:04\nСчет списания *0000\nИмя плательщика {S}\nСообщение Долг\nПолучатель {R}\nТелефон получателя +7 (900) 000-00-00\nБанк получателя Т-Банк\nID операции в СБП А#\nСумма операции @ 500 ₽\nБанк ВТБ (ПАО)\nОперация выполнена", "ВТБ", RECIPIENT, SENDER, 500, 0, "А#", "", "Выполнено", "2026-06-20 16:04:00"),
)


def receipt_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a receipt in one of the layouts, read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    texts = F.array(*[F.lit(x[0].replace("{R}", RECIPIENT).replace("{S}", SENDER)) for x in LAYOUTS])
    text = F.replace(F.replace(F.element_at(texts, F.col("id").cast("int") % len(LAYOUTS) + 1), F.lit("@"), (F.col("k") + 1).cast("string")), F.lit("#"), F.col("id").cast("string"))
    return parsers.parse_receipts(e.select("id", text.alias("text"))).withColumn("tx_time", F.col("tx_time").cast("string"))


def _row(i: int, layout: tuple) -> str:
    _, bank, recipient, sender, over, commission, doc, auth, status, time = layout
    shown = lambda x: "null" if x is None else f"'{x}'"
    return f"({i}, {shown(bank)}, {shown(recipient)}, {shown(sender)}, {'null' if over is None else over}, {commission}, {shown(doc)}, {shown(auth)}, {shown(status)}, {shown(time)})"


LAYOUTS_SQL = f"""select event_id as id, bank, recipient, sender, case when over is null then 0.0 else (cast(json_extract(props, '$.k') as int) + 1) * 1000.0::double + over end as amount, commission::double as commission, replace(doc, '#', cast(event_id as varchar)) as doc_number, auth as auth_code, status, tx_time
from events join (values {", ".join(_row(i, x) for i, x in enumerate(LAYOUTS))}) v(i, bank, recipient, sender, over, commission, doc, auth, status, tx_time) on event_id % {len(LAYOUTS)} = v.i"""
