"""Functions of text on stated cases, dealt over the events: each event gets one of a function's texts, and the SQL has what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as fn

#: name: (function of a text, [(text, what comes out)]).
CASES: dict[str, tuple[Callable[[Column], Column], list[tuple[str, object]]]] = {
    "fn02_extract_amount": (fn.extract_amount, [("22т", 22000.0), ("5к", 5000.0), ("3 млн", 3000000.0), ("нет суммы", 0.0), ("2 кк", 2000000.0), ("1500 р", 1500.0), ("взял 70 тыс у него", 70000.0), ("2 ляма", 2000000.0), ("косарь", 0.0)]),
    "fn08_is_cash": (fn.is_cash, [("Тест 5000 офис", True), ("через интернет-банк 5000", False), ("НАЛИЧКА", True), ("нал 500", True), ("канал 500", False), ("у Ани", True), ("отдал из рук в руки", True), ("перевод на карту", False)]),
    "fn11_client_name": (fn.client_name, [("Тестов Тест Тестович", "Тестов Тест Тестович"), ("ок спасибо", None), ("Тест Тестов 5000", "Тест Тестов"), ("что?", None), ("Тест", None), ("mail@host ru", None), ("Аня\nОля", None)]),
    "fn12_first_name_line": (fn.first_name_line, [("22.000\nТестов Тест", "Тестов Тест"), ("5000", None), ("Иванов Иван\nПетров Пётр", "Иванов Иван"), ("", None)]),
    "fn13_looks_like_fio": (fn.looks_like_fio, [("Тестов Тест", True), ("тестов тест", False), ("Тест", False), ("Тест 5", False), ("Anna Kim", True), ("А Б В Г Д", False)]),
    "fn16_detect_bank": (fn.detect_bank, [("перевод СБЕРБАНК онлайн", "Сбербанк"), ("Т-Банк", "Т-Банк"), ("Ромашкабанк", "Ромашкабанк"), ("мобильный-банк", ""), ("ничего", "")]),
    "fn17_header_lines": (fn.header_lines, [("a\n\n b \nc\nd\ne\nf", "a\nb\nc\nd\ne"), ("", ""), ("one", "one")]),
    "fn18_tx_time": (lambda c: fn.tx_time(c).cast("string"), [("Дата 26 июня 2026 14:05:09", "2026-06-26 14:05:09"), ("26 июня 2026", "2026-06-26 00:00:00"), ("31 июня 2026", "2026-07-01 00:00:00"), ("01.02.2026, 9:30", "2026-02-01 09:30:00"), ("01.02.2026", None), ("01.13.2026 10:00", None), ("x\n05.05.2026 10:00\nдата 06.05.2026 11:00", "2026-05-06 11:00:00")]),
    "fn19_parse_datetime": (lambda c: fn.parse_datetime(c).cast("string"), [("2026-03-04 05:06:07", "2026-03-04 05:06:07"), (" 2026-03-04 05:06 ", "2026-03-04 05:06:00"), ("2026-03-04", "2026-03-04 00:00:00"), ("2026-03-04T05:06:07", "2026-03-04 05:06:07"), ("2026-03-04T05:06", "2026-03-04 05:06:00"), ("04.03.2026 05:06", "2026-03-04 05:06:00"), ("04.03.2026", "2026-03-04 00:00:00"), ("2026-13-04", None), ("завтра", None), ("", None)]),
    "fn20_looks_like_receipt": (fn.looks_like_receipt, [("Чек по операции", True), ("Получатель: А", True), ("сбербанк", True), ("фото кота", False)]),
    "fn24_dup_answer": (fn.dup_answer, [("не новый", "same"), ("новый", "new"), ("хз", "unclear"), ("нет", "same"), ("да", "new"), ("Тот же самый", "same"), ("другой платёж", "new"), ("да нет", "unclear")]),
    "fn25_collector_name": (fn.collector_name, [("взял Тест Тестов 500", "Тест Тестов"), ("у Ани", "Ани"), ("наличка", ""), ("Отдал Адаму!", "Адаму!")]),
    "fn26_without_name": (lambda c: fn.without_name(c, "Ада"), [("Ада, какой сбор?", "какой сбор?"), ("ада скинь отчет", "скинь отчет"), ("АДА", "Привет!"), ("Адам пришёл", None), ("скинь, Ада", None), (" Ада — привет", "привет"), ("", None)]),
    "fn27_looks_like_silence": (fn.looks_like_silence, [("Мне нечего добавить.", True), ("ПРОМОЛЧУ", True), ("Сбор за день 5 000", False), ("нет контекста " + "а" * 120, False), ("", False)]),
    "fn27_worth_a_word": (fn.worth_a_word, [("привет", True), (" ок ", False), ("", False), ("скинь отчёт", True)]),
    "fn29_means_main_group": (fn.means_main_group, [(" Основная ", True), ("", True), ("группа оплаты", True), ("Оплата клиентов", False)]),
    "fn29_forward_source": (fn.forward_source, [("Личка", "dm"), (" лс ", "dm"), ("Оплата", None), ("личные чаты", "dm")]),
    "fn30_unclear_code": (lambda c: F.concat_ws("/", fn.unclear_code(c)["kind"], fn.unclear_code(c)["id"].cast("string")), [("receipt:12", "receipt/12"), ("message:7", "message/7"), ("other:7", ""), ("receipt:x", ""), ("12", "")]),
    "fn31_file_name": (fn.file_name, [("Отчёт: май/июнь", "Отчёт_ май_июнь"), ("  ", "Отчёт"), ('a*b?"c"', "a_b__c_"), ("я" * 70, "я" * 60)]),
    "fn31_truncated": (lambda c: fn.truncated(c, 5), [("abcde", "abcde"), ("abcdef", "abcde..."), ("", "")]),
    "fn33_is_report_command": (fn.is_report_command, [("/отчет", True), ("/отчёт", True), ("/report", True), ("/итог", True), ("отчет", False), ("/Report", False)]),
    "fn33_is_pdf": (lambda c: fn.is_pdf(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2))), [("application/PDF|x", True), ("image/png|Чек.PDF", True), ("image/png|pdf.png", False)]),
    "fn33_has_digit": (fn.has_digit, [("сумма 5", True), ("без суммы", False), ("٣", True), ("", False)]),
}


def _literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}::double"
    return "'" + str(v).replace("'", "''") + "'"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    function, cases = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.element_at(F.array(*[F.lit(t) for t, _ in cases]), (F.col("event_id") % len(cases) + 1).cast("int"))
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", function(texts).alias("result"))

    return run


def _sql(name: str) -> str:
    cases = CASES[name][1]
    return f"select event_id, case event_id % {len(cases)} {' '.join(f'when {i} then {_literal(v)}' for i, (_, v) in enumerate(cases))} end as result from events"


QUERIES = {name: _query(name) for name in CASES}
ORACLES = {name: _sql(name) for name in CASES}
