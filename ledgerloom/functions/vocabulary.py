"""Words, patterns and tables that results depend on, stated as they must be."""

# What a note can be, in the order of preference.
NOTES = ("аванс", "премия", "долг", "перекур", "штраф", "бонус")

# The cards that a message can name.
CARD = r"(?iu)(втб|сбер(банк)?|альфа|тинькофф|т-банк|райффайзен|озон|яндекс)"
CARD_WITHOUT_BANK = "карта (банк не указан)"
CASH_CARD = "наличные"

# Words of action, which are no names.
ACTIONS = ("закрыл", "закрыла", "скинул", "скинула", "перевел", "перевёл", "оплатил", "оплатила", "взял", "взяла", "отдал", "отдала", "договор", "просрочк", "остаток")

# Patterns of amounts, names with amounts, cash and collectors.
THOUSANDS = r"(?iu)^(\d+[.,]?\d*)\s*(тыс[а-яё]*|к|k)(?:[^а-яёa-zA-Z]|$)"
SHORTHAND = r"(?iu)(\d[\d\s.,]*)\s*(кк|к|тыщ[а-яё]*|тыс[а-яё]*|т|млн|лям[а-яё]*|косар[а-яё]*)(?:[^\p{L}]|$)"
NAME_AMOUNT = r"(?iu)^([А-ЯЁа-яёA-Za-z][А-ЯЁа-яёA-Za-z\-]*(?:\s+[А-ЯЁа-яёA-Za-z\-]+){0,2})\s+(\d[\d\s.,]*(?:тыс[а-яё]*|к|k)?)\s*(р|руб|₽)?\.?\s*(аванс|премия|долг)?\s*$"
CASH = r"(?iu)(налич|кэш|кэшем|нал[иь]ком|живыми|на\s+руки|из\s+рук|(^|[^\p{L}])нал([^\p{L}]|$)|(^|[^\p{L}])cash([^\p{L}]|$)|(^|[^\p{L}])офис|(^|[^\p{L}])у\s+\p{L})"
COLLECTED = r"(?iu)(взял|забрал|отдал|собрал|принёс|принес)"
NO_NAME = " (сумма без имени)"
UNNAMED = "(не указано)"

# Answers to whether a cash payment is new.
SAME_ANSWERS = ("тот же", "та же", "то же", "тоже", "повтор", "дубл", "один и тот", "не новый", "не считай", "старый", "ошиб")
NEW_ANSWERS = ("нов", "отдельн", "друг", "ещё", "еще")

# Words around a collector's name.
COLLECTOR_MARKERS = ("у", "взял", "взяла", "забрал", "забрала", "отдал", "отдала", "к", "собрал", "собрала", "наличка", "нал", "наличными", "это", "руки", "руках")

# Words that belong to no client's name.
NAME_STOPWORDS = (
    "ок окей да нет спасибо спс привет хорошо хор понял поняла готово всё все ясно давай жду плюс принял принято ладно ок. "
    "верно точно правильно угу ага за месяц месяца месяцев мес оплата оплатил оплатила оплату нал наличка наличкой наличными офис "
    "его её ее их он она оно они мы вы ты я это этот эта эти тот та те вот тут там здесь чек чеки чека деньги сумма "
    "перевод платёж платеж текст без имени имя тебе мне ему ей нам вам и в на от перевёл перевел перевела перевели "
    "перевожу переведено скинул скинула скинули скинь кинул кинула кинули отправил отправила отправили отправлено "
    "заплатил заплатила заплатили оплачено плачу сделал сделала сделали внёс внес внесла сдал сдала принёс "
    "принес забрал взял отдал сегодня вчера сейчас только что уже ещё еще тоже также"
).split()

# Banks and their marks, in the order in which they are tried.
BANKS = (
    ("Кредит Урал Банк", r"кредит\s*урал"),
    ("Кредит Москва", r"банк\s*кредит\s*москва"),
    ("Кредит Европа", r"кредит\s*европа|credit\s*europe"),
    ("Русский Стандарт", r"русский\s*стандарт|russian\s*standard"),
    ("Транскапиталбанк", r"транскапитал|(^|\W)ткб(\W|$)"),
    ("Металлинвест", r"металлинвест"),
    ("Инвестторгбанк", r"инвестторгбанк"),
    ("Тольяттихимбанк", r"тольяттихим"),
    ("Кузнецкбизнесбанк", r"кузнецкбизнес"),
    ("Челябинвестбанк", r"челябинвест"),
    ("Челиндбанк", r"челиндбанк"),
    ("Севергазбанк", r"севергазбанк"),
    ("Газэнергобанк", r"газэнергобанк"),
    ("Запсибкомбанк", r"запсибкомбанк"),
    ("Примсоцбанк", r"примсоцбанк"),
    ("Хакасский", r"хакасский\s*муниципальн"),
    ("Уралфинанс", r"уралфинанс"),
    ("Кубань Кредит", r"кубань\s*кредит"),
    ("Дальневосточный", r"дальневосточн"),
    ("Банк Приморье", r"банк\s*приморье"),
    ("Кошелев-Банк", r"кошелев.?банк"),
    ("Ланта-Банк", r"ланта.?банк"),
    ("Меткомбанк", r"меткомбанк"),
    ("Генбанк", r"генбанк|genbank"),
    ("Держава", r"банк\s*держава"),
    ("Солидарность", r"банк\s*солидарность"),
    ("Таврический", r"таврический"),
    ("СДМ-Банк", r"сдм.?банк"),
    ("НС Банк", r"(^|\W)нс\s*банк"),
    ("Центр-инвест", r"центр.?инвест"),
    ("Экспобанк", r"экспобанк|expobank"),
    ("Уралсиб", r"уралсиб|uralsib"),
    ("Синара", r"банк\s*синара|(^|\W)скб.?банк"),
    ("Авангард", r"банк\s*авангард"),
    ("Интеза", r"банк\s*интеза|intesa"),
    ("Россельхозбанк", r"россельхоз|(^|\W)рсхб(\W|$)|(^|\W)rshb(\W|$)"),
    ("Газпромбанк", r"газпромбанк|(^|\W)гпб(\W|$)|gazprombank"),
    ("ПСБ", r"промсвязь|(^|\W)псб(\W|$)|(^|\W)psb(\W|$)"),
    ("МКБ", r"московский\s*кредитн|(^|\W)мкб(\W|$)"),
    ("АТБ", r"азиатско.?тихоокеанск|(^|\W)атб(\W|$)"),
    ("ВБРР", r"(^|\W)вбрр(\W|$)|всероссийский\s*банк\s*развития"),
    ("БКС Банк", r"бкс\s*банк|(^|\W)бкс(\W|$)"),
    ("СМП Банк", r"(^|\W)смп\s*банк|(^|\W)смп(\W|$)"),
    ("УБРиР", r"убрир|уральский\s*банк\s*реконструкц"),
    ("РНКБ", r"(^|\W)рнкб(\W|$)|rncb"),
    ("ДОМ.РФ", r"дом\.рф|дом\s*рф"),
    ("Банк СПб", r"санкт.?петербург|(^|\W)бспб(\W|$)"),
    ("Ситибанк", r"ситибанк|citibank"),
    ("Финам", r"финам\s*банк"),
    ("Совкомбанк", r"совкомбанк|халва|sovcombank"),
    ("МТС Банк", r"мтс\s*банк|mts\s*bank"),
    ("Росбанк", r"росбанк|rosbank"),
    ("Райффайзен", r"райффайзен|raiffeisen"),
    ("Ак Барс", r"ак\s*барс|ak\s*bars"),
    ("Юникредит", r"юникредит|unicredit"),
    ("Хоум Кредит", r"хоум\s*кредит|home\s*credit"),
    ("Хоум Банк", r"хоум\s*банк"),
    ("Ренессанс", r"ренессанс"),
    ("Абсолют", r"абсолют\s*банк"),
    ("Зенит", r"банк\s*зенит|(^|\W)зенит(\W|$)"),
    ("Свой Банк", r"свой\s*банк"),
    ("Новиком", r"новикомбанк"),
    ("Локо-Банк", r"локо.?банк"),
    ("Драйв Клик", r"драйв\s*клик|drive\s*click"),
    ("Модульбанк", r"модуль\s*банк|модульбанк"),
    ("Точка", r"точка\s*банк|банк\s*точка"),
    ("Вайлдберриз Банк", r"вайлдберриз|wildberries|(^|\W)вб\s*банк"),
    ("Яндекс Пэй", r"яндекс\s*(пэй|pay)"),
    ("Яндекс Банк", r"яндекс\s*банк|yandex\s*bank"),
    ("ЮMoney", r"ю\W?money|юмани|yoomoney"),
    ("QIWI", r"qiwi|киви\s*банк"),
    ("Почта Банк", r"почта\s*банк|pochta"),
    ("ОТП Банк", r"отп\s*банк|otp\s*bank"),
    ("Открытие", r"банк\s*открытие|открытие\s*банк"),
    ("Озон Банк", r"озон\s*банк|ozon\s*bank|(^|\W)озон(\W|$)"),
    ("Альфа-Банк", r"альфа.?банк|alfa.?bank"),
    ("Сбербанк", r"сбер(банк)?|sber(bank)?"),
    ("Т-Банк", r"тинькофф|tinkoff|(^|[^\p{L}])т[-.\s]?банк|(^|[^\p{L}])t[-.\s]?bank"),
    ("ВТБ", r"(^|\W)втб(\W|$)|(^|\W)vtb(\W|$)"),
)
GENERIC_BANK = r"(?iu)(?:^|[^\p{L}])([\p{L}-]{3,}банк)(?:[^\p{L}]|$)"
NOT_BANKS = ("интернет-банк", "интернетбанк", "онлайн-банк", "онлайнбанк", "мобильныйбанк", "мобильный-банк", "смс-банк", "банк-клиент", "необанк", "мойбанк", "супербанк")

# Phrases that only receipts have.
RECEIPT_PHRASES = ("получател", "исходящий перевод", "код авторизации", "чек по операции", "сумма перевода", "перевод по сбп", "перевод клиенту")

# Months in the genitive, and the two ways to write a time.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
NAMED_TIME = r"(?iu)(\d{1,2})\s+(января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\s+(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
NUMERIC_TIME = r"(\d{2})\.(\d{2})\.(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"

# The labels of a receipt's fields, in the order in which they are tried.
FIELDS = (
    ("recipient", r"фио\s+получателя\s+перевода"),
    ("recipient", r"фио\s+получателя"),
    ("recipient", r"получатель\s+перевода"),
    ("recipient", r"получатель"),
    ("recipient", r"кому"),
    ("sender", r"фио\s+отправителя"),
    ("sender", r"отправитель"),
    ("sender", r"фио\s+плательщика"),
    ("sender", r"имя\s+плательщика"),
    ("sender", r"плательщик"),
    ("sender", r"от\s+кого"),
    ("commission", r"сумма\s+комиссии"),
    ("commission", r"комиссия"),
    ("amount", r"сумма\s+перевода"),
    ("amount", r"сумма\s+операции"),
    ("amount", r"сумма\s+платежа"),
    ("amount", r"сколько"),
    ("amount", r"итого"),
    ("amount", r"сумма"),
    ("doc", r"номер\s+документа"),
    ("doc", r"номер\s+операции\s+в\s+сбп"),
    ("doc", r"номер\s+операции"),
    ("doc", r"идентификатор\s+операции(?:\s+в\s+сбп)?"),
    ("doc", r"id\s+операции(?:\s+в\s+сбп)?"),
    ("doc", r"номер\s+квитанции"),
    ("doc", r"квитанция"),
    ("auth", r"код\s+авторизации"),
    ("status", r"статус\s+операции"),
    ("status", r"статус"),
)

#: Replies that say nothing, by a phrase in them, and the length up to which a reply may be one.
SILENCE = (
    "нечего добавить", "добавить нечего", "нечего сказать", "сказать нечего",
    "пустое сообщение", "без контекста", "нет контекста", "не по теме",
    "не моя тема", "промолчу", "молчу", "не буду вмешиваться", "не вмешиваюсь",
    "нет вопроса", "нет информации", "непонятно", "не могу помочь", "ничего добавить",
    "нет повода", "воздержусь", "оставлю без", "не требуется", "нечего комментировать",
)
SILENCE_LENGTH = 120
#: How the main group and private chats are called.
MAIN_GROUP = (
    "", "основная", "основную", "основной", "основная группа", "главная", "главную", "главная группа",
    "основная группа учёта", "группа оплаты", "основную группу", "главную группу",
)
PRIVATE_CHATS = ("личка", "лс", "dm", "личные", "личные чаты", "личные сообщения")
#: Commands for the monthly report, the greeting in place of an empty address, and the name of an untitled file.
REPORT_COMMANDS = ("/отчет", "/отчёт", "/report", "/итог")
GREETING = "Привет!"
UNTITLED = "Отчёт"
#: First names that are known without any table of aliases.
BUILT_IN_ALIASES = {
    "Пияна": ("пияна", "пиян"), "Хадижат": ("хадижат", "хадижа"), "Наличка": ("наличка", "нал"), "Ахмед": ("ахмед",),
    "Милана": ("милана",), "Яхита": ("яхита",), "Нажуд": ("нажуд",), "Сафаи": ("сафаи",),
}
#: Layouts of a model's dates, as Spark patterns and the patterns of texts that they fit, in the order of trial.
DATE_LAYOUTS = (
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d\d-\d\d \d\d:\d\d$"),
    ("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"),
    ("yyyy-MM-dd'T'HH:mm", r"^\d{4}-\d\d-\d\dT\d\d:\d\d$"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$"),
    ("dd.MM.yyyy HH:mm:ss", r"^\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d$"),
    ("dd.MM.yyyy HH:mm", r"^\d\d\.\d\d\.\d{4} \d\d:\d\d$"),
    ("dd.MM.yyyy", r"^\d\d\.\d\d\.\d{4}$"),
)
#: What an unclear item is, by what is known of it.
UNCLEAR_MESSAGE = "фото/файл без распознанной операции"
UNCLEAR_ALL = "не распознались ни сумма, ни получатель"
