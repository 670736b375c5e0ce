"""Russian dialog lexicon: intents, categories, tone, automatic replies.  All values are plain data."""

# Cues of each class; a text has the first class of which it contains a cue.
PRICING = [
    "сколько", "цена", "стоимость", "прайс", "тариф", "расценки", "прайслист", "ценник", "почем", "по чем",
    "коммерческое предложение", "стоит", "бюджет на",
]

REQUEST = [
    "нужно", "нужен", "нужна", "сделать", "заказать", "хочу", "ищем", "ищу", "требуется", "помогите",
    "подключите", "возьметесь", "беретесь", "берете", "можете", "готовы", "сотрудничество", "проект", "задача",
    "интересует", "предложение", "рассмотрим", "рассматриваем",
]

GREETING = [
    "привет", "здравствуйте", "добрый", "доброе утро", "добрый день", "добрый вечер", "приветствую", "хай",
    "hello", "hi", "доброго дня", "доброго времени",
]

CATEGORY_VK = [
    "таргет вк", "реклама вк", "vk ads", "mytarget", "таргет одноклассники", "реклама вконтакте",
    "таргетолог вк", "таргетинг вк", "таргет в вк", "vk реклама", "реклама в вк", "продвижение вконтакте",
    "продвижение вк", "таргет mytarget", "реклама в одноклассниках", "ok.ru реклама", "настройка таргета вк",
    "ведение таргета вк", "вк таргетолог", "таргетированная реклама вк",
]

CATEGORY_SEO = [
    "seo", "сео", "продвижение", "поиск", "ранжирование", "органика", "поисковое продвижение",
    "продвижение в поиске", "позиции яндекс", "позиции google", "топ выдачи", "семантическое ядро", "семантика",
    "ссылочная масса", "технический аудит", "линкбилдинг", "seo оптимизация", "органический трафик",
    "трафик из поиска", "выход в топ", "первая страница поиска", "seo специалист", "seo аудит", "yandex seo",
    "google seo", "поисковый трафик",
]

CATEGORY_AVITO = [
    "авито", "avito", "авито реклама", "авито про", "продвижение авито", "объявления авито", "авито xl",
    "авито магазин", "авито бизнес", "поднятие объявлений", "продвижение объявлений", "авито специалист",
]

CATEGORY_SITES = [
    "сайт", "лендинг", "разработка", "веб", "магазин", "wordpress", "tilda", "тильда", "landing page",
    "корпоративный сайт", "интернет-магазин", "интернет магазин", "сайт визитка", "сайт под ключ", "верстка",
    "вёрстка", "веб разработка", "битрикс", "1с-битрикс", "opencart", "woocommerce", "react", "vue", "frontend",
    "backend", "редизайн", "создать сайт", "сделать сайт", "разработчик сайтов", "e-commerce",
    "электронный магазин",
]

CATEGORY_CONTEXT = [
    "реклама", "директ", "контекст", "ppc", "google ads", "яндекс директ", "yandex direct", "настройка директ",
    "ведение директ", "контекстолог", "рся", "кмс", "ретаргетинг", "ремаркетинг", "реклама в яндексе",
    "реклама в google", "настройка рекламы", "ведение рекламы", "рекламная кампания", "cpc", "cpa",
    "performance маркетинг", "платный трафик", "платная реклама",
]

POSITIVE = [
    "спасибо", "круто", "отлично", "хорошо", "буду", "да", "верно", "ок", "интересно", "супер", "замечательно",
    "прекрасно", "согласен", "договорились", "понял", "окей", "конечно", "разумеется", "обсудим", "попробуем",
    "рассмотрим", "здорово", "именно", "точно", "правильно", "отличный вариант",
]

NEGATIVE = [
    "нет", "дорого", "плохо", "не", "ошибка", "долго", "сложно", "спам", "не нужно", "не интересует",
    "не интересно", "слишком дорого", "не могу", "не подходит", "не то", "разочарован", "не устраивает",
    "отказываемся", "передумал",
]

HURRY = [
    "срочно", "быстрее", "когда", "сейчас", "горит", "asap", "горящий", "нужно сегодня", "нужно завтра",
    "как можно быстрее", "в кратчайшие сроки", "дедлайн", "жмут сроки", "поджимают сроки", "немедленно",
    "срочная задача",
]

DETAIL = [
    "бюджет", "срочно", "тз", "задание", "техническое задание", "бриф", "смета", "договор", "предоплата",
    "проект", "задача поставлена",
]

# Phrases that reveal a technical failure or a generated text, with the reason.
LEAK_PHRASES = [
    ("ошибка api", "Техническая ошибка API"),
    ("error:", "Технический лог ошибки"),
    ("exception", "Python исключение"),
    ("traceback", "Python traceback"),
    ("undefined", "Неопределенная переменная"),
    ("null", "Null значение"),
    ("nan", "Not a Number"),
    ("[object object]", "JS Object Leak"),
    ("http error", "HTTP ошибка"),
    ("status code", "HTTP статус код/ошибка"),
    ("bad gateway", "Ошибка шлюза 502"),
    ("internal server error", "Ошибка сервера 500"),
    ("connection refused", "Ошибка соединения"),
    ("timeout", "Таймаут запроса"),
    ("rate limit", "Лимит запросов API"),
    ("401 unauthorized", "Ошибка авторизации"),
    ("403 forbidden", "Ошибка доступа"),
    ("sqlalchemy", "Ошибка базы данных (SQLAlchemy)"),
    ("sqlite3", "Ошибка базы данных (SQLite)"),
    ("integrityerror", "Ошибка целостности БД"),
    ("cursor", "Упоминание курсора БД"),
    ("await ", "Упоминание асинхронного кода"),
    ("async def", "Упоминание функции кода"),
    ("self.", "Упоминание self (Python)"),
    ("__main__", "Упоминание мейн-модуля"),
    ("openai", "Упоминание OpenAI"),
    ("anthropic", "Упоминание Anthropic"),
    ("chatgpt", "Упоминание ChatGPT"),
    ("claude", "Упоминание Claude"),
    ("llm", "Упоминание LLM"),
    ("language model", "Упоминание языковой модели"),
    ("training data", "Упоминание обучающих данных"),
    ("knowledge cutoff", "Упоминание даты обучения"),
    ("as an ai", "Фраза 'Как ИИ...'"),
    ("как искусственный интеллект", "Фраза 'Как ИИ...'"),
    ("i cannot fulfill", "Отказ модели выполнять запрос"),
    ("i cannot generate", "Отказ модели генерировать"),
    ("i apologize, but", "Шаблонный отказ модели"),
]

# Automatic replies; one strong phrase or two weak ones are enough.
AUTOREPLY_STRONG = [
    "вакансия здесь размещена", "вакансии здесь размещены", "неизвестная команда", "доступные команды:",
    "login code:", "this code can be used to log in",
]

AUTOREPLY_WEAK = [
    "vakansii", "freelance_rabota", "советуем", "если вам нужен фриланс чат",
]
