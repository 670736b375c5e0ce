"""Russian rule lexicon of the first cascade.  All values are plain data."""

# Literals and patterns that block a message outright, in order of precedence.
BLOCKED_DOMAINS = [
    "forms.gle",
    "docs.google.com/forms",
    "kwork.ru",
    "fl.ru",
    "freelance.ru",
]

BLOCKED_BOTS = [
    "@getclient_tg_bot",
    "vk.com/freelance_all",
]

BOT_NAME_PATTERNS = [
    r"(?i)(vacanci|vacancy|jobs?|work|job_bot|freelanc)[_\w]*bot$",
    "(?i)bot_(vacanci|jobs?|work|freelanc)",
]

SCAM_PATTERNS = [
    r"чистыми.*\$\d+.*в день",
    "набор в.*команду.*eu",
    r"стабильные.*\d+.*день",
    "легкий заработок",
    r"без вложений.*\d+.*рублей",
    "пассивный доход от",
    r"провер(?:ка|ить|яем).*(?:доставк|сервис|магазин).*(?:\d+[\s]*(?:₽|руб|рублей))",
    r"(?:заказ|покупк).*за наш счёт.*(?:\d+[\s]*(?:₽|руб|рублей))",
    "тайный покупатель",
    "mystery.?shopper",
    r"#помогу\b",
    r"\bзанимаюсь\s+настройкой\b",
    r"\bя\s+занимаюсь\s+(?:настройкой|продвижением|ведением|запуском|таргетом|рекламой|seo|seo-)",
    r"\bбыстро\s+привед[ую]\s+(?:клиентов|заявки|лидов|трафик)",
    r"\bпредоставляем\s+(?:широкий|услуги|спектр|комплекс)",
    r"\bтебе\s+к\s+нам\b",
    r"\bможем?\s+сломать\s+сайт\b",
    r"\bзанимаюсь\s+хакинг",
    r"\bвзломаю\s+сайт\b",
]

SCAM_WORDS = [
    "воркер",
    "воркеров",
    "дропы",
    "обнал",
    "кардинг",
    "прогрев аккаунтов",
    "регистрация аккаунтов",
    "европа бан",
    "anti-detect",
    "antidetect",
    "поиск людей для проверки",
    "проверка сервиса доставки",
]

IRRELEVANT_TOPICS = [
    "натяжные потолки",
    "ремонт квартир",
    "грузоперевозки",
    "юридические услуги",
    "бухгалтерия",
    "1с программист",
    "видеомонтаж",
    "озон",
    "ozon",
    "wildberries",
    "wb поставщик",
    "маркетплейс",
    "инфографика для wb",
    "закупщик рекламы",
    "байер",
    "фотофиксация",
    "фотографирование помещений",
    "иллюстратор",
    "художник",
    "переводчик",
    "копирайтер со знанием",
    "копирайтер",
    "отзывы за деньги",
    "отзывы авито",
    "отзывы wb",
    "заработок без вложений",
    "доход в день",
    "подработка подростку",
    "работа для студентов без опыта",
    "smm специалист",
    "smm-менеджер",
    "smm менеджер",
    "smm-специалист",
    "ведение соцсети",
    "ведение инстаграм",
    "ведение вк",
    "контент менеджер",
    "контент для соцсетей",
    "контент-план",
    "ютуб канал",
    "youtube продвижение",
    "tiktok продвижение",
    "рилс",
    "инфлюенсер",
    "facebook ads",
    "реклама facebook",
    "реклама инстаграм",
    "telegram ads",
    "telegram рекла",
    "тг адс",
    "tg ads",
    "telegram реклама",
    "реклама telegram",
    "tg реклама",
    "telegram-бот",
    "телеграм бот продвижение",
    "яндекс маркет",
    "yandex market",
    "wb менеджер",
    "ozon менеджер",
    "менеджер маркетплейс",
    "менеджер по продвижению маркетплейс",
    "менеджер по развитию",
    "менеджер по продвижению на яндекс",
    "сторисмейкер",
    "сторис мейкер",
    "stories maker",
    "reels мейкер",
    "торговый представитель",
    "менеджер по продажам офлайн",
    "монтажёр",
    "видеограф",
    "оператор съёмки",
    "минуса для",
    "биты для",
    "рэпчик",
    "хип-хап",
    "хип-хоп бит",
    "хакингом",
    "взломаю сайт",
    "сломать сайт конкурента",
    "можем сломать",
]

# Weighted cues.  Pattern groups count every match, word groups count each word once.
CLIENT_STRONG = [
    r"\bнужен\b",
    r"\bтребуется\b",
    r"\bищу\s+(?:спец|специалист|исполнител)",
    r"\bкто\s+(?:сделает|поможет|настроит)",
    r"\bесть\s+задач",
    r"\bзаказ\b",
]

CLIENT_MEDIUM = [
    "подскажите",
    "посоветуйте",
    "помогите разобраться",
    "нужна помощь",
    "консультация",
    "аудит",
]

CLIENT_WEAK = [
    "бюджет",
    "сроки",
    "стоимость работы",
    "оплата по результату",
]

SELLER_STRONG = [
    r"#помогу\b",
    r"\bя\s+(?:специалист|таргетолог|сеошник|маркетолог)",
    r"\bпредлагаю\s+услуг",
    r"\bмое\s+портфолио",
    r"\bвозьму\s+на\s+ведение",
    r"\bготов\s+(?:работать|взяться|помочь)",
]

SELLER_MEDIUM = [
    "мой опыт",
    "мои кейсы",
    "работал с",
    "сертифицированный",
    "прошёл обучение",
    "меня зовут",
    "я — ",
    "настрою вам",
    "пишите в лс",
    "пишите мне",
    "свяжитесь со мной",
]

SELLER_WEAK = [
    "резюме",
    "опыт работы",
    "команда",
    "агентство",
    "наши услуги",
    "прайс",
    "тарифы",
]

SPAM_STRONG = [
    "подпишитесь на канал",
    "переходи в бот",
    "больше проектов в боте",
    "узнать больше",
    "жми на кнопку",
    "регистрируйся",
    "обучающий курс",
    "бесплатный вебинар",
    "наша дружная команда",
    "наша команда ищет",
    "ищем людей в команду",
    "ищем человека в команду",
    "открыта вакансия",
    "актуальная вакансия",
    "ищем на постоянную",
    "ищем в команду",
    "в нашу команду",
    "на постоянную основу",
    "на постоянку",
    "команда ищет",
    "команда по маркетингу ищем",
    "возьмем в команду",
    "берем в команду",
    "принимаем в команду",
    "приглашаем в команду",
    "нанимаем в команду",
    "ищем в штат",
    "берём в команду",
    "возьмём в команду",
    "обязанности:",
    "ваши обязанности",
    "в твои обязанности",
    "твои обязанности",
    "участвуете в составлении",
    "участвуешь в составлении",
    "требования к кандидату",
    "требования к соискателю",
    "менеджер маркетплейсов",
    "аккаунт-менеджер",
    "трафик-менеджер",
    "мониторинг выручки",
    "прогноз спроса",
    "официальное трудоустройство",
    "трудоустройство официальное",
    "руб/час",
    "руб./час",
    "рублей в час",
    "₽/час",
    "оплата сдельная",
    "сдельная оплата",
    "зп от",
    "зарплата от",
    "выплачиваем еженедельно",
    "выплаты еженедельно",
    "пак инфы",
    "пак материалов",
    "приватные консультации",
    "курс по",
    "обучение по арбитражу",
    "обучение по трафику",
    "гарантируем доход",
    "гарантированный заработок",
    "ставишь лайки",
    "скачиваешь приложения",
    "серфишь сайты",
]

SPAM_MEDIUM = [
    "набор сотрудников",
    "требуются",
    "вакансия",
    "ищем в команду",
    "в команду",
    "ищем специалиста в",
    "удаленная работа на постоянной основе",
    "свежий пак",
    "авторский курс",
    "закрытый канал",
    "лью трафик сам",
    "сам лью",
    "льём трафик",
    "черкните в директ",
    "напишите в директ",
    "пишите в директ",
    "написать в директ",
    "пиши в директ",
    "пишите в лс",
]

QUALITY_INDICATORS = [
    "техническое задание",
    "тз",
    "бриф",
    "детали проекта",
    "скайп",
    "zoom",
    "созвон",
]

# Source trust and topic relevance.
SOURCES_HIGH = [
    "Разработка и IT - Kwork фриланс заказы",
    "Таргет | Арбитраж | Вакансии",
]

SOURCES_LOW = [
    "ЖВБ – Фриланс и отзывы за деньги",
    "ФРИЛАНС | ВАКАНСИИ INSTAGRAM",
]

SOURCES_BLACKLIST = [
    "VK Freelance All",
]

TOPICS_CORE = [
    "SEO",
    "контекстная реклама",
    "авито",
    "разработка сайтов",
    "Digital Marketing",
    "SMM",
    "маркетинг",
]

TOPICS_SECONDARY = [
    "интернет-маркетинг",
    "веб-дизайн",
    "email маркетинг",
    "лендинг",
]

TOPICS_IRRELEVANT = [
    "таргетированная реклама",
    "маркетплейс",
    "WB",
    "OZON",
    "Keyword Match",
    "Unknown",
]

# Templates of a negated or already owned keyword, and cues of a request.
NEGATION_TEMPLATES = [
    r"не\s+нужн[оа]\s+{kw}",
    r"не\s+нужен\s+{kw}",
    r"без\s+{kw}",
    r"не\s+интересует\s+{kw}",
    r"не\s+требуется\s+{kw}",
    r"отказываемся\s+от\s+{kw}",
    r"сам[а]?\s+(?:делаю|делает|занимаюсь|занимается|веду|ведёт|ведет)\s+{kw}",
    r"{kw}\s+(?:не\s+нужн[оа]|не\s+нужен|не\s+требуется)",
    r"свой\s+{kw}",
    r"есть\s+{kw}",
    r"нашли\s+{kw}",
]

REQUEST_CUES = [
    "нужен",
    "нужна",
    "нужно",
    "нужны",
    "ищем",
    "ищу",
    "ищет",
    "заказать",
    "заказываем",
    "настроить",
    "настройка",
    "настроите",
    "хочу",
    "хотим",
    "хотим заказать",
    "требуется",
    "требуются",
    "помогите",
    "помоги",
    "сделайте",
    "сделать",
    "сделаем",
    "запустить",
    "запустите",
    "подберите",
    "подберём",
    "ведение",
    "возьмёте",
    "возьмете",
    "под ключ",
    "на аутсорс",
    "ищем подрядчика",
    "ищем исполнителя",
    "нанимаем",
    "нанять",
]
