"""Russian pattern lexicon of the second scorer.  All values are plain data."""

# Specialisations with their priority, in order of precedence.
SPECIALISATIONS = [
    (
        "SEO",
        3,
        [
            r"\bseo\b",
            r"\bсео\b",
            r"\bсеошник\b",
            "поисков(?:ая|ую|ой) оптимизаци",
            "продвижени(?:е|я) сайт",
            "вывод в топ",
            "seo[- ]специалист",
            "оптимизатор",
            "линкбилдинг",
            "linkbuilding",
            "семантическ(?:ое|ого) ядр",
            "технический аудит",
            "органический трафик",
            "поисковый трафик",
            "кластеризация",
            "перелинковка",
            "аудит сайта",
            "seo-audit",
            "вывести сайт в поиск",
            "поднять сайт в выдаче",
            "нужно сео",
            "нужно seo",
            "продвиньте сайт",
            r"\bсеошник\w*\b",
            "seo[- ]копирайт",
            r"поведенческ\w+\s+фактор",
            r"внешн\w+\s+(?:оптимизаци|ссылк)",
            r"(?:google|гугл)\s+(?:search\s+console|вебмастер)",
            r"яндекс\s+вебмастер",
            r"(?:наращивание|закупка)\s+(?:ссылок|ссылочн)",
            "(?:title|description|мета[- ]?теги)",
        ],
    ),
    (
        "контекстная реклама",
        3,
        [
            "контекстн(?:ая|ую|ой) реклам",
            r"яндекс\.директ",
            r"\bдирект\b",
            "google ads",
            "google adwords",
            r"\bppc\b",
            r"\bппс\b",
            "контекстолог",
            "директолог",
            "поисков(?:ая|ую|ой) реклам",
            r"\bрся\b",
            r"\bкмс\b",
            "настройк(?:а|у) контекст",
            "ведени(?:е|я) реклам(?:ы)? директ",
            "оптимизаци(?:я|и) ставок",
            "реклама в поиске",
            "товарная кампания",
            "контекст под ключ",
            "запустить директ",
            "настроить яндекс",
            "нужна реклама в яндексе",
            "хочу лидов из поиска",
            "настройте рекламу",
            r"(?:ведение|настройка|оптимизация)\s+(?:рекламн\w+\s+)?кампани[ийя]",
            r"(?:реклама|продвижение)\s+в\s+яндекс",
            "(?:минус[- ]?слова|минусовка)",
            r"(?:конверси\w+|cpa|cpc|ctr)\s+(?:оптимизаци|улучш)",
        ],
    ),
    (
        "таргетированная реклама",
        3,
        [
            "таргетирован(?:ная|ную|ой) реклам",
            r"\bтаргет(?:инг)?\b",
            "таргетолог",
            "vk ads",
            r"\bвк реклам",
            "вконтакте реклам",
            "вк таргет",
            "реклама вк",
            "настройк(?:а|у) таргет(?:а)? вк",
            "ведени(?:е|я) таргет(?:а)? вк",
            "lookalike вк",
            "лукалайк вконтакте",
        ],
    ),
    (
        "интернет-маркетинг",
        3,
        [
            "интернет[- ]маркетинг",
            "digital[- ]маркетинг",
            "диджитал[- ]маркетинг",
            "performance[- ]маркетинг",
            r"\bмаркетолог\b",
            "трафик[- ]менеджер",
            "cpa[- ]маркетинг",
            "привлечени(?:е|я) клиентов",
            "лидогенераци",
            r"\bлиды\b",
            "конверсионн(?:ый|ого) маркетинг",
            "growth[- ]маркетинг",
        ],
    ),
    (
        "авито",
        3,
        [
            r"\bавито\b",
            r"\bavito\b",
            "авитолог",
            "помощник авитолога",
            "реклам(?:а|у) (?:на |в )?авито",
            "размещени(?:е|я) (?:на |в )?авито",
            "объявлени(?:я|й) (?:на |в )?авито",
            "продвижени(?:е|я) (?:на |в )?авито",
            "маспостинг",
            "автозагрузка авито",
            "продажи через авито",
            "раскачать авито",
            "нужны лиды с авито",
            "настроить авито",
            r"(?:продвижение|раскрутка|ведение)\s+(?:на\s+)?авито",
            r"(?:авито|avito)\s+(?:про|магазин|кабинет)",
            r"(?:объявлени\w+|карточк\w+)\s+(?:на\s+)?авито",
        ],
    ),
    (
        "разработка сайтов",
        2,
        [
            r"\btilda\b",
            r"\bтильда\b",
            "разработ(?:ка|ку) сайт",
            r"\bлендинг\b",
            "landing page",
            "одностраничник",
            "создани(?:е|я) сайт",
            "посадочн(?:ая|ую) страниц",
            "сайт под ключ",
            "readymag",
            "webflow",
            "хочу сайт",
            "нужен сайт",
            "сделать сайт",
            "помогите с сайтом",
            "кто делает сайты",
            "нужен лендинг",
            "собрать сайт",
            r"\bcms\b",
            r"(?:доработка|переделка|редизайн)\s+сайт",
            r"\bflexbe\b",
            r"\bкрафтум\b",
            r"\bcraftum\b",
            "(?:opencart|опенкарт|woocommerce|вукомерс)",
            r"(?:адаптивн\w+\s+(?:верстк|дизайн))",
            r"(?:интеграци\w+)\s+(?:с\s+)?(?:crm|1с|битрикс|амо)",
            r"\bсайтолог\b",
            r"\bтильдолог\b",
        ],
    ),
    (
        "веб-дизайн",
        2,
        [
            "веб[- ]дизайн",
            "web[- ]дизайн",
            "ui/ux дизайн",
            "дизайн сайт",
            "дизайн лендинг",
            "прототипирование",
            "figma дизайн",
            "адаптивн(?:ый|ого) дизайн",
            r"(?:макет|прототип)\s+(?:сайта|лендинга|страниц)",
            r"(?:дизайн|редизайн)\s+(?:интернет[- ]?магазин|сайт|лендинг|страниц)",
            r"(?:figma|фигма)\s+(?:макет|дизайн|прототип)",
        ],
    ),
]

# Rejection, demand and penalty patterns.
EXCLUDED_SPECIALISATIONS = [
    r"\bsmm\b",
    r"\bсмм\b",
    "smm[- ]специалист",
    "social media",
    "контент[- ]менеджер",
    "контент[- ]мейкер",
    "email[- ]маркетинг",
    "email[- ]рассылк",
    "(?<!seo[- ])копирайтер",
    "(?<!seo[- ])копирайтинг",
    "редактор",
    "корректор",
    "ассистент",
    "помощник",
    "(?<!digital[- ])маркетолог",
    "продуктовый маркетолог",
    "product marketing",
    "маркетинговый копирайтинг",
    "продающ(?:ие|их) текст",
    "коммерческ(?:ие|их) текст",
    "текст(?:ы|ов) для реклам",
    "lsi[- ]копирайтинг",
    "текст(?:ы|ов) для лендинг",
    "аналитик",
    "анализ данных",
    r"\bcrm\b",
    "crm[- ]менеджер",
    "crm[- ]маркетолог",
    "графический дизайнер",
    "моушн[- ]дизайнер",
    "motion designer",
    "видеокреатор",
    "видео[- ]монтаж",
    "монтажер",
    "рилсмейкер",
    "reels",
    "shorts",
    "сторисмейкер",
    "stories maker",
    "художник",
    "2d артист",
    "2d artist",
    "иллюстратор",
    "фотограф",
    "фотошоп[- ]мастер",
    "менеджер по продажам",
    "сейлз",
    "sales manager",
    "холодные звонки",
    "оператор колл-центра",
    "hr[- ]менеджер",
    "рекрутер",
    "подбор персонала",
]

EXCLUDED_LOCATIONS = [
    "алмат[ыа]",
    "казахстан",
    "казахстан[аеу]",
    "алма[- ]ат[ыа]",
    "астана",
    "узбекистан",
    "ташкент",
    "грузия",
    "тбилиси",
    "ереван",
    "армения",
]

EXCLUDED_PLATFORMS = [
    "tg ads",
    "telegram ads",
    "реклам(?:а|у) в телеграм",
    "mytarget",
    "майтаргет",
    "facebook ads",
    "meta ads",
    "fb ads",
    "instagram ads",
    "реклам(?:а|у) в инстаграм",
]

DEMAND_PATTERNS = [
    r"\bищу\b",
    r"\bищем\b",
    r"\bнужен\b",
    r"\bнужна\b",
    r"\bнужны\b",
    r"\bтребуется\b",
    r"\bтребуются\b",
    r"\bвакансия\b",
    r"\bvacancy\b",
    r"\bhiring\b",
    r"\bhire\b",
    "кто может",
    "кто умеет",
    "есть кто",
    "помогите найти",
    r"\bнабираем\b",
    r"\bприглашаем\b",
    "рассматриваем кандидатов",
    "ищу подрядчика",
    "нужен специалист",
    "срочно нужен",
    "кто возьмется",
    "кто готов",
    "ищу фрилансера",
    "требуется исполнитель",
    "в штат",
    "ищу в штат",
    "подрядчик",
    "ищу подрядчика",
    "закрыть задачу",
    "помогите закрыть",
    "откликнуться",
    "заполнить анкет",
    "заполнить форму",
    "ищу того кто",
    "нужен человек который",
    "кто может реализовать",
    "запустить проект",
    r"📌\s+\w",
    r"🔥\s*(?:заказ|срочн)",
    "связаться с заказчиком",
    r"freelancehunt\.com/project",
    r"freelance\.ua/orders",
    r"kwork\.ru/projects",
    r"finder\.work/vacancies",
    r"hh\.ru/vacancy",
    r"🙋[‍♂️♀️]*\s",
    r"от\s+\d+[\s,]*\d*\s*(?:до|₽|руб)",
]

AGENCY_PATTERNS = [
    "в (?:нашу )?команд(?:у|е).{0,50}агентств",
    "в (?:нашу )?команд(?:у|е).{0,50}студи",
    "ищ(?:у|ем) в команд",
    "набираем команд",
    "расширяем команд",
    "ищ(?:у|ем) в агентств",
    "требуется в команд(?:у)? агентств",
    "smm[- ]агентств(?:о|а) ищ",
    "digital[- ]агентств(?:о|а) ищ",
    "маркетинговое агентств",
]

TEAM_PATTERNS = [
    "ищ(?:у|ем) в команд",
    "расширяем команд",
    "набираем команд",
    "требуется в команд",
]

SPAM_PATTERNS = [
    "прикладной эфир",
    "полезный эфир",
    "зайти на эфир",
    "записаться на эфир",
    "бесплатн(?:ый|ого) эфир",
    "прогрев(?:а)? к курс",
    "продаж(?:а|и) курс",
    "обнял, приподнял",
    "шлепнул по жопке",
    r"как зарабатывать \d+\.?\d* (?:тысяч|рубл)",
    "пройди бесплатное обучение",
    "насмотренность.*видео.*контента",
    "стань режиссером",
    "нейросети в кино",
    "подпишись на канал",
    "вступай в группу",
    "крипта",
    "p2p",
    "арбитраж трафика",
    "темки",
    "абуз",
    "реферальная ссылка",
    "переходи по ссылке",
    "дарю чек-лист",
    "скачать гайд",
    "забирай подарок",
    "пассивный доход",
    "удаленный заработок для всех",
    "требуются люди для перепечатки",
    "обработка текста на дому",
    "выплаты ежедневно",
    "без вложений",
    "халява",
    "раздача денег",
    "розыгрыш",
    "подработка для студентов",
    "легкие деньги",
    "заработок в приложении",
    "тапать",
    "хомяк",
    r"занимаюсь\s+составлением",
    r"системные\s+продажи",
    r"вернуть\s+себе\s+время",
    r"коллеги,?\s*(?:кто\s+хочет|устали|хочу\s+предложить)",
    r"аккаунт(?:ы)?(?:\s+(?:в\s+)?авито)?.*\s+отзыв(?:ам|ами|ах)?",
    r"написани(?:я|е)\s+отзывов",
    "отзывы за деньги",
    "купить отзывы",
    "event[- ]агентств",
    r"маркетингово(?:е|м)\s+агентств",
    r"занимаюсь\s+посевами",
    r"сделаю\s+посевы",
    r"коротк(?:ие|их)\s+ролик(?:и|ов)",
    "reels|рилс|риллс|shorts",
    r"клониров(?:ать|ание)\s+голос(а)?",
    "вебинар",
    r"приглашаем\s+на\s+(?:семинар|вебинар)",
    "АСУТП",
    r"промышленн(?:ые|ую)\s+автоматизаци",
    r"массовая?\s+рассылк[аи]",
    "(?:рассылк[аи]|инвайтинг|парсинг).{0,30}(?:telegram|тг|tg)",
    r"(?:софт|бот)\s+(?:для\s+)?(?:рассылк|парсинг|инвайтинг)",
    r"оператор\s+(?:онлайн[- ])?чата",
    r"международн\w+\s+(?:онлайн[- ])?школ",
    r"присоединяйтесь\s+к\s+нашему\s+(?:международн|чат)",
    "[єґіїІЇ]",
    r"\bщо\b",
    r"\bта\s+(?:й|її|він|вона)\b",
    r"\bякщо\b",
]

OFFER_PATTERNS = [
    r"ищ(?:у|ем)\s+(?:работу|заказы|проекты|клиентов|подработку)",
    "предлагаю(?: свои)? услуги",
    r"выполню\s+(?:работу|заказ|настройку)",
    r"готов(?:а)?\s+(?:взять|выполнить|работать)",
    "портфолио:",
    "мои кейсы",
    "опыт работы:",
    r"в поиске\s+(?:работы|заказов|проектов)",
    "сделаю на совесть",
    "настрою под ключ",
    "пишите в лс для заказа",
    "открыт(?:а)? к предложениям",
    r"отзыв(?:ы|ов)\s+на\s+авито",
    r"верификаци(?:я|и)\s+на\s+авито",
    r"аккаунт(?:ы|ов)\s+авито",
    r"аренду\s+аккаунт",
    r"менеджер(?:ы)?-помощниц(?:ы)?\s+для\s+авито",
    r"без\s+(?:будильника|начальника|вложений)",
    r"выплата\s+на\s+следующий\s+день",
    "копипастом",
    r"международную\s+онлайн-\s*школу",
    r"научим\s+зарабатывать",
    r"продюсер\s+(?:стратег|маркетолог)",
    r"меня\s+зовут\s+(?:Алена|Алёна)",
    r"помогу\s+с\s+(?:продажами|продвижением|маркетингом|таргетом|SEO)",
    r"подработка\s+для\s+телефон",
    r"обучение\s+работе\s+с\s+нуля",
    r"отзыв(?:ы|ов)(?:\s+на)?\s+авито",
    r"оператор\s+чата\s+на\s+авито",
    r"простые\s+задания\s+на\s+биржах",
    r"(?:канал|инструкцию)\s+по\s+заработку",
    r"доход\s+ежедневно",
    r"выплата\s+раз\s+в\s+неделю",
    r"стать\s+оператором\s+авито",
    r"хочу\s+быть\s+оператором",
    r"(?:привет|здравствуйте|всех приветст?вую).{0,20}меня\s+зовут",
    r"меня\s+зовут\s*[–-]?\s*[А-Я][а-я]+",
    r"я\s+сертифицированн(?:ый|ая)",
    r"(?:сделаю|настрою|разработаю|создам|создаю|делаю)\s+(?:как\s+)?(?:для\s+вас\s+)?(?:чат[- ]?бота|ии[- ]?агента|сайт|веб[- ]?сайт|сео|seo|карточк(?:и|ек))",
    r"аудит\s+безопасности\s+сайта",
    r"кому\s+нужны\s+клиенты",
    r"оплата\s+(?:до\s+и\s+после|после\s+получения)",
    r"карточк(?:и|ек)\s+для\s+мп",
    r"беру.{0,10}проект(?:а|ов)(?:\s+на\s+запуск)?",
    r"занимаюсь\s+составлением",
    r"возьму\s+в\s+работу",
    r"коллеги,?\s*(?:кто\s+хочет|устали|хочу\s+предложить)",
    r"могу\s+помочь\s+с",
    r"разработки?\s+любой\s+сложности",
    r"последнее\s+время\s+(?:часто\s+)?вижу",
    r"#(?:фрилансер|исполнитель|разработчик|дизайнер|верстальщик)\b",
    r"(?:привет|здравствуйте)[!.\s]*(?:я\s+(?:веб|дизайн|маркетолог|фрилансер|специалист))",
    r"(?:привет|здравствуйте)[!.\s]*(?:предлагаю|меня\s+зовут)",
    r"(?:предлагаю|выполню|сделаю|настрою|разработаю|создам|соберу)\s+(?:для\s+вас|вам|под\s+ключ|качественн)",
    r"(?:более|больше|свыше|от)\s+\d+\s+(?:(?:реализованных\s+)?проектов|(?:успешных\s+)?кейсов|лет\s+(?:в|опыт))",
    r"(?:бесплатн\w+)\s+(?:аудит|консультаци|разбор|стратеги)",
    r"(?:со\s+скидкой|акция|спецпредложение|спец\.?\s*цена)",
    r"(?:готов(?:а)?)\s+(?:взять|выполнить|приступить|начать|стартовать)",
    r"(?:открыт(?:а)?|свободен|доступен|доступна)\s+(?:для|к)\s+(?:новых?|сотрудничеств|проект|заказ)",
    r"(?:нахожусь|я)\s+в\s+поиске\s+(?:новых?\s+)?(?:клиентов|заказов|проектов)",
    r"(?:приведу|привлеку|привлечем|приведём)\s+(?:в\s+ваш|вам|новых?)\s+(?:бизнес|компани|клиент)",
    r"(?:мой|моя|мои|моё)\s+(?:портфолио|кейс|работ|опыт)",
    r"(?:возьму|беру|принимаю)\s+(?:в\s+работу|на\s+(?:проект|аутсорс)|заказ)",
    r"(?:гарантирую|гарантия)\s+(?:результат|возврат|качеств)",
]

EXCLUSION_PATTERNS = [
    r"\bjunior\b",
    "джуниор",
    "начинающий",
    "стажер",
    "стажировк",
    r"\bintern\b",
    "без опыта",
    r"\bзакрыто\b",
    r"\bнашли\b",
    "исполнитель найден",
    "вакансия закрыта",
]

CONTEXT_PATTERNS = [
    "посоветуйте",
    "рекомендуйте",
    "подскажите",
    "знает ли кто",
    "нужна помощь",
    "кто делал",
    "кто может сделать",
    "ищу специалиста",
    "есть контакты",
    "дайте контакт",
    "кто занимается",
    "нужна консультация",
    r"заказ\s*#\d+",
    "бюджет:",
    "дедлайн:",
    "ТЗ:",
]

