"""Topic vocabulary of the Russian lexicon."""

# The keywords of each topic, in order of precedence of the topics and as listed within each.
DIRECTION_KEYWORDS = {
    "SEO": [
        "seo", "сео", "поисковое продвижение", "позиции в поиске", "ссылочная масса", "семантическое ядро",
        "продвижение сайта", "органический трафик", "органика", "поисковая оптимизация", "seo оптимизация",
        "seo специалист", "seo аудит", "позиции google", "позиции яндекс", "яндекс поиск", "топ выдачи", "топ яндекс",
        "топ гугл", "первая страница", "выдача", "выход в топ", "топ 10 яндекс", "топ 10 google", "топ 3",
        "продвижение в яндексе", "продвижение в google", "продвижение в гугл", "yandex seo", "google seo",
        "технический аудит сайта", "аудит seo", "техническое seo", "индексация", "карта сайта", "sitemap", "robots.txt",
        "микроразметка", "скорость сайта", "внутренняя оптимизация", "внешняя оптимизация", "перелинковка", "метатеги",
        "мета теги", "title теги", "структура сайта", "crawl", "краулер", "сниппет", "расширенный сниппет",
        "featured snippet", "seo-тексты", "seo тексты", "оптимизация контента", "линкбилдинг", "крауд маркетинг",
        "вечные ссылки", "ссылочный профиль", "анкорные ссылки", "аутрич", "гостевые посты", "тематические ссылки",
        "биржа ссылок", "ссылочная стратегия", "white hat seo", "seo копирайтинг", "serm", "управление репутацией",
        "локальное seo", "семантика", "ранжирование", "поисковый трафик", "трафик из поиска", "нч запросы",
        "вч запросы", "кластеризация запросов", "продвижение интернет магазина", "высокочастотные запросы",
        "низкочастотные запросы", "поисковое ядро", "конкурентный анализ seo", "анализ конкурентов seo", "трафик сайта",
        "видимость сайта", "поднять сайт в топ", "вывести сайт в топ", "хочу в топ яндекса", "нужны клиенты из яндекса",
        "сайт не индексируется", "сайт пропал из поиска", "упал в выдаче", "просел в выдаче",
        "потеряли позиции в поиске", "вылетел из топа", "почему сайт не находят", "поднять позиции",
        "поведенческие факторы", "накрутка пф", "накрутка поведенческих", "траст сайта", "трастовость домена",
        "domain authority", "domain rating", "dr домена", "da домена", "ahrefs", "semrush", "key collector",
        "кей коллектор", "google search console", "яндекс вебмастер", "yandex webmaster", "wordstat", "яндекс вордстат",
        "сбор семантики", "подбор семантики", "среднечастотные запросы", "сч запросы", "кластеризация семантики",
        "частотность запросов", "мета описание", "description meta", "alt теги изображений", "заголовки h1 h2",
        "canonical url", "редирект 301", "хлебные крошки", "пагинация seo", "турбо страницы яндекс", "amp страницы",
        "core web vitals", "lcp fid cls", "закрыть страницы от индексации", "disavow ссылок", "апдейт яндекса",
        "алгоритм яндекса", "фильтр яндекса", "google penalty", "информационный трафик", "продвижение статьями",
        "блог для seo", "контентная стратегия seo", "seo для маркетплейса", "продвижение на wildberries",
        "продвижение карточки товара", "поднять трафик сайта",
    ],
    "контекстная реклама": [
        "яндекс директ", "yandex direct", "google ads", "google adwords", "яндекс реклама", "контекстная реклама",
        "директ", "контекст", "рся", "кмс", "ретаргетинг", "ремаркетинг", "смарт баннеры", "динамические объявления",
        "поисковые кампании", "медийная реклама", "баннерная реклама", "мастер кампаний", "performance max",
        "рекламная сеть яндекса", "рбс", "реклама на поиске яндекс", "ppc", "настройка директ", "ведение директ",
        "настройка google ads", "оптимизация кампаний", "снизить цену клика", "снизить cpc", "контекстолог",
        "реклама в поиске", "платный трафик", "ведение рекламных кампаний", "настройка контекстной рекламы",
        "аудит рекламных кампаний", "настройка рекламы", "ведение рекламы", "рекламная кампания", "реклама в яндексе",
        "реклама в google", "минус слова", "минусовка", "кросс-минусовка", "ключевые фразы", "стратегии ставок",
        "автостратегия", "ручное управление ставками", "шаблоны объявлений", "utm метки директ", "коллтрекинг",
        "целевые звонки", "calltracking", "динамический ретаргетинг", "cpa", "cpc", "roi", "roas", "стоимость лида",
        "лиды через директ", "конверсия из директ", "performance маркетинг", "платная реклама", "стоимость конверсии",
        "ctr объявлений", "директолог", "запустить контекстную рекламу", "хочу рекламу в яндексе",
        "настроить рекламу яндекс", "реклама не приносит заявки", "дорогие клики в директе",
        "много показов мало кликов", "сливается бюджет на рекламу", "контекстная реклама под ключ", "ведение контекста",
        "аудит директ кабинета", "оптимизация рекламного кабинета", "запуск рекламы под ключ",
        "настройка рекламы с нуля", "реклама для малого бизнеса", "реклама услуг яндекс", "реклама b2b яндекс",
        "контекстная реклама для интернет-магазина", "клиенты из директа", "заявки через рекламу",
        "автотаргетинг яндекс", "товарная галерея яндекс", "яндекс маркет реклама", "реклама в яндекс маркете",
        "бид менеджер", "биддер ставок", "google merchant center", "торговые кампании google", "product feed",
        "фид товаров", "look-alike яндекс", "яндекс аудитории", "сегменты аудитории яндекс", "медийная кампания яндекс",
        "видеореклама яндекс", "in-stream реклама", "discovery ads google", "быстрые ссылки объявления",
        "расширения объявлений", "a/b тест объявлений", "сплит тест рекламы", "дашборд рекламы",
        "отчёт по рекламным кампаниям", "romi реклама", "cac стоимость клиента", "стоимость привлечения клиента",
    ],
    "таргет вк": [
        "таргет вк", "реклама вк", "vk реклама", "vk ads", "таргет одноклассники", "mytarget", "ok реклама",
        "таргетолог вк", "реклама вконтакте", "таргетинг вк", "продвижение вконтакте", "реклама в вк",
        "таргет mytarget", "реклама в одноклассниках", "таргетированная реклама вк", "таргетированная реклама",
        "рекламный кабинет вк", "кабинет вк", "аудитория вк", "таргетинг по интересам вк", "look-alike вк",
        "lookalike вк", "парсинг аудитории", "парсер аудитории", "pepper.ninja", "segmento target", "vk pixel",
        "пиксель вк", "ретаргетинг вк", "ретаргет вк", "динамический ретаргетинг вк", "одноклассники реклама", "ok ads",
        "ok таргет", "таргет ok", "одноклассники таргет", "реклама мейлру", "mail ru таргет", "ok.ru реклама",
        "настройка таргета вк", "ведение таргета вк", "продвижение сообщества вк", "реклама сообщества вк",
        "реклама записи вк", "универсальная запись вк", "набрать подписчиков вк", "подписчики вк", "вк таргетолог",
        "специалист по таргету вк", "настроить таргет вк", "реклама вк для бизнеса", "реклама паблика вк",
        "таргет для группы вк", "раскрутка вконтакте", "раскрутка группы вк", "продвижение паблика вк",
        "набрать аудиторию вк", "привлечь подписчиков вконтакте", "таргет под ключ вк", "ведение таргета под ключ",
        "рекламный кабинет вк настройка", "реклама услуг вконтакте", "vk ads новый кабинет", "vk ads 2.0",
        "новый кабинет вконтакте", "карусель вк реклама", "клипы вк реклама", "cpm вк реклама", "cpc вк реклама",
        "переходы в сообщество вк", "вступления в группу реклама", "охватные кампании вк", "охват аудитории вк",
        "универсальная запись вк", "парсинг групп вк", "парсинг конкурентов вк", "mytarget настройка",
        "mytarget ведение", "аудитория mail.ru", "one data mytarget", "ok.ru таргет", "аудитория одноклассников",
        "продвижение в одноклассниках", "сенлер", "senler", "рассылка вк через senler", "подписка на рассылку вк",
        "лид форма вконтакте", "lead ads вк", "форма заявки вк", "чат-бот вк", "маркет платформа вк",
        "вк маркет реклама", "продвижение интернет-магазина вк", "таргет для e-commerce вк",
        "реклама товаров вконтакте", "динамическая реклама вк",
    ],
    "авито": [
        "авито", "avito", "авито про", "авито реклама", "авито продвижение", "продвижение авито", "объявления авито",
        "авито магазин", "продвижение на авито", "авито специалист", "авито менеджер", "авито маркетолог",
        "авито эксперт", "авито под ключ", "xl пакет", "xl объявления", "продвижение объявлений", "поднятие объявлений",
        "просмотры авито", "авито xl", "платное продвижение авито", "авито пакет xl", "поднятие объявления",
        "выделение объявления", "авито выделить", "авито поднять", "авито фреш", "авито аналитика",
        "конкурентный анализ авито", "статистика авито", "авито трафик", "авито просмотры", "авито звонки",
        "авито лиды", "кол-во просмотров авито", "seo авито", "сео авито", "оптимизация авито", "карточка авито",
        "описание авито", "доски объявлений", "продвижение на досках", "юла", "авито доставка", "авито бизнес",
        "авито кабинет", "настройка авито", "авито для бизнеса", "авито про кабинет", "авито недвижимость",
        "авито авто", "авито услуги", "авитолог", "авито агент", "ведение авито", "авито ведение объявлений",
        "авито ведение кабинета", "заказы через авито", "продажи через авито", "авито xml фид",
        "авито автозагрузка объявлений", "автозагрузка авито", "авито api интеграция", "авито фид загрузка",
        "авито обновление объявлений", "авито пакет продвижения", "авито премиум объявление", "авито pro подписка",
        "авито про кабинет", "авито написание объявлений", "текст для авито", "заголовок для авито", "фото для авито",
        "авито конверсия объявлений", "стоимость лида авито", "авито цена за звонок", "авито отклики",
        "авито чат ответы", "авито магазин оформление", "авито витрина магазина", "авито шапка магазина",
        "авито настройка магазина", "авито интеграция crm", "авито + амосрм", "авито битрикс интеграция",
        "авито аналитика спроса", "дром продвижение", "auto.ru продвижение", "циан продвижение",
        "яндекс недвижимость продвижение", "доски объявлений ведение", "ведение досок объявлений", "юла продвижение",
        "юла объявления",
    ],
    "разработка сайтов": [
        "tilda", "тильда", "wordpress", "битрикс", "1с-битрикс", "bitrix", "joomla", "drupal", "opencart",
        "woocommerce", "сайт", "лендинг", "landing page", "landing", "корпоративный сайт", "сайт-визитка",
        "многостраничник", "интернет-магазин", "интернет магазин", "сайт под ключ", "создание сайта",
        "разработка сайта", "создать сайт", "сделать сайт", "сайт на заказ", "сайт для бизнеса", "лендинг под ключ",
        "создать лендинг", "сделать лендинг", "персональный сайт", "b2b сайт", "b2c сайт", "e-commerce", "верстка",
        "вёрстка", "веб разработка", "frontend", "backend", "fullstack", "react", "vue", "laravel", "python django",
        "разработчик сайтов", "адаптивный сайт", "мобильная версия сайта", "редизайн сайта", "html css", "javascript",
        "nodejs", "php разработчик", "django", "fastapi", "api интеграция", "апи разработка", "переделать сайт",
        "редизайн", "перенос сайта", "доработка сайта", "платежные системы", "интеграция crm", "1с интеграция",
        "поддержка сайта", "техническая поддержка сайта", "telegram bot", "бот разработка", "chatbot разработка",
        "react native", "мобильное приложение", "разработка мобильного", "лендос", "одностраничник", "мультилендинг",
        "квиз сайт", "сайт с квизом", "marquiz", "typeform квиз", "квиз для лидогенерации", "wix разработка",
        "modx разработка", "modx cms", "битрикс24 сайт", "prestashop", "shopify разработка", "opencart разработка",
        "opencart магазин", "wordpress плагины", "wordpress тема под заказ", "crm интеграция сайта",
        "интеграция с amoCRM сайт", "callback виджет", "онлайн-чат для сайта", "jivosite интеграция",
        "форма захвата лидов", "лид-форма для сайта", "pagespeed оптимизация", "core web vitals оптимизация",
        "ускорение загрузки сайта", "lighthouse оптимизация", "ssl сертификат", "https переход", "vps настройка",
        "деплой сайта", "ci/cd настройка", "docker контейнер", "nginx настройка", "pwa приложение",
        "прогрессивное веб-приложение", "ios разработка", "android разработка", "интернет-магазин под ключ",
        "битрикс интернет-магазин", "каталог товаров разработка", "фильтры для каталога", "личный кабинет разработка",
        "кабинет пользователя сайт", "платёжный модуль", "эквайринг интеграция", "яндекс касса интеграция",
        "google pay интеграция", "техподдержка сайта", "поддержка сайта", "доработка под ключ",
    ],
    "маркетинг": [
        "маркетинг", "digital", "диджитал", "интернет-маркетолог", "маркетолог на проект", "маркетолог",
        "digital specialist", "маркетинговая стратегия", "комплексное продвижение", "digital агентство",
        "маркетинговое агентство", "продвижение бизнеса", "стратегия продвижения", "план маркетинга",
        "digital стратегия", "омниканальный маркетинг", "медиаплан", "медиапланирование", "маркетинг b2b",
        "маркетолог b2b", "рост бизнеса", "масштабирование бизнеса", "аутсорс маркетинг", "лид", "лиды",
        "лидогенерация", "генерация лидов", "привлечение клиентов", "воронка продаж", "воронка", "квалификация лидов",
        "привлечение трафика", "acquisition", "retention", "веб-аналитика", "яндекс метрика", "google analytics",
        "сквозная аналитика", "roistat", "calltracking", "utm метки", "kpi маркетинг", "roi маркетинг",
        "метрики маркетинга", "аналитика маркетинга", "маркетинговый отчет", "performance", "email маркетинг",
        "рассылки", "crm маркетинг", "amocrm", "битрикс24", "автоматизация маркетинга", "контент маркетинг",
        "content marketing", "маркетинг в telegram", "телеграм канал продвижение", "мессенджер маркетинг",
        "whatsapp маркетинг", "реклама в telegram", "реклама в телеграм", "telegram ads", "маркетинг под ключ",
        "ведение маркетинга", "маркетинг полного цикла", "комплексный маркетинг", "маркетинг для стартапа",
        "маркетинговый директор на аутсорсе", "cmo на аутсорсе", "fractional cmo", "маркетинг для малого бизнеса",
        "аутсорс-маркетолог", "онлайн-маркетинг", "performance-маркетинг", "cpa маркетинг", "affiliate маркетинг",
        "партнёрский маркетинг", "нативная реклама", "programmatic реклама", "dsp платформа", "unit-экономика",
        "unit economics расчёт", "ltv расчёт", "churn rate снижение", "customer journey map", "cjm разработка",
        "маркетинговый аудит", "аудит маркетинга", "маркетинговая аналитика", "дашборд маркетинга", "b2b лидогенерация",
        "привлечение b2b клиентов", "лид-магнит создание", "лид нёрчуринг", "lead nurturing", "account-based marketing",
        "abm маркетинг", "brand awareness", "знание бренда", "охватная рекламная кампания", "мультиканальный маркетинг",
        "точки касания клиент", "touchpoint маркетинг", "генерация заявок", "привести клиентов онлайн",
        "продажи онлайн увеличить", "продвижение услуг онлайн", "реклама телеграм каналов", "посев в телеграм",
    ],
    "интернет-маркетинг": [
        "интернет маркетинг", "онлайн маркетинг", "digital маркетинг", "интернет продвижение", "продвижение онлайн",
        "комплексный интернет маркетинг", "интернет продвижение бизнеса", "онлайн продвижение", "digital продвижение",
        "трафик на сайт", "привлечение трафика на сайт", "конверсия сайта", "онлайн реклама", "интернет реклама",
        "продвижение онлайн бизнеса",
    ],
    "веб-дизайн": [
        "веб дизайн", "ui/ux", "figma", "дизайн сайта", "прототип", "ux дизайн", "ui дизайн", "дизайн интерфейса",
        "айдентика", "графический дизайн", "логотип", "брендинг", "wireframe", "макет сайта", "дизайн лендинга",
        "дизайнер сайтов", "разработка дизайна", "дизайн интерфейсов", "дизайн с нуля", "дизайн под тз",
        "сделать дизайн", "нарисовать сайт", "создание макета", "готовый макет", "дизайн-концепция",
        "отрисовка интерфейса", "макет в figma", "дизайн в figma", "ux исследование", "usability", "usability тест",
        "user experience", "user interface", "ui/ux designer", "продуктовый дизайн", "product designer", "стиль бренда",
        "корпоративный стиль", "фирменный стиль", "разработка фирменного стиля", "гайдлайн", "дизайн-система",
        "адаптивный дизайн", "мобильный дизайн", "редизайн", "sketch", "adobe xd", "photoshop", "motion design",
        "анимация интерфейса", "нарисовать дизайн сайта", "нарисовать лендинг", "дизайн под верстку",
        "макет для разработчика", "концепция дизайна сайта", "дизайн главной страницы", "первый экран дизайн",
        "hero section дизайн", "дизайн интернет-магазина", "дизайн каталога товаров", "карточка товара дизайн",
        "ux для e-commerce", "ux аудит", "аудит интерфейса", "анализ юзабилити", "heatmap анализ",
        "вебвизор анализ поведения", "конверсионный дизайн", "дизайн для повышения конверсии", "a/b тест дизайна",
        "дизайн мобильного приложения", "app ui дизайн", "ios дизайн", "android дизайн", "дизайн таббара",
        "figma прототип", "интерактивный прототип", "кликабельный прототип", "дизайн хендовер",
        "передача макета разработчику", "спецификация дизайна", "дизайн баннеров", "email дизайн", "дизайн письма",
        "html email верстка", "разработка логотипа", "создать логотип", "фирменные цвета", "типографика бренда",
        "неймдизайн", "дизайн без тз", "дизайн презентации", "pitch deck дизайн", "дизайн коммерческого предложения",
        "дизайн кп", "дизайн под tilda", "иконки для сайта", "иллюстрации для сайта",
    ],
}
