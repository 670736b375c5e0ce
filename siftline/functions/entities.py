"""Contacts, companies and niches found in a text; detection and masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import numbers
from siftline.functions.text import SPACE, URL, WORD, extract_all, let

# Personal-data spans.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
HANDLE = r"@([a-zA-Z0-9_]{5,})"
FORM = r"(?i)https?://(?:forms\.gle|typeform\.com|docs\.google\.com)/\S+"

# Company cues.
COMPANY_QUOTED = r"(?U)(?:компания|проект|бренд|магазин|школа)\s+[«\"]([^»\"]+)[»\"]"
COMPANY_AFTER = r"(?U)(?:для|у нас в)\s+([А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?)"

# Where a contact is named in a text, in order of precedence.
CONTACT_PATTERNS = [
    r"(?:откликаться|отклик|писать|пишите)\s+(?:сюда|в\s+личку|лс)?[:\s👉→]*(@\w+)",
    r"(?:контакт|тг|связь|tg|связаться)[:\s👉→]*(@\w+)",
    r"админ(?:у|а)?[:\s👉→]*(@\w+)",
    r"личка[:\s👉→]*(@\w+)",
    r"автор(?:у|а)?[:\s👉→]*(@\w+)",
    r"откликнуться\s+[👉→]\s*(@\w+)",
    r"(@\w+)\s+с пометкой\s+#\w+",
    r"написать\s+(@\w+)",
    r"менеджер(?:у)?[:\s👉→]*(@\w+)",
]
PRIVATE_MESSAGE = [
    r"личные\s+сообщения", r"личку", r"лс", r"в\s+личном", r"личка\s+админа", r"лички\s+админа", r"писати\s+админу",
    r"headmod", r"head[- ]mod", r"связаться\s+со\s+мной",
]
BUTTON_CUES = [
    "связаться", "откликнуться", "контакт", "написать", "отклик", "автор", "узнать подробнее", "заполнить", "админ",
    "анкета",
]
BUTTON_SECTION = "🔘 КНОПКИ:"

# How a niche is named, and the known niches with their cues in order of precedence.
NICHE_PATTERNS = [
    (r"для\s+([а-яА-Яa-zA-Z\s-]+(?:компании|фирмы|проекта|бизнеса))", "для [ниша]"),
    (r"в нише\s+([а-яА-Яa-zA-Z\s-]+)", "в нише [ниша]"),
    (r"проект\s+([а-яА-Яa-zA-Z\s-]+)", "проект [ниша]"),
    (r"(?:seo|контекст|таргет)[- ]специалист\s+(?:по|для)\s+([а-яА-Яa-zA-Z\s-]+)", "[специалист] по [ниша]"),
    (r"(?:интернет[- ])?магазин\s+([а-яА-Яa-zA-Z\s]+)", "магазин [ниша]"),
    (r"(?:сайт|лендинг)\s+(?:для|по)\s+([а-яА-Яa-zA-Z\s-]+)", "сайт для [ниша]"),
]
KNOWN_NICHES = {
    "строительство": ["строительств", "коттедж", "дом", "ремонт", "стройк"],
    "недвижимость": ["недвижимост", "квартир", "жилье", "риэлтор"],
    "e-commerce": ["интернет-магазин", "e-commerce", "ecommerce", "онлайн-магазин", "маркетплейс"],
    "онлайн-школа": ["онлайн-школ", "курс", "обучение онлайн", "образование", "вебинар", "инфопродукт"],
    "медицина": ["медицин", "клиник", "стоматолог", "врач", "здоровье"],
    "автомобили": ["автомобил", "авто", "машин", "автосервис", "автозапчаст"],
    "красота": ["салон красоты", "парикмахерск", "косметолог", "маникюр", "барбершоп"],
    "фитнес": ["фитнес", "спортзал", "тренажерн", "йога", "спорт"],
    "ресторан": ["ресторан", "кафе", "бар", "общепит", "доставка еды"],
    "юриспруденция": ["юридическ", "адвокат", "юрист", "право"],
    "финансы": ["финанс", "банк", "кредит", "инвестиц", "страхов"],
    "туризм": ["туризм", "туристическ", "путешеств", "тур", "отдых"],
}

RE = "(?iU)"


def contact_spans(text: Column) -> Column:
    at_sign = F.contains(text, F.lit("@"))  # both address patterns need one, and most texts have none
    empty = F.array().cast("array<string>")
    emails = F.when(at_sign, extract_all(text, EMAIL)).otherwise(empty)
    handles = F.when(at_sign, extract_all(text, HANDLE, 1)).otherwise(empty)
    phones = extract_all(text, PHONE)
    return F.struct(
        emails.alias("emails"),
        phones.alias("phones"),
        handles.alias("handles"),
        extract_all(text, URL).alias("urls"),
        ((at_sign & (text.rlike(EMAIL) | text.rlike(HANDLE))) | text.rlike(PHONE)).alias("has_contact"),
    )


def mask_contacts(text: Column) -> Column:
    """Replace personal-data spans by their kind; the first kind wins where spans overlap."""
    at_sign = F.contains(text, F.lit("@"))
    masked = F.regexp_replace(F.when(at_sign, F.regexp_replace(text, EMAIL, "<email>")).otherwise(text), PHONE, "<phone>")
    return F.when(at_sign, F.regexp_replace(masked, HANDLE, "<handle>")).otherwise(masked)


def company_names(text: Column) -> Column:
    return F.array_distinct(F.concat(extract_all(text, COMPANY_QUOTED, 1), extract_all(text, COMPANY_AFTER, 1)))


def username_from_url(url: Column) -> Column:
    path = rf"(?i)(?:t|telegram)\.me/([{WORD}]+)"
    found = F.when(url.rlike(path), F.concat(F.lit("@"), F.regexp_extract(url, path, 1)))
    return F.coalesce(found, F.when(url.startswith("@"), url))


def parse_buttons(buttons: Column) -> Column:
    """Buttons of the section as (priority, position, text, url), best first."""
    cues = F.array(*map(F.lit, BUTTON_CUES))

    def parse(line, position):
        parts = F.split(line, "→")
        label = F.regexp_replace(F.get(parts, 0), "^[ •]+|[ •]+$", "")
        hits = F.transform(cues, lambda c: F.contains(F.lower(label), c))
        priority = F.array_position(hits, True).cast("int")
        return F.when(
            F.size(parts) == 2,
            F.struct(
                F.when(priority > 0, priority - 1).otherwise(999).alias("priority"),
                position.alias("position"),
                label.alias("text"),
                F.regexp_replace(F.get(parts, 1), f"^[{SPACE}]+|[{SPACE}]+$", "").alias("url"),
            ),
        )

    lines = F.when(F.contains(buttons, F.lit(BUTTON_SECTION)), F.split(buttons, "\n"))
    return F.array_sort(F.filter(F.transform(lines, parse), lambda b: b.isNotNull()))


def _contact(level, kind, value, link, instructions, subject, source, confidence, backups=None) -> Column:
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    empty = F.array().cast("array<string>")
    return F.struct(
        text(level).alias("priority_level"),
        text(kind).alias("contact_type"),
        text(value).alias("contact_value"),
        text(link).alias("contact_link"),
        text(instructions).alias("additional_instructions"),
        text(subject).alias("subject_line"),
        text(source).alias("extraction_source"),
        text(confidence).alias("extraction_confidence"),
        (empty if backups is None else backups).alias("backup_contacts"),
    )


def _profile(name: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), F.regexp_replace(name, "^@+", ""))


def contact_priority(
    text: Column, buttons: Column, sender_username: Column, sender_id: Column, fwd: Column
) -> Column:
    """Best contact of a message as a 9-field struct: forwarded user, button, named in the text, private
    message, phone, sender name, any handle or form, sender id, none."""
    text = F.coalesce(text, F.lit(""))
    forwarded = fwd.isNotNull() & fwd["from_id"].isNotNull() & (fwd["from_id"] != 0) & fwd["channel_id"].isNull()
    fwd_name = fwd["from_username"]
    level_0 = F.when(
        forwarded & (F.coalesce(fwd_name, F.lit("")) != ""),
        _contact("0", "forwarded_from", F.concat(F.lit("@"), fwd_name), _profile(fwd_name), "Переслано от пользователя",
                 None, "пересланное сообщение", "high"),
    ).when(
        forwarded,
        _contact("0", "forwarded_from", fwd["from_id"], F.concat(F.lit("tg://user?id="), fwd["from_id"]),
                 "Переслано от пользователя (без username)", None, "пересланное сообщение (ID)", "medium"),
    )

    parsed = parse_buttons(buttons)
    best = F.get(parsed, 0)
    name = username_from_url(best["url"])
    others = F.transform(F.slice(parsed, 2, F.greatest(F.size(parsed) - 1, F.lit(0))), lambda b: b["url"])
    level_1a = F.when(
        name.isNotNull(),
        _contact("1A", "button_username", name, _profile(name), None, None,
                 F.concat(F.lit("кнопка '"), best["text"], F.lit("'")), "high", others),
    )

    named = []
    for pattern in CONTACT_PATTERNS:
        handle = F.regexp_extract(text, RE + pattern, 1)
        tag = F.regexp_extract(text, rf"{RE}@\w+\s+с пометкой\s+(#\w+)", 1)
        subject = F.regexp_extract(text, rf"{RE}@\w+\s+с темой\s+['\"]([^'\"]+)['\"]", 1)
        named.append(
            F.when(
                text.rlike(RE + pattern),
                _contact(
                    "1B", "text_username", handle, _profile(handle),
                    F.when(_follows(text, handle, r"с пометкой\s+#\w+"), F.concat(F.lit("с пометкой "), tag)),
                    F.when(_follows(text, handle, r"с темой\s+['\"][^'\"]+['\"]"), subject),
                    f"текст (паттерн '{pattern}')", "high",
                ),
            )
        )

    private = F.when(
        text.rlike(RE + "|".join(PRIVATE_MESSAGE)),
        _contact("1C", "admin_mention", "написать автору/админу", None, "В тексте указано писать в личные сообщения",
                 None, "упоминание лички в тексте", "medium"),
    )
    phone = F.regexp_extract(text, PHONE, 0)
    person = F.regexp_extract(text, rf"(?:{PHONE})\s*([А-Я][а-я]+)", 1)
    level_1d = F.when(
        text.rlike(PHONE),
        _contact("1D", "phone", F.when(person != "", F.concat(phone, F.lit(" ("), person, F.lit(")"))).otherwise(phone),
                 F.concat(F.lit("tel:"), F.regexp_replace(phone, r"[ \-()]", "")), "Указан номер телефона", None,
                 "номер телефона в тексте", "high"),
    )
    sender = F.when(sender_username.startswith("@"), sender_username).otherwise(F.concat(F.lit("@"), sender_username))
    level_2 = F.when(
        F.coalesce(sender_username, F.lit("")) != "",
        _contact("2", "sender_username", sender, _profile(sender), None, None, "username отправителя", "medium"),
    )
    handles = extract_all(text, f"@[{WORD}]+")
    first = F.get(handles, 0)
    level_4 = F.when(
        F.size(handles) > 0,
        _contact("4", "text_username", first, _profile(first), None, None, "резервный поиск в тексте", "low",
                 F.slice(handles, 2, F.greatest(F.size(handles) - 1, F.lit(0)))),
    ).when(
        text.rlike(FORM),
        _contact("4", "form", F.regexp_extract(text, FORM, 0), F.regexp_extract(text, FORM, 0),
                 "Требуется заполнение формы", None, "ссылка на форму", "low"),
    )
    level_3 = F.when(
        sender_id.isNotNull() & (sender_id != 0),
        _contact("3", "sender_id", sender_id, F.concat(F.lit("tg://user?id="), sender_id), None, None,
                 "ID отправителя", "medium"),
    )
    none = _contact("none", "not_found", None, None, None, None, "не найдено", "none")
    return F.coalesce(level_0, level_1a, *named, private, level_1d, level_2, level_4, level_3, none)


def _follows(text: Column, handle: Column, phrase: str) -> Column:
    """Whether ``phrase`` comes right after this handle anywhere in the text."""
    candidates = extract_all(text, rf"{RE}(@\w+)\s+{phrase}", 1)
    return F.exists(candidates, lambda c: F.lower(c) == F.lower(handle))


def niche(text: Column) -> Column:
    """struct(found, name, keywords, confidence, pattern, extracted): a named niche, else one by context."""
    low = F.lower(text)
    pattern_kind = F.when(F.lit(False), F.lit(None).cast("string"))
    raw = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, kind in NICHE_PATTERNS:
        hit = low.rlike(RE + pattern)
        pattern_kind = pattern_kind.when(hit, kind)
        raw = raw.when(hit, F.regexp_extract(low, RE + pattern, 1))
    strip = f"^[{SPACE}]+|[{SPACE}]+$"
    extracted = F.regexp_replace(F.regexp_replace(raw, strip, ""), r"(?U)\s+(и|или|,)\s+.*$", "")

    def known(source: Column) -> Column:
        hits = [
            F.struct(
                F.size(words).alias("score"),
                F.lit(-i).alias("first"),
                F.lit(name).alias("name"),
                words.alias("keywords"),
            )
            for i, (name, cues) in enumerate(KNOWN_NICHES.items())
            for words in [F.filter(F.array(*map(F.lit, cues)), lambda k: F.contains(source, k))]
        ]
        return F.sort_array(F.array(*hits), asc=False)[0]

    in_name, in_text = let(F.coalesce(extracted, F.lit("")), known), let(low, known)
    empty = F.array().cast("array<string>")

    def result(found, name, words, confidence, kind, part):
        return F.struct(
            F.lit(found).alias("found"),
            name.alias("name"),
            words.alias("keywords"),
            F.lit(confidence).alias("confidence"),
            kind.alias("pattern"),
            part.alias("extracted"),
        )

    null = F.lit(None).cast("string")
    return (
        F.when(extracted.isNotNull() & (in_name["score"] > 0),
               result(True, in_name["name"], in_name["keywords"], "high", pattern_kind, extracted))
        .when(extracted.isNotNull(),
              result(True, F.regexp_replace(extracted, strip, ""), empty, "medium", pattern_kind, extracted))
        .when(in_text["score"] > 0,
              result(True, in_text["name"], in_text["keywords"], "medium", F.lit("context_matching"), null))
        .otherwise(result(False, null, empty, "none", null, null))
    )


def hybrid(text: Column, strict: bool = False) -> Column:
    """Budget, deadline and contact of a text.

    A budget word near a thousand amount counts as the confident reading.  There the original returns no
    contact and no deadline (``strict=True``); the default keeps them.
    """
    low = F.lower(text)
    thousand = r"(\d+)\s*(?:тыс|к|k)"
    confident = F.contains(low, F.lit("бюджет")) & low.rlike(thousand)
    amount = F.regexp_extract(low, thousand, 1).try_cast("long") * 1000
    spans = contact_spans(text)
    urgency = numbers.entity_urgency(text)
    plain = numbers.entity_budget(text)
    quiet = confident if strict else F.lit(False)
    return F.struct(
        F.when(confident, amount).otherwise(plain["min"]).alias("budget_min"),
        F.when(confident, F.lit(0) if strict else amount).otherwise(plain["max"]).alias("budget_max"),
        F.when(~quiet, urgency).alias("urgency"),
        (~quiet & spans["has_contact"]).alias("has_contact"),
        F.when(confident, "named_amount").otherwise("pattern").alias("method"),
    )
