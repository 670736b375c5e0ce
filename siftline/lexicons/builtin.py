"""The two built-in lexicons: Russian (the default) and Latin (for English, French, German and Spanish text)."""

from __future__ import annotations

from siftline.lexicons import ru, topics
from siftline.lexicons.model import Lexicon, ScoreGroup

# Urgency and quality cues of the priority.
URGENT = ["срочно", "быстро", "сегодня", "завтра", "asap"]
QUALITY = ["техническое задание", "тз", "бриф", "детали", "скайп", "zoom", "созвон", "встреча"]

RUSSIAN = Lexicon(
    domains=ru.BLOCKED_DOMAINS,
    bots=ru.BLOCKED_BOTS,
    scam_patterns=ru.SCAM_PATTERNS,
    scam_words=ru.SCAM_WORDS,
    irrelevant=ru.IRRELEVANT_TOPICS,
    bot_names=ru.BOT_NAME_PATTERNS,
    groups=[
        ScoreGroup("client_strong", 3, ru.CLIENT_STRONG, regex=True),
        ScoreGroup("client_medium", 2, ru.CLIENT_MEDIUM),
        ScoreGroup("client_weak", 1, ru.CLIENT_WEAK),
        ScoreGroup("seller_strong", -4, ru.SELLER_STRONG, regex=True),
        ScoreGroup("seller_medium", -3, ru.SELLER_MEDIUM),
        ScoreGroup("seller_weak", -2, ru.SELLER_WEAK),
        ScoreGroup("spam_strong", -5, ru.SPAM_STRONG, label="SPAM - "),
        ScoreGroup("spam_medium", -3, ru.SPAM_MEDIUM, label="SPAM_MED - "),
        ScoreGroup("quality_indicators", 2, ru.QUALITY_INDICATORS, label="QUALITY - "),
    ],
    repeated_spam=ru.SPAM_STRONG,
    sources_high=ru.SOURCES_HIGH,
    sources_low=ru.SOURCES_LOW,
    sources_blocked=ru.SOURCES_BLACKLIST,
    topics_core=ru.TOPICS_CORE,
    topics_secondary=ru.TOPICS_SECONDARY,
    topics_irrelevant=ru.TOPICS_IRRELEVANT,
    urgent=URGENT,
    quality=QUALITY,
    directions=topics.DIRECTION_KEYWORDS,
    negations=ru.NEGATION_TEMPLATES,
    request_cues=ru.REQUEST_CUES,
)

LATIN = Lexicon(
    domains=["mail1.example.com", "mail2.example.com"],
    bots=["@mail3"],
    scam_patterns=[r"token[s]?\s*[=:]", r"apache\s+license"],
    scam_words=["worthless"],
    irrelevant=["disgusting", "idiot"],
    custom=["mit license"],
    bot_names=[r"(?i)mail[4-6]"],
    groups=[
        ScoreGroup("client_strong", 3, [r"\sis the\s", r"\sund die\s", r"\sde la\s"], regex=True),
        ScoreGroup("client_medium", 2, ["threat", "free ", " that the "]),
        ScoreGroup("client_weak", 1, [" of the ", " ou ", " der "]),
        ScoreGroup("seller_strong", -4, [r"scum[\s,.]", r"path?etic"], regex=True),
        ScoreGroup("seller_medium", -3, ["!!", " for the "]),
        ScoreGroup("seller_weak", -2, ["***", " with "]),
        ScoreGroup("spam_strong", -5, ["###", "&&&"], label="SPAM - "),
        ScoreGroup("spam_medium", -3, ["%%%", " an "], label="SPAM_MED - "),
        ScoreGroup("quality_indicators", 2, ["hetition", "thintion", "ungen"], label="QUALITY - "),
    ],
    repeated_spam=["###", "&&&", "%%%"],
    sources_high=["src1", "src2"],
    sources_low=["src3"],
    sources_blocked=["src19"],
    topics_core=["law", "german"],
    topics_secondary=["french"],
    topics_irrelevant=["spanish", "Unknown"],
    urgent=["threat", "oning the"],
    quality=["hetition", "thintion", "license", "ungen"],
    directions={
        "law": ["license", "licensed", "copyright"],
        "german": ["und", "nicht", "der"],
        "french": ["les", "une", "avec"],
        "spanish": ["ción", "los", "para"],
    },
    negations=[r"the\s+{kw}", r"in\s+{kw}", r"{kw}\s+(?:is|la)"],
    request_cues=["with ", "pour ", "mit ", "con "],
)
