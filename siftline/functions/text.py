"""Normalisation, structural features and keys of a text, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes that mean the same in Java and RE2 and equal Unicode "word" and "white space".
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"

# Look-alike characters and the Cyrillic letter each is read as.
LOOKALIKES = {
    "ⲁ": "а", "ꭺ": "а", "ɑ": "а",
    "ⲃ": "в", "ᵥ": "в",
    "ⲥ": "с", "ϲ": "с", "ѕ": "с",
    "ⲉ": "е", "ё": "е",
    "ⲕ": "к", "κ": "к",
    "ⲙ": "м",
    "ⲛ": "н",
    "ⲟ": "о",
    "ⲣ": "р", "ρ": "р",
    "ⲧ": "т",
    "ⲩ": "у",
    "ⲭ": "х", "χ": "х",
    "ⲱ": "ш",
    "ʜ": "н",
    "ᴀ": "а", "ᴄ": "с", "ᴇ": "е", "ᴋ": "к",
    "ᴍ": "м", "ɴ": "н", "ᴏ": "о", "ᴘ": "р",
    "ᴛ": "т", "ᴜ": "у", "ᴠ": "в",
}

# Latin and Greek letters folded to Cyrillic, position by position.
FOLD_FROM = "abehkmopctyxABEHKMOPCTYXαβεηκμοπρτυχΑΒΕΗΚΜΟΠΡΤΥΧ"
FOLD_TO = "авенкморстухАВЕНКМОРСТУХавенкмопртухАВЕНКМОПРТУХ"

# Words without content.
STOP_WORDS = ["и", "в", "на", "с", "по", "для", "как", "а", "от", "до"]

# Currency marks of a budget mention, and the emoji blocks that are counted.
CURRENCY = r"₽|руб|rub|\$|usd|евро|eur"
EMOJI_BLOCKS = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)

URL = r"https?://[a-z$-_!]+"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return texts.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


# Characters that canonical composition leaves alone when no other ones are around.
COMPOSED = r"\x00-\x{2FF}\x{400}-\x{481}\x{48A}-\x{52F}\x{2002}-\x{206F}\x{20A0}-\x{20BF}\x{2190}-\x{21FF}\x{1F000}-\x{1FAFF}"


# Characters beyond Latin-1: one range test, much cheaper than the others.
WIDE = r"[^\x00-\xFF]"


def compose(text: Column) -> Column:
    """NFC.  Only texts that may change are sent to Python; the others pass as nulls."""
    return F.coalesce(nfc(F.when(text.rlike(WIDE) & text.rlike(f"[^{COMPOSED}]"), text)), text)


def fold_lookalikes(text: Column) -> Column:
    folded = F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))
    # no look-alike is a Latin-1 character; one range test is much cheaper than the mapping
    return F.when(text.rlike(WIDE), folded).otherwise(text)


def normalize_unicode(text: Column) -> Column:
    return fold_lookalikes(compose(text))


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside array lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df, keep: list[str], columns: list[Column]):
    """Select ``keep`` and ``columns`` so that the columns are computed once per row.

    A filter on a computed column is otherwise moved below the projections it came from, and long chains
    of them are then substituted into each other.  A one-row generator holds it above.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def urls(text: Column) -> Column:
    return extract_all(text, URL)


def domains(url_list: Column) -> Column:
    return F.transform(url_list, lambda u: F.regexp_extract(u, r"^https?://([^/?#]*)", 1))


def emoji_runs(text: Column) -> Column:
    runs = F.regexp_count(text, F.lit(f"[{EMOJI_BLOCKS}]+"))
    return F.when(text.rlike(r"[\x{24C2}-\x{10FFFF}]"), runs).otherwise(F.when(text.isNotNull(), 0))


def hashtags(lowered: Column) -> Column:
    return extract_all(lowered, f"#[{WORD}]+")


def mentions(text: Column) -> Column:
    return extract_all(text, f"@[{WORD}]+")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{WORD}{SPACE}]", "")


def words(lowered: Column) -> Column:
    return extract_all(strip_punctuation(lowered), f"[^{SPACE}]+")


def word_count(lowered: Column) -> Column:
    """Words after punctuation is removed: runs of non-space from their first word character on."""
    return F.regexp_count(lowered, F.lit(f"[a-z0-9{WORD}][!-~]*+[^{SPACE}]*"))  # one range takes most characters of most words


def density(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def caps_ratio(text: Column) -> Column:
    return density(F.regexp_count(text, F.lit(r"\p{Lu}")), F.length(text))


def budget_values(lowered: Column) -> Column:
    """First digit run of each amount with a currency mark."""
    return F.transform(
        extract_all(lowered, rf"(\d+)[{SPACE}]*(?:{CURRENCY})", 1), lambda n: n.try_cast("long")
    )


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v.cast("double"), F.lit(0.0)))
    return density(total, F.size(values))


def text_hash(text: Column) -> Column:
    """Identity of a message: case and white space do not count."""
    return F.md5(F.regexp_replace(F.lower(text), f"[{SPACE}]+", ""))


def dedup_fingerprint(text: Column, strict: bool = False) -> Column:
    """Hash of the text without emoji and with single spaces; ``strict`` reads its first 200 characters only."""
    flat = F.regexp_replace(F.lower(text), r"[\x{10000}-\x{10FFFF}]", "")
    flat = F.trim(F.regexp_replace(flat, f"[{SPACE}]+", " "))
    return F.md5(F.substring(flat, 1, 200) if strict else flat)


def cache_key(prompt: Column, text: Column, strict: bool = False) -> Column:
    """Hash of prompt and text; ``strict`` reads their first 200 and 500 characters only."""
    return F.md5(F.concat_ws("||", F.substring(prompt, 1, 200), F.substring(text, 1, 500)) if strict else F.concat_ws("||", prompt, text))


def clean_text(text: Column) -> Column:
    return F.regexp_replace(strip_punctuation(F.lower(text)), f"^[{SPACE}]+|[{SPACE}]+$", "")


def keywords(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    tokens = extract_all(clean_text(text), f"[^{SPACE}]+")
    return F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def features(df, text: str = "text"):
    """Add the structural features a cascade reads.

    The normalised text and its lower case are computed once: beside Python functions, the planner would otherwise put their
    expressions into each of the features that reads them.
    """
    columns = [c for c in df.columns if c not in ("norm", "lowered")]
    df = df.withColumn("_composed", compose(F.col(text)))
    df = computed_once(df, columns, [fold_lookalikes(F.col("_composed")).alias("norm")])
    df = computed_once(df, [*columns, "norm"], [F.lower("norm").alias("lowered")])
    lowered = F.col("lowered")
    return (
        df.withColumn("folded", fold_homoglyphs(lowered))
        .withColumn("refolded", fold_lookalikes(lowered))
        .withColumn("word_count", word_count(lowered))
        .withColumn("emoji_density", density(emoji_runs(F.col("norm")), F.col("word_count")))
        .withColumn("hashtags", hashtags(lowered))
        .withColumn("mentions", mentions(F.col("norm")))
        .withColumn("avg_budget", array_mean(budget_values(lowered)))
    )
