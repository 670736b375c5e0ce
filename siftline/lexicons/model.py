"""Shape of a rule lexicon.  Lexicons are data: build one in code, or load it from a rule table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ScoreGroup:
    """Weighted cues; ``regex`` groups count every match, word groups count each word once."""

    name: str
    weight: int
    entries: Sequence[str]
    regex: bool = False
    label: str = ""


@dataclass(frozen=True)
class Lexicon:
    domains: Sequence[str] = ()
    bots: Sequence[str] = ()
    scam_patterns: Sequence[str] = ()
    scam_words: Sequence[str] = ()
    irrelevant: Sequence[str] = ()
    custom: Sequence[str] = ()
    bot_names: Sequence[str] = ()
    groups: Sequence[ScoreGroup] = ()
    repeated_spam: Sequence[str] = ()
    sources_high: Sequence[str] = ()
    sources_low: Sequence[str] = ()
    sources_blocked: Sequence[str] = ()
    topics_core: Sequence[str] = ()
    topics_secondary: Sequence[str] = ()
    topics_irrelevant: Sequence[str] = ()
    urgent: Sequence[str] = ()
    quality: Sequence[str] = ()
    directions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    negations: Sequence[str] = ()
    request_cues: Sequence[str] = ()


BLOCK_STAGES = ["domains", "bots", "scam_patterns", "scam_words", "irrelevant", "custom", "bot_names"]

RULE_SCHEMA = (
    "rule_id STRING, stage STRING, `group` STRING, kind STRING, pattern STRING, weight DOUBLE, counts STRING, "
    "label STRING, ordinal INT, enabled BOOLEAN"
)


def to_rule_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """The lexicon as rows, for storage, editing and merging."""
    rows = []

    def add(stage, group, kind, pattern, weight, counts, label, ordinal):
        rows.append((f"{group}:{ordinal}", stage, group, kind, pattern, weight, counts, label, ordinal, True))

    for stage in BLOCK_STAGES:
        kind = "regex" if stage in ("scam_patterns", "bot_names") else "literal"
        for i, pattern in enumerate(getattr(lexicon, stage)):
            add("block", stage, kind, pattern, None, "once", stage, i)
    for group in lexicon.groups:
        for i, pattern in enumerate(group.entries):
            kind, counts = ("regex", "per_match") if group.regex else ("literal", "once")
            add("score", group.name, kind, pattern, float(group.weight), counts, group.label, i)
    for topic, words in lexicon.directions.items():
        for i, word in enumerate(words):
            add("direction", topic, "literal", word, 1.0, "once", topic, i)
    return spark.createDataFrame(rows, RULE_SCHEMA)


def from_rule_table(rules: DataFrame, base: Lexicon) -> Lexicon:
    """Replace block, score and direction rules of ``base`` by the enabled rows of a rule table.

    A rule table is a lexicon of some thousand rows at most; it is checked before it is read.
    """
    from dataclasses import replace

    limit = 100_000
    rows = rules.filter("enabled").orderBy("stage", "group", "ordinal").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a rule table of more than {limit} rows is not a lexicon")
    blocks: dict[str, list[str]] = {stage: [] for stage in BLOCK_STAGES}
    groups: dict[str, list] = {}
    directions: dict[str, list[str]] = {topic: [] for topic in base.directions}
    for row in rows:
        if row["stage"] == "block":
            blocks[row["group"]].append(row["pattern"])
        elif row["stage"] == "score":
            groups.setdefault(row["group"], []).append(row)
        elif row["stage"] == "direction":
            directions.setdefault(row["group"], []).append(row["pattern"])
    order = {g.name: i for i, g in enumerate(base.groups)}
    scored = [
        ScoreGroup(name, int(rs[0]["weight"]), [r["pattern"] for r in rs], rs[0]["kind"] == "regex", rs[0]["label"] or "")
        for name, rs in sorted(groups.items(), key=lambda kv: order.get(kv[0], len(order)))
    ]
    return replace(base, groups=scored, directions={k: v for k, v in directions.items() if v}, **blocks)
