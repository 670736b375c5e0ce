"""Patterns are tried only where a literal that they need was found: with the same results as trying all."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siftline.functions import literals
from siftline.operators import scorer
from siftline.plans import rules
from siftline.plans.rules import PATTERN_EXAMPLES


@pytest.mark.parametrize(
    "pattern, words",
    [
        (r"\bнуж(?:ен|на)\b", {"нуж"}),
        (r"(?:seo|сео)[- ]?спец", {"спец"}),
        (r"ab|cde", {"ab", "cde"}),
        (r"(?:срочно\s+)?ищу", {"ищу"}),
        (r"(?i)вакансия", set()),
        (r"\w+\d", set()),
        (r"x(?:yz)*", set()),
        (r"(?<!не )автор", {"автор"}),
    ],
)
def test_needed(pattern, words):
    assert set(literals.needed(pattern)) == words


def test_same_as_every_pattern_alone(spark):
    lex = scorer.ScorerLexicon()
    rows = [(i, t.lower()) for i, t in enumerate([*PATTERN_EXAMPLES, "", "ничего такого", "📌 x"])] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    low = F.col("text")
    every = [p for _, _, ps in lex.specialisations for p in ps]
    for patterns in (lex.spam, lex.offer, lex.demand, lex.locations, every):
        alone = df.select("id", *[F.coalesce(low.rlike(scorer._flags(p) + p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
        want = {r["id"]: [p for i, p in enumerate(patterns) if r[f"p{i}"]] for r in alone}
        found = df.select("id", scorer.matched(low, patterns).alias("m"), scorer.any_pattern(low, patterns).alias("a"), scorer.first_match(low, patterns).alias("f"))
        for r in found.collect():
            assert r["m"] == want[r["id"]]
            assert r["a"] == bool(want[r["id"]])
            assert (r["f"] is not None) == bool(want[r["id"]])


def test_patterns_are_not_all_tried():
    """Before, each pattern of a class was tried on every text."""
    lex = scorer.ScorerLexicon()
    every = [p for _, _, ps in lex.specialisations for p in ps]
    assert all(scorer._needed(p) for p in every)
    for p in every:
        for text in PATTERN_EXAMPLES:
            if re.search(re.sub(r"^\(\?U\)", "", p), text.lower()):
                assert any(w in text.lower() for w in scorer._needed(p))


def test_exclusions_tell_excluded_specialisations(spark):
    """Before, the query left the excluded specialisations out."""
    rows = [(i, status, f"{rank}-X", 1000.0) for i, (status, rank) in enumerate((s, r) for s in "FOP" for r in "1234")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double")
    found = {r["o_orderkey"] for r in rules.scorer_exclusions(SimpleNamespace(orders=orders)).where("excluded_specialisation").collect()}
    assert found == {7}  # the message that asks for an smm manager
