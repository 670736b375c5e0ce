"""Many literal patterns in one pass over a text.

The patterns form an automaton that reads each character once, whatever their number; of each pattern the first place is
kept.  The automaton is built once in a worker and kept for later batches.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Bytes of patterns that travel with the tasks at a time; more take further passes.
PART_BYTES = 8_000_000
#: Automata that a worker keeps.
KEPT = 4

_made: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, words: list[str]) -> ahocorasick.Automaton:
    if key not in _made:
        while len(_made) >= KEPT:
            del _made[next(iter(_made))]
        made = ahocorasick.Automaton()
        for number, word in enumerate(words):
            if word:
                made.add_word(word, number)
        if len(made):
            made.make_automaton()
        _made[key] = made
    return _made[key]


def _key(words: list[str]) -> str:
    return hashlib.sha256("\0".join(words).encode()).hexdigest()


def first_places(made: ahocorasick.Automaton, words: list[str], text: str) -> dict[int, int]:
    """Number of each word that the text holds -> its first place, counted from 1; the empty word is at 1."""
    found = {number: 1 for number, word in enumerate(words) if not word} if len(made) < len(words) else {}
    if len(made):
        for end, number in made.iter(text):
            if number not in found:
                found[number] = end - len(words[number]) + 2
    return found


def labelled_hits(entries: list[tuple[int, str]], cues: Sequence[str] = (), reach: int = 80):
    """Arrow function text -> array of ``(label, word, at, near)``: the words that a text holds, under each label that lists them
    (as often as it does), in the order of ``entries`` (label, word); null for a null text.  ``near``: a cue lies within
    ``reach`` characters before or after the first place of the word."""
    words = list(dict.fromkeys([*(w for _, w in entries), *cues]))
    number = {w: i for i, w in enumerate(words)}
    listed: list[list[int]] = [[] for _ in words]
    for place, (_, w) in enumerate(entries):
        listed[number[w]].append(place)
    lengths = {number[c]: len(c) for c in cues}
    always = "" in cues
    key = _key(words)
    result = ArrayType(StructType([
        StructField("label", IntegerType()), StructField("word", StringType()), StructField("at", IntegerType()), StructField("near", BooleanType()),
    ]))

    def places(made, text):
        """First places of the words, and all places (from, up to) of the cues."""
        first = {number[""]: 1} if "" in number else {}
        spans = []
        if len(made):
            for end, n in made.iter(text):
                if n in lengths:
                    spans.append((end - lengths[n] + 2, end + 2))
                if n not in first:
                    first[n] = end - len(words[n]) + 2
        return first, sorted(spans)

    @F.pandas_udf(result)
    def hits(texts: pd.Series) -> pd.Series:
        made = _automaton(key, words)

        def near(spans, at, size):
            i, last = bisect_left(spans, (at - reach,)), at + size + reach
            while i < len(spans) and spans[i][0] < last:
                if spans[i][1] <= last:
                    return True
                i += 1
            return always

        def one(text):
            if text is None:
                return None
            first, spans = places(made, text)
            found = sorted((place, at) for n, at in first.items() for place in listed[n])
            return [(*entries[place], at, near(spans, at, len(entries[place][1]))) for place, at in found]

        return texts.map(one)

    return hits


def multi_match(df: DataFrame, ident: str, text: str, rules: DataFrame, rule: str, pattern: str) -> DataFrame:
    """``ident, rule, at`` for every rule whose pattern the text of a row holds, with its first place.

    The rule table may be of any size: it is taken in parts of about PART_BYTES, with one pass over the texts for each.
    Rules of equal patterns share the pattern; null patterns match nothing.
    """
    rules = rules.select(F.col(rule), F.col(pattern).cast("string").alias("_pattern")).where("_pattern is not null")
    distinct = rules.select("_pattern").distinct()
    size = distinct.agg(F.sum(F.octet_length("_pattern") + 1)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    kind = dict(df.dtypes)[ident]
    rows = df.select(ident, F.col(text).cast("string").alias("_text")).where("_text is not null")
    found = None
    for part in range(parts):
        words = sorted(r[0] for r in distinct.where(F.pmod(F.xxhash64("_pattern"), F.lit(parts)) == part).collect())
        hits = _hits_of(rows, ident, kind, words)
        found = hits if found is None else found.union(hits)
    return found.join(rules, "_pattern").select(ident, rule, "at")


def _hits_of(rows: DataFrame, ident: str, kind: str, words: list[str]) -> DataFrame:
    key = _key(words)

    def run(batches):
        made = _automaton(key, words)
        for batch in batches:
            ids, found, places = [], [], []
            for row_id, text in zip(batch[ident], batch["_text"]):
                for number, at in first_places(made, words, text).items():
                    ids.append(row_id)
                    found.append(words[number])
                    places.append(at)
            yield pd.DataFrame({ident: pd.Series(ids, dtype=batch[ident].dtype), "_pattern": pd.Series(found, dtype=object), "at": pd.Series(places, dtype="int32")})

    return rows.mapInPandas(run, f"`{ident}` {kind}, _pattern string, at int")
