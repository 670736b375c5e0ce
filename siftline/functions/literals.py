"""Literals that a match cannot do without, found in one pass over a text.

Testing hundreds of patterns on every text costs far more than finding the few that can match at all.  ``needed`` reads from a
pattern a set of literals of which each of its matches holds one; ``possible`` tells which patterns a text leaves possible.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

try:
    from re import _constants as _c, _parser
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _parser


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of the pattern holds at least one; none if the pattern does not say, or ignores case."""
    try:
        parsed = _parser.parse(re.sub(r"^\(\?[sU]+\)", "", pattern))
    except (re.error, OverflowError):
        return ()
    if parsed.state.flags & re.IGNORECASE:
        return ()
    found = _of(parsed)
    return tuple(sorted(found)) if found and min(map(len, found)) >= 2 else ()


def _of(parsed) -> frozenset[str] | None:
    offers, run = [], []

    def close():
        if run:
            offers.append(frozenset(["".join(run)]))
            run.clear()

    for op, value in parsed:
        if op is _c.LITERAL:
            run.append(chr(value))
            continue
        close()
        if op is _c.SUBPATTERN:
            _, on, _, inner = value
            offers.append(None if on & re.IGNORECASE else _of(inner))
        elif op is _c.BRANCH:
            ways = [_of(way) for way in value[1]]
            offers.append(frozenset().union(*ways) if all(ways) else None)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and value[0] >= 1:
            offers.append(_of(value[2]))
        elif op is _c.ATOMIC_GROUP:
            offers.append(_of(value))
    close()
    known = [o for o in offers if o]
    return max(known, key=lambda o: (min(min(map(len, o)), 6), -len(o), min(map(len, o)))) if known else None


#: Bits of a number that are used.
WIDTH = 62


def possible(text: Column, needs: Sequence[Sequence[str]]) -> Column:
    """Numbers whose bits tell which entries of ``needs`` (literals, of which the text has to hold one; none: always) are met,
    WIDTH to a number; found in one pass over a text by an automaton.  Null for a null text."""
    always, of_word = 0, {}
    for i, words in enumerate(needs):
        if not words:
            always |= 1 << i
        for word in words:
            if word:
                of_word[word] = of_word.get(word, 0) | 1 << i
            else:
                always |= 1 << i
    numbers = max(1, -(-len(needs) // WIDTH))
    made = []  # the automaton of a worker

    @F.pandas_udf(ArrayType(LongType()))
    def bits(texts: pd.Series) -> pd.Series:
        if not made:
            found = ahocorasick.Automaton()
            for word, mask in of_word.items():
                found.add_word(word, mask)
            if of_word:
                found.make_automaton()
            made.append(found)
        search = made[0].iter if of_word else lambda text: ()

        def one(text):
            if text is None:
                return None
            mask = always
            for _, more in search(text):
                mask |= more
            return [mask >> shift & (1 << WIDTH) - 1 for shift in range(0, numbers * WIDTH, WIDTH)]

        return pd.Series([one(text) for text in texts], dtype=object)

    return bits(text)


def may(found: Column, places: Sequence[int]) -> Column:
    """Whether ``found``, which is ``possible``, has the bit of one of the entries."""
    masks: dict[int, int] = {}
    for i in places:
        masks[i // WIDTH] = masks.get(i // WIDTH, 0) | 1 << i % WIDTH
    return reduce(lambda a, b: a | b, [F.get(found, F.lit(n)).bitwiseAND(F.lit(mask)) != 0 for n, mask in masks.items()])
