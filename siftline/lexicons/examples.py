"""Texts that patterns match, made from the patterns themselves."""

from __future__ import annotations

import re


def example(pattern: str) -> str:
    """A short text that the pattern matches: first alternatives, least repetitions, first characters of a class."""
    return _text(re._parser.parse(pattern))


def _text(parsed) -> str:
    out = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "IN":
            out.append(_member(value))
        elif name == "ANY":
            out.append("x")
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, _, inner = value
            out.append(_text(inner) * least)
        elif name == "SUBPATTERN":
            out.append(_text(value[-1]))
        elif name == "BRANCH":
            out.append(_text(value[1][0]))
    return "".join(out)


def _member(members) -> str:
    for kind, value in members:
        name = str(kind)
        if name == "LITERAL":
            return chr(value)
        if name == "RANGE":
            return chr(value[0])
        if name == "CATEGORY":
            return {"CATEGORY_DIGIT": "1", "CATEGORY_SPACE": " ", "CATEGORY_WORD": "а"}.get(str(value), "")
    return ""
