"""Token counts by section: whole documents are encoded once, and tokens are attributed by their character spans.

Encoding section by section gives other tokens than the document has.  So each document is encoded as a whole, the
tokens' spans follow from their byte lengths, and a sorted interval join places them in the sections.  A token that
crosses a border goes, by ``rule``, to the section of its first character ("first"), of its last one ("last"), or to
the section that holds most of its characters, the earlier one of equals ("most").
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.blocks import id_and_text, map_blocks
from siftline.llm.ranks import parse, ranks_encoding, read_ranks

RULES = ("first", "last", "most")
#: White space as the pattern knows it, so much that it is encoded apart.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=2)
def _vocabulary(payload: bytes):
    ranks = parse(payload)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return ranks_encoding(payload), sizes


def character_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token; a part of a character counts as that character."""
    end = np.cumsum(sizes[ids])
    if text.isascii():
        return end - sizes[ids], end
    raw = np.frombuffer(text.encode(), np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
    return number[end - sizes[ids]] - 1, number[end - 1]


def line_starts(text: str) -> np.ndarray:
    """Where lines start; a line holds its line break, and a text always has a first line."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(text)]))


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a border; ``first``/``last``: the tokens' outer characters."""
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    home = a if rule == "first" else b
    if rule == "most":
        home = a.copy()
        for t in np.flatnonzero(a != b):
            edges = np.concatenate(([first[t]], starts[a[t] + 1 : b[t] + 1], [last[t] + 1]))
            home[t] = a[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(home, minlength=len(starts)), int((a != b).sum())


def encode(encoding, text: str) -> list[int]:
    """Ids of a text.  A long run of white space, on which the pattern engine would overflow, is one piece of the pattern, but
    for its last character where a word follows; it is encoded without the pattern."""
    ids, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += encoding.encode_ordinary(text[at : m.start()])
        ids += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def count(text: str, payload: bytes, rule: str = "first") -> tuple[np.ndarray, np.ndarray, int]:
    """Token ids, tokens of each line, and the number of tokens that cross lines."""
    encoding, sizes = _vocabulary(payload)
    ids = np.array(encode(encoding, text), np.int64)
    first, end = character_spans(text, ids, sizes)
    return ids, *attribute(first, end - 1, line_starts(text), rule)


SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, most_tokens long, section_tokens array<int>, ids_sha256 string"


def by_section(docs: DataFrame, path: str | None = None, *, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens, lines, tokens that cross lines, the largest line's tokens, tokens of each line, digest of the ids.

    Null and empty texts have one line without tokens.  Repeated rows stay; an empty table gives no rows; other columns
    are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    payload = read_ranks(path)

    def work(block: pa.RecordBatch) -> dict:
        made = [count(t, payload, rule) for t in block.column("text").to_pylist()]
        return {
            "doc_id": block.column("doc_id"),
            "n_tokens": pa.array([len(ids) for ids, _, _ in made], pa.int64()),
            "n_sections": pa.array([len(n) for _, n, _ in made], pa.int64()),
            "n_crossing": pa.array([c for _, _, c in made], pa.int64()),
            "most_tokens": pa.array([int(n.max()) for _, n, _ in made], pa.int64()),
            "section_tokens": pa.array([n.tolist() for _, n, _ in made], pa.list_(pa.int32())),
            "ids_sha256": [hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest() for ids, _, _ in made],
        }

    return map_blocks(id_and_text(docs, id_col, text_col), work, SCHEMA)
