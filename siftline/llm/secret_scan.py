"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learned from text spends few tokens on text and many on random strings.  A long run of characters that
credentials are made of is reported if it needs more than one token for every LEAST characters, unless it is a known
digest or an identifier, a name whose words are themselves cheap in tokens: such strings are random or long without being
secret.  Of a run that passes as a whole, the pieces between marks are tested too, so a readable part hides no random one.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.blocks import id_and_text, map_blocks
from siftline.llm.covered import Covered
from siftline.llm.ranks import read_ranks, ranks_encoding

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMED = ("password", "passwd", "secret", "token", "api")
# runs of these classes are matched whole, so asking for the length inside the pattern finds the same runs
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{16,}")
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Letters, digits and marks of a run, each part once; a number in a name has four digits at most, or is a date of eight.
PART = re.compile("([A-Z]?[a-z]+|[A-Z]+)|([0-9]+)|[/_+=-]+")
#: Marks at which a run is taken apart, in this order.
MARKS = ("=", "/", "_+-")
NUMBER = re.compile("[0-9/_+=-]+")
#: Characters for each token that text reaches and random strings don't.
LEAST = 2.0
#: Letters for each token that the words of a name reach, each word taken by itself; short pieces of random strings reach more than LEAST.
NAME_LEAST = 2.5

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lowered = text.lower()
    if any(n in lowered for n in NAMED):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def is_fixed(run: str) -> bool:
    """Digests, UUIDs and numbers."""
    return bool(NUMBER.fullmatch(run) or UUID.fullmatch(run) or len(run) in DIGESTS and re.fullmatch("[0-9a-fA-F]+", run))


def word_tokens(word: str, encode) -> int:
    """Tokens of a word in its cheapest spelling."""
    return min(len(encode(w)) for w in (word, word.lower(), " " + word.lower()))


def is_identifier(run: str, encode) -> bool:
    """Words of letters, in any one case or with a capital first, with marks and short numbers between; the words are of
    some length (random strings change class every other character) and cheap in tokens."""
    parts = [m for m in PART.finditer(run)]
    words = [m[1] for m in parts if m[1]]
    if not words or len(run) < 4 * len(words) or any(m[2] and len(m[2]) > 4 and len(m[2]) != 8 for m in parts):
        return False
    return sum(map(len, words)) >= NAME_LEAST * sum(word_tokens(w, encode) for w in words)


def is_known(run: str, encode) -> bool:
    """Digests, UUIDs, numbers and identifiers."""
    return is_fixed(run) or is_identifier(run, encode)


@lru_cache(maxsize=2)
def _encoding(payload: bytes):
    return ranks_encoding(payload)


def _is_random(run: str, encode, least: float) -> bool:
    return len(run) >= 16 and len(run) < least * len(encode(run)) and not is_known(run, encode)


def _pieces(run: str, start: int, encode, taken: Covered, least: float, level: int = 0) -> list[tuple[int, int]]:
    """Where ``run`` is random: as a whole, or else in pieces between marks, neighbours that are no names together first."""
    if len(run) < 16 or is_fixed(run):
        return []
    if not taken.meets(start, start + len(run)) and _is_random(run, encode, least):
        return [(start, start + len(run))]
    for at in range(level, len(MARKS)):
        cuts = [(m.start(), m.end()) for m in re.finditer(f"[^{MARKS[at]}]+", run)]
        if len(cuts) == 1 and cuts[0] == (0, len(run)) or not any(b - a < len(run) for a, b in cuts):
            continue
        groups: list[tuple[int, int]] = []
        joined = False
        for a, b in cuts:
            if is_known(run[a:b], encode):
                joined = False
            elif joined:
                groups[-1] = (groups[-1][0], b)
            else:
                groups.append((a, b))
                joined = True
        whole = groups == [(cuts[0][0], cuts[-1][1])]
        # names are looked into further, since cheap words can stand beside a random one
        next_ones = [(c, at + 1) for c in cuts] if whole else [(g, at) for g in groups] + [(c, at + 1) for c in cuts if is_known(run[slice(*c)], encode)]
        return [s for (a, b), deeper in next_ones for s in _pieces(run[a:b], start + a, encode, taken, least, deeper)]
    return []


def random_spans(text: str, encode, taken: list[Span], least: float = LEAST) -> list[Span]:
    out, covered = [], Covered(taken)
    for m in CANDIDATE.finditer(text):
        run = m[0].strip("=-/_+") if m[0][0] in "=-/_+" else m[0]
        start = m.start() + m[0].find(run) if run else m.start()
        out += [("random", a, b) for a, b in sorted(_pieces(run, start, encode, covered, least))]
    return out


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def find(docs: DataFrame, path: str | None = None, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of spans by kind, the digest of the patterns' spans, and all spans as ``kind:start:end``.

    Offsets are code points, ends exclusive; spans are in order of start, then of KINDS.  Spans of the test overlap none
    of the patterns'.  Null and empty texts have no spans.  Repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """
    payload = read_ranks(path)

    def work(block: pa.RecordBatch) -> dict:
        encode = _encoding(payload).encode_ordinary
        texts = block.column("text").to_pylist()
        base = [base_spans(t) for t in texts]
        more = [random_spans(t, encode, b, least) for t, b in zip(texts, base)]
        counts = {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]}
        return {
            "doc_id": block.column("doc_id"),
            **counts,
            "n_random": pa.array([len(m) for m in more], pa.int64()),
            "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base],
            "spans": [written(b + m) for b, m in zip(base, more)],
        }

    return map_blocks(id_and_text(docs, id_col, text_col), work, SCHEMA)
