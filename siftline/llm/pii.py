"""Personal data: fixed patterns, and a linear-chain conditional random field for spellings that they miss.

The field labels the tokens around anything with a digit, an ``@`` or an ``(at)``, from features of word shape and of
the neighbouring words.  It is trained from the small labelled table of :mod:`siftline.llm.pii_examples` by gradient
ascent with forward and backward sums in numpy, and decoded by Viterbi over batches of token sequences.  A span it
finds counts if it holds what its kind needs (enough digits, a valid checksum, four parts, a name and a domain) and
overlaps no span of the patterns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.covered import Covered
from siftline.llm.blocks import id_and_text, map_blocks, rewrite_blocks
from siftline.llm.pii_examples import ROWS

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# ---- patterns

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that starts inside a run of digits fails or ends as one from the run's start does
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, leftmost and without overlap inside a kind; matches that fail a check are dropped."""
    found: list[Span] = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                free = m.end()
    if DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _is_ip(m[0].split("."))]
        found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if _is_phone(m[0])]
    return found


# ---- tokens and features

SEED = re.compile(r"[0-9@]\S*|[(\[]at[)\]]\S*")
TOKEN = re.compile(r"\S+")
BEFORE, AFTER = 40, 25
EDGES = "\"'<>,;:!?*#$%&|{}~`=._/"
#: Words that announce personal data.
CUES = frozenset(
    "call phone tel telefon téléphone teléfono numéro mobile cell fax text whatsapp contact number reach "
    "mail e-mail email courriel write send ip host server address login from card visa mastercard amex karte credit paid".split()
)


def _core(token: str) -> tuple[int, int]:
    """The token without punctuation at its edges, as offsets; brackets stay where they close."""
    a, b, closed = 0, len(token), token.rfind(")")
    while a < b and (token[a] in EDGES or token[a] in "[)]" or token[a] == "(" and closed < a):
        a += 1
    opened = {end: at if (at := token.find(start, a)) >= 0 else len(token) for start, end in ("()", "[]")}
    while b > a and (token[b - 1] in EDGES or token[b - 1] in "([" or opened.get(token[b - 1], -1) >= b):
        b -= 1
    return a, b


def shape(token: str) -> str:
    """Digits as 9, letters as x and X, runs of letters shortened to one and of digits to four."""
    out = re.sub("[0-9]", "9", token)
    out = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", out)
    return re.sub(r"9{5,}", "99999", out)[:24]


def _features(tokens: list[str]) -> list[list[str]]:
    shapes, lows = [shape(t) for t in tokens], [t.lower() for t in tokens]
    out = []
    for i, (t, s) in enumerate(zip(tokens, shapes)):
        digits = len(DIGIT.findall(t))
        around = [("cue" if w in CUES else "") for w in (lows[i - 1] if i else "", lows[i - 2] if i > 1 else "")]
        kind = "9" if digits == len(t) and t else "x" if not digits else "m"
        f = ["bias", "shape=" + s, "kind=" + kind, f"digits={min(digits, 20)}", "short=" + re.sub(r"9+", "9", s)]
        f += [f"prev={lows[i - 1]}" if i and around[0] else "prev=" + re.sub(r"9+", "9", shapes[i - 1]) if i else "start"]
        f += [f"prev2={lows[i - 2]}" if around[1] else "", "next=" + re.sub(r"9+", "9", shapes[i + 1]) if i + 1 < len(tokens) else "end"]
        f += ["at" if "@" in t or "(at)" in lows[i] or "[at]" in lows[i] else "", "word=" + lows[i] if lows[i] in CUES else ""]
        f += ["dots=" + str(t.count(".")) if digits else "", "hex" if re.fullmatch("[0-9a-f]{16,}", t) else ""]
        out.append([x for x in f if x])
    return out


# ---- the field


def _labelled(row: str) -> tuple[list[str], list[int]]:
    tokens, labels = [], []
    for part in re.split(r"(\[(?:email|ip|card|phone) .*?\](?=[^\]\w\[]|$))", row):
        marked = re.fullmatch(r"\[(email|ip|card|phone) (.*)\]", part)
        for i, m in enumerate(TOKEN.finditer(marked[2] if marked else part)):
            a, b = _core(m[0])
            if a < b:
                tokens.append(m[0][a:b])
                labels.append(LABELS.index(("I-" if i else "B-") + marked[1]) if marked else 0)
    return tokens, labels


def _allowed() -> np.ndarray:
    """A label inside a span follows one of the same kind only."""
    move = np.zeros((len(LABELS), len(LABELS)))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                move[a, b] = -1e4
    return move


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[str] = ROWS, steps: int = 150, rate: float = 0.15, shrink: float = 0.02) -> dict:
    """``index`` (feature -> row), ``emit`` and ``move`` weights."""
    table = [_labelled(r) for r in rows]
    sequences = [_features(tokens) for tokens, _ in table]
    index = {f: i for i, f in enumerate(sorted({f for s in sequences for fs in s for f in fs}))}
    n, longest, k = len(table), max(len(s) for s in sequences), len(LABELS)
    x = np.zeros((n, longest, len(index)))
    gold, size = np.zeros((n, longest), np.int64), np.array([len(s) for s in sequences])
    for i, (s, (_, labels)) in enumerate(zip(sequences, table)):
        gold[i, : len(s)] = labels
        for t, fs in enumerate(s):
            x[i, t, [index[f] for f in fs]] = 1
    inside = np.arange(longest) < size[:, None]
    start = _allowed()[0]
    p = {"emit": np.zeros((len(index), k)), "move": np.zeros((k, k))}
    first, second = ({name: np.zeros_like(v) for name, v in p.items()} for _ in range(2))
    hot = np.eye(k)[gold] * inside[:, :, None]
    pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    for step in range(1, steps + 1):
        emit, move = x @ p["emit"], p["move"] + _allowed()
        forward, backward = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        forward[:, 0] = emit[:, 0] + start
        for t in range(1, longest):
            here = _logsum(forward[:, t - 1, :, None] + move, 1) + emit[:, t]
            forward[:, t] = np.where(inside[:, t, None], here, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            here = _logsum(move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], here, 0)
        total = _logsum(forward[:, -1], 1)
        mean = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
        both = forward[:, :-1, :, None] + move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(both) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        g = {"emit": np.einsum("ntf,ntk->fk", x, hot - mean) - shrink * p["emit"], "move": pairs - expected - shrink * p["move"]}
        for name in p:
            first[name] += 0.1 * (g[name] - first[name])
            second[name] += 0.01 * (g[name] ** 2 - second[name])
            p[name] += rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return {"index": index, "emit": p["emit"], "move": p["move"] + _allowed()}


def viterbi(model: dict, sequences: list[list[list[str]]]) -> list[np.ndarray]:
    """The best labels of token sequences (of features), decoded in batches of similar length."""
    index, emit, move = model["index"], model["emit"], model["move"]
    start, out = _allowed()[0], [np.zeros(0, np.int64)] * len(sequences)
    order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        batch = []
        while at < len(order) and (not batch or len(sequences[order[at]]) * (len(batch) + 1) <= 20_000):
            batch.append(order[at])
            at += 1
        longest = len(sequences[batch[-1]])
        scores = np.zeros((len(batch), longest, len(LABELS)))
        for b, i in enumerate(batch):
            for t, fs in enumerate(sequences[i]):
                scores[b, t] = emit[[index[f] for f in fs if f in index]].sum(axis=0)
        size = np.array([len(sequences[i]) for i in batch])
        best, back = scores[:, 0] + start, np.zeros(scores.shape, np.int8)
        for t in range(1, longest):
            through = best[:, :, None] + move
            back[:, t] = through.argmax(axis=1)
            best = np.where((t < size)[:, None], through.max(axis=1) + scores[:, t], best)
        label = best.argmax(axis=1)
        path = np.zeros((len(batch), longest), np.int64)
        for t in range(longest - 1, -1, -1):
            path[:, t] = label
            label = np.where((t < size) & (t > 0), back[np.arange(len(batch)), t, label], label)
        for b, i in enumerate(batch):
            out[i] = path[b, : size[b]]
    return out


def _segments(text: str) -> list[tuple[int, int]]:
    """Stretches of text around seeds."""
    out: list[list[int]] = []
    for m in SEED.finditer(text):
        a = m.start()
        floor = out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        if out and a - BEFORE <= out[-1][1]:
            out[-1][1] = max(out[-1][1], m.end() + AFTER)
        else:
            out.append([max(0, a - BEFORE), m.end() + AFTER])
    return [(a, min(b, len(text))) for a, b in out]


def _holds(kind: str, text: str) -> bool:
    if kind == "phone":
        return _is_phone(text)
    if kind == "card":
        return _is_card(text)
    if kind == "ip":
        return _is_ip(DIGIT_RUN.findall(text))
    return re.search(r"[^\s@]+(?:@|[(\[]at[)\]])[^\s@]+", text) is not None


DIGIT_RUN = re.compile("[0-9]+")


def spans(model: dict, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text, the spans of the patterns, and these with those the model adds; by kind, then start."""
    bases = [base_spans(t) for t in texts]
    owners, places, sequences = [], [], []
    for i, text in enumerate(texts):
        for a, b in _segments(text):
            tokens = [(m.start() + x, m.start() + y) for m in TOKEN.finditer(text, a, b) for x, y in [_core(m[0])] if x < y]
            owners.append(i)
            places.append(tokens)
            sequences.append(_features([text[x:y] for x, y in tokens]))
    added: list[list[Span]] = [[] for _ in texts]
    covered = [Covered(b) for b in bases]
    for i, tokens, labels in zip(owners, places, viterbi(model, sequences)):
        t = 0
        while t < len(labels):
            name = LABELS[labels[t]]
            end = t + 1
            if name[0] != "O":
                while end < len(labels) and LABELS[labels[end]] == "I" + name[1:]:
                    end += 1
                span = (name[2:], tokens[t][0], tokens[end - 1][1])
                after = not added[i] or added[i][-1][2] <= span[1]  # spans come in order
                if after and not covered[i].meets(span[1], span[2]) and _holds(name[2:], texts[i][span[1] : span[2]]):
                    added[i].append(span)
            t = end
    order = lambda found: sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))
    return [(order(b), order(b + more)) for b, more in zip(bases, added)]


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])


def find(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the patterns' spans by kind, their digest, and all spans as ``kind:start:end``.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans.  Repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    model = model or train()

    def work(block: pa.RecordBatch) -> dict:
        found = spans(model, block.column("text").to_pylist())
        counts = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
        return {
            "doc_id": block.column("doc_id"),
            **counts,
            "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found],
            "spans": [written(every) for _, every in found],
        }

    return map_blocks(id_and_text(docs, id_col, text_col), work, SCHEMA)


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: dict | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; a null text stays null, all other columns as they are."""
    model, place = model or train(), docs.columns.index(text_col)

    def replace(texts: list[str]) -> list[str]:
        return [masked(t, every) for t, (_, every) in zip(texts, spans(model, texts))]

    return rewrite_blocks(docs, place, replace)
