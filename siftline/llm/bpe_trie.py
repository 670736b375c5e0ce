"""BPE encoding by traversal of a trie of distinct words.

In the BPE encoding of a string, the tokens before the last one are the encoding of what comes before it.  So the
encoding of every prefix is known from one value, its last token, and a token ``t`` ends the encoding of prefix ``p``
exactly if ``t`` is a suffix of ``p`` and stays apart from the last token of the rest.  The distinct words of a block
form a trie; visiting it depth first (the words in sorted order, with one value for each character of the current
path), the last token of each shared prefix is computed once.

Tokens with the end-of-word mark form an alphabet of their own: the mark belongs to the last character of a word, so a
word's last node differs from the inner node with the same characters.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.blocks import id_and_text, map_blocks

END = "</w>"
#: Distinct words whose encodings a Python worker keeps; beyond it the memory is emptied, which costs time only.
KEPT = 120_000
#: Answers about neighbouring tokens that it keeps.
APART = 150_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = SCHEMA + ", ids array<int>, decoded string"

#: The vocabulary's pattern (contractions, letters, one digit, the rest) on characters below U+0180 without marks, where the re module knows the classes.
_LETTERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
SIMPLE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Outside of this the library's own normalizer and pre-tokenizer decide.
BEYOND = re.compile("[^\x00-įı-ſ]")


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, payload: bytes):
        spec = json.loads(payload)
        model = spec["model"]
        self.payload = payload
        self.names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.vocab = vocab = model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = rank
            if made not in self.parts:
                self.parts[made], self.born[made] = pair, rank
        inner = [t for t in vocab if not t.endswith(END)]
        final = [t[: -len(END)] for t in vocab if t.endswith(END)]
        self.prefixes = {t[:k] for t in (*inner, *final) for k in range(len(t) + 1)}
        self.inner, self.final = {t: vocab[t] for t in inner}, {t: vocab[t + END] for t in final}
        self.longest = max(map(len, (*inner, *final)))
        self.states: dict[str, dict] = {"": {"": ""}}
        self.ends: dict[tuple[str, str], list] = {}
        self.apart: dict[int, bool] = {}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.spell = {b: c for b, c in byte_letters().items()}
        self.unspell = {ord(c): chr(b) for b, c in self.spell.items()}
        self.whole = {s: (str(i), s) for s, i in self.special.items()}
        self.known: dict[str, tuple[str, str]] = {}  # word -> its ids and its tokens, joined
        self.digits = {i: str(i) for i in self.names}
        self._library = None

    # ---- when do two neighbouring tokens stay apart?

    def _edges(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at an edge of ``token`` while it is being merged: (token, from rank, until rank)."""
        found, until = [], len(self.rank)
        while True:
            born = self.born.get(token, -1)
            found.append((token, born, until))
            if token not in self.parts:
                return found
            token, until = self.parts[token][side], born

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of ``a`` and ``b`` side by side ends in just these two tokens.

        A merge across the border happens if both of its parts stand at the border when its turn comes.  At equal
        rank the left of two overlapping places is merged first.
        """
        key = (a << 17) | b
        known = self.apart.get(key)
        if known is None:
            right = self.right.get(a) or self.right.setdefault(a, self._edges(a, 1))
            left = self.left.get(b) or self.left.setdefault(b, self._edges(b, 0))
            known = True
            for x, from_x, until_x in right:
                for y, from_y, until_y in left:
                    rank = self.rank.get((x, y))
                    if rank is not None and from_x < rank and from_y < rank and rank < until_x and rank <= until_y:
                        known = False
            self.apart[key] = known
        return known

    # ---- trie

    def _step(self, state: dict, letter: str) -> tuple[dict, list]:
        """From the longest suffix that starts a token to the next one, and the inner tokens that end there, longest first."""
        suffix = state[""] + letter
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        found = [(self.inner[suffix[-k:]], k) for k in range(len(suffix), 0, -1) if suffix[-k:] in self.inner]
        made = state[letter] = (self.states.setdefault(suffix, {"": suffix}), found)
        return made

    def _end(self, state: dict, letter: str) -> list:
        """The tokens with the end mark that end a word here, longest first."""
        suffix = state[""] + letter
        found = [(self.final[suffix[-k:]], k) for k in range(len(suffix), 0, -1) if suffix[-k:] in self.final]
        self.ends[state[""], letter] = found
        return found

    def encode_words(self, words) -> dict[str, list[int]]:
        """Token ids of distinct words (in byte letters), visited as a trie in depth-first order."""
        out = {}
        path, last, size = [self.states[""]], [0], [0]  # for each node of the current path
        before = ""
        apart, stay, ends = self.apart, self.stay_apart, self.ends
        for word in sorted(words):
            n, shared = len(word) - 1, 0
            most = min(len(path) - 1, n)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :], last[shared + 1 :], size[shared + 1 :]
            state = path[shared]
            for i in range(shared, n):
                state, found = state.get(word[i]) or self._step(state, word[i])
                for token, k in found:
                    if k > i:
                        break
                    ok = apart.get((last[i + 1 - k] << 17) | token)
                    if ok or ok is None and stay(last[i + 1 - k], token):
                        break
                path.append(state)
                last.append(token)
                size.append(k)
            for token, k in ends.get((state[""], word[n])) or self._end(state, word[n]):
                if k > n:
                    break
                ok = apart.get((last[n + 1 - k] << 17) | token)
                if ok or ok is None and stay(last[n + 1 - k], token):
                    break
            ids, at = [token], n + 1 - k
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    # ---- texts

    def _pieces(self, text: str) -> list[str]:
        """What the vocabulary's normaliser and pattern make of a text without special tokens."""
        if not BEYOND.search(text):
            return SIMPLE.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.payload.decode())
        plain = self._library.normalizer.normalize_str(text)
        return [p.translate(self.unspell).encode("latin-1").decode() for p, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    def _learn(self, words: list[str]) -> None:
        spelled = [w.encode().decode("latin-1").translate(self.spell) for w in words]
        ids_of = self.encode_words(set(spelled))
        digits, names = self.digits, self.names
        for w, s in zip(words, spelled):
            ids = ids_of[s]
            self.known[w] = (" ".join([digits[i] for i in ids]), " ".join([names[i] for i in ids]))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text, its ids and its tokens, each joined by a space."""
        split = []
        for text in texts:
            if any(s in text for s in self.special):  # special tokens are cut out before anything is normalised
                parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
                split.append([w for p in parts for w in ([p] if p in self.special else self._pieces(p))])
            else:
                split.append(self._pieces(text))
        need = set().union(*split)
        new = [w for w in need if w not in self.known]
        if len(self.known) + len(new) > KEPT:  # keep what this block uses
            self.known = {w: self.known[w] for w in need if w in self.known}
        if len(self.apart) > APART:
            self.apart = {}
        self.known |= self.whole
        self._learn([w for w in new if w not in self.whole])
        out = []
        for words in split:
            pairs = list(map(self.known.__getitem__, words))
            out.append((" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
        return out


@lru_cache(maxsize=2)
def encoder(payload: bytes) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    return Encoder(payload)


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file (by default the public word BPE), read once on the driver and sent with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def encode(docs: DataFrame, path: str | None = None, *, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``full`` also the ids and
    the decoded text.

    A null or empty text has no tokens.  Repeated rows are encoded one by one; null ids are kept; an empty table gives
    no rows.  Other columns, whatever their names, are not read.
    """
    payload = vocabulary(path)

    def work(block: pa.RecordBatch) -> dict:
        made = encoder(payload).encode(block.column("text").to_pylist())
        out = {
            "doc_id": block.column("doc_id"),
            "n_tokens": pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in made], pa.int64()),
            "ids_sha256": [_digest(ids) for ids, _ in made],
            "decoded_sha256": [_digest(text) for _, text in made],
        }
        if full:
            out["ids"] = pa.array([[int(i) for i in ids.split()] for ids, _ in made], pa.list_(pa.int32()))
            out["decoded"] = [text for _, text in made]
        return out

    return map_blocks(id_and_text(docs, id_col, text_col), work, FULL_SCHEMA if full else SCHEMA)
