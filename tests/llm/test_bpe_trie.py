"""The trie's encodings against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from siftline.llm import bpe_trie

ALPHABET = "abcdefghijklmnopqrstuvwxyz'ABC  éÉßİςΣſKǅ½²٣一🎉é̈\x1c\x85 　\xa0\n\t_-.,!0129<|>\x00\x7f"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(library, texts):
    encoded = library.encode_batch(texts, add_special_tokens=False)
    return [(" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)) for e in encoded]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(library, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "aa", "ab", "th", "the", "in", "ing", "er", "nn", "ss", "ee", "é", " "]
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(2000)]
    assert bpe_trie.encoder(bpe_trie.vocabulary()).encode(texts) == expected(library, texts)


def test_special_tokens_and_repeats(library):
    texts = ["", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|> z", "a" * 3000, "the" * 2000, "aaaa aaaaa hahaha", "It's we've I'll"]
    assert bpe_trie.encoder(bpe_trie.vocabulary()).encode(texts) == expected(library, texts)


def test_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "KEPT", 5)
    made = bpe_trie.Encoder(bpe_trie.vocabulary())
    texts = ["one two three four five six seven", "two three eight nine", "one ten"]
    assert [made.encode([t])[0] for t in texts] == expected(library, texts)


def test_odd_rows(odd, empty, library):
    digest = lambda value: hashlib.sha256(value.encode()).hexdigest()
    want = [(i, ids.count(" ") + 1 if ids else 0, digest(ids), digest(text)) for (i, _), (ids, text) in zip(ODD, expected(library, [t or "" for _, t in ODD]))]
    got = [tuple(r) for r in bpe_trie.encode(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = bpe_trie.encode(odd, full=True).where("doc_id = 4").first()
    assert full["ids"] == library.encode("word", add_special_tokens=False).ids and full["decoded"] == "word</w>"
    assert bpe_trie.encode(empty).collect() == []
