"""Packed pieces against the tokenizers library, and sequences against the pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from siftline.llm import packing
from siftline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, library, sequence):
    """Every id of every document in one piece, sequences gapless, all but the last full."""
    want = sorted((str(i), *library.encode(t or "", add_special_tokens=False).ids, 0) for i, t in texts)
    documents, places = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and 0 <= r["offset"] and r["offset"] + r["length"] <= sequence
        documents.setdefault((r["doc_id"], r["sequence_id"] * sequence + r["offset"] - r["start"]), []).append((r["start"], ids, r["doc_tokens"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    got = []
    for (i, _), parts in documents.items():
        parts.sort()
        assert [s for s, _, _ in parts] == np.cumsum([0] + [len(p) for _, p, _ in parts])[:-1].tolist()
        whole = [x for _, p, _ in parts for x in p]
        assert {n for _, _, n in parts} == {len(whole)}
        got.append((str(i), *whole))
    assert sorted(got) == want
    assert sorted(places) == list(range(len(places)))
    for number, spans in places.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == sequence or number == len(places) - 1


@pytest.mark.parametrize("sequence, few", [(1024, 200_000), (16, 0)])
def test_pieces_of_odd_rows(odd, empty, library, monkeypatch, sequence, few):
    monkeypatch.setattr(packing, "FEW_PARTS", few)
    check(packing.pieces(odd.repartition(5), sequence=sequence).collect(), ODD, library, sequence)
    assert packing.pieces(empty).collect() == [] and packing.sequences(packing.pieces(empty)).collect() == []


def test_places_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    totals = [(p, (p * 7) % 5) for p in range(0, 20, 2)]
    got = {r["part"]: r["base"] for r in packing.places(spark.createDataFrame(totals, "part long, total long")).collect()}
    assert got == {p: sum(t for q, t in totals if q < p) for p, _ in totals}


def test_sequences(spark, library):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["some", "words", "unüblich", "42", "\n\n"], k=rng.randint(0, 40)))) for i in range(300)]
    packed = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), sequence=64)
    pieces = packed.collect()
    check(pieces, rows, library, 64)
    made = {r["sequence_id"]: r for r in packing.sequences(packed, 64).collect()}
    for number, row in made.items():
        mine = sorted((p["offset"], p["doc_id"], p["start"], p["length"], bytes(p["ids"])) for p in pieces if p["sequence_id"] == number)
        ids = b"".join(m[-1] for m in mine)
        assert [tuple(d) for d in row["documents"]] == [m[:4] for m in mine] and row["n_tokens"] == len(ids) // 4
        power = row["n_tokens"] & (row["n_tokens"] - 1) == 0
        assert bytes(row["ids"]) == (ids if power else ids.ljust(256, b"\0"))
    assert sorted(made) == list(range(len(made))) and len(made) > 7


def test_long_texts_are_cut_at_safe_places(library, monkeypatch):
    rng = random.Random(5)
    payload = packing.tokenizer_file()
    texts = ["".join(rng.choices("ab1é.' \n\t　\x1c\x85\xa0\u2028\u200b!<|>", k=rng.randint(0, 400))) + "<|endoftext|> it's" for _ in range(200)]
    for stretch in (5, 50):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        assert all("".join(packing.stretches(t)) == t for t in texts)
        want = [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]
        for kept in (300_000, 3):
            monkeypatch.setattr(packing, "KEPT", kept)
            assert [np.frombuffer(m, "<u4").tolist() for m in packing.encoded(payload, texts)] == want


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 300_000 + "x", "a" * 300_000, "🎉" * 100_000])
def test_long_runs(library, text):
    assert np.frombuffer(packing.encoded(packing.tokenizer_file(), [text])[0], "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_query(spark):
    directory = "/root/testdata/sf0.001"
    rows = QUERIES["op13_concatenate_cut"](spark, directory).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows[:500]:
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
