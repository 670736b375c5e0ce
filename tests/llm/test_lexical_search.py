"""Block-Max MaxScore against plain scoring of all documents."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import ODD

from siftline.llm import lexical_search as ls
from siftline.llm.queries import SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, t, {w: t.count(w) for w in set(t)}) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t, _ in held)
    df = {}
    for _, _, counts in held:
        for w in counts:
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in items:
        scored = []
        for i, t, counts in held:
            m = 100 - 25 + (25 * len(t) * n) // total
            score = 0
            for w in split(text):
                if w in counts:
                    tf = counts[w]
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(rows, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and", "Über", "日本"]
    odds = [1 / (i + 1) for i in range(300)] + [20, 15, 10, 1, 1]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.choice([3, 20, 80, 600])))) for i in range(n)]
    docs += [(i + n, docs[i * 3][1].upper()) for i in range(n // 4)]  # ties
    docs += [(900_000, "the " * 700 + "w1"), (900_001, "of " * 300)]
    items = [(j, ", ".join(rng.choices(words, odds, k=rng.choice([1, 4, 30])))) for j in range(25)]
    return docs, items + [(50, ""), (51, None), (52, "nothing-known"), (53, "the"), (54, "the the The of w299")]


@pytest.mark.parametrize("seed, block, shard", [(0, 128, 16384), (1, 4, 60), (2, 3, 7)])
def test_against_all_documents(spark, monkeypatch, seed, block, shard):
    """Small blocks and shards, so that many lists are not essential and many blocks stay closed."""
    docs, items = corpus(seed)
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "SHARD_DOCS", shard)
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    index = ls.cut_lineage(ls.build_index(made))
    assert collected(ls.search_index(index, asked)) == brute(docs, items)
    monkeypatch.setattr(ls, "WAVE_BYTES", 900)
    assert collected(ls.search_index(index, asked, 3)) == brute(docs, items, 3)


def test_closed_blocks_and_lists(monkeypatch):
    """Without Spark: the entry score keeps blocks of frequent terms closed, and rows stay right."""
    monkeypatch.setattr(ls, "BLOCK", 8)
    rng = random.Random(6)
    shard = ls._Builder()
    for i in range(3000):
        shard.add(i, (("common " * rng.randint(1, 3)) + ("rare " * rng.randint(1, 5) if i % 100 == 0 else "") + f"x{i}").encode())
    batch = pa.RecordBatch.from_pylist([shard.row()])
    found = ls.Shard(batch, 0, 3000, int(sum(shard.lengths)))
    lists = found.lists(pa.array([b"common", b"rare", b"absent"], pa.binary())).tolist()
    assert lists[2] == -1 and found.size(lists[0]) == 3000 and found.size(lists[1]) == 30
    heap = ls.Heap(5)
    ls.search_shard(found, [(lists[0], 2, found.bound(lists[0])), (lists[1], 5000, found.bound(lists[1]))], heap)
    assert len(heap.ids) == 5 and all(i % 100 == 0 for i in heap.ids.tolist())
    asked = [(lists[0], 2, found.bound(lists[0])), (lists[1], 5000, found.bound(lists[1]))]
    plain = {}
    for number, w, _ in asked:
        for d, g in zip(*(a.tolist() for a in found.open(np.arange(found.list_starts[number], found.list_starts[number + 1])))):
            plain[d] = plain.get(d, 0) + w * g
    best = sorted(plain.items(), key=lambda p: (-p[1], p[0]))
    assert list(zip(heap.ids.tolist(), heap.score.tolist())) == best[:5]
    later = ls.Heap(5)  # as left by an earlier shard with higher scores
    later.push(np.array([best[2][1] + 1] * 5), np.zeros(5, np.uint8), np.arange(5) + 10**6)
    found.opened, found.whole = 0, {}
    ls.search_shard(found, asked, later)
    assert sorted(set(later.ids.tolist()) & set(range(3000))) == sorted(d for d, s in best if s > best[2][1] + 1)
    # of 375 blocks of the frequent term only those of documents with the rare one that can still enter are opened
    assert found.opened <= 4 + 30
    full = ls.Heap(5)
    full.push(np.array([10**18] * 5), np.zeros(5, np.uint8), np.arange(5))
    found.opened = 0
    ls.search_shard(found, asked, full)
    assert found.opened == 0 and full.ids.tolist() == list(range(5))


def test_lists_come_back_whole():
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", "dd"], [500, 3, 1, 0.2], k=rng.randint(1, 900))) for _ in range(1500)]
    shard = ls._Builder()
    for i, t in enumerate(texts):
        shard.add(i, t.encode())
    made = ls.Shard(pa.RecordBatch.from_pylist([shard.row()]), 0, len(texts), sum(len(t.split()) for t in texts))
    for word, number in zip("a b c dd".split(), made.lists(pa.array([b"a", b"b", b"c", b"dd"], pa.binary())).tolist()):
        docs, gains = made.open(np.arange(made.list_starts[number], made.list_starts[number + 1]))
        want = [(i, t.split().count(word)) for i, t in enumerate(texts) if word in t.split()]
        assert docs.tolist() == [i for i, _ in want]
        assert gains.tolist() == [(10**9 * n) // (1000 * n + 12 * int(made.m[i])) for i, n in want]


def test_odd_rows(spark, odd, empty):
    items = [(1, "word"), (2, "LONG words"), (2, "no id"), (3, "é" * 50), (4, None), (5, "a" * 100_000), (1, "word"), (None, "same text")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    assert collected(ls.search(odd, asked)) == brute(ODD, list(dict.fromkeys(items)))
    assert ls.search(empty, asked).collect() == [] and ls.search(odd, asked.where("false")).collect() == []
    assert ls.search(odd, asked.where("item_id = 4")).columns == ["item_id", "rank", "doc_id", "score"]


def test_stretches(monkeypatch):
    text = b"ab cd  ef-gh " * 50
    want = ls.terms(text)
    monkeypatch.setattr(ls, "STRETCH", 7)
    assert ls.terms(text) == want


def test_sql_is_the_brute_force():
    docs, items = corpus(3, 60)
    db = duckdb.connect()
    for name, rows, kind in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        db.execute(f"create table {name} ({kind} bigint, text varchar)")
        db.executemany(f"insert into {name} values (?, ?)", rows)
    assert sorted(db.execute(SQL["op12_block_max_maxscore"]).fetchall(), key=str) == brute(docs, items)
