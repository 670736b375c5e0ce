"""Fingerprints and links against brute force over all pairs."""

import random
import re

import pytest
import xxhash
from tests.llm.conftest import ODD

from siftline.llm import simhash
from siftline.llm.components import components
from siftline.operators import neighbours


def fingerprint(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["fingerprint"]) for r in simhash.clusters(odd).collect()), key=str)
    assert got == sorted(((i, f"{fingerprint(t):016x}") for i, t in ODD), key=str)
    by_id = {r["doc_id"]: r["component_id"] for r in simhash.clusters(odd).collect()}
    assert by_id[8] == by_id[9] == 8 and by_id[1] == by_id[2] == by_id[3] == 1 and by_id[None] is not None
    assert simhash.clusters(empty).collect() == []


def signed(n):
    return n - (1 << 64) if n >> 63 else n


@pytest.mark.parametrize("bucket", [0, 3, 64])
def test_links_equal_all_pairs(spark, monkeypatch, bucket):
    """Compared, through pivots, and both: the same components."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(rng.randint(0, 4)):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            values.add(v)
    values = sorted(signed(v) for v in values)
    near = [(a, b) for a in values for b in values if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    made = simhash.links(df)
    links = {tuple(sorted((r["a"], r["b"]))) for r in made.collect()}
    assert links <= set(near)
    got = {r["node"]: r["root"] for r in components(made).collect()}
    want = {n: r for n, r in roots(values, near).items() if any(n in e for e in near)}
    assert got == want


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)] + [(5000, 5000), (7, 3), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(201)} | {n: 1000 for n in range(1000, 1101)}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # blank texts are one component, the repeated row and the copy go
    assert len(rows) == len({fingerprint(t) for _, t in ODD}) and [i for i, _ in rows].count(4) == 1 and 9 not in [i for i, _ in rows]


def test_keep_one_by_similarity(spark):
    """Texts of a similarity of 0.8 go although their fingerprints differ in more bits, also in a crowd with a common frame."""
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    frame = draw(100)
    for _ in range(40):  # alike in the frame, below 0.8 to each other; each second one has a copy with one word changed
        words = frame[:]
        for at in range(rng.randrange(25), 100, 25):
            words[at] = draw(1)[0]
        texts.append(words)
        if len(texts) % 2:
            texts.append([*words[:-1], *draw(1)])
    texts += [draw(64) for _ in range(5)]
    texts += [[*t[:30], "changed", *t[31:]] for t in texts[-5:]] + [["Short", "text"], ["short", "text"], ["other"]]
    made = [" ".join(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ([x.lower() for x in t] for t in texts)]
    pairs = [(i, j) for i in range(len(made)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [fingerprint(t) for t in made]
    bits = [(i, j) for i in range(len(made)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = {i for i, r in roots(range(len(made)), pairs + bits).items() if i == r}
    assert want < {i for i, r in roots(range(len(made)), bits).items() if i == r}
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(df, least=0.8).collect()} == want


def test_keep_one_by_similarity_of_odd_rows(odd, empty):
    kept = simhash.keep_one(odd, least=0.8)
    assert kept.columns == odd.columns and kept.count() == simhash.keep_one(odd).count()
    assert simhash.keep_one(empty, least=0.8).collect() == []


def test_crowds_of_unlike_copies_make_few_pairs(spark, monkeypatch):
    """Copies of one text that each differ from it in much, so that most are below 0.8 to each other: few are compared."""
    rng = random.Random(5)
    frame = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(300):
        words = frame[:]
        for at in range(rng.randrange(28), 150, 28):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    pairs = [(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [fingerprint(" ".join(t)) for t in texts]
    bits = [(i, j) for i in range(300) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = {i for i, r in roots(range(300), pairs + bits).items() if i == r}
    compared, check = [], neighbours.verified

    def counted(index, met):
        compared.append(met.count())
        return check(index, met)

    monkeypatch.setattr(neighbours, "verified", counted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(df, least=0.8).collect()} == want
    assert sum(compared) < 5000, compared
