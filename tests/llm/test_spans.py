"""PII, secrets and token spans against plain regular expressions and loops."""

import bisect
import random
import re
import time

import pytest
from tests.llm.conftest import ODD

from siftline.llm import pii, ranks, secret_scan, token_spans
from siftline.llm.covered import Covered

digits = lambda s: re.sub("[^0-9]", "", s)
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def plain(patterns, text):
    return [(k, m.start(), m.end()) for k, p, ok in patterns for m in re.finditer(p, text) if ok(m)]


@pytest.fixture(scope="module")
def model():
    return pii.train()


@pytest.mark.parametrize("seed", range(3))
def test_patterns(seed):
    rng = random.Random(seed)
    for _ in range(5000):
        text = "".join(rng.choices("ab1234567890..@@--+ ()%é\n٣", k=rng.randint(0, 70)))
        assert pii.base_spans(text) == plain(PII, text)
        parts = ["token", "SECRET", "api_key", "apikey", "=", " ", ":", '"', "AKIA", "AB12CD34", "0a1b2c3d4e5f", "abc", "ſecret", "x", "token=token:abcdefgh"]
        text = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        assert secret_scan.base_spans(text) == plain(SECRETS, text)


def test_crf_learns_its_table(model):
    for row in pii.ROWS:
        tokens, labels = pii._labelled(row)
        assert list(pii.viterbi(model, [pii._features(tokens)])[0]) == labels, row


def test_viterbi_equals_all_paths(model):
    from itertools import product

    tokens = ["call", "555-123-4567", "now", "x"]
    features = pii._features(tokens)
    emit = [sum((model["emit"][model["index"][f]] for f in fs if f in model["index"]), start=0) for fs in features]
    start = pii._allowed()[0]
    value = lambda path: start[path[0]] + sum(e[k] for e, k in zip(emit, path)) + sum(model["move"][a, b] for a, b in zip(path, path[1:]))
    best = max(product(range(len(pii.LABELS)), repeat=len(tokens)), key=value)
    other = [pii._features(["a"] * 7), pii._features(["ip", "1.2.3.4"])]
    assert tuple(pii.viterbi(model, [features, *other])[0]) == best


def test_model_adds_spellings_that_patterns_miss(model):
    for text, kind, value in [
        ("ring (980) 555-6268 now", "phone", "(980) 555-6268"),
        ("bob(at)example.org", "email", "bob(at)example.org"),
        ("host 10[.]1[.]2[.]3", "ip", "10[.]1[.]2[.]3"),
        ("paid with card 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"),
    ]:
        base, every = pii.spans(model, [text])[0]
        assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, value)]
    for text in ("version 3.2.1 of 2024-01-05", "nothing here", "1998 and 2001, 12:30", ""):
        assert pii.spans(model, [text])[0] == ([], [])


def test_pii_rows_and_mask(spark, odd, empty, model):
    extra = [(20, "mail a@b.co and +1 (980) 555-6268, ip 1.2.3.4", None), (21, None, "k")]
    docs = spark.createDataFrame(extra, "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    assert rows[20]["spans"] == "email:5:11,ip:38:45,phone:16:33" and rows[20]["n_phone"] == 1 and rows[21]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    assert masked == {20: "mail <email> and <phone>, ip <ip>", 21: None}
    assert pii.find(odd, model).count() == len(ODD) and pii.find(empty, model).collect() == []
    same = pii.mask(odd, model)
    assert same.columns == odd.columns and sorted(same.collect(), key=str) == sorted(odd.collect(), key=str)
    assert pii.mask(empty, model).collect() == []


def test_token_efficiency():
    encode = ranks.ranks_encoding(ranks.read_ranks()).encode_ordinary
    for run in ("aG9x2LkQz81mWq0PvR7sT", "ghp_a8D2kLq0ZxPw93mNvB71tYrEuIoPlKjH"):
        assert [s[0] for s in secret_scan.random_spans(f"key {run}.", encode, [])] == ["random"]
    for run in (
        "internationalization_of_words", "myCamelCaseIdentifierName", "thtionblehaninganden", "THHATIONBLEREANDINGER", "2024-01-05-2024-01-06",
        "123e4567-e89b-12d3-a456-426614174000", "5d41402abc4b2a76b9719d911017c592", "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    ):
        assert secret_scan.random_spans(run, encode, []) == []


def test_secret_rows(spark, odd, empty):
    docs = spark.createDataFrame([(1, 'é token = "aG9x2LkQz81mWq0PvR7sT" x9Z8y7W6v5U4t3S2r1Q0', 1)], "doc_id long, text string, n_hex int")
    row = secret_scan.find(docs).first()
    assert row["spans"] == "assign:2:32,random:34:54" and row["n_assign"] == 1 and row["n_random"] == 1
    assert secret_scan.find(odd).count() == len(ODD) and secret_scan.find(empty).collect() == []


def test_token_spans(odd, empty):
    payload = ranks.read_ranks()
    encoding = ranks.ranks_encoding(payload)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(["the", " word", "\n", "\n\n", " \n ", "é", "𝒳", "\r\n", "x" * 9, "."], k=rng.randint(0, 30)))
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        want, at = {r: [0] * len(starts) for r in token_spans.RULES}, 0
        crossing = 0
        for token in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(token))
            chars = range(owner[at], owner[at + size - 1] + 1)
            at += size
            sections = [bisect.bisect_right(starts, c) - 1 for c in chars]
            crossing += len(set(sections)) > 1
            want["first"][sections[0]] += 1
            want["last"][sections[-1]] += 1
            want["most"][max(set(sections), key=lambda s: (sections.count(s), -s))] += 1
        for rule in token_spans.RULES:
            _, got, crossed = token_spans.count(text, payload, rule)
            assert got.tolist() == want[rule] and crossed == crossing
    rows = token_spans.by_section(odd).collect()
    assert len(rows) == len(ODD) and all(sum(r["section_tokens"]) == r["n_tokens"] and len(r["section_tokens"]) == r["n_sections"] for r in rows)
    assert token_spans.by_section(empty).collect() == []


def test_random_strings_of_one_case_and_behind_names():
    encode = ranks.ranks_encoding(ranks.read_ranks()).encode_ordinary
    found = lambda text: [text[a:b] for _, a, b in secret_scan.random_spans(text, encode, [])]
    rng = random.Random(2)
    for letters, share in (("abcdefghijklmnopqrstuvwxyz", 0.85), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.95), ("abcdefghijklmnopqrstuvwxyz0123456789", 0.95)):
        runs = ["".join(rng.choices(letters, k=rng.randint(16, 40))) for _ in range(400)]
        assert sum(found(r) == [r] for r in runs) >= share * len(runs)
    assert found("seed JBSWY3DPEHPK3PXPJBSWY3DP.") == ["JBSWY3DPEHPK3PXPJBSWY3DP"]
    assert found("session_authentication_cookie_value=Zk3xQ9mB7tLw2RpY") == ["Zk3xQ9mB7tLw2RpY"]
    assert found("https/international/documentation/Zk3xQ9mB7tLw2RpY/presidential/election/results") == ["Zk3xQ9mB7tLw2RpY"]
    for name in ("spark_sql_adaptive_skew_join", "MAX_RETRY_COUNT_PER_HOST", "HTTPServerRequestHandlerFactory"):
        assert found(name) == []


def test_slugs_with_long_numbers_take_no_time():
    encode = ranks.ranks_encoding(ranks.read_ranks()).encode_ordinary
    for run in ("united-states-presidential-election-results-20201103", "internationalizationinternationalization12345", "word-" * 2000 + "123456"):
        assert secret_scan.random_spans(run, encode, []) == []


def test_covered_is_any_overlap():
    rng = random.Random(3)
    for _ in range(300):
        taken = [("k", a, a + rng.randint(1, 9)) for a in rng.choices(range(60), k=rng.randint(0, 8))]
        covered = Covered(taken)
        for _ in range(20):
            a = rng.randrange(70)
            b = a + rng.randint(1, 12)
            assert covered.meets(a, b) == any(x < b and a < y for _, x, y in taken)


def seconds(work):
    started = time.process_time()
    work()
    return time.process_time() - started


def test_many_spans_in_one_text(model):
    rng = random.Random(4)
    encode = secret_scan._encoding(ranks.read_ranks()).encode_ordinary
    keys = "\n".join(f"id{i} {rng.getrandbits(128):032x} token=Zk3xQ9mB7tLw{i:06}" for i in range(100_000))
    base = secret_scan.base_spans(keys)
    assert len(base) >= 200_000
    assert seconds(lambda: secret_scan.random_spans(keys, encode, base)) < 30
    people = " ".join(f"call +49 30 {rng.randrange(10**6, 10**7)} or a{i}[at]b{i}.org" for i in range(100_000))
    found = []
    assert seconds(lambda: found.extend(pii.spans(model, [people]))) < 120
    assert len(found[0][0]) == 100_000 and len(found[0][1]) >= len(found[0][0])
    assert seconds(lambda: pii.spans(model, ["@" + "(" * 100_000, "9" + ")" * 100_000, "1[at]" + "(]" * 50_000])) < 20


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \n"])
def test_a_million_white_space_characters(space):
    payload = ranks.read_ranks()
    for text in (space * 1_000_000, "a" + space * 500_000 + "b", space * 400_000 + "\x1cx" + space * 400_000):
        ids, lines, _ = token_spans.count(text, payload)
        assert token_spans._vocabulary(payload)[0].decode(ids.tolist()) == text and lines.sum() == len(ids)


def test_white_space_apart_gives_the_same_ids(monkeypatch):
    encoding = token_spans._vocabulary(ranks.read_ranks())[0]
    rng = random.Random(5)
    for least in (2, 3, 7):
        monkeypatch.setattr(token_spans, "LONG_SPACE", re.compile(token_spans.LONG_SPACE.pattern.replace("10000", str(least))))
        for _ in range(2000):
            text = "".join(rng.choices(["a", "'s", "1", " ", "  ", "\n", "\t", "\x1c", "　", "\x85", ".", "é"], k=rng.randint(0, 25)))
            assert token_spans.encode(encoding, text) == encoding.encode_ordinary(text)
