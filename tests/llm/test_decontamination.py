"""Contamination against brute force, and against the registered SQL."""

import random
import re

import duckdb
import pytest

from siftline.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[tuple(w[p : p + size])]
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "über", "ñ", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (None, "null id item text of some length"), (50, None), (51, "..."), (52, items[5][1])]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ". ", "\n"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    return docs + [(3, docs[3][1]), (100, None), (101, ""), (None, items[2][1]), (102, items[2][1] * 300)], items


@pytest.mark.parametrize("limit", [100_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, limit, seed):
    """By the set and, for benchmarks too large for it, by the join."""
    docs, items = cases(seed)
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in docs], "doc_id long, text string, window string, items int")
    found = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), set_limit=limit)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"]), r["contaminated"]) for r in found.collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_sql(spark):
    docs, items = cases(5)
    items = [x for x in items if x[0] is not None]
    db = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        db.execute(f"create table {name} ({key} bigint, text varchar)")
        db.executemany(f"insert into {name} values (?, ?)", rows)
    got = [(r[0], r[1], r[2], r[3], r[5]) for r in db.execute(queries.OP3_SQL).fetchall()]
    assert sorted(got, key=str) == sorted(((a, b, c, d, f) for a, b, c, d, _, f in brute(docs, items)), key=str)


def test_empty_tables_and_removal(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text twice over")], "item_id long, text string")
    assert decontamination.contamination(empty, items).collect() == []
    clean = decontamination.contamination(odd, items.where("false"))
    assert clean.count() == odd.count() and not clean.where("contaminated OR n_hit > 0").count()
    left = decontamination.remove_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 2 and not left.where("doc_id in (8, 9)").count()


def test_a_prompt_that_many_items_share(spark):
    """Windows are broadcast without the ids of their items."""
    prompt = "read the following text with care and answer the question below in one word only"
    items = spark.range(100_000).selectExpr("id item_id", f"concat('{prompt}', if(id % 1000 = 0, concat(' q', id), '')) text")
    docs = spark.createDataFrame([(1, f"before {prompt} after"), (2, "nothing of it"), (3, f"{prompt} q5000")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontamination.contamination(docs, items).drop("item_ids").collect()}
    assert got == {1: (15, 100_000), 2: (0, 0), 3: (16, 100_000)}
