"""The pipeline's stages against brute-force versions over the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import bpe_trie, pii, toxicity
from siftline.llm.blocks import read
from tests.llm.test_decontamination import brute
from tests.llm.test_simhash import fingerprint, roots

DIRECTORY = os.environ.get("SIFTLINE_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no driver tables")


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def test_near_copies_go(spark):
    """Copies of documents with a word changed, which differ in more than two bits of the fingerprint."""
    docs = read(spark, DIRECTORY, "documents")
    longer = [r for r in docs.collect() if len((r["text"] or "").split()) >= 60][:40]
    changed = []
    for r in longer:
        words = r["text"].split()
        words[len(words) // 2] = "replaced"
        changed.append((10**6 + r["doc_id"], " ".join(words), r["lang"], r["source"], len(r["text"])))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.union(spark.createDataFrame(changed, docs.schema)), DIRECTORY)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not [c for c in changed if c[0] in ids]


def test_stages_take_odd_rows(spark, odd):
    """Nulls, repeated rows, very long texts and clashing columns; all but the last stage keep the columns."""
    docs = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DIRECTORY)
        assert made.count() > 0
        if name != "bpe":
            assert made.columns == docs.columns
            docs = made


def test_stages(spark):
    docs = read(spark, DIRECTORY, "documents")
    columns = docs.columns
    model = toxicity.fit(docs, read(spark, DIRECTORY, "labels"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    scores = dict(zip(rows, toxicity.score_texts(model, list(rows.values()))))
    kept = {i: t for i, t in rows.items() if scores[i] < toxicity.CUT}
    prints, sets = {i: fingerprint(t) for i, t in kept.items()}, {i: shingles(t) for i, t in kept.items()}
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]).bit_count() <= 2 or alike(sets[a], sets[b]))]
    kept = {i: kept[i] for i, root in roots(kept, near).items() if i == root}
    items = duckdb.sql(f"select item_id, text from '{DIRECTORY}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in brute(list(kept.items()), items) if r[5]}
    kept = {i: t for i, t in kept.items() if i not in bad}
    field = pii.train()
    kept = {i: pii.masked(t, pii.spans(field, [t])[0][1]) for i, t in kept.items()}
    encoder = bpe_trie.encoder(bpe_trie.vocabulary())
    want = sorted((i, ids.count(" ") + 1 if ids else 0) for i, (ids, _) in zip(kept, encoder.encode(list(kept.values()))))
    got = corpus_pipeline.run(spark, DIRECTORY)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIRECTORY)
        assert docs.columns == columns


def test_empty_documents(spark):
    docs = read(spark, DIRECTORY, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIRECTORY)
        assert docs.collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {"op3_decontamination", "op5_url_aliases", "op11_spanning_tree_negatives", "op12_block_max_maxscore"} <= set(entry.oracle_sql()) <= names
