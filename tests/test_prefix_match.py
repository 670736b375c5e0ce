"""Texts with a common head: the whole texts are compared."""

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import joins

HEAD = "licence " * 20


def test_similarity_of_whole_texts(spark):
    left = spark.createDataFrame([(1, HEAD + "a b c"), (2, HEAD + "p q r s t"), (3, "Same Text"), (4, "none"), (5, HEAD + "A  B c"), (6, "")], "id LONG, text STRING")
    right = spark.createDataFrame([(10, HEAD + "a b c d"), (11, HEAD + "p q r s t"), (12, "same  text"), (13, "other")], "known LONG, text STRING")
    rows = {r["id"]: (r["match_id"], r["match_by"], r["similarity"]) for r in joins.hash_then_prefix(left, right, "id", "known", "text", T.text_hash).collect()}
    assert rows[1] == (10, "prefix", 0.8) and rows[2] == (11, "hash", 1.0) and rows[3] == (12, "hash", 1.0) and rows[4] == (None, None, None)
    assert rows[5] == (10, "prefix", 0.8)
    # an empty text is the head of every text, and shares no word with any
    assert rows[6] == (10, "prefix", 0.0)


def test_words(spark):
    row = spark.createDataFrame([(" Ab  ab\tc\n",), ("",), (None,)], "t STRING").select(joins.words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in row] == [["ab", "c"], [], None]
