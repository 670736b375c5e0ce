"""Hashed vectors against a loop over words."""

import zlib

import numpy as np

from siftline.functions.vectors import hashed_vector


def test_hashed_vector(spark):
    texts = ["", None, "Один два　три один", "a b a\x1cc", "word " * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", hashed_vector(16)("t").alias("v")).collect()
    for r in rows:
        v = np.zeros(16)
        for w in (r["t"] or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 16] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(v)
        assert np.allclose(r["v"], (v / norm if norm else v).astype(np.float32), atol=0)
