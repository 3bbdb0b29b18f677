"""What the driver gets while the quality model is fitted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallycast.llm import quality

TEXTS = [f"word{i % 7} and Word{i % 3}, number {i}" * (i % 4) for i in range(1100)]


def sample(spark):
    rows = [(i * 3 + (1 << 60), i % 2, i % 5, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, y int, part long, text string").repartition(3)


def test_features_come_in_blocks_of_bytes(spark):
    vectors = quality.index_vectors()
    blocks = quality.features(sample(spark), vectors).collect()
    assert len(blocks) <= 6 and all(isinstance(b[c], (bytes, bytearray)) and len(b[c]) <= quality.ROWS * quality.N_FEATURES * 4 for b in blocks for c in ("doc_id", "y", "part", "x"))
    ids, y, part = (np.frombuffer(b"".join(b[c] for b in blocks), np.int64) for c in ("doc_id", "y", "part"))
    x = np.frombuffer(b"".join(b.x for b in blocks), np.float32).reshape(-1, quality.N_FEATURES)
    place, words = (ids - (1 << 60)) // 3, quality.Words()
    assert sorted(place) == list(range(len(TEXTS))) and (y == place % 2).all() and (part == place % 5).all()
    assert all((x[k] == quality.pooled(words.of(TEXTS[at]), vectors)).all() for k, at in enumerate(place))


def test_context_sums_are_added_up_in_tasks(spark):
    words, index, total = quality.Words(), quality.index_vectors(), np.zeros((quality.BUCKETS, quality.WIDTH), np.float32)
    for t in TEXTS:
        quality.add_contexts(total, index, words.of(t))
    assert np.allclose(quality.gather(sample(spark)), total, rtol=1e-3, atol=1e-2)


def test_no_labelled_row_gives_no_network(spark):
    none = sample(spark).select("doc_id", "text")
    labels = sample(spark).select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert quality.fit(none, labels, F.lit(True))[1] is None
