"""Fingerprints of op8's method propose near copies, also where no band key does."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallycast.llm import near_copies


def test_fingerprints_propose_without_bands(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(other)]
    rows = near_copies.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nodes = rows.withColumn("bands", F.array().cast("array<long>"))
    found = {r.node: r.cluster for r in near_copies.clusters(nodes).collect()}
    node = {r.doc_id: r.node for r in rows.collect()}
    assert set(found) == {node[0], node[1]} and found[node[0]] == found[node[1]]
