from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out_metrics(spark, out, label, folds, held):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(labels.where(F.col(label).isNotNull()), "doc_id").select("doc_id", "held_out", "score", "predicted", F.col(label).alias("y")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    test = [r for r in rows if r.held_out]
    pos, neg = [r.score for r in test if r.y == 1], [r.score for r in test if r.y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    return auc, np.mean([r.predicted for r in test if r.y == 1]), np.mean([r.predicted for r in test if r.y == 0])


def test_quality_on_held_out_documents(spark):
    out = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    auc, hit, false = held_out_metrics(spark, out, "quality", 5, 0)
    print("quality", auc, hit, false)
    assert auc > 0.97 and hit > 0.98


def test_toxicity_on_held_out_documents(spark):
    out = toxicity.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    auc, hit, false = held_out_metrics(spark, out, "toxic", 4, 2)
    print("toxicity", auc, hit, false)
    assert auc > 0.97 and hit > 0.9 and false < 0.02


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.Network(x, y, np.arange(4000) % 5 == 0)
    score = net.score(x)
    assert abs(score.mean() - y.mean()) < 0.03 and np.mean(np.abs(score - p)) < 0.1


def test_pooling_does_not_depend_on_chunks(monkeypatch):
    words, vectors = quality.Words(), quality.index_vectors()
    runs = words.of("The cat, the CAT sat 12 times! " * 50)
    whole = quality.pooled(runs, vectors)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert np.allclose(quality.pooled(runs, vectors), whole, atol=1e-5)
    assert not quality.pooled(words.of(""), vectors).any()


def brute_segments(scores):
    """The highest segment, shortest of equals, then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    left, right = brute_segments(scores[:i]), brute_segments(scores[j + 1:])
    return left + [(i, j, total)] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


def test_maximal_segments_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 30)
        flagged = sorted(rng.sample(range(n), rng.randint(0, n)))
        scores = [rng.choice([0.5, 1.0, 2.25, 3.5, 4.75]) + rng.random() / 64 for _ in flagged]
        drift = rng.choice([0.125, 1.0, 3.0])
        row = [-drift] * n
        for i, s in zip(flagged, scores):
            row[i] = s
        got = toxicity.maximal_segments(flagged, scores, drift)
        want = brute_segments(row)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, module, label):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "word " * 3000, "z"), (3, "1 !! é", "w")], "doc_id long, text string, score string")
    for rows in ([], [(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (3, 7, 7)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        out = module.classify(docs, labels).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert module.classify(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for module, folds, held in ((quality, 5, 0), (toxicity, 4, 2)):
        out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held
        turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        a, b = ({r.doc_id: r.score for r in module.classify(docs, x).collect()} for x in (labels, turned))
        assert a == b
