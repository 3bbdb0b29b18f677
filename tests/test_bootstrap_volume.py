"""What a bootstrap shuffles does not grow with its draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycast.operators import bootstrap as BS


def shuffled(spark, run) -> int:
    """Bytes that the stages of `run` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def test_shuffles_hold_no_draws(spark):
    """20,000 groups and 500 replicates make 10 million draws; rows with 50 scores bring some bytes a group."""
    rows = spark.range(40_000).select(
        (F.col("id") % 20_000).alias("g"), (F.xxhash64("id") % 2 == 0).cast("int").alias("outcome"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 50.0).alias("p"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)) / 50.0).alias("q"))
    found = []
    assert shuffled(spark, lambda: found.extend(BS.bootstrap_auc_diff(rows, "p", "q", "g", 500).collect())) < 8_000_000
    assert found[0].replicates == 500 and found[0].ci_lo < found[0].point < found[0].ci_hi
    sums = rows.groupBy("g").agg(F.sum("p").alias("a"), F.count(F.lit(1)).alias("n"))
    assert shuffled(spark, lambda: found.extend(BS.bootstrap_ratio(sums, "g", {"r": ("a", "n")}, 500).collect())) < 4_000_000
    assert found[1].replicates == 500
