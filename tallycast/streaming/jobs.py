"""Streaming forms of the incremental jobs. Each drains what is available and stops; the checkpoint
replaces a hand-kept state file."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators.live import first_lookups, outcome_of
from tallycast.session import shared_folder

#: Rows exactly thirty days back still count; Spark takes a row at the watermark for late.
LOOK_BACK = "30 days 1 millisecond"


def ingest(stream: DataFrame, key: str, event_time: str, look_back: str = LOOK_BACK) -> DataFrame:
    """Rows of a growing folder, each key once within the look-back; state older than that expires.

    Drained by `run_to_table` under one path, the checkpoint keeps keys and watermark over runs: a later run takes
    keys that closed late, down to `look_back` before the latest end date of the runs before it, and no key twice."""
    return stream.withWatermark(event_time, look_back).dropDuplicatesWithinWatermark([key])


def resolve(lookups: DataFrame, closed: DataFrame) -> DataFrame:
    """Stream-static join: every lookup with the outcome of its market, as far as the catalogue has closed it."""
    known = closed.select("market_id", "yes_price", F.lit(True).alias("closed"))
    joined = lookups.join(known, "market_id", "left")
    label = outcome_of(F.col("yes_price"))
    status = F.when(F.col("closed").isNull(), "open").when(label.isNotNull(), "resolved").otherwise("ambiguous")
    return joined.withColumn("status", status).withColumn("outcome", label).drop("closed", "yes_price")


def run_to_table(stream: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """Drain a stream into Parquet (exactly once) and read the table back."""
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{path}/table")


def append_log(stream: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """Append lookups batch by batch. A replayed batch overwrites its own folder, so each lookup is stored
    once, and no batch rewrites older ones."""
    path = path or f"{shared_folder(spark)}/lookups-{uuid.uuid4().hex}"

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    q = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/log")


def first_of_log(log: DataFrame) -> DataFrame:
    return first_lookups(log.drop("batch"))


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(r.v for r in spark.read.parquet(path).select("v").distinct().collect()) if begun(path, spark) else []


def drop_versions(spark: SparkSession, path: str, up_to: int) -> None:
    for v in versions(spark, path):
        if v <= up_to:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def first_so_far(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Rows that hold the first lookup per key after the batches below `before`: the newest compacted table and the
    changes since then; a key may have several rows, of which its first lookup is one."""
    bases = [v for v in versions(spark, f"{path}/base") if v < before]
    changes = [v for v in versions(spark, f"{path}/changes") if v < before and v > (bases[-1] if bases else -1)]
    parts = [f"{path}/base/v={v}" for v in bases[-1:]] + [f"{path}/changes/v={v}" for v in changes]
    return spark.read.parquet(*parts) if parts else None


def keep_first(stream: DataFrame, spark: SparkSession, path: str, compact_every: int = 16) -> DataFrame:
    """First lookup per (source, market) over all runs of one checkpoint.

    A batch writes its changes only: keys that it saw first, or earlier than known. After every `compact_every`
    batches the changes are merged into one table, and what the table before it had merged is deleted; the table
    before stays, so a batch that is replayed finds what it read the first time and writes the same rows again."""
    def store(batch: DataFrame, batch_id: int) -> None:
        fresh, known = first_lookups(batch).select(batch.columns), first_so_far(spark, path, batch_id)
        if known is not None:
            key = F.struct("source", "market_id").alias("__key")  # null-safe
            keyed = fresh.select("*", key)
            rivals = known.select(*batch.columns, key).join(keyed.select("__key"), "__key", "left_semi")
            rivals = rivals.groupBy("__key").agg(F.min(F.struct("ts", "lookup_id")).alias("__known"))
            better = F.col("__known").isNull() | (F.struct("ts", "lookup_id") < F.col("__known"))
            fresh = keyed.join(rivals, "__key", "left").where(better).select(batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/changes/v={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            before = [v for v in versions(spark, f"{path}/base") if v < batch_id]
            first_lookups(first_so_far(spark, path, batch_id + 1)).select(batch.columns).write.mode("overwrite").parquet(f"{path}/base/v={batch_id}")
            if before:
                drop_versions(spark, f"{path}/changes", before[-1])
                drop_versions(spark, f"{path}/base", before[-1] - 1)

    q = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    known = first_so_far(spark, path, 1 << 62)
    return first_lookups(known).select(known.columns) if known is not None else first_lookups(spark.createDataFrame([], stream.schema))


def begun(path: str, spark: SparkSession) -> bool:
    """Whether versions of a table are there."""
    try:
        return "v" in spark.read.parquet(path).columns
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def resolve_later(lookups: DataFrame, closed: DataFrame) -> DataFrame:
    """Looks open lookups up again in a newer catalogue; decided ones stay as they are."""
    still = resolve(lookups.filter("status = 'open'").drop("status", "outcome"), closed)
    return lookups.filter("status <> 'open'").unionByName(still.select(lookups.columns))
