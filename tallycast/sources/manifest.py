"""Dataset manifests, file checks and report text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up

PIECE = 1 << 22


def dataset_summary(meta: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: coverage, counts, YES rate, ranges."""
    m = meta.agg(
        F.countDistinct("market_id").alias("markets_fetched"),
        F.min("start_date").alias("market_start_min"), F.max("start_date").alias("market_start_max"),
    )
    c = clean.agg(
        F.count(F.lit(1)).alias("clean_snapshots"), F.countDistinct("market_id").alias("clean_markets"),
        half_up(F.avg("outcome"), 4).alias("clean_yes_rate"),
        F.min("snapshot_timestamp").alias("snapshot_min"), F.max("snapshot_timestamp").alias("snapshot_max"),
    )
    both = m.withColumn("c", c.select(F.struct("*")).scalar())
    return both.select(*m.columns, "c.*")


def split_summary(clean: DataFrame) -> DataFrame:
    return clean.groupBy("split").agg(
        F.count(F.lit(1)).alias("snapshots"), F.countDistinct("market_id").alias("markets"),
        F.min("snapshot_timestamp").alias("first_ts"), F.max("snapshot_timestamp").alias("last_ts"),
        half_up(F.avg("outcome"), 6).alias("yes_rate"),
    )


def write_manifest(summary: DataFrame, splits: DataFrame, path: str, version: str) -> None:
    """The nested manifest as one JSON file; its inputs are one row and a handful of split rows."""
    nested = splits.agg(F.map_from_entries(F.collect_list(F.struct("split", F.struct(
        "snapshots", "markets", "first_ts", "last_ts", "yes_rate")))).alias("by_split"))
    whole = summary.withColumn("by_split", nested.scalar()).withColumn("version", F.lit(version))
    whole.coalesce(1).write.mode("errorifexists").json(path)


def digest_of(path: str) -> str:
    """SHA-256 of a file of any size, read in pieces of `PIECE` bytes."""
    local = path.startswith("file:") or "://" not in path
    system, inside = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    found = hashlib.sha256()
    with system.open_input_stream(inside, compression=None) as stream:
        while piece := stream.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, bytes, sha256) per file below `path`. Spark lists the files and deals them to tasks by size without
    reading them; a task reads each of its files once, in pieces, so files may be of any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = pa.array([digest_of(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, shas], [*batch.schema.names, "sha256"])

    return files.mapInArrow(run, "path string, file string, bytes long, sha256 string")


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) per Parquet file below `path`; only footers are read, so files may differ in their columns."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    # file_path is an encoded URI; the listing gives plain paths
    plain = F.regexp_replace(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return df.groupBy(plain.alias("path")).agg(F.count(F.lit(1)).alias("rows"))


def integrity(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every file: ok, missing, modified, or unlisted."""
    m = manifest.select("file", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha"))
    same = (F.col("bytes") == F.col("want_bytes")) & (F.col("sha256") == F.col("want_sha"))
    state = (
        F.when(F.col("want_sha").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(same, "ok").otherwise("modified")
    )
    return listing.join(m, "file", "full_outer").select("file", state.alias("state"))


def markdown_table(df: DataFrame) -> str:
    """Report text of a result table of any length, fetched part by part in its order."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("—" if v is None else str(v) for v in row) + " |" for row in df.toLocalIterator()])
