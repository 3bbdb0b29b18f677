"""Helpers of the text operators: tables, written intermediate results, bounded samples of labelled rows."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Taken:
    """Spans (start, end) of a text, asked for an overlap in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def map_texts(docs: DataFrame, text: str, function: Callable[[str | None], Any], field: T.StructField, kind: pa.DataType, keep_text: bool = True) -> DataFrame:
    """`docs` with function(text) as `field`, in the place of a column of that name or last, without the text if so
    wished. The other columns stay in Arrow, so that no number goes through a float where a null stands beside it."""
    fields = [field if f.name == field.name else f for f in docs.schema.fields if keep_text or f.name != text]
    if field not in fields:
        fields.append(field)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([function(x) for x in batch.column(text).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([made if n == field.name else batch.column(n) for n in names], names)

    return docs.mapInArrow(run, T.StructType(fields))


def add_columns(
    df: DataFrame, source: str, start: Callable[[], Callable[[list], list[pa.Array]]], new: list[T.StructField], rows: int = 1 << 30, keep: bool = False
) -> DataFrame:
    """`df` with the columns `new`, made from those of column `source`: a task calls `start` once for a function that
    gives an Arrow array a column for the values of up to `rows` rows. `source` goes unless `keep`. Other columns stay
    in Arrow, so that no number goes through a float where a null stands beside it; none may be named as a new one."""
    fields = [f for f in df.schema.fields if keep or f.name != source]
    names, all_names = [f.name for f in fields], [f.name for f in fields + new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), *function(some.column(source).to_pylist())], all_names)

    return df.mapInArrow(run, T.StructType(fields + new))


def digest_id(column: Column) -> Column:
    """CRC-32 of an id written as text; null for a null id."""
    return F.crc32(column.cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of about `bound` labelled documents at most, chosen by a digest of the id, so that the
    choice depends neither on partitions nor on order. `usable` is a condition on `doc_id`; rows with a null id,
    null label or a label other than 0 and 1 take no part; of rows with one id the largest label and the first text in
    order count.

    `bound` limits what a model is fitted on, never what is scored. The chosen ids are at most about `bound` rows
    of 20 bytes, so they are broadcast to the scan of the documents."""
    usable_rows = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
                   .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
                   .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = usable_rows.count()
    share = min(1.0, bound / n) if n else 1.0
    slots = 1 << 30
    chosen = usable_rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(slots)) < int(slots * share))
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).sortWithinPartitions("doc_id").select("doc_id", "text", "y")
