"""A corpus pipeline: each stage takes what its predecessor kept, is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallycast.llm import stages
from tallycast.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", stages.keep_good),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("personal_data", stages.mask_personal_data),
    ("byte_bpe", stages.encode_texts),
]

#: The fitted classifier of the first stage has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
