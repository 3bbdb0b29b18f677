"""The stages of the corpus pipeline: each takes and returns documents (the last one: what became of their texts)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm import bpe, decontaminate, near_copies, pii, quality
from tallycast.llm.common import digest_id, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from rows that are not held out only."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.pmod(digest_id(F.col("doc_id")), F.lit(quality.FOLDS)) != quality.HELD_OUT)
    return quality.kept(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near copies (five-word shingles, Jaccard 0.8 or more). Rows that
    repeat an id and its text are copies: the one with the least digest of its other columns stays. Rows of one id with
    different texts are different documents. A null id is replaced by a negative digest of the text while comparing."""
    stand_in = -1 - F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    keyed = docs.select(F.coalesce("doc_id", stand_in).alias("key"), F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row"))
    groups = near_copies.near_copies(keyed.select(F.col("key").alias("doc_id"), "row.text"))
    kept = groups.select(F.col("component_id").alias("key"), F.col("component_h").alias("h")).distinct()
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"row.{c}") for c in docs.columns if c != "text"], F.lit(0))))
    return keyed.join(kept, ["key", "h"], "left_semi").groupBy("key", "h").agg(F.min_by("row", others).alias("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    hashed = docs.withColumn("__text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return hashed.join(bad, hashed.doc_id.eqNullSafe(bad["__id"]) & (hashed["__text"] == bad["__h"]), "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; `n_chars` follows the text."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number and digests of their token ids instead of the text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return tokens.select(
        *[c for c in tokens.columns if c not in ("token_ids", "decoded")], F.size("token_ids").cast("long").alias("n_tokens"), bpe.joined_digest("token_ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
