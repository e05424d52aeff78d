"""From raw documents to token ids: toxic texts go, then copies, near copies and contaminated texts; the rest is encoded."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import byte_bpe
from voxframe.llm.common import read_table, stored
from voxframe.llm.decontaminate import decontaminate
from voxframe.llm.exact_dedup import exact_dedup
from voxframe.llm.near_join import ngram_jaccard_join
from voxframe.llm.toxicity import fit, score

#: SQL cannot express the learned score, the near-duplicate join and the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filters(stage: Stage) -> Stage:
    """A stage that keeps rows: it sees all columns but doc_id and text under names that it does not use itself."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apart = [c if c in ("doc_id", "text") else f"input_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*apart), sf_dir).toDF(*docs.columns)

    return run


@filters
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic, in one scan. Empty and null texts stay."""
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")), docs.columns).where("predicted = 0").select(docs.columns)


@filters
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of each group of equal texts; of rows that repeat id and text, one."""
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("stay_id"), F.unhex("text_sha256").alias("stay_digest")).distinct()
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.withColumn("row_digest", digest).join(
        stay, (F.col("row_digest") == F.col("stay_digest")) & F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi"
    )
    return rows.dropDuplicates(["doc_id", "row_digest"]).select(docs.columns)


@filters
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies. Rows without an id stay."""
    gone = ngram_jaccard_join(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


@filters
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages in a twentieth of their words or more."""
    gone = decontaminate(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.join(gone, same, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    coded = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
