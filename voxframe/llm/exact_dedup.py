"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import run_of, stored

#: A digest is checked by a second hash and the length; only rows that agree in all three are equal.
DIGEST = ["digest", "check_hash", "check_bytes"]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: int = 256) -> DataFrame:
    """(doc_id, digest columns, run) of every row. Null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.xxhash64(whole).alias("check_hash"),
        F.octet_length(whole).alias("check_bytes"),
    ).withColumn("run", run_of(runs, "doc_id", "check_hash"))


def merge_runs(leaves: DataFrame, runs: int = 256, ways: int = 16, keep: str = "largest") -> DataFrame:
    """Merge runs `ways` at a time until one is left; (digest columns, keep_id, group_size).

    In each round the runs of a block of `ways` meet: partitions exchange them by block and
    digest, sort, and merge equal neighbours into the identifier that stays and a count (the
    struct makes Spark aggregate over sorted rows). A digest held by a third of all rows is
    spread over all runs in the first round and is one row per run afterwards, so no task
    receives more than its share.
    """
    best = F.max if keep == "largest" else F.min
    level = leaves.select("run", *DIGEST, F.struct("doc_id").alias("best"), F.lit(1).cast("long").alias("rows"))
    blocks = runs
    while True:
        level = level.groupBy("run", *DIGEST).agg(best("best").alias("best"), F.sum("rows").alias("rows"))
        if blocks == 1:
            return level.select(*DIGEST, F.col("best.doc_id").alias("keep_id"), F.col("rows").alias("group_size"))
        blocks = -(-blocks // ways)
        level = level.withColumn("run", F.floor(F.col("run") / ways).cast("int"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: int = 256, ways: int = 16, keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, byte for byte; null counts as empty. The largest (or
    smallest) id of a group stays. Rows that repeat both id and text are all marked kept and
    all counted in group_size. A null id never wins over another; in a group of null ids
    alone keep_id is null and its rows are marked kept. No rows give no rows; further
    columns are ignored.
    """
    leaves = stored(digests(docs, text, doc_id, runs), "digests")
    if keep == "smallest":  # a struct with a null id would be the smallest
        winners = merge_runs(leaves.where("doc_id IS NOT NULL"), runs, ways, keep).select(*DIGEST, "keep_id")
        sizes = merge_runs(leaves, runs, ways, keep).select(*DIGEST, "group_size")
        winners = sizes.join(winners, DIGEST, "left")
    else:
        winners = merge_runs(leaves, runs, ways, keep)
    # back down the tree: to the runs, where a frequent digest has one row per run, then to the rows
    per_run = leaves.select("run", *DIGEST).distinct().join(winners, DIGEST)
    return leaves.join(per_run, ["run", *DIGEST]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
