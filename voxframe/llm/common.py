"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import shared_dir

#: Rows of at most this many may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to a table of its own in the shared folder and read it again.

    It cuts the lineage: a lost executor costs no more than the running step.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if a count shows that the side is small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def run_of(runs: int, *columns: str) -> Column:
    """A number under `runs`, the same for the same row wherever it is computed."""
    return F.pmod(F.xxhash64(*columns), F.lit(runs)).cast("int")
