"""Time-warp alignment of whole contours, pair by pair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions import kernels
from voxframe.functions.scalar import clamp
from voxframe.operators.ordered import ROWS_PER_BLOCK, with_position
from voxframe.operators.wavefront import TILE, warp_tiled


def warp(ref: DataFrame, syn: DataFrame, keys: Sequence[str], idx: str = "frame_idx", value: str = "value", tile: int = TILE) -> DataFrame:
    """Alignment path of every pair, with the paired values.

    Whole series are aligned, in the order of ``idx``; rows of null keys have no partner. A
    pair whose sides both fit into one tile is one task. A longer pair is cut into tiles of its
    cost matrix (``wavefront``), which many tasks share; the path is the same.
    """
    ref, syn = (_side(df, keys, idx, value) for df in (ref, syn))
    long, diagonals = _long_pairs(ref, syn, keys, tile)
    if not diagonals:
        return _warp_whole(ref, syn, keys)
    short = _warp_whole(ref.join(long, list(keys), "left_anti"), syn.join(long, list(keys), "left_anti"), keys)
    tiled = warp_tiled(ref.join(long, list(keys), "left_semi"), syn.join(long, list(keys), "left_semi"), keys, diagonals, tile)
    return short.unionByName(tiled)


def _side(df: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """(keys, _i, _x), _i the place of a row in its series."""
    # new column identities, as both sides often come from one table
    named = [F.col(k).alias(k) for k in keys]
    cut = df.select(*named, F.col(idx).alias("_at"), F.col(value).cast("double").alias("_x")).dropna(subset=list(keys))
    placed = with_position(cut.withColumn("_block", F.floor(F.col("_at") / ROWS_PER_BLOCK)), keys, ["_at"], "_block", "_i")
    return placed.select(*keys, "_i", "_x")


def _long_pairs(ref: DataFrame, syn: DataFrame, keys: Sequence[str], tile: int) -> tuple[DataFrame, int]:
    """Keys of the pairs with a side longer than a tile, and the most tile diagonals that one has."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = count(ref, "_n").join(count(syn, "_m"), list(keys)).where(F.greatest("_n", "_m") > tile)
    most = sizes.agg(F.max(F.ceil(F.col("_n") / tile) + F.ceil(F.col("_m") / tile) - 1)).first()[0]
    return sizes.select(*keys), int(most or 0)


def _warp_whole(ref: DataFrame, syn: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = T.StructType(
        [
            *[ref.schema[k] for k in keys],
            T.StructField("path_pos", T.LongType()),
            T.StructField("ref_idx", T.LongType()),
            T.StructField("syn_idx", T.LongType()),
            T.StructField("ref_value", T.DoubleType()),
            T.StructField("syn_value", T.DoubleType()),
        ]
    )
    names = [f.name for f in out.fields]

    def align(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = left.sort_values("_i")["_x"].to_numpy(float)
        b = right.sort_values("_i")["_x"].to_numpy(float)
        path = kernels.warp_path(a, b)
        if not len(path):
            return pd.DataFrame(columns=names)
        cols = [np.repeat(k, len(path)) for k in key]
        cells = [*cols, np.arange(len(path)), path[:, 0], path[:, 1], a[path[:, 0]], b[path[:, 1]]]
        return pd.DataFrame(dict(zip(names, cells)))

    # a stated count keeps AQE from merging small but slow Python partitions
    parts = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ref, syn = (df.repartition(parts, *keys) for df in (ref, syn))
    return ref.groupBy(*keys).cogroup(syn.groupBy(*keys)).applyInPandas(align, out)


def contour_correlation(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson correlation along the path; 0 when there is no variation."""
    stats = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("ref_value", "syn_value").alias("_cov"),
        F.sqrt(F.var_pop("ref_value") * F.var_pop("syn_value")).alias("_sd"),
    )
    # not F.corr: in ANSI mode it fails on a constant side
    flat = (F.col("n") < 2) | (F.col("_sd") * F.col("n") < 1e-12)
    r = F.when(flat, 0.0).otherwise(clamp(F.try_divide(F.col("_cov"), F.col("_sd")), -1.0, 1.0))
    return stats.select(*keys, "n", r.alias("correlation"))
