"""Time-warp alignment of one long pair over many tasks: tiles of the cost matrix, diagonal by diagonal.

Tiles of one anti-diagonal do not depend on each other. A tile takes the last row of the tile
above, the last column of the tile to the left and the corner between, and leaves its own last
row and column. With each border cell it also leaves where the best way to that cell came into
the tile. So the way back from the end hops from tile to tile, and only the tiles on it, at
most one a diagonal and side step, are computed again to give the path within them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxframe.operators.recursions import in_groups, kept
from voxframe.session import shared_dir

TILE = 2048


def fill(a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last row, last column, where they come from, steps) of a tile with the given borders.

    A place of entry is the number of a top border cell counted from one, minus the number of a
    left one, or zero for the corner. A diagonal step wins ties, then a step in ``a``.
    """
    p, q = len(a), len(b)
    rim_top, rim_left = np.concatenate([[corner], top]), np.concatenate([[corner], left])
    steps = np.zeros((p, q), np.int8)
    bottom, right, bottom_from, right_from = np.empty(q), np.empty(p), np.empty(q, np.int32), np.empty(p, np.int32)
    older, last = np.full(p + 1, np.inf), np.full(p + 1, np.inf)
    older_from, last_from = np.zeros(p + 1, np.int32), np.zeros(p + 1, np.int32)
    older[0] = corner
    last[0], last_from[0] = rim_top[1], 1
    last[1], last_from[1] = rim_left[1], -1
    for s in range(2, p + q + 1):
        here, came = np.full(p + 1, np.inf), np.zeros(p + 1, np.int32)
        i = np.arange(max(1, s - q), min(p, s - 1) + 1)
        both, up, side = older[i - 1], last[i - 1], last[i]
        step = np.where((both <= up) & (both <= side), 0, np.where(up <= side, 1, 2)).astype(np.int8)
        here[i] = np.minimum(np.minimum(both, up), side) + np.abs(a[i - 1] - b[s - i - 1])
        came[i] = np.choose(step, [older_from[i - 1], last_from[i - 1], last_from[i]])
        steps[i - 1, s - i - 1] = step
        if s <= q:
            here[0], came[0] = rim_top[s], s
        if s <= p:
            here[s], came[s] = rim_left[s], -s
        if s > p:
            bottom[s - p - 1], bottom_from[s - p - 1] = here[p], came[p]
        if s > q:
            right[s - q - 1], right_from[s - q - 1] = here[s - q], came[s - q]
        older, last, older_from, last_from = last, here, last_from, came
    return bottom, right, bottom_from, right_from, steps


_BORDER = "bottom array<double>, `right` array<double>, bottom_from array<int>, right_from array<int>"


def _borders(row, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    """What enters a tile; the first tile is entered at its corner alone."""
    rim = lambda x, n: np.full(n, np.inf) if x is None else np.asarray(x, float)
    corner = 0.0 if row.ti == 0 and row.tj == 0 else np.inf if row.corner is None or pd.isna(row.corner) else float(row.corner)
    return rim(row.above, q), rim(row.beside, p), corner


def _with_borders(tiles: DataFrame, around: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles with the last row above, the last column beside and the corner between."""
    by = [*keys, "ti", "tj"]
    moved = lambda di, dj, value: around.select(*keys, (F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), value)
    above = moved(1, 0, F.col("bottom").alias("above"))
    beside = moved(0, 1, F.col("right").alias("beside"))
    corner = moved(1, 1, F.element_at("bottom", -1).alias("corner"))
    return tiles.join(above, by, "left").join(beside, by, "left").join(corner, by, "left")


def _strips(df: DataFrame, keys: Sequence[str], number: str, values: str, tile: int) -> DataFrame:
    """(keys, number, values): stretches of a series of (keys, _i, _x), _i its place."""
    cut = df.groupBy(*keys, F.floor(F.col("_i") / tile).cast("int").alias(number)).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return cut.select(*keys, number, F.col("_v._x").alias(values))


def warp_tiled(ref: DataFrame, syn: DataFrame, keys: Sequence[str], diagonals: int, tile: int = TILE) -> DataFrame:
    """Alignment path of pairs of series (keys, _i, _x): keys, path_pos, ref_idx, syn_idx, ref_value, syn_value.

    ``_i`` counts from zero; ``diagonals`` is the largest number of tile diagonals of a pair.
    Keys are not null. Each diagonal is one job over the tiles of all pairs on it, whose
    borders are written to the shared folder.
    """
    spark, keys = ref.sparkSession, list(keys)
    rows, columns = kept(_strips(ref, keys, "ti", "a", tile), "strips"), kept(_strips(syn, keys, "tj", "b", tile), "strips")
    key_fields = [ref.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("ti", T.IntegerType()), T.StructField("tj", T.IntegerType()), *T._parse_datatype_string(_BORDER).fields])
    folder = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"

    def borders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a, b = np.asarray(row.a, float), np.asarray(row.b, float)
                bottom, right, bottom_from, right_from, _ = fill(a, b, *_borders(row, len(a), len(b)))
                yield pd.DataFrame([[*(getattr(row, k) for k in keys), row.ti, row.tj, bottom, right, bottom_from, right_from]], columns=schema.names)

    for d in range(diagonals):
        tiles = rows.join(columns.withColumn("ti", (F.lit(d) - F.col("tj")).cast("int")), [*keys, "ti"])
        back = [f"{folder}/{e}" for e in (d - 1, d - 2) if e >= 0]
        around = spark.read.schema(schema).parquet(*back) if back else spark.createDataFrame([], schema)
        _with_borders(tiles, around, keys).mapInPandas(borders, schema).write.parquet(f"{folder}/{d}")
    done = spark.read.schema(schema).parquet(*[f"{folder}/{d}" for d in range(diagonals)])

    def hop(state: list, row: tuple) -> list[tuple]:
        _, ti, tj, bottom_from, right_from = row
        if state[0] is None:
            state[:] = [ti, tj, len(right_from) - 1, len(bottom_from) - 1]
        if (ti, tj) != (state[0], state[1]):
            return []
        i, j = state[2], state[3]
        # a border cell of a tile left at its last row or column; -1 stands for that of the next tile
        if i == -1:
            i = len(right_from) - 1
        if j == -1:
            j = len(bottom_from) - 1
        origin = bottom_from[j] if i == len(right_from) - 1 else right_from[i]
        if origin > 0:
            state[:] = [ti - 1, tj, -1, origin - 1]
        elif origin < 0:
            state[:] = [ti, tj - 1, -origin - 1, -1]
        else:
            state[:] = [ti - 1, tj - 1, -1, -1]
        return [(ti, tj, i, j)]

    walk = done.select(*keys, (-F.col("ti") - F.col("tj")).alias("_d"), "ti", "tj", "bottom_from", "right_from")
    visited = in_groups(walk, keys, ["_d", "ti"], lambda: [None] * 4, hop, lambda s: [], T.StructType([*key_fields, *T._parse_datatype_string("ti int, tj int, i int, j int").fields]))

    out = T.StructType([*key_fields, *T._parse_datatype_string("ti int, tj int, cells array<struct<ref_idx:bigint,syn_idx:bigint,ref_value:double,syn_value:double>>").fields])

    def paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                a, b = np.asarray(row.a, float), np.asarray(row.b, float)
                steps = fill(a, b, *_borders(row, len(a), len(b)))[4]
                i, j, cells = row.i, row.j, []
                while i >= 0 and j >= 0:
                    cells.append({"ref_idx": row.ti * tile + i, "syn_idx": row.tj * tile + j, "ref_value": float(a[i]), "syn_value": float(b[j])})
                    step = steps[i, j]
                    i, j = i - (step < 2), j - (step != 1)
                yield pd.DataFrame([[*(getattr(row, k) for k in keys), row.ti, row.tj, cells[::-1]]], columns=out.names)

    on_way = visited.join(rows, [*keys, "ti"]).join(columns, [*keys, "tj"])
    parts = kept(_with_borders(on_way, done, keys).mapInPandas(paths, out), "paths")
    before = Window.partitionBy(*keys).orderBy(F.col("ti") + F.col("tj")).rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select(*keys, "ti", "tj", F.coalesce(F.sum(F.size("cells")).over(before), F.lit(0)).alias("_start"))
    cells = parts.join(start, [*keys, "ti", "tj"]).select(*keys, "_start", F.posexplode("cells").alias("_k", "_c"))
    return cells.select(*keys, (F.col("_start") + F.col("_k")).cast("bigint").alias("path_pos"), "_c.ref_idx", "_c.syn_idx", "_c.ref_value", "_c.syn_value")
