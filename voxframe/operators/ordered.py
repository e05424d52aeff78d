"""Ordered operators that never need a whole series in one task.

A window partitioned by the series alone puts a hot series (a clip, session or
user holding a large share of all rows) into one task.  Everything here works on
*blocks* instead: a block is a stretch of one series, numbered monotonically in
the ordering column.  Each operator

1. does its row-level work in windows over ``(series, block)``,
2. reduces every block to one summary row,
3. scans the summaries (rows / block size of them) to get what flows *into* a
   block, and
4. joins that back on ``(series, block)``, which the rows are already
   partitioned by.

``block_of`` sizes blocks from the row count, so small inputs have one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BLOCK = 250_000
BLOCK_CONF = "spark.voxframe.rowsPerBlock"
QUANTILES = 1024

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _as_number(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the summary of its keys, null keys meeting null keys."""
    named = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in summary.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, same).drop(*[f"_k_{k}" for k in keys])


def block_of(df: DataFrame, column: str, rows_per_block: int | None = None) -> Column:
    """Block number of an ordering column, monotone in it, for blocks of about equal row counts.

    One aggregation over the input gives the row count and up to 1024 quantiles; they enter
    the plan as literals, so every use of the column sees the same borders. Outlying and
    bursty values therefore do not fill a block. Where more blocks are wanted than there are
    quantiles, each stretch between two of them is cut into equal widths. The target size is
    ``rows_per_block``, else the session's ``spark.voxframe.rowsPerBlock``, else
    ``ROWS_PER_BLOCK``. Equal values share a block. A null ordering value comes first, in a
    block of its own (-1); NaN is in the last block.
    """
    x = _as_number(df, column).cast("double")
    target = rows_per_block or int(df.sparkSession.conf.get(BLOCK_CONF, str(ROWS_PER_BLOCK)))
    marks = [i / QUANTILES for i in range(QUANTILES + 1)]
    stats = df.agg(F.count(x).alias("n"), F.percentile_approx(F.when(~F.isnan(x), x), marks).alias("at")).first()
    blocks = -(-stats["n"] // target)
    if blocks <= 1 or not stats["at"]:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    pieces = min(blocks, QUANTILES)
    cells = -(-blocks // pieces)
    edges = sorted({stats["at"][i * QUANTILES // pieces] for i in range(pieces + 1)})
    inner = edges[1:-1]
    piece = F.lit(0)
    if inner:
        # first among every 32nd border, then among the 32 from there on
        tops = F.array(*map(F.lit, inner[::32]))
        group = F.greatest(F.size(F.filter(tops, lambda e: e <= x)) - 1, F.lit(0)) * 32
        piece = group + F.size(F.filter(F.slice(F.array(*map(F.lit, inner)), group + 1, 32), lambda e: e <= x))
    block = piece.cast("bigint") * cells
    if cells > 1 and len(edges) > 1:
        low, high = (F.element_at(F.array(*map(F.lit, side)), piece + 1) for side in (edges[:-1], edges[1:]))
        cell = F.floor((x - low) / (high - low) * cells)
        block = block + F.when(F.isnan(x), cells - 1).otherwise(F.greatest(F.lit(0), F.least(cell, F.lit(cells - 1))))
    return F.when(x.isNull(), F.lit(-1).cast("bigint")).otherwise(block)


def with_block(df: DataFrame, order: str, rows_per_block: int | None = None, name: str = "block") -> DataFrame:
    return df.withColumn(name, block_of(df, order, rows_per_block))


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: str,
    values: dict[str, Column],
    how: str = "sum",
) -> DataFrame:
    """Inclusive running sum / min / max per key, without a per-key window."""
    merge = _MERGE[how]
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    combine = {
        "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + local,
        "min": lambda carry, local: F.least(carry, local),
        "max": lambda carry, local: F.greatest(carry, local),
    }[how]

    local = df.select("*", *[merge(v).over(inside).alias(f"_l_{n}") for n, v in values.items()])
    totals = df.groupBy(*keys, block).agg(*[merge(v).alias(f"_t_{n}") for n, v in values.items()])
    carry = totals.select(*keys, block, *[merge(f"_t_{n}").over(before).alias(f"_c_{n}") for n in values])
    kept = [c for c in df.columns if c not in values]
    return _attach(local, carry, [*keys, block]).select(
        *kept, *[combine(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n in values]
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: str, name: str = "frame_idx"
) -> DataFrame:
    """Zero-based position of every row within its key."""
    ranked = prefix(df, keys, order, block, {name: F.lit(1).cast("bigint")})
    return ranked.withColumn(name, F.col(name) - 1)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    block: str,
    flag: Column,
    aggs: dict[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Maximal runs of equal ``flag`` over consecutive positions.

    Runs are first built inside blocks.  Only the first and last run of a block
    can continue in a neighbour, so only those are brought together per series;
    the rest stay grouped by block.  ``aggs`` maps a name to (value, sum|min|max).
    """
    aggs = aggs or {}
    inside = Window.partitionBy(*keys, block).orderBy(idx)
    marked = df.withColumn("_flag", flag)
    changed = F.coalesce((F.col("_flag") != F.lag("_flag").over(inside)).cast("int"), F.lit(1))
    numbered = marked.withColumn("_chg", changed).withColumn("_run", F.sum("_chg").over(inside))
    partial = numbered.groupBy(*keys, block, "_run", "_flag").agg(
        F.min(idx).alias("start_idx"),
        F.count(F.lit(1)).alias("n_frames"),
        *[_MERGE[how](value).alias(name) for name, (value, how) in aggs.items()],
    )
    whole = Window.partitionBy(*keys, block)
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(whole))
    grouped = partial.withColumn("_grp", F.when(edge, F.lit(-1).cast("bigint")).otherwise(F.col(block).cast("bigint")))
    across = Window.partitionBy(*keys, "_grp").orderBy("start_idx")
    continues = (F.lag("_flag").over(across) == F.col("_flag")) & (
        F.lag(F.col("start_idx") + F.col("n_frames")).over(across) == F.col("start_idx")
    )
    joined = grouped.withColumn("_new", F.when(continues, 0).otherwise(1)).withColumn(
        "_gid", F.sum("_new").over(across)
    )
    return joined.groupBy(*keys, "_grp", "_gid").agg(
        F.first("_flag").alias("flag"),
        F.min("start_idx").alias("start_idx"),
        F.sum("n_frames").alias("n_frames"),
        *[_MERGE[how](name).alias(name) for name, (_, how) in aggs.items()],
    ).drop("_grp", "_gid")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    before: int,
    after: int,
    columns: dict[str, Callable[[Window], Column]],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Columns over a bounded row frame (``lag``, centred averages, dilation).

    Rows within ``before``/``after`` of a block edge are copied to the neighbour
    block, so the windows are exact and bounded by the block size.  Each entry of
    ``columns`` gets the ordered window and returns a column; it may look at most
    ``before`` rows back and ``after`` rows ahead.
    """
    homes = F.sequence(
        F.floor((F.col(idx) - F.lit(after)) / rows_per_block),
        F.floor((F.col(idx) + F.lit(before)) / rows_per_block),
    )
    spread = df.select("*", F.explode(homes).alias("_home"))
    window = Window.partitionBy(*keys, "_home").orderBy(idx)
    return (
        spread.select("*", *[make(window).alias(name) for name, make in columns.items()])
        .filter(F.col("_home") == F.floor(F.col(idx) / rows_per_block))
        .drop("_home")
    )


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, columns: dict[str, Column]
) -> DataFrame:
    """Latest non-null value at or before each row (the as-of lookup)."""
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_l_{n}") for n, v in columns.items()])
    at = F.struct(*order)
    lasts = df.groupBy(*keys, block).agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_t_{n}") for n, v in columns.items()]
    )
    carry = lasts.select(
        *keys, block, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in columns]
    )
    kept = [c for c in df.columns if c not in columns]
    return _attach(local, carry, [*keys, block]).select(
        *kept, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in columns]
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    rows_per_block: int | None = None,
) -> DataFrame:
    """The value at an exact zero-based rank per key, e.g. ``floor(n * 0.1)``.

    Equal values are counted before anything is ordered, then ranks are running
    counts over blocks of the value range.  ``ranks`` maps an output name to a
    function from the key's row count to the wanted rank.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    blocked = with_block(counted, value, rows_per_block, "_vblock")
    upto = prefix(blocked, keys, [value], "_vblock", {"_upto": F.col("_n")})
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("n_rows"))
    hit = _attach(upto, sizes, keys) if keys else upto.withColumn("n_rows", sizes.scalar())
    picks = []
    for name, rank in ranks.items():
        at = rank(F.col("n_rows"))
        inside = (at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return hit.groupBy(*keys, "n_rows").agg(*picks)


def ema(df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Exponential moving average seeded by the first value, as window sums.

    Inside a stretch of rows the recursion is a weighted running sum.  What enters a
    stretch is the average at the end of the previous one.  The stretch is as long as
    (1-alpha)^stretch stays near 1e-150: weights within it neither overflow nor vanish,
    and what lies more than two stretches back has a weight of 1e-300 or less, so two
    look-backs make the value exact for every alpha.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha lies above 0 and at most at 1")
    if alpha == 1.0:
        return df.withColumn(name, F.col(value).cast("double"))
    keep = 1.0 - alpha
    stretch = max(1, int(345.0 / -math.log(keep)))
    rows = df.withColumn("_s", F.floor(F.col(idx) / stretch)).withColumn("_p", F.col(idx) % stretch)
    inside = Window.partitionBy(*keys, "_s").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col(idx) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    summed = F.sum(weight * F.col(value) * F.pow(F.lit(keep), -F.col("_p"))).over(inside)
    local = rows.withColumn("_e", summed * F.pow(F.lit(keep), F.col("_p")))
    ends = (
        local.groupBy(*keys, "_s")
        .agg(F.max_by("_e", "_p").alias("_end"))
        .withColumn("_s", F.col("_s").cast("bigint"))
    )
    full = keep**stretch
    carried = neighbours(
        ends,
        keys,
        "_s",
        2,
        0,
        {"_in": lambda w: F.lag("_end", 1).over(w) + full * F.coalesce(F.lag("_end", 2).over(w), F.lit(0.0))},
    ).select(*keys, "_s", "_in")
    return _attach(local, carried, [*keys, "_s"]).select(
        *df.columns,
        (F.col("_e") + F.coalesce(F.col("_in") * F.pow(F.lit(keep), F.col("_p") + 1), F.lit(0.0))).alias(name),
    )
