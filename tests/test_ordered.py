"""Block operators against plain Python, with blocks far smaller than a series."""

import random

import pytest
from pyspark.sql import functions as F

from voxframe.operators import ordered

BLOCK = 7


@pytest.fixture(scope="module")
def series():
    """Key 'hot' holds most rows; positions are dense per key, ts irregular."""
    rng = random.Random(3)
    rows = []
    for key, n in [("hot", 240), ("a", 31), ("b", 8), ("c", 1)]:
        ts = 0.0
        for i in range(n):
            ts += rng.choice([0.0, 1.0, 2.5, 40.0]) if i else 0.0
            rows.append((key, ts, i, round(rng.uniform(0, 10), 2)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, series):
    df = spark.createDataFrame(series, "k string, ts double, idx bigint, x double")
    blocked = ordered.with_block(df, "ts", rows_per_block=BLOCK)
    assert blocked.select("block").distinct().count() > 5
    return blocked


def by_key(series):
    out = {}
    for k, ts, i, x in series:
        out.setdefault(k, []).append((ts, i, x))
    return out


def test_position(frames):
    got = ordered.with_position(frames, ["k"], ["ts", "idx"], "block", "pos").collect()
    assert all(r.pos == r.idx for r in got) and len(got) == 280


@pytest.mark.parametrize("how,fold", [("sum", lambda a, b: a + b), ("min", min), ("max", max)])
def test_prefix(frames, series, how, fold):
    got = {(r.k, r.idx): r.p for r in ordered.prefix(frames, ["k"], ["ts", "idx"], "block", {"p": F.col("x")}, how).collect()}
    for k, rows in by_key(series).items():
        run = None
        for _, i, x in rows:
            run = x if run is None else fold(run, x)
            assert got[(k, i)] == pytest.approx(run)


def test_runs(frames, series):
    got = ordered.runs(frames, ["k"], "idx", "block", F.col("x") >= 2, {"top": (F.col("x"), "max")}).collect()
    want = set()
    for k, rows in by_key(series).items():
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or (rows[i][2] >= 2) != (rows[start][2] >= 2):
                want.add((k, rows[start][2] >= 2, start, i - start, max(r[2] for r in rows[start:i])))
                start = i
    assert {(r.k, r.flag, r.start_idx, r.n_frames, r.top) for r in got} == want
    assert len(got) == len(want)


def test_one_run_over_many_blocks(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("idx"), F.floor(F.col("id") / 3).alias("block"))
    got = ordered.runs(df, ["k"], "idx", "block", F.lit(True)).collect()
    assert [(r.start_idx, r.n_frames) for r in got] == [(0, 100)]


def test_neighbours(frames, series):
    made = {"m": lambda w: F.sum("x").over(w.rowsBetween(-2, 3))}
    got = {(r.k, r.idx): r.m for r in ordered.neighbours(frames, ["k"], "idx", 2, 3, made, rows_per_block=5).collect()}
    assert len(got) == 280
    for k, rows in by_key(series).items():
        for _, i, _ in rows:
            assert got[(k, i)] == pytest.approx(sum(r[2] for r in rows[max(0, i - 2) : i + 4]))


def test_fill_forward(frames, series):
    seen = F.when(F.col("x") > 8, F.col("x"))
    got = {(r.k, r.idx): r.s for r in ordered.fill_forward(frames, ["k"], ["ts", "idx"], "block", {"s": seen}).collect()}
    for k, rows in by_key(series).items():
        last = None
        for _, i, x in rows:
            last = x if x > 8 else last
            assert got[(k, i)] == last


def test_order_statistics(frames, series):
    ranks = {"lo": lambda n: F.floor(n * 0.1), "hi": lambda n: F.floor(n * 0.9)}
    for row in ordered.order_statistics(frames, ["k"], "x", ranks, rows_per_block=BLOCK).collect():
        values = sorted(r[2] for r in by_key(series)[row.k])
        assert (row.lo, row.hi) == (values[int(len(values) * 0.1)], values[int(len(values) * 0.9)])


def test_order_statistics_without_keys(frames, series):
    row = ordered.order_statistics(frames, [], "x", {"mid": lambda n: F.floor(n / 2)}, rows_per_block=BLOCK).first()
    values = sorted(r[3] for r in series)
    assert row.mid == values[len(values) // 2]


def test_ema_over_stretches(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(1, 9000), 3) for _ in range(5000)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, idx bigint, v double")
    got = {r.idx: r.ema for r in ordered.ema(df, ["k"], "idx", "v", 0.3).collect()}
    run = values[0]
    for i, v in enumerate(values):
        run = v if i == 0 else 0.3 * v + 0.7 * run
        assert got[i] == pytest.approx(run, rel=1e-12)


def test_ema_small_case(spark):
    df = spark.createDataFrame([("s", 0, 3000.0), ("s", 1, 3000.0), ("s", 2, 9000.0)], "k string, idx bigint, v double")
    assert [r.ema for r in ordered.ema(df, ["k"], "idx", "v", 0.3).orderBy("idx").collect()] == pytest.approx([3000, 3000, 4800])


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.6, 0.9, 1.0])
def test_ema_for_every_alpha(spark, alpha):
    values = [float((i * 7919) % 101) for i in range(5000)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, idx bigint, v double")
    got = [r.ema for r in ordered.ema(df, ["k"], "idx", "v", alpha).orderBy("idx").collect()]
    want, last = [], values[0]
    for v in values:
        last = alpha * v + (1 - alpha) * last
        want.append(last)
    assert got == pytest.approx(want, rel=1e-9)


def test_null_keys_and_null_order_values_stay(spark):
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 1, 3.0), (None, None, 4.0), ("a", 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, ts bigint, v double")
    blocked = ordered.with_block(df, "ts", 2)
    placed = ordered.with_position(blocked, ["k"], ["ts"], "block")
    assert sorted((r.k or "", r.v, r.frame_idx) for r in placed.collect()) == [("", 3.0, 1), ("", 4.0, 0), ("a", 1.0, 1), ("a", 2.0, 0), ("a", 5.0, 2)]
    filled = ordered.fill_forward(blocked, ["k"], ["ts"], "block", {"last": F.col("v")})
    assert filled.count() == 5
    assert ordered.order_statistics(df, ["k"], "v", {"low": lambda n: F.lit(0)}).count() == 2
    assert ordered.ema(placed, ["k"], "frame_idx", "v", 0.5).count() == 5


def test_blocks_hold_about_as_many_rows_each(spark):
    """An outlier, a burst and more blocks than quantiles; numbers follow the order."""
    n = 40_000
    df = spark.range(n).select((F.when(F.col("id") < n // 2, F.col("id") / 1e6).otherwise(F.col("id"))).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([(1e12,), (None,), (float("nan"),)], "x double"))
    for target in (1000, 20):
        blocked = ordered.with_block(df, "x", target)
        sizes = {r.block: r for r in blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        assert sizes.pop(-1).n == 1 and sum(r.n for r in sizes.values()) == n + 2
        assert max(r.n for r in sizes.values()) <= 2 * target + 8
        order = [sizes[b] for b in sorted(sizes)]
        assert all(a.hi < b.lo for a, b in zip(order, order[1:]))
    assert ordered.with_block(df.limit(0), "x").count() == 0
    spark.conf.set(ordered.BLOCK_CONF, "500")
    try:
        assert ordered.with_block(df, "x").select("block").distinct().count() > 60
    finally:
        spark.conf.unset(ordered.BLOCK_CONF)
