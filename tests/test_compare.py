import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import kernels, tables, verdicts
from voxframe.functions.scalar import goertzel, hz_to_mel, linspace, mel_to_hz, rnd
from voxframe.operators import alignment, compare, sessions


@pytest.mark.parametrize("pct,want", [(0.0, "close"), (14.9, "close"), (15.0, "near"), (34.9, "near"), (35.0, "far"), (59.9, "far"), (60.0, "very far"), (100.0, "very far")])
def test_gap_verdict(spark, pct, want):
    assert spark.range(1).select(verdicts.gap_verdict(F.lit(pct)).alias("x")).first().x == want


def test_gap_uses_unrounded_value_for_the_verdict(spark):
    metrics = spark.createDataFrame([("s", "Loudness", 1.4996)], "series_id string, metric string, value double")
    targets = spark.createDataFrame([("Loudness", 0.0)], "metric string, target double")
    row = compare.gap_table(metrics, targets, compare.metric_definitions(metrics)).first()
    assert (row.gap_pct, row.verdict) == (15.0, "close")


def test_new_metric_is_a_row(spark):
    metrics = spark.createDataFrame([("s", "Custom", 3.0)], "series_id string, metric string, value double")
    targets = spark.createDataFrame([("Custom", 1.0)], "metric string, target double")
    defs = compare.metric_definitions(metrics, [("Custom", "x", 4.0)])
    assert compare.gap_table(metrics, targets, defs).first().gap_pct == 50.0


def test_alignment_of_missing_pause(spark):
    ref = "series_id int, ordinal bigint, label string, start_s double, end_s double"
    run = "series_id int, ordinal bigint, start_s double, end_s double, rms_db double"
    words = spark.createDataFrame([(1, 0, "a", 0.0, 0.5), (1, 1, "b", 0.6, 1.0)], ref)
    pauses = spark.createDataFrame([(1, 0, "a", 0.5, 0.6)], ref)
    voiced = spark.createDataFrame([(1, 0, 0.0, 0.5, -10.0)], run)
    pairs = compare.align_by_position(words, pauses, voiced, voiced.limit(0))
    assert {(r.label, r.status) for r in pairs.collect()} == {("a", "ok"), ("[pause after 'a'] MISSING", "missing")}
    row = compare.alignment_summary(pairs).first()
    assert (row.worst_pause_ratio, row.mean_duration_ratio) == (0.0, 0.5)


def brute_path(a, b):
    n, m = len(a), len(b)
    cost = [[math.inf] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            prev = 0.0 if i == j == 0 else min(
                cost[i - 1][j - 1] if i and j else math.inf, cost[i - 1][j] if i else math.inf, cost[i][j - 1] if j else math.inf
            )
            cost[i][j] = prev + abs(a[i] - b[j])
    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        if i and j:
            best = min(cost[i - 1][j - 1], cost[i - 1][j], cost[i][j - 1])
            if best == cost[i - 1][j - 1]:
                i, j = i - 1, j - 1
            elif best == cost[i - 1][j]:
                i -= 1
            else:
                j -= 1
        elif i:
            i -= 1
        else:
            j -= 1
        path.append((i, j))
    return path[::-1]


@pytest.mark.parametrize("n,m", [(1, 1), (1, 6), (7, 1), (12, 9), (20, 33)])
def test_warp_path(n, m):
    rng = random.Random(n * 100 + m)
    a, b = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 5) for _ in range(m)]
    assert [tuple(p) for p in kernels.warp_path(np.array(a), np.array(b))] == brute_path(a, b)


def contour(spark, values, pair=1):
    return spark.createDataFrame([(pair, i, float(v)) for i, v in enumerate(values)], "pair_id int, frame_idx bigint, value double")


def test_contour_correlation(spark):
    short = contour(spark, [math.sin(i / 100 * 2 * math.pi) for i in range(100)])
    long = contour(spark, [math.sin(i / 150 * 2 * math.pi) for i in range(150)])
    flat = contour(spark, [1.0] * 100)
    run = lambda a, b: alignment.contour_correlation(alignment.warp(a, b, ["pair_id"]), ["pair_id"]).first().correlation
    assert run(short, long) > 0.9
    assert run(short, flat) == 0.0


def test_warp_aligns_whole_series(spark):
    path = alignment.warp(contour(spark, range(3000)), contour(spark, range(2500)), ["pair_id"])
    assert tuple(path.agg(F.max("ref_idx"), F.max("syn_idx")).first()) == (2999, 2499)


def test_warp_path_does_not_depend_on_the_stride():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 130), rng.integers(0, 5, 90)
    whole = kernels.warp_path(a, b, 10_000)
    for stride in (1, 2, 7, 64, 219):
        assert (kernels.warp_path(a, b, stride) == whole).all()
    assert [tuple(p) for p in whole] == brute_path(list(a), list(b))


def test_tempo_ratio_takes_whole_timelines(spark):
    """A synthetic segment that is no first match (the second here) still counts for the ratio."""
    ref, syn = contour(spark, [1.0, 1.0]), contour(spark, [1.0, 1.0, 5.0])
    path = alignment.warp(ref, syn, ["pair_id"]).withColumnsRenamed({"ref_value": "ref_duration_s", "syn_value": "syn_duration_s"})
    matches = compare.tempo_matches(path.withColumn("kind", F.lit("voiced")))
    totals = spark.createDataFrame([(1, 2.0, 7.0)], "pair_id int, ref_total_s double, syn_total_s double")
    got = compare.tempo_summary(matches, totals).first()
    assert (got.overall_ratio, got.rushed, got.drawn_out) == (3.5, 0, 1)
    odd = alignment.warp(contour(spark, [1.0, 4.0, 1.0]), contour(spark, [1.0, 2.0, 1.5]), ["pair_id"])
    odd = odd.withColumnsRenamed({"ref_value": "ref_duration_s", "syn_value": "syn_duration_s"}).withColumn("kind", F.lit("voiced"))
    assert [(r.ref_idx, r.tempo) for r in compare.tempo_outliers(compare.tempo_matches(odd)).orderBy("ref_idx").collect()] == [(1, "rushed"), (2, "drawn out")]


def test_region_centres(spark):
    schema = "k string, i bigint, a double, b double, block bigint"
    same = spark.createDataFrame([("s", i, 0.5, 0.5, i) for i in range(3)], schema)
    assert sessions.distinct_regions(same, ["k"], "i", ["a", "b"]).count() == 1
    rng = random.Random(8)
    points = [(rng.random(), rng.random()) for _ in range(90)]
    rows = [("s", i, x, y, i // 10) for i, (x, y) in enumerate(points)]
    got = sorted(r.i for r in sessions.distinct_regions(spark.createDataFrame(rows, schema), ["k"], "i", ["a", "b"]).collect())
    centres = []
    for i, p in enumerate(points):
        if all(math.dist(p, points[c]) > 0.25 for c in centres):
            centres.append(i)
    assert got == centres


def test_best_three(spark):
    df = spark.createDataFrame([("r", s) for s in (5.0, 1.0, 1.05, 1.09, 1.2, 1.25, 3.0)], "run string, score double")
    got = compare.best_three(df, ["run"]).orderBy("rank").collect()
    assert [r.score for r in got] == [1.0, 1.2, 3.0]


def test_upsert_keeps_every_result(spark):
    old = spark.createDataFrame([("auto-1 (9%)", 1.0), ("mine", 2.0)], "name string, v double")
    new = spark.createDataFrame([(f"auto-{i} (5%)", float(i)) for i in (1, 2, 3)], "name string, v double")
    assert {r.name for r in compare.upsert_presets(old, new).collect()} == {"mine", "auto-1 (5%)", "auto-2 (5%)", "auto-3 (5%)"}


def test_unpaired_is_infinite(spark):
    ids = spark.createDataFrame([(1,), (2,)], "pair_id int")
    found = spark.createDataFrame([(1, 0.5)], "pair_id int, mcd double")
    assert {r.pair_id: r.mcd for r in compare.with_unpaired(found, ids, ["pair_id"]).collect()} == {1: 0.5, 2: math.inf}


def test_cosine_bounds(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(compare.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == pytest.approx([1.0, 0.0, -1.0])


def test_custom_policy_and_fallback(spark):
    knobs = {"tilt_low_db": 0.0, "tilt_high_db": 0.0, "rms_target_lufs": -16.0, "presence_db": 0.0, "de_harsh_db": 0.0}
    measured = {**tables.CONTROLLER["targets"], "loudness_db": -14.5}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {**knobs, **measured}.items()])
    plain = compare.correct_knobs(df).first()
    assert plain.new_rms_target_lufs == pytest.approx(-16.0 + 1.0 / 0.975 * 0.9)
    assert plain.new_tilt_low_db == 0.0
    override = lambda err, k: {"rms_target_lufs": k["rms_target_lufs"] + 1.0, "tilt_low_db": F.lit(None).cast("double")}
    custom = compare.correct_knobs(df, policy=override).first()
    assert custom.new_rms_target_lufs == -15.0 and custom.new_tilt_low_db == 0.0


def test_grid_points(spark):
    cols = ", ".join(f"lo_{a} double, hi_{a} double" for a in ("exaggeration", "cfg_weight", "temperature"))
    bounds = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], cols)
    assert [compare.parameter_grid(bounds, n).count() for n in (3, 4)] == [27, 64]
    assert compare.parameter_grid(bounds, 1).first().exaggeration == 0.5


def test_scalars(spark):
    row = spark.range(1).select(
        rnd(F.lit(2.345), 1).alias("a"),
        rnd(F.lit(-0.00001), 3).alias("z"),
        mel_to_hz(hz_to_mel(F.lit(440.0))).alias("hz"),
        linspace(F.lit(0.0), F.lit(1.0), 5).alias("l"),
        goertzel(F.transform(F.sequence(F.lit(0), F.lit(799)), lambda i: F.sin(i * 2 * math.pi * 100 / 8000)), 100.0, 8000).alias("g"),
    ).first()
    assert row.a == 2.3 and str(row.z) == "0.0" and row.hz == pytest.approx(440.0)
    assert row.l == pytest.approx([0, 0.25, 0.5, 0.75, 1.0]) and row.g == pytest.approx(400.0, rel=1e-3)
