"""Similar vectors against brute force, with exact and near copies and a large family."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import similarity


def planted(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(32) for _ in range(300)]
    rows += [rows[i] + rng.standard_normal(32) * 0.35 for i in range(0, 200, 2)]
    hub = rng.standard_normal(32)
    rows += [hub + rng.standard_normal(32) * 0.2 for _ in range(150)] + [hub] * 60 + [rows[5]] * 3
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [16, 2048])
def test_recall_and_numbers(spark, block):
    rows = planted(block)
    odd = [(9000, None), (9020, []), (9040, [0.0] * 32), (9060, [1.0, 2.0]), (9080, [1.0, 2.1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<double>").withColumn("block", F.lit(1)).withColumn("first", F.lit(2))
    got = {r.vec_id: r for r in similarity.similar_vectors(df, "vec_id", "v", F.col("vec_id") % 5 == 0, block=block).collect()}
    assert set(got) == {i for i, _ in rows + odd if i % 5 == 0}
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T
    np.fill_diagonal(near, -1)
    wanted = found = 0
    for i in range(0, len(rows), 5):
        links = int((near[i] >= 0.8).sum())
        wanted, found = wanted + links, found + got[i].n_links
        assert got[i].n_links <= links
        if got[i].n_links == links and links:
            assert abs(got[i].similarity - near[i].max()) < 1e-9 and abs(near[i][got[i].best_id] - near[i].max()) < 1e-9
    assert wanted > 5000 and found / wanted > 0.99
    assert [got[i].n_links for i in (9000, 9020, 9040, 9060, 9080)] == [0, 0, 0, 1, 1] and got[9060].best_id == 9080


def test_more_bits_for_more_rows():
    for rows, threshold in ((10, 0.9), (10**6, 0.8)):
        bits, bands = similarity.banding(rows, threshold, 0.99)
        assert 1 - (1 - (1 - np.arccos(threshold) / np.pi) ** bits) ** bands >= 0.99 and 2**bits > rows


def test_no_vectors(spark):
    assert similarity.similar_vectors(spark.createDataFrame([], "vec_id long, v array<double>"), "vec_id", "v", F.lit(True)).count() == 0


def test_bands_as_many_as_pay():
    """A row goes to a few buckets, not to hundreds, and small tables are met whole."""
    assert similarity.cheapest_banding(50_000, 2_500, 0.8, 0.995) == (0, 1)
    for rows in (300_000, 3_000_000):
        bits, bands = similarity.cheapest_banding(rows, rows // 20, 0.8, 0.995)
        assert bands < 60 and 1 - (1 - (1 - np.arccos(0.8) / np.pi) ** bits) ** bands >= (0.995 if bits else 0)


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_links_of_any_banding(spark, monkeypatch, bits):
    monkeypatch.setattr(similarity, "cheapest_banding", lambda *a: similarity.banding(0, 0.8, 0.999, bits))
    rows = planted(5) + [(9001, [1.0] * 65), (9005, [1.0] * 64 + [2.0]), (9006, [3.0]), (9010, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {r.vec_id: r for r in similarity.similar_vectors(df, "vec_id", "v", F.col("vec_id") % 5 == 0, block=64).collect()}
    v = np.array([x for _, x in rows[:-4]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.8
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in range(0, len(v), 5)) >= 0.99 * near[::5].sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(0, len(v), 5))
    assert (got[9005].n_links, got[9005].best_id, got[9010].n_links, got[9010].best_id) == (1, 9001, 1, 9006)
