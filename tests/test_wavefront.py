"""Alignment over tiles against the whole alignment in one task."""

import random

import numpy as np
import pytest

from voxframe.functions import kernels
from voxframe.operators import alignment, wavefront


def series(rng, n):
    return [float(rng.choice([0, 1, 1, 2, 5])) for _ in range(n)]


@pytest.mark.parametrize(("p", "q"), [(1, 1), (1, 5), (6, 1), (7, 4)])
def test_one_tile_is_the_whole_matrix(p, q):
    rng = random.Random(p * 10 + q)
    a, b = np.array(series(rng, p)), np.array(series(rng, q))
    bottom, right, came, _, steps = wavefront.fill(a, b, np.full(q, np.inf), np.full(p, np.inf), 0.0)
    i, j, path = p - 1, q - 1, []
    while i >= 0 and j >= 0:
        path.append((i, j))
        i, j = i - (steps[i, j] < 2), j - (steps[i, j] != 1)
    assert path[::-1] == [tuple(x) for x in kernels.warp_path(a, b)]
    assert bottom[-1] == right[-1] == sum(abs(a[i] - b[j]) for i, j in path) and came[-1] == 0


@pytest.mark.parametrize("tile", [3, 8, 40])
def test_tiles_give_the_whole_path(spark, tile):
    rng = random.Random(tile)
    sides = {k: (series(rng, n), series(rng, m)) for k, (n, m) in enumerate([(17, 23), (30, 2), (1, 30), (8, 8), (2, 3), (25, 25)])}
    frame = lambda side: spark.createDataFrame([(k, i, x) for k, both in sides.items() for i, x in enumerate(both[side])], "pair_id long, frame_idx long, value double")
    rows = alignment.warp(frame(0), frame(1), ["pair_id"], tile=tile).collect()
    for k, (a, b) in sides.items():
        own = sorted((r.path_pos, r.ref_idx, r.syn_idx, r.ref_value, r.syn_value) for r in rows if r.pair_id == k)
        want = [(n, i, j, a[i], b[j]) for n, (i, j) in enumerate(map(tuple, kernels.warp_path(np.array(a), np.array(b))))]
        assert own == want, k
