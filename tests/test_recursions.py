"""Recursions over blocks against the same rule gone through in order, for blocks of many sizes."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.functions import chunking, steps
from voxframe.operators import recursions
from voxframe.operators.ordered import with_block


def in_order(rows, keys, order, step):
    """What a step gives for every key's rows in order."""
    out = []
    for _, own in rows.groupby(keys, dropna=False):
        got, _ = step(None, own.sort_values(order, kind="stable").reset_index(drop=True))
        out += got.to_dict("records")
    return out


def as_rows(records, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(plain(r[c]) for c in columns) for r in records)


def collected(df, columns):
    return as_rows([r.asDict() for r in df.collect()], columns)


def blocked(spark, frame, order, size):
    return with_block(spark.createDataFrame(frame), order, size)


MOODS = ["neutral", "joy", "anger", "sadness", "fear", "shy"]


def readings(seed, gaps):
    rng = random.Random(seed)
    rows = []
    for key in range(3):
        at = 0.0
        for _ in range(220 if key == 0 else 40):
            at += rng.choice(gaps)
            rows.append((key, len(rows), at, rng.choice(MOODS[: 2 + key * 2]), rng.choice([0.0, 0.15, 0.4, 0.7, 1.0])))
    return pd.DataFrame(rows, columns=["k", "id", "ts_ms", "emotion", "confidence"])


@pytest.mark.parametrize("gaps", [[1000.0, 60_000.0], [30_000.0, 900_000.0, 1_000_000.0, 5_000_000.0], [0.0, 2e6]])
def test_emotion_states(spark, gaps):
    frame = readings(len(gaps), gaps)
    columns = ["k", "id", "state_emotion", "state_intensity", "half_life_ms", "current_intensity"]
    want = as_rows(in_order(frame, ["k"], ["ts_ms", "id"], steps.emotion_state(["k"], "id")), columns)
    for size in (5, 1000):
        assert collected(recursions.emotion_states(blocked(spark, frame, "ts_ms", size), ["k"], "id"), columns) == want, size


def test_emotion_maps_compose():
    """A stretch's map is that of its two halves one after the other, whatever emotion has faded before it."""
    rng = random.Random(1)
    for _ in range(300):
        at, rows = 0.0, []
        for _ in range(8):
            at += rng.choice([1e3, 1e5, 2e6])
            rows.append((at, rng.choice(MOODS[:4]), rng.choice([0.0, 0.3, 1.0])))
        maps = []
        for part in (rows, rows[:5], rows[5:]):
            own = recursions._Reactions()
            for r in part:
                own.add(*r)
            maps.append(own.row())
        if rows[5][0] - rows[4][0] < 1e6:
            continue
        for mood in MOODS[:4]:
            whole, halves = [mood, 0.2, 300_000.0], [mood, 0.2, 300_000.0]
            recursions._pass_on(whole, (0, *maps[0]))
            recursions._pass_on(halves, (0, *maps[1]))
            recursions._pass_on(halves, (1, *maps[2]))
            assert whole == halves


@pytest.mark.parametrize("wait", [3.0, 25.0, 400.0])
def test_cool_down(spark, wait):
    rng = random.Random(int(wait))
    rows = [(k, i, float(rng.randrange(600))) for k in range(3) for i in range(150 if k else 400)]
    frame = pd.DataFrame(rows, columns=["k", "id", "ts_ms"])
    want = as_rows(in_order(frame, ["k"], ["ts_ms", "id"], steps.cool_down(["k"], "id", wait)), ["k", "id", "ts_ms"])
    for size in (3, 40, 5000):
        got = recursions.cool_down(blocked(spark, frame, "ts_ms", size), ["k"], "id", wait)
        assert collected(got, ["k", "id", "ts_ms"]) == want, size
    assert recursions.cool_down(blocked(spark, frame, "ts_ms", 40), ["k"], "id", 0.0).count() == len(frame)


def test_utterances(spark):
    rng = random.Random(5)
    rows = []
    for k in range(4):
        loud = False
        for i in range(300):
            loud = loud if rng.random() < (0.97 if k == 3 else 0.7) else not loud
            rows.append((k, i, 1.0 if loud else 0.0))
    frame = pd.DataFrame(rows, columns=["k", "frame_idx", "value"])
    limits = {"threshold": 0.5, "min_silence": 3, "min_speech": 2, "max_speech": 9}
    flagged = frame.assign(flush=frame["frame_idx"] == 299)
    columns = ["k", "start_idx", "n_frames", "speech_frames"]
    want = as_rows(in_order(flagged, ["k"], ["frame_idx"], steps.utterances(["k"], **limits)), columns)
    for size in (7, 5000):
        assert collected(recursions.utterance_segments(blocked(spark, frame, "frame_idx", size), ["k"], **limits), columns) == want, size


TEXTS = ["One. ", "two", "!", " ", "\n", "\n\n", "`code`", "``` fence", "```", "`", "``", "a.b", "? Yes. No", "ünï ", ". ", "\nline\n", "", "Hm...  ok.\n"]


def deltas(seed, ends):
    rng = random.Random(seed)
    rows = []
    for k in range(3):
        for _ in range(250):
            kind = rng.choices(["delta", "message_end", "set_config", "reset"], [1.0, ends, ends, ends / 2])[0]
            rows.append((k, len(rows), kind, rng.choice(TEXTS) if rng.random() < 0.97 else None, rng.random() < 0.6))
    return pd.DataFrame(rows, columns=["k", "id", "type", "text", "enabled"])


@pytest.mark.parametrize(("seed", "ends"), [(1, 0.15), (2, 0.02), (3, 0.0)])
def test_session_chunks(spark, seed, ends):
    frame = deltas(seed, ends)
    columns = ["k", "id", "chunk_idx", "chunk"]
    want = as_rows(in_order(frame, ["k"], ["id"], steps.sentence_chunker(["k"], "id")), columns)
    for size in (4, 60, 5000):
        assert collected(recursions.session_chunks(blocked(spark, frame, "id", size), ["k"], ["id"], "id"), columns) == want, size


def test_code_maps_compose():
    rng = random.Random(9)
    for _ in range(400):
        texts = [rng.choice(TEXTS) for _ in range(6)]
        whole, left, right = chunking.CodeMap(), chunking.CodeMap(), chunking.CodeMap()
        for i, t in enumerate(texts):
            whole.add(t)
            (left if i < 3 else right).add(t)
        assert whole.exits == [right.exits[e] for e in left.exits]


def test_distinct_regions(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, *map(float, rng.random(3))) for k in ("a", "b") for i in range(400)] + [("c", 1, None, 0.5, 0.5), ("c", 2, 0.5, 0.5, 0.5), ("c", 3, 0.5, 0.5, 0.5)]
    rows += [("d", i, i / 900, 0.0, 0.0) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double")
    step = steps.distinct_regions(["k"], "id", ["x", "y", "z"])
    known = pd.DataFrame([r for r in rows if r[2] is not None], columns=["k", "id", "x", "y", "z"])
    want = sorted([*as_rows(in_order(known, ["k"], ["id"], step), ["k", "id"]), ("c", 1)])
    for head in (3, 50, 2000):
        assert collected(recursions.distinct_regions(df, ["k"], "id", ["x", "y", "z"], head=head), ["k", "id"]) == want, head


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, id long, ts_ms double, emotion string, confidence double, block long, type string, text string, enabled boolean, frame_idx long, value double, x double")
    assert recursions.emotion_states(none, ["k"], "id").count() == 0
    assert recursions.cool_down(none, ["k"], "id", 5.0).count() == 0
    assert recursions.utterance_segments(none, ["k"]).count() == 0
    assert recursions.session_chunks(none, ["k"], ["id"], "id").count() == 0
    assert recursions.distinct_regions(none, ["k"], "id", ["x"]).count() == 0


def test_null_keys_are_a_series(spark):
    df = spark.createDataFrame([(None, i, float(i), "joy", 0.5, 0) for i in range(4)], "k long, id long, ts_ms double, emotion string, confidence double, block long")
    assert recursions.emotion_states(df, ["k"], "id").count() == 4
    assert {r.id for r in recursions.cool_down(df.withColumn("block", F.col("id")), ["k"], "id", 2.0).collect()} == {0, 2}


def test_cool_down_takes_no_group_whole(spark):
    frame = pd.DataFrame([(k, i, 400.0 * i) for i, k in enumerate([0, 1, 2, None] * 40)], columns=["k", "id", "ts_ms"])
    frame = frame.astype({"k": "Int64"})
    df = spark.createDataFrame([(None if k is pd.NA else int(k), int(i), float(t)) for k, i, t in frame.itertuples(index=False)], "k bigint, id bigint, ts_ms double")
    # rows without a time: kept for a key that has no others, and there only the first
    df = df.unionByName(spark.createDataFrame([(1, 900, None), (7, 902, None), (7, 901, None)], "k bigint, id bigint, ts_ms double"))
    want = set()
    for key in (0, 1, 2, 3):
        last = None
        for i in range(key, 160, 4):
            if last is None or 400.0 * i - last >= 3000.0:
                want.add(i)
                last = 400.0 * i
    for size in (7, 1000):
        got = recursions.cool_down(with_block(df, "ts_ms", size), ["k"], "id", 3000.0)
        assert "InPandas" not in got._jdf.queryExecution().toString()
        assert {r.id for r in got.collect()} == want | {901}, size
