"""Streams fed in several micro-batches must equal their batch twins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import steps
from voxframe.functions.steps import sentence_chunker
from voxframe.operators import ordered, sessions
from voxframe.session import shared_dir
from voxframe.streaming import eventtime, followed, keyed, spend, stateful


def batches(spark, df, order, parts, name):
    """The table as files in arrival order, one per micro-batch."""
    folder = f"{shared_dir(spark)}/{name}-{random.random()}"
    n = df.count()
    rows = df.orderBy(order).collect()
    for i in range(parts):
        part = spark.createDataFrame(rows[i * n // parts : (i + 1) * n // parts], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return stateful.read_stream(spark, folder, df.schema, files_per_trigger=1)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def frame_rows(spark, voiced_silent, rate=0.03):
    rows, i = [], 0
    for kind, seconds in voiced_silent:
        for _ in range(round(seconds / rate)):
            rows.append(("s", i, 0.5 if kind else 0.0))
            i += 1
    return spark.createDataFrame(rows, "k string, frame_idx bigint, value double").withColumn("block", F.floor(F.col("frame_idx") / 40))


@pytest.mark.parametrize(
    "plan,want",
    [
        ([(1, 2.0), (0, 0.6), (1, 1.5), (0, 0.6), (1, 3.0), (0, 0.6)], 3),
        ([(1, 2.0), (0, 0.1), (1, 2.0), (0, 0.6)], 1),
        ([(1, 1.0), (0, 0.2), (1, 1.0), (0, 0.6), (1, 1.0), (0, 0.8)], 2),
        ([(1, 0.3), (0, 0.6)], 0),
        ([(1, 16.0)], 2),
    ],
)
def test_utterances(spark, plan, want):
    frames = frame_rows(spark, plan)
    batch = sessions.utterance_segments(frames, ["k"])
    assert batch.count() == want
    last = frames.agg(F.max("frame_idx")).first()[0]
    rows = frames.select("k", "frame_idx", "value", (F.col("frame_idx") == last).alias("flush"))
    same(batch, stateful.run_available(stateful.utterances(batches(spark, rows, "frame_idx", 3, "utt"), ["k"])))


def fold_text(events):
    """The session rule in plain Python, one event at a time."""
    import pandas as pd

    step, state, out = sentence_chunker(["k"], "i"), None, []
    for e in events:
        rows, state = step(state, pd.DataFrame([e], columns=["k", "i", "type", "text", "enabled"]))
        out += [tuple(r) for r in rows.itertuples(index=False)]
    return out


def test_chunks_across_batches(spark):
    rng = random.Random(11)
    parts = ["Hello there. ", "wor", "ld `co", "de` and more! Next", "\n\nNew par", "a. ", "```block\nx. y", "``` after. ", "ok"]
    events = []
    for k in ("a", "b"):
        for i in range(60):
            kind = rng.choices(["delta", "message_end", "set_config", "reset"], [12, 2, 1, 0.3])[0]
            events.append((k, i, kind, rng.choice(parts), rng.random() < 0.5))
    df = spark.createDataFrame(events, "k string, i bigint, type string, text string, enabled boolean")
    want = sorted(c for k in ("a", "b") for c in fold_text([e for e in events if e[0] == k]))
    batch = sessions.session_chunks(df.withColumn("block", F.floor(F.col("i") / 7)), ["k"], ["i"], "i")
    assert sorted(map(tuple, batch.collect())) == want and len(want) > 10
    same(batch, stateful.run_available(stateful.sentence_chunks(batches(spark, df, "i", 4, "chunks"), ["k"], ["i"], "i")))


def test_gate_rules():
    ev = lambda i, kind, text="", on=True: ("s", i, kind, text, on)
    assert fold_text([ev(0, "delta", "One two. Thr"), ev(1, "message_end")]) == [("s", 0, 0, "One two."), ("s", 1, 1, "Thr")]
    off = [ev(0, "set_config", on=False), ev(1, "delta", "Kept text. And"), ev(2, "set_config", on=True)]
    assert fold_text(off) == [("s", 2, 0, "Kept text.")]
    assert fold_text([ev(0, "delta", "Lost tail"), ev(1, "set_config", on=False), ev(2, "set_config", on=True), ev(3, "message_end")]) == []
    assert fold_text([ev(0, "set_config", on=False), ev(1, "delta", "Gone. "), ev(2, "message_end"), ev(3, "set_config", on=True)]) == []


def test_emotion_states_match(spark):
    rng = random.Random(2)
    moods = ["angry", "cute", "excited", "neutral"]
    rows = [("s" if i % 5 else "t", i, 1000.0 * i * rng.choice([1, 30]), rng.choice(moods), rng.choice([0.25, 0.5, 1.0])) for i in range(150)]
    rows = [(k, i, t, e, 0.0 if e == "neutral" else c) for (k, i, _, e, c), t in zip(rows, np.cumsum([rng.choice([900.0, 50_000.0]) for _ in rows]).tolist())]
    df = spark.createDataFrame(rows, "k string, i bigint, ts_ms double, emotion string, confidence double")
    batch = sessions.emotion_states(ordered.with_block(df, "ts_ms", 10), ["k"], "i")
    whole = sessions.emotion_states(df.withColumn("block", F.lit(0)), ["k"], "i")
    same(batch, whole)
    same(batch, stateful.run_available(stateful.emotion_states(batches(spark, df, "i", 4, "emo"), ["k"], "i")))


def test_cool_down_over_blocks(spark):
    rng = random.Random(9)
    ts = np.cumsum([rng.choice([100.0, 400.0, 1500.0]) for _ in range(300)]).tolist()
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(ts)], "k string, i bigint, ts_ms double")
    got = sorted(r.i for r in sessions.cool_down(ordered.with_block(df, "ts_ms", 11), ["k"], "i", 1000.0).collect())
    want, last = [], None
    for i, t in enumerate(ts):
        if last is None or t - last >= 1000.0:
            want.append(i)
            last = t
    assert got == want


def test_filler_and_snapshot(spark):
    trips = spark.createDataFrame([("s", i, 6000.0, 44 + 2 * 24000 * 3, 0) for i in range(3)], "k string, chunk_index bigint, rtt_ms double, audio_bytes bigint, block bigint")
    plan = sessions.filler_plan(trips, ["k"]).orderBy("chunk_index").collect()
    assert [r.gap_ms for r in plan] == pytest.approx([0.0, 3000.0, 3000.0]) and plan[-1].total_filler_ms == pytest.approx(6000.0)
    stream = stateful.filler_plan(batches(spark, trips.drop("block"), "chunk_index", 3, "trips"), ["k"], ["chunk_index"], "chunk_index")
    same(sessions.filler_plan(trips, ["k"]).select("k", "chunk_index", "ema", "gap_ms", "total_filler_ms"), stateful.run_available(stream))
    arrivals = spark.createDataFrame([("s", i, 1.0, 0) for i in (0, 1, 2, 4)], "k string, idx bigint, secs double, block bigint")
    state = spark.createDataFrame([("s", 0, 6), ("idle", 0, None)], "k string, cursor bigint, total bigint")
    snap = {r.k: r for r in sessions.buffer_snapshot(arrivals, state, ["k"]).collect()}
    assert (snap["s"].buffered, snap["s"].pending, snap["s"].complete) == (3, 3, False)
    assert (snap["idle"].buffered, snap["idle"].pending) == (0, 0)


def test_reassembly(spark):
    rows = [("s", 1, "one", 0), ("s", 0, "zero", 1), ("t", 2, "c", 0), ("t", 0, "a", 1), ("t", 1, "b", 2)]
    df = spark.createDataFrame(rows, "k string, idx bigint, payload string, arrived bigint")
    out = stateful.run_available(stateful.reassembled(batches(spark, df, "arrived", 3, "order"), ["k"]))
    got = {k: [r.payload for r in sorted(out.filter(F.col("k") == k).collect(), key=lambda r: (r.released_by, r.idx))] for k in ("s", "t")}
    assert got == {"s": ["zero", "one"], "t": ["a", "b", "c"]}


def test_replay_is_strictly_after(spark):
    rows = [("s", i, "chunk", i, f"c{i}") for i in range(30)] + [("s", 30, "resume", 25, None), ("s", 31, "resume", 0, None)]
    df = spark.createDataFrame(rows, "k string, at bigint, type string, idx bigint, text string")
    out = stateful.run_available(stateful.replayed(batches(spark, df, "at", 3, "log"), ["k"], ["at"])).collect()
    assert sorted(r.idx for r in out if r.resume_at == 30) == [26, 27, 28, 29]
    assert sorted(r.idx for r in out if r.resume_at == 31) == list(range(10, 30))


def test_idempotent_append(spark):
    path = f"{shared_dir(spark)}/idem-{random.random()}"
    write = stateful.idempotent_append(path)
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    write(rows, 0)
    write(rows, 0)
    write(rows, 1)
    assert spark.read.parquet(path).count() == 4


def test_receipt_cases(spark):
    df = spark.createDataFrame([("x" * 200, 3.0, False), ("y", 3.0, True)], "text string, audio_duration_sec double, cache_hit boolean")
    miss, hit = sessions.receipts(df).collect()
    assert miss.gpu_sec == pytest.approx(3.9) and len(miss.text_preview) == 60 and miss.text_chars == 200
    assert hit.gpu_sec == hit.cost_usd == 0.0
    empty = sessions.ledger_summary(sessions.receipts(df.limit(0))).first()
    assert empty.status == "none" and empty.hit_pct is None and empty.cost_usd == 0.0


def test_delivery_status_and_order(spark):
    schema = "k string, idx bigint, payload string, arrived bigint, total bigint"
    rows = [("s", 2, "c", 0, None), ("s", 0, "a", 1, None), ("t", 0, "x", 2, None), ("s", None, None, None, 3), ("s", 1, "b", 5, None), ("s", 0, "again", 6, None), ("u", None, None, None, 0), ("u", 4, "w", 9, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", i bigint")
    for parts in (1, 3, 8):
        out = stateful.run_available(keyed.delivery(batches(spark, df, "i", parts, "status").drop("i"), ["k"])).collect()
        chunks = sorted((r.k, r.idx, r.payload, r.released_by) for r in out if r.kind == "chunk")
        assert chunks == [("s", 0, "a", 1), ("s", 1, "b", 5), ("s", 2, "c", 5), ("t", 0, "x", 2)]
        last = {k: max((r for r in out if r.k == k and r.kind != "chunk"), key=lambda r: (r.received, r.total is not None, r.idx)) for k in "stu"}
        assert [(last[k].kind, last[k].idx) for k in "stu"] == [("done", 3), ("filling", 1), ("done", 0)]


def test_fence_in_event_time(spark):
    rng = random.Random(4)
    rows, open_, want = [], [], []
    resets = {k: [] for k in "ab"}
    for i in range(160):
        k, at = rng.choice("ab"), 1_000.0 * i
        if rng.random() < 0.15:
            rows.append((k, "reset", -i, at))
            resets[k].append(at)
        else:
            done = at + rng.choice([0.0, 500.0, 4_000.0, 30_000.0])
            rows += [(k, "request", i, at), (k, "result", i, done)]
            open_.append((k, i, at, done))
    for k, i, at, done in open_:
        if not any(at < x <= done for x in resets[k]):
            want.append((k, i, sum(x <= at for x in resets[k])))
    rows.append(("z", "reset", -1, 9e8))
    rows = [r for _, r in sorted((r[3] + rng.choice([0, 5_000]) * (r[0] != "z"), r) for r in rows)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "k string, type string, request long, at double, n long").withColumn("ts", F.timestamp_micros((F.col("at") * 1000).cast("bigint")))
    stream = batches(spark, df, "n", 5, "fence").withWatermark("ts", "20 seconds")
    got = stateful.run_available(keyed.fence(stream, ["k"], 60_000.0))
    assert sorted((r.k, r.request, r.generation) for r in got.collect()) == sorted(want) and len(want) > 60


def test_late_rows_are_kept_apart_once(spark):
    rows = [(i, f"2024-01-01 {h}:00:00", 2.0, i % 2 == 0, 0.5, 10.0 * i) for i, h in enumerate(["10", "11", "12", "09", "11", "14", "12"])]
    df = spark.createDataFrame(rows, "i long, t string, audio_duration_sec double, cache_hit boolean, cost_usd double, rtt_ms double").withColumn("ts", F.to_timestamp("t"))
    own = spend.RunningSpend(spark, df.schema, "2 HOURS")
    own.run(batches(spark, df, "i", 3, "spend"))  # 0-1, 2-3, 4-6
    assert sorted(r.i for r in own.late_rows().collect()) == []
    own = spend.RunningSpend(spark, df.schema, "30 MINUTES").run(batches(spark, df, "i", 3, "spend"))
    for _ in range(2):  # a batch that is run again changes nothing
        assert sorted(r.i for r in own.late_rows().collect()) == [3, 4]
        total = own.totals().first()
        assert (total.calls, total.hits, total.cost_usd, total.mean_rtt_ms, total.max_rtt_ms) == (5, 3, 2.5, 28.0, 60.0)
        own.write(df.where("i >= 4"), 2)
    assert own.history().count() == 3
    nothing = spend.RunningSpend(spark, df.schema, "1 HOUR")
    assert nothing.totals().first().calls == 0 and nothing.late_rows().count() == 0


def test_followed_log_keeps_the_order_of_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    line = lambda step: f"{step}/20000 [00:01, loss=0.{step}, accuracy=0.5]"
    log = followed.FollowedLog(spark, F.regexp_extract("file", "([a-z]+)[0-9]*[.]log", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (folder / "a1.log").write_text("\n".join([*map(line, range(100, 900)), "   ", "CUDA out of memory"]))
        (folder / "b1.log").write_text("\n".join(map(line, [7, 9, 8])))
        log.run(followed.stream_lines(spark, str(folder)))
        first = {r.job: r for r in log.status().collect()}
        assert (first["a"].step, first["a"].state, first["a"].lines, first["b"].step) == (899, "failed", 802, 8)
        (folder / "a2.log").write_text("\n".join([line(50), "[train] DONE"]))
        log.run(followed.stream_lines(spark, str(folder)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    last = {r.job: r for r in log.status().collect()}
    assert (last["a"].step, last["a"].state, last["a"].lines, last["b"].step) == (50, "failed", 804, 8)
    assert log.events().where("event = 'oom'").count() == 1


def shuffled_in_time(spark, rows, schema, seed, parts=5, late_s=40):
    """The rows as a stream that brings each up to late_s seconds late, and a last one of another key to end it."""
    rng = random.Random(seed)
    arrivals = sorted((r[1] + rng.random() * late_s, i) for i, r in enumerate(rows))
    end = ("end", 9e8, *(None for _ in rows[0][2:]))
    came = [(*rows[i], n) for n, (_, i) in enumerate(arrivals)] + [(*end, len(rows))]
    df = spark.createDataFrame(came, f"{schema}, arrival long").withColumn("ts", F.timestamp_micros((F.col("secs") * 1_000_000).cast("bigint")))
    return batches(spark, df, "arrival", parts, "intime").withWatermark("ts", f"{late_s + 1} seconds")


def in_order(step, rows, keys=("k",)):
    """The rule over each key's rows in one go."""
    import pandas as pd

    out = []
    for key in sorted({r[0] for r in rows}):
        mine = pd.DataFrame([dict(zip(("k", "secs", *keys), r)) for r in rows if r[0] == key])
        out += [tuple(r) for r in step(None, mine)[0].itertuples(index=False)]
    return sorted(out)


def test_event_time_rules_take_rows_in_order(spark):
    rng = random.Random(8)
    stamps = [("ab"[i % 2], float(1000 + 10 * (i // 2))) for i in range(120)]
    parts = ["Hello there. ", "wor", "ld `co", "de` and more! Next", "\n\nNew par", None, "```block\nx. y", "``` after. "]
    rows = [(k, t, i, rng.choices(["delta", "message_end", "set_config", "reset"], [12, 2, 1, 0.3])[0], rng.choice(parts), rng.random() < 0.5) for i, (k, t) in enumerate(stamps)]
    stream = shuffled_in_time(spark, rows, "k string, secs double, i long, type string, text string, enabled boolean", 1)
    got = stateful.run_available(eventtime.sentence_chunks(stream, ["k"], "i")).collect()
    want = in_order(sentence_chunker(["k"], "i"), rows, ("i", "type", "text", "enabled"))
    assert sorted(map(tuple, got)) == want and len(want) > 10

    rows = [(k, t, i, 1000.0 * t, rng.choice(["angry", "cute", "neutral"]), rng.choice([0.0, 0.25, 0.5, 1.0])) for i, (k, t) in enumerate(stamps)]
    stream = shuffled_in_time(spark, rows, "k string, secs double, i long, ts_ms double, emotion string, confidence double", 2)
    got = stateful.run_available(eventtime.emotion_states(stream, ["k"], "i")).collect()
    assert sorted(map(tuple, got)) == in_order(steps.emotion_state(["k"], "i"), rows, ("i", "ts_ms", "emotion", "confidence"))


def test_event_time_filler_utterances_and_replay(spark):
    rng = random.Random(9)
    stamps = [("ab"[i % 2], float(1000 + 10 * (i // 2))) for i in range(100)]
    rows = [(k, t, i, rng.random() * 9000, rng.randrange(44, 200_000)) for i, (k, t) in enumerate(stamps)]
    stream = shuffled_in_time(spark, rows, "k string, secs double, i long, rtt_ms double, audio_bytes long", 3)
    got = stateful.run_available(eventtime.filler_plan(stream, ["k"], "i")).collect()
    assert sorted(map(tuple, got)) == in_order(steps.filler(["k"], "i"), rows, ("i", "rtt_ms", "audio_bytes"))

    limits = {"threshold": 0.5, "min_silence": 2, "min_speech": 2, "max_speech": 5}
    rows = [(k, t, i // 2, rng.random() ** 0.5, i >= 98) for i, (k, t) in enumerate(stamps)]
    stream = shuffled_in_time(spark, rows, "k string, secs double, frame_idx long, value double, flush boolean", 4)
    got = stateful.run_available(eventtime.utterances(stream, ["k"], **limits)).collect()
    want = in_order(steps.utterances(["k"], **limits), rows, ("frame_idx", "value", "flush"))
    assert sorted(map(tuple, got)) == want and len(want) > 5

    rows = [(k, t, i, "resume" if i % 10 > 7 else "chunk", i - 9 if i % 10 > 7 else i, f"t{i}") for i, (k, t) in enumerate(stamps)]
    stream = shuffled_in_time(spark, rows, "k string, secs double, at long, type string, idx long, text string", 5)
    got = stateful.run_available(eventtime.replayed(stream, ["k"], capacity=3)).collect()
    want = in_order(steps.recent_log(["k"], 3), rows, ("at", "type", "idx", "text"))
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_event_time_late_rows_and_rows_without_a_time(spark):
    """A row behind the watermark is dropped, one without a time too; rows the watermark has not reached wait."""
    trip = lambda i, secs: ("s", secs, i, 6000.0, 44 + 48_000 * 3)
    rows = [trip(0, 100.0), trip(1, 500.0), trip(2, 300.0), trip(4, None), trip(3, 50.0), trip(5, 2000.0), trip(6, 1990.0)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "k string, secs double, i long, rtt_ms double, audio_bytes long, n long").withColumn("ts", F.timestamp_micros((F.col("secs") * 1_000_000).cast("bigint")))
    # files of two, two and three rows: in the second batch the watermark is 200 s, so in the third a row of 50 s is late
    stream = batches(spark, df, "n", 3, "late").withWatermark("ts", "300 seconds")
    got = stateful.run_available(eventtime.filler_plan(stream, ["k"], "i")).orderBy("total_filler_ms").collect()
    assert [(r.i, r.gap_ms, r.total_filler_ms) for r in got] == [(0, 0.0, 0.0), (2, 3000.0, 3000.0), (1, 3000.0, 6000.0)]


def test_null_keys_in_event_time_keep_to_themselves(spark):
    rows = [(None if i % 5 == 0 else i % 3, i, 100.0 * (i % 7), 44 + 48 * i, i % 2) for i in range(60)]
    rows.append((9, 60, 1.0, 44, 1))
    df = spark.createDataFrame(rows, "k bigint, i bigint, rtt_ms double, audio_bytes bigint, wave int")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("i") + F.when(F.col("i") == 60, 1_000_000).otherwise(1_000)))
    stream = stateful.read_stream(spark, stateful.waves(df, "wave", 2, 1), df.drop("wave").schema, files_per_trigger=1).withWatermark("ts", "1 hour")
    got = {r.i: r for r in stateful.run_available(eventtime.filler_plan(stream, ["k"], "i")).collect()}
    want = {}
    for key in (None, 0, 1, 2):
        own = [(i, rtt) for k, i, rtt, _, _ in rows if k == key]
        ema = None
        for i, rtt in own:
            ema = rtt if ema is None else 0.3 * rtt + 0.7 * ema
            want[i] = (key, ema)
    assert {i: r.k for i, r in got.items()} == {i: k for i, (k, _) in want.items()}
    assert [got[i].ema for i in want] == pytest.approx([e for _, e in want.values()])


def test_dictionary_sorts_a_bounded_part(spark, tmp_path, monkeypatch):
    from voxframe.plans import dialogue

    docs = spark.createDataFrame([(i, "Aword another worda " * (1 + i % 3)) for i in range(40)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = sorted(dialogue.stress_dictionary(spark, str(tmp_path)).collect())
    monkeypatch.setattr(dialogue, "DICTIONARY_CHARS", 100)
    assert sorted(dialogue.stress_dictionary(spark, str(tmp_path)).collect()) == whole and whole
