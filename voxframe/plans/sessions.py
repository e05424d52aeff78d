"""Session queries over ``events``: a user is a session.  Streams have batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import tables
from voxframe.functions.scalar import rnd
from voxframe.functions.verdicts import is_cache_hit, is_warm
from voxframe.operators import alignment, compare, ordered, sessions, signal
from voxframe.operators import text as text_ops
from voxframe.operators.ordered import with_block, with_position
from voxframe.operators.recursions import kept
from voxframe.plans.dialogue import EMOTIONS, MESSAGE, MESSAGES, _LOG, messages
from voxframe.plans.frames import FRAME_S, FRAMES, SEGMENTS, frames, segments
from voxframe.plans.registry import query, rnd_sql as r, table, with_sql
from voxframe.session import shared_dir
from voxframe.streaming import eventtime, followed, keyed, spend, stateful



def ts_ms():
    return F.unix_micros("ts") / 1000.0


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = stateful.read_stream(spark, sf, schema, glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _block_on_ms(df: DataFrame) -> DataFrame:
    return with_block(df, "ts_ms")


# ---- round trips


TRIPS = {
    **FRAMES,
    "trips": "SELECT series_id AS session_id, frame_idx AS chunk_index, event_id, value * 100.0 / 7 AS rtt_ms, 44 + CAST(floor(value * 4000) AS BIGINT) AS audio_bytes FROM frames",
    "ema": "SELECT session_id, chunk_index, event_id, rtt_ms, audio_bytes, rtt_ms::DOUBLE AS ema FROM trips WHERE chunk_index = 0 UNION ALL "
    "SELECT t.session_id, t.chunk_index, t.event_id, t.rtt_ms, t.audio_bytes, 0.3::DOUBLE * t.rtt_ms + 0.7::DOUBLE * e.ema FROM ema e JOIN trips t ON t.session_id = e.session_id AND t.chunk_index = e.chunk_index + 1",
    "gap": "SELECT *, CASE WHEN chunk_index >= 1 THEN greatest(ema - (lag(audio_bytes) OVER w - 44) / 2 / 24000 * 1000.0, 0) ELSE 0 END AS gap_ms FROM ema WINDOW w AS (PARTITION BY session_id ORDER BY chunk_index)",
}


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select(
        F.col("series_id").alias("session_id"), F.col("frame_idx").alias("chunk_index"), "event_id", "block",
        (F.col("value") * 100.0 / 7).alias("rtt_ms"), (F.lit(44) + F.floor(F.col("value") * 4000)).alias("audio_bytes"),
    )


@query("rtt_ema", with_sql(TRIPS, f"SELECT session_id, chunk_index, {r('ema', 5)} AS ema FROM ema"))
def rtt_ema(spark, sf):
    out = ordered.ema(trips(spark, sf), ["session_id"], "chunk_index", "rtt_ms", 0.3)
    return out.select("session_id", "chunk_index", rnd(F.col("ema"), 5).alias("ema"))


_FILLER = with_sql(
    TRIPS,
    f"SELECT session_id, event_id, {r('ema', 5)} AS ema, {r('gap_ms', 5)} AS gap_ms, {r('sum(gap_ms) OVER (PARTITION BY session_id ORDER BY chunk_index)', 4)} AS total_filler_ms FROM gap",
)


def _filler_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "event_id", rnd(F.col("ema"), 5).alias("ema"), rnd(F.col("gap_ms"), 5).alias("gap_ms"), rnd(F.col("total_filler_ms"), 4).alias("total_filler_ms")
    )


@query("filler_plan", _FILLER)
def filler_plan(spark, sf):
    return _filler_columns(sessions.filler_plan(trips(spark, sf), ["session_id"]))


@query("stream_filler_plan", _FILLER)
def stream_filler_plan(spark, sf):
    events = stream_events(spark, sf).select(
        F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("value") * 100.0 / 7).alias("rtt_ms"), (F.lit(44) + F.floor(F.col("value") * 4000)).alias("audio_bytes")
    )
    return _filler_columns(stateful.run_available(stateful.filler_plan(events, ["session_id"], ["ts", "event_id"], "event_id")))


@query(
    "latency_summary",
    with_sql(
        TRIPS,
        f"SELECT session_id, count(*) AS trips, {r('avg(rtt_ms)', 5)} AS mean_rtt_ms, {r('min(rtt_ms)', 5)} AS min_rtt_ms, {r('max(rtt_ms)', 5)} AS max_rtt_ms, {r('count(*) / (sum(rtt_ms) / 60000.0)', 5)} AS chunks_per_min FROM trips GROUP BY session_id",
    ),
)
def latency_summary(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.col("value") * 100.0 / 7).alias("rtt_ms"))
    out = sessions.latency_summary(calls, ["session_id"])
    return out.select("session_id", "trips", *[rnd(F.col(c), 5).alias(c) for c in out.columns[2:]])


@query(
    "call_labels",
    "SELECT event_id, value * 200 < 8000 AS warm, value * 200 < 150 AS cache_hit FROM events",
)
def call_labels(spark, sf):
    rtt = F.col("value") * 200
    return table(spark, sf, "events").select("event_id", is_warm(rtt).alias("warm"), is_cache_hit(rtt).alias("cache_hit"))


@query(
    "cold_warm",
    "WITH c AS (SELECT user_id AS session_id, CAST(floor(value * 100) AS BIGINT) AS ms, floor(value * 900) + 1 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) "
    f"SELECT session_id, max(CASE WHEN rn = 1 THEN ms END) AS cold_ms, CAST(floor(sum(CASE WHEN rn > 1 THEN ms END) / count(*) FILTER (rn > 1)) AS BIGINT) AS warm_avg_ms, {r('avg(ms / 1000.0 / (b / 44100.0))', 6)} AS mean_rtf FROM c GROUP BY session_id",
)
def cold_warm(spark, sf):
    calls = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.floor(F.col("value") * 100).alias("ms"), (F.floor(F.col("value") * 900) + 1).alias("audio_bytes")
    )
    out = sessions.cold_warm(calls, ["session_id"], ["ts", "event_id"])
    return out.withColumn("mean_rtf", rnd(F.col("mean_rtf"), 6))


# ---- receipts and ledger


RECEIPTS = {
    **MESSAGES,
    "k": "SELECT *, sha256('m' || (event_id % 3) || '|' || text) AS cache_key, row_number() OVER (PARTITION BY event_id % 3, text ORDER BY ts, event_id) > 1 AS cache_hit FROM msg",
    "rc": f"SELECT *, value / 10 AS audio_duration_sec, left(text, 60) AS text_preview, length(text) AS text_chars, CASE WHEN cache_hit THEN 0 ELSE {tables.GPU_BASE_S} + value / 10 * {tables.GPU_PER_AUDIO_S} END::DOUBLE AS gpu_sec, "
    f"CASE WHEN cache_hit THEN 0 ELSE {tables.GPU_BASE_S} + value / 10 * {tables.GPU_PER_AUDIO_S} END::DOUBLE * {tables.GPU_USD_PER_S} AS cost_usd FROM k",
}


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    calls = messages(spark, sf).withColumn("model", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")))
    seen = sessions.repeats(calls, ["ts", "event_id"])
    return sessions.receipts(seen.withColumn("audio_duration_sec", F.col("value") / 10))


@query("repeat_detection", with_sql(RECEIPTS, "SELECT event_id, cache_key, cache_hit FROM k"))
def repeat_detection(spark, sf):
    return receipts(spark, sf).select("event_id", "cache_key", "cache_hit")


@query(
    "receipts",
    with_sql(RECEIPTS, f"SELECT event_id, text_preview, text_chars, {r('gpu_sec', 6)} AS gpu_sec, {r('cost_usd', 9)} AS cost_usd FROM rc"),
)
def receipt_rows(spark, sf):
    return receipts(spark, sf).select(
        "event_id", "text_preview", F.col("text_chars").cast("bigint").alias("text_chars"), rnd(F.col("gpu_sec"), 6).alias("gpu_sec"), rnd(F.col("cost_usd"), 9).alias("cost_usd")
    )


@query(
    "ledger_summary",
    with_sql(
        RECEIPTS,
        f"SELECT count(*) AS calls, count(*) FILTER (cache_hit) AS hits, {r('count(*) FILTER (cache_hit) * 100.0 / count(*)', 4)} AS hit_pct, {r('sum(audio_duration_sec)', 3)} AS audio_sec, {r('sum(cost_usd)', 6)} AS cost_usd, 'ok' AS status FROM rc",
    ),
)
def ledger_summary(spark, sf):
    out = sessions.ledger_summary(receipts(spark, sf))
    return out.select("calls", "hits", rnd(F.col("hit_pct"), 4).alias("hit_pct"), rnd(F.col("audio_sec"), 3).alias("audio_sec"), rnd(F.col("cost_usd"), 6).alias("cost_usd"), "status")


_DAILY = (
    "WITH c AS (SELECT CAST(ts AS DATE) AS day, value / 10 AS a, value < 20 AS hit FROM events), g AS (SELECT *, CASE WHEN hit THEN 0 ELSE "
    f"{tables.GPU_BASE_S} + a * {tables.GPU_PER_AUDIO_S} END::DOUBLE * {tables.GPU_USD_PER_S} AS cost FROM c) "
    f"SELECT CAST(day AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (hit) AS hits, {r('count(*) FILTER (hit) * 100.0 / count(*)', 4)} AS hit_pct, {r('sum(a)', 3)} AS audio_sec, {r('sum(cost)', 6)} AS cost_usd FROM g GROUP BY day"
)


def _daily_calls(events: DataFrame) -> DataFrame:
    calls = events.select("ts", (F.col("value") / 10).alias("audio_duration_sec"), (F.col("value") < 20).alias("cache_hit"), F.lit("x").alias("text"))
    return sessions.receipts(calls)


def _daily_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("day").cast("string").alias("day"), "calls", "hits", rnd(F.col("hit_pct"), 4).alias("hit_pct"), rnd(F.col("audio_sec"), 3).alias("audio_sec"), rnd(F.col("cost_usd"), 6).alias("cost_usd")
    )


@query("daily_spend", _DAILY)
def daily_spend(spark, sf):
    return _daily_columns(sessions.ledger_totals(_daily_calls(table(spark, sf, "events")), [F.to_date("ts").alias("day")]))


@query("stream_daily_spend", _DAILY)
def stream_daily_spend(spark, sf):
    """The running table in complete mode: every day seen so far."""
    totals = stateful.daily_totals(_daily_calls(stream_events(spark, sf)))
    return _daily_columns(stateful.run_available(totals, mode="complete"))


# ---- decaying emotion


_STATES = {
    **EMOTIONS,
    "rd": "SELECT session_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS t, emotion AS e, confidence AS c, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM em",
    "st": "SELECT session_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, 'neutral' AS emotion, 0::DOUBLE AS inten, 0::DOUBLE AS since, 300000::DOUBLE AS half, 0::DOUBLE AS now FROM (SELECT DISTINCT session_id FROM rd) UNION ALL "
    "SELECT session_id, rn, event_id, CASE WHEN keep THEN emotion ELSE e END, CASE WHEN neutral THEN inten WHEN same THEN least(1.0, lev + c * 0.35) WHEN win THEN c ELSE lev * 0.6 END, "
    "CASE WHEN neutral OR (NOT same AND NOT win) THEN since ELSE t END, CASE WHEN neutral THEN least(half, 60000) WHEN same OR win THEN 300000 ELSE 60000 END, t FROM ("
    "SELECT *, e = 'neutral' OR c = 0 AS neutral, e = emotion AS same, c >= lev AS win, e = 'neutral' OR c = 0 OR (e <> emotion AND c < lev) AS keep FROM ("
    "SELECT rd.session_id, rd.rn, rd.event_id, rd.t, rd.e, rd.c, st.emotion, st.inten, st.since, st.half, CASE WHEN st.emotion = 'neutral' THEN 0 WHEN st.inten * pow(2.0::DOUBLE, -(rd.t - st.since) / st.half) < 0.1 THEN 0 ELSE st.inten * pow(2.0::DOUBLE, -(rd.t - st.since) / st.half) END AS lev "
    "FROM st JOIN rd ON rd.session_id = st.session_id AND rd.rn = st.rn + 1))",
}
_STATES_SQL = with_sql(
    _STATES,
    f"SELECT session_id, event_id, emotion AS state_emotion, {r('inten', 6)} AS state_intensity, half AS half_life_ms, "
    f"{r('CASE WHEN emotion = $$neutral$$ OR inten * pow(2.0::DOUBLE, -(now - since) / half) < 0.1 THEN 0 ELSE inten * pow(2.0::DOUBLE, -(now - since) / half) END', 6)} AS current_intensity FROM st WHERE rn > 0",
)


def _state_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "event_id", "state_emotion", rnd(F.col("state_intensity"), 6).alias("state_intensity"), "half_life_ms", rnd(F.col("current_intensity"), 6).alias("current_intensity")
    )


@query("emotion_states", _STATES_SQL)
def emotion_states(spark, sf):
    readings = with_block(text_ops.tag_emotion(messages(spark, sf)), "ts").withColumn("ts_ms", ts_ms())
    return _state_columns(sessions.emotion_states(readings, ["session_id"], "event_id"))


@query("stream_emotion_states", _STATES_SQL)
def stream_emotion_states(spark, sf):
    events = stream_events(spark, sf).select(F.col("user_id").alias("session_id"), "event_id", ts_ms().alias("ts_ms"), F.expr(MESSAGE).alias("text"))
    readings = text_ops.tag_emotion(events).select("session_id", "event_id", "ts_ms", "emotion", "confidence")
    return _state_columns(stateful.run_available(stateful.emotion_states(readings, ["session_id"], "event_id")))


@query(
    "state_at_chunk",
    with_sql(
        {
            **EMOTIONS,
            "s": "SELECT session_id, epoch_us(ts) / 1000.0::DOUBLE AS t, emotion, confidence FROM em WHERE emotion <> 'neutral' AND event_id % 2 = 0",
            "c": "SELECT session_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS t FROM em WHERE event_id % 2 = 1",
            "j": "SELECT c.session_id, c.event_id, s.emotion, s.confidence * pow(2.0::DOUBLE, -(c.t - s.t) / 36000000.0) AS x FROM c ASOF LEFT JOIN s ON c.session_id = s.session_id AND c.t >= s.t",
        },
        f"SELECT session_id, event_id, coalesce(emotion, 'neutral') AS emotion, {r('CASE WHEN x >= 0.1 THEN x ELSE 0 END', 6)} AS intensity FROM j",
    ),
)
def state_at_chunk(spark, sf):
    tagged = text_ops.tag_emotion(messages(spark, sf)).withColumn("ts_ms", ts_ms())
    states = tagged.filter("emotion <> 'neutral' AND event_id % 2 = 0").select(
        "session_id", "ts_ms", "emotion", F.col("confidence").alias("intensity"), F.lit(36000000.0).alias("half_life_ms")
    )
    out = sessions.state_at(tagged.filter("event_id % 2 = 1"), states, ["session_id"], "event_id", _block_on_ms)
    return out.withColumn("intensity", rnd(F.col("intensity"), 6))


@query(
    "cool_down",
    with_sql(
        {
            "e": "SELECT user_id AS session_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
            "k": "SELECT session_id, rn, event_id, t AS last, true AS kept FROM e WHERE rn = 1 UNION ALL "
            "SELECT e.session_id, e.rn, e.event_id, CASE WHEN e.t - k.last >= 36000000 THEN e.t ELSE k.last END, e.t - k.last >= 36000000 FROM k JOIN e ON e.session_id = k.session_id AND e.rn = k.rn + 1",
        },
        "SELECT session_id, event_id FROM k WHERE kept",
    ),
)
def cool_down(spark, sf):
    events = with_block(table(spark, sf, "events"), "ts").select(F.col("user_id").alias("session_id"), "event_id", "block", ts_ms().alias("ts_ms"))
    return sessions.cool_down(events, ["session_id"], "event_id", 36_000_000.0).select("session_id", "event_id")


# ---- delta sessions


_DELTA = (
    "CASE event_type WHEN 'error' THEN 'WHY is it `BRO' WHEN 'purchase' THEN 'KEN` again?! ok. ' WHEN 'view' THEN 'Hmm... still' || chr(10) || chr(10) || 'item ' || CAST(event_id AS STRING) ELSE ' tail of it! And' END"
)
_KIND = "CASE WHEN event_id % 9 = 0 THEN 'set_config' WHEN event_type = 'signup' THEN 'message_end' ELSE 'delta' END"


def _delta_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.expr(_KIND).alias("type"), F.expr(_DELTA).alias("text"), (F.col("event_id") % 2 == 0).alias("enabled")
    )


# The check assembles every unit (up to a message end or a switch-off) as one text.
_CODE_FREE = "regexp_replace(regexp_replace(body, '`[^`]*`', '', 'g'), '`.*', '', 's')"
_CHUNKS_SQL = with_sql(
    {
        "d": f"SELECT user_id AS session_id, event_id, {_KIND} AS type, {_DELTA} AS text, event_id % 2 = 0 AS enabled, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
        # the switch in force before each event
        "sw": "SELECT *, coalesce(last_value(CASE WHEN type = 'set_config' THEN enabled END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS was FROM d",
        "un": "SELECT *, type = 'message_end' OR (type = 'set_config' AND was AND NOT enabled) AS ends FROM sw",
        "uu": "SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY session_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM un",
        # what has been fed, and whether the gate was ever open after it
        "ag": "SELECT session_id, unit, string_agg(CASE WHEN type = 'delta' THEN text ELSE '' END, '' ORDER BY rn) AS body, max(CASE WHEN ends AND type = 'message_end' AND was THEN 1 ELSE 0 END) = 1 AS flushed, "
        "max(CASE WHEN (type = 'delta' AND was) OR (type = 'set_config' AND enabled) THEN rn END) AS drained FROM uu GROUP BY ALL",
        "bd": "SELECT u.session_id, u.unit, a.flushed, string_agg(CASE WHEN u.type = 'delta' AND (a.flushed OR u.rn <= a.drained) THEN u.text ELSE '' END, '' ORDER BY u.rn) AS body FROM uu u JOIN ag a USING (session_id, unit) WHERE a.drained IS NOT NULL OR a.flushed GROUP BY ALL",
        "cd": f"SELECT session_id, unit, flushed, {_CODE_FREE} AS t FROM bd",
        "pc": "SELECT session_id, unit, flushed, string_split(regexp_replace(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n\\n+', chr(1), 'g'), chr(1)) AS p FROM cd",
        "ck": "SELECT session_id, unit, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in CASE WHEN flushed THEN p ELSE p[1:len(p) - 1] END], lambda x: strlen(x) > 2) AS c FROM pc",
    },
    "SELECT session_id, generate_subscripts(c, 1) - 1 AS chunk_idx, unnest(c) AS chunk FROM ck",
)


@query("session_chunks", _CHUNKS_SQL)
def session_chunks(spark, sf):
    events = with_block(_delta_events(table(spark, sf, "events")), "ts")
    return sessions.session_chunks(events, ["session_id"], ["ts", "event_id"], "event_id").select("session_id", "chunk_idx", "chunk")


@query("stream_session_chunks", _CHUNKS_SQL)
def stream_session_chunks(spark, sf):
    chunks = stateful.sentence_chunks(_delta_events(stream_events(spark, sf)), ["session_id"], ["ts", "event_id"], "event_id")
    return stateful.run_available(chunks).select("session_id", "chunk_idx", "chunk")


_LIMITS = {"threshold": 30.0, "min_silence": 2, "min_speech": 3, "max_speech": 8}
_UTTERANCES = with_sql(
    {
        **FRAMES,
        "f": "SELECT series_id, frame_idx, value > 30 AS loud, frame_idx = max(frame_idx) OVER (PARTITION BY series_id) AS flush FROM frames",
        # state: start (-1 idle), length, speech, silence; emitted start and length
        "u": "SELECT series_id, -1::BIGINT AS frame_idx, -1::BIGINT AS st, 0::BIGINT AS len, 0::BIGINT AS sp, 0::BIGINT AS si, NULL::BIGINT AS e_st, NULL::BIGINT AS e_len, NULL::BIGINT AS e_sp FROM (SELECT DISTINCT series_id FROM f) UNION ALL "
        "SELECT series_id, frame_idx, CASE WHEN shut THEN -1 ELSE st END, CASE WHEN shut THEN 0 ELSE len END, CASE WHEN shut THEN 0 ELSE sp END, CASE WHEN shut THEN 0 ELSE si END, "
        "CASE WHEN shut AND sp >= 3 THEN st END, CASE WHEN shut AND sp >= 3 THEN CASE WHEN si >= 2 THEN len - si ELSE len END END, CASE WHEN shut AND sp >= 3 THEN sp END FROM ("
        "SELECT *, st >= 0 AND (si >= 2 OR sp >= 8 OR flush) AS shut FROM (SELECT f.series_id, f.frame_idx, f.flush, CASE WHEN u.st >= 0 THEN u.st WHEN loud THEN f.frame_idx ELSE -1 END AS st, "
        "CASE WHEN u.st >= 0 OR loud THEN u.len + 1 ELSE 0 END AS len, CASE WHEN loud THEN u.sp + 1 ELSE u.sp END AS sp, CASE WHEN loud OR u.st < 0 THEN 0 ELSE u.si + 1 END AS si FROM u JOIN f ON f.series_id = u.series_id AND f.frame_idx = u.frame_idx + 1))",
    },
    "SELECT series_id, e_st AS start_idx, e_len AS n_frames, e_sp AS speech_frames FROM u WHERE e_st IS NOT NULL",
)


@query("utterances", _UTTERANCES)
def utterances(spark, sf):
    return sessions.utterance_segments(frames(spark, sf), ["series_id"], **_LIMITS)


@query("stream_utterances", _UTTERANCES)
def stream_utterances(spark, sf):
    fr = frames(spark, sf)
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.count(F.lit(1)).alias("_n"))
    marked = fr.join(last, "series_id").select("series_id", "frame_idx", "value", (F.col("frame_idx") + 1 == F.col("_n")).alias("flush"))
    return stateful.run_available(stateful.utterances(stateful.staged(marked), ["series_id"], **_LIMITS))


# ---- ordered delivery


_ARRIVALS = {
    **FRAMES,
    "arr": "SELECT series_id AS session_id, frame_idx AS idx, value / 100 AS secs FROM frames WHERE value >= 5",
    "ses": "SELECT series_id AS session_id, series_id % 4 AS cursor, CASE WHEN series_id % 3 = 0 THEN NULL ELSE count(*) END AS total FROM frames GROUP BY series_id",
    "ah": "SELECT a.session_id, a.idx, a.secs, s.cursor, a.idx - (row_number() OVER (PARTITION BY a.session_id ORDER BY a.idx) - 1) = s.cursor AS ready FROM arr a JOIN ses s USING (session_id) WHERE idx >= cursor",
    "ag": "SELECT session_id, count(*) FILTER (ready) AS b, coalesce(sum(secs) FILTER (ready), 0) AS bs, max(idx) AS hi FROM ah GROUP BY session_id",
    "sn": "SELECT s.session_id, s.cursor, s.total, coalesce(b, 0) AS b, coalesce(bs, 0) AS bs, coalesce(s.total, hi + 1, s.cursor) AS fin FROM ses s LEFT JOIN ag USING (session_id)",
}


@query(
    "buffer_snapshot",
    with_sql(
        _ARRIVALS,
        f"SELECT session_id, b AS buffered, {r('bs', 5)} AS buffered_s, greatest(greatest(fin - cursor, 0) - b, 0) AS pending, coalesce(cursor >= total, false) AS complete FROM sn",
    ),
)
def buffer_snapshot(spark, sf):
    fr = frames(spark, sf)
    arrivals = fr.filter("value >= 5").select(F.col("series_id").alias("session_id"), F.col("frame_idx").alias("idx"), (F.col("value") / 100).alias("secs"), "block")
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("_n"))
    who = F.col("session_id")
    state = counts.select("session_id", (who % 4).alias("cursor"), F.when(who % 3 != 0, F.col("_n")).alias("total"))
    out = sessions.buffer_snapshot(arrivals, state, ["session_id"])
    return out.withColumn("buffered_s", rnd(F.col("buffered_s"), 5))


_ORDERED = with_sql(
    {
        **FRAMES,
        "a": "SELECT series_id AS session_id, frame_idx AS idx, 'c' || event_id AS payload, row_number() OVER (PARTITION BY series_id ORDER BY value, event_id) - 1 AS arrived FROM frames",
    },
    "SELECT session_id, idx, payload, max(arrived) OVER (PARTITION BY session_id ORDER BY idx) AS released_by FROM a",
)


def _arrivals(spark, sf):
    fr = frames(spark, sf).select(F.col("series_id").alias("session_id"), F.col("frame_idx").alias("idx"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("payload"), "value", "event_id", "block")
    return with_position(with_block(fr.withColumnRenamed("block", "iblock"), "value"), ["session_id"], ["value", "event_id"], "block", "arrived")


@query("ordered_delivery", _ORDERED)
def ordered_delivery(spark, sf):
    """Index k is released by the latest arrival among 0..k."""
    out = ordered.prefix(_arrivals(spark, sf).withColumn("released_by", F.col("arrived")), ["session_id"], ["idx"], "iblock", {"released_by": F.col("arrived")}, how="max")
    return out.select("session_id", "idx", "payload", "released_by")


@query("stream_ordered_delivery", _ORDERED)
def stream_ordered_delivery(spark, sf):
    results = _arrivals(spark, sf).select("session_id", "idx", "payload", "arrived")
    return stateful.run_available(stateful.reassembled(stateful.staged(results), ["session_id"]))


_FENCE = with_sql(
    {
        "q": "SELECT user_id AS session_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS t, epoch_us(ts) / 1000.0::DOUBLE + value * 600000 AS f FROM events WHERE event_type <> 'error'",
        "z": "SELECT user_id AS session_id, epoch_us(ts) / 1000.0::DOUBLE AS t FROM events WHERE event_type = 'error'",
        "g": "SELECT q.session_id, q.event_id, count(*) FILTER (z.t <= q.t) AS a, count(*) FILTER (z.t <= q.f) AS b FROM q LEFT JOIN z ON z.session_id = q.session_id AND z.t <= q.f GROUP BY ALL",
    },
    "SELECT session_id, event_id, a AS generation FROM g WHERE a = b",
)


@query("fenced_results", _FENCE)
def fenced_results(spark, sf):
    events = table(spark, sf, "events").withColumn("ts_ms", ts_ms()).withColumnRenamed("user_id", "session_id")
    requests = events.filter("event_type <> 'error'").withColumn("done_ms", F.col("ts_ms") + F.col("value") * 600000)
    return sessions.fenced_results(requests, events.filter("event_type = 'error'"), ["session_id"], "event_id", _block_on_ms)


@query("stream_fenced_results", _FENCE)
def stream_fenced_results(spark, sf):
    events = stream_events(spark, sf).withColumn("ts_ms", ts_ms())
    reset = F.col("event_type") == "error"
    done = F.col("ts_ms") + F.col("value") * 600000
    mark = lambda kind, at, src: F.struct(F.lit(kind).alias("type"), at.alias("at"), F.lit(src).alias("src"))
    kinds = F.when(reset, F.array(mark("reset", F.col("ts_ms"), 0))).otherwise(F.array(mark("request", F.col("ts_ms"), 1), mark("result", done, 2)))
    marks = events.select(F.col("user_id").alias("session_id"), "event_id", F.inline(kinds))
    return stateful.run_available(stateful.fenced_results(marks, ["session_id"], ["at", "src", "event_id"], "event_id"))


_REPLAY = with_sql(
    {**FRAMES, "l": "SELECT series_id AS session_id, frame_idx AS idx, event_id, row_number() OVER (PARTITION BY series_id ORDER BY frame_idx DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM frames"},
    "SELECT session_id, idx, 'c' || event_id AS text FROM l WHERE rn <= 20 AND idx > n - 25 + session_id % 20",
)


@query("recent_replay", _REPLAY)
def recent_replay(spark, sf):
    log = frames(spark, sf).select(F.col("series_id").alias("session_id"), F.col("frame_idx").alias("idx"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("text"))
    resumes = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    asked = resumes.select("session_id", (F.col("n") - 25 + F.col("session_id") % 20).alias("last_seen"))
    return sessions.replay(log, asked, ["session_id"]).select("session_id", "idx", "text")


@query("stream_recent_replay", _REPLAY)
def stream_recent_replay(spark, sf):
    """Every session logs its chunks, then reconnects once."""
    fr = frames(spark, sf).select(F.col("series_id").alias("session_id"), F.col("frame_idx").alias("at"), F.lit("chunk").alias("type"), F.col("frame_idx").alias("idx"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("text"))
    sizes = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    asked = sizes.select("session_id", F.col("n").alias("at"), F.lit("resume").alias("type"), (F.col("n") - 25 + F.col("session_id") % 20).alias("idx"), F.lit(None).cast("string").alias("text"))
    marks = stateful.staged(fr.unionByName(asked))
    return stateful.run_available(stateful.replayed(marks, ["session_id"], ["at"])).select("session_id", "idx", "text")


_JOBS = "SELECT user_id, max(CASE WHEN event_id % 14 = 7 THEN event_id END) AS step, max(CASE WHEN event_id % 14 = 7 THEN 0.75 END)::DOUBLE AS loss, CASE WHEN count(*) FILTER (event_id % 14 = 10) > 0 THEN 'failed' ELSE 'running' END AS state FROM events GROUP BY user_id"


@query("stream_job_status", _JOBS)
def stream_job_status(spark, sf):
    lines = stream_events(spark, sf).select("event_id", "user_id", F.expr(_LOG).alias("value"))
    return stateful.run_available(stateful.job_status(lines, ["user_id"], "event_id"), mode="complete")


# ---- state by entries, late rows, followed logs


@query(
    "stream_delivery_status",
    with_sql(
        {
            **FRAMES,
            "n": "SELECT series_id AS session_id, count(*) AS n FROM frames GROUP BY series_id",
            # every third session is not closed, another third misses its last chunk
            "g": "SELECT session_id, CASE WHEN session_id % 3 = 1 THEN n - 1 ELSE n END AS received, CASE WHEN session_id % 3 > 0 THEN n END AS total FROM n",
        },
        "SELECT session_id, CASE WHEN total IS NULL THEN 'filling' WHEN received >= total THEN 'done' ELSE 'draining' END AS status, received AS played, received, total, received AS chunks FROM g",
    ),
)
def stream_delivery_status(spark, sf):
    arrivals = _arrivals(spark, sf).select("session_id", "idx", "payload", "arrived")
    sizes = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    sent = arrivals.join(sizes, "session_id").where("session_id % 3 <> 1 OR idx < n - 1").drop("n").withColumn("total", F.lit(None).cast("bigint"))
    ends = sizes.where("session_id % 3 > 0").select("session_id", F.lit(None).cast("bigint").alias("idx"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("bigint").alias("arrived"), F.col("n").alias("total"))
    folder = stateful.waves(sent.unionByName(ends).withColumn("wave", F.pmod(F.xxhash64("session_id", "idx"), F.lit(3))), "wave", 3)
    stream = stateful.read_stream(spark, folder, sent.schema, files_per_trigger=4)
    out = stateful.run_available(keyed.delivery(stream, ["session_id"]))
    last = F.max(F.when(F.col("kind") != "chunk", F.struct("received", F.coalesce("total", F.lit(-1)).alias("t"), "idx", "kind", "total")))
    ends = out.groupBy("session_id").agg(last.alias("s"), F.count_if(F.col("kind") == "chunk").alias("chunks"))
    return ends.select("session_id", F.col("s.kind").alias("status"), F.col("s.idx").alias("played"), "s.received", "s.total", "chunks")


@query("stream_event_time_fence", _FENCE)
def stream_event_time_fence(spark, sf):
    """Decided as the watermark passes each result; a last row of another session moves it to the end."""
    events = table(spark, sf, "events").withColumn("ts_ms", ts_ms())
    done = F.col("ts_ms") + F.col("value") * 600000
    mark = lambda kind, at: F.struct(F.lit(kind).alias("type"), at.alias("at"))
    kinds = F.when(F.col("event_type") == "error", F.array(mark("reset", F.col("ts_ms")))).otherwise(F.array(mark("request", F.col("ts_ms")), mark("result", done)))
    marks = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("request"), F.inline(kinds))
    edges = marks.agg(F.percentile_approx("at", [0.0, 0.34, 0.67, 1.0]).alias("q")).first()["q"] or [0.0] * 4
    last = spark.createDataFrame([(None, -1, "reset", float(edges[3]) + 9e9, 3)], "session_id long, request long, type string, at double, wave int")
    wave = F.when(F.col("at") < edges[1], 0).when(F.col("at") < edges[2], 1).otherwise(2)
    rows = marks.withColumn("wave", wave).unionByName(last).withColumn("ts", F.timestamp_micros((F.col("at") * 1000).cast("bigint")))
    folder = stateful.waves(rows, "wave", 4)
    stream = stateful.read_stream(spark, folder, rows.drop("wave").schema, files_per_trigger=4)
    out = stateful.run_available(keyed.fence(stream.withWatermark("ts", "1 hour"), ["session_id"], 864_000_000.0))
    return out.select("session_id", F.col("request").alias("event_id"), "generation")


_SPEND = {
    "c": "SELECT event_id, event_id % 4 AS w, ts, value / 10 AS a, value < 20 AS hit, value * 100.0 / 7 AS rtt FROM events",
    "m": "SELECT w, max(max(ts)) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS mark FROM c GROUP BY w",
    "g": f"SELECT *, coalesce(ts < mark, false) AS late, CASE WHEN hit THEN 0 ELSE {tables.GPU_BASE_S} + a * {tables.GPU_PER_AUDIO_S} END::DOUBLE * {tables.GPU_USD_PER_S} AS cost FROM c JOIN m USING (w)",
}


def _running_spend(spark, sf):
    calls = table(spark, sf, "events").select(
        "event_id", "ts", (F.col("event_id") % 4).alias("wave"), (F.col("value") / 10).alias("audio_duration_sec"), (F.col("value") < 20).alias("cache_hit"), (F.col("value") * 100.0 / 7).alias("rtt_ms"), F.lit("x").alias("text")
    )
    rows = sessions.receipts(calls)
    folder = stateful.waves(rows, "wave", 4)
    schema = rows.drop("wave").schema
    return spend.RunningSpend(spark, schema, "10 DAYS").run(stateful.read_stream(spark, folder, schema, files_per_trigger=4))


@query(
    "stream_running_spend",
    with_sql(
        _SPEND,
        f"SELECT CAST(ts::DATE AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (hit) AS hits, {r('count(*) FILTER (hit) * 100.0 / count(*)', 4)} AS hit_pct, {r('sum(a)', 3)} AS audio_sec, {r('sum(cost)', 6)} AS cost_usd, "
        f"{r('avg(rtt)', 5)} AS mean_rtt_ms, {r('min(rtt)', 5)} AS min_rtt_ms, {r('max(rtt)', 5)} AS max_rtt_ms FROM g WHERE NOT late GROUP BY ts::DATE",
    ),
)
def stream_running_spend(spark, sf):
    """Calls arrive in four waves; what lies more than ten days behind is late."""
    out = _running_spend(spark, sf).totals("day")
    digits = {"hit_pct": 4, "audio_sec": 3, "cost_usd": 6, "mean_rtt_ms": 5, "min_rtt_ms": 5, "max_rtt_ms": 5}
    return out.select(F.col("day").cast("string").alias("day"), "calls", "hits", *[rnd(F.col(c), d).alias(c) for c, d in digits.items()])


@query("stream_late_rows", with_sql(_SPEND, f"SELECT event_id, {r('cost', 6)} AS cost_usd FROM g WHERE late"))
def stream_late_rows(spark, sf):
    return _running_spend(spark, sf).late_rows().select("event_id", rnd(F.col("cost_usd"), 6).alias("cost_usd"))


@query(
    "stream_followed_log",
    "WITH l AS (SELECT event_id, user_id % 8 AS job, event_id % 14 AS k, event_id % 3 * 1000000000 + event_id AS pos FROM events) "
    "SELECT job, count(*) AS lines, count(*) FILTER (k NOT IN (5, 11)) AS events, arg_max(event_id, pos) FILTER (k = 7) AS step, max(0.75) FILTER (k = 7)::DOUBLE AS loss, "
    "CASE WHEN count(*) FILTER (k = 10) > 0 THEN 'failed' ELSE 'running' END AS state FROM l GROUP BY job",
)
def stream_followed_log(spark, sf):
    """Eight jobs log in three waves of text files."""
    lines = table(spark, sf, "events").select("event_id", (F.col("user_id") % 8).alias("job"), (F.col("event_id") % 3).alias("wave"), F.expr(_LOG).alias("value"))
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    for wave in range(3):
        part = lines.where(F.col("wave") == wave).repartition(4, "job").sortWithinPartitions("job", "event_id")
        part.select("job", "value").write.mode("append").partitionBy("job").text(folder)
    job = F.regexp_extract("file", "job=([0-9]+)", 1).cast("bigint")
    return followed.FollowedLog(spark, job).run(followed.stream_lines(spark, folder, 3)).status()


# ---- warped alignment and regions


def _warp_sql(series: str) -> dict[str, str]:
    """Alignment of pairs of a relation (pair_id, side, idx, x): `way` has its cells, with k from the end."""
    row = "list_reduce(list_prepend([]::DOUBLE[], list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE])), lambda done, j: list_append(done, {cell}))"
    at = "abs(a[i] - b[CAST(j[1] AS INT)])"
    first = row.format(cell="abs(a[1] - b[CAST(j[1] AS INT)]) + CASE WHEN len(done) = 0 THEN 0 ELSE done[len(done)] END")
    best = "least(coalesce(prev[len(done)], 'infinity'::DOUBLE), prev[len(done) + 1], CASE WHEN len(done) = 0 THEN 'infinity'::DOUBLE ELSE done[len(done)] END)"
    inner = row.format(cell=f"{at} + {best}")
    return {
        "two": f"SELECT pair_id, list(x ORDER BY idx) FILTER (side = 0) AS a, list(x ORDER BY idx) FILTER (side = 1) AS b FROM {series} GROUP BY pair_id HAVING count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0",
        "cost": f"SELECT pair_id, 1::BIGINT AS i, {first} AS d FROM two UNION ALL "
        f"SELECT pair_id, i, {inner} FROM (SELECT c.pair_id, c.i + 1 AS i, c.d AS prev, s.a, s.b FROM cost c JOIN two s USING (pair_id) WHERE c.i < len(s.a))",
        "way": "SELECT pair_id, len(a)::BIGINT AS i, len(b)::BIGINT AS j, 0::BIGINT AS k FROM two UNION ALL "
        "SELECT pair_id, CASE WHEN step < 2 THEN i - 1 ELSE i END, CASE WHEN step <> 1 THEN j - 1 ELSE j END, k + 1 FROM ("
        "SELECT *, CASE WHEN diag <= up AND diag <= side THEN 0 WHEN up <= side THEN 1 ELSE 2 END AS step FROM (SELECT w.pair_id, w.i, w.j, w.k, "
        "CASE WHEN w.i > 1 AND w.j > 1 THEN p.d[w.j - 1] ELSE 'infinity'::DOUBLE END AS diag, CASE WHEN w.i > 1 THEN p.d[w.j] ELSE 'infinity'::DOUBLE END AS up, "
        "CASE WHEN w.j > 1 THEN c.d[w.j - 1] ELSE 'infinity'::DOUBLE END AS side "
        "FROM way w JOIN cost c ON c.pair_id = w.pair_id AND c.i = w.i LEFT JOIN cost p ON p.pair_id = w.pair_id AND p.i = w.i - 1 WHERE w.i > 1 OR w.j > 1))",
    }


def _contours(spark, sf):
    fr = kept(frames(spark, sf).select("series_id", "frame_idx", "value"), "contours").withColumn("pair_id", F.floor(F.col("series_id") / 2))
    side = lambda s: fr.filter(F.col("series_id") % 2 == s).select("pair_id", "frame_idx", "value")
    return side(0), side(1)


_CORRELATION = with_sql(
    {
        **FRAMES,
        "x": "SELECT series_id // 2 AS pair_id, series_id % 2 AS side, frame_idx AS idx, value AS x FROM frames",
        **_warp_sql("x"),
        "cells": "SELECT w.pair_id, s.a[w.i] AS u, s.b[w.j] AS v FROM way w JOIN two s USING (pair_id)",
        "st": "SELECT pair_id, count(*) AS n, covar_pop(u, v) AS c, sqrt(var_pop(u) * var_pop(v)) AS sd FROM cells GROUP BY pair_id",
    },
    f"SELECT pair_id, n, {r('CASE WHEN n < 2 OR sd * n < 1e-12 THEN 0 ELSE greatest(-1, least(1, c / sd)) END', 6)} AS correlation FROM st",
)


@query("contour_correlation", _CORRELATION)
def contour_correlation(spark, sf):
    path = alignment.warp(*_contours(spark, sf), ["pair_id"])
    out = alignment.contour_correlation(path, ["pair_id"])
    return out.select("pair_id", "n", rnd(F.col("correlation"), 6).alias("correlation"))


def _tempo(spark, sf):
    """(matches, totals): segment durations of a reference series warped onto its partner's."""
    seg = kept(with_position(segments(spark, sf), ["series_id"], ["start_idx"], "block", "seg_no"), "segments").withColumn("pair_id", F.floor(F.col("series_id") / 2))
    side = lambda s: seg.filter(F.col("series_id") % 2 == s)
    path = alignment.warp(side(0), side(1), ["pair_id"], idx="seg_no", value="duration_s")
    kinds = side(0).select("pair_id", F.col("seg_no").alias("ref_idx"), "kind")
    named = path.join(kinds, ["pair_id", "ref_idx"]).select(
        "pair_id", "path_pos", "ref_idx", "kind", F.col("ref_value").alias("ref_duration_s"), F.col("syn_value").alias("syn_duration_s")
    )
    total = lambda s: F.sum(F.when(F.col("series_id") % 2 == s, F.col("duration_s")))
    totals = seg.groupBy("pair_id").agg(total(0).alias("ref_total_s"), total(1).alias("syn_total_s"))
    return compare.tempo_matches(named), totals


_TEMPO = {
    **SEGMENTS,
    "sg": f"SELECT series_id // 2 AS pair_id, series_id % 2 AS side, kind, row_number() OVER (PARTITION BY series_id ORDER BY start_idx) - 1 AS idx, "
    f"(start_idx + n_frames) * {FRAME_S}::DOUBLE - start_idx * {FRAME_S}::DOUBLE AS x FROM segments",
    **_warp_sql("sg"),
    # the first match of each reference segment
    "mt": "SELECT w.pair_id, w.i - 1 AS ref_idx, first(s.a[w.i]) AS rd, first(s.b[w.j] ORDER BY w.k DESC) AS sd FROM way w JOIN two s USING (pair_id) GROUP BY w.pair_id, w.i",
    "rt": "SELECT mt.*, g.kind, CASE WHEN rd > 0.01 THEN sd / rd ELSE 1 END AS ratio FROM mt JOIN sg g ON g.pair_id = mt.pair_id AND g.side = 0 AND g.idx = mt.ref_idx",
}


@query(
    "tempo_summary",
    with_sql(
        {
            **_TEMPO,
            "ct": "SELECT pair_id, count(*) FILTER (kind = 'voiced' AND ratio < 0.7) AS rushed, count(*) FILTER (kind = 'voiced' AND ratio > 1.4) AS drawn_out FROM rt GROUP BY pair_id",
            "tt": "SELECT pair_id, sum(x) FILTER (side = 0) AS ref_s, sum(x) FILTER (side = 1) AS syn_s FROM sg GROUP BY pair_id",
        },
        f"SELECT pair_id, {r('CASE WHEN ref_s > 0 THEN syn_s / ref_s ELSE 1 END', 6)} AS overall_ratio, rushed, drawn_out FROM ct JOIN tt USING (pair_id)",
    ),
)
def tempo_summary(spark, sf):
    out = compare.tempo_summary(*_tempo(spark, sf))
    return out.withColumn("overall_ratio", rnd(F.col("overall_ratio"), 6))


@query(
    "tempo_outliers",
    with_sql(
        _TEMPO,
        f"SELECT pair_id, ref_idx, CASE WHEN ratio < 0.7 THEN 'rushed' ELSE 'drawn out' END AS tempo, {r('rd', 6)} AS ref_duration_s, {r('sd', 6)} AS syn_duration_s, {r('ratio', 6)} AS ratio FROM rt WHERE kind = 'voiced' AND (ratio < 0.7 OR ratio > 1.4)",
    ),
)
def tempo_outliers(spark, sf):
    """The rushed and drawn-out segments themselves."""
    out = compare.tempo_outliers(_tempo(spark, sf)[0])
    return out.select("pair_id", "ref_idx", "tempo", *[rnd(F.col(c), 6).alias(c) for c in ("ref_duration_s", "syn_duration_s", "ratio")])


_norm = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-6 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END"
_REGIONS = with_sql(
    {
        "t": "SELECT l_partkey, p_brand AS sweep, avg(l_quantity)::DOUBLE AS a, avg(l_discount)::DOUBLE AS b, avg(l_tax)::DOUBLE AS c, avg(l_extendedprice)::DOUBLE AS d FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
        "n": f"SELECT l_partkey, sweep, [{', '.join(map(_norm, 'abcd'))}] AS p, row_number() OVER (PARTITION BY sweep ORDER BY l_partkey) AS rn FROM t WINDOW w AS (PARTITION BY sweep)",
        # every row of a sweep in turn, with the centres so far
        "g": "SELECT sweep, rn, l_partkey, [p] AS centres, true AS centre FROM n WHERE rn = 1 UNION ALL "
        "SELECT sweep, rn, l_partkey, CASE WHEN far THEN list_append(centres, p) ELSE centres END, far FROM (SELECT n.sweep, n.rn, n.l_partkey, n.p, g.centres, "
        "list_min(list_transform(g.centres, lambda q: list_distance(q, n.p))) > 0.25 AS far FROM g JOIN n ON n.sweep = g.sweep AND n.rn = g.rn + 1)",
    },
    "SELECT sweep, l_partkey FROM g WHERE centre",
)


@query("distinct_regions", _REGIONS)
def distinct_regions(spark, sf):
    """Greedy region centres per brand over four normalised features."""
    trials = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"), F.avg("l_extendedprice").alias("d")
        )
        .join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sweep")), "l_partkey")
    )
    features = ["a", "b", "c", "d"]
    return sessions.distinct_regions(signal.min_max_normalise(trials, features, ["sweep"]), ["sweep"], "l_partkey", features)


# ---- the session rules in event time: rows come in waves, up to five days out of order


def _late_stream(rows: DataFrame, key: str) -> DataFrame:
    """The rows as a stream in three waves by a shifted time, and a last row of no session that moves the watermark to the end."""
    spark = rows.sparkSession
    shifted = F.unix_micros("ts") / 1e6 + F.pmod(F.xxhash64("ts", key), F.lit(432_000))
    edges = rows.agg(F.percentile_approx(shifted, [0.34, 0.67]).alias("q"), F.max("ts").alias("end")).first()
    first, second = edges["q"] or [0.0, 0.0]
    wave = F.when(shifted < first, 0).when(shifted < second, 1).otherwise(2)
    end = spark.range(1).select(
        *[(F.lit(edges["end"]) + F.expr("INTERVAL 100 DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields], F.lit(3).alias("wave")
    )
    folder = stateful.waves(rows.withColumn("wave", wave).unionByName(end), "wave", 4)
    return stateful.read_stream(spark, folder, rows.schema, files_per_trigger=4).withWatermark("ts", "6 days")


@query("event_time_session_chunks", _CHUNKS_SQL)
def event_time_session_chunks(spark, sf):
    stream = _late_stream(_delta_events(table(spark, sf, "events")), "session_id")
    return stateful.run_available(eventtime.sentence_chunks(stream, ["session_id"], "event_id")).select("session_id", "chunk_idx", "chunk")


@query("event_time_emotion_states", _STATES_SQL)
def event_time_emotion_states(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", ts_ms().alias("ts_ms"), F.expr(MESSAGE).alias("text"))
    readings = text_ops.tag_emotion(events).select("session_id", "ts", "event_id", "ts_ms", "emotion", "confidence")
    return _state_columns(stateful.run_available(eventtime.emotion_states(_late_stream(readings, "session_id"), ["session_id"], "event_id")))


@query("event_time_filler_plan", _FILLER)
def event_time_filler_plan(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("value") * 100.0 / 7).alias("rtt_ms"), (F.lit(44) + F.floor(F.col("value") * 4000)).alias("audio_bytes")
    )
    return _filler_columns(stateful.run_available(eventtime.filler_plan(_late_stream(events, "session_id"), ["session_id"], "event_id")))


@query("event_time_utterances", _UTTERANCES)
def event_time_utterances(spark, sf):
    fr = frames(spark, sf)
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.count(F.lit(1)).alias("_n"))
    marked = fr.join(last, "series_id").select("series_id", "ts", "frame_idx", "value", (F.col("frame_idx") + 1 == F.col("_n")).alias("flush"))
    return stateful.run_available(eventtime.utterances(_late_stream(marked, "series_id"), ["series_id"], **_LIMITS))


@query("event_time_replay", _REPLAY)
def event_time_replay(spark, sf):
    """Every session logs its chunks, then reconnects once, a second after the last."""
    fr = frames(spark, sf).select(F.col("series_id").alias("session_id"), "ts", F.col("frame_idx").alias("at"), F.lit("chunk").alias("type"), F.col("frame_idx").alias("idx"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("text"))
    sizes = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"), (F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    asked = sizes.select("session_id", "ts", F.col("n").alias("at"), F.lit("resume").alias("type"), (F.col("n") - 25 + F.col("session_id") % 20).alias("idx"), F.lit(None).cast("string").alias("text"))
    stream = _late_stream(fr.unionByName(asked), "session_id")
    return stateful.run_available(eventtime.replayed(stream, ["session_id"])).select("session_id", "idx", "text")
