"""Signal queries over ``events``: a user is a series, an event a frame.

``value`` plays the amplitude (silence below 30), position is the rank by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import verdicts
from voxframe.functions.scalar import rnd
from voxframe.operators import signal
from voxframe.operators.ordered import with_block, with_position
from voxframe.operators.recursions import kept
from voxframe.plans.registry import query, rnd_sql as r, table, with_sql

SILENT = 30.0
FRAME_S = 0.05
RATE = 20.0


def frames(spark: SparkSession, sf: str) -> DataFrame:
    events = with_block(table(spark, sf, "events"), "ts").select(
        F.col("user_id").alias("series_id"), "ts", "event_id", "event_type", "value", "block"
    )
    return with_position(events, ["series_id"], ["ts", "event_id"], "block")


FRAMES = {
    "frames": "SELECT user_id AS series_id, ts, event_id, event_type, value, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events"
}

RUNS = {
    **FRAMES,
    "marked": f"SELECT *, value >= {SILENT} AS flag, frame_idx - row_number() OVER "
    f"(PARTITION BY series_id, value >= {SILENT} ORDER BY frame_idx) AS grp FROM frames",
    "seg": "SELECT series_id, flag, min(frame_idx) AS start_idx, count(*) AS n_frames, sum(value * value) AS ss "
    "FROM marked GROUP BY series_id, flag, grp",
}

SEGMENTS = {
    **RUNS,
    "segments": "SELECT series_id, CASE WHEN flag THEN 'voiced' ELSE 'silence' END AS kind, start_idx, n_frames, "
    f"start_idx * {FRAME_S} AS start_s, (start_idx + n_frames) * {FRAME_S} AS end_s, "
    f"(start_idx + n_frames) * {FRAME_S} - start_idx * {FRAME_S} AS duration_s, "
    "20 * log10(sqrt(ss / n_frames)) AS rms_db FROM seg",
}


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return signal.vad_segments(frames(spark, sf), SILENT, FRAME_S)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[rnd(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(
    "loudness",
    "SELECT user_id AS series_id, "
    f"{r('20*log10(sqrt(sum(value*value)/count(*)))', 6)} AS rms_db, {r('20*log10(max(abs(value)))', 6)} AS peak_db, "
    f"{r('20*log10(max(abs(value))) - 20*log10(sqrt(sum(value*value)/count(*)))', 6)} AS crest "
    "FROM events GROUP BY user_id",
)
def loudness(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "series_id")
    return _rounded(signal.loudness(events), 6, "rms_db", "peak_db", "crest")


@query(
    "energy_envelope",
    with_sql(
        FRAMES,
        f"SELECT series_id, CAST(frame_idx // 5 AS BIGINT) AS chunk, {r('sqrt(sum(value*value)/count(*))', 6)} AS rms, "
        "count(*) AS n FROM frames GROUP BY ALL",
    ),
)
def energy_envelope(spark, sf):
    return _rounded(signal.energy_envelope(frames(spark, sf), 5), 6, "rms")


@query(
    "energy_dump",
    with_sql(
        FRAMES,
        f"SELECT series_id, CAST(frame_idx // 4 AS BIGINT) AS chunk, {r('20*log10(sqrt(sum(value*value)/count(*)) + 1e-10)', 6)} "
        "AS level_db FROM frames GROUP BY series_id, frame_idx // 4 HAVING count(*) = 4",
    ),
)
def energy_dump(spark, sf):
    out = signal.energy_dump(frames(spark, sf), 4).select("series_id", "chunk", "level_db")
    return _rounded(out, 6, "level_db")


@query(
    "vad_segments",
    with_sql(
        SEGMENTS,
        f"SELECT series_id, kind, start_idx, n_frames, {r('start_s', 4)} AS start_s, {r('end_s', 4)} AS end_s, "
        f"{r('rms_db', 6)} AS rms_db FROM segments",
    ),
)
def vad_segments(spark, sf):
    out = segments(spark, sf).select("series_id", "kind", "start_idx", "n_frames", "start_s", "end_s", "rms_db")
    return _rounded(_rounded(out, 4, "start_s", "end_s"), 6, "rms_db")


@query(
    "timeline_summary",
    with_sql(
        SEGMENTS,
        "SELECT series_id, count(*) FILTER (kind = 'silence' AND n_frames >= 2) AS pause_count, "
        f"{r(f'sum(CASE WHEN flag THEN 0 ELSE n_frames END) * {FRAME_S} / (max(start_idx + n_frames) * {FRAME_S})', 6)} "
        "AS silence_ratio "
        "FROM (SELECT *, kind = 'voiced' AS flag FROM segments) GROUP BY series_id",
    ),
)
def timeline_summary(spark, sf):
    out = signal.timeline_summary(segments(spark, sf), pause_s=0.09).drop("total_s")
    return _rounded(out, 6, "silence_ratio")


@query(
    "pause_runs",
    with_sql(
        RUNS,
        f"SELECT series_id, start_idx, n_frames, {r(f'n_frames * {FRAME_S}', 4)} AS pause_s "
        "FROM seg WHERE NOT flag AND n_frames >= 3",
    ),
)
def pause_runs(spark, sf):
    out = signal.pauses(frames(spark, sf), SILENT, FRAME_S, min_s=0.14)
    return _rounded(out.select("series_id", "start_idx", "n_frames", "pause_s"), 4, "pause_s")


@query(
    "temporal_metrics",
    with_sql(
        RUNS,
        f"SELECT series_id, {r(f'sum(n_frames) * {FRAME_S}', 4)} AS duration_secs, "
        f"{r(f'sum(CASE WHEN flag THEN n_frames ELSE 0 END) / (sum(n_frames) * {FRAME_S})', 6)} AS speech_rate, "
        "count(*) FILTER (NOT flag AND n_frames >= 3) AS pause_count, "
        f"{r(f'coalesce(avg(CASE WHEN NOT flag AND n_frames >= 3 THEN n_frames * {FRAME_S} END), 0)', 6)} AS mean_pause_duration, "
        f"{r('sum(CASE WHEN flag THEN 0 ELSE n_frames END) / sum(n_frames)', 6)} AS pause_ratio FROM seg GROUP BY series_id",
    ),
)
def temporal_metrics(spark, sf):
    out = signal.temporal_metrics(frames(spark, sf), SILENT, FRAME_S, min_s=0.14)
    return _rounded(_rounded(out, 4, "duration_secs"), 6, "speech_rate", "mean_pause_duration", "pause_ratio")


def _centred(spark, sf):
    return frames(spark, sf).withColumn("value", F.col("value") - 50.0)


@query(
    "zero_crossing_rate",
    with_sql(
        FRAMES,
        f"SELECT series_id, {r(f'count(*) FILTER (was <> pos) / (count(*) / {RATE})', 6)} AS zcr FROM ("
        "SELECT series_id, value - 50 >= 0 AS pos, lag(value - 50 >= 0) OVER (PARTITION BY series_id ORDER BY frame_idx) "
        "AS was FROM frames) GROUP BY series_id",
    ),
)
def zero_crossing_rate(spark, sf):
    return _rounded(signal.zero_crossing_rate(_centred(spark, sf), RATE), 6, "zcr")


@query(
    "spectral_shape",
    "SELECT vec_id, "
    f"{r('CASE WHEN am > 0 THEN exp(lg / n) / (am / n) ELSE 0 END', 6)} AS flatness, "
    f"{r('CASE WHEN hi > 1e-20 THEN 10 * log10(lo / hi) ELSE 0 END', 6)} AS balance_db FROM ("
    "SELECT vec_id, len(embedding) AS n, list_sum([ln(abs(x::DOUBLE) + 1e-10) for x in embedding]) AS lg, "
    "list_sum([abs(x::DOUBLE) for x in embedding]) AS am, list_sum([x::DOUBLE*x::DOUBLE for x in embedding[1:10]]) AS lo, "
    "list_sum([x::DOUBLE*x::DOUBLE for x in embedding[11:64]]) AS hi FROM embeddings)",
)
def spectral_shape(spark, sf):
    mags = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select(
        "vec_id",
        rnd(signal.spectral_flatness(mags), 6).alias("flatness"),
        rnd(signal.band_balance(mags, 100.0), 6).alias("balance_db"),
    )


@query(
    "spectral_tilt",
    "SELECT vec_id, "
    f"{r('coalesce(regr_slope(10 * log10(m * m), log2(b * 100.0)), 0)', 6)} AS tilt_db_oct FROM ("
    "SELECT vec_id, unnest(embedding)::DOUBLE AS m, generate_subscripts(embedding, 1) - 1 AS b FROM embeddings) "
    "WHERE b >= 1 AND b < 80 AND m * m > 1e-20 GROUP BY vec_id",
)
def spectral_tilt(spark, sf):
    tilt = signal.array_tilt(F.transform("embedding", lambda x: x.cast("double")), 100.0)
    return _rounded(table(spark, sf, "embeddings").select("vec_id", tilt.alias("tilt_db_oct")), 6, "tilt_db_oct")


@query(
    "vocal_weight",
    "WITH l AS (SELECT user_id AS series_id, CAST(floor(value / 2) AS BIGINT) AS bin, "
    "sum(CASE WHEN floor(value / 2) >= 10 AND floor(value / 2) < 50 THEN value ELSE 0 END) AS p FROM events GROUP BY ALL), "
    "c AS (SELECT *, sum(p) OVER (PARTITION BY series_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, "
    "sum(p) OVER (PARTITION BY series_id) AS total FROM l) "
    f"SELECT series_id, {r('coalesce(min(CASE WHEN bin >= 10 AND bin < 50 AND total > 0 AND cum >= total * 0.5 THEN bin END) * 100.0, 3000.0)', 4)} "
    "AS vocal_weight_hz FROM c GROUP BY series_id",
)
def vocal_weight(spark, sf):
    bins = table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"), F.floor(F.col("value") / 2).alias("bin"), F.col("value").alias("power")
    )
    return _rounded(signal.vocal_weight(bins, ["series_id"], 100.0), 4, "vocal_weight_hz")


@query(
    "pitch_statistics",
    with_sql(
        {
            **FRAMES,
            "v": f"SELECT *, value >= {SILENT} AS voiced, sum(CASE WHEN value >= {SILENT} THEN 1 ELSE 0 END) OVER "
            "(PARTITION BY series_id ORDER BY frame_idx) AS ord FROM frames",
            "s": "SELECT series_id, coalesce(avg(value) FILTER (voiced), 0) AS pitch_hz, "
            "coalesce(stddev_pop(value) FILTER (voiced), 0) AS sd, avg(CASE WHEN voiced THEN 1.0::DOUBLE ELSE 0 END) AS presence, "
            f"coalesce(regr_slope(value, ord * {FRAME_S}) FILTER (voiced), 0) AS slope FROM v GROUP BY series_id",
        },
        f"SELECT series_id, {r('pitch_hz', 6)} AS pitch_hz, {r('sd', 6)} AS pitch_variation_hz, {r('presence', 6)} AS voice_presence, "
        f"{r('CASE WHEN pitch_hz > 0 THEN slope / (pitch_hz * ln(2) / 12) ELSE 0 END', 5)} AS pitch_slope_semi FROM s",
    ),
)
def pitch_statistics(spark, sf):
    out = signal.pitch_statistics(frames(spark, sf), F.col("value") >= SILENT, FRAME_S, order=["ts", "event_id"])
    return _rounded(_rounded(out, 6, "pitch_hz", "pitch_variation_hz", "voice_presence"), 5, "pitch_slope_semi")


@query(
    "jitter_shimmer",
    with_sql(
        {
            **FRAMES,
            "x": "SELECT series_id, frame_idx, value - 50 AS v, lag(value - 50) OVER (PARTITION BY series_id ORDER BY frame_idx) AS p FROM frames",
            "c": "SELECT *, sum(CASE WHEN p <= 0 AND v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame_idx) AS cyc FROM x",
            "g": "SELECT series_id, cyc, count(*) AS period, sqrt(sum(v * v) / count(*)) AS amp, "
            "max(cyc) OVER (PARTITION BY series_id) AS last FROM c WHERE cyc > 0 GROUP BY series_id, cyc",
            "a": "SELECT * FROM g WHERE cyc < last AND period BETWEEN 2 AND 8 AND amp > 10",
            "d": "SELECT *, abs(period - lag(period) OVER w) AS dp, abs(amp - lag(amp) OVER w) AS da FROM a "
            "WINDOW w AS (PARTITION BY series_id ORDER BY cyc)",
        },
        f"SELECT series_id, count(*) AS cycles, {r('coalesce(avg(dp) / avg(period), 0)', 6)} AS jitter, "
        f"{r('coalesce(avg(da) / avg(amp), 0)', 6)} AS shimmer FROM d GROUP BY series_id",
    ),
)
def jitter_shimmer(spark, sf):
    cycles = signal.glottal_cycles(_centred(spark, sf), 2, 8, 10.0)
    return _rounded(signal.jitter_shimmer(cycles), 6, "jitter", "shimmer")


@query(
    "noise_ratio",
    "WITH o AS (SELECT user_id AS series_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS rn, "
    "count(*) OVER (PARTITION BY user_id) AS n FROM events) "
    f"SELECT series_id, max(n) AS n_rows, {r('CASE WHEN max(n) >= 10 THEN max(CASE WHEN rn = floor(n * 0.10::DOUBLE) THEN value END) / max(CASE WHEN rn = floor(n * 0.90::DOUBLE) THEN value END) ELSE 0 END', 6)} "
    "AS noise_ratio FROM o GROUP BY series_id",
)
def noise_ratio(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "series_id")
    return _rounded(signal.noise_ratio(events), 6, "noise_ratio")


@query(
    "level_profile",
    with_sql(
        {
            **FRAMES,
            "c": "SELECT series_id, CAST(frame_idx // 5 AS BIGINT) AS chunk, avg(value) AS m FROM frames GROUP BY ALL",
        },
        f"SELECT series_id, chunk, {r('m', 6)} AS mean_value, CAST(least(floor(m / greatest(max(m) OVER (PARTITION BY series_id), 0.001) * 7.0 + 0.5), 7) AS BIGINT) AS level FROM c",
    ),
)
def level_profile(spark, sf):
    return _rounded(signal.level_profile(frames(spark, sf)), 6, "mean_value")


@query(
    "merge_short_silences",
    with_sql(
        {
            **SEGMENTS,
            "n": "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_idx) - 1 AS seg_no FROM segments",
            "k": "SELECT *, kind = 'voiced' OR (n_frames < 3 AND seg_no > 0) AS v FROM n",
            "g": "SELECT *, seg_no - row_number() OVER (PARTITION BY series_id, v ORDER BY seg_no) AS grp FROM k",
        },
        f"SELECT series_id, CASE WHEN v THEN 'voiced' ELSE 'silence' END AS kind, {r('min(start_s)', 4)} AS start_s, {r('max(end_s)', 4)} AS end_s, "
        f"{r('CASE WHEN v THEN max(CASE WHEN kind = $$voiced$$ THEN rms_db END) ELSE max(rms_db) END', 6)} AS rms_db "
        "FROM g GROUP BY series_id, v, grp",
    ),
)
def merge_short_silences(spark, sf):
    out = signal.merge_short_silences(segments(spark, sf), 0.14).drop("duration_s")
    return _rounded(_rounded(out, 4, "start_s", "end_s"), 6, "rms_db")


@query(
    "trim_tail",
    with_sql(
        {
            **FRAMES,
            "a": "SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS av FROM frames",
            "l": "SELECT series_id, coalesce(max(CASE WHEN av >= 70 THEN frame_idx END), 0) AS last, count(*) AS n FROM a GROUP BY series_id",
        },
        f"SELECT f.series_id, count(*) AS kept_frames, max(frame_idx) AS last_idx, {r('sum(value)', 4)} AS kept_sum FROM frames f JOIN l USING (series_id) "
        "WHERE n < 5 OR frame_idx < last + 2 GROUP BY f.series_id",
    ),
)
def trim_tail(spark, sf):
    kept = signal.trim_tail(frames(spark, sf), 70.0)
    return kept.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("kept_frames"),
        F.max("frame_idx").alias("last_idx"),
        rnd(F.sum("value"), 4).alias("kept_sum"),
    )


@query(
    "gate_mask",
    with_sql(
        FRAMES,
        "SELECT series_id, frame_idx, max(value >= 120) OVER (PARTITION BY series_id ORDER BY frame_idx "
        "ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS kept FROM frames",
    ),
)
def gate_mask(spark, sf):
    return signal.gate_mask(frames(spark, sf), 120.0).select("series_id", "frame_idx", "kept")


INTERVALS = {
    **SEGMENTS,
    "sil": "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_idx) AS no, "
    "lag(end_s, 1, 0.0) OVER (PARTITION BY series_id ORDER BY start_idx) AS pos FROM segments "
    "WHERE kind = 'silence' AND n_frames >= 2",
    "dur": f"SELECT series_id, count(*) * {FRAME_S} AS total_s FROM frames GROUP BY series_id",
    "iv": "SELECT series_id, pos AS from_s, start_s AS to_s FROM sil WHERE pos < start_s UNION ALL "
    "SELECT d.series_id, coalesce(e, 0.0) AS from_s, total_s AS to_s FROM dur d LEFT JOIN "
    "(SELECT series_id, max(end_s) AS e FROM sil GROUP BY series_id) m ON d.series_id = m.series_id WHERE coalesce(e, 0.0) < total_s",
}


def intervals(spark, sf):
    seg = kept(segments(spark, sf), "segments")
    silences = seg.filter((F.col("kind") == "silence") & (F.col("n_frames") >= 2))
    durations = seg.groupBy("series_id").agg(F.max("end_s").alias("total_s"))
    return signal.speech_intervals(silences, durations)


@query(
    "speech_intervals",
    with_sql(INTERVALS, f"SELECT series_id, {r('from_s', 4)} AS from_s, {r('to_s', 4)} AS to_s FROM iv"),
)
def speech_intervals(spark, sf):
    return _rounded(intervals(spark, sf), 4, "from_s", "to_s")


@query(
    "split_clips",
    with_sql(
        INTERVALS,
        f"SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY from_s) AS clip_no, {r('from_s', 4)} AS from_s, {r('to_s', 4)} AS to_s "
        "FROM iv WHERE to_s - from_s BETWEEN 0.12 AND 0.42",
    ),
)
def split_clips(spark, sf):
    blocked = with_block(intervals(spark, sf), "from_s")
    out = signal.split_clips(blocked, 0.12, 0.42).select("series_id", "clip_no", "from_s", "to_s")
    return _rounded(out, 4, "from_s", "to_s")


@query(
    "edge_trim",
    with_sql(
        {**FRAMES, "e": "SELECT series_id, min(frame_idx) AS a, max(frame_idx) AS b FROM frames WHERE value >= 90 GROUP BY series_id"},
        f"SELECT f.series_id, count(*) AS kept_frames, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx, {r('sum(value)', 4)} AS kept_sum "
        "FROM frames f JOIN e USING (series_id) WHERE frame_idx BETWEEN a AND b GROUP BY f.series_id",
    ),
)
def edge_trim(spark, sf):
    return (
        signal.edge_trim(frames(spark, sf), 90.0)
        .groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("kept_frames"),
            F.min("frame_idx").alias("first_idx"),
            F.max("frame_idx").alias("last_idx"),
            rnd(F.sum("value"), 4).alias("kept_sum"),
        )
    )


@query(
    "worst_frames",
    with_sql(
        FRAMES,
        f"SELECT series_id, frame_idx, {r('value', 4)} AS value, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, frame_idx) AS rank "
        "FROM frames QUALIFY rank <= 10",
    ),
)
def worst_frames(spark, sf):
    out = signal.worst_frames(frames(spark, sf)).select("series_id", "frame_idx", "value", F.col("rank").cast("bigint"))
    return _rounded(out, 4, "value")


CLEAN = {
    **FRAMES,
    "s": "SELECT series_id, frame_idx, value / 500.0 AS v FROM frames",
    "e": "SELECT series_id, count(*) AS n, min(CASE WHEN v > 0.01 THEN frame_idx END) AS a, max(CASE WHEN v > 0.01 THEN frame_idx END) AS b FROM s GROUP BY series_id",
    "i": "SELECT s.* FROM s JOIN e USING (series_id) WHERE frame_idx BETWEEN a AND b",
    "lv": "SELECT series_id, sqrt(avg(v * v)) AS rms FROM i GROUP BY series_id",
    "cl": "SELECT i.series_id, count(*) FILTER (abs(v * (pow(10.0, -14.0 / 20.0) / rms)) > 0.99) AS clipped FROM i JOIN lv USING (series_id) GROUP BY i.series_id",
    "rep": f"SELECT e.series_id, n / {RATE} AS before_s, coalesce((b - a + 1) / {RATE}, 0) AS after_s, coalesce(clipped, 0) AS clipped, "
    f"coalesce((b - a + 1) / {RATE}, 0) >= 3.2 AS kept FROM e LEFT JOIN cl USING (series_id)",
}


def _clean(spark, sf):
    samples = frames(spark, sf).withColumn("value", F.col("value") / 500.0)
    return signal.clean_report(samples, RATE, min_s=3.2)


@query(
    "clean_report",
    with_sql(CLEAN, f"SELECT series_id, {r('before_s', 4)} AS before_s, {r('after_s', 4)} AS after_s, clipped, kept FROM rep"),
)
def clean_report(spark, sf):
    return _rounded(_clean(spark, sf), 4, "before_s", "after_s")


@query(
    "clean_totals",
    with_sql(
        CLEAN,
        "SELECT count(*) FILTER (kept) AS files, count(*) FILTER (after_s = 0) AS silent_files, "
        f"{r('sum(before_s)', 4)} AS before_s, {r('coalesce(sum(CASE WHEN kept THEN after_s END), 0)', 4)} AS after_s FROM rep",
    ),
)
def clean_totals(spark, sf):
    return _rounded(signal.clean_totals(_clean(spark, sf)), 4, "before_s", "after_s")


@query(
    "duration_filter",
    with_sql(
        FRAMES,
        f"SELECT series_id, count(*) AS n_samples, {r(f'count(*) / {RATE}', 4)} AS duration_s FROM frames GROUP BY series_id HAVING count(*) / {RATE} <= 3.3",
    ),
)
def duration_filter(spark, sf):
    clips = table(spark, sf, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    return (
        clips.withColumn("duration_s", rnd(F.col("n_samples") / RATE, 4)).filter(F.col("n_samples") / RATE <= 3.3)
    )


QUALITY = (
    "SELECT user_id AS series_id, 20*log10(max(abs(value/500.0))) AS peak_db, 20*log10(sqrt(sum(value/500.0*(value/500.0))/count(*))) AS rms_db, "
    "avg(CASE WHEN value >= 60 THEN 30.0 ELSE -40.0 END)::DOUBLE AS tilt, min(value)/500.0 AS noise FROM events GROUP BY user_id"
)


def quality_metrics(spark, sf):
    level = F.col("value") / 500.0
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("series_id")).agg(
        (20.0 * F.log10(F.max(F.abs(level)))).alias("peak_db"),
        (20.0 * F.log10(F.sqrt(F.sum(level * level) / F.count(F.lit(1))))).alias("rms_db"),
        F.avg(F.when(F.col("value") >= 60, 30.0).otherwise(-40.0)).alias("tilt"),
        (F.min("value") / 500.0).alias("noise"),
    )


GAUSS = " + ".join(
    f"{w} * exp(-0.5 * pow(({m} - ({i})) / {s}, 2))"
    for m, i, s, w in [("tilt", 13.0, 5.0, 0.1), ("(peak_db - rms_db)", 17.0, 4.0, 0.25), ("noise * 10", 0.3, 0.08, 0.2), ("rms_db", -15.0, 3.0, 0.1)]
)


@query(
    "quality_gate",
    f"WITH q AS ({QUALITY}), f AS (SELECT *, concat_ws(',', CASE WHEN NOT peak_db < -0.5 THEN 'no-clip' END, CASE WHEN NOT rms_db > -40 THEN 'not-silent' END, "
    "CASE WHEN NOT tilt > -20 THEN 'tilt-sane' END, CASE WHEN NOT peak_db - rms_db > 3 THEN 'has-dynamics' END, CASE WHEN NOT noise < 0.02 THEN 'no-static-noise' END) AS failed FROM q) "
    f"SELECT series_id, failed, failed = '' AS passed, {r(f'CASE WHEN failed = $$$$ THEN {GAUSS} ELSE 0 END', 8)} AS score FROM f",
)
def quality_gate(spark, sf):
    q = quality_metrics(spark, sf)
    failed = verdicts.failed_checks(F.col("peak_db"), F.col("rms_db"), F.col("tilt"), F.col("noise"))
    # Ideal, spread and weight of the four scored metrics
    score = (
        0.10 * verdicts.gauss_score(F.col("tilt"), F.lit(13.0), F.lit(5.0))
        + 0.25 * verdicts.gauss_score(F.col("peak_db") - F.col("rms_db"), F.lit(17.0), F.lit(4.0))
        + 0.20 * verdicts.gauss_score(F.col("noise") * 10.0, F.lit(0.30), F.lit(0.08))
        + 0.10 * verdicts.gauss_score(F.col("rms_db"), F.lit(-15.0), F.lit(3.0))
    )
    return q.select(
        "series_id",
        F.array_join(failed, ",").alias("failed"),
        (F.size(failed) == 0).alias("passed"),
        rnd(F.when(F.size(failed) == 0, score).otherwise(0.0), 8).alias("score"),
    )


@query(
    "corpus_fingerprint",
    with_sql(
        {
            **FRAMES,
            "c": "SELECT series_id, 20*log10(sqrt(sum(value*value)/count(*))) AS rms_db, "
            "20*log10(max(value)) - 20*log10(sqrt(sum(value*value)/count(*))) AS crest, "
            f"coalesce(avg(value) FILTER (value >= {SILENT}), 0) AS pitch_hz, coalesce(stddev_pop(value) FILTER (value >= {SILENT}), 0) AS pitch_variation_hz, "
            f"avg(CASE WHEN value >= {SILENT} THEN 1.0::DOUBLE ELSE 0 END) AS voice_presence FROM frames GROUP BY series_id",
            "ce": "SELECT vec_id, list_sum([abs(x::DOUBLE) * (i - 1) * 100.0::DOUBLE for x, i in embedding]) / list_sum([abs(x::DOUBLE) for x in embedding]) AS centroid FROM embeddings",
        },
        f"SELECT count(*) AS clips, {r('avg(rms_db)', 6)} AS rms_db, {r('avg(crest)', 6)} AS crest, {r('avg(pitch_hz)', 6)} AS pitch_hz, "
        f"{r('avg(pitch_variation_hz)', 6)} AS pitch_variation_hz, {r('avg(voice_presence)', 6)} AS voice_presence, {r('avg(centroid)', 4)} AS centroid_hz FROM c LEFT JOIN ce ON vec_id = series_id",
    ),
)
def corpus_fingerprint(spark, sf):
    fr = frames(spark, sf)
    clips = signal.loudness(fr).join(
        signal.pitch_statistics(fr, F.col("value") >= SILENT, FRAME_S, order=["ts", "event_id"]), "series_id"
    )
    mags = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    spectra = table(spark, sf, "embeddings").select(F.col("vec_id").alias("series_id"), signal.spectral_centroid(mags, 100.0).alias("centroid_hz"))
    metrics = ["rms_db", "crest", "pitch_hz", "pitch_variation_hz", "voice_presence"]
    out = signal.corpus_fingerprint(clips.join(spectra, "series_id", "left"), [*metrics, "centroid_hz"])
    return _rounded(_rounded(out, 6, *metrics), 4, "centroid_hz")


@query(
    "middle_frame",
    with_sql(
        FRAMES,
        f"SELECT series_id, event_id, {r('value', 4)} AS value FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM frames) WHERE frame_idx = n // 2",
    ),
)
def middle_frame(spark, sf):
    """The middle entry of each ordered list, by position rather than by value."""
    fr = frames(spark, sf)
    sizes = fr.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        fr.join(sizes, "series_id")
        .filter(F.col("frame_idx") == F.floor(F.col("n") / 2))
        .select("series_id", "event_id", rnd(F.col("value"), 4).alias("value"))
    )
