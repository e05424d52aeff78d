"""Loudness, timeline, pitch and spectral statistics over ordered frames.

Frames are rows ``(series_id, frame_idx, block, value)`` where ``block`` is any
monotone block number (see ``ordered``).  Order-free statistics are plain
two-step aggregates; ordered ones use the block operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.scalar import db
from voxframe.operators.ordered import (
    ROWS_PER_BLOCK,
    neighbours,
    order_statistics,
    prefix,
    runs,
    with_position,
)
from voxframe.operators.recursions import kept

KEYS = ("series_id",)

# Thresholds of the analysis rules, amplitude in [0, 1], seconds.
SILENCE_AMPLITUDE = 0.01
PAUSE_MIN_TEMPORAL_S = 0.1
PAUSE_MIN_TIMELINE_S = 0.05


def index_block(idx: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    return F.floor(F.col(idx) / rows_per_block)


def loudness(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    level = df.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col(value) * F.col(value)) / F.count(value)).alias("_rms"),
        F.max(F.abs(value)).alias("_peak"),
    )
    dbs = level.select(*keys, db(F.col("_rms")).alias("rms_db"), db(F.col("_peak")).alias("peak_db"))
    silent = F.col("rms_db").isin(float("-inf")) | F.col("peak_db").isin(float("-inf"))
    return dbs.withColumn("crest", F.when(silent, 0.0).otherwise(F.col("peak_db") - F.col("rms_db")))


def energy_envelope(
    df: DataFrame, frame: int, keys: Sequence[str] = KEYS, idx: str = "frame_idx", value: str = "value"
) -> DataFrame:
    """RMS of non-overlapping chunks; the last partial chunk is kept."""
    return df.groupBy(*keys, F.floor(F.col(idx) / frame).alias("chunk")).agg(
        F.sqrt(F.sum(F.col(value) * F.col(value)) / F.count(value)).alias("rms"),
        F.count(value).alias("n"),
    )


def energy_dump(df: DataFrame, frame: int, keys: Sequence[str] = KEYS, idx: str = "frame_idx") -> DataFrame:
    """Chunk level in dB; a partial tail is dropped."""
    return (
        energy_envelope(df, frame, keys, idx)
        .filter(F.col("n") == frame)
        .withColumn("level_db", 20.0 * F.log10(F.col("rms") + 1e-10))
    )


def vad_segments(
    frames: DataFrame,
    threshold: float,
    frame_s: float,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
    block: str = "block",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Maximal voiced / silent runs with their level.

    ``totals(keys, total_s)`` caps the end of the last run where the clip is
    shorter than its frame grid.
    """
    seg = runs(
        frames,
        keys,
        idx,
        block,
        F.col(value) >= threshold,
        {"_sumsq": (F.col(value) * F.col(value), "sum"), "_block": (F.col(block), "min")},
    )
    start = F.col("start_idx") * frame_s
    end = (F.col("start_idx") + F.col("n_frames")) * frame_s
    if totals is not None:
        seg = seg.join(totals, list(keys))
        end = F.least(end, F.col("total_s"))
    return seg.select(
        *keys,
        F.when(F.col("flag"), "voiced").otherwise("silence").alias("kind"),
        "start_idx",
        "n_frames",
        start.alias("start_s"),
        end.alias("end_s"),
        (end - start).alias("duration_s"),
        db(F.sqrt(F.col("_sumsq") / F.col("n_frames"))).alias("rms_db"),
        F.col("_block").alias(block),
    )


def merge_short_silences(segments: DataFrame, max_gap_s: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Absorb short silences into the voiced run before them (VAD hangover)."""
    numbered = with_position(segments, keys, ["start_idx"], "block", "seg_no")
    voiced = F.col("kind") == "voiced"
    absorbed = (~voiced) & (F.col("duration_s") < max_gap_s) & (F.col("seg_no") > 0)
    merged = runs(
        numbered,
        keys,
        "seg_no",
        "block",
        voiced | absorbed,
        {
            "start_s": (F.col("start_s"), "min"),
            "end_s": (F.col("end_s"), "max"),
            "_voiced_db": (F.when(voiced, F.col("rms_db")), "max"),
            "_any_db": (F.col("rms_db"), "max"),
        },
    )
    return merged.select(
        *keys,
        F.when(F.col("flag"), "voiced").otherwise("silence").alias("kind"),
        "start_s",
        "end_s",
        (F.col("end_s") - F.col("start_s")).alias("duration_s"),
        F.when(F.col("flag"), F.col("_voiced_db")).otherwise(F.col("_any_db")).alias("rms_db"),
    )


def timeline_summary(segments: DataFrame, keys: Sequence[str] = KEYS, pause_s: float = PAUSE_MIN_TIMELINE_S) -> DataFrame:
    silent = F.col("kind") == "silence"
    total = F.max("end_s")
    return segments.groupBy(*keys).agg(
        F.count_if(silent & (F.col("duration_s") >= pause_s)).alias("pause_count"),
        F.coalesce(F.try_divide(F.sum(F.when(silent, F.col("duration_s")).otherwise(0.0)), total), F.lit(0.0)).alias(
            "silence_ratio"
        ),
        total.alias("total_s"),
    )


def pauses(
    frames: DataFrame,
    threshold: float,
    hop_s: float,
    min_s: float = PAUSE_MIN_TEMPORAL_S,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
    block: str = "block",
) -> DataFrame:
    """Silent runs long enough to be a pause, leading and trailing ones too."""
    return (
        runs(frames, keys, idx, block, F.col(value) < threshold)
        .filter(F.col("flag"))
        .withColumn("pause_s", F.col("n_frames") * hop_s)
        .filter(F.col("pause_s") >= min_s)
        .drop("flag")
    )


def temporal_metrics(
    frames: DataFrame,
    threshold: float,
    hop_s: float,
    min_s: float = PAUSE_MIN_TEMPORAL_S,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
    block: str = "block",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Speech rate and pause statistics; duration defaults to frames x hop."""
    counted = runs(frames, keys, idx, block, F.col(value) < threshold)
    pause = F.when(F.col("flag") & (F.col("n_frames") * hop_s >= min_s), F.col("n_frames") * hop_s)
    out = counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("flag"), 0).otherwise(F.col("n_frames"))).alias("_voiced"),
        F.sum(F.when(F.col("flag"), F.col("n_frames")).otherwise(0)).alias("_silent"),
        F.count(pause).alias("pause_count"),
        F.coalesce(F.avg(pause), F.lit(0.0)).alias("mean_pause_duration"),
    )
    all_frames = F.col("_voiced") + F.col("_silent")
    if totals is not None:
        out = out.join(totals, list(keys)).withColumnRenamed("total_s", "duration_secs")
    else:
        out = out.withColumn("duration_secs", all_frames * hop_s)
    return out.select(
        *keys,
        "duration_secs",
        F.coalesce(F.try_divide(F.col("_voiced"), F.col("duration_secs")), F.lit(0.0)).alias("speech_rate"),
        "pause_count",
        "mean_pause_duration",
        (F.col("_silent") / all_frames).alias("pause_ratio"),
    )


def zero_crossing_rate(
    df: DataFrame, sample_rate: float, keys: Sequence[str] = KEYS, idx: str = "frame_idx", value: str = "value"
) -> DataFrame:
    """Sign changes per second."""
    flagged = df.withColumn("_pos", F.col(value) >= 0)
    paired = neighbours(flagged, keys, idx, 1, 0, {"_was": lambda w: F.lag("_pos").over(w)})
    return paired.groupBy(*keys).agg(
        (F.count_if(F.col("_was") != F.col("_pos")) / (F.count(F.lit(1)) / sample_rate)).alias("zcr")
    )


def spectral_flatness(mags: Column) -> Column:
    """Geometric over arithmetic mean of a magnitude array, 0 for an empty one."""
    n = F.size(mags).cast("double")
    logs = F.aggregate(mags, F.lit(0.0), lambda s, m: s + F.ln(m.cast("double") + 1e-10))
    mean = F.aggregate(mags, F.lit(0.0), lambda s, m: s + m.cast("double")) / n
    return F.when(mean > 0, F.exp(logs / n) / mean).otherwise(0.0)


def band_balance(mags: Column, bin_hz: float, split_hz: float = 1000.0) -> Column:
    """Power below over power above the split, in dB; 0 without high power."""
    cut = F.least(F.lit(int(split_hz / bin_hz)), F.size(mags) - 1)
    power = lambda part: F.aggregate(part, F.lit(0.0), lambda s, m: s + F.pow(m.cast("double"), F.lit(2.0)))
    low = power(F.slice(mags, 1, cut))
    high = power(F.slice(mags, cut + 1, F.size(mags)))
    return F.when(high > 1e-20, 10.0 * F.log10(low / high)).otherwise(0.0)


def array_tilt(mags: Column, bin_hz: float) -> Column:
    """``spectral_tilt`` of a whole magnitude array in one pass over it, without a shuffle."""
    lo, hi = max(int(100.0 / bin_hz), 1), int(8000.0 / bin_hz)
    points = F.transform(mags, lambda m, i: F.struct((m * m).alias("p"), F.log2(i * bin_hz).alias("x"), i.alias("i")))
    used = F.filter(points, lambda q: (q["i"] >= lo) & (q["i"] < hi) & (q["p"] > 1e-20))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")])

    def add(s: Column, q: Column) -> Column:
        y = 10.0 * F.log10(q["p"])
        return F.struct(
            (s["n"] + 1).alias("n"), (s["x"] + q["x"]).alias("x"), (s["y"] + y).alias("y"), (s["xx"] + q["x"] * q["x"]).alias("xx"), (s["xy"] + q["x"] * y).alias("xy")
        )

    def slope(s: Column) -> Column:
        spread = s["n"] * s["xx"] - s["x"] * s["x"]
        return F.when((s["n"] > 1) & (spread > 1e-12), (s["n"] * s["xy"] - s["x"] * s["y"]) / spread).otherwise(0.0)

    return F.aggregate(used, start, add, slope)


def spectral_tilt(
    bins: DataFrame, keys: Sequence[str], bin_hz: float, bin_col: str = "bin", mag_col: str = "mag"
) -> DataFrame:
    """Slope of dB power over log2 frequency between 100 Hz and 8 kHz."""
    lo, hi = max(int(100.0 / bin_hz), 1), int(8000.0 / bin_hz)
    power = F.col(mag_col) * F.col(mag_col)
    used = bins.filter((F.col(bin_col) >= lo) & (F.col(bin_col) < hi) & (power > 1e-20))
    return used.groupBy(*keys).agg(
        F.coalesce(
            F.regr_slope(10.0 * F.log10(power), F.log2(F.col(bin_col) * bin_hz)), F.lit(0.0)
        ).alias("tilt_db_oct")
    )


def vocal_weight(
    bins: DataFrame,
    keys: Sequence[str],
    bin_hz: float,
    bin_col: str = "bin",
    power: str = "power",
    lo_hz: float = 1000.0,
    hi_hz: float = 5000.0,
) -> DataFrame:
    """Weighted median frequency of the average spectrum in the 1-5 kHz band.

    Spectra are summed per (key, bin) first, so the running sum sees one row per
    frequency bin.
    """
    lo, hi = int(lo_hz / bin_hz), int(hi_hz / bin_hz)
    inside = (F.col(bin_col) >= lo) & (F.col(bin_col) < hi)
    ltas = bins.groupBy(*keys, bin_col).agg(F.sum(F.when(inside, F.col(power)).otherwise(0.0)).alias("_p"))
    run = Window.partitionBy(*keys).orderBy(bin_col)
    cum = ltas.select(
        *keys,
        bin_col,
        "_p",
        F.sum("_p").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
        F.sum("_p").over(Window.partitionBy(*keys)).alias("_total"),
    )
    reached = (F.col(bin_col) >= lo) & (F.col(bin_col) < hi) & (F.col("_total") > 0) & (F.col("_cum") >= F.col("_total") * 0.5)
    return cum.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(reached, F.col(bin_col))) * bin_hz, F.lit((lo + hi) * bin_hz * 0.5)).alias("vocal_weight_hz")
    )


def pitch_statistics(
    frames: DataFrame,
    voiced: Column,
    hop_s: float,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("frame_idx",),
    value: str = "value",
    block: str = "block",
) -> DataFrame:
    """Mean, spread, presence and slope of a pitch contour.

    The slope runs over the ordinal of voiced frames, not over real time.
    """
    ranked = prefix(frames.withColumn("_v", voiced), keys, list(order), block, {"_ord": F.when(voiced, 1).otherwise(0).cast("bigint")})
    f0 = F.when(F.col("_v"), F.col(value))
    at = F.when(F.col("_v"), F.col("_ord") * hop_s)
    stats = ranked.groupBy(*keys).agg(
        F.coalesce(F.avg(f0), F.lit(0.0)).alias("pitch_hz"),
        F.coalesce(F.stddev_pop(f0), F.lit(0.0)).alias("pitch_variation_hz"),
        F.avg(F.col("_v").cast("double")).alias("voice_presence"),
        F.coalesce(F.regr_slope(f0, at), F.lit(0.0)).alias("_slope"),
    )
    semi = F.when(F.col("pitch_hz") > 0, F.col("_slope") / (F.col("pitch_hz") * F.ln(F.lit(2.0)) / 12.0)).otherwise(0.0)
    return stats.withColumn("pitch_slope_semi", semi).drop("_slope")


def glottal_cycles(
    samples: DataFrame,
    min_period: int,
    max_period: int,
    min_amplitude: float,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
    block: str = "block",
) -> DataFrame:
    """Accepted cycles between upward zero crossings: period in samples, RMS."""
    flagged = neighbours(samples, keys, idx, 1, 0, {"_prev": lambda w: F.lag(value).over(w)})
    crossing = F.when((F.col("_prev") <= 0) & (F.col(value) > 0), 1).otherwise(0).cast("bigint")
    numbered = prefix(flagged, keys, [idx], block, {"_cycle": crossing})
    cycles = numbered.filter(F.col("_cycle") > 0).groupBy(*keys, "_cycle").agg(
        F.count(F.lit(1)).alias("period"),
        F.sqrt(F.sum(F.col(value) * F.col(value)) / F.count(F.lit(1))).alias("amplitude"),
    )
    open_end = cycles.groupBy(*keys).agg(F.max("_cycle").alias("_last"))
    return (
        cycles.join(open_end, list(keys))
        .filter((F.col("_cycle") < F.col("_last")) & F.col("period").between(min_period, max_period))
        .filter(F.col("amplitude") > min_amplitude)
        .drop("_last")
    )


def jitter_shimmer(cycles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean successive difference over mean, as fractions; 0 under two cycles."""
    blocked = cycles.withColumn("_cblock", index_block("_cycle"))
    ordered = with_position(blocked, keys, ["_cycle"], "_cblock", "_pos")
    paired = neighbours(
        ordered,
        keys,
        "_pos",
        1,
        0,
        {
            "_dp": lambda w: F.abs(F.col("period") - F.lag("period").over(w)),
            "_da": lambda w: F.abs(F.col("amplitude") - F.lag("amplitude").over(w)),
        },
    )
    return paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cycles"),
        F.coalesce(F.try_divide(F.avg("_dp"), F.avg("period")), F.lit(0.0)).alias("jitter"),
        F.coalesce(F.try_divide(F.avg("_da"), F.avg("amplitude")), F.lit(0.0)).alias("shimmer"),
    )


def noise_ratio(frames: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """10th over 90th percentile frame level by index; 0 under ten frames."""
    picked = order_statistics(
        frames, keys, value, {"_lo": lambda n: F.floor(n * 0.10), "_hi": lambda n: F.floor(n * 0.90)}
    )
    ratio = F.when((F.col("n_rows") >= 10) & (F.col("_hi") > 0), F.col("_lo") / F.col("_hi")).otherwise(0.0)
    return picked.select(*keys, "n_rows", ratio.alias("noise_ratio"))


def min_max_normalise(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Scale columns to 0..1 within each sweep; a constant column becomes 0.5."""
    bounds = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    if keys:
        joined, bound = df.join(bounds, list(keys)), F.col
    else:
        one = bounds.select(F.struct("*")).scalar()
        joined, bound = df, one.getField
    scaled = []
    for c in columns:
        span = bound(f"_hi_{c}") - bound(f"_lo_{c}")
        scaled.append(F.when(span > 1e-6, (F.col(c) - bound(f"_lo_{c}")) / span).otherwise(0.5).alias(c))
    return joined.select(*[c for c in df.columns if c not in columns], *scaled)


def level_profile(
    df: DataFrame, chunk: int = 5, keys: Sequence[str] = KEYS, idx: str = "frame_idx", value: str = "value"
) -> DataFrame:
    """Mean per chunk, quantised to eight levels against the loudest chunk."""
    chunks = df.groupBy(*keys, F.floor(F.col(idx) / chunk).alias("chunk")).agg(F.avg(value).alias("mean_value"))
    peak = chunks.groupBy(*keys).agg(F.greatest(F.max("mean_value"), F.lit(0.001)).alias("_peak"))
    level = F.least(F.floor(F.greatest(F.col("mean_value"), F.lit(0.0)) / F.col("_peak") * 7.0 + 0.5), F.lit(7))
    return chunks.join(peak, list(keys)).withColumn("level", level).drop("_peak")


def trim_tail(
    frames: DataFrame,
    threshold: float,
    window: int = 5,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
) -> DataFrame:
    """Drop what follows the last frame whose centred mean level is speech."""
    half = window // 2
    averaged = neighbours(
        frames, keys, idx, half, half, {"_avg": lambda w: F.avg(value).over(w.rowsBetween(-half, half))}
    )
    last = averaged.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_avg") >= threshold, F.col(idx))), F.lit(0)).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    kept = (F.col("_n") < window) | (F.col(idx) < F.col("_last") + 2)
    return frames.join(last, list(keys)).filter(kept).drop("_last", "_n")


def gate_mask(
    frames: DataFrame,
    threshold: float,
    attack: int = 2,
    release: int = 3,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
) -> DataFrame:
    """Noise gate that opens ``attack`` frames early and holds ``release`` frames."""
    active = frames.withColumn("_on", (F.col(value) >= threshold).cast("int"))
    return neighbours(
        active,
        keys,
        idx,
        release,
        attack,
        {"kept": lambda w: F.max("_on").over(w.rowsBetween(-release, attack)) == 1},
    ).drop("_on")


def speech_intervals(silences: DataFrame, durations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Complement of the silences ``(start_s, end_s, start_idx, block)`` in the clip.

    Empty intervals are omitted.
    """
    silences = kept(silences.select(*keys, "start_s", "end_s", "block"), "silences")
    numbered = with_position(silences, keys, ["start_s"], "block", "_no")
    opened = neighbours(
        numbered, keys, "_no", 1, 0, {"_from": lambda w: F.coalesce(F.lag("end_s").over(w), F.lit(0.0))}
    )
    inner = opened.select(*keys, F.col("_from").alias("from_s"), F.col("start_s").alias("to_s"))
    ends = silences.groupBy(*keys).agg(F.max("end_s").alias("_end"))
    tail = durations.join(ends, list(keys), "left").select(
        *keys, F.coalesce("_end", F.lit(0.0)).alias("from_s"), F.col("total_s").alias("to_s")
    )
    return inner.unionByName(tail).filter(F.col("from_s") < F.col("to_s"))


def split_clips(
    intervals: DataFrame, min_s: float = 0.5, max_s: float = 15.0, keys: Sequence[str] = KEYS, block: str = "block"
) -> DataFrame:
    """Keep intervals inside the duration band and number them from one."""
    length = F.col("to_s") - F.col("from_s")
    kept = intervals.filter((length >= min_s) & (length <= max_s))
    return with_position(kept, keys, ["from_s"], block, "clip_no").withColumn("clip_no", F.col("clip_no") + 1)


def edge_trim(
    frames: DataFrame, threshold: float, keys: Sequence[str] = KEYS, idx: str = "frame_idx", value: str = "value"
) -> DataFrame:
    """Cut before the first and after the last loud frame, keeping inner pauses."""
    loud = frames.filter(F.col(value) >= threshold)
    edges = loud.groupBy(*keys).agg(F.min(idx).alias("_from"), F.max(idx).alias("_to"))
    return frames.join(edges, list(keys)).filter(F.col(idx).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def worst_frames(
    df: DataFrame, n: int = 10, keys: Sequence[str] = KEYS, idx: str = "frame_idx", value: str = "value"
) -> DataFrame:
    """The frames with the largest distance, ties by position."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), idx)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def clean_report(
    samples: DataFrame,
    sample_rate: float,
    keys: Sequence[str] = KEYS,
    idx: str = "frame_idx",
    value: str = "value",
    trim_db: float = -40.0,
    level_db: float = -14.0,
    min_s: float = 0.5,
) -> DataFrame:
    """Durations before/after trimming, samples that clip after levelling, kept?

    An all-silent clip is reported with an after-duration of 0 and not kept. The samples are
    staged once and read three times.
    """
    samples = kept(samples.select(*keys, idx, value), "samples")
    loud = F.abs(F.col(value)) > 10.0 ** (trim_db / 20.0)
    edges = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(loud, F.col(idx))).alias("_from"),
        F.max(F.when(loud, F.col(idx))).alias("_to"),
    )
    inner = samples.join(edges, list(keys)).filter(F.col(idx).between(F.col("_from"), F.col("_to")))
    level = inner.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_rms"))
    gain = F.when(F.col("_rms") > 1e-8, 10.0 ** (level_db / 20.0) / F.col("_rms")).otherwise(1.0)
    clipped = (
        inner.join(level, list(keys))
        .groupBy(*keys)
        .agg(F.count_if(F.abs(F.col(value) * gain) > 0.99).alias("clipped"))
    )
    after = F.coalesce((F.col("_to") - F.col("_from") + 1) / sample_rate, F.lit(0.0))
    return edges.join(clipped, list(keys), "left").select(
        *keys,
        (F.col("_n") / sample_rate).alias("before_s"),
        after.alias("after_s"),
        F.coalesce("clipped", F.lit(0)).alias("clipped"),
        (after >= min_s).alias("kept"),
    )


def clean_totals(report: DataFrame) -> DataFrame:
    """``before`` covers every clip, ``after`` only the kept ones."""
    return report.agg(
        F.count_if("kept").alias("files"),
        F.count_if(F.col("after_s") == 0).alias("silent_files"),
        F.sum("before_s").alias("before_s"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("after_s"))), F.lit(0.0)).alias("after_s"),
    )


def spectral_centroid(mags: Column, bin_hz: float) -> Column:
    """Mean frequency of a spectrum, weighted by magnitude; null for a vanishing one."""
    total = F.aggregate(mags, F.lit(0.0), lambda s, m: s + m)
    weighted = F.aggregate(F.transform(mags, lambda m, i: m * i * bin_hz), F.lit(0.0), lambda s, m: s + m)
    return F.when(total > 1e-10, weighted / total)


def corpus_fingerprint(clips: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Unweighted mean of each clip metric, with the clip count."""
    return clips.agg(F.count(F.lit(1)).alias("clips"), *[F.avg(m).alias(m) for m in metrics])
