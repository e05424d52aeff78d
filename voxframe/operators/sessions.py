"""Session operators: decaying state, latency, reassembly, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import tables
from voxframe.functions.textrules import INTENSITY_FLOOR
from voxframe.operators.ordered import ema, fill_forward, neighbours, prefix, with_position
from voxframe.operators.recursions import cool_down, distinct_regions, emotion_states, session_chunks, utterance_segments

__all__ = ["cool_down", "distinct_regions", "emotion_states", "session_chunks", "utterance_segments"]


def filler_plan(
    trips: DataFrame, keys: Sequence[str], idx: str = "chunk_index", block: str = "block", alpha: float = 0.3
) -> DataFrame:
    """Predicted round trip, filler gap and filler so far for every trip.

    The budget is the playback time of the chunk before; the prediction is
    trusted from the second trip on.
    """
    predicted = ema(trips, keys, idx, "rtt_ms", alpha)
    playback_ms = (F.col("audio_bytes") - 44) / 2 / 24000 * 1000.0
    budget = neighbours(predicted, keys, idx, 1, 0, {"_budget": lambda w: F.lag(playback_ms).over(w)})
    gap = F.when(F.col(idx) >= 1, F.greatest(F.col("ema") - F.col("_budget"), F.lit(0.0))).otherwise(0.0)
    decided = budget.withColumn("gap_ms", gap).drop("_budget")
    return prefix(
        decided.withColumn("total_filler_ms", F.col("gap_ms")), keys, [idx], block, {"total_filler_ms": F.col("gap_ms")}
    )


def buffer_snapshot(arrivals: DataFrame, sessions: DataFrame, keys: Sequence[str], block: str = "block") -> DataFrame:
    """Contiguous ready chunks from the cursor, what is pending, completeness.

    ``arrivals(keys, idx, secs, block)``; ``sessions(keys, cursor, total)`` where
    an unknown total is null and the window then ends at the last arrival.
    """
    ahead = arrivals.join(sessions, list(keys)).filter(F.col("idx") >= F.col("cursor"))
    placed = with_position(ahead, keys, ["idx"], block, "_pos")
    ready = (F.col("idx") - F.col("_pos")) == F.col("cursor")
    seen = placed.groupBy(*keys).agg(
        F.count_if(ready).alias("buffered"),
        F.coalesce(F.sum(F.when(ready, F.col("secs"))), F.lit(0.0)).alias("buffered_s"),
        F.max("idx").alias("_hi"),
    )
    joined = sessions.join(seen, list(keys), "left")
    end = F.coalesce("total", F.col("_hi") + 1, F.col("cursor"))
    buffered = F.coalesce("buffered", F.lit(0))
    remaining = F.greatest(end - F.col("cursor"), F.lit(0))
    return joined.select(
        *keys,
        buffered.alias("buffered"),
        F.coalesce("buffered_s", F.lit(0.0)).alias("buffered_s"),
        F.greatest(remaining - buffered, F.lit(0)).alias("pending"),
        F.coalesce(F.col("cursor") >= F.col("total"), F.lit(False)).alias("complete"),
    )


def replay(log: DataFrame, resumes: DataFrame, keys: Sequence[str], idx: str = "idx", capacity: int = 20) -> DataFrame:
    """The last ``capacity`` logged chunks that come after the last one seen."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(idx))
    kept = log.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= capacity).drop("_rn")
    return kept.join(resumes, list(keys)).filter(F.col(idx) > F.col("last_seen")).drop("last_seen")


def state_at(
    chunks: DataFrame, states: DataFrame, keys: Sequence[str], row_id: str, block_of_ts, ts_ms: str = "ts_ms"
) -> DataFrame:
    """Latest emotion state at or before every chunk, decayed to its time.

    ``states(keys, ts_ms, emotion, intensity, half_life_ms)``; ``block_of_ts`` adds
    the block column to the merged rows.
    """
    state = F.struct(F.col(ts_ms).alias("at"), "emotion", "intensity", "half_life_ms")
    known = states.select(*keys, ts_ms, F.lit(0).alias("_src"), F.lit(None).cast("bigint").alias(row_id), state.alias("_s"))
    asked = chunks.select(
        *keys, ts_ms, F.lit(1).alias("_src"), F.col(row_id).cast("bigint"), F.lit(None).cast(known.schema["_s"].dataType).alias("_s")
    )
    merged = block_of_ts(known.unionByName(asked))
    filled = fill_forward(merged, keys, [ts_ms, "_src", row_id], "block", {"_s": F.col("_s")}).filter("_src = 1")
    raw = F.col("_s.intensity") * F.pow(F.lit(2.0), -(F.col(ts_ms) - F.col("_s.at")) / F.col("_s.half_life_ms"))
    live = F.when((raw >= INTENSITY_FLOOR) & (F.col("_s.emotion") != "neutral"), raw).otherwise(0.0)
    return filled.select(
        *keys, row_id, F.coalesce("_s.emotion", F.lit("neutral")).alias("emotion"), F.coalesce(live, F.lit(0.0)).alias("intensity")
    )


def repeats(requests: DataFrame, order: Sequence[str], model: str = "model", text: str = "text") -> DataFrame:
    """Content key of every request and whether it was seen before.

    The first sighting per key is an aggregate, so a text holding a third of all
    requests is combined on the map side instead of being ranked in one task.
    """
    keyed = requests.withColumn("cache_key", F.sha2(F.concat_ws("|", model, text), 256))
    first = keyed.groupBy("cache_key").agg(F.min(F.struct(*order)).alias("_first"))
    return (
        keyed.join(first, "cache_key")
        .withColumn("cache_hit", F.struct(*order) > F.col("_first"))
        .drop("_first")
    )


def fenced_results(requests: DataFrame, resets: DataFrame, keys: Sequence[str], row_id: str, block_of_ts) -> DataFrame:
    """Results whose session was not reset between request and finish.

    ``requests(keys, row_id, ts_ms, done_ms)``, ``resets(keys, ts_ms)``.
    """
    mark = resets.select(*keys, "ts_ms", F.lit(0).alias("_src"), F.lit(None).cast("bigint").alias(row_id))
    start = requests.select(*keys, "ts_ms", F.lit(1).alias("_src"), row_id)
    done = requests.select(*keys, F.col("done_ms").alias("ts_ms"), F.lit(2).alias("_src"), row_id)
    merged = block_of_ts(mark.unionByName(start).unionByName(done))
    is_reset = F.when(F.col("_src") == 0, 1).otherwise(0).cast("bigint")
    counted = prefix(merged, keys, ["ts_ms", "_src", row_id], "block", {"generation": is_reset})
    ends = counted.filter("_src > 0").groupBy(*keys, row_id).agg(
        F.min("generation").alias("generation"), F.max("generation").alias("_after")
    )
    return ends.filter(F.col("generation") == F.col("_after")).drop("_after")


def receipts(calls: DataFrame, text: str = "text", audio_s: str = "audio_duration_sec", hit: str = "cache_hit") -> DataFrame:
    """Preview, size, GPU time and cost of every call."""
    gpu = F.when(F.col(hit), 0.0).otherwise(tables.GPU_BASE_S + F.col(audio_s) * tables.GPU_PER_AUDIO_S)
    return (
        calls.withColumn("text_preview", F.substring(text, 1, 60))
        .withColumn("text_chars", F.length(text))
        .withColumn("gpu_sec", gpu)
        .withColumn("cost_usd", F.col("gpu_sec") * tables.GPU_USD_PER_S)
    )


def ledger_totals(ledger: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    hits = F.count_if("cache_hit")
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        hits.alias("hits"),
        F.try_divide(hits * 100.0, F.count(F.lit(1))).alias("hit_pct"),
        F.coalesce(F.sum("audio_duration_sec"), F.lit(0.0)).alias("audio_sec"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Totals with a one-word status for an empty ledger."""
    return ledger_totals(ledger).withColumn("status", F.when(F.col("calls") == 0, "none").otherwise("ok"))


def latency_summary(trips: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    total = F.sum("rtt_ms")
    return trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trips"),
        *[F.coalesce(f("rtt_ms"), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean_rtt_ms"), (F.min, "min_rtt_ms"), (F.max, "max_rtt_ms"))],
        F.coalesce(F.try_divide(F.count(F.lit(1)), total / 60000.0), F.lit(0.0)).alias("chunks_per_min"),
    )


def cold_warm(calls: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First call against the integer mean of the rest; real-time factor overall.

    ``calls(keys, order, ms bigint, audio_bytes)``.
    """
    dur = F.col("audio_bytes") / (22050.0 * 2.0)
    out = calls.groupBy(*keys).agg(
        F.min_by("ms", F.struct(*order)).alias("cold_ms"),
        F.sum("ms").alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.try_divide(F.col("ms") / 1000.0, dur)).alias("mean_rtf"),
    )
    warm = F.when(F.col("_n") >= 2, F.floor((F.col("_sum") - F.col("cold_ms")) / (F.col("_n") - 1)))
    return out.select(*keys, "cold_ms", warm.alias("warm_avg_ms"), "mean_rtf")
