"""Comparison of synthesis with reference recordings, and parameter studies.

Metrics are long rows ``(series_id, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import tables, verdicts
from voxframe.functions.scalar import clamp, let, rnd
from voxframe.operators.recursions import kept
from voxframe.session import small_or_plain


def literal_rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table in the session of ``df``."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def metric_definitions(df: DataFrame, extra: Sequence[tuple] = ()) -> DataFrame:
    """The metric registry; a new metric is a new row."""
    return literal_rows(df, [*tables.METRIC_DEFS, *extra], "metric string, unit string, scale double")


def gap_table(metrics: DataFrame, targets: DataFrame, definitions: DataFrame) -> DataFrame:
    """Distance of each metric from its target as a share of the metric's scale.

    Definitions and targets hold one row per metric.
    """
    dim = small_or_plain(
        definitions.join(targets, "metric", "left").select(
            "metric", "scale", F.coalesce("target", F.lit(0.0)).alias("target")
        )
    )
    raw = F.least(F.lit(100.0), F.abs(F.col("value") - F.col("target")) / F.col("scale") * 100.0)
    return (
        metrics.join(dim, "metric")
        .withColumn("_raw", raw)
        .select(
            "series_id",
            "metric",
            "target",
            F.col("value").alias("actual"),
            rnd(F.col("_raw"), 1).alias("gap_pct"),
            verdicts.gap_verdict(F.col("_raw")).alias("verdict"),
        )
    )


def gap_summary(gaps: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean of the rounded gaps, rounded again.

    Rounded gaps are whole tenths, so they are summed as integers: a sum of doubles
    depends on task order and can tip a half-way mean either way.
    """
    tenths = F.sum(F.round(F.col("gap_pct") * 10.0).cast("bigint")).cast("double")
    return gaps.groupBy(*keys).agg(rnd(tenths / 10.0 / F.count(F.lit(1)), 1).alias("mean_gap_pct"))


def phrase_summary(summary: DataFrame) -> DataFrame:
    """Mean of the per-phrase means; 0 without phrases."""
    return summary.agg(
        F.count(F.lit(1)).alias("phrases"), F.coalesce(F.avg("mean_gap_pct"), F.lit(0.0)).alias("mean_of_means")
    )


def worst_dimensions(gaps: DataFrame) -> DataFrame:
    means = gaps.groupBy("metric").agg(F.avg("gap_pct").alias("mean_gap_pct"))
    # one row per metric is left here, so the ranking is small whatever the input
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_gap_pct"), "metric")))


def paired_metrics(studio: DataFrame, synth: DataFrame, stem: str = "stem") -> DataFrame:
    """Studio and synthesis rows of one stem and metric; both sides must exist."""
    left = studio.select(stem, "metric", F.col("value").alias("reference"))
    right = synth.select(stem, "metric", F.col("value").alias("synthetic"))
    return left.join(right, [stem, "metric"])


def pair_comparison(pairs: DataFrame) -> DataFrame:
    """Corpus means per metric with their relative gap."""
    means = pairs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("reference").alias("reference"),
        F.avg("synthetic").alias("synthetic"),
    )
    gap = verdicts.relative_gap(F.col("reference"), F.col("synthetic"))
    return means.withColumn("gap_pct", gap).withColumn("verdict", verdicts.relative_verdict(F.col("gap_pct")))


def naturalness(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Mean of the scores that exist and its label."""
    return pairs.agg(F.count(score).alias("scored"), F.avg(score).alias("naturalness")).withColumn(
        "verdict", verdicts.naturalness_verdict(F.col("naturalness"))
    )


def align_by_position(words: DataFrame, pauses: DataFrame, runs: DataFrame, pause_runs: DataFrame) -> DataFrame:
    """The i-th reference word against the i-th voiced run, pauses likewise.

    All inputs carry ``(series_id, ordinal, label|start_s, end_s)``.  Words with
    no run are dropped; pauses with no run stay as MISSING with ratio 0.
    """

    def matched(ref: DataFrame, syn: DataFrame, how: str) -> DataFrame:
        other = syn.select(
            "series_id",
            "ordinal",
            F.col("start_s").alias("syn_start_s"),
            F.col("end_s").alias("syn_end_s"),
            F.col("rms_db"),
        )
        mine = ref.select("series_id", "ordinal", "label", "start_s", "end_s")
        return mine.join(other, ["series_id", "ordinal"], how)

    def shaped(df: DataFrame, is_pause: bool) -> DataFrame:
        missing = F.col("syn_start_s").isNull()
        ref_s = F.col("end_s") - F.col("start_s")
        syn_s = F.col("syn_end_s") - F.col("syn_start_s")
        ratio = F.when(missing, 0.0).when(ref_s > 0, syn_s / ref_s).otherwise(1.0)
        label = F.col("label")
        if is_pause:
            label = F.concat(
                F.lit("[pause after '"), F.col("label"), F.lit("']"), F.when(missing, " MISSING").otherwise("")
            )
        return df.select(
            "series_id",
            "ordinal",
            F.lit(is_pause).alias("is_pause"),
            label.alias("label"),
            ref_s.alias("ref_duration_s"),
            F.coalesce(syn_s, F.lit(0.0)).alias("syn_duration_s"),
            rnd(ratio, 3).alias("duration_ratio"),
            F.coalesce("rms_db", F.lit(0.0)).alias("rms_delta_db"),
        )

    pairs = shaped(matched(words, runs, "inner"), False).unionByName(shaped(matched(pauses, pause_runs, "left"), True))
    return pairs.withColumn("status", verdicts.alignment_status(F.col("duration_ratio"), F.col("is_pause")))


def alignment_summary(pairs: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.coalesce(F.avg("duration_ratio"), F.lit(1.0)).alias("mean_duration_ratio"),
        F.coalesce(F.min(F.when(F.col("is_pause"), F.col("duration_ratio"))), F.lit(0.0)).alias("worst_pause_ratio"),
        F.coalesce(F.avg(F.when(~F.col("is_pause"), F.col("rms_delta_db"))), F.lit(0.0)).alias("mean_rms_delta_db"),
    )


def frame_pairs(ref: DataFrame, syn: DataFrame, keys: Sequence[str], idx: str = "frame_idx") -> DataFrame:
    """Frame-by-frame pairing; the longer side is cut by the inner join."""
    left = ref.select(*keys, idx, F.col("vector").alias("ref_vector"))
    right = syn.select(*keys, idx, F.col("vector").alias("syn_vector"))
    return left.join(right, [*keys, idx])


def _sum_over(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum_over(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))


def mel_cepstral_distance(pairs: DataFrame, keys: Sequence[str], coefficients: int = 24) -> DataFrame:
    """Mean per-frame root mean square difference, without the dB constant."""
    frame = F.sqrt(squared_distance(F.col("ref_vector"), F.col("syn_vector")) / coefficients)
    return pairs.groupBy(*keys).agg(F.avg(frame).alias("mcd"))


def with_unpaired(distances: DataFrame, pair_ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs without a common frame have an infinite distance."""
    return pair_ids.join(distances, list(keys), "left").withColumn("mcd", F.coalesce("mcd", F.lit(float("inf"))))


def log_spectral_distance(pairs: DataFrame) -> DataFrame:
    """Per-frame RMS over the bands; average it per pair for the overall value."""
    bands = F.least(F.size("ref_vector"), F.size("syn_vector"))
    return pairs.withColumn("lsd", F.sqrt(squared_distance(F.col("ref_vector"), F.col("syn_vector")) / bands))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [-1, 1]; 0 for a vanishing vector."""
    dot = _sum_over(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    norms = F.sqrt(_sum_over(a, a, lambda x, y: x.cast("double") * y.cast("double"))) * F.sqrt(
        _sum_over(b, b, lambda x, y: x.cast("double") * y.cast("double"))
    )
    return F.when(norms < 1e-10, 0.0).otherwise(clamp(dot / norms, -1.0, 1.0))


def vector_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors."""
    return _sum_over(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))) / F.size(a)


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, unit: bool = False) -> DataFrame:
    """Per-dimension mean; with ``unit`` of unit vectors, normalised again.

    Averages per (key, dimension) combine on the map side, so a key holding most
    rows still sends one partial row per task and dimension.
    """
    source = F.col(vector)
    if unit:
        norm = F.sqrt(_sum_over(source, source, lambda x, y: x.cast("double") * y.cast("double")))
        vectors = source
        source = let(norm, lambda n: F.transform(vectors, lambda x: F.when(n > 1e-8, x.cast("double") / n).otherwise(x.cast("double"))))
    cells = df.select(*keys, F.posexplode(source).alias("dim", "x"))
    means = cells.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_v"))
    out = gathered.select(*keys, F.col("_v.m").alias("centroid"))
    if unit:
        norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
        out = out.withColumn(
            "centroid", let(norm, lambda n: F.when(n > 1e-8, F.transform("centroid", lambda x: x / n)).otherwise(F.col("centroid")))
        )
    return out


def tempo_matches(path: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """First match of every reference segment along an alignment path.

    ``path(keys, path_pos, ref_idx, kind, ref_duration_s, syn_duration_s)``.
    """
    first = path.groupBy(*keys, "ref_idx").agg(
        F.min_by(F.struct("kind", "ref_duration_s", "syn_duration_s"), "path_pos").alias("m")
    )
    ratio = F.when(F.col("m.ref_duration_s") > 0.01, F.col("m.syn_duration_s") / F.col("m.ref_duration_s")).otherwise(1.0)
    return first.select(*keys, "ref_idx", "m.*", ratio.alias("ratio"))


def tempo_outliers(matches: DataFrame) -> DataFrame:
    """Voiced segments whose match is rushed (ratio under 0.7) or drawn out (over 1.4)."""
    label = F.when(F.col("ratio") < 0.7, "rushed").when(F.col("ratio") > 1.4, "drawn out")
    return matches.where(F.col("kind") == "voiced").withColumn("tempo", label).where(F.col("tempo").isNotNull())


def tempo_summary(matches: DataFrame, totals: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Overall ratio of the two timelines and how many voiced segments are rushed or drawn out.

    ``totals(keys, ref_total_s, syn_total_s)`` are the durations of the whole timelines; the
    ratio is 1 where the reference has none.
    """
    voiced = F.col("kind") == "voiced"
    counts = matches.groupBy(*keys).agg(
        F.count_if(voiced & (F.col("ratio") < 0.7)).alias("rushed"),
        F.count_if(voiced & (F.col("ratio") > 1.4)).alias("drawn_out"),
    )
    ratio = F.when(F.col("ref_total_s") > 0, F.col("syn_total_s") / F.col("ref_total_s")).otherwise(1.0)
    return counts.join(totals, list(keys)).select(*keys, ratio.alias("overall_ratio"), "rushed", "drawn_out")


def weighted_objective(gaps: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Weighted gap of the objective metrics; a missing metric scores 50."""
    score = F.lit(0.0)
    for metric, weight in tables.OBJECTIVE_WEIGHTS:
        found = F.max(F.when(F.col("metric") == metric, F.col("gap_pct")))
        score = score + weight * F.coalesce(found, F.lit(tables.OBJECTIVE_MISSING))
    return gaps.groupBy(*keys).agg(score.alias("objective"))


def composite_score(metrics: DataFrame, criteria: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Sum of weighted bell curves; ``criteria(metric, ideal, sigma, weight)``."""
    part = F.col("weight") * verdicts.gauss_score(F.col("value"), F.col("ideal"), F.col("sigma"))
    return metrics.join(small_or_plain(criteria), "metric").groupBy(*keys).agg(F.sum(part).alias("score"))


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current mean gap per model against the stored one; improvement passes."""
    joined = current.select("model", F.col("mean_gap_pct").alias("current_gap")).join(
        baseline.select("model", F.col("mean_gap_pct").alias("baseline_gap")), "model", "left"
    )
    delta = F.col("baseline_gap") - F.col("current_gap")
    verdict = F.when(F.col("baseline_gap").isNull(), "MISSING BASELINE").when(delta > 0, "PASS").otherwise("FAIL")
    return joined.withColumn("delta", delta).withColumn("verdict", verdict)


def sensitivity_matrix(trials: DataFrame, baseline: DataFrame, steps: dict[str, float], metrics: Sequence[str]) -> DataFrame:
    """(value - baseline) / |step| per knob, metrics as columns."""
    step = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    dim = small_or_plain(baseline.select("metric", F.col("value").alias("_base")))
    change = (F.col("value") - F.col("_base")) / F.abs(F.try_element_at(step, F.col("knob")))
    return (
        trials.join(dim, "metric")
        .withColumn("_s", change)
        .groupBy("knob")
        .pivot("metric", list(metrics))
        .agg(F.first("_s"))
    )


def sweep_table(trials: DataFrame, metrics: Sequence[str], setting: str = "setting") -> DataFrame:
    """One row per knob value (the neutral run included), metric gaps as columns."""
    return trials.groupBy(setting).pivot("metric", list(metrics)).agg(F.first("gap_pct"))


def best_setting(sweep: DataFrame, neutral: str, setting: str = "setting", gap: str = "mean_gap_pct") -> DataFrame:
    """The best value of a sweep, only if strictly better than neutral."""
    is_neutral = F.col(setting) == neutral
    best = sweep.agg(
        F.min_by(F.when(~is_neutral, F.col(setting)), F.when(~is_neutral, F.struct(gap, setting))).alias("best_setting"),
        F.min(F.when(~is_neutral, F.col(gap))).alias("best_gap"),
        F.min(F.when(is_neutral, F.col(gap))).alias("neutral_gap"),
    )
    return best.filter(F.col("best_gap") < F.col("neutral_gap"))


def variant_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], dead_band: float = 1.0) -> DataFrame:
    """Gap change per metric between two runs of the same material."""
    on = [*keys, "metric"]
    joined = before.select(*on, F.col("gap_pct").alias("before_pct")).join(
        after.select(*on, F.col("gap_pct").alias("after_pct")), on
    )
    delta = F.col("after_pct") - F.col("before_pct")
    return joined.withColumn("delta", delta).withColumn("trend", verdicts.trend(F.col("delta"), dead_band))


def variant_summary(before: DataFrame, after: DataFrame, lsd_before: DataFrame, lsd_after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall rows of a variant diff: mean gap and spectral gap of each run, their change and its trend.

    Gaps are ``(keys, metric, gap_pct)`` rows, spectral gaps ``(keys, lsd)``. A change counts
    beyond one percent of gap and half a dB of spectral gap. Only what both runs have is shown.
    """
    mean = lambda df, name: df.groupBy(*keys).agg(F.round(F.avg(F.round("gap_pct", 1)), 1).alias(name))
    spectral = lambda df, name: df.groupBy(*keys).agg(F.avg("lsd").alias(name))

    def row(old: DataFrame, new: DataFrame, metric: str, dead_band: float) -> DataFrame:
        both = old.join(new, list(keys)).withColumn("delta", F.col("after") - F.col("before"))
        return both.select(*keys, F.lit(metric).alias("metric"), "before", "after", "delta", verdicts.trend(F.col("delta"), dead_band).alias("trend"))

    gap = row(mean(before, "before"), mean(after, "after"), "Mean gap", 1.0)
    return gap.unionByName(row(spectral(lsd_before, "before"), spectral(lsd_after, "after"), "Spectral gap", 0.5))


def correct_knobs(
    df: DataFrame,
    config: dict = tables.CONTROLLER,
    targets: dict[str, Column] | None = None,
    policy: Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]] | None = None,
) -> DataFrame:
    """Proportional correction of the rendering knobs towards the targets.

    Measured columns and knob columns are on the row.  A ``policy`` (errors,
    knobs) -> knobs may override single knobs; where it gives null, the built-in
    rule applies.
    """
    s, ranges, damping = config["sensitivity"], config["ranges"], config["damping"]
    aim = targets or {k: F.lit(v) for k, v in config["targets"].items()}
    err = {k: aim[k] - F.col(k) for k in config["targets"]}
    bright, dark = err["brightness_hz"], err["vocal_darkness_db_oct"]
    change = {
        "tilt_high_db": (bright / s["brightness_per_tilt_high"] * 0.7 + dark / s["darkness_per_tilt_high"] * 0.3) * damping,
        "rms_target_lufs": err["loudness_db"] / s["loudness_per_rms_lufs"] * damping,
        "tilt_low_db": err["bass_balance_db"] / s["bass_balance_per_tilt_low"] * damping,
        "presence_db": err["bass_balance_db"] / s["bass_balance_per_presence"] * damping * 0.5,
        "de_harsh_db": F.when(bright < -200.0, -4.0 * damping).when(bright < -100.0, -2.0 * damping).otherwise(0.0),
    }
    custom = policy(err, {k: F.col(k) for k in ranges}) if policy else {}
    out = df
    for knob, (lo, hi) in ranges.items():
        fixed = clamp(F.col(knob) + change[knob], lo, hi)
        new = F.coalesce(custom[knob], fixed) if knob in custom else fixed
        out = out.withColumn(f"new_{knob}", new)
    for knob in ranges:
        out = out.withColumn(f"delta_{knob}", F.col(f"new_{knob}") - F.col(knob))
    return out


def emotion_targets(df: DataFrame, targets: dict[str, float], emotion: str = "emotion") -> DataFrame:
    """One row per target metric, shifted by the emotion's offset (none for others)."""
    offsets = F.broadcast(literal_rows(df, tables.EMOTION_OFFSETS, f"{emotion} string, metric string, offset double"))
    aims = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(v).alias("target")) for m, v in targets.items()])
    return (
        df.select("*", F.inline(aims))
        .join(offsets, [emotion, "metric"], "left")
        .withColumn("target", F.col("target") + F.coalesce("offset", F.lit(0.0)))
        .drop("offset")
    )


def configuration_drift(trials: DataFrame, default: dict[str, float], options: str = "opts") -> DataFrame:
    """How many trials change each option; companion options are not reported."""
    base = F.create_map(*[F.lit(x) for kv in default.items() for x in kv])
    changed = F.map_filter(
        options,
        lambda k, v: ~k.isin(*tables.ABSORBED_FIELDS) & ~v.eqNullSafe(F.try_element_at(base, k)),
    )
    names = F.map_keys(changed)
    field = F.explode(F.when(F.size(names) == 0, F.array(F.lit("baseline"))).otherwise(names))
    return trials.select(field.alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("trials"))


def running_best(trials: DataFrame, keys: Sequence[str], block: str = "block") -> DataFrame:
    """Best score so far per run and whether the iteration improved it.

    The run stops at the first iteration past the fourth without a change.
    """
    from voxframe.operators.ordered import neighbours, prefix

    scored = prefix(trials, keys, ["iteration"], block, {"best": F.col("score")}, how="min")
    marked = neighbours(
        scored, keys, "iteration", 1, 0, {"improved": lambda w: F.coalesce(F.col("best") < F.lag("best").over(w), F.lit(True))}
    )
    stop = marked.groupBy(*keys).agg(F.min(F.when(~F.col("improved") & (F.col("iteration") > 4), F.col("iteration"))).alias("_stop"))
    return (
        marked.join(stop, list(keys))
        .filter(F.col("_stop").isNull() | (F.col("iteration") <= F.col("_stop")))
        .drop("_stop")
    )


def best_three(scores: DataFrame, keys: Sequence[str], score: str = "score", apart: float = 0.1) -> DataFrame:
    """The three lowest scores, skipping any closer than ``apart`` to the last kept."""
    scores, taken = kept(scores.select(*keys, score), "scores"), None
    for rank in (1, 2, 3):
        if taken is None:
            step = scores.groupBy(*keys).agg(F.min(score).alias("_s1"))
        else:
            free = scores.join(step, list(keys)).filter(F.col(score) - F.col(f"_s{rank - 1}") >= apart)
            nxt = free.groupBy(*keys).agg(F.min(score).alias(f"_s{rank}"))
            step = step.join(nxt, list(keys), "left")
        taken = rank
    ranked = F.array(*[F.struct(F.lit(i).cast("bigint").alias("rank"), F.col(f"_s{i}").alias(score)) for i in (1, 2, 3)])
    return step.select(*keys, F.inline(ranked)).filter(F.col(score).isNotNull())


def upsert_presets(existing: DataFrame, generated: DataFrame, prefix: str = "auto-") -> DataFrame:
    """Replace presets whose name shares ``prefix`` and slot with a generated one.

    The slot is the number after the prefix, so three results stay three rows.
    """
    slot = lambda: F.regexp_extract("name", f"^{prefix}(\\d+)", 1)
    old = existing.withColumn("_slot", F.when(F.col("name").startswith(prefix), slot()).otherwise(F.col("name")))
    new = generated.withColumn("_slot", slot())
    rest = old.join(new.select("_slot"), "_slot", "left_anti")
    return rest.unionByName(new).drop("_slot")


def default_on_empty(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """``rows``, or ``fallback`` when there are none."""
    return rows.unionByName(fallback.filter(~rows.limit(1).exists()))


def parameter_grid(bounds: DataFrame, steps: int) -> DataFrame:
    """All combinations of three evenly spaced axes, per row of ``bounds``.

    ``bounds`` has ``lo_/hi_`` columns for exaggeration, cfg_weight, temperature.
    """
    from voxframe.functions.scalar import linspace

    out = bounds
    for axis in ("exaggeration", "cfg_weight", "temperature"):
        out = out.withColumn(axis, F.explode(linspace(F.col(f"lo_{axis}"), F.col(f"hi_{axis}"), steps)))
    return out.drop(*[f"{side}_{a}" for side in ("lo", "hi") for a in ("exaggeration", "cfg_weight", "temperature")])


def augmentation_plan(clips: DataFrame, speeds: Sequence[float], stem: str = "stem") -> DataFrame:
    """Planned copies of every clip at other speeds: name and sample count."""
    plan = clips.withColumn("speed", F.explode(F.array(*[F.lit(float(s)) for s in speeds])))
    return plan.select(
        stem,
        "speed",
        F.concat(F.col(stem), F.lit("_s"), F.floor(F.col("speed") * 100.0).cast("string")).alias("output"),
        F.ceil(F.col("n_samples") / F.col("speed")).alias("n_samples"),
    )


def cycle_take(slots: DataFrame, phrases: DataFrame, slot: str = "slot", position: str = "position") -> DataFrame:
    """Assign phrases to slots in turn, starting over when they run out."""
    size = phrases.agg(F.count(F.lit(1))).scalar()
    return slots.withColumn(position, F.col(slot) % size).join(phrases, position)
