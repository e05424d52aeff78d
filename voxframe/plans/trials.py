"""Comparison queries: ``lineitem`` as trial measurements, ``embeddings`` as vectors.

A part is a clip, its thirteen metrics are aggregates of its line items; line
status F is the studio side and O the synthesis; a brand is a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import tables, verdicts
from voxframe.functions.scalar import rnd
from voxframe.operators import compare, signal, similarity
from voxframe.operators.ordered import with_block, with_position
from voxframe.operators.recursions import kept
from voxframe.plans.frames import SEGMENTS, segments
from voxframe.plans.registry import query, rnd_sql as r, table, with_sql

METRIC_SQL = [
    ("Loudness", "avg(l_quantity)"),
    ("Dynamic range", "stddev_pop(l_quantity)"),
    ("Brightness", "avg(l_extendedprice) / 20"),
    ("Tone purity", "avg(l_discount) * 10"),
    ("Noise texture", "stddev_pop(l_extendedprice) / 20"),
    ("Duration", "avg(l_tax) * 100"),
    ("Speech rate", "avg(l_linenumber) * 20"),
    ("Voice presence", "avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END)"),
    ("Pitch variation", "avg(l_quantity * l_discount) * 100"),
    ("Bass balance", "avg(l_extendedprice * l_discount) / 500"),
    ("Vocal darkness", "avg(l_extendedprice * l_tax) / 500"),
    ("Vocal weight", "avg(l_extendedprice / l_quantity) / 5"),
    ("Breathiness", "avg(l_quantity * l_tax) * 10"),
]
NAMES = [m for m, _ in METRIC_SQL]
# gaps are whole tenths; summed as integers the mean does not depend on order
MEAN_GAP = "CAST(sum(CAST(round(gap_pct * 10.0) AS BIGINT)) AS DOUBLE) / 10.0 / count(*)"
REPORT = tables.REPORT_METRICS


def clip_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    wide = lines.groupBy(*keys).agg(*[rnd(F.expr(e), 6).alias(m) for m, e in METRIC_SQL])
    return wide.unpivot(keys, NAMES, "metric", "value")


def targets_of(lines: DataFrame) -> DataFrame:
    wide = lines.agg(*[rnd(F.expr(e), 6).alias(m) for m, e in METRIC_SQL])
    return wide.unpivot([], NAMES, "metric", "target")


def _wide_sql(keys: str, where: str = "") -> str:
    cols = ", ".join(f'{r(e, 6)} AS "{m}"' for m, e in METRIC_SQL)
    return f"SELECT {keys + ', ' if keys else ''}{cols} FROM lineitem {where} {'GROUP BY ' + keys if keys else ''}"


def _long_sql(wide: str, value: str = "value") -> str:
    cols = ", ".join(f'"{m}"' for m in NAMES)
    return f"UNPIVOT {wide} ON {cols} INTO NAME metric VALUE {value}"


DEFS = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {s}::DOUBLE)" for m, _, s in tables.METRIC_DEFS) + ") t(metric, scale)"


def _gap_ctes(keys: str, where: str = "", target_where: str = "") -> dict[str, str]:
    raw = "least(100.0, abs(value - target) / scale * 100.0)"
    return {
        "wide": _wide_sql(keys, where),
        "long": _long_sql("wide"),
        "twide": _wide_sql("", target_where),
        "tlong": _long_sql("twide", "target"),
        "defs": DEFS,
        "gap": f"SELECT {keys}, metric, target, value AS actual, {r(raw, 1)} AS gap_pct, CASE WHEN {raw} < 15 THEN 'close' "
        f"WHEN {raw} < 35 THEN 'near' WHEN {raw} < 60 THEN 'far' ELSE 'very far' END AS verdict FROM long JOIN tlong USING (metric) JOIN defs USING (metric)",
    }


def gaps_of(lines: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    metrics = clip_metrics(lines, keys)
    named = metrics.withColumn("series_id", F.struct(*keys))
    out = compare.gap_table(named, targets, compare.metric_definitions(lines))
    return out.select(*[F.col(f"series_id.{k}").alias(k) for k in keys], "metric", "target", "actual", "gap_pct", "verdict")


def part_gaps(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return gaps_of(lines, ["l_partkey"], targets_of(lines)).withColumnRenamed("l_partkey", "series_id")


PART_GAPS = {
    **_gap_ctes("l_partkey"),
    "gaps": "SELECT l_partkey AS series_id, metric, target, actual, gap_pct, verdict FROM gap",
    "summary": f"SELECT series_id, {r(MEAN_GAP, 1)} AS mean_gap_pct FROM gaps GROUP BY series_id",
}


@query("gap_table", with_sql(PART_GAPS, "SELECT * FROM gaps"))
def gap_table(spark, sf):
    return part_gaps(spark, sf)


@query("gap_summary", with_sql(PART_GAPS, "SELECT * FROM summary"))
def gap_summary(spark, sf):
    return compare.gap_summary(part_gaps(spark, sf))


@query(
    "phrase_summary",
    with_sql(PART_GAPS, f"SELECT count(*) AS phrases, {r('avg(mean_gap_pct)', 6)} AS mean_of_means FROM summary"),
)
def phrase_summary(spark, sf):
    return compare.phrase_summary(compare.gap_summary(part_gaps(spark, sf))).withColumn(
        "mean_of_means", rnd(F.col("mean_of_means"), 6)
    )


@query(
    "worst_dimensions",
    with_sql(
        PART_GAPS,
        f"SELECT metric, {r('avg(gap_pct)', 5)} AS mean_gap_pct, row_number() OVER (ORDER BY avg(gap_pct) DESC, metric) AS rank FROM gaps GROUP BY metric",
    ),
)
def worst_dimensions(spark, sf):
    out = compare.worst_dimensions(part_gaps(spark, sf))
    return out.select("metric", rnd(F.col("mean_gap_pct"), 5).alias("mean_gap_pct"), F.col("rank").cast("bigint"))


@query(
    "weighted_objective",
    with_sql(
        PART_GAPS,
        "SELECT series_id, "
        + r(
            " + ".join(
                f"{w} * coalesce(max(CASE WHEN metric = $${m}$$ THEN gap_pct END), 50.0)" for m, w in tables.OBJECTIVE_WEIGHTS
            ),
            6,
        )
        + " AS objective FROM gaps GROUP BY series_id",
    ),
)
def weighted_objective(spark, sf):
    out = compare.weighted_objective(part_gaps(spark, sf))
    return out.withColumn("objective", rnd(F.col("objective"), 6))


@query(
    "model_snapshot",
    with_sql(
        PART_GAPS,
        "SELECT p_brand AS model, row_number() OVER (PARTITION BY p_brand ORDER BY series_id) - 1 AS ordinal, mean_gap_pct AS score, "
        f"{r('avg(mean_gap_pct) OVER (PARTITION BY p_brand)', 6)} AS mean_gap_pct FROM summary JOIN part ON p_partkey = series_id",
    ),
)
def model_snapshot(spark, sf):
    """Scores of a model in clip order with their mean; kept as rows, not an array."""
    scores = compare.gap_summary(part_gaps(spark, sf)).join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"), F.col("p_brand").alias("model")), "series_id"
    )
    blocked = with_block(scores, "series_id")
    placed = with_position(blocked, ["model"], ["series_id"], "block", "ordinal")
    means = scores.groupBy("model").agg(rnd(F.avg("mean_gap_pct"), 6).alias("mean"))
    return placed.join(means, "model").select(
        "model", "ordinal", F.col("mean_gap_pct").alias("score"), F.col("mean").alias("mean_gap_pct")
    )


SIDES = {
    "studio_w": _wide_sql("l_partkey", "WHERE l_linestatus = 'F'"),
    "studio": _long_sql("studio_w"),
    "synth_w": _wide_sql("l_partkey", "WHERE l_linestatus = 'O'"),
    "synth": _long_sql("synth_w"),
}


def _pairs(spark, sf):
    lines = table(spark, sf, "lineitem")
    side = lambda s: clip_metrics(lines.filter(F.col("l_linestatus") == s), ["l_partkey"])
    return compare.paired_metrics(side("F"), side("O"), "l_partkey")


@query(
    "pair_comparison",
    with_sql(
        {
            **SIDES,
            "m": "SELECT metric, count(*) AS pairs, avg(a.value) AS re, avg(b.value) AS sy FROM studio a JOIN synth b USING (l_partkey, metric) GROUP BY metric",
            "g": "SELECT *, CASE WHEN abs(re) <= 0.01 THEN 0 ELSE abs(sy - re) / abs(re) * 100 END AS g FROM m",
        },
        f"SELECT metric, pairs, {r('re', 5)} AS reference, {r('sy', 5)} AS synthetic, {r('g', 5)} AS gap_pct, "
        "CASE WHEN g < 10 THEN 'close' WHEN g < 25 THEN 'near' WHEN g < 50 THEN 'far' ELSE 'very far' END AS verdict FROM g",
    ),
)
def pair_comparison(spark, sf):
    out = compare.pair_comparison(_pairs(spark, sf))
    return out.select(
        "metric", "pairs", *[rnd(F.col(c), 5).alias(c) for c in ("reference", "synthetic", "gap_pct")], "verdict"
    )


@query(
    "naturalness",
    "WITH s AS (SELECT l_partkey, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE avg(l_quantity) / 6 END AS score FROM lineitem GROUP BY l_partkey) "
    f"SELECT count(score) AS scored, {r('avg(score)', 6)} AS naturalness, CASE WHEN avg(score) > 4 THEN 'good' WHEN avg(score) > 3 THEN 'ok' ELSE 'poor' END AS verdict FROM s",
)
def naturalness(spark, sf):
    per_clip = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.when(F.count(F.lit(1)) % 7 != 0, F.avg("l_quantity") / 6).alias("score")
    )
    return compare.naturalness(per_clip).withColumn("naturalness", rnd(F.col("naturalness"), 6))


_GATE = _gap_ctes("l_partkey, l_linestatus")


@query(
    "regression_gate",
    with_sql(
        {
            **_GATE,
            "s": "SELECT l_partkey, l_linestatus, avg(gap_pct) AS x FROM gap GROUP BY ALL",
            "m": f"SELECT p_brand AS model, l_linestatus, {r(MEAN_GAP, 1)} AS g FROM gap JOIN part ON p_partkey = l_partkey GROUP BY ALL",
        },
        f"SELECT c.model, c.g AS current_gap, b.g AS baseline_gap, {r('b.g - c.g', 4)} AS delta, CASE WHEN b.g IS NULL THEN 'MISSING BASELINE' WHEN b.g - c.g > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict "
        "FROM (SELECT * FROM m WHERE l_linestatus = 'O') c LEFT JOIN (SELECT * FROM m WHERE l_linestatus = 'F' AND model <> 'Brand#1') b ON b.model = c.model",
    ),
)
def regression_gate(spark, sf):
    lines = table(spark, sf, "lineitem")
    gaps = gaps_of(lines, ["l_partkey", "l_linestatus"], targets_of(lines))
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"))
    means = compare.gap_summary(gaps.join(brands, "l_partkey"), ["model", "l_linestatus"])
    out = compare.regression_gate(
        means.filter("l_linestatus = 'O'"), means.filter("l_linestatus = 'F' AND model <> 'Brand#1'")
    )
    return out.withColumn("delta", rnd(F.col("delta"), 4))


@query(
    "variant_diff",
    with_sql(
        {**_GATE, "k": "SELECT * FROM gap WHERE metric IN (" + ", ".join(f"'{m}'" for m in REPORT) + ")"},
        f"SELECT b.l_partkey, b.metric, b.gap_pct AS before_pct, a.gap_pct AS after_pct, {r('a.gap_pct - b.gap_pct', 4)} AS delta, "
        "CASE WHEN a.gap_pct - b.gap_pct < -1 THEN 'improved' WHEN a.gap_pct - b.gap_pct > 1 THEN 'worse' ELSE 'same' END AS trend "
        "FROM (SELECT * FROM k WHERE l_linestatus = 'F') b JOIN (SELECT * FROM k WHERE l_linestatus = 'O') a USING (l_partkey, metric)",
    ),
)
def variant_diff(spark, sf):
    lines = table(spark, sf, "lineitem")
    gaps = gaps_of(lines, ["l_partkey", "l_linestatus"], targets_of(lines)).filter(F.col("metric").isin(REPORT))
    out = compare.variant_diff(gaps.filter("l_linestatus = 'F'"), gaps.filter("l_linestatus = 'O'"), ["l_partkey"])
    return out.withColumn("delta", rnd(F.col("delta"), 4))


@query(
    "variant_summary",
    with_sql(
        {
            **_GATE,
            "mg": "SELECT l_partkey, l_linestatus, round(avg(round(gap_pct, 1)), 1) AS g FROM gap GROUP BY l_partkey, l_linestatus",
            "fr": "SELECT vec_id // 14 // 2 AS pair_id, vec_id // 14 % 2 AS side, vec_id % 14 AS frame_idx, [x::DOUBLE for x in embedding] AS v FROM embeddings",
            "ls": "SELECT a.pair_id // 2 AS l_partkey, a.pair_id % 2 AS run, avg(sqrt(list_sum([pow(p - b.v[i], 2) for p, i in a.v]) / len(a.v))) AS lsd FROM fr a JOIN fr b ON a.pair_id = b.pair_id AND a.frame_idx = b.frame_idx AND a.side = 0 AND b.side = 1 GROUP BY a.pair_id",
            "u": "SELECT b.l_partkey, 'Mean gap' AS metric, b.g AS before, a.g AS after, 1.0 AS band FROM mg b JOIN mg a ON a.l_partkey = b.l_partkey AND b.l_linestatus = 'F' AND a.l_linestatus = 'O' UNION ALL "
            "SELECT b.l_partkey, 'Spectral gap', b.lsd, a.lsd, 0.5 FROM ls b JOIN ls a ON a.l_partkey = b.l_partkey AND b.run = 0 AND a.run = 1",
        },
        f"SELECT l_partkey, metric, {r('before', 4)} AS before, {r('after', 4)} AS after, {r('after - before', 4)} AS delta, CASE WHEN after - before < -band THEN 'improved' WHEN after - before > band THEN 'worse' ELSE 'same' END AS trend FROM u",
    ),
)
def variant_summary(spark, sf):
    """Mean gap per part, and the spectral gap of two pairs of vector clips, before and after."""
    lines = table(spark, sf, "lineitem")
    gaps = kept(gaps_of(lines, ["l_partkey", "l_linestatus"], targets_of(lines)).select("l_partkey", "l_linestatus", "metric", "gap_pct"), "gaps")
    fr = _vector_frames(spark, sf, 64)
    pairs = compare.log_spectral_distance(compare.frame_pairs(fr.filter("side = 0"), fr.filter("side = 1"), ["pair_id"]))
    lsd = kept(pairs.select(F.floor(F.col("pair_id") / 2).alias("l_partkey"), (F.col("pair_id") % 2).alias("run"), "lsd"), "lsd")
    out = compare.variant_summary(gaps.filter("l_linestatus = 'F'"), gaps.filter("l_linestatus = 'O'"), lsd.filter("run = 0"), lsd.filter("run = 1"), ["l_partkey"])
    return out.select("l_partkey", "metric", *[rnd(F.col(c), 4).alias(c) for c in ("before", "after", "delta")], "trend")


_STEPS = {"A": 6.0, "N": -6.0, "R": 4.0}


@query(
    "sensitivity_matrix",
    with_sql(
        {
            "w": _wide_sql("l_returnflag"),
            "b": _wide_sql(""),
            "st": "SELECT * FROM (VALUES ('A', 6.0::DOUBLE), ('N', -6.0::DOUBLE), ('R', 4.0::DOUBLE)) t(knob, step)",
        },
        "SELECT knob, "
        + ", ".join(r(f'(w."{m}" - b."{m}") / abs(step)', 6) + f' AS "{m}"' for m in REPORT)
        + " FROM w JOIN st ON knob = l_returnflag, b",
    ),
)
def sensitivity_matrix(spark, sf):
    lines = table(spark, sf, "lineitem")
    trials = clip_metrics(lines, ["l_returnflag"]).withColumnRenamed("l_returnflag", "knob")
    base = targets_of(lines).withColumnRenamed("target", "value")
    out = compare.sensitivity_matrix(trials.filter(F.col("metric").isin(REPORT)), base, _STEPS, REPORT)
    return out.select("knob", *[rnd(F.col(f"`{m}`"), 6).alias(m) for m in REPORT])


_SWEEP = {
    "neutral": _wide_sql(""),
    "runs": _wide_sql("l_linenumber"),
    "wide": "SELECT CAST(l_linenumber AS VARCHAR) AS setting, * EXCLUDE (l_linenumber) FROM runs UNION ALL SELECT '(neutral)', * FROM neutral",
    "long": _long_sql("wide"),
    "twide": _wide_sql("", "WHERE l_linenumber = 3"),
    "tlong": _long_sql("twide", "target"),
    "defs": DEFS,
    "gap": f"SELECT setting, metric, {r('least(100.0, abs(value - target) / scale * 100.0)', 1)} AS gap_pct FROM long JOIN tlong USING (metric) JOIN defs USING (metric)",
    "sw": f"SELECT setting, {r(MEAN_GAP, 1)} AS mean_gap_pct, "
    + ", ".join(f'max(CASE WHEN metric = $${m}$$ THEN gap_pct END) AS "{m}"' for m in REPORT)
    + " FROM gap GROUP BY setting",
}


def _sweep(spark, sf):
    lines = table(spark, sf, "lineitem")
    # the neutral run repeats every line item under its own setting
    settings = F.array(F.col("l_linenumber").cast("string"), F.lit("(neutral)"))
    tagged = lines.withColumn("setting", F.explode(settings))
    gaps = gaps_of(tagged, ["setting"], targets_of(lines.filter("l_linenumber = 3")))
    table_ = compare.sweep_table(gaps.filter(F.col("metric").isin(REPORT)), REPORT)
    return compare.gap_summary(gaps, ["setting"]).join(table_, "setting")


@query("sweep_table", with_sql(_SWEEP, "SELECT * FROM sw"))
def sweep_table(spark, sf):
    return _sweep(spark, sf)


@query(
    "best_setting",
    with_sql(
        _SWEEP,
        "SELECT * FROM (SELECT arg_min(setting, mean_gap_pct) FILTER (setting <> '(neutral)') AS best_setting, min(mean_gap_pct) FILTER (setting <> '(neutral)') AS best_gap, "
        "min(mean_gap_pct) FILTER (setting = '(neutral)') AS neutral_gap FROM (SELECT * FROM sw ORDER BY setting)) WHERE best_gap < neutral_gap",
    ),
)
def best_setting(spark, sf):
    return compare.best_setting(_sweep(spark, sf), "(neutral)")


@query(
    "composite_score",
    with_sql(
        {
            "w": _wide_sql("l_partkey"),
            "l": _long_sql("w"),
            "c": "SELECT * FROM (VALUES ('Loudness', 25.0, 5.0, 0.10), ('Dynamic range', 14.0, 4.0, 0.25), ('Tone purity', 0.5, 0.08, 0.20), ('Vocal darkness', 2.0, 3.0, 0.10)) t(metric, ideal, sigma, weight)",
        },
        f"SELECT l_partkey AS series_id, {r('sum(weight * exp(-0.5 * pow((value - ideal) / sigma, 2)))', 8)} AS score FROM l JOIN c USING (metric) GROUP BY l_partkey",
    ),
)
def composite_score(spark, sf):
    metrics = clip_metrics(table(spark, sf, "lineitem"), ["l_partkey"]).withColumnRenamed("l_partkey", "series_id")
    criteria = compare.literal_rows(
        metrics,
        [("Loudness", 25.0, 5.0, 0.10), ("Dynamic range", 14.0, 4.0, 0.25), ("Tone purity", 0.5, 0.08, 0.20), ("Vocal darkness", 2.0, 3.0, 0.10)],
        "metric string, ideal double, sigma double, weight double",
    )
    return compare.composite_score(metrics, criteria).withColumn("score", rnd(F.col("score"), 8))


# ---- position alignment over voiced runs: user 2k is the reference of user 2k+1

_ORD = {
    **SEGMENTS,
    "o": "SELECT *, series_id // 2 AS pair, series_id % 2 AS side, row_number() OVER (PARTITION BY series_id, kind ORDER BY start_idx) - 1 AS ordinal FROM segments",
    "rw": "SELECT * FROM o WHERE side = 0",
    "sy": "SELECT * FROM o WHERE side = 1",
    "j": "SELECT rw.pair AS series_id, rw.ordinal, rw.kind = 'silence' AS is_pause, "
    "CASE WHEN rw.kind = 'voiced' THEN 'w' || rw.start_idx ELSE '[pause after ''w' || rw.start_idx || ''']' || CASE WHEN sy.start_s IS NULL THEN ' MISSING' ELSE '' END END AS label, "
    f"rw.duration_s AS ref_duration_s, coalesce(sy.duration_s, 0) AS syn_duration_s, {r('CASE WHEN sy.start_s IS NULL THEN 0 WHEN rw.duration_s > 0 THEN sy.duration_s / rw.duration_s ELSE 1 END', 3)} AS duration_ratio, "
    "coalesce(sy.rms_db, 0) AS rms_delta_db FROM rw LEFT JOIN sy ON rw.pair = sy.pair AND rw.kind = sy.kind AND rw.ordinal = sy.ordinal "
    "WHERE rw.kind = 'silence' OR sy.start_s IS NOT NULL",
}


def _alignment(spark, sf):
    seg = kept(segments(spark, sf), "segments")
    placed = with_position(seg, ["series_id", "kind"], ["start_idx"], "block", "ordinal")
    named = kept(placed, "placed").withColumn("label", F.concat(F.lit("w"), F.col("start_idx").cast("string")))
    side = lambda n, kind: named.filter((F.col("series_id") % 2 == n) & (F.col("kind") == kind)).withColumn(
        "series_id", F.floor(F.col("series_id") / 2)
    )
    return compare.align_by_position(side(0, "voiced"), side(0, "silence"), side(1, "voiced"), side(1, "silence"))


@query(
    "alignment_pairs",
    with_sql(
        _ORD,
        f"SELECT series_id, ordinal, is_pause, label, {r('ref_duration_s', 4)} AS ref_duration_s, {r('syn_duration_s', 4)} AS syn_duration_s, duration_ratio, {r('rms_delta_db', 6)} AS rms_delta_db, "
        "CASE WHEN duration_ratio = 0 THEN 'missing' WHEN is_pause THEN CASE WHEN duration_ratio >= 0.5 THEN 'ok' WHEN duration_ratio >= 0.3 THEN 'short' ELSE 'collapsed' END "
        "WHEN duration_ratio BETWEEN 0.6 AND 1.8 THEN 'ok' WHEN duration_ratio < 0.6 THEN 'too short' ELSE 'too long' END AS status FROM j",
    ),
)
def alignment_pairs(spark, sf):
    out = _alignment(spark, sf)
    return (
        out.withColumn("ref_duration_s", rnd(F.col("ref_duration_s"), 4))
        .withColumn("syn_duration_s", rnd(F.col("syn_duration_s"), 4))
        .withColumn("rms_delta_db", rnd(F.col("rms_delta_db"), 6))
    )


@query(
    "alignment_summary",
    with_sql(
        _ORD,
        f"SELECT series_id, {r('avg(duration_ratio)', 6)} AS mean_duration_ratio, {r('coalesce(min(duration_ratio) FILTER (is_pause), 0)', 6)} AS worst_pause_ratio, "
        f"{r('coalesce(avg(rms_delta_db) FILTER (NOT is_pause), 0)', 6)} AS mean_rms_delta_db FROM j GROUP BY series_id",
    ),
)
def alignment_summary(spark, sf):
    out = compare.alignment_summary(_alignment(spark, sf))
    return out.select("series_id", *[rnd(F.col(c), 6).alias(c) for c in out.columns[1:]])


# ---- vectors


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))


_UNIT = {
    "e": "SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings",
    "u": "SELECT vec_id, label, v, CASE WHEN sqrt(list_sum([x*x for x in v])) > 1e-8 THEN [x / sqrt(list_sum([y*y for y in v])) for x in v] ELSE v END AS w FROM e",
    "d": "SELECT label, generate_subscripts(w, 1) - 1 AS dim, unnest(w) AS x FROM u",
    "m": "SELECT label, dim, avg(x) AS x FROM d GROUP BY label, dim",
    "c": "SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m",
    "cent": "SELECT label, list(x ORDER BY dim) AS centroid FROM c GROUP BY label",
}


@query("speaker_centroid", with_sql(_UNIT, f"SELECT label, dim, {r('x', 6)} AS x FROM c"))
def speaker_centroid(spark, sf):
    cents = compare.mean_vector(_vectors(spark, sf), ["label"], "v", unit=True)
    return cents.select("label", F.posexplode("centroid").alias("dim", "x")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), rnd(F.col("x"), 6).alias("x")
    )


@query(
    "mean_vector",
    with_sql(
        {"e": "SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"},
        f"SELECT label, dim, {r('avg(x)', 6)} AS x FROM e GROUP BY label, dim",
    ),
)
def mean_vector(spark, sf):
    cents = compare.mean_vector(_vectors(spark, sf), ["label"], "v")
    return cents.select("label", F.posexplode("centroid").alias("dim", "x")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), rnd(F.col("x"), 6).alias("x")
    )


@query(
    "speaker_similarity",
    with_sql(_UNIT, f"SELECT vec_id, {r('list_cosine_similarity(v, centroid)', 6)} AS similarity FROM u JOIN cent USING (label)"),
)
def speaker_similarity(spark, sf):
    """Every vector against the centroid of its own speaker: an equi-join."""
    vectors = _vectors(spark, sf)
    cents = compare.mean_vector(vectors, ["label"], "v", unit=True)
    return vectors.join(cents, "label").select(
        "vec_id", rnd(compare.cosine(F.col("v"), F.col("centroid")), 6).alias("similarity")
    )


@query(
    "vector_pairs",
    "WITH e AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side, [x::DOUBLE for x in embedding] AS v FROM embeddings) "
    f"SELECT a.pair_id, {r('list_cosine_similarity(a.v, b.v)', 6)} AS similarity, {r('list_sum([abs(x - b.v[i]) for x, i in a.v]) / len(a.v)', 6)} AS distance "
    "FROM e a JOIN e b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1",
)
def vector_pairs(spark, sf):
    vectors = _vectors(spark, sf).select(F.floor(F.col("vec_id") / 2).alias("pair_id"), (F.col("vec_id") % 2).alias("side"), "v")
    a = vectors.filter("side = 0").select("pair_id", F.col("v").alias("a"))
    b = vectors.filter("side = 1").select("pair_id", F.col("v").alias("b"))
    return a.join(b, "pair_id").select(
        "pair_id",
        rnd(compare.cosine(F.col("a"), F.col("b")), 6).alias("similarity"),
        rnd(compare.vector_distance(F.col("a"), F.col("b")), 6).alias("distance"),
    )


@query(
    "similar_vectors",
    with_sql(
        {
            "e": "SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings",
            "p": "SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id",
            "l": "SELECT vec_id, count(*) AS n_links, first(other ORDER BY s DESC, other) AS best_id, max(s) AS s FROM p WHERE s >= 0.8 GROUP BY vec_id",
        },
        f"SELECT vec_id, coalesce(n_links, 0) AS n_links, best_id, {r('s', 6)} AS similarity FROM e LEFT JOIN l USING (vec_id) WHERE vec_id % 20 = 0",
    ),
)
def similar_vectors(spark, sf):
    """Every twentieth vector against all others, by hyperplane bands."""
    out = similarity.similar_vectors(_vectors(spark, sf), "vec_id", "v", F.col("vec_id") % 20 == 0)
    return out.withColumn("similarity", rnd(F.col("similarity"), 6))


_FRAMES = {
    "f": "SELECT vec_id // 14 // 2 AS pair_id, vec_id // 14 % 2 AS side, vec_id % 14 AS frame_idx, [x::DOUBLE for x in embedding] AS v FROM embeddings",
    "j": "SELECT a.pair_id, a.frame_idx, a.v AS x, b.v AS y FROM f a JOIN f b ON a.pair_id = b.pair_id AND a.frame_idx = b.frame_idx AND a.side = 0 AND b.side = 1",
}


def _vector_frames(spark, sf, dims: int):
    clip = F.floor(F.col("vec_id") / 14)
    return _vectors(spark, sf).select(
        F.floor(clip / 2).alias("pair_id"), (clip % 2).alias("side"), (F.col("vec_id") % 14).alias("frame_idx"), F.slice("v", 1, dims).alias("vector")
    )


@query(
    "mel_cepstral_distance",
    with_sql(_FRAMES, f"SELECT pair_id, {r('avg(sqrt(list_sum([pow(p - y[i], 2) for p, i in x]) / 24))', 6)} AS mcd FROM j GROUP BY pair_id"),
)
def mel_cepstral_distance(spark, sf):
    fr = _vector_frames(spark, sf, 64)
    pairs = compare.frame_pairs(fr.filter("side = 0"), fr.filter("side = 1"), ["pair_id"])
    return compare.mel_cepstral_distance(pairs, ["pair_id"]).withColumn("mcd", rnd(F.col("mcd"), 6))


@query(
    "log_spectral_distance",
    with_sql(_FRAMES, f"SELECT pair_id, {r('avg(sqrt(list_sum([pow(p - y[i], 2) for p, i in x]) / len(x)))', 6)} AS lsd FROM j GROUP BY pair_id"),
)
def log_spectral_distance(spark, sf):
    fr = _vector_frames(spark, sf, 64)
    pairs = compare.frame_pairs(fr.filter("side = 0"), fr.filter("side = 1"), ["pair_id"])
    return compare.log_spectral_distance(pairs).groupBy("pair_id").agg(rnd(F.avg("lsd"), 6).alias("lsd"))


# ---- parameter studies


@query(
    "min_max_normalise",
    "WITH t AS (SELECT p_brand AS sweep, l_partkey, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) "
    f"SELECT sweep, l_partkey, {r('CASE WHEN max(a) OVER w - min(a) OVER w > 1e-6 THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0.5 END', 6)} AS a, "
    f"{r('CASE WHEN max(b) OVER w - min(b) OVER w > 1e-6 THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0.5 END', 6)} AS b FROM t WINDOW w AS (PARTITION BY sweep)",
)
def min_max_normalise(spark, sf):
    trials = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"))
        .join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sweep")), "l_partkey")
    )
    out = signal.min_max_normalise(trials, ["a", "b"], ["sweep"])
    return out.select("sweep", "l_partkey", rnd(F.col("a"), 6).alias("a"), rnd(F.col("b"), 6).alias("b"))


@query(
    "region_names",
    "WITH t AS (SELECT l_partkey, avg(l_quantity) / 25 AS e, avg(l_discount) * 6 AS c, avg(l_tax) * 20 AS t FROM lineitem GROUP BY l_partkey) "
    "SELECT l_partkey, CASE WHEN e > 1.3 THEN 'intense' WHEN e > 0.8 THEN 'moderate' ELSE 'calm' END || '_' || CASE WHEN t > 1 THEN 'warm' WHEN t > 0.6 THEN 'neutral' ELSE 'cold' END || '_' || "
    "CASE WHEN c < 0.2 THEN 'commanding' WHEN c < 0.4 THEN 'firm' ELSE 'loose' END AS region FROM t",
)
def region_names(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        (F.avg("l_quantity") / 25).alias("e"), (F.avg("l_discount") * 6).alias("c"), (F.avg("l_tax") * 20).alias("t")
    )
    return t.select("l_partkey", verdicts.region_name(F.col("e"), F.col("c"), F.col("t")).alias("region"))


_C = tables.CONTROLLER


def _controller_sql() -> str:
    t, s, g, d = _C["targets"], _C["sensitivity"], _C["ranges"], _C["damping"]
    change = {
        "tilt_high_db": f"(eb / {s['brightness_per_tilt_high']} * 0.7 + ed / {s['darkness_per_tilt_high']} * 0.3) * {d}",
        "rms_target_lufs": f"el / {s['loudness_per_rms_lufs']} * {d}",
        "tilt_low_db": f"ea / {s['bass_balance_per_tilt_low']} * {d}",
        "presence_db": f"ea / ({s['bass_balance_per_presence']}) * {d} * 0.5",
        "de_harsh_db": f"CASE WHEN eb < -200 THEN {-4 * d} WHEN eb < -100 THEN {-2 * d} ELSE 0 END",
    }
    knobs = ", ".join(
        f"{r(f'least(greatest({base} + {change[k]}, {g[k][0]}), {g[k][1]})', 5)} AS new_{k}, "
        f"{r(f'least(greatest({base} + {change[k]}, {g[k][0]}), {g[k][1]}) - ({base})', 5)} AS delta_{k}"
        for k, base in _KNOBS.items()
    )
    return (
        f"WITH m AS ({_MEASURED_SQL}), e AS (SELECT l_partkey, {t['brightness_hz']} - b AS eb, {t['loudness_db']} - l AS el, "
        f"{t['bass_balance_db']} - a AS ea, {t['vocal_darkness_db_oct']} - dk AS ed FROM m) SELECT l_partkey, {knobs} FROM e"
    )


_KNOBS = {"tilt_low_db": 0.0, "tilt_high_db": -2.0, "rms_target_lufs": -16.0, "presence_db": 0.0, "de_harsh_db": -2.0}
_MEASURED_SQL = (
    "SELECT l_partkey, avg(l_extendedprice) / 20 AS b, -avg(l_quantity) / 2 AS l, avg(l_extendedprice * l_discount) / 900 AS a, -avg(l_tax) * 160 AS dk FROM lineitem GROUP BY l_partkey"
)


def measured_knobs(spark, sf):
    """Measured columns of each part with the knobs as they stand."""
    measured = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        (F.avg("l_extendedprice") / 20).alias("brightness_hz"),
        (-F.avg("l_quantity") / 2).alias("loudness_db"),
        (F.avg(F.col("l_extendedprice") * F.col("l_discount")) / 900).alias("bass_balance_db"),
        (-F.avg("l_tax") * 160).alias("vocal_darkness_db_oct"),
    )
    return measured.select("*", *[F.lit(v).alias(k) for k, v in _KNOBS.items()])


@query("correct_knobs", _controller_sql())
def correct_knobs(spark, sf):
    out = compare.correct_knobs(measured_knobs(spark, sf))
    return out.select(
        "l_partkey", *[rnd(F.col(c), 5).alias(c) for k in _KNOBS for c in (f"new_{k}", f"delta_{k}")]
    )


_EMO = "CASE s_nationkey % 5 WHEN 0 THEN 'angry' WHEN 1 THEN 'tired' WHEN 2 THEN 'excited' WHEN 3 THEN 'sarcastic' ELSE 'neutral' END"


@query(
    "emotion_targets",
    f"WITH s AS (SELECT s_suppkey, {_EMO} AS emotion FROM supplier), t AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _C["targets"].items())
    + ") t(metric, target)), o AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{e}', '{m}', {v}::DOUBLE)" for e, m, v in tables.EMOTION_OFFSETS)
    + f") t(emotion, metric, off)) SELECT s_suppkey, s.emotion, t.metric, {r('target + coalesce(off, 0)', 4)} AS target FROM s CROSS JOIN t LEFT JOIN o ON o.emotion = s.emotion AND o.metric = t.metric",
)
def emotion_targets(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.expr(_EMO).alias("emotion"))
    out = compare.emotion_targets(rows, _C["targets"])
    return out.select("s_suppkey", "emotion", "metric", rnd(F.col("target"), 4).alias("target"))


@query(
    "configuration_drift",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_discount <> 0 AS a, l_tax <> 0.02 AS b, l_quantity > 25 AS c FROM lineitem), f AS ("
    "SELECT 'saturationDrive' AS field, a AS hit FROM t UNION ALL SELECT 'reverbMs', b FROM t UNION ALL SELECT 'tiltLowDb', c FROM t UNION ALL SELECT 'baseline', NOT (a OR b OR c) FROM t) "
    "SELECT field, count(*) AS trials FROM f WHERE hit GROUP BY field",
)
def configuration_drift(spark, sf):
    opts = F.create_map(
        F.lit("saturationDrive"), F.col("l_discount"),
        F.lit("saturationAmount"), F.col("l_extendedprice"),
        F.lit("reverbMs"), F.col("l_tax"),
        F.lit("tiltLowDb"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0),
    )
    trials = table(spark, sf, "lineitem").select(opts.alias("opts"))
    return compare.configuration_drift(trials, {"saturationDrive": 0.0, "saturationAmount": 0.0, "reverbMs": 0.02, "tiltLowDb": 0.0})


_RUNS_SQL = {
    "t": "SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS iteration, o_totalprice / 10000 AS score FROM orders"
}


def _tuning_runs(spark, sf):
    orders = with_block(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey", (F.col("o_totalprice") / 10000).alias("score")),
        "o_orderkey",
    )
    return with_position(orders, ["run_id"], ["o_orderkey"], "block", "iteration")


@query(
    "running_best",
    with_sql(
        {
            **_RUNS_SQL,
            "b": "SELECT *, min(score) OVER (PARTITION BY run_id ORDER BY iteration) AS best FROM t",
            "i": "SELECT *, coalesce(best < lag(best) OVER (PARTITION BY run_id ORDER BY iteration), true) AS improved FROM b",
            "s": "SELECT run_id, min(iteration) FILTER (NOT improved AND iteration > 4) AS stop FROM i GROUP BY run_id",
        },
        f"SELECT i.run_id, iteration, {r('score', 5)} AS score, {r('best', 5)} AS best, improved FROM i JOIN s ON s.run_id = i.run_id WHERE stop IS NULL OR iteration <= stop",
    ),
)
def running_best(spark, sf):
    out = compare.running_best(_tuning_runs(spark, sf), ["run_id"])
    return out.select("run_id", "iteration", rnd(F.col("score"), 5).alias("score"), rnd(F.col("best"), 5).alias("best"), "improved")


@query(
    "best_three",
    with_sql(
        {
            **_RUNS_SQL,
            "k": "SELECT run_id, min(score) AS s, 1 AS rank FROM t GROUP BY run_id UNION ALL "
            "SELECT run_id, min(x) AS s, rank + 1 FROM (SELECT k.run_id, k.rank, t.score AS x FROM k JOIN t ON t.run_id = k.run_id WHERE k.rank < 3 AND t.score - k.s >= 4) GROUP BY run_id, rank",
        },
        f"SELECT run_id, CAST(rank AS BIGINT) AS rank, {r('s', 5)} AS score FROM k",
    ),
)
def best_three(spark, sf):
    out = compare.best_three(_tuning_runs(spark, sf).select("run_id", "score"), ["run_id"], apart=4.0)
    return out.select("run_id", "rank", rnd(F.col("score"), 5).alias("score"))


@query(
    "ranked_ratings",
    f"SELECT o_custkey AS session_id, o_orderkey AS ord, {r('o_totalprice', 2)} AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
)
def ranked_ratings(spark, sf):
    marks = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("score"), (-F.col("o_totalprice")).alias("_down")
    )
    placed = with_position(with_block(marks, "_down"), ["session_id"], ["_down", "ord"], "block", "rank")
    return placed.select("session_id", "ord", rnd(F.col("score"), 2).alias("score"), (F.col("rank") + 1).alias("rank"))


@query(
    "exclusive_winner",
    "SELECT o_custkey AS session_id, o_orderkey AS track FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def exclusive_winner(spark, sf):
    """The latest winner mark of a session is the only one that counts."""
    marks = table(spark, sf, "orders")
    return marks.groupBy(F.col("o_custkey").alias("session_id")).agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("track")
    )


@query(
    "parameter_grid",
    "WITH b AS (SELECT l_returnflag, min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_discount) AS b0, max(l_discount) AS b1, min(l_tax) AS c0, max(l_tax) AS c1 FROM lineitem GROUP BY 1) "
    f"SELECT l_returnflag, {r('a0 + (a1 - a0) * i / 3.0', 6)} AS exaggeration, {r('b0 + (b1 - b0) * j / 3.0', 6)} AS cfg_weight, {r('c0 + (c1 - c0) * k / 3.0', 6)} AS temperature "
    "FROM b, range(4) x(i), range(4) y(j), range(4) z(k)",
)
def parameter_grid(spark, sf):
    names = {"exaggeration": "l_quantity", "cfg_weight": "l_discount", "temperature": "l_tax"}
    bounds = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        *[F.min(c).alias(f"lo_{n}") for n, c in names.items()], *[F.max(c).alias(f"hi_{n}") for n, c in names.items()]
    )
    out = compare.parameter_grid(bounds, 4)
    return out.select("l_returnflag", *[rnd(F.col(n), 6).alias(n) for n in names])


@query(
    "augmentation_plan",
    "SELECT 'clip' || l_partkey AS stem, speed, 'clip' || l_partkey || '_s' || CAST(floor(speed * 100.0) AS BIGINT) AS output, CAST(ceil(n / speed) AS BIGINT) AS n_samples "
    "FROM (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1), (VALUES (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE)) t(speed)",
)
def augmentation_plan(spark, sf):
    clips = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n_samples"))
    return compare.augmentation_plan(clips.withColumn("stem", F.concat(F.lit("clip"), F.col("l_partkey").cast("string"))), [0.9, 1.0, 1.1])


@query(
    "cycle_take",
    "WITH p AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS position, item_id FROM benchmark) "
    "SELECT doc_id AS slot, item_id FROM documents JOIN p ON position = doc_id % (SELECT count(*) FROM benchmark)",
)
def cycle_take(spark, sf):
    phrases = with_position(with_block(table(spark, sf, "benchmark"), "item_id"), [], ["item_id"], "block", "position")
    slots = table(spark, sf, "documents").select(F.col("doc_id").alias("slot"))
    return compare.cycle_take(slots, phrases.select("position", "item_id")).select("slot", "item_id")


@query(
    "upsert_presets",
    "WITH e AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'auto-' || p_partkey || ' (old)' ELSE 'preset' || p_partkey END AS name, p_retailprice AS v FROM part), "
    "n AS (SELECT 'auto-' || s_suppkey || ' (new)' AS name, s_acctbal AS v FROM supplier), "
    "es AS (SELECT *, CASE WHEN name LIKE 'auto-%' THEN regexp_extract(name, '^auto-(\\d+)', 1) ELSE name END AS slot FROM e) "
    f"SELECT name, {r('v', 2)} AS v FROM es WHERE slot NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) UNION ALL SELECT name, {r('v', 2)} FROM n",
)
def upsert_presets(spark, sf):
    key = F.col("p_partkey")
    existing = table(spark, sf, "part").select(
        F.when(key % 3 == 0, F.concat(F.lit("auto-"), key.cast("string"), F.lit(" (old)"))).otherwise(F.concat(F.lit("preset"), key.cast("string"))).alias("name"),
        rnd(F.col("p_retailprice"), 2).alias("v"),
    )
    generated = table(spark, sf, "supplier").select(
        F.concat(F.lit("auto-"), F.col("s_suppkey").cast("string"), F.lit(" (new)")).alias("name"), rnd(F.col("s_acctbal"), 2).alias("v")
    )
    return compare.upsert_presets(existing, generated)
