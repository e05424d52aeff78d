"""Threshold classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label cut-points of the scoring rules.
GAP_CUTS = [(15.0, "close"), (35.0, "near"), (60.0, "far")]
RELATIVE_CUTS = [(10.0, "close"), (25.0, "near"), (50.0, "far")]
VERY_FAR = "very far"
WARM_RTT_MS = 8000.0
CACHE_HIT_RTT_MS = 150.0


def _below(value: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    out = F.when(value < cuts[0][0], cuts[0][1])
    for cut, label in cuts[1:]:
        out = out.when(value < cut, label)
    return out.otherwise(otherwise)


def gap_verdict(pct: Column) -> Column:
    """Takes the unrounded percentage."""
    return _below(pct, GAP_CUTS, VERY_FAR)


def relative_gap(reference: Column, actual: Column) -> Column:
    return F.when(F.abs(reference) <= 0.01, 0.0).otherwise(F.abs(actual - reference) / F.abs(reference) * 100.0)


def relative_verdict(pct: Column) -> Column:
    return _below(pct, RELATIVE_CUTS, VERY_FAR)


def alignment_status(ratio: Column, is_pause: Column) -> Column:
    pause = F.when(ratio >= 0.5, "ok").when(ratio >= 0.3, "short").otherwise("collapsed")
    word = F.when((ratio >= 0.6) & (ratio <= 1.8), "ok").when(ratio < 0.6, "too short").otherwise("too long")
    return F.when(ratio == 0.0, "missing").when(is_pause, pause).otherwise(word)


def trend(delta: Column, dead_band: float) -> Column:
    return F.when(delta < -dead_band, "improved").when(delta > dead_band, "worse").otherwise("same")


def naturalness_verdict(score: Column) -> Column:
    return F.when(score > 4.0, "good").when(score > 3.0, "ok").otherwise("poor")


def region_name(exaggeration: Column, cfg_weight: Column, temperature: Column) -> Column:
    energy = F.when(exaggeration > 1.3, "intense").when(exaggeration > 0.8, "moderate").otherwise("calm")
    tone = F.when(temperature > 1.0, "warm").when(temperature > 0.6, "neutral").otherwise("cold")
    grip = F.when(cfg_weight < 0.2, "commanding").when(cfg_weight < 0.4, "firm").otherwise("loose")
    return F.concat_ws("_", energy, tone, grip)


def is_warm(rtt_ms: Column) -> Column:
    return rtt_ms < WARM_RTT_MS


def is_cache_hit(rtt_ms: Column) -> Column:
    return rtt_ms < CACHE_HIT_RTT_MS


def failed_checks(peak_db: Column, rms_db: Column, tilt: Column, noise: Column) -> Column:
    """Names of the failed quality predicates, in check order."""
    checks = [
        ("no-clip", peak_db < -0.5),
        ("not-silent", rms_db > -40.0),
        ("tilt-sane", tilt > -20.0),
        ("has-dynamics", peak_db - rms_db > 3.0),
        ("no-static-noise", noise < 0.02),
    ]
    return F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks]))


def gauss_score(value: Column, ideal: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * F.pow((value - ideal) / sigma, F.lit(2.0)))
