"""Numeric column helpers shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def rnd(x: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double; never a negative zero."""
    scale = 10.0**digits
    scaled = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)
    # floor gives a bigint, which cannot hold an infinity
    return F.when(F.abs(x) == float("inf"), x).otherwise(scaled)


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.least(F.greatest(x, F.lit(lo) if isinstance(lo, float) else lo), F.lit(hi) if isinstance(hi, float) else hi)


def db(amplitude: Column) -> Column:
    """20 log10, minus infinity for silence."""
    return F.when(amplitude > 0, 20.0 * F.log10(amplitude)).otherwise(F.lit(float("-inf")))


def db_ratio(db_value: float) -> float:
    return 10.0 ** (db_value / 20.0)


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def linspace(lo: Column, hi: Column, steps: int) -> Column:
    """Evenly spaced points; a single step gives the midpoint."""
    if steps <= 1:
        return F.array((lo + hi) / 2.0)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: lo + (hi - lo) * i / float(steps - 1))


def goertzel(samples: Column, freq_hz: float, sample_rate: int) -> Column:
    """Magnitude of one frequency over an array column."""
    coeff = 2.0 * math.cos(2.0 * math.pi * freq_hz / sample_rate)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(
        samples,
        start,
        lambda s, x: F.struct((coeff * s["a"] - s["b"] + x.cast("double")).alias("a"), s["a"].alias("b")),
        lambda s: F.sqrt(F.greatest(s["a"] * s["a"] + s["b"] * s["b"] - coeff * s["a"] * s["b"], F.lit(0.0))),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
