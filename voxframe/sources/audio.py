"""WAV corpora as clip and frame tables.

A clip arrives as one binary row; only Arrow-batched kernels touch samples, and
they emit rows ``(clip_id, frame_idx, ...)`` per feature family, so a job computes
just the families it asks for.  Everything after that is DataFrame work.
"""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import kernels

CLIPS = "clip_id string, path string, sample_rate int, n_samples bigint, duration_s double, reject string"


def _open(content: bytes) -> wave.Wave_read:
    reader = wave.open(io.BytesIO(content))
    if reader.getsampwidth() not in (2, 4):
        raise ValueError(f"unsupported depth {8 * reader.getsampwidth()}")
    return reader


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate; channels are averaged."""
    with _open(content) as reader:
        kind = np.dtype("<i2") if reader.getsampwidth() == 2 else np.dtype("<i4")
        raw = np.frombuffer(reader.readframes(reader.getnframes()), kind).astype(float) / np.iinfo(kind).max
        return raw.reshape(-1, reader.getnchannels()).mean(axis=1), reader.getframerate()


def _wavs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content")


def clip_id_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def scan_clips(spark: SparkSession, path: str) -> DataFrame:
    """Header facts of every clip; unreadable ones carry a reject reason.

    Write this once per corpus: filters on duration then need no audio.
    """

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    with _open(content) as r:
                        n, rate = r.getnframes(), r.getframerate()
                    rows.append([clip_id_of(where), where, rate, n, n / rate, None])
                except Exception as e:  # noqa: BLE001 - any undecodable file is counted
                    rows.append([clip_id_of(where), where, None, None, None, str(e) or type(e).__name__])
            yield pd.DataFrame(rows, columns=["clip_id", "path", "sample_rate", "n_samples", "duration_s", "reject"])

    return _wavs(spark, path).mapInPandas(headers, CLIPS)


Extract = Callable[[np.ndarray, int], dict[str, np.ndarray]]


def _indexed(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    return {"frame_idx": np.arange(len(values)), name: values}


def _levels(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    frames = kernels.framed(samples, int(rate * kernels.FRAME_S), int(rate * kernels.HOP_S))
    return {**_indexed(np.sqrt((frames**2).mean(axis=1)), "rms"), "peak": np.abs(frames).max(axis=1, initial=0.0)}


def _envelope(samples: np.ndarray, rate: int, frame_s: float = 0.010) -> dict[str, np.ndarray]:
    size = max(int(rate * frame_s), 1)
    starts = np.arange(0, len(samples), size)
    n = np.diff(np.append(starts, len(samples)))
    sumsq = np.add.reduceat(samples**2, starts) if len(samples) else np.empty(0)
    return {**_indexed(np.sqrt(sumsq / np.maximum(n, 1)), "rms"), "n": n}


def _samples(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    return _indexed(samples, "value")


def _mfcc(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    return _indexed(kernels.cepstral_frames(samples, rate, 26, 80.0, 8000.0, 0, 13, 1e-10), "vector")


def _mcep(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    return _indexed(kernels.cepstral_frames(samples, rate, 24, 80.0, 7600.0, 1, 24, 1e-12), "vector")


def _log_mel(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    return _indexed(kernels.log_mel_frames(samples, rate), "vector")


def _bands(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    # Presence, high, low and bright bands of the quality check.
    bands = [("presence", 2000.0, 5000.0), ("high", 8000.0, rate / 2 - 1), ("low", 80.0, 500.0), ("bright", 2000.0, 8000.0)]
    out = {name: np.array([kernels.band_energy(samples, rate, lo, hi)]) for name, lo, hi in bands}
    return {"frame_idx": np.zeros(1, int), **out, "coarse_centroid": np.array([kernels.coarse_centroid(samples, rate)])}


FAMILIES: dict[str, tuple[Extract, str]] = {
    "samples": (_samples, "value double"),
    "levels": (_levels, "rms double, peak double"),
    "envelope": (_envelope, "rms double, n bigint"),
    "spectral": (kernels.spectral_columns, "centroid double, bandwidth double, mags array<double>, bin_hz double"),
    "voice": (kernels.voice_columns, "hnr double, cpp double, breathiness double"),
    "pitch": (kernels.pitch_columns, "f0 double"),
    "mfcc": (_mfcc, "vector array<double>"),
    "mcep": (_mcep, "vector array<double>"),
    "log_mel": (_log_mel, "vector array<double>"),
    "bands": (_bands, "presence double, high double, low double, bright double, coarse_centroid double"),
}


def frame_table(spark: SparkSession, path: str, family: str, keep: Sequence[str] | None = None, rows_per_batch: int = 20_000) -> DataFrame:
    """Frames of one feature family for every decodable clip.

    Undecodable files are skipped here and counted by ``scan_clips``.  Rows leave
    in bounded batches however long a clip is.
    """
    extract, fields = FAMILIES[family]
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    wanted = [n for n in names if keep is None or n in keep]
    kept_fields = ", ".join(f.strip() for f, n in zip(fields.split(","), names) if n in wanted)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    samples, rate = decode(content)
                except Exception:  # noqa: BLE001, S112 - reported by scan_clips
                    continue
                cols = extract(samples, rate)
                total = len(cols["frame_idx"])
                for at in range(0, total, rows_per_batch):
                    part = slice(at, at + rows_per_batch)
                    rows = {"clip_id": clip_id_of(where), "sample_rate": rate, "frame_idx": cols["frame_idx"][part]}
                    for name in wanted:
                        values = cols[name][part]
                        rows[name] = list(values) if values.ndim > 1 else values
                    yield pd.DataFrame(rows)

    schema = f"clip_id string, sample_rate int, frame_idx bigint, {kept_fields}"
    return _wavs(spark, path).mapInPandas(kernel, schema)


def spectral_summary(frames: DataFrame) -> DataFrame:
    """Clip means of the spectral frame columns."""
    from voxframe.operators.signal import spectral_flatness

    mags = F.col("mags")
    split = F.least((1000.0 / F.col("bin_hz")).cast("int"), F.size(mags) - 1)
    power = lambda part: F.aggregate(part, F.lit(0.0), lambda s, m: s + m * m)
    high = power(F.slice(mags, split + 1, F.size(mags)))
    balance = F.when(high > 1e-20, 10.0 * F.log10(power(F.slice(mags, F.lit(1), split)) / high)).otherwise(0.0)
    return frames.groupBy("clip_id").agg(
        F.avg("centroid").alias("brightness_hz"),
        F.avg("bandwidth").alias("bandwidth_hz"),
        F.avg(spectral_flatness(mags)).alias("tone_purity"),
        F.avg(balance).alias("bass_balance_db"),
    )


def tilt_summary(frames: DataFrame) -> DataFrame:
    """Mean over frames of the per-frame spectral tilt."""
    bins = frames.select("clip_id", "frame_idx", "bin_hz", F.posexplode("mags").alias("bin", "mag"))
    hz = F.col("bin") * F.col("bin_hz")
    power = F.col("mag") * F.col("mag")
    used = bins.filter(
        (F.col("bin") >= F.greatest((100.0 / F.col("bin_hz")).cast("int"), F.lit(1)))
        & (F.col("bin") < (8000.0 / F.col("bin_hz")).cast("int"))
        & (power > 1e-20)
    )
    slopes = used.groupBy("clip_id", "frame_idx").agg(F.coalesce(F.regr_slope(10.0 * F.log10(power), F.log2(hz)), F.lit(0.0)).alias("t"))
    return slopes.groupBy("clip_id").agg(F.avg("t").alias("vocal_darkness_db_oct"))


def voice_summary(frames: DataFrame) -> DataFrame:
    """Averages over the frames that count towards each; 0 without any."""
    mean = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0))
    return frames.groupBy("clip_id").agg(
        mean("hnr").alias("hnr_db"), mean("cpp").alias("cpp"), mean("breathiness").alias("breathiness_db")
    )
