"""Numeric kernels for Arrow batches: alignment and acoustic frame features."""

from __future__ import annotations

import numpy as np

# Analysis framing and search ranges.
FRAME_S, HOP_S = 0.025, 0.010
PITCH_MIN_HZ, PITCH_MAX_HZ = 80, 500
SILENCE = 0.01


def warp_path(a: np.ndarray, b: np.ndarray, stride: int | None = None) -> np.ndarray:
    """Cheapest monotone alignment of two whole series, as (i, j) rows.

    Costs fill along anti-diagonals, each one vector operation. Only every `stride`-th pair of
    diagonals is kept; walking back, the steps of one stride at a time are computed again from
    the pair before it, so memory grows with the shorter side times the root of the longer. A
    diagonal step wins ties, then a step in ``a``.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return np.empty((0, 2), dtype=int)
    stride = stride or max(64, int(4 * np.sqrt(n + m)))

    def advance(s: int, last: np.ndarray, older: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Diagonal i + j = s, by i, from the two before it, and the step that leads to each cell."""
        here, step = np.full(n + 1, np.inf), np.zeros(n + 1, np.int8)
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        both, up, left = older[i - 1], last[i - 1], last[i]
        step[i] = np.where((both <= up) & (both <= left), 0, np.where(up <= left, 1, 2))
        here[i] = np.minimum(np.minimum(both, up), left) + np.abs(a[i - 1] - b[s - i - 1])
        return here, step

    older, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = 0.0  # before the first cell
    kept = []
    for s in range(2, n + m + 1):
        if (s - 2) % stride == 0:
            kept.append((older, last))
        older, last = last, advance(s, last, older)[0]
    i, j, path = n, m, [(n - 1, m - 1)]
    for block in range(len(kept) - 1, -1, -1):
        older, last = kept[block]
        first = 2 + block * stride
        steps = []
        for s in range(first, min(first + stride, i + j + 1)):
            here, step = advance(s, last, older)
            older, last = last, here
            steps.append(step)
        while i + j >= first and (i > 1 or j > 1):
            i, j = ((i - 1, j - 1), (i - 1, j), (i, j - 1))[steps[i + j - first][i]]
            path.append((i - 1, j - 1))
    return np.array(path[::-1])


def framed(samples: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Strided (frames, size) view of whole windows."""
    if len(samples) < size or hop < 1:
        return np.empty((0, max(size, 1)))
    return np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]


def power_of_two(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def mel_bank(bands: int, lo_hz: float, hi_hz: float, n_fft: int, rate: int) -> np.ndarray:
    """Triangular filters on the mel scale, (bands, n_fft / 2)."""
    mel = np.linspace(2595.0 * np.log10(1.0 + lo_hz / 700.0), 2595.0 * np.log10(1.0 + hi_hz / 700.0), bands + 2)
    edges = np.floor((n_fft + 1.0) * 700.0 * (10.0 ** (mel / 2595.0) - 1.0) / rate).astype(int)
    k = np.arange(n_fft // 2)
    bank = np.zeros((bands, n_fft // 2))
    for row, (left, mid, right) in enumerate(zip(edges, edges[1:], edges[2:])):
        up, down = (k >= left) & (k < mid), (k >= mid) & (k < right)
        bank[row, up] = (k[up] - left) / (mid - left)
        bank[row, down] = (right - k[down]) / (right - mid)
    return bank


def cosine_basis(first: int, count: int, bands: int) -> np.ndarray:
    n = np.arange(first, first + count)[:, None]
    return np.cos(np.pi * n * (2 * np.arange(bands) + 1) / (2 * bands))


def magnitudes(samples: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
    """Hann-windowed magnitude spectra per 10 ms hop and the transform size."""
    size = power_of_two(int(rate * FRAME_S))
    frames = framed(samples, size, int(rate * HOP_S))
    spectra = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))[:, : size // 2]
    return spectra, size


def tone_strength(frames: np.ndarray, hz: np.ndarray, rate: int) -> np.ndarray:
    """Magnitude of one frequency per frame (each row its own frequency)."""
    angle = 2.0 * np.pi * np.asarray(hz)[:, None] / rate * np.arange(frames.shape[1])
    return np.hypot((frames * np.cos(angle)).sum(axis=1), (frames * np.sin(angle)).sum(axis=1))


def autocorrelation_peak(frames: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(energy, best correlation, its lag) over the 80-500 Hz lags."""
    size = frames.shape[1]
    spectrum = np.fft.rfft(frames, 2 * size, axis=1)
    corr = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :size]
    lags = np.arange(rate // PITCH_MAX_HZ, min(rate // PITCH_MIN_HZ, size - 1) + 1)
    best = corr[:, lags].argmax(axis=1)
    return corr[:, 0], corr[np.arange(len(frames)), lags[best]], lags[best]


def spectral_columns(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """Centroid, bandwidth and magnitudes per audible frame."""
    mags, size = magnitudes(samples, rate)
    index = np.arange(len(mags))
    heard = mags.sum(axis=1) > 1e-10
    mags, index = mags[heard], index[heard]
    hz = np.arange(size // 2) * rate / size
    weight = mags.sum(axis=1, keepdims=True)
    centroid = (mags * hz).sum(axis=1) / weight[:, 0]
    spread = np.sqrt((mags * (hz - centroid[:, None]) ** 2).sum(axis=1) / weight[:, 0])
    return {"frame_idx": index, "centroid": centroid, "bandwidth": spread, "mags": mags, "bin_hz": np.full(len(index), rate / size)}


def voice_columns(samples: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """Harmonic-to-noise, cepstral peak and breathiness of the sounding frames.

    NaN where a frame does not count towards that average.
    """
    size = int(rate * FRAME_S)
    frames = framed(samples, size, int(rate * HOP_S))
    index = np.arange(len(frames))
    loud = np.sqrt((frames**2).mean(axis=1)) >= SILENCE if len(frames) else np.zeros(0, bool)
    frames, index = frames[loud], index[loud]
    if not len(frames):
        none = np.empty(0)
        return {"frame_idx": index, "hnr": none, "cpp": none, "breathiness": none}
    energy, peak, lag = autocorrelation_peak(frames, rate)
    clean = (peak > 0) & (energy > peak)
    hnr = np.full(len(frames), np.nan)
    hnr[clean] = 10.0 * np.log10(peak[clean] / (energy[clean] - peak[clean]))
    f0 = rate / lag
    h1, h2 = tone_strength(frames, f0, rate), tone_strength(frames, 2 * f0, rate)
    both = (peak > 0) & (h1 > 1e-8) & (h2 > 1e-8)
    breath = np.full(len(frames), np.nan)
    breath[both] = 20.0 * np.log10(h1[both] / h2[both])
    half = size // 2
    logs = np.log(np.maximum(np.abs(np.fft.fft(frames * np.hanning(size), axis=1))[:, :half] ** 2, 1e-12))
    # real part of the transform of the half spectrum, scaled by its length
    cepstrum = np.fft.fft(logs, axis=1).real / half
    lo, hi = min(rate // PITCH_MAX_HZ, half - 1), min(rate // PITCH_MIN_HZ, half - 1)
    cpp = np.full(len(frames), np.nan)
    if hi > lo:
        part = cepstrum[:, lo : hi + 1]
        at = part.argmax(axis=1)
        line = part[:, 0] + (part[:, -1] - part[:, 0]) / (hi - lo) * at
        cpp = np.maximum(part.max(axis=1) - line, 0.0)
    return {"frame_idx": index, "hnr": hnr, "cpp": cpp, "breathiness": breath}


def pitch_columns(samples: np.ndarray, rate: int, size: int = 2048, hop: int = 512, clarity: float = 0.6) -> dict[str, np.ndarray]:
    """F0 per frame from the normalised autocorrelation peak; 0 when unvoiced."""
    frames = framed(samples, size, hop)
    if not len(frames):
        return {"frame_idx": np.empty(0, int), "f0": np.empty(0)}
    energy, peak, lag = autocorrelation_peak(frames, rate)
    # a window of lag samples less overlaps, so compare with the energy left
    left = energy * (size - lag) / size
    voiced = (energy / size > 5e-4) & (peak > clarity * np.maximum(left, 1e-12))
    return {"frame_idx": np.arange(len(frames)), "f0": np.where(voiced, rate / lag, 0.0)}


def cepstral_frames(samples: np.ndarray, rate: int, bands: int, lo_hz: float, hi_hz: float, first: int, count: int, floor: float) -> np.ndarray:
    """Log mel energies through a cosine transform, per frame."""
    mags, size = magnitudes(samples, rate)
    logs = np.log(mags @ mel_bank(bands, lo_hz, hi_hz, size, rate).T + floor)
    return logs @ cosine_basis(first, count, bands).T


def log_mel_frames(samples: np.ndarray, rate: int, bands: int = 80, lo_hz: float = 80.0, hi_hz: float = 7600.0) -> np.ndarray:
    mags, size = magnitudes(samples, rate)
    power = (mags**2) @ mel_bank(bands, lo_hz, hi_hz, size, rate).T
    return 10.0 * np.log10(np.maximum(power, 1e-10))


def band_energy(samples: np.ndarray, rate: int, lo_hz: float, hi_hz: float, steps: int = 8, window: int = 2048) -> float:
    """Mean magnitude at log-spaced frequencies over the first window."""
    part = samples[:window][None, :]
    hz = np.exp(np.linspace(np.log(lo_hz), np.log(hi_hz), steps))
    used = hz[hz <= rate / 2]
    if not part.size or not len(used):
        return 0.0
    return float(sum(tone_strength(part, np.array([f]), rate)[0] for f in used) / part.size / steps)


def coarse_centroid(samples: np.ndarray, rate: int, window: int = 2048) -> float:
    # The twelve probe frequencies.
    probes = [80, 150, 250, 400, 600, 1000, 1500, 2500, 4000, 6000, 8000, 12000]
    part = samples[:window][None, :]
    used = np.array([f for f in probes if f <= rate / 2], float)
    if not part.size:
        return 0.0
    level = np.array([tone_strength(part, np.array([f]), rate)[0] for f in used])
    return float((used * level).sum() / level.sum()) if level.sum() > 0 else 0.0
