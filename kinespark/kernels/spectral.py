"""Windows, spectra and short-time frames."""

from __future__ import annotations

import numpy as np

#: Names of windows.
WINDOWS = ("hann", "hamming", "rect", "rectangular")


def weights(n: int, window: str) -> np.ndarray:
    """Symmetric window of n points; Hann and Hamming of one point are NaN (0 / 0)."""
    if window.startswith("rect"):
        return np.ones(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.cos(2 * np.pi * np.arange(n) / np.float64(n - 1))
    return 0.5 * (1 - c) if window == "hann" else 0.54 - 0.46 * c


def magnitude(x: np.ndarray, window: str) -> np.ndarray:
    """One-sided magnitude spectrum, n // 2 + 1 bins."""
    return np.abs(np.fft.rfft(x * weights(len(x), window))) if len(x) else np.empty(0)


def detrend(segment: np.ndarray, mode: str) -> np.ndarray:
    if mode == "none":
        return segment
    if mode in ("mean", "constant"):
        return segment - segment.mean()
    n = len(segment)
    i = np.arange(n, dtype=np.float64)
    den = n * (i * i).sum() - i.sum() ** 2
    slope = (n * (i * segment).sum() - i.sum() * segment.sum()) / den if den else 0.0
    return segment - (slope * i + (segment.sum() - slope * i.sum()) / n)


def detrend_rows(segments: np.ndarray, mode: str) -> np.ndarray:
    """``detrend`` of each row."""
    if mode == "none":
        return segments
    flat = segments - segments.mean(axis=1, keepdims=True)
    if mode in ("mean", "constant"):
        return flat
    i = np.arange(segments.shape[1], dtype=np.float64)
    i -= i.mean()
    den = (i * i).sum()
    return flat - np.outer(flat @ i / den, i) if den else flat


def frames(n: int, nperseg: int, noverlap: int) -> tuple[int, np.ndarray]:
    """(segment length, starts). Length 0 or of at least n gives one full segment; a trailing part is dropped."""
    size = n if nperseg == 0 or nperseg >= n else nperseg
    if size == 0:
        return 0, np.empty(0, np.int64)
    hop = size - min(noverlap, size - 1)
    return size, np.arange(0, n - size + 1, hop)


def stft(x: np.ndarray, rate: float, window: str = "hann", nperseg: int = 256, noverlap: int = 128, trend: str = "none"):
    """(frame times in s, complex spectra by frame, segment length, window)."""
    size, starts = frames(len(x), nperseg, noverlap)
    w = weights(size, window)
    spectra = np.array([np.fft.rfft(detrend(x[s : s + size], trend) * w) for s in starts]) if size else np.empty((0, 0))
    return (starts + size / 2) / rate, spectra, size, w


def scaled_power(power: np.ndarray, size: int, w: np.ndarray, rate: float, scaling: str) -> np.ndarray:
    """Magnitude: root of the power. Density: power / (rate * sum w^2), doubled but for DC and an even segment's last bin."""
    if scaling == "magnitude":
        return np.sqrt(power)
    out = power / (rate * (w * w).sum())
    last = out.shape[-1] - 1 if size % 2 == 0 else out.shape[-1]
    out[..., 1:last] *= 2
    return out


def welch(x: np.ndarray, rate: float, window: str = "hann", nperseg: int = 256, noverlap: int = 128, trend: str = "none", average: str = "mean", scaling: str = "density"):
    """(frequencies, combined spectrum)."""
    _, spectra, size, w = stft(x, rate, window, nperseg, noverlap, trend)
    if not size or not len(spectra):
        return np.empty(0), np.empty(0)
    power = np.abs(spectra) ** 2
    combined = power.mean(axis=0) if average == "mean" else np.median(power, axis=0)
    return np.arange(len(combined)) * rate / size, scaled_power(combined, size, w, rate, scaling)
