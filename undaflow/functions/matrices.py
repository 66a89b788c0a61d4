"""Constant matrices of the spectral operators, from their closed formulas."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def window(name: str | None, n: int) -> np.ndarray:
    if name in (None, "boxcar"):
        return np.ones(n)
    if name == "hann":
        return hann(n)
    raise ValueError(f"unknown window {name!r}")


def hz_to_mel(f, htk: bool = False):
    """Mels of frequencies: linear to 1000 Hz and logarithmic above, or the logarithmic formula throughout."""
    f = np.asarray(f, float)
    if htk:
        return 2595.0 * np.log10(1.0 + f / 700.0)
    return np.where(f < 1000.0, f * 3 / 200.0, 15.0 + np.log(np.maximum(f, 1e-10) / 1000.0) * 27.0 / np.log(6.4))


def mel_to_hz(m, htk: bool = False):
    m = np.asarray(m, float)
    if htk:
        return 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    return np.where(m < 15.0, m * 200.0 / 3, 1000.0 * np.exp(np.log(6.4) / 27.0 * (m - 15.0)))


def mel_filters(rate: float, n_fft: int, n_mels: int, fmin: float = 0.0, fmax: float | None = None, htk: bool = False) -> np.ndarray:
    """Triangles between neighbouring mel points, each of area 2 over its width in Hz: (n_mels, bins)."""
    freq = np.arange(n_fft // 2 + 1) * rate / n_fft
    edge = mel_to_hz(np.linspace(hz_to_mel(fmin, htk), hz_to_mel(fmax or rate / 2, htk), n_mels + 2), htk)
    rise = (freq - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - freq) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (edge[2:] - edge[:-2]))[:, None]


def dct(n_out: int, n_in: int) -> np.ndarray:
    """The orthonormal cosine transform of type 2."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n_in)) * np.where(k == 0, np.sqrt(1 / n_in), np.sqrt(2 / n_in))


def lifter(n: int, strength: int) -> np.ndarray:
    return 1 + strength / 2 * np.sin(np.pi * np.arange(1, n + 1) / strength) if strength else np.ones(n)


def chroma_filters(rate: float, n_fft: int, n_chroma: int = 12, centre: float = 5.0, width: float = 2.0) -> np.ndarray:
    """Bells around the pitch classes, from C on, weighted by distance from octave ``centre``; tuning is 0. (n_chroma, bins)"""
    f = np.arange(1, n_fft) * rate / n_fft
    at = n_chroma * np.log2(f / (440.0 / 16))
    at = np.concatenate([[at[0] - 1.5 * n_chroma], at])
    wide = np.concatenate([np.maximum(np.diff(at), 1.0), [1.0]])
    half = round(n_chroma / 2)
    gap = np.remainder(at[None, :] - np.arange(n_chroma)[:, None] + half + 10 * n_chroma, n_chroma) - half
    w = np.exp(-0.5 * (2 * gap / wide) ** 2)
    w = w / np.sqrt((w**2).sum(axis=0))
    w = w * np.exp(-0.5 * ((at / n_chroma - centre) / width) ** 2)
    return np.roll(w, -3 * (n_chroma // 12), axis=0)[:, : n_fft // 2 + 1]


def harmonic_sum(bins: int, overtones: int, undertones: int) -> np.ndarray:
    """The sum over harmonics 1 to overtones - 1 less that over fractions 1/2 to 1/(undertones - 1), as a matrix on
    spectra: a harmonic is read between bins linearly, and is 0 beyond the last."""
    out = np.zeros((bins, bins))
    for h, sign in [(float(h), 1.0) for h in range(1, overtones)] + [(1.0 / h, -1.0) for h in range(2, undertones)]:
        at = np.arange(bins) * h
        ok = at <= bins - 1
        low = np.minimum(at.astype(int), bins - 2)
        for b in np.flatnonzero(ok):
            out[b, low[b]] += sign * (1 - (at[b] - low[b]))
            out[b, low[b] + 1] += sign * (at[b] - low[b])
    return out


def checker(n: int, normalize: bool = True) -> np.ndarray:
    """The checkerboard of 2 n + 1 rows: 1 where the signs of the offsets differ, -1 where they agree, 0 on the axes."""
    s = np.sign(np.arange(-n, n + 1))
    k = -np.outer(s, s).astype(float)
    return k / np.abs(k).sum() if normalize and n else k


def positions(n: int, dim: int) -> np.ndarray:
    """Sines and cosines of positions at wavelengths from 2 pi to 10000 * 2 pi: (n, dim)."""
    angle = np.arange(n)[:, None] * np.exp(np.arange(0, dim, 2) * (-np.log(10000.0) / dim))
    out = np.zeros((n, dim))
    out[:, 0::2] = np.sin(angle)
    out[:, 1::2] = np.cos(angle[:, : dim // 2])
    return out
