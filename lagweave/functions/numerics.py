"""Numbers that plans need as constants: quantiles of t, filter taps; and kernels for signals."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
    if x == 1:
        tail = 1.0
    elif x < (a + 1) / (a + b + 2):
        tail = front * _beta_fraction(a, b, x) / a
    else:
        tail = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t >= 0 else tail / 2


def t_quantile(p: float, df: float) -> float:
    """By bisection on the distribution function."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def lowpass_taps(factor: int, half_width: int = 10, beta: float = 5.0) -> np.ndarray:
    """Windowed-sinc taps of an anti-alias filter for decimation by factor; unit sum, symmetric."""
    n = 2 * half_width * factor + 1
    k = np.arange(n) - n // 2
    h = np.sinc(k / factor) * np.kaiser(n, beta)
    return h / h.sum()


def bandpass_taps(low: float, high: float, rate: float, n: int) -> np.ndarray:
    """Hamming-windowed difference of two sincs, odd length, zero at the mean."""
    n += 1 - n % 2
    k = np.arange(n) - n // 2
    low_pass = lambda f: 2 * f / rate * np.sinc(2 * f / rate * k)
    w = np.hamming(n)
    a, b = low_pass(high) * w, low_pass(low) * w
    return a / a.sum() - b / b.sum()


def fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase: the taps' centre on each point, zeros outside."""
    n = len(x) + len(taps) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:n]
    return full[len(taps) // 2 : len(taps) // 2 + len(x)]


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """n samples of the periodic band-limited curve through x."""
    spectrum = np.fft.rfft(x)
    keep = min(len(x), n) // 2 + 1
    out = np.zeros(n // 2 + 1, complex)
    out[:keep] = spectrum[:keep]
    if min(len(x), n) % 2 == 0 and n != len(x):
        out[keep - 1] *= 2 if n < len(x) else 0.5
        if n < len(x):
            out[keep - 1] = out[keep - 1].real
    return np.fft.irfft(out, n) * (n / len(x))


def gammatone(x: np.ndarray, centre: float, rate: float) -> np.ndarray:
    """Fourth-order gammatone: shift to the centre frequency, four one-pole low passes, shift back."""
    width = 1.019 * 24.7 * (4.37e-3 * centre + 1)
    pole = math.exp(-2 * math.pi * width / rate)
    phase = np.exp(-2j * math.pi * centre * np.arange(len(x)) / rate)
    y = x * phase
    for _ in range(4):
        # The one-pole recurrence as an FFT convolution with its decaying response.
        span = min(len(y), max(1, int(math.log(1e-12) / math.log(pole)) + 1))
        h = (1 - pole) * pole ** np.arange(span)
        size = 1 << (len(y) + span - 2).bit_length()
        y = np.fft.ifft(np.fft.fft(y, size) * np.fft.fft(h, size))[: len(y)]
    return 2 * (y * phase.conj()).real


def envelope(x: np.ndarray, rate: float, centres: list[float], power: float = 0.6) -> np.ndarray:
    """Mean over the bands under the Nyquist rate of the output's absolute value, compressed."""
    bands = [np.abs(gammatone(x, c, rate)) ** power for c in centres if c < rate / 2]
    return np.mean(bands, axis=0)
