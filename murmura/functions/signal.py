"""Signal processing on numpy arrays, for use inside Arrow and pandas functions."""

from __future__ import annotations

import numpy as np

WINDOW, STEP = 512, 128
FILTERS, COEFFICIENTS = 24, 12
QUIET_SHARE = 0.2


def chunks(samples: np.ndarray, size: int, rest: bool = False) -> list[np.ndarray]:
    """Consecutive whole chunks; a shorter rest is dropped unless asked for."""
    return [samples[i : i + size] for i in range(0, len(samples) if rest else len(samples) - size + 1, size)]


def frame_starts(n: int, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """Offsets of frames: those whose end lies before the last sample."""
    return np.arange(0, max(0, n - window), step)


def extract_frame(samples: np.ndarray, start: int, size: int) -> np.ndarray:
    return samples[start : start + size]


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def fft(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Complex transform of a power-of-two length; the inverse is divided by it."""
    n = len(x)
    if n < 2 or n & (n - 1):
        raise ValueError(f"{n} is not a power of two")
    return np.fft.ifft(x) if inverse else np.fft.fft(x)


def real_fft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(real, imaginary) of n/2 bins; the Nyquist value stands in the imaginary part of bin 0."""
    f = np.fft.rfft(x)
    re, im = f.real[..., :-1].copy(), f.imag[..., :-1].copy()
    im[..., 0] = f.real[..., -1]
    return re, im


def power_spectrum(x: np.ndarray) -> np.ndarray:
    re, im = real_fft(x)
    return re * re + im * im


def spectrogram(samples: np.ndarray, window: int = WINDOW, step: int = STEP, low: int = 0, high: int = 0) -> np.ndarray:
    """Magnitudes by (frame, bin) of Hamming-weighted frames, ``low`` and ``high`` bins cut off."""
    starts = frame_starts(len(samples), window, step)
    if not len(starts):
        return np.zeros((0, window // 2 - low - high))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), window)[starts]
    return np.sqrt(power_spectrum(frames * hamming(window)))[:, low : window // 2 - high]


def boost_contrast(s: np.ndarray) -> np.ndarray:
    return np.sqrt(s)


def zero_low(s: np.ndarray, bins: int) -> np.ndarray:
    out = s.copy()
    out[:, :bins] = 0
    return out


def normalized_01(s: np.ndarray) -> np.ndarray:
    """Over the largest value, which must not be 0."""
    if not s.size or s.max() == 0:
        raise ValueError("a silent spectrogram has no scale")
    return s / s.max()


def minus_average(s: np.ndarray) -> np.ndarray:
    """Less each bin's mean over frames, not under 0."""
    return np.maximum(0, s - s.mean(0))


def as_pdfs(s: np.ndarray) -> np.ndarray:
    t = s.sum(1, keepdims=True)
    return np.divide(s, t, out=s.astype(float).copy(), where=t != 0)


def uniform_blur(x: np.ndarray, r: int) -> np.ndarray:
    """Centred moving average; the first and last ``r`` values stay."""
    out = np.array(x, float)
    if len(x) > 2 * r:
        out[r : len(x) - r] = np.convolve(x, np.full(2 * r + 1, 1 / (2 * r + 1)), "valid")
    return out


def energy_envelope(s: np.ndarray, r: int) -> np.ndarray:
    e = uniform_blur(s.sum(1), r)
    return e / e.max() if len(e) and e.max() else e


def greyscale_image(s: np.ndarray, boost: bool = True) -> np.ndarray:
    """A spectrogram of [0, 1] as bytes by (bin, frame)."""
    v = np.sqrt(s) if boost else s
    return (v.astype(np.float32) * np.float32(255)).astype(np.uint8).T


def whitening_filter(img: np.ndarray) -> np.ndarray:
    """Each row over the root of its energy in the quietest fifth of the columns, cut at 1."""
    unit = img.astype(np.float32) / np.float32(255)
    energy = (unit * unit).mean(0)
    quiet = np.argsort(energy, kind="stable")[: int(np.ceil(img.shape[1] * QUIET_SHARE - 1e-9))]
    noise = (unit[:, quiet] ** 2).sum(1, keepdims=True) + 1e-11
    return (np.minimum(unit / np.sqrt(noise), 1) * np.float32(255)).astype(np.uint8)


def lin_to_mel(f):
    return 2595.0 * np.log10(1 + np.asarray(f, float) / 700)


def mel_to_lin(m):
    return 700.0 * (10 ** (np.asarray(m, float) / 2595.0) - 1)


def filter_bank(bins: int, sample_rate: float, low: float, high: float, filters: int = FILTERS) -> np.ndarray:
    """Mel triangles by (filter, bin), each bin's weight summed over it in hundredths."""
    edge = lambda i: bins / sample_rate * mel_to_lin(lin_to_mel(low) + i * (lin_to_mel(high) - lin_to_mel(low)) / filters)
    at = np.arange(bins)[:, None] + np.arange(100) * 0.01
    out = np.zeros((filters, bins))
    for i in range(filters):
        a, b, c = edge(i - 1), edge(i), edge(i + 1)
        rise, fall = (at - a) / (b - a), (c - at) / (c - b)
        out[i] = 0.01 * np.where((at >= a) & (at <= c), np.where(at <= b, rise, fall), 0).sum(1)
    return out


def filter_bank_image(bank: np.ndarray) -> np.ndarray:
    """A picture of the filters, a column to each: weights as brightness."""
    return (np.clip(bank.T, 0, 1).astype(np.float32) * np.float32(255)).astype(np.uint8)


def dct(x: np.ndarray) -> np.ndarray:
    m = x.shape[-1]
    j, i = np.arange(1, m + 1)[:, None], np.arange(1, m + 1)[None]
    return x @ np.cos(j * (i - 0.5) * np.pi / m).T


def mfccs(power: np.ndarray, bank: np.ndarray, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """By (frame, coefficient). The last bin that the last filter weighs isn't counted in."""
    last = np.nonzero(bank[-1] > 0)[0]
    end = int(last[-1]) if len(last) else 0
    return dct(np.log10(np.maximum(power[:, :end] @ bank[:, :end].T, 0.001)))[:, :coefficients]
