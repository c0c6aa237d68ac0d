"""Signal kernels in numpy, from the textbook definitions. Each takes the whole series of one recording."""

from __future__ import annotations

import numpy as np


def fill_gaps(x: np.ndarray) -> np.ndarray | None:
    """Values that aren't finite, interpolated over the index; None if all are."""
    good = np.isfinite(x)
    if not good.any():
        return None
    at = np.arange(len(x))
    return np.where(good, x, np.interp(at, at[good], x[good]))


def detrend(x: np.ndarray) -> np.ndarray:
    """x less its least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x / max(t @ t, 1e-300))


def _design(order: int, edges: tuple[float, ...], rate: float, kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital `low`, `high` or `band` pass with the given edges in Hz, by the bilinear transform
    with pre-warped edges."""
    poles = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order))
    warped = [2 * rate * np.tan(np.pi * f / rate) for f in edges]
    if kind == "band":
        half, centre = poles * (warped[1] - warped[0]) / 2, np.sqrt(warped[0] * warped[1])
        root = np.sqrt(half**2 - centre**2 + 0j)
        analog, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order), (warped[1] - warped[0]) ** order
    elif kind == "low":
        analog, zeros, gain = poles * warped[0], np.empty(0), warped[0] ** order
    else:
        analog, zeros, gain = warped[0] / poles, np.zeros(order), 1.0
    twice = 2 * rate
    gain = gain * (np.prod(twice - zeros) / np.prod(twice - analog)).real
    digital = np.concatenate(((twice + zeros) / (twice - zeros), -np.ones(len(analog) - len(zeros))))
    return digital, (twice + analog) / (twice - analog), float(gain)


def butterworth(order: int, edges: tuple[float, ...], rate: float, kind: str = "band") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of such a filter."""
    zeros, poles, gain = _design(order, edges, rate, kind)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def butterworth_sections(order: int, edges: tuple[float, ...], rate: float, kind: str = "band") -> tuple[tuple[float, ...], ...]:
    """The same filter as a chain of sections (b0, b1, b2, a1, a2) of two poles, or one: their states don't cancel each other,
    so powers of their transitions stay exact."""
    zeros, poles, gain = _design(order, edges, rate, kind)
    upper, real = poles[poles.imag > 1e-9], np.sort(poles[np.abs(poles.imag) <= 1e-9].real)
    pairs = [[p, p.conjugate()] for p in upper] + [real[i : i + 2].tolist() for i in range(0, len(real), 2)]
    # a zero from either end for each pair of a band pass
    left = sorted(zeros.real.tolist())
    out = []
    for pair in pairs:
        own = [left.pop(-1 if i % 2 == 0 else 0) for i in range(len(pair))]
        top, bottom = np.real(np.poly(own)), np.real(np.poly(pair))
        out.append((*(gain * np.pad(top, (0, 3 - len(top)))), *np.pad(bottom, (0, 3 - len(bottom)))[1:]))
        gain = 1.0
    return tuple(tuple(map(float, x)) for x in out)


def filter_once(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed, from a given state."""
    z, out = state.tolist() + [0.0], []
    b, a = b.tolist(), a.tolist()
    steps = range(len(z) - 1)
    for v in x.tolist():
        y = b[0] * v + z[0]
        for i in steps:
            z[i] = z[i + 1] + b[i + 1] * v - a[i + 1] * y
        out.append(y)
    return np.array(out)


def _chained(sections: tuple[tuple[float, ...], ...], x: np.ndarray) -> np.ndarray:
    """Section after section, each started in the steady state of its first input."""
    for b0, b1, b2, a1, a2 in sections:
        level = x[0] * (b0 + b1 + b2) / (1 + a1 + a2)
        second = b2 * x[0] - a2 * level
        x = filter_once(np.array([b0, b1, b2]), np.array([1.0, a1, a2]), x, np.array([b1 * x[0] - a1 * level + second, second]))
    return x


def zero_phase(sections: tuple[tuple[float, ...], ...], x: np.ndarray) -> np.ndarray:
    """Filtered forwards and backwards, ends continued by odd reflection, started in the steady state."""
    pad = 3 * (1 + sum(2 if s[4] else 1 for s in sections))
    if len(x) <= pad:
        raise ValueError("too short to filter")
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return _chained(sections, _chained(sections, wide)[::-1])[::-1][pad:-pad]


def peaks(x: np.ndarray, distance: float, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of maxima (the middle of a plateau), thinned by distance from the highest down, then by
    prominence."""
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    ends = np.append(starts[1:], len(x)) - 1
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    found = (starts[top] + ends[top]) // 2
    found = found[thinned(found, x[found], int(np.ceil(distance)))]
    rise = _prominences(x, found)
    strong = rise >= prominence
    return found[strong], rise[strong]


def thinned(places: np.ndarray, heights: np.ndarray, gap: int) -> np.ndarray:
    """Which places stay if, from the highest down (of equal ones the last first), each drops those nearer than gap. Each
    place is dropped once, and walks end at the first one that is far, so steps are as many as places and their neighbours."""
    keep, at = np.ones(len(places), bool), places.tolist()
    for i in np.argsort(heights, kind="stable")[::-1].tolist():
        if keep[i]:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(at) and abs(at[j] - at[i]) < gap:
                    keep[j] = False
                    j += step
    return keep


def _prominences(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Heights above the higher of the lowest points on either side, up to a higher sample."""
    if not len(places):
        return np.empty(0)
    left = _lowest_before_higher(x)
    right = _lowest_before_higher(x[::-1])[::-1]
    return x[places] - np.maximum(left[places], right[places])


def _lowest_before_higher(x: np.ndarray) -> np.ndarray:
    """Of each sample, the lowest one from it back to, not with, the last higher one: a stack of falling heights, each
    with the lowest point since the one below it."""
    heights: list[float] = []
    lows: list[float] = []
    out = []
    for v in x.tolist():
        low = v
        while heights and heights[-1] <= v:
            heights.pop()
            low = min(low, lows.pop())
        heights.append(v)
        lows.append(low)
        out.append(low)
    return np.array(out)


def welch(x: np.ndarray, rate: float, segment: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density: periodic Hann windows half over each other, each less its mean."""
    segment = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    hop = segment - segment // 2
    parts = np.lib.stride_tricks.sliding_window_view(x, segment)[::hop]
    parts = (parts - parts.mean(axis=1, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(parts, size, axis=1)) ** 2).mean(axis=0) / (rate * (window @ window))
    power[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def savitzky_golay(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomials over centred windows; near the ends that of the first or last full window."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(basis)
    out = np.convolve(x, fit[0][::-1], "same")
    out[:half] = (basis @ (fit @ x[:window]))[:half]
    out[len(x) - half :] = (basis @ (fit @ x[-window:]))[half + 1 :]
    return out


def odd_window(samples: float, n: int, least: int = 3) -> int:
    """An odd window near so many samples, within the series."""
    size = max(least, int(round(samples)))
    size += 1 - size % 2
    return min(size, n if n % 2 else n - 1)
