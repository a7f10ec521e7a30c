"""Filter kernels and calibration on small arrays, with numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def kaiser_lowpass(taps: int = 60, factor: int = 5, beta: float = 5.0) -> np.ndarray:
    """A lowpass for decimation by a factor, with unit gain at zero frequency."""
    if taps % factor:
        raise ValueError("the number of taps must be a multiple of the factor")
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(n / factor) * np.kaiser(taps, beta)
    return h / h.sum()


#: Slope and offset of the equivalent rectangular bandwidth over frequency, in hertz.
ERB_SLOPE, ERB_OFFSET = 2.02 * 0.35 * 0.1039 * 0.75, 2.02 * 0.35 * 24.7


def erb_centres(low: float, high: float, bands: int) -> np.ndarray:
    """Frequencies at equal steps of ln(slope * f + offset)."""
    ends = np.log(ERB_SLOPE * np.array([low, high]) + ERB_OFFSET)
    return (np.exp(np.linspace(*ends, bands)) - ERB_OFFSET) / ERB_SLOPE


def gammachirp_bank(rate: float = 8000.0, low: float = 60.0, high: float = 4000.0, bands: int = 100, order: int = 4, chirp: float = -3.7, seconds: float = 0.1, every: int = 5, erb: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(centre frequencies, ascending; complex kernels [bands x taps]). Centres have equal steps
    on a logarithmic scale, or on the ERB scale. A kernel ends a sample before the first whole
    number of frames, of `every` samples, that is longer than `seconds`: 804 taps by default."""
    f = erb_centres(low, high, bands) if erb else np.geomspace(low, high, bands)
    t = np.arange(1, (int(rate * seconds / every) + 1) * every) / rate
    width = ERB_SLOPE * f + ERB_OFFSET
    shape = t[None] ** (order - 1) * np.exp(-2 * np.pi * width[:, None] * t[None])
    wave = np.exp(1j * (2 * np.pi * f[:, None] * t[None] + chirp * np.log(t[None])))
    gain = np.sqrt((4 * np.pi * width) ** (2 * order - 1) / math.factorial(2 * order - 2)) * f / rate
    return f, shape * wave * gain[:, None]


def valid_filter(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Outputs of a causal filter from the first that has a whole past, by blocks of FFTs.
    h may be one kernel or [bands x taps]."""
    h = np.atleast_2d(h)
    taps = h.shape[1]
    if len(x) < taps:
        return np.empty((len(h), 0), np.result_type(x, h))
    size = 1 << max(8, (4 * taps - 1).bit_length())
    step, spectrum = size - taps + 1, np.fft.fft(h, size, axis=1)
    out = np.empty((len(h), len(x) - taps + 1), complex)
    for at in range(0, out.shape[1], step):
        y = np.fft.ifft(np.fft.fft(x[at : at + size], size) * spectrum, axis=1)[:, taps - 1 :]
        n = min(step, out.shape[1] - at)
        out[:, at : at + n] = y[:, :n]
    return out if np.iscomplexobj(h) else out.real


THRESHOLD = 0.2


@dataclass(frozen=True)
class Crossing:
    """Where a ray from a scale's origin falls below the threshold: offsets of the last point
    above and of the first below, and where between them."""

    found: bool
    super_scale: int = 0
    super_frame: int = 0
    sub_scale: int = 0
    sub_frame: int = 0
    delta: float = 0.0
    above: float = 0.0
    below: float = 0.0


class Correlator:
    """Lagged correlations of a noise plane [scales x frames] with global moments."""

    def __init__(self, plane: np.ndarray):
        self.n, self.frames = plane.shape
        self.centred = plane - plane.mean(axis=1, keepdims=True)
        var = plane.var(axis=1, ddof=1)
        var[var <= self.frames * np.finfo(float).eps] = 0.0
        self.sigma = np.sqrt(var)

    def at(self, delay: int, scale: int, other: int) -> float | None:
        a, b = self.centred[scale], self.centred[other]
        a, b = (a[: self.frames - delay], b[delay:]) if delay >= 0 else (a[-delay:], b[: self.frames + delay])
        if len(a) < 2 or not self.sigma[scale] or not self.sigma[other]:
            return None
        return float(a @ b / ((len(a) - 1) * self.sigma[scale] * self.sigma[other]))

    def cube(self, most: int) -> np.ndarray:
        """[scale x scale x (2 most + 1)]; lags that have no value are 0."""
        return np.array([[[self.at(d, s, x) or 0.0 for d in range(-most, most + 1)] for x in range(self.n)] for s in range(self.n)])

    def walk(self, scale: int, points) -> Crossing:
        """Follow points (scale and frame offsets) until the correlation isn't above the
        threshold. The position moves on before a point is judged, so the points reported lie
        one step beyond the pair that gives delta."""
        before = held = 1.0
        last = here = (0, 0)
        for ds, df in points:
            last, here = here, (ds, df)
            inside = 0 <= scale + ds < self.n
            if held <= THRESHOLD or not inside:
                break
            value = self.at(df, scale, scale + ds)
            if value is None:
                return Crossing(False)
            before, held = held, value
        else:
            return Crossing(False)
        if not (held < THRESHOLD and 0 <= scale + here[0] < self.n):
            return Crossing(False)
        return Crossing(True, *last, *here, (THRESHOLD - before) / (held - before), before, held)

    def ray(self, scale: int, ds: int, df: int) -> Crossing:
        return self.walk(scale, ((k * ds, k * df) for k in range(1, self.n + self.frames)))

    def slope(self, scale: int, ds: float, df: float) -> Crossing:
        """Along a real direction: the longer axis by ones, the other rounded down and up."""
        if not ds and not df:
            return Crossing(False)
        m = max(abs(ds), abs(df))
        ways = []
        for to in (math.floor, math.ceil):
            ways.append(self.walk(scale, ((int(to(k * ds / m)) if abs(ds) < m else int(round(k * ds / m)), int(to(k * df / m)) if abs(df) < m else int(round(k * df / m))) for k in range(1, self.n + self.frames))))
        return merge(*ways)


def merge(a: Crossing, b: Crossing) -> Crossing:
    """The inner point above and the outer one below of two crossings."""
    if not a.found or not b.found:
        return a if a.found else b
    up = a if a.above <= b.above else b
    down = a if a.below >= b.below else b
    return Crossing(True, up.super_scale, up.super_frame, down.sub_scale, down.sub_frame, (THRESHOLD - up.above) / (down.below - up.above) if down.below != up.above else 0.0, up.above, down.below)


TEXTURES = ("f", "s", "u", "d")


def calibrate(plane: np.ndarray) -> dict[str, dict[str, list[tuple[Crossing, Crossing]]]]:
    """texture -> axis -> a pair of crossings for each scale: frames, scales, up and down."""
    c = Correlator(plane)
    f = [(c.ray(s, 0, 1), c.ray(s, 0, -1)) for s in range(c.n)]
    s_ = [(c.ray(s, 1, 0), c.ray(s, -1, 0)) for s in range(c.n)]

    def half(x: Crossing, name: str) -> float:
        return (getattr(x, f"sub_{name}") + getattr(x, f"super_{name}")) / 2 if x.found else 0.0

    u, d = [], []
    for s in range(c.n):
        ahead, back = (half(x, "frame") for x in f[s])
        up, down = (half(x, "scale") for x in s_[s])
        u.append((c.slope(s, up, ahead), c.slope(s, down, back)) if all((ahead, back, up, down)) else (Crossing(False), Crossing(False)))
        d.append((c.slope(s, up, back), c.slope(s, down, ahead)) if all((ahead, back, up, down)) else (Crossing(False), Crossing(False)))
    return {t: {"principal": p, "orthogonal": o} for t, p, o in (("f", f, s_), ("s", s_, f), ("u", u, d), ("d", d, u))}


@dataclass(frozen=True)
class Margin:
    """Frames and scales at each end for which there is no value."""

    first_frame: int
    last_frame: int
    first_scale: int
    last_scale: int


def margins(reach: dict[int, tuple[int, int, int, int]], scales: int, before: Margin = Margin(0, 0, 0, 0)) -> Margin | None:
    """From each usable scale's (scales back, scales ahead, frames back, frames ahead), on top
    of the margins of what it reads; None if no scale is left."""
    low = next((before.first_scale + r[0] for s, r in sorted(reach.items()) if s >= before.first_scale + r[0]), None)
    high = next((before.last_scale + r[1] for s, r in sorted(reach.items(), reverse=True) if s + before.last_scale + r[1] <= scales - 1), None)
    if low is None or high is None or low > scales - 1 - high:
        return None
    inside = [r for s, r in reach.items() if low <= s <= scales - 1 - high]
    if not inside:
        return None
    return Margin(before.first_frame + max(r[2] for r in inside), before.last_frame + max(r[3] for r in inside), low, high)


def area_reach(areas: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, int, int]]:
    """The same of context areas (scale, run scale, first frame, last frame)."""
    out: dict[int, tuple[int, int, int, int]] = {}
    for s, run, a, z in areas:
        r = out.get(s, (0, 0, 0, 0))
        out[s] = (max(r[0], s - run), max(r[1], run - s), max(r[2], -a), max(r[3], z))
    return out


def pattern_reach(pairs: list[tuple[Crossing, Crossing]]) -> dict[int, tuple[int, int, int, int]]:
    out = {}
    for s, (a, b) in enumerate(pairs):
        if a.found and b.found:
            ds, df = sorted((a.sub_scale, b.sub_scale)), sorted((a.sub_frame, b.sub_frame))
            out[s] = (max(0, -ds[0]), max(0, ds[1]), max(0, -df[0]), max(0, df[1]))
    return out


def _away(x: float) -> int:
    return int(math.copysign(math.ceil(abs(x)), x)) if x else 0


def context_area(scale: int, principal: tuple[Crossing, Crossing], orthogonal: tuple[Crossing, Crossing], scales: int, along: float = 0.7, across: float = 2.0) -> list[tuple[int, int, int]]:
    """(run scale, first frame, last frame) of the parallelogram that the scaled crossings span
    around a scale; empty if one is missing or it leaves the plane."""
    if not all(x.found for x in (*principal, *orthogonal)):
        return []
    vectors = [(_away(k * x.sub_scale), _away(k * x.sub_frame)) for k, pair in ((along, principal), (across, orthogonal)) for x in pair]
    corners = sorted(vectors, key=lambda v: math.atan2(v[1], v[0]))
    low, high = {}, {}
    (p1, p2), (o1, o2) = vectors[:2], vectors[2:]
    points = [(a[0] + b[0], a[1] + b[1]) for a in (p1, p2) for b in (o1, o2)]
    points.sort(key=lambda v: math.atan2(v[1], v[0]))
    for (s0, f0), (s1, f1) in zip(points, [*points[1:], points[0]]):
        for s in range(min(s0, s1), max(s0, s1) + 1):
            ends = (min(f0, f1), max(f0, f1)) if s0 == s1 else (f0 + (s - s0) * (f1 - f0) / (s1 - s0),) * 2
            low[s] = min(low.get(s, math.inf), math.floor(ends[0]))
            high[s] = max(high.get(s, -math.inf), math.ceil(ends[1]))
    if not corners or any(not 0 <= scale + s < scales for s in low):
        return []
    return [(scale + s, int(low[s]), int(high[s])) for s in sorted(low) if low[s] != high[s]]
