"""Arithmetic of divisors and sampling plans: plain Python on the driver."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def factorize(n: int) -> dict[int, int]:
    """Prime exponents of ``n``."""
    if n < 1:
        raise ValueError(f"only positive integers factorize, not {n}")
    out: dict[int, int] = {}
    p = 2
    while p * p <= n:
        while n % p == 0:
            out[p] = out.get(p, 0) + 1
            n //= p
        p += 1 if p == 2 else 2
    if n > 1:
        out[n] = 1
    return out


def vec_add(a: Mapping[int, int], b: Mapping[int, int]) -> dict[int, int]:
    return {p: a.get(p, 0) + b.get(p, 0) for p in sorted({*a, *b})}


def to_int(coord: Mapping[int, int]) -> int:
    return math.prod(p**e for p, e in coord.items())


def divisors(n: int) -> list[int]:
    out = [1]
    for p, e in factorize(n).items():
        out = [d * p**i for d in out for i in range(e + 1)]
    return sorted(out)


def lattice_members(horizon: int, cbin: int) -> list[int]:
    """Divisors of the horizon that are multiples of the computational bin."""
    return [d for d in divisors(horizon) if d % cbin == 0]


def smallest_divisor_gte(horizon: int, grain: int) -> int:
    return next(d for d in divisors(horizon) if d >= grain)


def parse_duration(x: int | str) -> int:
    """Seconds of ``90``, ``"90s"``, ``"5m"``, ``"2h"``, ``"1d"`` or ``"1w"``."""
    if isinstance(x, int):
        return x
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])?\s*", x)
    if not m:
        raise ValueError(f"no duration: {x!r}")
    return int(m[1]) * _UNITS[m[2] or "s"]


def horizon_for(windows: Iterable[int], grain: int | None = None) -> int:
    return reduce(math.lcm, windows)


def suggest_cbin(grain: int, windows: Sequence[int]) -> int:
    """The greatest common divisor of the windows; a warning if it is finer than the grain."""
    out = reduce(math.gcd, windows)
    if out < grain:
        warnings.warn(f"windows share no divisor of at least {grain}; their common divisor is {out}", stacklevel=2)
    return out


@dataclass(frozen=True)
class SamplingPlan:
    """Windows that divide a horizon and are multiples of one bin, with a hop for each.

    ``windows`` is "dense" (every lattice member), a list, or None for dense; a hop defaults to the bin.
    """

    horizon: int
    grain: int
    windows: tuple[int, ...] | Sequence[int] | str | None = "dense"
    hops: tuple[int, ...] | Sequence[int] | Mapping[int, int] | None = None
    cbin: int | None = None
    n_values: tuple[int, ...] = field(init=False, compare=False)
    coordinates: tuple[dict[int, int], ...] = field(init=False, compare=False, hash=False)

    def __post_init__(self):
        h, g = self.horizon, self.grain
        if h < 1 or g < 1:
            raise ValueError("horizon and grain must be positive")
        if g > h:
            raise ValueError(f"grain {g} exceeds horizon {h}")
        dense = self.windows is None or isinstance(self.windows, str)
        if isinstance(self.windows, str) and self.windows != "dense":
            raise ValueError(f"unknown window preset {self.windows!r}")
        if not dense and not self.windows:
            raise ValueError("no windows")
        cbin = self.cbin or (smallest_divisor_gte(h, g) if dense else suggest_cbin(g, self.windows))
        if h % cbin:
            raise ValueError(f"bin {cbin} does not divide horizon {h}")
        windows = lattice_members(h, cbin) if dense else sorted(set(self.windows))
        for w in windows:
            if w < 1 or h % w or w % cbin:
                raise ValueError(f"window {w} is not a divisor of {h} and multiple of {cbin}")
        hops = self.hops
        if hops is None:
            hops = [cbin] * len(windows)
        elif isinstance(hops, Mapping):
            hops = [hops.get(w, cbin) for w in windows]
        if len(hops) != len(windows):
            raise ValueError("as many hops as windows are needed")
        for w, p in zip(windows, hops, strict=True):
            if p < 1 or p % cbin or w % p:
                raise ValueError(f"hop {p} of window {w} must be a multiple of {cbin} that divides it")
        put = lambda k, v: object.__setattr__(self, k, v)
        put("cbin", cbin)
        put("windows", tuple(windows))
        put("hops", tuple(hops))
        put("n_values", tuple(w // p for w, p in zip(windows, hops, strict=True)))
        put("coordinates", tuple(factorize(w // cbin) for w in windows))

    def __eq__(self, other):
        return isinstance(other, SamplingPlan) and (self.horizon, self.cbin, self.windows, self.hops) == (other.horizon, other.cbin, other.windows, other.hops)

    def __hash__(self):
        return hash((self.horizon, self.cbin, self.windows, self.hops))

    @classmethod
    def from_windows(cls, windows: Sequence[int], cbin: int, hops=None) -> SamplingPlan:
        """Exactly these windows and this bin; the horizon is their least common multiple."""
        if not windows:
            raise ValueError("no windows")
        for w in windows:
            if w < cbin or w % cbin:
                raise ValueError(f"window {w} is not a multiple of {cbin}")
        return cls(reduce(math.lcm, [*windows, cbin]), cbin, tuple(windows), hops, cbin)

    @property
    def prime_basis(self) -> dict[int, int]:
        return factorize(self.horizon // self.cbin)

    @property
    def scales(self) -> tuple[int, ...]:
        return tuple(w // self.cbin for w in self.windows)

    @property
    def hop_bins(self) -> tuple[int, ...]:
        return tuple(p // self.cbin for p in self.hops)

    def valid_windows(self) -> list[int]:
        return lattice_members(self.horizon, self.cbin)

    def cover(self, window: int) -> int | None:
        """The smallest selected window that ``window`` properly divides."""
        return next((w for w in self.windows if w > window and w % window == 0), None)

    def cover_edges(self) -> list[tuple[int, int]]:
        """Edges of the Hasse diagram of divisibility among the windows."""
        up = lambda a, b: a < b and b % a == 0
        return [(a, b) for a in self.windows for b in self.windows if up(a, b) and not any(up(a, c) and up(c, b) for c in self.windows)]

    def describe(self) -> str:
        basis = " * ".join(f"{p}^{e}" for p, e in self.prime_basis.items()) or "1"
        rows = [f"{w:>10} {p:>8} {n:>6}  {c or '{}'}" for w, p, n, c in zip(self.windows, self.hops, self.n_values, self.coordinates, strict=True)]
        return "\n".join([f"horizon {self.horizon}, bin {self.cbin}, grain {self.grain}, basis {basis}", f"{'window':>10} {'hop':>8} {'n':>6}  coordinate", *rows])

    def show_lattice(self) -> str:
        return "\n".join(f"{a} -> {b} (x{b // a})" for a, b in self.cover_edges())

    def dataframe(self, spark):
        """scale_idx, window, hop, w_bins, h_bins, coord: one small row for each window."""
        rows = [(i, w, p, w // self.cbin, p // self.cbin, c) for i, (w, p, c) in enumerate(zip(self.windows, self.hops, self.coordinates, strict=True))]
        return spark.createDataFrame(rows, "scale_idx int, window long, hop long, w_bins long, h_bins long, coord map<int,int>")


@dataclass(frozen=True)
class FlipFlop:
    """The self-similar sequence of valuations: each flip by p repeats it p times and raises the last term."""

    prime: int
    terms: tuple[int, ...] = (0,)

    def flip(self) -> FlipFlop:
        out = self.terms * self.prime
        return FlipFlop(self.prime, (*out[:-1], out[-1] + 1))

    @property
    def coverage(self) -> int:
        return len(self.terms)

    @property
    def depth(self) -> int:
        return round(math.log(len(self.terms), self.prime))

    def flips_needed(self, n: int) -> int:
        k, size = 0, self.coverage
        while size < n:
            size *= self.prime
            k += 1
        return k

    def expand_to(self, n: int) -> FlipFlop:
        out = self
        for _ in range(self.flips_needed(n)):
            out = out.flip()
        return out

    def valuation_at(self, n: int) -> int:
        return valuation(n, self.prime)


def valuation(n: int, p: int) -> int:
    if n < 1:
        raise ValueError("valuations are of positive integers")
    v = 0
    while n % p == 0:
        n //= p
        v += 1
    return v


# --- presets ------------------------------------------------------------------------------------


def preset(horizon: int, grain: int, anchors: Iterable[int] = (), fine: int = 0) -> SamplingPlan:
    """Lattice members that are anchors, at most ``fine``, or the horizon; all if none is."""
    cbin = smallest_divisor_gte(horizon, grain)
    members = lattice_members(horizon, cbin)
    keep = [w for w in members if w in set(anchors) or w <= fine or w == horizon]
    return SamplingPlan(horizon, grain, keep or members, cbin=cbin)


def timeseries_plan(horizon: int = 360, grain: int = 1) -> SamplingPlan:
    """Days of a generic series: every member up to 20, then months, quarters and half years."""
    return preset(horizon, grain, (1, 5, 10, 20, 60, 180), 20)


def equities_plan(horizon: int = 360, grain: int = 1, daily: bool = False) -> SamplingPlan:
    """Minutes of a session, or trading days of a year."""
    return preset(horizon, grain, (1, 5, 10, 20, 60, 180), 20) if daily else preset(horizon, grain, (1, 5, 15, 30, 60), 60)


def eeg_plan(horizon: int = 921_600, grain: int = 256) -> SamplingPlan:
    """Samples of an hour at 256 a second, in bins of one second: every member up to a minute, and epochs."""
    return preset(horizon, grain, [256 * s for s in (1, 4, 16, 30, 60, 300)], 256 * 60)


def eeg_plan_for_rate(sfreq: int, seconds: int = 3600) -> SamplingPlan:
    return eeg_plan(sfreq * seconds, sfreq)


def geomagnetic_plan(horizon: int = 86_400, grain: int = 60) -> SamplingPlan:
    """Seconds of a day: every member up to two hours, and the day."""
    return preset(horizon, grain, (60, 3600, 86_400), 7_200)


def geomagnetic_year_plan(horizon: int = 360 * 86_400, grain: int = 86_400) -> SamplingPlan:
    """Days of a year: every member up to a month, quarters and the solar rotation."""
    return preset(horizon, grain, [86_400 * d for d in (1, 7, 27, 30, 90)], 30 * 86_400)


def default_plan(span: int | None = None, horizon: int = 86_400, grain: int = 60) -> SamplingPlan:
    """Whole days that hold the span, with windows of common lengths and all up to an hour."""
    if span and span > 0:
        horizon = max(1, span // 86_400 + 1) * 86_400
    anchors = [60, 300, 900, 1800, 3600, 7200, 14_400, 43_200, 86_400, *([604_800] if horizon > 86_400 else [])]
    return preset(horizon, grain, anchors, 3600)


def derive_plan(grain: int | None, windows: Sequence[int], horizon: int | None, span: int | None = None) -> SamplingPlan:
    """One window is the horizon of a dense lattice, several are explicit, none: the horizon, else the span, else 360."""
    grain = grain or 1
    if len(windows) == 1:
        return SamplingPlan(horizon or windows[0], grain)
    if windows:
        return SamplingPlan(horizon or horizon_for(windows), grain, tuple(sorted(set(windows))))
    return SamplingPlan(horizon or span or 360, grain)
