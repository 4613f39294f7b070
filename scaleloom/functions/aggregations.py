"""Registry of aggregations: each as an aggregate over rows and as a function of an ordered array.

A registered Python function gets a non-empty float array and returns a float; it runs on Arrow
batches. The built-in ones are Column expressions, but for the dominant frequency.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

Array = Callable[[Column], Column]
EWMA_ALPHA = 0.3


@dataclass(frozen=True)
class Aggregation:
    """``rows`` takes (value, order); without it the rows of a group are gathered in order for ``array``."""

    name: str
    array: Array
    rows: Callable[[Column, Column], Column] | None = None

    def over_rows(self, value: Column, order: Column) -> Column:
        if self.rows is not None:
            return self.rows(value, order)
        gathered = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
        return self.array(F.transform(gathered, lambda x: x["v"]))


_registry: dict[str, Aggregation] = {}


def register_aggregation(name: str, fn: Callable | None = None):
    """Registers a Python function of a float array; also as a decorator."""
    if fn is None:
        return lambda f: register_aggregation(name, f)
    _registry[name] = Aggregation(name, _from_python(fn))
    return fn


def get_aggregation(name: str) -> Aggregation:
    if name not in _registry:
        raise KeyError(f"unknown aggregation {name!r}; there are {', '.join(aggregation_names())}")
    return _registry[name]


def aggregation_names() -> list[str]:
    return sorted(_registry)


def _from_python(fn: Callable) -> Array:
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or len(a) == 0 else float(fn(np.asarray(a, float))) for a in arrays])

    def of(a: Column) -> Column:
        return F.pandas_udf(run, "double", PandasUDFType.SCALAR)(a)

    of.python = True
    return of


def is_python(name: str) -> bool:
    """Whether an aggregation is a Python function, which cannot stand inside a higher-order function."""
    return getattr(get_aggregation(name).array, "python", False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _some(body: Array) -> Array:
    return lambda a: let(a, lambda v: F.when(F.size(v) > 0, body(v)))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _mean(v: Column) -> Column:
    return _sum(v) / F.size(v)


def _var(v: Column) -> Column:
    return let(_mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))


def quantile_of_array(q: float) -> Array:
    """Linear interpolation between the neighbours in order."""

    def of(v: Column) -> Column:
        def at(s: Column) -> Column:
            pos = (F.size(s) - 1) * F.lit(float(q))
            lo = F.floor(pos).cast("int")
            hi = F.least(lo + 1, F.size(s) - 1)
            return F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (pos - lo)

        return let(F.sort_array(v), at)

    return of


def _mode(v: Column) -> Column:
    counted = F.transform(F.array_distinct(v), lambda x: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-x).alias("low")))
    return -F.array_max(counted)["low"]


def _geometric(v: Column) -> Column:
    return let(F.filter(v, lambda x: x > 0), lambda p: F.when(F.size(p) > 0, F.exp(F.aggregate(p, F.lit(0.0), lambda s, x: s + F.log(x)) / F.size(p))).otherwise(0.0))


def ewma_of_array(alpha: float) -> Array:
    return lambda v: F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.get(v, F.lit(0)), lambda s, x: alpha * x + (1 - alpha) * s)


def _spectral_energy(v: Column) -> Column:
    """One-sided energy of the Hann-weighted, centred values by Parseval's theorem instead of a transform."""

    def weighted(m: Column) -> Column:
        n = F.size(v)
        hann = lambda k: F.when(n > 1, 0.5 - 0.5 * F.cos(2 * np.pi * k / (n - 1))).otherwise(1.0)
        return F.transform(v, lambda x, k: (x - m) * hann(k))

    def energy(y: Column) -> Column:
        n = F.size(y)
        squares = F.aggregate(y, F.lit(0.0), lambda s, x: s + x * x)
        total = _sum(y)
        turned = F.aggregate(F.transform(y, lambda x, k: F.when(k % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)
        return (n * squares + total * total + F.when(n % 2 == 0, turned * turned).otherwise(0.0)) / 2 / n

    return let(let(_mean(v), weighted), energy)


def _value_entropy(v: Column) -> Column:
    """Shannon bits of the histogram of values in min(10, n) equal bins."""

    def of(bounds: Column) -> Column:
        bins = F.least(F.lit(10), F.size(v))
        place = lambda x: F.least(F.floor((x - bounds["lo"]) / (bounds["hi"] - bounds["lo"]) * bins).cast("int"), bins - 1)

        def sum_up(b: Column) -> Column:
            n = F.size(b)
            part = lambda k: let(F.size(F.filter(b, lambda y: y == k)) / n, lambda p: -p * F.log2(p))
            return _sum(F.transform(F.array_distinct(b), part))

        return F.when(bounds["hi"] > bounds["lo"], let(F.transform(v, place), sum_up)).otherwise(0.0)

    return let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), of)


def dominant_frequency(a: np.ndarray) -> float:
    """Cycles for each step of the strongest line of the spectrum without its constant; 0 for fewer than four values."""
    n = len(a)
    if n < 4:
        return 0.0
    lines = np.abs(np.fft.rfft(np.hanning(n) * (a - a.mean())))
    return float(1 + lines[1:].argmax()) / n if lines.any() else 0.0


def _add(name: str, array: Array, rows: Callable[[Column, Column], Column] | None = None) -> None:
    _registry[name] = Aggregation(name, array, rows)


_add("count", lambda a: F.size(a).cast("double"), lambda v, o: F.count(v).cast("double"))
_add("sum", _some(_sum), lambda v, o: F.sum(v))
_add("mean", _some(_mean), lambda v, o: F.avg(v))
_add("min", F.array_min, lambda v, o: F.min(v))
_add("max", F.array_max, lambda v, o: F.max(v))
_add("median", _some(quantile_of_array(0.5)), lambda v, o: F.percentile(v, F.lit(0.5)))
_add("std", _some(lambda v: F.sqrt(_var(v))), lambda v, o: F.stddev_pop(v))
_add("var", _some(_var), lambda v, o: F.var_pop(v))
_add("range", lambda a: F.array_max(a) - F.array_min(a), lambda v, o: F.max(v) - F.min(v))
_add("first", lambda a: F.get(a, F.lit(0)), lambda v, o: F.min_by(v, o))
_add("last", lambda a: F.get(a, F.size(a) - 1), lambda v, o: F.max_by(v, o))
_add("mode", _some(_mode), lambda v, o: F.mode(v, True))
for _q in (25, 75, 90, 95, 99):
    _add(f"p{_q}", _some(quantile_of_array(_q / 100)), lambda v, o, q=_q: F.percentile(v, F.lit(q / 100)))
_add("geometric_mean", _some(_geometric), lambda v, o: F.coalesce(F.exp(F.avg(F.when(v > 0, F.log(v)))), F.lit(0.0)))
_add("ewma", _some(ewma_of_array(EWMA_ALPHA)))
_add("spectral_energy", _some(_spectral_energy))
_add("entropy", _some(_value_entropy))
_add("dominant_freq", _from_python(dominant_frequency))

#: Aggregations that a surface offers for a kind of signal.
_profiles: dict[str, tuple[str, ...]] = {
    "event": ("count", "max", "ewma", "std"), "continuous": ("mean", "geometric_mean", "median", "std"),
    "ratio": ("geometric_mean", "median", "p25", "p75", "p90"), "anomaly": ("mean", "max", "p95", "p99"), "sparse": ("count", "max"),
}


def register_profile(name: str, aggregations) -> None:
    for a in aggregations:
        get_aggregation(a)
    _profiles[name] = tuple(aggregations)


def get_profile(name: str) -> tuple[str, ...]:
    if name not in _profiles:
        raise KeyError(f"unknown profile {name!r}; there are {', '.join(profile_names())}")
    return _profiles[name]


def profile_names() -> list[str]:
    return sorted(_profiles)
