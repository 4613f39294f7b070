"""Surfaces from surfaces: baselines, residuals, analytic signal, gradients, stacks, peaks.

``values`` names the columns that an operator works on; rows are (by, scale_idx, scale, window, bin).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lattice import SamplingPlan

AXES = ("scale_idx", "scale", "window", "bin")
KEPT = (*AXES, "n_events", "coverage")


def value_columns(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in KEPT and c not in by]


def per_row(df: DataFrame, by: Sequence[str], fn, columns: Sequence[str]) -> DataFrame:
    """``fn`` of a pandas frame sorted by bin, for each signal and scale; it returns {column: array}."""
    new = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns if c not in df.columns]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf.assign(**{c: np.where(np.isfinite(x), x, np.nan) for c, x in fn(pdf).items()})[new.names]

    out = df.groupBy(*by, "scale_idx").applyInPandas(run, new)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def ewma(x: np.ndarray, alpha: float, fill: bool) -> np.ndarray:
    """Exponential smoothing over the finite values; at the others NaN, or the last state with ``fill``."""
    out, state = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x):
        if v == v:
            state = v if state != state else alpha * v + (1 - alpha) * state
            out[i] = state
        elif fill:
            out[i] = state
    return out


def median_baseline(x: np.ndarray, size: int) -> np.ndarray:
    """Rank size // 2 of the sorted window from i - size // 2, edges mirrored; gaps take the row's median and stay gaps."""
    known = np.isfinite(x)
    if known.sum() < size:
        return x
    filled = np.where(known, x, np.median(x[known]))
    left = size // 2
    padded = np.pad(filled, (left, size - 1 - left), mode="symmetric")
    ranked = np.sort(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)[:, size // 2]
    return np.where(known, ranked, np.nan)


def baseline(surface: DataFrame, by: Sequence[str], method: str = "ewma", alpha: float = 0.1, window: int = 10, values: Sequence[str] | None = None) -> DataFrame:
    """The columns replaced by their baseline along time."""
    values = list(values or value_columns(surface, by))
    if method == "rolling_mean":
        w = Window.partitionBy(*by, "scale_idx").orderBy("bin").rowsBetween(-(window - 1), 0)
        return surface.withColumns({c: F.avg(c).over(w) for c in values})
    if method == "ewma":
        return per_row(surface, by, lambda p: {c: ewma(p[c].to_numpy(float), alpha, False) for c in values}, values)
    if method == "median":
        return per_row(surface, by, lambda p: {c: median_baseline(p[c].to_numpy(float), window) for c in values}, values)
    raise ValueError(f"unknown baseline {method!r}; use ewma, median or rolling_mean")


def residual(measured: DataFrame, base: DataFrame, by: Sequence[str], mode: str = "difference", values: Sequence[str] | None = None) -> DataFrame:
    """measured against base, joined by their axes: difference, ratio (null at 0) or z by the spread of the base's row."""
    values = list(values or value_columns(measured, by))
    keys = [*by, *AXES]
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in values])
    if mode == "z":
        row = Window.partitionBy(*by, "scale_idx")
        b = b.withColumns({f"_s_{c}": F.stddev_pop(f"_b_{c}").over(row) for c in values})
    df = measured.join(b, keys)
    for c in values:
        m, r = F.col(c), F.col(f"_b_{c}")
        if mode == "difference":
            out = m - r
        elif mode == "ratio":
            out = F.when(r != 0, m / r)
        elif mode == "z":
            out = F.when(F.col(f"_s_{c}") > 0, (m - r) / F.col(f"_s_{c}"))
        else:
            raise ValueError(f"unknown residual {mode!r}; use difference, ratio or z")
        df = df.withColumn(c, out)
    return df.select(*measured.columns)


def analytic(x: np.ndarray) -> dict[str, np.ndarray]:
    """Amplitude, phase and instantaneous frequency (radians a bin) of the analytic signal; NaN below four finite values."""
    n, known = len(x), np.isfinite(x)
    if known.sum() < 4:
        return {k: np.full(n, np.nan) for k in ("amplitude", "phase", "inst_freq")}
    spectrum = np.fft.fft(np.where(known, x, x[known].mean()))
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    z = np.fft.ifft(spectrum * gain)
    angle = np.angle(z)
    return {"amplitude": np.abs(z), "phase": angle, "inst_freq": np.gradient(np.unwrap(angle))}


def hilbert(surface: DataFrame, by: Sequence[str], value: str | None = None) -> DataFrame:
    """Adds amplitude, phase and inst_freq of the mean (or the first) column along each row."""
    names = value_columns(surface, by)
    value = value or ("mean" if "mean" in names else names[0])
    return per_row(surface, by, lambda p: analytic(p[value].to_numpy(float)), ["amplitude", "phase", "inst_freq"])


def gradient(surface: DataFrame, plan: SamplingPlan, by: Sequence[str], value: str | None = None) -> DataFrame:
    """grad_t = f[t + 1] - f[t]; grad_p<p> = f at scale / p minus f, for each prime of the plan; their magnitude."""
    names = value_columns(surface, by)
    value = value or ("mean" if "mean" in names else names[0])
    after = Window.partitionBy(*by, "scale_idx").orderBy("bin")
    out = surface.select(*[c for c in surface.columns if c not in names], F.col(value).alias("_f"), (F.lead(value).over(after) - F.col(value)).alias("grad_t"))
    primes = sorted(plan.prime_basis)
    # all scales of a bin meet in one group of as many rows as there are windows: a map instead of a join for each prime
    at_bin = Window.partitionBy(*by, "bin")
    out = out.withColumn("_at", F.map_from_entries(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("scale", "_f"))).over(at_bin)))
    for p in primes:
        finer = F.try_element_at("_at", (F.col("scale") / p).cast("long"))
        out = out.withColumn(f"grad_p{p}", F.when(F.col("scale") % p == 0, finer - F.col("_f")))
    squares = sum((F.coalesce(F.col(f"grad_p{p}") * F.col(f"grad_p{p}"), F.lit(0.0)) for p in primes), F.lit(0.0))
    return out.withColumn("grad_scale_mag", F.sqrt(squares)).drop("_f", "_at")


def stack(surfaces: Sequence[tuple[str, DataFrame]], by: Sequence[str]) -> DataFrame:
    """The columns of named surfaces side by side as <name>_<column>, joined by their axes."""
    if not surfaces:
        raise ValueError("nothing to stack")
    names = [f"{n}_{c}" for n, s in surfaces for c in value_columns(s, by)]
    if len({*names}) < len(names):
        raise ValueError(f"stacked columns would clash: {sorted({n for n in names if names.count(n) > 1})}")
    keys = [*by, *AXES]
    out = None
    for name, s in surfaces:
        cols = value_columns(s, by)
        part = s.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in cols])
        if out is None:
            part = s.select(*keys, *[c for c in ("n_events", "coverage") if c in s.columns], *[F.col(c).alias(f"{name}_{c}") for c in cols])
        out = part if out is None else out.join(part, keys)
    return out


def zscores(surface: DataFrame, by: Sequence[str], value: str = "mean", robust: bool = False) -> DataFrame:
    """Adds z along each scale row: from mean and spread, or from the median and 1.4826 MAD."""
    row = Window.partitionBy(*by, "scale_idx")
    v = F.col(value)
    if robust:
        df = surface.withColumn("_m", F.percentile(v, F.lit(0.5)).over(row))
        df = df.withColumn("_s", 1.4826 * F.percentile(F.abs(v - F.col("_m")), F.lit(0.5)).over(row))
    else:
        df = surface.withColumns({"_m": F.avg(v).over(row), "_s": F.stddev_pop(v).over(row)})
    return df.withColumn("z", F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def peaks(surface: DataFrame, by: Sequence[str], value: str = "mean", top: int = 6) -> DataFrame:
    """by, window, peak_z (largest abs z), peak_bin, rank: the scales of each signal with the highest peaks."""
    z = zscores(surface, by, value).where("z IS NOT NULL")
    best = z.groupBy(*by, "window").agg(F.max(F.struct(F.abs("z").alias("z"), (-F.col("bin")).alias("b"))).alias("p"))
    best = best.select(*by, "window", F.col("p.z").alias("peak_z"), (-F.col("p.b")).alias("peak_bin"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("peak_z"), "window"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)
