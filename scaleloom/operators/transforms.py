"""Transforms of binned rows (by, bin, value, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    v = F.col("value")
    if low is not None:
        v = F.when(v < low, low).otherwise(v)
    if high is not None:
        v = F.when(v > high, high).otherwise(v)
    return df.withColumn("value", v)


def winsorize(df: DataFrame, lower: float = 0.01, upper: float = 0.99, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Clamps to exact percentiles of the group; the groups are channels (and metrics), so their bounds are few rows."""
    q = F.percentile("value", F.array(F.lit(lower), F.lit(upper)))
    bounds = df.groupBy(*by).agg(q.alias("_q"))
    v, lo, hi = F.col("value"), F.col("_q")[0], F.col("_q")[1]
    return df.join(bounds, list(by)).withColumn("value", F.when(v < lo, lo).when(v > hi, hi).otherwise(v)).select(*df.columns)


def drop_sparse(df: DataFrame, min_coverage: float = 0.1, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Keeps groups with two rows or more that cover the share of their span; rows count across keys."""
    n = F.count("*")
    kept = df.groupBy(*by).agg(n.alias("n"), (n / (F.max("bin") - F.min("bin") + 1)).alias("share")).where(f"n >= 2 AND share >= {min_coverage}")
    return df.join(kept.select(*by), list(by), "left_semi").select(*df.columns)


def drop_channels(df: DataFrame, *names: str) -> DataFrame:
    return df.where(~F.col("channel").isin(*names))


def keep_channels(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("channel").isin(*names))


def fill_gaps(df: DataFrame, by: Sequence[str], value: float = 0.0) -> DataFrame:
    """Adds the missing bins inside each signal with this value, no events, and the agg_func of the row before."""
    after = F.lead("bin").over(Window.partitionBy(*by).orderBy("bin"))
    gaps = df.withColumn("_next", after).where("_next > bin + 1").withColumn("bin", F.explode(F.sequence(F.col("bin") + 1, F.col("_next") - 1)))
    gaps = gaps.withColumn("value", F.lit(float(value)))
    for c, v in (("n_events", 0), ("gap_before", None), ("seq_sum", None)):
        if c in df.columns:
            gaps = gaps.withColumn(c, F.lit(v).cast("long"))
    return df.unionByName(gaps.select(*df.columns))


def _wide(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """bin and a column for each channel; of several rows of a channel in a bin the last by the other columns."""
    rest = [c for c, t in df.dtypes if c not in ("channel", "bin", "value") and not t.startswith("map")]
    order = F.struct(*rest) if rest else F.lit(0)
    return df.groupBy("bin").pivot("channel", list(channels)).agg(F.max_by("value", order))


def _rows_of(df: DataFrame, name: str) -> dict:
    """Columns of derived rows beside bin and value."""
    fixed = {"channel": F.lit(name), "agg_func": F.lit("derived"), "n_events": F.lit(0).cast("long")}
    return {c: fixed.get(c, F.lit(None).cast(t)).alias(c) for c, t in df.dtypes}


def derive(df: DataFrame, name: str, fn: Column | Callable[[dict[str, float]], float], channels: Sequence[str]) -> DataFrame:
    """Appends a channel computed from the values of others in the same bin.

    ``fn`` is a Column over the channel names (null where one is missing or a division fails: such bins
    are left out), or a Python function of {channel: value} that may raise.
    """
    wide = _wide(df, channels)
    if isinstance(fn, Column):
        got = wide.select("bin", fn.cast("double").alias("value"))
    else:

        @F.pandas_udf("double")
        def run(*cols: pd.Series) -> pd.Series:
            out = []
            for row in zip(*cols, strict=True):
                try:
                    out.append(float(fn({c: v for c, v in zip(channels, row, strict=True) if v is not None and v == v})))
                except (KeyError, ZeroDivisionError, ValueError):
                    out.append(None)
            return pd.Series(out, dtype=float)

        got = wide.select("bin", run(*[F.col(f"`{c}`") for c in channels]).alias("value"))
    got = got.where("value IS NOT NULL AND NOT isnan(value)")
    new = _rows_of(df, name)
    return df.unionByName(got.select(*[F.col(c) if c in ("bin", "value") else new[c] for c in df.columns]))


def derive_temporal(df: DataFrame, name: str, fn: Column | Callable[[dict[str, np.ndarray]], np.ndarray], channels: Sequence[str]) -> DataFrame:
    """Appends a channel computed along time: a Column with windows over "bin", or a function of whole arrays.

    The arrays of a function are aligned on the distinct bins, with NaN where a channel is missing; it
    runs in one task over as many rows as there are bins. Nulls and NaN of the result are left out.
    """
    wide = _wide(df, channels)
    if isinstance(fn, Column):
        got = wide.select("bin", fn.cast("double").alias("value"))
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin")
            out = np.asarray(fn({c: pdf[c].to_numpy(float) for c in channels}), float)
            if out.shape != (len(pdf),):
                raise ValueError(f"derive_temporal: {out.shape} values for {len(pdf)} bins")
            return pd.DataFrame({"bin": pdf["bin"], "value": out})

        got = wide.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "bin long, value double")
    got = got.where("value IS NOT NULL AND NOT isnan(value)")
    new = _rows_of(df, name)
    return df.unionByName(got.select(*[F.col(c) if c in ("bin", "value") else new[c] for c in df.columns]))


def with_rank(df: DataFrame, name: str, column: str, ties: Sequence[str] = (), chunks: int = 1024) -> DataFrame:
    """Adds the place of each row by ``column`` and ``ties``, from 0, nulls first: ranks within chunks of the column's span, and the sizes of the chunks before."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    size = max(1, -(-int((hi or 0) - (lo or 0) + 1) // chunks))
    dealt = df.withColumn("_chunk", F.coalesce(F.floor((F.col(column) - F.lit(lo)) / size), F.lit(-1)).cast("long"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each chunk
    sizes = dealt.groupBy("_chunk").count().select("_chunk", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_chunk").orderBy(column, *ties)) - 1
    return dealt.join(F.broadcast(sizes), "_chunk").withColumn(name, within + F.col("_before")).drop("_chunk", "_before")


def zoom(records: DataFrame, start: int | None = None, end: int | None = None, column: str = "order", positions: bool = False) -> DataFrame:
    """The records from ``start`` up to before ``end``, by order or by position, with orders from 0."""
    seq = [c for c in ("seq",) if c in records.columns]
    if positions:
        records = with_rank(records, "_at", column, seq)
    at = "_at" if positions else column
    for bound, op in ((start, ">="), (end, "<")):
        if bound is not None:
            records = records.where(f"`{at}` {op} {int(bound)}")
    if positions:
        return records.withColumn(column, (F.col("_at") - (start or 0)).cast("long")).drop("_at")
    first = records.agg(F.min(column).alias("_first"))
    return records.crossJoin(F.broadcast(first)).withColumn(column, F.col(column) - F.col("_first")).drop("_first")


# --- complex values: paired columns re, im -------------------------------------------------------


def amplitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    """0 or pi where the imaginary part is zero."""
    return F.atan2(im, re)


def is_real(im: Column) -> Column:
    """An aggregate: whether all imaginary parts are zero."""
    return F.bool_and(F.coalesce(im, F.lit(0.0)) == 0)


def short_name(c: Column, limit: int = 30) -> Column:
    """The part after the last slash, cut to the limit with dots."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(F.length(last) > limit, F.concat(F.substring(last, 1, limit - 3), F.lit("..."))).otherwise(last)


def window_label(w: Column) -> Column:
    whole = lambda unit, mark: F.concat(F.floor(w / unit).cast("string"), F.lit(mark))
    return F.when(w >= 86_400, whole(86_400, "d")).when(w >= 3600, whole(3600, "h")).when(w >= 60, whole(60, "m")).otherwise(F.concat(w.cast("string"), F.lit("s")))
