"""Streaming forms: bins, sessions and exponential smoothing with bounded state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bins(events: DataFrame, by: Sequence[str], bin_length: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """by, bin_start, value (mean), n_events of tumbling bins; events later than the watermark are left out."""
    w = F.window(time, bin_length)
    out = events.withWatermark(time, late).groupBy(*by, w.alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n_events"))
    return out.select(*by, F.col("w.start").alias("bin_start"), "value", "n_events")


def stream_windows(events: DataFrame, by: Sequence[str], windows: Sequence[str], hop: str, time: str = "ts", late: str = "1 hour") -> list[DataFrame]:
    """One sliding aggregate for each window length: by, length, start, mean, n_events."""
    out = []
    for length in windows:
        agg = events.withWatermark(time, late).groupBy(*by, F.window(time, length, hop).alias("w")).agg(F.avg("value").alias("mean"), F.count("*").alias("n_events"))
        out.append(agg.select(*by, F.lit(length).alias("length"), F.col("w.start").alias("start"), "mean", "n_events"))
    return out


def stream_sessions(events: DataFrame, entity: Sequence[str], gap: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """entity, start, end (last event), event_count of sessions: a pause beyond the gap ends one."""
    s = events.withWatermark(time, late).groupBy(*entity, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("event_count"), F.max(time).alias("end"), F.min(time).alias("start"))
    return s.select(*entity, "start", "end", "event_count")


def stream_ewma(bins: DataFrame, by: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """Rows (by, bin, value) with ewma; the state of a signal is its last smoothed value and bin.

    Within a micro-batch rows go in the order of bins; a bin at or before the last one seen is left out.
    """
    fields = {f.name: f.dataType.simpleString() for f in bins.schema.fields}
    out = ", ".join([*[f"`{c}` {fields[c]}" for c in by], "bin long", "value double", "ewma double"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values("bin").itertuples():
            if at is not None and r.bin <= at or pd.isna(r.value):
                continue
            last = r.value if last is None else alpha * r.value + (1 - alpha) * last
            at = r.bin
            rows.append((*key, r.bin, r.value, last))
        if at is not None:
            state.update((float(last), int(at)))
        yield pd.DataFrame(rows, columns=[*by, "bin", "value", "ewma"])

    return bins.groupBy(*by).applyInPandasWithState(run, out, "last double, at long", "append", GroupStateTimeout.NoTimeout)
