"""Features of surfaces and their assembly for learning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lattice import SamplingPlan
from .surface_ops import AXES, KEPT, ewma, per_row, value_columns

FEATURES = ("baseline_ewma", "baseline_rmed", "residual", "zscore", "delta", "rate", "gradient")


def engineer(surface: DataFrame, plan: SamplingPlan, by: Sequence[str], ewma_alpha: float = 0.3, rolling_window: int = 5, features: Sequence[str] = FEATURES) -> DataFrame:
    """For each column a: a, a_baseline_ewma (filled forward), a_baseline_rmed, a_residual, a_zscore, a_delta, a_rate, a_gradient.

    The z-score divides the residual by 1.4826 times its median absolute deviation along the row (null below
    two values or where that is 0). The gradient is against the smallest selected window that this one divides.
    """
    aggs = value_columns(surface, by)
    want = {*features}
    if want & {"baseline_ewma", "residual", "zscore"}:
        surface = per_row(surface, by, lambda p: {f"{a}_baseline_ewma": ewma(p[a].to_numpy(float), ewma_alpha, True) for a in aggs}, [f"{a}_baseline_ewma" for a in aggs])
    row = Window.partitionBy(*by, "scale_idx")
    along = row.orderBy("bin")
    trailing = along.rowsBetween(-(rolling_window - 1), 0)
    cover = {w: c for w in plan.windows if (c := plan.cover(w)) is not None}
    half = F.lit(0.5)
    for a in aggs:
        v = F.col(a)
        if "baseline_rmed" in want:
            surface = surface.withColumn(f"{a}_baseline_rmed", F.percentile(v, half).over(trailing))
        if want & {"residual", "zscore"}:
            surface = surface.withColumn(f"{a}_residual", v - F.col(f"{a}_baseline_ewma"))
        if "zscore" in want:
            r = F.col(f"{a}_residual")
            surface = surface.withColumns({"_m": F.percentile(r, half).over(row), "_n": F.count(r).over(row)})
            surface = surface.withColumn("_d", F.percentile(F.abs(r - F.col("_m")), half).over(row))
            surface = surface.withColumn(f"{a}_zscore", F.when((F.col("_n") >= 2) & (F.col("_d") > 0), r / (1.4826 * F.col("_d")))).drop("_m", "_n", "_d")
        if want & {"delta", "rate"}:
            delta = v - F.lag(a).over(along)
            surface = surface.withColumn(f"{a}_delta", delta)
        if "rate" in want:
            surface = surface.withColumn(f"{a}_rate", F.when(F.col("coverage") > 0, F.col(f"{a}_delta") / F.greatest("coverage", F.lit(1e-9))))
    if "gradient" in want:
        at_bin = Window.partitionBy(*by, "bin")
        target = F.coalesce(*[F.when(F.col("window") == w, F.lit(c)) for w, c in cover.items()], F.lit(None).cast("long")).cast("long") if cover else F.lit(None).cast("long")
        surface = surface.withColumn("_cover", target)
        for a in aggs:
            values = F.map_from_entries(F.collect_list(F.when(F.col(a).isNotNull(), F.struct("window", a))).over(at_bin))
            surface = surface.withColumn("_at", values).withColumn(f"{a}_gradient", F.when(F.col("_cover").isNotNull(), F.col(a) - F.try_element_at("_at", F.coalesce("_cover", F.lit(-1))))).drop("_at")
        surface = surface.drop("_cover")
    names = [n for a in aggs for n in (a, *[f"{a}_{f}" for f in FEATURES if f in want])]
    return surface.select(*[c for c in (*by, *KEPT) if c in surface.columns], *names)


def assemble(tensors: Sequence[DataFrame], by: Sequence[str], entity: Column, labels: DataFrame | None = None) -> DataFrame:
    """Long rows (entity, channel_name, channel_idx, scale, bin, value FLOAT) of the features of all tensors.

    channel_name is channel/metric/feature; its index follows the names in order. ``labels`` (entity, label)
    is joined. The tensors must have the same columns.
    """
    if not tensors:
        raise ValueError("nothing to assemble")
    first = value_columns(tensors[0], by)
    whole = tensors[0]
    for t in tensors[1:]:
        if value_columns(t, by) != first:
            raise ValueError("tensors differ in their features")
        whole = whole.unionByName(t)
    metric = F.col("metric") if "metric" in whole.columns else F.lit("value")
    long = whole.select(
        entity.alias("entity"), F.col("channel").alias("_channel"), metric.alias("_metric"), "scale", "bin",
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("float").alias("value")) for c in sorted(first)])).alias("f"),
    )
    long = long.select("entity", F.concat_ws("/", "_channel", "_metric", "f.feature").alias("channel_name"), "scale", "bin", "f.value")
    names = long.select("channel_name").distinct()
    index = names.withColumn("channel_idx", F.row_number().over(Window.orderBy("channel_name")) - 1)  # channels times features: few rows
    out = long.join(F.broadcast(index), "channel_name").select("entity", "channel_name", "channel_idx", "scale", "bin", "value")
    return out if labels is None else out.join(labels, "entity", "left")


def entity_array(bundle: DataFrame, entity: str) -> np.ndarray:
    """(channels, scales, bins) float32 of one entity, NaN where nothing was measured."""
    pdf = bundle.where(F.col("entity") == entity).toPandas()
    if pdf.empty:
        raise KeyError(entity)
    scales, bins = sorted(pdf["scale"].unique()), sorted(pdf["bin"].unique())
    out = np.full((int(pdf["channel_idx"].max()) + 1, len(scales), len(bins)), np.nan, np.float32)
    at = {s: i for i, s in enumerate(scales)}, {b: i for i, b in enumerate(bins)}
    out[pdf["channel_idx"], pdf["scale"].map(at[0]), pdf["bin"].map(at[1])] = pdf["value"]
    return out


__all__ = ["AXES", "FEATURES", "assemble", "engineer", "entity_array"]
