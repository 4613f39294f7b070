"""Records to signals and bins.

A records frame has group columns (``by``: channel, keys, maybe metric), ``order`` (long), ``value``
(double) and ``seq`` (a tiebreak for arrival); ``order_type`` and ``seq_order`` are optional.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregations import get_aggregation

SIGNAL_AGGREGATIONS = ("mean", "sum", "max", "min", "count", "last")


def seq_of(df: DataFrame) -> Column:
    return F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()


def records_to_signals(records: DataFrame, by: Sequence[str], agg: str = "mean") -> DataFrame:
    """One point for each group and order: by, order, value, n_records."""
    if agg not in SIGNAL_AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}; use one of {', '.join(SIGNAL_AGGREGATIONS)}")
    value = get_aggregation(agg).over_rows(F.col("value"), seq_of(records))
    return records.groupBy(*by, "order").agg(value.alias("value"), F.count("*").alias("n_records"))


def canonical_keys(keys: Mapping[str, Column | str]) -> Column:
    """``k=v;k2=a,b`` with the keys in order; list values are sorted Columns of arrays; ``_`` without keys."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(""))) for k, v in sorted(keys.items())]
    return F.concat_ws(";", *parts) if parts else F.lit("_")


def in_scope(records: DataFrame, scope: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Keeps the listed channels and, where a list is given, their metrics."""
    keep = F.lit(False)
    for channel, metrics in scope.items():
        hit = F.col("channel") == channel
        keep = keep | (hit if metrics is None else hit & F.col("metric").isin(*metrics))
    return records.where(keep)


def materialize(records: DataFrame, cbin: int, by: Sequence[str], agg: str | Mapping = "mean", scope: Mapping | None = None) -> DataFrame:
    """by, bin, value, n_events, gap_before (null first), seq_sum, agg_func.

    ``agg`` is one name, or names by channel or (channel, metric) with "mean" for the rest. seq_sum is the
    sum of seq_order where every record of the bin has one and is ordered by sequence, else null.
    """
    if scope is not None:
        records = in_scope(records, scope)
    value, seq = F.col("value"), seq_of(records)
    names = {agg} if isinstance(agg, str) else {*agg.values(), "mean"}
    aggs = [get_aggregation(n).over_rows(value, F.struct(F.col("order"), seq)).alias(f"_{n}") for n in sorted(names)]
    if "seq_order" in records.columns:
        complete = F.min((F.col("seq_order").isNotNull() & F.col("order_type").isin("sequence", "both")).cast("int")) == 1
        seq_sum = F.when(complete, F.sum("seq_order"))
    else:
        seq_sum = F.lit(None).cast("long")
    binned = records.withColumn("bin", F.floor(F.col("order") / cbin)).groupBy(*by, "bin").agg(*aggs, F.count("*").alias("n_events"), seq_sum.alias("seq_sum"))
    name = F.lit("mean" if not isinstance(agg, str) else agg)
    if not isinstance(agg, str):
        for k, n in agg.items():
            hit = F.col("channel") == (k if isinstance(k, str) else k[0])
            if not isinstance(k, str):
                hit = hit & (F.col("metric") == k[1])
            name = F.when(hit, n).otherwise(name)
    binned = binned.withColumn("agg_func", name)
    picked = F.coalesce(*[F.when(F.col("agg_func") == n, F.col(f"_{n}")) for n in sorted(names)])
    w = Window.partitionBy(*by).orderBy("bin")
    return binned.select(*by, "bin", picked.alias("value"), "n_events", (F.col("bin") - F.lag("bin").over(w) - 1).alias("gap_before"), "seq_sum", "agg_func")


def bin_signal(signals: DataFrame, cbin: int, by: Sequence[str]) -> DataFrame:
    """by, bin, value (mean of the points of a bin), n_events (its points)."""
    return signals.groupBy(*by, F.floor(F.col("order") / cbin).alias("bin")).agg(F.avg("value").alias("value"), F.count("*").alias("n_events"))


def spine(binned: DataFrame, by: Sequence[str], axis: str = "signal") -> DataFrame:
    """by, bin for every bin from the first to the last of each signal, or of all signals (axis="global")."""
    ends = binned.groupBy(*by).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    if axis == "global":
        whole = binned.agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))  # one row
        ends = ends.drop("_lo", "_hi").crossJoin(F.broadcast(whole))
    elif axis != "signal":
        raise ValueError(f"axis is signal or global, not {axis!r}")
    return ends.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("bin"))


def densify(binned: DataFrame, by: Sequence[str], axis: str = "signal") -> DataFrame:
    """The binned rows with empty bins in between as nulls."""
    return spine(binned, by, axis).join(binned, [*by, "bin"], "left")


def entity_channel_matrix(records: DataFrame, entity: Sequence[str], channels: Sequence[str], cbin: int = 1) -> DataFrame:
    """entity, bin (from the entity's first order), a count for each channel, _total."""
    w = Window.partitionBy(*entity)
    rel = records.withColumn("bin", F.floor((F.col("order") - F.min("order").over(w)) / cbin))
    counted = rel.groupBy(*entity, "bin").pivot("channel", list(channels)).count()
    total = rel.groupBy(*entity, "bin").agg(F.count("*").alias("_total"))
    out = spine(total, entity).join(total, [*entity, "bin"], "left").join(counted, [*entity, "bin"], "left")
    return out.fillna(0, [*channels, "_total"])


def entity_signals(records: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """The records, dealt by entity and in order within it; without keys all are one entity."""
    if not entity:
        return records.withColumn("_all", F.lit("_all")).sort("order")
    return records.repartition(*entity).sortWithinPartitions(*entity, "order")
