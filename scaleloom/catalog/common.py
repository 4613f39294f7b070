"""Records of the test tables, and the fragments of SQL that most oracles start from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import materialize
from ..plans.lattice import SamplingPlan
from ..sources.records import epoch_days, epoch_seconds, from_table

HOUR = 3600
PLAN = SamplingPlan.from_windows([HOUR, 2 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR, 168 * HOUR], HOUR)
HOPPING = SamplingPlan.from_windows([HOUR, 6 * HOUR, 24 * HOUR], HOUR, [HOUR, 3 * HOUR, 24 * HOUR])
DAILY = SamplingPlan.from_windows([1, 7, 30, 90, 360], 1)
GAP = 6 * HOUR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its oracle if SQL can express it."""

    def put(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return put


def events(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """channel (event_type), user_id, order (epoch seconds), value, seq."""
    df = spark.read.parquet(f"{d}/events.parquet")
    return from_table(df, epoch_seconds(F.col("ts")), "value", "event_type", ["user_id"], "event_id", keep=keep)


def cents(spark: SparkSession, d: str) -> DataFrame:
    """Events with whole cents as values, so that sums are exact in any order."""
    return events(spark, d).withColumn("value", F.round(F.col("value") * 100))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """channel (priority), status, order (days), value (total price), seq."""
    df = spark.read.parquet(f"{d}/orders.parquet")
    return from_table(df, epoch_days(F.col("o_orderdate")), "o_totalprice", "o_orderpriority", {"status": "o_orderstatus"}, "o_orderkey")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """channel, bin, value (cents), n_events."""
    return materialize(cents(spark, d), HOUR, ["channel"], "sum").select("channel", "bin", "value", "n_events")


def r(c: str | Column, n: int = 6) -> Column:
    """Rounded under its own name."""
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


def scaled(c: str) -> Column:
    """Divided by a prime before rounding, which keeps means of few whole numbers off the edges of rounding; never a negative zero."""
    return (F.round(F.col(c) / 997, 5) + 0.0).alias(c)


def cells(surface: DataFrame, *columns: str | Column, by: Sequence[str] = ("channel",)) -> DataFrame:
    return surface.select(*by, F.col("window").alias("win"), "bin", *columns)


REC = "rec AS (SELECT event_type AS channel, user_id, epoch_us(ts) // 1000000 AS ord, value, event_id AS seq FROM events)"
CENTS = "rec AS (SELECT event_type AS channel, user_id, epoch_us(ts) // 1000000 AS ord, round(value * 100) AS value, event_id AS seq FROM events)"
HOURLY = f"{CENTS}, binned AS (SELECT channel, ord // 3600 AS bin, sum(value) AS value, count(*) AS n_events FROM rec GROUP BY 1, 2)"
DENSE = f"""{HOURLY},
ends AS (SELECT channel, min(bin) AS lo, max(bin) AS hi FROM binned GROUP BY 1),
spine AS (SELECT channel, lo, unnest(range(lo, hi + 1)) AS bin FROM ends),
dense AS (SELECT s.channel, s.bin, s.lo, b.value, coalesce(b.n_events, 0) AS n_events FROM spine s LEFT JOIN binned b ON s.channel = b.channel AND s.bin = b.bin)"""
_WIN = ", ".join(f"({w}, {h})" for w, h in zip(PLAN.scales, PLAN.hop_bins, strict=True))
WIN = f"win(w, h) AS (VALUES {_WIN})"
#: Every cell with the dense bins of its window: a row for each pair.
PAIRED = f"""{DENSE}, {WIN},
paired AS (SELECT a.channel, a.bin, a.lo, w.w, w.h, w.w * 3600 AS win, b.bin AS b_bin, b.value, b.n_events
  FROM dense a CROSS JOIN win w JOIN dense b ON b.channel = a.channel AND b.bin >= a.bin AND b.bin < a.bin + w.w)"""


def surface_sql(columns: str, tail: str = "") -> str:
    return f"WITH {PAIRED} SELECT channel, win, bin, {columns} FROM paired GROUP BY channel, win, bin, w {tail}"


#: The surface of means as a table to go on from.
MEANS = f"{PAIRED}, m AS (SELECT channel, win, w, bin, avg(value) AS mean, count(value) / w AS coverage FROM paired GROUP BY channel, win, w, bin)"
