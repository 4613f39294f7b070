"""Binning, aggregations, transforms and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregations import get_profile
from ..operators import binning, surface, transforms
from .common import CENTS, DAILY, DENSE, HOPPING, HOUR, HOURLY, PAIRED, PLAN, REC, cells, cents, events, hourly, orders, query, r, surface_sql

_SQL_AGG = {
    "mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(*) AS DOUBLE)", "last": "max_by(value, seq)", "first": "min_by(value, seq)",
    "median": "quantile_cont(value, 0.5)", "std": "stddev_pop(value)", "var": "var_pop(value)", "range": "max(value) - min(value)",
    **{f"p{q}": f"quantile_cont(value, {q / 100})" for q in (25, 75, 90, 95, 99)},
    "geometric_mean": "coalesce(exp(avg(ln(value)) FILTER (WHERE value > 0)), 0.0)",
    "ewma": "list_reduce(list(value ORDER BY ord, seq), lambda a, x: 0.3 * x + 0.7 * a)",
}

for _a in binning.SIGNAL_AGGREGATIONS:

    @query(f"records_to_signals_{_a}", f"WITH {CENTS} SELECT channel, ord, {_SQL_AGG[_a]} AS value, count(*) AS n_records FROM rec GROUP BY 1, 2")
    def _(spark, d, a=_a):
        return binning.records_to_signals(cents(spark, d), ["channel"], a).withColumnRenamed("order", "ord")


def _materialized(value: str, where: str = "TRUE", records: str = CENTS) -> str:
    return f"""WITH {records}, b AS (SELECT channel, user_id, ord // 86400 AS bin, {value} AS value, count(*) AS n_events FROM rec WHERE {where} GROUP BY 1, 2, 3)
SELECT channel, user_id, bin, value, n_events, bin - lag(bin) OVER (PARTITION BY channel, user_id ORDER BY bin) - 1 AS gap_before FROM b"""


@query("materialize_bins", _materialized("avg(value)"))
def _(spark, d):
    return binning.materialize(cents(spark, d), 86_400, ["channel", "user_id"]).drop("seq_sum", "agg_func")


@query("materialize_scope", _materialized("max(value)", "channel IN ('click', 'error')"))
def _(spark, d):
    return binning.materialize(cents(spark, d), 86_400, ["channel", "user_id"], "max", {"click": None, "error": None}).drop("seq_sum", "agg_func")


@query("materialize_by_channel", _materialized("CASE channel WHEN 'click' THEN sum(value) WHEN 'view' THEN max(value) ELSE avg(value) END"))
def _(spark, d):
    return binning.materialize(cents(spark, d), 86_400, ["channel", "user_id"], {"click": "sum", "view": "max"}).drop("seq_sum", "agg_func")


@query("materialize_seq_sum", f"WITH {CENTS} SELECT channel, ord // 86400 AS bin, CASE WHEN bool_and(user_id % 50 <> 3) THEN CAST(sum(seq) AS BIGINT) END AS seq_sum FROM rec GROUP BY 1, 2")
def _(spark, d):
    rec = cents(spark, d).withColumns({"seq_order": F.when(F.col("user_id") % 50 != 3, F.col("seq")), "order_type": F.lit("both")})
    return binning.materialize(rec, 86_400, ["channel"]).select("channel", "bin", "seq_sum")


_LINE = "SELECT l_returnflag AS channel, 'quantity' AS metric, l_linestatus AS status, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS ord, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_linestatus, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), round(l_extendedprice * 100) FROM lineitem"


@query("materialize_lineitem_metrics", f"WITH rec AS ({_LINE}) SELECT channel, metric, status, ord // 30 AS bin, max(value) AS value, count(*) AS n_events FROM rec GROUP BY 1, 2, 3, 4")
def _(spark, d):
    from ..sources.records import epoch_days, from_table

    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("price", F.round(F.col("l_extendedprice") * 100))
    long = li.withColumnRenamed("l_quantity", "quantity").unpivot(["l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey"], ["quantity", "price"], "metric", "value")
    rec = from_table(long, epoch_days(F.col("l_shipdate")), "value", "l_returnflag", {"status": "l_linestatus"}, "l_orderkey", "metric")
    return binning.materialize(rec, 30, ["channel", "metric", "status"], "max").select("channel", "metric", "status", "bin", "value", "n_events")


_MODE = f"WITH {CENTS}, c AS (SELECT channel, ord // 86400 AS bin, value, count(*) AS n FROM rec GROUP BY 1, 2, 3) SELECT channel, bin, arg_min(value, (-n, value)) AS value FROM c GROUP BY 1, 2"
_ENTROPY = f"""WITH {CENTS}, b AS (SELECT channel, ord // 86400 AS bin, value, min(value) OVER p AS lo, max(value) OVER p AS hi, count(*) OVER p AS n FROM rec WINDOW p AS (PARTITION BY channel, ord // 86400)),
h AS (SELECT channel, bin, n, CASE WHEN hi > lo THEN least(CAST(floor((value - lo) / (hi - lo) * least(10, n)) AS INT), least(10, n) - 1) ELSE 0 END AS k FROM b),
c AS (SELECT channel, bin, k, n, count(*) AS m FROM h GROUP BY 1, 2, 3, 4)
SELECT channel, bin, round(abs(-sum(m / n * log2(m / n))), 6) AS value FROM c GROUP BY 1, 2"""
_SPECTRAL = f"""WITH {REC}, b AS (SELECT channel, ord // 86400 AS bin, value - avg(value) OVER (PARTITION BY channel, ord // 86400) AS v,
  row_number() OVER (PARTITION BY channel, ord // 86400 ORDER BY ord, seq) - 1 AS k, count(*) OVER (PARTITION BY channel, ord // 86400) AS n FROM rec),
y AS (SELECT channel, bin, n, k, v * CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * k / (n - 1)) ELSE 1 END AS y FROM b)
SELECT channel, bin, round((n * sum(y * y) + sum(y) * sum(y) + CASE WHEN n % 2 = 0 THEN pow(sum(CASE WHEN k % 2 = 0 THEN y ELSE -y END), 2) ELSE 0 END) / 2 / n, 3) AS value FROM y GROUP BY channel, bin, n"""
for _a in [*(k for k in _SQL_AGG), "mode", "entropy", "spectral_energy", "dominant_freq"]:
    _n = {"spectral_energy": 3}.get(_a, 4)
    _body = {"mode": _MODE, "entropy": _ENTROPY, "spectral_energy": _SPECTRAL, "dominant_freq": None}.get(_a, f"WITH {CENTS} SELECT channel, ord // 86400 AS bin, round({_SQL_AGG.get(_a)}, 4) AS value FROM rec GROUP BY 1, 2")

    @query(f"agg_{_a}", _body)
    def _(spark, d, a=_a, n=6 if _a == "entropy" else _n):
        rec = events(spark, d) if a == "spectral_energy" else cents(spark, d)
        out = binning.materialize(rec, 86_400, ["channel"], a).select("channel", "bin", r("value", n))
        return out.withColumn("value", F.abs("value")) if a == "entropy" else out


@query("densify", f"WITH {DENSE} SELECT channel, bin, value, n_events FROM dense")
def _(spark, d):
    return binning.densify(hourly(spark, d), ["channel"]).select("channel", "bin", "value", F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("densify_global", f"WITH {HOURLY}, e AS (SELECT min(bin) AS lo, max(bin) AS hi FROM binned), s AS (SELECT channel, unnest(range(lo, hi + 1)) AS bin FROM e, (SELECT DISTINCT channel FROM binned)) SELECT s.channel, s.bin, b.value FROM s LEFT JOIN binned b ON s.channel = b.channel AND s.bin = b.bin")
def _(spark, d):
    return binning.densify(hourly(spark, d), ["channel"], "global").select("channel", "bin", "value")


@query(
    "entity_channel_matrix",
    f"""WITH {REC}, f AS (SELECT user_id, channel, (ord - min(ord) OVER (PARTITION BY user_id)) // 86400 AS bin FROM rec),
e AS (SELECT user_id, unnest(range(0, max(bin) + 1)) AS bin FROM f GROUP BY 1)
SELECT e.user_id, e.bin, count(f.channel) FILTER (WHERE channel = 'click') AS click, count(f.channel) FILTER (WHERE channel = 'error') AS error, count(f.channel) AS _total
FROM e LEFT JOIN f ON e.user_id = f.user_id AND e.bin = f.bin GROUP BY 1, 2""",
)
def _(spark, d):
    return binning.entity_channel_matrix(events(spark, d), ["user_id"], ["click", "error"], 86_400).select("user_id", "bin", "click", "error", "_total")


@query("entity_ids", f"WITH {REC} SELECT DISTINCT 'channel=' || channel || ';user=' || user_id AS entity FROM rec")
def _(spark, d):
    return events(spark, d).select(binning.canonical_keys({"user": F.col("user_id").cast("string"), "channel": "channel"}).alias("entity")).distinct()


# --- transforms of binned rows -------------------------------------------------------------------


@query("op_clip", f"WITH {HOURLY} SELECT channel, bin, greatest(least(value, 50000), 10000) AS value FROM binned")
def _(spark, d):
    return transforms.clip(hourly(spark, d), 10_000.0, 50_000.0).select("channel", "bin", "value")


@query("op_winsorize", f"WITH {HOURLY}, q AS (SELECT channel, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM binned GROUP BY 1) SELECT channel, bin, round(greatest(least(value, hi), lo), 4) AS value FROM binned JOIN q USING (channel)")
def _(spark, d):
    return transforms.winsorize(hourly(spark, d), 0.05, 0.95).select("channel", "bin", r("value", 4))


@query("op_drop_sparse", f"WITH {CENTS}, b AS (SELECT channel, user_id, ord // 3600 AS bin FROM rec GROUP BY 1, 2, 3), k AS (SELECT user_id FROM b GROUP BY 1 HAVING count(*) >= 2 AND count(*) / (max(bin) - min(bin) + 1) >= 0.09) SELECT channel, user_id, bin FROM b WHERE user_id IN (SELECT user_id FROM k)")
def _(spark, d):
    b = binning.materialize(cents(spark, d), HOUR, ["channel", "user_id"])
    return transforms.drop_sparse(b, 0.09, ["user_id"]).select("channel", "user_id", "bin")


@query("op_drop_channels", f"WITH {HOURLY} SELECT channel, bin, value FROM binned WHERE channel NOT IN ('view', 'click')")
def _(spark, d):
    return transforms.drop_channels(hourly(spark, d), "view", "click").select("channel", "bin", "value")


@query("op_keep_channels", f"WITH {HOURLY} SELECT channel, bin, value FROM binned WHERE channel IN ('view', 'click')")
def _(spark, d):
    return transforms.keep_channels(hourly(spark, d), "view", "click").select("channel", "bin", "value")


@query("op_fill_gaps", f"WITH {DENSE} SELECT channel, bin, coalesce(value, 0) AS value, n_events FROM dense")
def _(spark, d):
    return transforms.fill_gaps(hourly(spark, d), ["channel"]).select("channel", "bin", "value", "n_events")


_WIDE = f"WITH {HOURLY}, w AS (SELECT bin, max(value) FILTER (WHERE channel = 'error') AS error, max(value) FILTER (WHERE channel = 'view') AS vw FROM binned GROUP BY 1)"


@query("op_derive", f"{_WIDE} SELECT channel, bin, value FROM binned UNION ALL SELECT 'share', bin, error / vw FROM w WHERE error IS NOT NULL AND vw <> 0")
def _(spark, d):
    return transforms.derive(hourly(spark, d), "share", F.try_divide(F.col("error"), F.col("view")), ["error", "view"]).select("channel", "bin", "value")


@query("op_derive_python", f"{_WIDE} SELECT channel, bin, value FROM binned UNION ALL SELECT 'sum', bin, error + vw FROM w WHERE error IS NOT NULL AND vw IS NOT NULL")
def _(spark, d):
    return transforms.derive(hourly(spark, d), "sum", lambda v: v["error"] + v["view"], ["error", "view"]).select("channel", "bin", "value")


@query("op_derive_temporal", f"{_WIDE}, l AS (SELECT bin, error - lag(error) OVER (ORDER BY bin) AS v FROM w) SELECT channel, bin, value FROM binned UNION ALL SELECT 'step', bin, v FROM l WHERE v IS NOT NULL")
def _(spark, d):
    def step(x):
        import numpy as np

        return np.concatenate(([np.nan], np.diff(x["error"])))

    return transforms.derive_temporal(hourly(spark, d), "step", step, ["error", "view"]).select("channel", "bin", "value")


@query("op_zoom", f"WITH {REC}, z AS (SELECT * FROM rec WHERE ord >= 1704585600 AND ord < 1705190400) SELECT channel, user_id, ord - (SELECT min(ord) FROM z) AS ord, value, seq FROM z")
def _(spark, d):
    return transforms.zoom(events(spark, d), 1_704_585_600, 1_705_190_400).withColumnRenamed("order", "ord")


@query("op_zoom_positions", f"WITH {REC}, z AS (SELECT *, row_number() OVER (ORDER BY ord, seq) - 1 AS p FROM rec) SELECT channel, user_id, p - 100 AS ord, value, seq FROM z WHERE p >= 100 AND p < 400")
def _(spark, d):
    return transforms.zoom(events(spark, d), 100, 400, positions=True).withColumnRenamed("order", "ord")


@query("complex_parts", "SELECT vec_id, round(sqrt(re * re + im * im), 6) AS amplitude, round(atan2(im, re), 6) AS phase FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS re, CAST(embedding[2] AS DOUBLE) AS im FROM embeddings)")
def _(spark, d):
    z = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im"))
    return z.select("vec_id", F.round(transforms.amplitude(F.col("re"), F.col("im")), 6).alias("amplitude"), F.round(transforms.phase(F.col("re"), F.col("im")), 6).alias("phase"))


@query("labels_of_windows", "SELECT w, CASE WHEN w >= 86400 THEN (w // 86400) || 'd' WHEN w >= 3600 THEN (w // 3600) || 'h' WHEN w >= 60 THEN (w // 60) || 'm' ELSE w || 's' END AS label FROM range(1, 200000, 997) t(w)")
def _(spark, d):
    return spark.range(1, 200_000, 997).select(F.col("id").alias("w"), transforms.window_label(F.col("id")).alias("label"))


@query("short_names", "SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS name FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", transforms.short_name(F.concat(F.lit("a/b/"), F.col("p_name")), 12).alias("name"))


# --- surfaces ------------------------------------------------------------------------------------

_SURFACE = {
    "mean": ("avg(value) AS mean", "mean"), "sum": ('sum(value) AS "sum"', "sum"), "count": ('CASE WHEN count(value) > 0 THEN CAST(count(value) AS DOUBLE) END AS "count"', "count"),
    "std": ("CASE WHEN count(value) > 1 THEN round(stddev_pop(value), 2) END AS std", lambda: r("std", 2)),
    "var": ("CASE WHEN count(value) > 1 THEN round(var_pop(value) / 997e3, 4) END AS var", lambda: F.round(F.col("var") / 997e3, 4).alias("var")),
    "geometric_mean": ("CASE WHEN count(value) > 0 THEN round(exp(coalesce(sum(ln(value)) FILTER (WHERE value > 0), 0) / count(value)), 2) END AS geometric_mean", lambda: r("geometric_mean", 2)),
    "median": ("round(quantile_cont(value, 0.5), 2) AS median", lambda: r("median", 2)), "p95": ("round(quantile_cont(value, 0.95), 2) AS p95", lambda: r("p95", 2)), "max": ('max(value) AS "max"', "max"),
    "count_entropy": ("CASE WHEN sum(n_events) > 0 THEN round(greatest(0, log2(sum(n_events)) - sum(n_events * log2(n_events)) FILTER (WHERE n_events > 0) / sum(n_events)), 6) END AS count_entropy", lambda: r("count_entropy")),
}
for _a, (_sql, _col) in _SURFACE.items():

    @query(f"surface_{_a}", surface_sql(_sql))
    def _(spark, d, a=_a, c=_col):
        return cells(surface.measure(hourly(spark, d), PLAN, ["channel"], a), c() if callable(c) else c)


@query("surface_coverage", surface_sql("CAST(sum(n_events) AS BIGINT) AS n_events, count(value) / w AS coverage"))
def _(spark, d):
    return cells(surface.measure(hourly(spark, d), PLAN, ["channel"]), "n_events", "coverage")


_HOPS = PAIRED.replace("(1, 1), (2, 1), (6, 1), (12, 1), (24, 1), (168, 1)", "(1, 1), (6, 3), (24, 24)")


@query("surface_hops", f"WITH {_HOPS} SELECT channel, win, bin, CASE WHEN (bin - lo) % h = 0 THEN avg(value) END AS mean, CASE WHEN (bin - lo) % h = 0 THEN count(value) / w ELSE 0 END AS coverage, CASE WHEN (bin - lo) % h = 0 THEN CAST(sum(n_events) AS BIGINT) ELSE 0 END AS n_events FROM paired GROUP BY channel, win, bin, w, lo, h")
def _(spark, d):
    return cells(surface.measure(hourly(spark, d), HOPPING, ["channel"]), "mean", "coverage", "n_events")


@query("surface_profile_anomaly", surface_sql('avg(value) AS mean, max(value) AS "max", round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99'))
def _(spark, d):
    assert get_profile("anomaly") == ("mean", "max", "p95", "p99")
    return cells(surface.measure(hourly(spark, d), PLAN, ["channel"], profile="anomaly"), "mean", "max", r("p95", 2), r("p99", 2))


_ORD = "rec AS (SELECT o_orderpriority AS channel, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ord, round(o_totalprice * 100) AS value FROM orders)"


@query(
    "surface_orders_daily",
    f"""WITH {_ORD}, b AS (SELECT channel, ord AS bin, sum(value) AS value, count(*) AS n FROM rec GROUP BY 1, 2), e AS (SELECT channel, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY 1),
s AS (SELECT channel, unnest(range(lo, hi + 1)) AS bin FROM e), dn AS (SELECT s.channel, s.bin, b.value FROM s LEFT JOIN b ON s.channel = b.channel AND s.bin = b.bin), w(w) AS (VALUES (1), (7), (30), (90), (360))
SELECT a.channel, w.w AS win, a.bin, sum(x.value) AS "sum", count(x.value) / w.w AS coverage FROM dn a CROSS JOIN w JOIN dn x ON x.channel = a.channel AND x.bin >= a.bin AND x.bin < a.bin + w.w GROUP BY 1, 2, 3, w.w""",
)
def _(spark, d):
    rec = orders(spark, d).withColumn("value", F.round(F.col("value") * 100))
    return cells(surface.measure(binning.materialize(rec, 1, ["channel"], "sum"), DAILY, ["channel"], "sum"), "sum", "coverage")


@query("surface_complex", f"WITH {PAIRED}, c AS (SELECT channel, win, w, bin, value AS re, value * (b_bin % 3 - 1) AS im FROM paired) SELECT channel, win, bin, avg(re) AS mean_re, avg(im) AS mean_im FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    z = hourly(spark, d).select("channel", "bin", F.col("value").alias("re"), (F.col("value") * (F.col("bin") % 3 - 1)).alias("im"), "n_events")
    return cells(surface.measure_complex(z, PLAN, ["channel"], ["mean"]), "mean_re", "mean_im")
