"""Operators on surfaces, features and information surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning, features, information, surface, surface_ops
from ..sources import sinks
from .common import CENTS, DENSE, HOUR, HOURLY, MEANS, PAIRED, PLAN, REC, cells, cents, events, hourly, query, r, scaled, surface_sql

BY = ["channel"]


def means(spark, d):
    return surface.measure(hourly(spark, d), PLAN, BY, "mean")


_TRAIL = "avg(mean) OVER (PARTITION BY channel, win ORDER BY bin ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_ROLLED = f"WITH {MEANS}, b AS (SELECT *, {_TRAIL} AS base FROM m)"
#: Exponential smoothing as a recursion along each row of the surface; nulls keep the state.
_SMOOTH = """k AS (SELECT channel, win, bin, mean, coverage, row_number() OVER (PARTITION BY channel, win ORDER BY bin) AS i FROM m),
s(channel, win, bin, i, mean, coverage, state) AS (SELECT channel, win, bin, i, mean, coverage, mean FROM k WHERE i = 1
  UNION ALL SELECT k.channel, k.win, k.bin, k.i, k.mean, k.coverage, CASE WHEN k.mean IS NULL THEN s.state WHEN s.state IS NULL THEN k.mean ELSE {a} * k.mean + (1 - {a}) * s.state END
  FROM s JOIN k ON k.channel = s.channel AND k.win = s.win AND k.i = s.i + 1)"""


@query("baseline_rolling_mean", f"{_ROLLED} SELECT channel, win, bin, round(base / 997, 5) + 0.0 AS mean FROM b")
def _(spark, d):
    return cells(surface_ops.baseline(means(spark, d), BY, "rolling_mean"), scaled("mean"))


@query("baseline_ewma", f"WITH RECURSIVE {MEANS}, {_SMOOTH.format(a=0.1)} SELECT channel, win, bin, CASE WHEN mean IS NOT NULL THEN round(state / 997, 5) END AS mean FROM s")
def _(spark, d):
    return cells(surface_ops.baseline(means(spark, d), BY, "ewma"), scaled("mean"))


@query(
    "baseline_median",
    f"""WITH {MEANS}, q AS (SELECT channel, win, median(mean) AS md, count(mean) AS n FROM m GROUP BY 1, 2),
f AS (SELECT channel, win, bin, mean, coalesce(mean, md) AS v, n, row_number() OVER (PARTITION BY channel, win ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY channel, win) AS len FROM m JOIN q USING (channel, win)),
p AS (SELECT f.channel, f.win, f.bin, f.mean, f.n, f.len, CASE WHEN f.i + o.o < 0 THEN -(f.i + o.o) - 1 WHEN f.i + o.o >= len THEN 2 * len - 1 - (f.i + o.o) ELSE f.i + o.o END AS j FROM f CROSS JOIN (SELECT unnest(range(-5, 5)) AS o) o),
g AS (SELECT p.channel, p.win, p.bin, any_value(p.mean) AS mean, any_value(p.n) AS n, list_sort(list(f.v))[6] AS v FROM p JOIN f ON f.channel = p.channel AND f.win = p.win AND f.i = p.j GROUP BY 1, 2, 3)
SELECT channel, win, bin, CASE WHEN mean IS NOT NULL THEN CASE WHEN n < 10 THEN mean ELSE v END END AS mean FROM g""",
)
def _(spark, d):
    return cells(surface_ops.baseline(means(spark, d), BY, "median"), "mean")


_RES = {
    "difference": "round((mean - base) / 997, 5)", "ratio": "CASE WHEN base <> 0 THEN round(mean / base, 6) END",
    "z": "CASE WHEN stddev_pop(base) OVER (PARTITION BY channel, win) > 0 THEN round((mean - base) / stddev_pop(base) OVER (PARTITION BY channel, win), 5) END",
}
for _m, _sql in _RES.items():

    @query(f"residual_{_m}", f"{_ROLLED} SELECT channel, win, bin, {_sql} AS mean FROM b")
    def _(spark, d, m=_m, n={"z": 5}.get(_m, 6)):
        x = means(spark, d)
        return cells(surface_ops.residual(x, surface_ops.baseline(x, BY, "rolling_mean"), BY, m), scaled("mean") if m == "difference" else r("mean", n))


_GRAD = ", ".join(f"g{p}.mean - m.mean AS grad_p{p}" for p in PLAN.prime_basis)
_GRAD_JOIN = " ".join(f"LEFT JOIN m g{p} ON g{p}.channel = m.channel AND g{p}.bin = m.bin AND m.w % {p} = 0 AND g{p}.w = m.w // {p}" for p in PLAN.prime_basis)
_MAG = " + ".join(f"coalesce(grad_p{p} * grad_p{p}, 0)" for p in PLAN.prime_basis)


@query(
    "gradient",
    f"WITH {MEANS}, g AS (SELECT m.channel, m.win, m.bin, lead(m.mean) OVER (PARTITION BY m.channel, m.win ORDER BY m.bin) - m.mean AS grad_t, {_GRAD} FROM m {_GRAD_JOIN}) "
    f"SELECT channel, win, bin, round(grad_t / 997, 5) + 0.0 AS grad_t, {', '.join(f'round(grad_p{p} / 997, 5) + 0.0 AS grad_p{p}' for p in PLAN.prime_basis)}, round(sqrt({_MAG}) / 997, 5) + 0.0 AS grad_scale_mag FROM g",
)
def _(spark, d):
    names = ["grad_t", *[f"grad_p{p}" for p in PLAN.prime_basis], "grad_scale_mag"]
    return cells(surface_ops.gradient(means(spark, d), PLAN, BY), *[scaled(n) for n in names])


@query("stack", f"{_ROLLED} SELECT channel, win, bin, mean AS measured_mean, round(base / 997, 5) + 0.0 AS rolled_mean FROM b")
def _(spark, d):
    x = means(spark, d)
    return cells(surface_ops.stack([("measured", x), ("rolled", surface_ops.baseline(x, BY, "rolling_mean"))], BY), "measured_mean", scaled("rolled_mean"))


_Z = f"WITH {MEANS}, z AS (SELECT *, (mean - avg(mean) OVER p) / nullif(stddev_pop(mean) OVER p, 0) AS z FROM m WINDOW p AS (PARTITION BY channel, win))"


@query("surface_zscores", f"{_Z} SELECT channel, win, bin, round(z, 5) AS z FROM z")
def _(spark, d):
    return cells(surface_ops.zscores(means(spark, d), BY), r("z", 5))


@query("surface_zscores_mad", f"WITH {MEANS}, a AS (SELECT *, median(mean) OVER (PARTITION BY channel, win) AS md FROM m), b AS (SELECT *, 1.4826 * median(abs(mean - md)) OVER (PARTITION BY channel, win) AS s FROM a) SELECT channel, win, bin, CASE WHEN s > 0 THEN round((mean - md) / s, 5) END AS z FROM b")
def _(spark, d):
    return cells(surface_ops.zscores(means(spark, d), BY, robust=True), r("z", 5))


@query("surface_heatmap", f"{_Z} SELECT channel, win, bin, round(greatest(least(z, 4), -4), 5) AS z FROM z")
def _(spark, d):
    return sinks.heatmap(means(spark, d), BY).select("channel", F.col("window").alias("win"), "bin", r("z", 5))


@query("surface_peaks", f"{_Z}, t AS (SELECT channel, win, max(abs(z)) AS pz FROM z GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY pz DESC, win) AS rank FROM t) SELECT channel, win, round(pz, 5) AS peak_z, rank FROM k WHERE rank <= 4")
def _(spark, d):
    return surface_ops.peaks(means(spark, d), BY, top=4).select("channel", F.col("window").alias("win"), r("peak_z", 5), F.col("rank").cast("long"))


@query("hilbert")
def _(spark, d):
    return cells(surface_ops.hilbert(means(spark, d), BY), "mean", r("amplitude"), r("phase"), r("inst_freq"))


# --- features ------------------------------------------------------------------------------------


def _features(spark, d, *names):
    return features.engineer(means(spark, d), PLAN, BY, features=names)


@query("feature_delta_rate", f"WITH {MEANS}, x AS (SELECT *, mean - lag(mean) OVER (PARTITION BY channel, win ORDER BY bin) AS delta FROM m) SELECT channel, win, bin, round(delta / 997, 5) + 0.0 AS mean_delta, CASE WHEN coverage > 0 THEN round(delta / greatest(coverage, 1e-9) / 997, 5) END AS mean_rate FROM x")
def _(spark, d):
    return cells(_features(spark, d, "delta", "rate"), scaled("mean_delta"), scaled("mean_rate"))


@query("feature_rolling_median", f"WITH {MEANS} SELECT channel, win, bin, round(quantile_cont(mean, 0.5) OVER (PARTITION BY channel, win ORDER BY bin ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 997, 5) + 0.0 AS mean_baseline_rmed FROM m")
def _(spark, d):
    return cells(_features(spark, d, "baseline_rmed"), scaled("mean_baseline_rmed"))


_COVER = " ".join(f"WHEN {w} THEN {c}" for w in PLAN.windows if (c := PLAN.cover(w)))


@query("feature_lattice_gradient", f"WITH {MEANS}, c AS (SELECT *, CASE win {_COVER} END AS up FROM m) SELECT c.channel, c.win, c.bin, round((c.mean - u.mean) / 997, 5) + 0.0 AS mean_gradient FROM c LEFT JOIN m u ON u.channel = c.channel AND u.bin = c.bin AND u.win = c.up")
def _(spark, d):
    return cells(_features(spark, d, "gradient"), scaled("mean_gradient"))


_FILLED = f"WITH RECURSIVE {MEANS}, {_SMOOTH.format(a=0.3)}, x AS (SELECT channel, win, bin, mean, state, mean - state AS res FROM s)"


@query("feature_ewma_residual", f"{_FILLED} SELECT channel, win, bin, round(state / 997, 5) + 0.0 AS mean_baseline_ewma, round(res / 997, 5) + 0.0 AS mean_residual FROM x")
def _(spark, d):
    return cells(_features(spark, d, "baseline_ewma", "residual"), scaled("mean_baseline_ewma"), scaled("mean_residual"))


@query("feature_zscore", f"{_FILLED}, a AS (SELECT *, median(res) OVER (PARTITION BY channel, win) AS md, count(res) OVER (PARTITION BY channel, win) AS n FROM x), b AS (SELECT *, median(abs(res - md)) OVER (PARTITION BY channel, win) AS mad FROM a) SELECT channel, win, bin, CASE WHEN n >= 2 AND mad > 0 THEN round(res / (1.4826 * mad), 4) + 0.0 END AS mean_zscore FROM b")
def _(spark, d):
    return cells(_features(spark, d, "baseline_ewma", "residual", "zscore"), (F.round("mean_zscore", 4) + 0.0).alias("mean_zscore"))


@query("assemble_long", f"WITH {MEANS}, x AS (SELECT channel, w, bin, mean, mean - lag(mean) OVER (PARTITION BY channel, win ORDER BY bin) AS delta FROM m), l AS (SELECT channel || '/value/mean' AS channel_name, w AS scale, bin, mean AS value FROM x UNION ALL SELECT channel || '/value/mean_delta', w, bin, delta FROM x) SELECT '_' AS entity, channel_name, dense_rank() OVER (ORDER BY channel_name) - 1 AS channel_idx, scale, bin, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 0) + 0.0 AS value FROM l")
def _(spark, d):
    out = features.assemble([_features(spark, d, "delta")], BY, binning.canonical_keys({}))
    return out.select("entity", "channel_name", F.col("channel_idx").cast("long"), "scale", "bin", (F.round(F.col("value").cast("double"), 0) + 0.0).alias("value"))


# --- information ---------------------------------------------------------------------------------

_LOGS = "log2(sum({c})) - coalesce(sum({c} * log2({c})) FILTER (WHERE {c} > 0), 0) / sum({c})"
_H = "CASE WHEN sum({c}) > 0 THEN greatest(0, " + _LOGS + ") ELSE 0 END"


@query("entropy_surface", f"WITH {PAIRED} SELECT channel, win, bin, CASE WHEN sum(n_events) > 0 THEN round(greatest(0, {_LOGS.format(c='n_events')}), 6) END AS entropy, CASE WHEN sum(n_events) > 0 THEN CAST(sum(n_events) AS DOUBLE) END AS \"count\" FROM paired GROUP BY 1, 2, 3")
def _(spark, d):
    return cells(information.entropy_surface(hourly(spark, d), PLAN, BY), r("entropy"), "count")


def _two(a: str, b: str) -> str:
    """Aligned counts of two channels, paired with the windows."""
    win = PAIRED[PAIRED.index("win(w, h)") : PAIRED.index("),\npaired") + 1]
    return f"""{HOURLY}, e AS (SELECT min(bin) AS lo, max(bin) AS hi FROM binned WHERE channel IN ('{a}', '{b}')), s AS (SELECT unnest(range(lo, hi + 1)) AS bin FROM e),
al AS (SELECT s.bin, coalesce(x.n_events, 0) AS a, coalesce(y.n_events, 0) AS b FROM s LEFT JOIN binned x ON x.bin = s.bin AND x.channel = '{a}' LEFT JOIN binned y ON y.bin = s.bin AND y.channel = '{b}'), {win},
pr AS (SELECT t.bin, w.w * 3600 AS win, u.a, u.b FROM al t CROSS JOIN win w JOIN al u ON u.bin >= t.bin AND u.bin < t.bin + w.w)"""


def _pair(spark, d, a, b):
    x = hourly(spark, d).withColumn("one", F.lit(1))
    return [x.where(F.col("channel") == c).select("one", "bin", "n_events") for c in (a, b)]


@query(
    "divergence_surface",
    f"WITH {_two('click', 'view')} SELECT win, bin, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN CASE WHEN coalesce(sum(a) FILTER (WHERE a > 0 AND b > 0), 0) = 0 THEN 999 "
    "ELSE round(sum(a * log2(a / b)) FILTER (WHERE a > 0 AND b > 0) / sum(a) + sum(a) FILTER (WHERE a > 0 AND b > 0) / sum(a) * log2(sum(b) / sum(a)), 6) + 0.0 END END AS kl_divergence FROM pr GROUP BY 1, 2",
)
def _(spark, d):
    s = information.divergence_surface(*_pair(spark, d, "click", "view"), PLAN, ["one"])
    kl = F.when(F.col("kl_divergence") == float("inf"), 999.0).otherwise(F.round("kl_divergence", 6) + 0.0)
    return cells(s, kl.alias("kl_divergence"), by=[])


@query(
    "mutual_information_surface",
    f"WITH {_two('click', 'view')}, j AS (SELECT win, bin, a, b, count(*) AS n FROM pr GROUP BY 1, 2, 3, 4), h AS (SELECT win, bin, {_H.format(c='n')} AS hj FROM j GROUP BY 1, 2), "
    f"x AS (SELECT win, bin, {_H.format(c='a')} AS ha, {_H.format(c='b')} AS hb, sum(a) + sum(b) AS t FROM pr GROUP BY 1, 2) "
    "SELECT win, bin, CASE WHEN t > 0 THEN round(ha + hb - hj, 6) + 0.0 END AS mi, CASE WHEN t > 0 THEN round(ha, 6) END AS entropy_a, CASE WHEN t > 0 THEN round(hb, 6) END AS entropy_b FROM x JOIN h USING (win, bin)",
)
def _(spark, d):
    s = information.mutual_information_surface(*_pair(spark, d, "click", "view"), PLAN, ["one"])
    return cells(s, (F.round("mi", 6) + 0.0).alias("mi"), r("entropy_a"), r("entropy_b"), by=[])


@query(
    "information_gain_surface",
    f"""WITH {PAIRED}, c AS (SELECT channel, win, bin, b_bin, max(b_bin) OVER p AS last, sum(n_events) OVER (PARTITION BY channel, win, bin ORDER BY b_bin) AS l, sum(n_events) OVER p AS t, n_events FROM paired WINDOW p AS (PARTITION BY channel, win, bin)),
g AS (SELECT *, l / nullif(t, 0) AS p FROM c), h AS (SELECT *, CASE WHEN p > 0 AND p < 1 AND b_bin < last THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END AS gain FROM g)
SELECT channel, win, bin, CASE WHEN max(t) > 0 THEN round(max(gain), 6) END AS information_gain, CASE WHEN max(t) > 0 THEN round(greatest(0, {_LOGS.format(c='n_events')}), 6) END AS entropy FROM h GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return cells(information.information_gain_surface(hourly(spark, d), PLAN, BY), r("information_gain"), r("entropy"))


@query("channel_entropy", f"WITH {CENTS}, c AS (SELECT channel, user_id, ord // 3600 AS o, count(*) AS n FROM rec GROUP BY 1, 2, 3) SELECT channel, user_id, round({_H.format(c='n')}, 6) AS entropy, count(*) AS events FROM c GROUP BY 1, 2")
def _(spark, d):
    from ..operators.analysis import channel_entropy

    sig = binning.bin_signal(events(spark, d), HOUR, ["channel", "user_id"]).withColumn("value", F.col("n_events"))
    return channel_entropy(sig, ["channel", "user_id"]).select("channel", "user_id", r("entropy"), "events")


_PAIRS = f"WITH {DENSE}, p AS (SELECT x.bin // 24 AS day, x.n_events AS a, y.n_events AS b FROM dense x JOIN dense y ON x.bin = y.bin WHERE x.channel = 'click' AND y.channel = 'view')"


def _pairs(spark, d):
    x = binning.densify(hourly(spark, d), BY).withColumn("n", F.coalesce("n_events", F.lit(0)))
    side = lambda c, n: x.where(F.col("channel") == c).select("bin", F.col("n").alias(n))
    return side("click", "a").join(side("view", "b"), "bin").withColumn("day", F.floor(F.col("bin") / 24))


_JOINT = f"{_PAIRS}, j AS (SELECT day, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3), h AS (SELECT day, {_H.format(c='n')} AS hj FROM j GROUP BY 1)"


@query("joint_entropy", f"{_JOINT} SELECT day, round(hj, 6) AS joint_entropy FROM h")
def _(spark, d):
    return information.joint_entropy(_pairs(spark, d), ["day"], "a", "b").select("day", r("joint_entropy"))


@query("mutual_information", f"{_JOINT}, e AS (SELECT day, {_H.format(c='a')} AS ha, {_H.format(c='b')} AS hb FROM p GROUP BY 1) SELECT day, round(ha + hb - hj, 6) + 0.0 AS mi FROM e JOIN h USING (day)")
def _(spark, d):
    return information.mutual_information(_pairs(spark, d), ["day"], "a", "b").select("day", (F.round("mi", 6) + 0.0).alias("mi"))


@query("kl_divergence", f"{_PAIRS} SELECT day, CASE WHEN sum(a) <= 0 OR sum(b) <= 0 THEN 0 WHEN coalesce(sum(a) FILTER (WHERE a > 0 AND b > 0), 0) = 0 THEN 999 ELSE round(sum(a * log2(a / b)) FILTER (WHERE a > 0 AND b > 0) / sum(a) + sum(a) FILTER (WHERE a > 0 AND b > 0) / sum(a) * log2(sum(b) / sum(a)), 6) END AS kl FROM p GROUP BY 1")
def _(spark, d):
    got = _pairs(spark, d).groupBy("day").agg(information.kl_divergence(F.col("a"), F.col("b")).alias("kl"))
    return got.select("day", F.when(F.col("kl") == float("inf"), 999.0).otherwise(F.round("kl", 6)).alias("kl"))


_SPLIT = f"WITH {DENSE}, c AS (SELECT channel, bin, row_number() OVER (PARTITION BY channel ORDER BY bin) AS pos, count(*) OVER (PARTITION BY channel) AS n, sum(n_events) OVER (PARTITION BY channel ORDER BY bin) / sum(n_events) OVER (PARTITION BY channel) AS p FROM dense), g AS (SELECT channel, bin, pos, n, CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END AS gain FROM c)"


def _dense(spark, d):
    return binning.densify(hourly(spark, d), BY).withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query("information_gain", f"{_SPLIT} SELECT channel, pos, round(gain, 6) AS gain FROM g")
def _(spark, d):
    return information.splits(_dense(spark, d), BY).select("channel", F.col("pos").cast("long"), r("gain"))


@query("best_split", f"{_SPLIT} SELECT channel, arg_min(pos, (-gain, pos)) AS pos, round(max(gain), 6) AS gain FROM g WHERE pos >= 1 AND pos < n - 1 GROUP BY 1")
def _(spark, d):
    return information.best_split(_dense(spark, d), BY).select("channel", F.col("pos").cast("long"), r("gain"))


#: The profile of all divisors of 720 hours, and the walk over them: a scale that gains or has one cell opens those a prime step below.
_WALK = f"""WITH RECURSIVE {REC}, m AS (SELECT ord // 3600 AS b, count(*) AS m FROM rec GROUP BY 1), size AS (SELECT min(b) AS lo, max(b) - min(b) + 1 AS n FROM m),
d AS (SELECT w, n FROM range(1, 721) t(w), size WHERE 720 % w = 0),
c AS (SELECT w, CASE WHEN w > n THEN b - lo ELSE (b - lo) // w END AS cell, sum(m) AS m FROM m, size JOIN d USING (n) WHERE w > n OR (b - lo) // w < n // w GROUP BY 1, 2),
t AS (SELECT w, sum(m) AS total, greatest(0, log2(sum(m)) - sum(m * log2(m)) / sum(m)) AS entropy FROM c GROUP BY 1),
g AS (SELECT w, unnest(range(n // w)) AS cell, n // w AS bins FROM d WHERE w <= n),
p AS (SELECT g.w, cell, bins, sum(coalesce(m, 0)) OVER (PARTITION BY g.w ORDER BY cell) / total AS p FROM g LEFT JOIN c USING (w, cell) JOIN t ON t.w = g.w),
s AS (SELECT w, max(CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END) AS gain FROM p WHERE cell <= bins - 3 GROUP BY 1),
f AS (SELECT w, w > n AS wide, greatest(1, n // w) AS bins, total, entropy, coalesce(gain, 0) AS gain FROM d JOIN t USING (w) LEFT JOIN s USING (w)),
walk(w) AS (SELECT 720 UNION SELECT w // x FROM walk JOIN f USING (w), (VALUES (2), (3), (5)) v(x) WHERE w % x = 0 AND (wide OR total >= 2) AND (gain >= 0.0001 OR bins = 1)),
found AS (SELECT w * 3600 AS win, bins, round(entropy, 6) AS entropy, round(gain, 6) AS gain FROM walk JOIN f USING (w) WHERE wide OR total >= 2)"""


@query("discover_scales", f"{_WALK} SELECT win, bins, entropy, gain FROM found")
def _(spark, d):
    sig = binning.records_to_signals(events(spark, d), [], "count")
    rows = [(s["window"], s["bins"], round(s["entropy"], 6), round(s["gain"], 6)) for s in information.discover_scales(sig, 720 * HOUR, HOUR, 0.0001)]
    return spark.createDataFrame(rows, "win long, bins long, entropy double, gain double")


@query("discover_plan", f"{_WALK} SELECT row_number() OVER (ORDER BY win) - 1 AS scale_idx, win, 3600 AS hop, win // 3600 AS w_bins, 1 AS h_bins FROM found WHERE gain > 0 OR win = 2592000")
def _(spark, d):
    sig = binning.records_to_signals(events(spark, d), [], "count")
    return information.discover_plan(sig, 720 * HOUR, HOUR, 0.0001).dataframe(spark).selectExpr("scale_idx", "window AS win", "hop", "w_bins", "h_bins")


_POINTS = f"{CENTS}, pts AS (SELECT channel, ord, avg(value) AS v FROM rec GROUP BY 1, 2), binned AS (SELECT channel, ord // 3600 AS bin, avg(v) AS value, count(*) AS n_events FROM pts GROUP BY 1, 2)"


@query("measure_signal", surface_sql("round(avg(value) / 997, 5) + 0.0 AS mean, CAST(sum(n_events) AS BIGINT) AS n_events").replace(HOURLY, _POINTS))
def _(spark, d):
    s = surface.measure_signal(binning.records_to_signals(cents(spark, d), BY, "mean"), PLAN, BY)
    return cells(s, scaled("mean"), "n_events")


@query("folded_day", f"WITH {REC} SELECT ((ord - (SELECT min(ord) FROM rec)) % 86400) // 1800 AS slot, count(*) AS n FROM rec GROUP BY 1")
def _(spark, d):
    return information.folded_day(events(spark, d), 1800)


@query("scalemap", f"WITH {REC}, f AS (SELECT ((ord - (SELECT min(ord) FROM rec)) % 86400) // 600 AS slot, count(*) AS n FROM rec GROUP BY 1), c AS (SELECT w.w AS win, h, h * 6 AS lo, least(h * 6 + greatest(w.w // 600, 6), 144) AS hi FROM (VALUES (3600), (7200), (21600), (86400)) w(w), range(24) t(h)) SELECT win, h AS hour, round({_H.format(c='n')}, 6) AS entropy FROM c JOIN f ON slot >= lo AND slot < hi GROUP BY 1, 2")
def _(spark, d):
    return information.scalemap(events(spark, d), [3600, 7200, 21_600, 86_400], 600).select(F.col("window").alias("win"), F.col("hour").cast("long"), r("entropy"))
