"""Segments, joins between them, analysis of entities, lattice grids and conversions of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, binning, segments
from ..plans import neighborhood
from ..plans.lattice import SamplingPlan
from ..sources import records as sources
from .common import GAP, HOUR, REC, events, orders, query, r

USER = ["user_id"]
_SEG = f"""{REC}, f AS (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY user_id ORDER BY ord, seq) > {GAP} THEN 1 ELSE 0 END AS new FROM rec),
ev AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ord, seq) AS BIGINT) AS seg_id FROM f),
seg AS (SELECT user_id, seg_id, min(ord) AS s, max(ord) AS e, max(ord) - min(ord) AS duration, count(*) AS event_count, count(DISTINCT channel) AS n_channels FROM ev GROUP BY 1, 2)"""


def cut(spark, d):
    return segments.split_by_gap(events(spark, d), USER, GAP)


def sessions(spark, d):
    return segments.make_segments(cut(spark, d), USER)


def _plain(df, *more):
    return df.select("user_id", F.col("seg_id").cast("long"), F.col("start").alias("s"), F.col("end").alias("e"), "duration", F.col("event_count").cast("long"), *more)


@query("sessions_gap", f"WITH {_SEG} SELECT user_id, seg_id, s, e, duration, event_count, n_channels FROM seg")
def _(spark, d):
    return _plain(sessions(spark, d), F.size("channels").cast("long").alias("n_channels"))


_GAPS = f"{REC}, g AS (SELECT user_id, ord - lag(ord) OVER (PARTITION BY user_id ORDER BY ord) AS gap FROM rec), p AS (SELECT * FROM g WHERE gap > 0)"
_FD = "2 * (quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25)) / cbrt(count(*))"


@query("session_gap_threshold", f"WITH {_GAPS} SELECT CAST(floor(greatest(3 * {_FD}, 5 * quantile_cont(gap, 0.5))) AS BIGINT) AS threshold FROM p")
def _(spark, d):
    return spark.createDataFrame([(segments.gap_threshold(events(spark, d), USER),)], "threshold long")


@query("session_stats", f"WITH {_SEG} SELECT count(DISTINCT user_id) AS n_entities, count(*) AS n_segments, round(avg(duration), 4) AS mean_duration, median(duration) AS median_duration, round(stddev_pop(duration), 4) AS std_duration, min(duration) AS min_duration, max(duration) AS max_duration, round(avg(event_count), 6) AS mean_events FROM seg")
def _(spark, d):
    return segments.segment_stats(sessions(spark, d), USER).withColumns({"mean_duration": F.round("mean_duration", 4), "std_duration": F.round("std_duration", 4), "mean_events": F.round("mean_events", 6)})


@query("session_channels", f"WITH {_SEG} SELECT user_id, seg_id, channel, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def _(spark, d):
    return sessions(spark, d).select("user_id", F.col("seg_id").cast("long"), F.explode("channels").alias("channel", "n"))


_LAB = f"{_SEG}, lab AS (SELECT *, CASE WHEN event_count = 1 THEN 'single_event' WHEN duration < 5 AND event_count > 1 THEN 'short_burst' ELSE 'normal' END AS label FROM seg)"


@query("session_labels", f"WITH {_LAB} SELECT user_id, seg_id, label FROM lab")
def _(spark, d):
    return segments.label_segments(sessions(spark, d)).select("user_id", F.col("seg_id").cast("long"), "label")


@query("session_summary", f"WITH {_LAB} SELECT label, count(*) AS \"count\", round(avg(duration), 4) AS mean_duration, round(stddev_pop(duration), 4) AS std_duration, round(avg(event_count), 6) AS mean_events FROM lab GROUP BY 1")
def _(spark, d):
    return segments.segment_summary(segments.label_segments(sessions(spark, d))).select("label", "count", r("mean_duration", 4), r("std_duration", 4), r("mean_events"))


@query("session_channel_summary", f"WITH {_LAB}, c AS (SELECT user_id, seg_id, channel, count(*) AS n FROM ev GROUP BY 1, 2, 3) SELECT label, channel, round(avg(n), 6) AS mean_count FROM lab JOIN c USING (user_id, seg_id) GROUP BY 1, 2")
def _(spark, d):
    return segments.segment_channel_summary(segments.label_segments(sessions(spark, d))).select("label", "channel", r("mean_count"))


@query(
    "session_features",
    f"""WITH {_SEG}, c AS (SELECT user_id, seg_id, count(*) FILTER (WHERE channel = 'click') AS click, count(*) FILTER (WHERE channel = 'error') AS error FROM ev GROUP BY 1, 2)
SELECT user_id, seg_id, event_count / greatest(duration, 1) AS event_rate, CAST(click AS DOUBLE) AS count_click, click / event_count AS ratio_click, CAST(error AS DOUBLE) AS count_error, error / event_count AS ratio_error,
((click > 0)::INT + (error > 0)::INT) / 2 AS channel_diversity FROM seg JOIN c USING (user_id, seg_id)""",
)
def _(spark, d):
    f = segments.segment_features(sessions(spark, d), ["click", "error"])
    return f.select("user_id", F.col("seg_id").cast("long"), "event_rate", "count_click", "ratio_click", "count_error", "ratio_error", "channel_diversity")


@query("sessions_to_signals", f"WITH {_SEG}, b AS (SELECT ev.user_id, ev.seg_id, (ord - s) // 900 AS bin, count(*) AS n FROM ev JOIN seg ON ev.user_id = seg.user_id AND ev.seg_id = seg.seg_id GROUP BY 1, 2, 3), sp AS (SELECT user_id, seg_id, unnest(range(0, duration // 900 + 1)) AS bin FROM seg) SELECT sp.user_id, sp.seg_id, sp.bin, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM sp LEFT JOIN b ON sp.user_id = b.user_id AND sp.seg_id = b.seg_id AND sp.bin = b.bin")
def _(spark, d):
    return segments.segments_to_signals(cut(spark, d), USER, 900).withColumn("seg_id", F.col("seg_id").cast("long"))


@query("session_peaks")
def _(spark, d):
    plan = SamplingPlan.from_windows([900, 1800, 3600], 900)
    return segments.segment_peaks(cut(spark, d), USER, plan).select("user_id", F.col("seg_id").cast("long"), F.col("window").alias("win"), r("peak_z"))


#: Sessions of (user, channel), joined by user or by channel.
_UC = f"""{REC}, f AS (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY user_id, channel ORDER BY ord, seq) > 86400 THEN 1 ELSE 0 END AS new FROM rec),
ev AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id, channel ORDER BY ord, seq) AS BIGINT) AS seg_id FROM f),
seg AS (SELECT user_id, channel, seg_id, min(ord) AS s, max(ord) AS e, count(*) AS event_count FROM ev GROUP BY 1, 2, 3)"""


def _user_channel(spark, d):
    rec = events(spark, d).withColumn("kind", F.col("channel"))
    return segments.make_segments(segments.split_by_gap(rec, ["user_id", "kind"], 86_400), ["user_id", "kind"])


def _joined(out):
    return out.select("user_id", F.col("kind").alias("channel"), F.col("seg_id").cast("long"), "join_user_id_segments", "join_user_id_entities", F.col("join_user_id_events").cast("long"), "join_user_id_fanout_kind", r("join_user_id_self_frac"))


_JOIN = "SELECT a.user_id, a.channel, a.seg_id, count(*) AS join_user_id_segments, count(DISTINCT (b.user_id, b.channel)) AS join_user_id_entities, CAST(sum(b.event_count) AS BIGINT) AS join_user_id_events, count(DISTINCT b.channel) AS join_user_id_fanout_kind, round(any_value(a.event_count) / sum(b.event_count), 6) AS join_user_id_self_frac FROM seg a JOIN seg b ON a.user_id = b.user_id"


@query("join_segments", f"WITH {_UC} {_JOIN} GROUP BY 1, 2, 3")
def _(spark, d):
    return _joined(segments.join_segments(_user_channel(spark, d), "user_id", ["user_id", "kind"]))


@query("join_segments_window", f"WITH {_UC} {_JOIN} AND (abs(a.s - b.s) <= 43200 OR (b.s <= a.e + 43200 AND b.e >= a.s - 43200)) GROUP BY 1, 2, 3")
def _(spark, d):
    return _joined(segments.join_segments(_user_channel(spark, d), "user_id", ["user_id", "kind"], 43_200))


@query("session_most_common", f"WITH {_SEG}, c AS (SELECT user_id, seg_id, channel, count(*) AS n, min((ord, seq)) AS f FROM ev GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg_id ORDER BY n DESC, f) AS i FROM c) SELECT user_id, seg_id, channel FROM k WHERE i = 1")
def _(spark, d):
    return segments.most_common(cut(spark, d), USER, "channel").withColumn("seg_id", F.col("seg_id").cast("long"))


@query("sessions_information_gain")
def _(spark, d):
    return _plain(segments.discover_segments(events(spark, d), USER, "information_gain"))


@query("sessions_lattice")
def _(spark, d):
    return _plain(segments.discover_segments(events(spark, d), USER, "lattice"))


_FAM = f"""{_GAPS}, lim AS (SELECT user_id, greatest(1, CAST(floor(3 * quantile_cont(gap, 0.5)) AS BIGINT)) AS lim FROM p GROUP BY 1),
f AS (SELECT rec.*, CASE WHEN ord - lag(ord) OVER (PARTITION BY rec.user_id ORDER BY ord, seq) > coalesce(lim, 1) THEN 1 ELSE 0 END AS new FROM rec LEFT JOIN lim ON rec.user_id = lim.user_id),
ev AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ord, seq) AS BIGINT) AS seg_id FROM f)"""


@query("family_sessions", f"WITH {_FAM} SELECT user_id, seg_id, min(ord) AS s, max(ord) AS e, max(ord) - min(ord) AS duration, count(*) AS event_count FROM ev GROUP BY 1, 2")
def _(spark, d):
    return _plain(analysis.family_sessions(events(spark, d), USER))


# --- analysis ------------------------------------------------------------------------------------

def _err():
    return F.col("channel") == "error"


@query("summary", f"WITH {REC} SELECT count(*) AS total_events, round((max(ord) - min(ord)) / 3600, 1) AS time_span_hours, round(avg(CASE WHEN channel = 'error' THEN 1.0 ELSE 0.0 END), 4) AS error_rate, count(DISTINCT user_id) AS unique_user_id, count(DISTINCT channel) AS unique_channel FROM rec")
def _(spark, d):
    return analysis.summary(events(spark, d), ["user_id", "channel"], _err())


@query("top_values", f"WITH {REC}, c AS (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM rec GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c) SELECT 'user_id' AS \"column\", value, n AS \"count\", rank FROM k WHERE rank <= 10")
def _(spark, d):
    return analysis.top_values(events(spark, d), "user_id").withColumn("rank", F.col("rank").cast("long"))


@query("estimate_grain", f"WITH {REC}, o AS (SELECT DISTINCT ord FROM rec), g AS (SELECT ord - lag(ord) OVER (ORDER BY ord) AS gap FROM o) SELECT greatest(60, CAST(floor(quantile_cont(gap, 0.5)) AS BIGINT)) AS grain FROM g")
def _(spark, d):
    return analysis.estimate_grain(events(spark, d)).select(F.col("grain").cast("long"))


@query("temporal_features", f"""WITH {REC}, h AS (SELECT user_id, (ord % 86400) // 3600 AS hour, count(*) AS n FROM rec GROUP BY 1, 2), g AS (SELECT hour, sum(n) / (SELECT count(*) FROM rec) AS g FROM h GROUP BY 1),
u AS (SELECT user_id, sum(n) AS t FROM h GROUP BY 1 HAVING sum(n) >= 5), grid AS (SELECT u.user_id, g.hour, g.g, coalesce(h.n, 0) AS n, t FROM u CROSS JOIN g LEFT JOIN h ON h.user_id = u.user_id AND h.hour = g.hour),
x AS (SELECT user_id, any_value(t) AS n, arg_min(hour, (-n, hour)) AS peak_hour, log2(sum(n)) - sum(n * log2(n)) FILTER (WHERE n > 0) / sum(n) AS te, sum(pow(n / t - g, 2) / g) AS an FROM grid GROUP BY 1)
SELECT user_id, CAST(n AS BIGINT) AS n, peak_hour, round(te, 3) AS temporal_entropy, round(te / log2(24), 3) AS spread, round(an, 4) AS anomaly FROM x""")
def _(spark, d):
    return analysis.temporal_features(events(spark, d), "user_id").withColumns({"peak_hour": F.col("peak_hour").cast("long"), "n": F.col("n").cast("long")}).withColumn("spread", F.col("spread"))


_CAP = "least(abs({z}), 5) / 5.0"


@query("session_scores", f"""WITH {_SEG}, st AS (SELECT avg(event_count) AS mn, greatest(stddev_pop(event_count), 0.01) AS sn, avg(duration) AS md, greatest(stddev_pop(duration), 0.01) AS sd, max(n_channels) AS mc FROM seg),
z AS (SELECT seg.*, (event_count - mn) / sn AS ez, (duration - md) / sd AS dz, mc FROM seg CROSS JOIN st)
SELECT user_id, seg_id, round(ez, 2) + 0.0 AS event_z, round(dz, 2) + 0.0 AS duration_z, round(1 / (1 + exp(-8 * (0.35 * {_CAP.format(z='ez')} + 0.25 * {_CAP.format(z='dz')} + 0.2 * n_channels / mc + 0.2 * ln(1 + event_count / (SELECT count(*) FROM rec) * 1000) / ln(1001) - 0.3))), 4) AS score FROM z""")
def _(spark, d):
    total = events(spark, d).count()
    return analysis.score_sessions(sessions(spark, d), total).select("user_id", F.col("seg_id").cast("long"), (F.col("event_z") + 0.0).alias("event_z"), (F.col("duration_z") + 0.0).alias("duration_z"), "score")


_SRC = "src AS (SELECT user_id, props AS source FROM events)"


@query("source_features", f"WITH {_SRC}, c AS (SELECT user_id, source, count(*) AS n FROM src GROUP BY 1, 2), t AS (SELECT user_id, count(*) AS unique_sources, sum(n) AS t, max(n) AS m, arg_min(source, (-n, source)) AS top_source FROM c GROUP BY 1) SELECT user_id, unique_sources, CAST(t AS BIGINT) AS total_events, top_source, round(m / t, 3) AS top_share, round(1 - m / t, 3) AS diversity FROM t")
def _(spark, d):
    return analysis.source_features(events(spark, d, "props"), "user_id", "props").withColumn("total_events", F.col("total_events").cast("long"))


@query("shared_sources", f"WITH {_SRC} SELECT source AS props, count(DISTINCT user_id) AS n_entities FROM src GROUP BY 1 HAVING count(DISTINCT user_id) >= 3")
def _(spark, d):
    return analysis.shared_sources(events(spark, d, "props"), "user_id", "props")


@query("error_rates", f"WITH {REC}, c AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE channel = 'error') AS errors FROM rec GROUP BY 1) SELECT user_id, total, errors, round(errors / total, 4) AS rate, errors / total > 2 * (SELECT sum(errors) / sum(total) FROM c) AND errors >= 5 AS flagged FROM c")
def _(spark, d):
    return analysis.error_rates(events(spark, d), "user_id", _err())


@query("top_errors", "WITH c AS (SELECT user_id, props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, props) AS rank FROM c) SELECT user_id, props, n AS \"count\", rank FROM k WHERE rank <= 5")
def _(spark, d):
    return analysis.top_errors(events(spark, d, "props").where(_err()), "user_id", "props").withColumn("rank", F.col("rank").cast("long"))


@query("mfa_features", f"WITH {REC} SELECT user_id, count(*) AS logins, count(*) FILTER (WHERE value > 100) AS with_mfa, count(*) - count(*) FILTER (WHERE value > 100) AS without_mfa FROM rec WHERE channel = 'signup' GROUP BY 1")
def _(spark, d):
    return analysis.mfa_features(events(spark, d), "user_id", F.col("channel") == "signup", F.col("value") > 100)


_PROFILE = f"{REC}, o AS (SELECT user_id, channel, ord // 3600 AS o, count(*) AS n FROM rec GROUP BY 1, 2, 3), pr AS (SELECT user_id, channel, greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS entropy, count(*) AS events FROM o GROUP BY 1, 2)"


def _profile(spark, d):
    sig = binning.bin_signal(events(spark, d), HOUR, ["user_id", "channel"]).withColumn("value", F.col("n_events"))
    return analysis.channel_entropy(sig, ["user_id", "channel"])


_SD = "greatest(CASE WHEN count(*) OVER {w} > 1 THEN stddev_pop({c}) OVER {w} ELSE 1 END, 0.01)"


@query("entity_scores", f"""WITH {_PROFILE}, z AS (SELECT *, (events - avg(events) OVER pc) / {_SD.format(c='events', w='pc')} AS cz, (events - avg(events) OVER pe) / {_SD.format(c='events', w='pe')} AS iz, abs(entropy - avg(entropy) OVER pc) / {_SD.format(c='entropy', w='pc')} AS nz,
1 - count(*) OVER pc / (SELECT count(DISTINCT user_id) FROM rec) AS rarity, events / (SELECT count(*) FROM rec) AS share FROM pr WINDOW pc AS (PARTITION BY channel), pe AS (PARTITION BY user_id))
SELECT user_id, channel, events, round(share, 4) AS share, round(rarity, 4) AS rarity, round(1 / (1 + exp(-8 * (0.3 * {_CAP.format(z='cz')} + 0.2 * {_CAP.format(z='iz')} + 0.15 * {_CAP.format(z='nz')} + 0.2 * rarity + 0.15 * ln(1 + share * 1000) / ln(1001) - 0.4))), 4) AS score FROM z""")
def _(spark, d):
    rec = events(spark, d)
    n, users = rec.agg(F.count("*"), F.count_distinct("user_id")).first()
    return analysis.entity_scores(_profile(spark, d), "user_id", n, users).select("user_id", "channel", "events", "share", "rarity", "score")


@query("behavioural_twins", f"""WITH {_PROFILE}, t AS (SELECT a.user_id AS entity_a, b.user_id AS entity_b, count(*) AS n_common, sum(a.events * b.events) / sqrt(sum(a.events * a.events) * sum(b.events * b.events)) AS c FROM pr a JOIN pr b ON a.channel = b.channel AND a.user_id < b.user_id GROUP BY 1, 2)
SELECT entity_a, entity_b, n_common, round(c, 4) AS similarity FROM t WHERE n_common >= 3 AND c > 0.95""")
def _(spark, d):
    return analysis.behavioural_twins(_profile(spark, d), "user_id").withColumn("n_common", F.col("n_common").cast("long"))


@query(
    "mi_pairs",
    f"""WITH {REC}, s AS (SELECT channel, ord // 86400 AS o, count(*) AS v FROM rec GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY o) AS i, count(*) OVER (PARTITION BY channel) AS len FROM s),
rk AS (SELECT channel, row_number() OVER (ORDER BY len DESC, channel) AS r FROM (SELECT DISTINCT channel, len FROM p)),
x AS (SELECT a.channel AS channel_a, b.channel AS channel_b, a.v AS va, b.v AS vb FROM p a JOIN p b ON a.i = b.i JOIN rk ra ON ra.channel = a.channel JOIN rk rb ON rb.channel = b.channel WHERE ra.r < rb.r),
e AS (SELECT channel_a, channel_b, log2(sum(va)) - sum(va * log2(va)) / sum(va) + log2(sum(vb)) - sum(vb * log2(vb)) / sum(vb) AS h FROM x GROUP BY 1, 2),
j AS (SELECT channel_a, channel_b, va, vb, count(*) AS n FROM x GROUP BY 1, 2, 3, 4), hj AS (SELECT channel_a, channel_b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hj FROM j GROUP BY 1, 2)
SELECT channel_a, channel_b, round(h - hj, 4) AS mi, 'within' AS kind FROM e JOIN hj USING (channel_a, channel_b) WHERE h - hj > 0""",
)
def _(spark, d):
    sig = binning.bin_signal(events(spark, d), 86_400, ["channel"]).select("channel", F.col("bin").alias("order"), F.col("n_events").alias("value"))
    return analysis.mi_pairs(sig, ["channel"])


@query("metadata_groups", f"WITH {REC} SELECT channel, arg_min(user_id, (ord, seq)) AS user_id FROM rec GROUP BY 1")
def _(spark, d):
    return analysis.metadata_groups(events(spark, d), "user_id")


@query("findings")
def _(spark, d):
    out = analysis.analyze(events(spark, d), "user_id", grain=HOUR, error=_err())["findings"]
    return spark.createDataFrame([(f["severity"], f["title"], f["description"]) for f in out], "severity string, title string, description string")


# --- widths, lattice, sources --------------------------------------------------------------------

_G = f"WITH {REC}, o AS (SELECT DISTINCT ord FROM rec), d AS (SELECT ord - lag(ord) OVER (ORDER BY ord) AS gap FROM o), g AS (SELECT gap FROM d WHERE gap > 0)"
_WIDTHS = {
    "freedman_diaconis": _FD, "scott": "cbrt(24 * sqrt(pi()) / count(*)) * stddev_pop(gap)", "sturges": "(max(gap) - min(gap)) / (log2(count(*)) + 1)",
    "rice": "(max(gap) - min(gap)) / (2 * cbrt(count(*)))", "sqrt": "(max(gap) - min(gap)) / sqrt(count(*))", "gcd_interval": None, "stone": None, "knuth": None,
    "auto": f"CASE WHEN {_FD} > 0 THEN least({_FD}, (max(gap) - min(gap)) / (log2(count(*)) + 1)) ELSE (max(gap) - min(gap)) / (log2(count(*)) + 1) END",
    "doane": "(max(gap) - min(gap)) / (1 + log2(count(*)) + log2(1 + abs(avg(pow(gap - (SELECT avg(gap) FROM g), 3)) / pow(stddev_pop(gap), 3)) / sqrt(6 * (count(*) - 2) / ((count(*) + 1) * (count(*) + 3)))))",
}
for _m, _sql in _WIDTHS.items():

    @query(f"interval_width_{_m}", f"{_G} SELECT round({_sql}, 6) AS width FROM g" if _sql else None)
    def _(spark, d, m=_m):
        gaps = segments.gaps(events(spark, d).select("order").distinct(), [])
        return spark.createDataFrame([(round(float(segments.interval_width(gaps, m)), 6),)], "width double")


@query("grain_from_orders", f"{_G}, w AS (SELECT greatest(1, round({_FD})) AS w FROM g) SELECT min(x) AS grain FROM range(1, 86401) t(x), w WHERE 86400 % x = 0 AND x >= w")
def _(spark, d):
    return spark.createDataFrame([(segments.grain_from_orders(events(spark, d), 86_400),)], "grain long")


_VAL = "len(list_filter(range(1, 20), lambda k: CAST(pow(p, k) AS HUGEINT) <= n AND n % CAST(pow(p, k) AS HUGEINT) = 0))"


@query("neighborhood", f"SELECT p AS prime, n, {_VAL} AS valuation FROM (VALUES (2), (3), (5), (7), (31), (37), (11), (17), (19), (13), (41)) b(p), range(30, 43) t(n)")
def _(spark, d):
    return neighborhood.neighborhood(spark, 36, 6).withColumns({"valuation": F.col("valuation").cast("long"), "prime": F.col("prime").cast("long")})


@query("valuations", f"SELECT n, {_VAL.replace('pow(p', 'pow(2')} AS v2, {_VAL.replace('pow(p', 'pow(3')} AS v3 FROM range(1, 5001) t(n)")
def _(spark, d):
    return spark.range(1, 5001).select(F.col("id").alias("n"), *[neighborhood.valuation_column(F.col("id"), p).cast("long").alias(f"v{p}") for p in (2, 3)])


@query("neighborhood_residuals", f"WITH g AS (SELECT p, n, {_VAL} AS v FROM (VALUES (2), (3), (5)) b(p), range(1, 101) t(n)) SELECT n, CAST(any_value(n) // product(pow(p, v)) AS BIGINT) AS residual, sum(v) = 1 AND max(v) = 1 AS is_prime_column FROM g GROUP BY n")
def _(spark, d):
    return neighborhood.residuals(neighborhood.neighborhood(spark, 51, 50, [2, 3, 5])).where("n <= 100")


@query("prices_to_long", "SELECT o_orderkey, metric, value FROM (SELECT o_orderkey, o_totalprice AS total, CAST(o_custkey AS DOUBLE) AS customer FROM orders) UNPIVOT (value FOR metric IN (total, customer))")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "o_totalprice AS total", "o_custkey AS customer")
    return sources.prices_to_long(o, ["o_orderkey"], ["total", "customer"])


@query("channels_to_rms", f"WITH {REC} SELECT ord / 256 AS t_sec, round(sqrt(avg(value * value)), 6) AS eeg_rms FROM rec GROUP BY ord")
def _(spark, d):
    return sources.channels_to_rms(events(spark, d), "order").select("t_sec", r("eeg_rms"))


@query("row_positions", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS _index FROM events")
def _(spark, d):
    return sources.with_positions(spark.read.parquet(f"{d}/events.parquet").select("event_id"))


@query("orders_records", "SELECT o_orderpriority AS channel, o_orderstatus AS status, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ord, o_totalprice AS value, o_orderkey AS seq FROM orders")
def _(spark, d):
    return orders(spark, d).withColumnRenamed("order", "ord")


