import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scaleloom.operators import analysis, binning, information, segments
from scaleloom.plans.lattice import SamplingPlan

REC = "user string, channel string, order long, value double, seq long"


def records(spark, rows):
    return spark.createDataFrame([(u, c, o, 1.0, i) for i, (u, c, o) in enumerate(rows)], REC)


BURSTS = [("u", "ab"[i % 2], o) for i, o in enumerate([0, 1, 2, 3, 1000, 1001, 1002, 5000])] + [("v", "a", 10), ("v", "b", 15)]


def test_gap_segments(spark):
    rec = records(spark, BURSTS)
    got = segments.discover_segments(rec, ["user"], threshold=100).orderBy("user", "seg_id").collect()
    assert [(r.user, r.start, r.end, r.event_count, r.channels) for r in got] == [("u", 0, 3, 4, {"a": 2, "b": 2}), ("u", 1000, 1002, 3, {"a": 2, "b": 1}), ("u", 5000, 5000, 1, {"b": 1}), ("v", 10, 15, 2, {"a": 1, "b": 1})]
    labels = {(r.user, r.seg_id): r.label for r in segments.label_segments(segments.discover_segments(rec, ["user"], threshold=100)).collect()}
    assert labels == {("u", 0): "short_burst", ("u", 1): "short_burst", ("u", 2): "single_event", ("v", 0): "normal"}
    with pytest.raises(ValueError):
        segments.discover_segments(rec, ["user"], "magic")


def test_threshold_is_exclusive_and_defaults(spark):
    rec = records(spark, [("u", "a", 0), ("u", "a", 10), ("u", "a", 21)])
    assert segments.discover_segments(rec, ["user"], threshold=10).count() == 2
    assert segments.gap_threshold(rec, ["user"]) == 105
    assert segments.gap_threshold(records(spark, [("u", "a", 5)]), ["user"]) == 100


def slow_cuts(counts, offset, length, min_gain, least, depth=20):
    if length < 2 * least or depth <= 0:
        return []
    c = counts[offset : offset + length]
    if c.sum() < 2 * least:
        return []
    h = lambda x: -sum(v / x.sum() * math.log2(v / x.sum()) for v in x if v) if x.sum() else 0.0
    best, at = 0.0, 0
    for i in range(least, length - least + 1):
        a, b = c[:i], c[i:]
        if a.sum() < least or b.sum() < least:
            continue
        g = h(c) - (a.sum() * h(a) + b.sum() * h(b)) / c.sum()
        if g > best + 1e-12:
            best, at = g, i
    if best < min_gain or best == 0:
        return []
    return [offset + at, *slow_cuts(counts, offset, at, min_gain, least, depth - 1), *slow_cuts(counts, offset + at, length - at, min_gain, least, depth - 1)]


def test_information_cuts_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = rng.poisson(rng.choice([0.2, 3.0], 24)).astype(float)
        held = np.flatnonzero(counts)
        assert segments.cut_points(held, counts[held], 24, 0.1, 2) == sorted(slow_cuts(counts, 0, 24, 0.1, 2))


def test_information_and_lattice_segments(spark):
    rec = records(spark, [("u", "a", o) for o in [*range(0, 60, 2), *range(5000, 5060, 2)]] + [("v", "a", 1)])
    for method in ("information_gain", "lattice"):
        got = segments.discover_segments(rec, ["user"], method).collect()
        assert sum(r.event_count for r in got) == 61 and any(r.start == 5000 for r in got) and all(not (r.start < 5000 <= r.end) for r in got)


def test_join_with_and_without_window(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i % 7}", f"k{i % 3}", i, int(s), int(s + rng.integers(0, 400)), int(rng.integers(1, 9))) for i, s in enumerate(rng.integers(0, 5000, 80))] + [("u0", None, 99, 5, 6, 1), ("u0", "", 98, 5, 6, 2)]
    seg = spark.createDataFrame(rows, "user string, key string, seg_id long, start long, end long, event_count long")
    for tw in (None, 0, 150):
        got = {r.seg_id: r for r in segments.join_segments(seg, "key", ["user"], tw).collect()}
        assert len(got) == len(rows)
        for u, k, i, s, e, n in rows:
            near = [x for x in rows if k and x[1] == k and (tw is None or abs(x[3] - s) <= tw or (x[3] <= e + tw and x[4] >= s - tw))]
            r = got[i]
            assert (r.join_key_segments, r.join_key_entities, r.join_key_events) == (len(near), len({x[0] for x in near}), sum(x[5] for x in near)), (tw, i)
            assert r.join_key_fanout_user == len({x[0] for x in near}) and r.join_key_self_frac == pytest.approx(n / sum(x[5] for x in near) if near else 1.0)


def test_segment_features(spark):
    rec = records(spark, BURSTS)
    ev = segments.split_by_gap(rec, ["user"], 100)
    f = {(r.user, r.seg_id): r for r in segments.segment_features(segments.make_segments(ev, ["user"]), ["a", "b", "z"]).collect()}
    assert f["u", 1].ratio_a == pytest.approx(2 / 3) and f["u", 2].channel_diversity == pytest.approx(1 / 3) and f["u", 0].event_rate == pytest.approx(4 / 3)
    sig = segments.segments_to_signals(ev, ["user"], 2).where("user = 'v'").orderBy("bin").collect()
    assert [r.value for r in sig] == [1.0, 0.0, 1.0]
    assert segments.most_common(ev, ["user"], "channel").where("user = 'v'").first().channel == "a"
    assert segments.segment_peaks(ev, ["user"], SamplingPlan.from_windows([1, 2], 1)).where("user = 'v'").count() == 2


def test_peaks_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    plan = SamplingPlan.from_windows([2, 4, 12], 2, [2, 4, 6])
    own = {f"u{k}": sorted(int(x) for x in rng.integers(0, n, m)) for k, (n, m) in enumerate([(40, 15), (6, 4), (3, 2), (500, 30), (300, 200), (9, 1)])}
    own["u6"], own["u7"] = list(range(0, 40, 2)), [7, 7, 7, 300, 900, 901]
    rec = records(spark, [(u, "a", o) for u, orders in own.items() for o in orders] + [(None, "a", 5), (None, "a", 50), (None, "a", 51)])
    want = {}
    for u, orders in own.items():
        counts = np.bincount([(o - orders[0]) // 2 for o in orders])
        for window, w, hop in zip(plan.windows, plan.scales, plan.hop_bins, strict=True):
            means = np.array([counts[i : i + w].mean() for i in range(0, len(counts), hop)])
            if len(counts) > 2 and np.ptp(means) > 0:
                want[u, window] = pytest.approx(np.abs((means - means.mean()) / means.std()).max(), abs=1e-9)
    for chunk in (4096, 1):  # a longest window of 6 makes chunks of 12 bins
        monkeypatch.setattr(segments, "CHUNK", chunk)
        got = segments.segment_peaks(segments.split_by_gap(rec, ["user"], 10_000), ["user"], plan).collect()
        assert {(r.user, r.window): r.peak_z for r in got} == want and len(got) == len(want) > 10


def test_peaks_hold_no_rows_of_bins(spark):
    rec = records(spark, [("u", "a", o) for o in (0, 3000, 4000, 9000)])
    out = segments.segment_peaks(segments.split_by_gap(rec, ["user"], 6000), ["user"], SamplingPlan.from_windows([5, 10, 20], 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("Sort ") == 2  # the records of an entity, then of its segments


def test_widths(spark):
    x = np.random.default_rng(1).gamma(2, 30, 400).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "gap double")
    for m, name in (("freedman_diaconis", "fd"), ("scott", "scott"), ("sturges", "sturges"), ("rice", None), ("sqrt", None), ("doane", "doane"), ("auto", "auto")):
        got = segments.interval_width(df, m)
        if m in ("freedman_diaconis", "scott"):  # numpy rounds the number of bins, so compare the rounded number
            edges = np.histogram_bin_edges(x, bins=name)
            assert math.ceil(np.ptp(x) / got) == len(edges) - 1
        elif name:
            assert math.ceil(np.ptp(x) / got - 1e-9) == len(np.histogram_bin_edges(x, bins=name)) - 1
    assert 1 < segments.interval_width(df, "stone") < np.ptp(x) and 1 < segments.interval_width(df, "knuth") < np.ptp(x)
    assert segments.interval_width(spark.createDataFrame([(60.0,), (90.0,), (150.0,)], "gap double"), "gcd_interval") == 30
    with pytest.raises(ValueError):
        segments.interval_width(df, "guess")


def test_grain(spark):
    rec = records(spark, [("u", "a", o) for o in range(0, 3600, 60)])
    assert segments.grain_from_orders(rec) == 60 and segments.grain_from_orders(rec, 86400) == 60
    assert segments.grain_from_orders(records(spark, [("u", "a", 0), ("u", "a", 7)])) == 7 and segments.grain_from_orders(records(spark, [("u", "a", 0)])) == 1


def test_entropy_family(spark):
    def h(*v):
        return spark.createDataFrame([(float(x),) for x in v] or [(None,)], "c double").agg(information.entropy(F.col("c"))).first()[0]

    assert h(1, 1, 1, 1) == pytest.approx(2) and h(5, 0, 0) == 0 and h(1, 1) == pytest.approx(1) and h() == 0 and h(0, 0) == 0
    pairs = spark.createDataFrame(list(zip([1, 1, 0, 0], [1, 0, 1, 0], strict=True)), "a int, b int").withColumn("g", F.lit(0))
    r = information.mutual_information(pairs, ["g"], "a", "b").first()
    assert r.joint_entropy == pytest.approx(2) and r.mi == pytest.approx(0)
    kl = lambda p, q: spark.createDataFrame(list(zip(map(float, p), map(float, q), strict=True)), "p double, q double").agg(information.kl_divergence(F.col("p"), F.col("q"))).first()[0]
    assert kl([1, 1], [1, 1]) == pytest.approx(0) and kl([1, 0], [0, 1]) == float("inf") and kl([0, 0], [1, 1]) == 0 and kl([3, 1], [1, 1]) == pytest.approx(0.75 * math.log2(1.5) + 0.25 * math.log2(0.5))


def test_best_split(spark):
    df = spark.createDataFrame([("c", i, n) for i, n in enumerate([4, 4, 0, 0, 8, 0])], "channel string, bin long, n_events long")
    assert tuple(information.best_split(df, ["channel"]).first())[1:] == (2, pytest.approx(1.0))


def test_scale_walk(spark):
    mass = spark.createDataFrame([(i, 5.0) for i in range(180)], "bin long, m double")
    scales = information.scales_of_mass(mass, 360, 360)
    assert scales[0] == {"window": 360, "entropy": 0.0, "gain": 0.0, "bins": 1} and any(s["gain"] > 0.9 for s in scales)
    assert [s["window"] for s in scales] == sorted((s["window"] for s in scales), reverse=True)
    assert information.scales_of_mass(mass.where("bin < 0"), 1, 4) == [] and information.scales_of_mass(mass.limit(1), 1, 4, min_events=9) == []
    sig = spark.createDataFrame([(i, 5.0) for i in range(180)] + [(359, 1.0)], "order long, value double")
    assert 360 in information.discover_plan(sig, 360).windows


def test_scale_profile_brute_force(spark, monkeypatch):
    monkeypatch.setattr(information, "CHUNK", 32)
    rng = np.random.default_rng(7)
    dense = rng.poisson(0.8, 200).astype(float)
    dense[0] = dense[-1] = 1
    held = np.flatnonzero(dense)
    mass = spark.createDataFrame([(int(i), float(dense[i])) for i in held], "bin long, m double")
    h = lambda c: -sum(x / c.sum() * math.log2(x / c.sum()) for x in c if x)
    for r in information.scale_profile(mass, 200, [1, 2, 7, 30, 66, 67, 100, 150, 300]).collect():
        n = 200 // r.width
        c = dense[: n * r.width].reshape(n, r.width).sum(axis=1) if n else dense
        gain = max((h(np.array([c[:i].sum(), c[i:].sum()])) for i in range(1, n - 1)), default=0.0)
        assert (r.bins, r.mass, r.entropy, r.gain) == (max(1, n), c.sum(), pytest.approx(h(c)), pytest.approx(gain)), r


def test_distances_without_a_key(spark):
    rng = np.random.default_rng(1)
    orders = sorted({int(x) for x in rng.integers(0, 10**6, 500)} | {0, 5 * 10**8})
    got = sorted(r.gap for r in segments.gaps(spark.createDataFrame([(x,) for x in orders * 2], "order long"), []).collect())
    assert got == sorted(np.diff(orders).tolist())
    frame = spark.createDataFrame([(int(x),) for x in [12, 30, 18, 600]], "gap long")
    assert segments.interval_width(frame, "gcd_interval") == 6 and segments.gaps(frame.selectExpr("gap order").limit(0), []).count() == 0


def test_twins_brute_force(spark, monkeypatch):
    monkeypatch.setattr(analysis, "TWIN_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(f"e{e}", f"c{c}", int(rng.integers(1, 9))) for e in range(40) for c in range(6) if rng.random() < 0.7]
    of = {}
    for e, c, n in rows:
        of.setdefault(e, {})[c] = n
    want = {}
    for a in of:
        for b in of:
            common = of[a].keys() & of[b].keys()
            if a < b and len(common) >= 3:
                x, y = (np.array([of[k][c] for c in sorted(common)], float) for k in (a, b))
                if (cos := x @ y / math.sqrt((x @ x) * (y @ y))) > 0.95:
                    want[a, b] = (len(common), round(cos, 4))
    got = {(r.entity_a, r.entity_b): (r.n_common, r.similarity) for r in analysis.behavioural_twins(spark.createDataFrame([*rows, (None, "c1", 3)], "e string, channel string, events long"), "e").collect()}
    assert got == want and len(want) > 10


def test_twins_in_bounded_blocks(spark, monkeypatch):
    rows = [(e, f"c{c}", 1 + (e * (c + 3)) % 11) for e in range(60) for c in range(4)]
    prof = spark.createDataFrame(rows, "e long, channel string, events long")
    want = {(r.entity_a, r.entity_b): (r.n_common, r.similarity) for r in analysis.behavioural_twins(prof, "e").collect()}
    for name, n in {"TWIN_BLOCK": 2, "TWIN_BLOCKS": 3, "TWIN_LARGEST": 2, "TWIN_SLAB": 1}.items():
        monkeypatch.setattr(analysis, name, n)
    blocks = analysis._twin_vectors(prof, "e", 3).groupBy("_n", "block").count().collect()
    assert {r._n for r in blocks} == {30} and len(blocks) < 30  # more than TWIN_BLOCKS, and some are empty
    got = analysis.behavioural_twins(prof, "e").collect()
    assert len(got) == len(want) > 100 and {(r.entity_a, r.entity_b): (r.n_common, r.similarity) for r in got} == want


def test_closest_twins_are_the_first_of_all(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(e), f"c{c}", int(rng.integers(1, 4))) for e in rng.permutation(90) for c in range(4) if rng.random() < 0.9]
    prof = spark.createDataFrame([*rows, (None, "c1", 3)], "e long, channel string, events long")
    whole = sorted((-r.similarity, r.entity_a, r.entity_b, r.n_common) for r in analysis.behavioural_twins(prof, "e").collect())
    ones = sum(w[0] == -1 for w in whole)
    assert 50 < ones < len(whole) - 100
    compared, compare = [], analysis._compare_twins
    monkeypatch.setattr(analysis, "_compare_twins", lambda cells, *a: compared.append(compare(cells, *a)) or compared[-1])
    for name, n in {"TWIN_BLOCK": 16, "TWIN_LARGEST": 16, "TWIN_SLAB": 5}.items():
        monkeypatch.setattr(analysis, name, n)
    for first, most, jobs in ((10, 3, 1), (90, ones, 1), (10, ones, 2), (10, ones + 50, 2), (200, len(whole) + 9, 2)):
        monkeypatch.setattr(analysis, "TWIN_FIRST", first)
        compared.clear()
        got = [(-r["similarity"], r["entity_a"], r["entity_b"], r["n_common"]) for r in analysis.closest_twins(prof, "e", most)]
        assert got == whole[:most] and len(compared) == jobs, (first, most)
        assert jobs == 1 or compared[-1].count() <= most * 21  # of six blocks


def test_rounded_as_spark_rounds(spark):
    x = [0.95005, 0.96875, 0.99995, 0.999949999999, 0.95015, 1.0000000002, -0.95005, 0.0, *np.random.default_rng(5).uniform(0.9, 1, 500), *(np.arange(9000, 10001) / 10000 + 0.00005)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i")
    assert analysis.rounded(np.array(x), 4).tolist() == [r.y for r in df.select(F.round("x", 4).alias("y")).collect()]


def test_analysis_pieces(spark):
    rec = records(spark, [(u, c, t) for u in ("a/x", "b/y", "c/z") for c in "pqr" for t in range(0, 86400, 3600 if u[0] != "c" else 7200)])
    s = analysis.summary(rec, ["user", "channel"], F.col("channel") == "p", {"user": "people"}).first()
    assert s.total_events == rec.count() and s.unique_user == s.unique_people == 3 and s.error_rate == pytest.approx(1 / 3, abs=1e-4)
    prof = analysis.channel_entropy(binning.records_to_signals(rec, ["user", "channel"], "count"), ["user", "channel"])
    twins = {(r.entity_a, r.entity_b): (r.n_common, r.similarity) for r in analysis.behavioural_twins(prof, "user").collect()}
    assert twins == {("a/x", "b/y"): (3, 1.0), ("a/x", "c/z"): (3, 1.0), ("b/y", "c/z"): (3, 1.0)}
    t = {r.user: r for r in analysis.temporal_features(rec, "user").collect()}
    assert t["a/x"].peak_hour == 0 and t["a/x"].spread == 1.0 and t["c/z"].anomaly > t["a/x"].anomaly
    out = analysis.analyze(rec, "user", analysis.AnalysisSchema(categorical=("user", "channel"), families={"f": {"events": ["p"], "session_key": "user"}, "none": {"events": ["p"]}}), grain=3600, error=F.col("channel") == "p")
    assert [f["severity"] for f in out["findings"]] == sorted((f["severity"] for f in out["findings"]), key=("concern", "attention", "info").index)
    assert "Behavioural twins" in {f["title"] for f in out["findings"]} and "Error rate" in {f["title"] for f in out["findings"]}
    assert set(out["families"]) == {"f"} and out["scores"].count() == 9 and out["pairwise_mi"].count() >= 0


def test_mutual_information_surface_runs(spark):
    a = spark.createDataFrame([(0, i, n) for i, n in enumerate([1, 2, 1, 3])], "one int, bin long, n_events long")
    out = information.mutual_information_surface(a, a, SamplingPlan.from_windows([4], 1), ["one"]).where("bin = 0").first()
    h = -sum(p * math.log2(p) for p in (1 / 7, 2 / 7, 1 / 7, 3 / 7))
    assert out.entropy_a == pytest.approx(h) and out.mi == pytest.approx(2 * h - 1.5)
    assert information.scalemap(records(spark, [("u", "a", 60 * i) for i in range(2000)]), [3600], 600).count() == 24
