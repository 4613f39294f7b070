import numpy as np
import pytest
from pyspark.sql import functions as F

from scaleloom.functions import aggregations as A
from scaleloom.operators import binning, features, surface, surface_ops, transforms
from scaleloom.plans import chain, graph
from scaleloom.plans.lattice import SamplingPlan

BINNED = "channel string, bin long, value double, n_events long"
REC = "channel string, user string, order long, value double, seq long"


def np_ewma(v):
    s = v[0]
    for x in v[1:]:
        s = 0.3 * x + 0.7 * s
    return s


def np_energy(v):
    y = (v - v.mean()) * np.hanning(len(v))
    return (np.abs(np.fft.rfft(y)) ** 2).sum() / len(v)


def np_entropy(v):
    p = np.histogram(v, bins=min(10, len(v)))[0] / len(v)
    return -(p[p > 0] * np.log2(p[p > 0])).sum()


def np_mode(v):
    u, c = np.unique(v, return_counts=True)
    return u[c.argmax()]


EXPECT = {
    "count": len, "sum": np.sum, "mean": np.mean, "min": np.min, "max": np.max, "median": np.median, "std": np.std, "var": np.var, "range": np.ptp, "first": lambda v: v[0], "last": lambda v: v[-1], "mode": np_mode,
    "p25": lambda v: np.percentile(v, 25), "p75": lambda v: np.percentile(v, 75), "p90": lambda v: np.percentile(v, 90), "p95": lambda v: np.percentile(v, 95), "p99": lambda v: np.percentile(v, 99),
    "geometric_mean": lambda v: np.exp(np.log(v[v > 0]).mean()) if (v > 0).any() else 0.0, "ewma": np_ewma, "spectral_energy": np_energy, "entropy": np_entropy, "dominant_freq": A.dominant_frequency,
}


def test_every_aggregation_both_ways(spark):
    rng = np.random.default_rng(3)
    groups = {0: np.array([4.0]), 1: np.array([-1.0, -2.0]), 2: np.full(5, 7.0), 3: np.round(rng.normal(size=9), 1), 4: rng.normal(size=16), 5: np.array([1.0, 2.0, 2.0, 1.0, 3.0])}
    rows = [(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(5)
    assert set(EXPECT) == set(A.aggregation_names())
    arrays = spark.createDataFrame([(g, v.tolist()) for g, v in groups.items()], "g int, a array<double>")
    for name, fn in EXPECT.items():
        agg = A.get_aggregation(name)
        got = dict(map(tuple, df.groupBy("g").agg(agg.over_rows(F.col("v"), F.col("i")).alias("x")).collect()))
        arr = dict(map(tuple, arrays.select("g", agg.array(F.col("a"))).collect()))
        for g, v in groups.items():
            assert got[g] == pytest.approx(fn(v), abs=1e-9), (name, g)
            assert arr[g] == pytest.approx(fn(v), abs=1e-9), (name, g)


def test_registry(spark):
    with pytest.raises(KeyError):
        A.get_aggregation("nope")
    A.register_aggregation("third", lambda a: a[2] if len(a) > 2 else -1.0)
    try:
        df = spark.createDataFrame([("c", i, float(i), 1) for i in range(6)], BINNED)
        out = surface.measure(df, SamplingPlan(3, 1, (3,), cbin=1), ["channel"], "third").orderBy("bin").collect()
        assert [r.third for r in out] == [2, 3, 4, 5, -1, -1]
    finally:
        del A._registry["third"]
    A.register_profile("mine", ["mean"])
    assert A.get_profile("mine") == ("mean",) and "event" in A.profile_names()
    with pytest.raises(KeyError):
        A.get_profile("none")


def test_signals_and_bins(spark):
    rec = spark.createDataFrame([("a", "u", 0, 1.0, 1), ("a", "u", 0, 3.0, 2), ("a", "u", 310, 5.0, 3), ("a", "u", 1200, 7.0, 4)], REC)
    sig = binning.records_to_signals(rec, ["channel", "user"], "last").orderBy("order").collect()
    assert [(r.order, r.value, r.n_records) for r in sig] == [(0, 3.0, 2), (310, 5.0, 1), (1200, 7.0, 1)]
    with pytest.raises(ValueError):
        binning.records_to_signals(rec, ["channel"], "median")
    b = binning.materialize(rec, 300, ["channel", "user"]).orderBy("bin").collect()
    assert [(r.bin, r.value, r.n_events, r.gap_before) for r in b] == [(0, 2.0, 2, None), (1, 5.0, 1, 0), (4, 7.0, 1, 2)]
    filled = transforms.fill_gaps(binning.materialize(rec, 300, ["channel", "user"]), ["channel", "user"]).orderBy("bin").collect()
    assert [(r.bin, r.value, r.n_events) for r in filled] == [(0, 2.0, 2), (1, 5.0, 1), (2, 0.0, 0), (3, 0.0, 0), (4, 7.0, 1)]
    m = binning.entity_channel_matrix(rec, ["user"], ["a", "b"], 600).orderBy("bin").collect()
    assert [(r.bin, r.a, r.b, r._total) for r in m] == [(0, 3, 0, 3), (1, 0, 0, 0), (2, 1, 0, 1)]
    assert binning.materialize(rec.limit(0), 300, ["channel"]).count() == 0


def brute(values, plan, fn):
    """values: dense list with None; fn of the non-null values of a window."""
    out = {}
    for w, s, h in zip(plan.windows, plan.scales, plan.hop_bins, strict=True):
        for t in range(len(values)):
            win = [v for v in values[t : t + s] if v is not None]
            out[w, t] = fn(np.array(win)) if win and t % h == 0 else None
    return out


@pytest.mark.parametrize("name", ["mean", "sum", "count", "std", "var", "geometric_mean", "median", "ewma", "max", "entropy"])
def test_surface_against_loops(spark, name):
    rng = np.random.default_rng(8)
    values = [None if rng.random() < 0.3 else float(np.round(rng.normal() * 5, 2)) for _ in range(40)]
    values[0], values[-1] = 2.0, 3.0
    plan = SamplingPlan.from_windows([1, 2, 6, 12, 60], 1, [1, 1, 3, 1, 1])
    df = spark.createDataFrame([("c", i + 100, v, 1) for i, v in enumerate(values) if v is not None], BINNED)
    fns = dict(EXPECT)
    fns["std"] = lambda v: np.std(v) if len(v) > 1 else None
    fns["var"] = lambda v: np.var(v) if len(v) > 1 else None
    fns["geometric_mean"] = lambda v: np.exp(np.log(v[v > 0]).sum() / len(v))
    want = brute(values, plan, fns[name])
    got = {(r.window, r.bin - 100): r[name] for r in surface.measure(df, plan, ["channel"], name).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-8) if v is not None else got[k] is None, (k, got[k], v)


def test_surface_edges(spark):
    plan = SamplingPlan.from_windows([1, 4], 1)
    empty = spark.createDataFrame([], BINNED)
    assert surface.measure(empty, plan, ["channel"]).count() == 0
    one = surface.measure(spark.createDataFrame([("c", 5, 2.0, 3)], BINNED), plan, ["channel"], ["mean", "std"]).orderBy("window").collect()
    assert [(r.window, r.mean, r.std, r.coverage, r.n_events) for r in one] == [(1, 2.0, None, 1.0, 3), (4, 2.0, None, 0.25, 3)]
    two = spark.createDataFrame([("a", 0, 1.0, 1), ("b", 3, 1.0, 1)], BINNED)
    assert surface.measure(two, plan, ["channel"]).count() == 4 and surface.measure(two, plan, ["channel"], axis="global").count() == 16
    with pytest.raises(ValueError):
        surface.measure(two, plan, ["channel"], axis="both")


def rows_of(spark, values):
    df = spark.createDataFrame([("c", i, v, 1) for i, v in enumerate(values)], BINNED)
    return df.selectExpr("channel", "0 AS scale_idx", "1L AS scale", "1L AS window", "bin", "n_events", "1.0D AS coverage", "value AS mean")


def test_baselines_against_numpy(spark):
    x = [1.0, 2.0, None, 4.0, 8.0, 16.0, 5.0, None, 3.0]
    b = lambda **k: [r.mean for r in surface_ops.baseline(rows_of(spark, x), ["channel"], **k).orderBy("bin").collect()]
    assert b(method="ewma", alpha=0.5) == [1.0, 1.5, None, 2.75, 5.375, 10.6875, 7.84375, None, 5.421875]
    assert b(method="rolling_mean", window=2) == [1.0, 1.5, 2.0, 4.0, 6.0, 12.0, 10.5, 5.0, 3.0]
    assert b(method="median", window=3) == [1.0, 2.0, None, 4.0, 8.0, 8.0, 5.0, None, 3.0]
    assert b(method="median", window=20) == x
    assert surface_ops.median_baseline(np.array([1.0, 5.0, 2.0, 8.0]), 2).tolist() == [1.0, 5.0, 5.0, 8.0]
    with pytest.raises(ValueError):
        b(method="mystery")


def test_residuals(spark):
    m, base = rows_of(spark, [1.0, 4.0, None]), rows_of(spark, [0.0, 2.0, 4.0])
    f = lambda mode: [r.mean for r in surface_ops.residual(m, base, ["channel"], mode).orderBy("bin").collect()]
    assert f("difference") == [1.0, 2.0, None] and f("ratio") == [None, 2.0, None]
    assert f("z")[1] == pytest.approx(2 / np.std([0, 2, 4]))
    assert [r.mean for r in surface_ops.residual(m, rows_of(spark, [1.0, 1.0, 1.0]), ["channel"], "z").collect()] == [None] * 3


def test_analytic_signal(spark):
    n = 64
    x = np.cos(2 * np.pi * 4 * np.arange(n) / n)
    out = surface_ops.hilbert(rows_of(spark, x.tolist()), ["channel"]).orderBy("bin").collect()
    assert np.allclose([r.amplitude for r in out], 1.0) and np.allclose([r.inst_freq for r in out], 2 * np.pi * 4 / n)
    odd = surface_ops.analytic(np.sin(2 * np.pi * 3 * np.arange(33) / 33))
    assert np.allclose(odd["amplitude"], 1.0)
    assert all(r.phase is None for r in surface_ops.hilbert(rows_of(spark, [1.0, None, 2.0]), ["channel"]).collect())


def test_stack_refuses_clashes(spark):
    s = rows_of(spark, [1.0])
    with pytest.raises(ValueError):
        surface_ops.stack([("a", s), ("a", s)], ["channel"])
    with pytest.raises(ValueError):
        surface_ops.stack([], ["channel"])


def test_derive(spark):
    df = spark.createDataFrame([("a", 0, 4.0, 1), ("b", 0, 2.0, 1), ("a", 1, 4.0, 1), ("b", 1, 0.0, 1), ("a", 2, 1.0, 1)], BINNED)
    for fn in (F.try_divide(F.col("a"), F.col("b")), lambda v: v["a"] / v["b"]):
        got = transforms.derive(df, "q", fn, ["a", "b"]).where("channel = 'q'").collect()
        assert [(r.bin, r.value, r.n_events) for r in got] == [(0, 2.0, 0)]
    got = transforms.derive_temporal(df, "c", lambda x: np.cumsum(np.nan_to_num(x["a"])), ["a", "b"]).where("channel = 'c'").orderBy("bin").collect()
    assert [r.value for r in got] == [4.0, 8.0, 9.0]


def test_bundle(spark):
    plan = SamplingPlan(4, 1)
    s = surface.measure(spark.createDataFrame([("a", i, float(i), 1) for i in range(6)] + [("b", i, 1.0, 1) for i in range(6)], BINNED), plan, ["channel"])
    t = features.engineer(s, plan, ["channel"])
    bundle = features.assemble([t], ["channel"], F.lit("_"))
    arr = features.entity_array(bundle, "_")
    assert arr.shape == (2 * 8, 3, 6) and arr.dtype == np.float32
    with pytest.raises(ValueError):
        features.assemble([], ["channel"], F.lit("_"))
    with pytest.raises(KeyError):
        features.entity_array(bundle, "x")


def test_graph_and_chain(spark):
    rec = spark.createDataFrame([(c, "u", i * 7, float(i % 5), i) for c in "ab" for i in range(60)], REC)
    m = graph.Measure("mean", windows=(12, 24))(graph.Input())
    pipe = graph.Pipeline(graph.Residual("difference")(m, graph.Baseline("rolling_mean")(m)), ["channel"], grain=6)
    plan = pipe.resolve(rec)
    assert plan.cbin == 12 and plan.windows == (12, 24)
    a, b = pipe.run(rec), pipe.run(rec.where("channel = 'a'"))
    assert a.id == b.id and a.frame.count() == 2 * b.frame.count() and len(a.id) == 16 and "Residual" in pipe.summary()
    with pytest.raises(TypeError):
        graph.Engineer()(graph.Input())
    full = graph.Assemble()(graph.Engineer()(graph.Measure(profile="continuous", windows=(12, 24))(graph.Bin()(graph.Input("records")))))
    assert graph.Pipeline(full, ["channel", "user"], grain=6).run(rec).frame.where("entity = 'user=u'").count() > 0
    c = chain.load(rec).measure("mean", windows=(12, 24)).baseline("rolling_mean")
    same = c.residual("difference").surfaces(grain=6)
    key = lambda df: sorted((r.channel, r.window, r.bin, r.mean) for r in df.where("mean IS NOT NULL").collect())
    assert key(same) == key(a.frame)
    assert {"mean_mean", "baseline_rolling_mean_mean"} <= set(c.stack().surfaces(grain=6).columns)
    assert c.gradient().surfaces(grain=6).count() and c.hilbert().heatmap(grain=6).count()
    with pytest.raises(ValueError):
        chain.load(rec.limit(0))
    with pytest.raises(ValueError):
        chain.load(rec).baseline().run()
