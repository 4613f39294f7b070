import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scaleloom import cli
from scaleloom.operators import binning, features, surface
from scaleloom.plans import chain
from scaleloom.plans.lattice import SamplingPlan
from scaleloom.sources import records as R
from scaleloom.sources import sinks
from scaleloom.streaming import streams


def write(path, text):
    path.write_text(text)
    return str(path)


def test_inference_and_round_trip(spark, tmp_path):
    p = write(tmp_path / "a.csv", "idx,kind,name,val\n" + "\n".join(f"{i * 10},{'xy'[i % 2]},n{i},{(i * 7) % 5}.5" for i in range(20)))
    s = R.Schema.infer(spark, p, "demo")
    assert s.kinds == {"idx": "ordered", "kind": "categorical", "name": "relational", "val": "numeric"}
    assert s.primary_order == "idx" and s.value_axis == "val"
    s2 = R.Schema(s.struct, "idx", ("kind",), "val", "kind", "demo")
    s2.save(str(tmp_path / "s.json"))
    assert R.Schema.load(str(tmp_path / "s.json")) == s2
    rows = s2.read(spark, p).orderBy("order").collect()
    assert [(r.order, r.channel, r.kind, r.value) for r in rows[:2]] == [(0, "x", "x", 0.5), (10, "y", "y", 2.5)]
    assert chain.load_schema(p, str(tmp_path / "s.json"), spark).measure().surfaces(grain=10, horizon=40).count() > 0
    for bad in ({"primary_order": "kind"}, {"group_by": ("val",)}, {"value_axis": "nope"}):
        with pytest.raises(ValueError):
            R.Schema(**({"fields": s.struct, "primary_order": "idx"} | bad))


def test_no_order_gets_positions(spark, tmp_path):
    p = write(tmp_path / "b.csv", "v,w\n3,1\n1,2\n2,1\n")
    s = R.Schema.infer(spark, p)
    assert s.primary_order == "_index" and next(iter(s.kinds)) == "_index"
    assert [r.order for r in s.records().orderBy("order").collect()] == [0, 1, 2]


def test_positions_across_partitions(spark):
    df = R.with_positions(spark.range(1000).repartition(7))
    ids = [r._index for r in df.collect()]
    assert sorted(ids) == list(range(1000))
    assert [r.id for r in R.with_positions(spark.range(0, 500, 1, 6)).orderBy("_index").collect()] == list(range(500))


def test_layouts(spark, tmp_path):
    ts = R.auto_ingest(spark, write(tmp_path / "t.csv", "date,lwe\n2020-01-01,1.5\n2020-01-02,x\n2020-01-03,2\n")).orderBy("order").collect()
    assert [(r.order, r.value, r.channel) for r in ts] == [(0, 1.5, "lwe"), (2, 2.0, "lwe")]
    geo = R.auto_ingest(spark, write(tmp_path / "g.csv", "timestamp,station,component,value\n2020-01-01 00:01:00,ABC,X,5\n2020-01-01 00:00:00,ABC,Y,6\n")).orderBy("order").collect()
    assert [(r.order, r.channel, r.station, r.value) for r in geo] == [(1577836800, "Y", "ABC", 6.0), (1577836860, "X", "ABC", 5.0)]
    eq = R.auto_ingest(spark, write(tmp_path / "e.csv", "timestamp,ticker,metric,value\n2020-01-01,AA,close,1.5\n2020-01-02,AA,close,\n2020-01-03,AA,volume,-3\n")).orderBy("order").collect()
    assert [(r.channel, r.ticker, r.value) for r in eq] == [("close", "AA", 1.5), ("volume", "AA", -3.0)]
    eeg = R.auto_ingest(spark, write(tmp_path / "x.csv", "t_sec,eeg_rms\n0.0,1\n0.00390625,2\n0.005859375,3\n")).orderBy("order").collect()
    assert [r.order for r in eeg] == [0, 1, 2]
    with pytest.raises(ValueError):
        R.auto_ingest(spark, write(tmp_path / "n.csv", "only\n1\n"))
    iaga = R.read_iaga2002(spark, write(tmp_path / "i.txt", " Format  IAGA-2002 |\nDATE       TIME         DOY     ABCX   ABCY   |\n2020-01-01 00:00:00.000 001 10.0 99999.00\n2020-01-01 00:01:00.000 001 11.0 12.0\n")).collect()
    assert sorted((r.station, r.component, r.value) for r in iaga) == [("ABC", "X", 10.0), ("ABC", "X", 11.0), ("ABC", "Y", 12.0)]


def test_edf(spark, tmp_path):
    labels, n, records = ["EEG Fp1", "EEG Fp2", "EDF Annotations"], [4, 4, 2], 3
    raw = np.arange(records * 10, dtype="<i2") * 7 - 50
    fields = [(labels, 16), ([""] * 3, 80), (["uV"] * 3, 8), (["-100"] * 3, 8), (["100"] * 3, 8), (["-1000"] * 3, 8), (["1000"] * 3, 8), ([""] * 3, 80), (n, 8), ([""] * 3, 32)]
    head = f"{'0':<8}{'':<80}{'':<80}{'01.01.20':<8}{'00.00.00':<8}{256 * 4:<8}{'':<44}{records:<8}{1:<8}{3:<4}" + "".join(f"{x:<{w}}" for part, w in fields for x in part)
    (tmp_path / "a.edf").write_bytes(head.encode() + raw.tobytes())
    got = {(r.channel, r.sample): r.value for r in R.read_edf(spark, str(tmp_path / "a.edf")).collect()}
    want = {(labels[i], rec * 4 + k): (raw[rec * 10 + i * 4 + k] + 1000) / 10 - 100 for rec in range(records) for i in (0, 1) for k in range(4)}
    assert got == pytest.approx(want)
    assert R.channels_to_rms(R.read_edf(spark, str(tmp_path / "a.edf")), sfreq=4).count() == 12


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(c, i, float(i), 1) for c in "ab" for i in range(6)], "channel string, bin long, value double, n_events long")
    s = surface.measure(rows, SamplingPlan(4, 1), ["channel"])
    bundle = features.assemble([features.engineer(s, SamplingPlan(4, 1), ["channel"], features=["delta"])], ["channel"], F.lit("k=v;l/m"))
    assert np.load(sinks.export_numpy(bundle, "k=v;l/m", str(tmp_path))).shape == (4, 3, 6)
    assert (tmp_path / "k-v_l_m.npy").exists()
    both = list(sinks.as_dataset(bundle.withColumn("label", F.lit(3)), transform=lambda x: x[:, :, :2]))
    whole = np.load(tmp_path / "k-v_l_m.npy")
    assert len(both) == 1 and np.array_equal(both[0][0], whole[:, :, :2], equal_nan=True) and both[0][1] == 3
    assert [np.array_equal(x, whole, equal_nan=True) for x in sinks.as_dataset(bundle)] == [True] and len(sinks.as_dataset(bundle)) == 1
    try:
        import torch  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            sinks.as_torch(bundle)
    sinks.draw_heatmap(s.where("channel = 'a'"), ["channel"], str(tmp_path / "h.png"), height=5)
    png = (tmp_path / "h.png").read_bytes()
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (6, 15)
    sinks.export_csv(bundle, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == bundle.count()
    sinks.save(s, str(tmp_path / "run"), {"cbin": 1})
    back, meta = sinks.load(spark, str(tmp_path / "run"))
    assert back.count() == s.count() and meta == {"cbin": 1}
    assert json.loads(sinks.to_json({"t": s.limit(1), "n": [1]}))["n"] == [1]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    p = write(tmp_path / "t.csv", "date,v\n" + "\n".join(f"2020-01-{i + 1:02d},{i % 4}" for i in range(28)))
    cli.main(["plan", "--horizon", "1h", "--grain", "5m", "--lattice"])
    cli.main(["neighborhood", "36", "--radius", "2"])
    cli.main(["load", p])
    cli.main(["schema", p, "--save", str(tmp_path / "s.json")])
    cli.main(["surface", p, "--windows", "2", "4", "--grain", "1", "--baseline", "rolling_mean", "--residual", "difference"])
    cli.main(["init", str(tmp_path / "ws"), "--csv", p, "--grain", "2"])
    with pytest.raises(SystemExit):
        cli.main(["init", str(tmp_path / "ws")])
    monkeypatch.chdir(tmp_path / "ws" / "cache")
    cli.main(["status"])
    cli.main(["inspect"])
    cli.main(["inspect", "EWMA"])
    out = capsys.readouterr().out
    assert "estimated_grain" in out and "data " in out and "(there)" in out and "residual: difference" in out and "distance" in out
    assert "3600" in out and "28 records" in out and "primary_order" in out and "peak_z" in out


def test_streams_equal_batch(spark, tmp_path):
    events = [("u", f"2024-01-01 {h:02d}:{m:02d}:00", float(h + m)) for h in range(3) for m in (0, 20, 59)] + [("v", "2024-01-01 00:10:00", 1.0)]
    df = spark.createDataFrame(events, "user string, t string, value double").select("user", F.to_timestamp("t").alias("ts"), "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode="complete"):
        q = out.writeStream.format("memory").queryName("t").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("t").collect()

    bins = {(r.user, str(r.bin_start)): (r.value, r.n_events) for r in run(streams.stream_bins(source, ["user"], "1 hour"))}
    batch = df.groupBy("user", F.date_trunc("hour", "ts").alias("b")).agg(F.avg("value"), F.count("*")).collect()
    assert bins == {(r[0], str(r[1])): (r[2], r[3]) for r in batch}
    ses = sorted((r.user, str(r.start), str(r.end), r.event_count) for r in run(streams.stream_sessions(source, ["user"], "30 minutes")))
    assert ses[0] == ("u", "2024-01-01 00:00:00", "2024-01-01 00:20:00", 2) and sum(s[3] for s in ses) == len(events)
    assert len(run(streams.stream_windows(source, ["user"], ["2 hours"], "1 hour")[0])) == 4 + 2
    spark.createDataFrame([("u", 0, 2.0), ("u", 1, 4.0), ("u", 2, None), ("u", 3, 8.0)], "user string, bin long, value double").coalesce(1).write.parquet(str(tmp_path / "bins2"))
    one = spark.readStream.schema("user string, bin long, value double").parquet(str(tmp_path / "bins2"))
    got = sorted((r.bin, r.ewma) for r in run(streams.stream_ewma(one, ["user"], 0.5), "append"))
    assert got == [(0, 2.0), (1, 3.0), (3, 5.5)]


def test_entity_order(spark):
    rec = spark.createDataFrame([("u", 3), ("v", 1), ("u", 1)], "user string, order long")
    assert [r.order for r in binning.entity_signals(rec, ["user"]).where("user = 'u'").collect()] == [1, 3]
