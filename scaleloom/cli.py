"""Command line: init, status, plan, neighborhood, load, surface, schema, run, inspect, demo."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.aggregations import aggregation_names, get_profile, profile_names
from .operators.analysis import analyze
from .operators.segments import grain_from_orders
from .operators.surface_ops import peaks
from .plans import chain, lattice, neighborhood
from .sources import sinks
from .sources.records import Schema, auto_ingest


def _session() -> SparkSession:
    return SparkSession.builder.appName("scaleloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


WORKSPACE = "workspace.json"
_NOTIONS = {
    "bin": "The shortest stretch of the order axis that is measured; all windows are multiples of it.",
    "window": "A stretch that a value is measured over. Windows of a plan divide its horizon.",
    "horizon": "The longest window; a common multiple of all others.",
    "grain": "The resolution below which the data say nothing; the bin is at least as long.",
    "hop": "The distance between two measured places of a window.",
    "scale": "A window in bins.",
    "surface": "A value for each scale and bin: all windows of a plan measured at all places.",
    "coverage": "The share of a window's bins that hold a value.",
}


_METHODS = {
    "ewma": ("baseline", "Each value moves the baseline by a share alpha of its distance."),
    "rolling_mean": ("baseline", "The mean of the last values."),
    "median": ("baseline", "The median of the values around."),
    "difference": ("residual", "The measured value less its baseline."),
    "ratio": ("residual", "The measured value by its baseline; none where that is zero."),
    "z": ("residual", "The difference by the spread of the baseline's row."),
}


def _topics() -> dict[str, tuple[str, str]]:
    known = {n: ("aggregation", f"{n.replace('_', ' ')} of the values of a bin or window") for n in aggregation_names()}
    return known | {f"profile {n}": ("profile", ", ".join(get_profile(n))) for n in profile_names()} | _METHODS | {n: ("notion", t) for n, t in _NOTIONS.items()}


def _chain(spark, a) -> chain.Chain:
    return chain.load_schema(a.csv, a.schema, spark) if a.schema else chain.load(a.csv, spark=spark)


def cmd_plan(a) -> None:
    windows = tuple(lattice.parse_duration(w) for w in a.windows) if a.windows else "dense"
    horizon = lattice.parse_duration(a.horizon) if a.horizon else lattice.horizon_for(windows)
    plan = lattice.SamplingPlan(horizon, lattice.parse_duration(a.grain), windows)
    print(plan.describe())
    if a.lattice:
        print(plan.show_lattice())


def cmd_neighborhood(a) -> None:
    print(neighborhood.show(neighborhood.neighborhood(_session(), a.anchor, a.radius)))


def cmd_load(a) -> None:
    df = auto_ingest(_session(), a.csv)
    n, lo, hi = df.agg(F.count("*"), F.min("order"), F.max("order")).first()
    keys = [c for c in df.columns if c not in ("channel", "order", "value", "seq", "metric")]
    print(f"{n} records, channels {[r[0] for r in df.select('channel').distinct().limit(50).collect()]}, keys {keys}, orders {lo} to {hi}")
    grain = grain_from_orders(df)
    print(f"estimated grain {grain}")
    print(lattice.SamplingPlan(max(hi - lo, 360), min(grain, max(hi - lo, 360))).describe())


def cmd_surface(a) -> None:
    c = _chain(_session(), a).measure(a.agg, windows=[lattice.parse_duration(w) for w in a.windows])
    if a.baseline:
        c = c.baseline(a.baseline)
    if a.residual:
        c = c.residual(a.residual)
    art = c.run(grain=lattice.parse_duration(a.grain) if a.grain else None, horizon=lattice.parse_duration(a.horizon) if a.horizon else None)
    peaks(art.frame, art.by, a.agg).show(truncate=False)
    if a.heatmap:
        sinks.draw_heatmap(art.frame, art.by, a.heatmap, a.agg)
    if a.save:
        sinks.save(art.frame, a.save, {"id": art.id, "windows": art.plan.windows, "cbin": art.plan.cbin})


def cmd_schema(a) -> None:
    s = Schema.load(a.load) if a.load else Schema.infer(_session(), a.csv)
    s = s.with_types(dict(x.split("=", 1) for x in a.set))
    s = Schema(s.struct, s.primary_order, a.group_by or s.group_by, s.value_axis, a.channel or s.channel_axis, s.name)
    print(s.to_json())
    if a.save:
        s.save(a.save)


def cmd_run(a) -> None:
    df = auto_ingest(_session(), a.csv)
    keys = [c for c in df.columns if c not in ("channel", "order", "value", "seq", "metric")]
    results = analyze(df, keys[0] if keys else "channel")
    print(sinks.to_json(results) if a.json else sinks.report(results))


def cmd_init(a) -> None:
    """A workspace: a folder with its settings, the data it is about and what they look like."""
    home = Path(a.name)
    if (home / WORKSPACE).exists():
        raise SystemExit(f"{home} is a workspace already")
    settings = {"version": 1, "name": a.name} | {k: v for k, v in (("max_window", a.max_window), ("grain", a.grain)) if v}
    if a.csv:
        df = auto_ingest(_session(), a.csv)
        names = [r[0] for r in df.select("channel").distinct().orderBy("channel").collect()]
        settings |= {"csv": str(Path(a.csv).resolve()), "summary": {"records": df.count(), "channels": names, "estimated_grain": grain_from_orders(df)}}
    for part in ("cache", "output"):
        (home / part).mkdir(parents=True, exist_ok=True)
    (home / WORKSPACE).write_text(json.dumps(settings, indent=2))
    print(f"workspace {home}: {json.dumps(settings)}")


def cmd_status(a) -> None:
    """What the nearest workspace holds, from the current folder upwards."""
    here = Path.cwd()
    home = next((p for p in (here, *here.parents) if (p / WORKSPACE).exists()), None)
    if home is None:
        raise SystemExit("no workspace here; make one with init")
    settings = json.loads((home / WORKSPACE).read_text())
    print(f"workspace {home} ({settings['name']})")
    if "csv" in settings:
        print(f"data {settings['csv']} ({'there' if Path(settings['csv']).exists() else 'missing'})")
    for k, v in (settings.get("summary", {}) | {k: settings[k] for k in ("max_window", "grain") if k in settings}).items():
        print(f"{k} {v}")
    for part in ("cache", "output"):
        print(f"{part} {len([*(home / part).iterdir()])} files")


def cmd_inspect(a) -> None:
    """What a baseline, residual, aggregation or notion is."""
    topics = _topics()
    if a.topic is None:
        for kind in dict.fromkeys(k for k, _ in topics.values()):
            print(f"{kind}: {', '.join(t for t, (k, _) in topics.items() if k == kind)}")
    elif a.topic.lower() in topics:
        kind, text = topics[a.topic.lower()]
        print(f"{a.topic.lower()} ({kind})\n{text}")
    else:
        raise SystemExit(f"nothing is known of {a.topic!r}; topics are {', '.join(sorted(topics))}")


def cmd_demo(a) -> None:
    """A sine with a burst, measured at every scale."""
    spark = _session()
    t = F.col("id")
    df = spark.range(3600).select(F.lit("demo").alias("channel"), t.alias("order"), (F.sin(t / 60) + F.when(t.between(1800, 1830), 5.0).otherwise(0.0)).alias("value"), t.alias("seq"))
    art = chain.load(df).measure("mean").baseline("ewma").residual("difference").run(grain=1, horizon=360)
    peaks(art.frame, art.by).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="scaleloom", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name, fn, *args):
        s = sub.add_parser(name)
        for flags, options in args:
            s.add_argument(*flags.split(), **options)
        s.set_defaults(fn=fn)

    many = {"nargs": "*", "default": []}
    command("init", cmd_init, ("name", {}), ("--csv", {}), ("--max-window", {"dest": "max_window"}), ("--grain", {}))
    command("status", cmd_status)
    command("inspect", cmd_inspect, ("topic", {"nargs": "?"}))
    command("plan", cmd_plan, ("--horizon", {}), ("--grain", {"default": "1"}), ("--windows", many), ("--lattice", {"action": "store_true"}))
    command("neighborhood", cmd_neighborhood, ("anchor", {"type": int}), ("--radius", {"type": int, "default": 6}))
    command("load", cmd_load, ("csv", {}))
    command("surface", cmd_surface, ("csv", {}), ("--schema", {}), ("--agg", {"default": "mean"}), ("--windows", many), ("--grain", {}), ("--horizon", {}), ("--baseline", {}), ("--residual", {}), ("--save", {}), ("--heatmap", {}))
    command("schema", cmd_schema, ("csv", {"nargs": "?"}), ("--set", many), ("--group-by", {**many, "dest": "group_by"}), ("--channel", {}), ("--save", {}), ("--load", {}))
    command("run", cmd_run, ("csv", {}), ("--json", {"action": "store_true"}))
    command("demo", cmd_demo)
    a = p.parse_args(argv)
    a.fn(a)


if __name__ == "__main__":
    main()
