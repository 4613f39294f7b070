"""Measurement of binned signals through every window of a plan at once.

The result is long: by, scale_idx, scale (bins), window, bin, n_events, coverage and a column for each
aggregation. A window looks forward from its bin and ends with the data; bins that are no multiple of the
hop from the first bin hold nulls, with coverage and n_events 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregations import get_aggregation, get_profile, is_python
from ..plans.lattice import SamplingPlan
from .binning import bin_signal

#: Aggregations that differences of running sums give.
PREFIX = ("mean", "sum", "count", "std", "var", "geometric_mean", "count_entropy")


#: Aggregations of two overlapping windows that give that of both.
EXTREMES = {"max": F.greatest, "min": F.least}
#: Bins of a chunk at least.
CHUNK = 4096


def chunks(binned: DataFrame, by: Sequence[str], longest: int, axis: str = "signal") -> DataFrame:
    """by, _chunk, bin, value, n_events for every bin of a signal, empty ones as nulls, with _first (its first bin), _centre (its mean).

    A chunk also holds the ``longest`` - 1 bins after it, for which _own is false.
    """
    if axis not in ("signal", "global"):
        raise ValueError(f"axis is signal or global, not {axis!r}")
    size, halo = max(CHUNK, 2 * longest), longest - 1
    ends = binned.groupBy(*by).agg(F.min("bin").alias("_first"), F.max("bin").alias("_last"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("_centre"))
    if axis == "global":
        whole = binned.agg(F.min("bin").alias("_first"), F.max("bin").alias("_last"))  # one row
        ends = ends.drop("_first", "_last").crossJoin(F.broadcast(whole))
    at = lambda c: F.floor(c / size)
    lo = F.col("_chunk") * size
    spine = ends.select(*by, "_first", "_last", "_centre", F.explode(F.sequence(at(F.col("_first")), at(F.col("_last")))).alias("_chunk"))
    spine = spine.select(*by, "_chunk", "_first", "_centre", F.explode(F.sequence(F.greatest("_first", lo), F.least("_last", lo + size - 1 + halo))).alias("bin"))
    held = F.when(F.pmod("bin", F.lit(size)) < halo, F.array(at(F.col("bin")) - 1, at(F.col("bin")))).otherwise(F.array(at(F.col("bin"))))
    values = binned.select(*by, F.explode(held).alias("_chunk"), "bin", "value", "n_events")
    n = int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spine.unionByName(values, allowMissingColumns=True).repartition(n, *by, "_chunk").groupBy(*by, "_chunk", "bin")
    return rows.agg(*[F.max(c).alias(c) for c in ("_first", "_centre", "value", "n_events")]).where("_first IS NOT NULL").withColumn("_own", F.col("bin") < lo + size)


class RunningSums:
    """Sums over [bin, bin + width) of dense rows from one running window, whatever the number of widths.

    ``add`` registers a term; ``frame`` gives the rows with their running sums, ``total`` the sum of a term.
    """

    def __init__(self, by: Sequence[str]):
        self.by, self.terms = list(by), {}

    def add(self, name: str, term: Column) -> None:
        self.terms[name] = F.coalesce(term, F.lit(0.0))

    def frame(self, dense: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        dense = dense.withColumns({f"_t_{n}": t for n, t in self.terms.items()})
        dense = dense.withColumns({f"_s_{n}": F.sum(f"_t_{n}").over(w) for n in self.terms})
        ends = Window.partitionBy(*self.by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dense.withColumns({f"_e_{n}": F.last(f"_s_{n}").over(ends) for n in self.terms})

    def total(self, name: str, width: int) -> Column:
        after = Window.partitionBy(*self.by).orderBy("bin")
        upto = F.coalesce(F.lead(f"_s_{name}", width - 1).over(after), F.col(f"_e_{name}")) if width > 1 else F.col(f"_s_{name}")
        return upto - (F.col(f"_s_{name}") - F.col(f"_t_{name}"))


def _prefix_value(name: str, s: dict[str, Column]) -> Column:
    n = s["n"]
    mean = s["v"] / n
    if name == "sum":
        return F.when(n > 0, s["v"])
    if name == "count":
        return F.when(n > 0, n)
    if name == "mean":
        return F.when(n > 0, mean)
    if name == "geometric_mean":
        return F.when(n > 0, F.exp(s["log"] / n))
    if name == "count_entropy":
        return F.when(s["events"] > 0, F.greatest(F.lit(0.0), F.log2(s["events"]) - s["clogc"] / s["events"]))
    # the group's mean was taken off before squaring, which keeps the difference from cancelling
    var = F.greatest(F.lit(0.0), s["cc"] / n - (s["c"] / n) * (s["c"] / n))
    return F.when(n > 1, F.sqrt(var) if name == "std" else var)


def measure(binned: DataFrame, plan: SamplingPlan, by: Sequence[str], agg: str | Sequence[str] = "mean", axis: str = "signal", profile: str | None = None) -> DataFrame:
    """The surface of ``binned`` (by, bin, value, n_events).

    A signal is dealt over chunks of its bins, each with as many of the following bins as the longest window
    needs, so a long signal is many tasks; one shuffle by ``by`` and chunk serves the spine, the running sums
    and all scales. Cells are differences in the chunk's array of running sums, read at both ends of a window. Extremes come from those of 1, 2, 4, ... bins; aggregations that neither can give are
    evaluated on the values of each window.
    """
    names = list(get_profile(profile)) if profile else [agg] if isinstance(agg, str) else list(agg)
    by = list(by)
    dense = chunks(binned.select(*by, "bin", "value", F.col("n_events").cast("double").alias("n_events")), by, max(plan.scales), axis)
    near = [*by, "_chunk"]
    v, e = F.col("value"), F.col("n_events")
    sums = RunningSums(near)
    sums.add("n", v.isNotNull().cast("double"))
    sums.add("v", v)
    sums.add("events", e)
    if {"std", "var"} & {*names}:
        sums.add("c", v - F.col("_centre"))
        sums.add("cc", (v - F.col("_centre")) * (v - F.col("_centre")))
    if "geometric_mean" in names:
        sums.add("log", F.when(v > 0, F.log(v)))
    if "count_entropy" in names:
        sums.add("clogc", F.when(e > 0, e * F.log2(e)))
    rows = dense.withColumns({f"_t_{n}": t for n, t in sums.terms.items()})
    upto = Window.partitionBy(*near).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s_{n}": F.sum(f"_t_{n}").over(upto) for n in sums.terms})
    longest, after, columns = max(plan.scales), Window.partitionBy(*near).orderBy("bin"), [f"_s_{n}" for n in sums.terms]
    doubled = [2**i for i in range(longest.bit_length())]
    for n in (n for n in names if n in EXTREMES):  # over 1, 2, 4, ... bins
        rows = rows.withColumn(f"_{n}_1", v)
        for w in doubled[1:]:
            rows = rows.withColumn(f"_{n}_{w}", EXTREMES[n](F.col(f"_{n}_{w // 2}"), F.lead(f"_{n}_{w // 2}", w // 2).over(after)))
        columns += [f"_{n}_{w}" for w in doubled]
    other = [n for n in names if n not in PREFIX and n not in EXTREMES]
    columns += ["value"] if other else []
    slow = [n for n in other if is_python(n)]
    of = lambda n, i: get_aggregation(n).array(F.filter(F.slice("value", i + 1, F.col("_c.s")), lambda x: x.isNotNull()))
    some = lambda n: lambda i: F.when(F.exists(F.slice("value", i + 1, F.col("_c.s")), lambda x: x.isNotNull()), of(n, i))
    cells = window_cells(rows, by, columns, plan, {f"_o_{n}": some(n) for n in other if n not in slow})
    s, at = F.col("_c.s"), F.col("_i")
    got = {t: F.get(F.col(f"_s_{t}"), F.least(at + s, F.col("_size"))) - F.get(F.col(f"_s_{t}"), at) for t in sums.terms}
    long = cells.select(
        *by, "_c.scale_idx", s.cast("long").alias("scale"), "_c.window", (F.col("_at") + at).alias("bin"), (F.pmod(F.col("_at") + at - F.col("_first"), F.col("_c.h")) == 0).alias("_start"),
        *[c.alias(f"_{t}") for t, c in got.items()], *[_extreme(n, doubled, s, at).alias(f"_{n}") for n in names if n in EXTREMES],
        *[F.get(f"_o_{n}", at).alias(f"_o_{n}") for n in other if n not in slow], *([F.filter(F.slice("value", at + 1, s), lambda x: x.isNotNull()).alias("_values")] if slow else []),
    )
    terms = {t: F.col(f"_{t}") for t in sums.terms}
    value = {n: _prefix_value(n, terms) if n in PREFIX else F.col(f"_{n}") if n in EXTREMES else F.col(f"_o_{n}") if n not in slow else F.when(F.size("_values") > 0, get_aggregation(n).array(F.col("_values"))) for n in names}
    return long.select(
        *by, "scale_idx", "scale", "window", "bin", F.when(F.col("_start"), F.round("_events")).otherwise(0.0).cast("long").alias("n_events"),
        F.when(F.col("_start"), F.col("_n") / F.col("scale")).otherwise(0.0).alias("coverage"), *[F.when(F.col("_start"), c).alias(n) for n, c in value.items()],
    )


def window_cells(rows: DataFrame, by: Sequence[str], columns: Sequence[str], plan: SamplingPlan, per_window: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A row for each scale and own bin of the chunks of ``rows``: by, _first, _at (first bin of the chunk), _size, _c (scale_idx, s, window, h, k), _i (place of the bin) and the chunk's arrays.

    Arrays hold ``columns`` by bin; running sums (_s_*) begin with a zero. ``per_window`` gives further arrays, one
    value for each place, from functions of a place that read the arrays and _c.s: they are evaluated once for each
    chunk and scale, so that what makes cells of them moves numbers only.
    """
    near = [*by, "_chunk"]
    held = rows.groupBy(*near).agg(F.sort_array(F.collect_list(F.struct("bin", *columns))).alias("_x"), F.min("_first").alias("_first"), F.min("bin").alias("_at"), F.count_if("_own").cast("int").alias("_n"))
    arrays = [(F.concat(F.array(F.lit(0.0)), F.col(f"_x.{c}")) if c.startswith("_s_") else F.col(f"_x.{c}")).alias(c) for c in columns]
    level = [s.bit_length() - 1 for s in plan.scales]
    scales = F.array(*[F.struct(F.lit(i).alias("scale_idx"), F.lit(s).cast("int").alias("s"), F.lit(window).cast("long").alias("window"), F.lit(h).cast("int").alias("h"), F.lit(k).alias("k")) for i, (s, window, h, k) in enumerate(zip(plan.scales, plan.windows, plan.hop_bins, level, strict=True))])
    each = held.select(*by, "_first", "_at", "_n", F.size("_x").alias("_size"), *arrays).select("*", F.explode(scales).alias("_c"))
    places = F.sequence(F.lit(0), F.col("_n") - 1)
    for name, fn in (per_window or {}).items():
        each = each.withColumn(name, F.transform(places, fn))
    return each.select("*", F.explode(places).alias("_i"))


def _extreme(name: str, doubled: Sequence[int], width: Column, at: Column) -> Column:
    """Of ``width`` bins from ``at``: of two overlapping stretches of the largest power of two within."""
    out = F.lit(None).cast("double")
    for i, w in enumerate(doubled):
        of = F.col(f"_{name}_{w}")
        out = F.when(F.col("_c.k") == i, EXTREMES[name](F.get(of, at), F.get(of, F.least(at + width - w, F.col("_size") - 1)))).otherwise(out)
    return out


def measure_signal(signals: DataFrame, plan: SamplingPlan, by: Sequence[str], agg: str | Sequence[str] = "mean") -> DataFrame:
    """The surface of signals (by, order, value): bins hold the mean of their points, each signal has its own axis."""
    return measure(bin_signal(signals, plan.cbin, by), plan, by, agg)


def measure_complex(binned: DataFrame, plan: SamplingPlan, by: Sequence[str], agg: Sequence[str] = ("mean",)) -> DataFrame:
    """Surfaces of paired columns re and im: sum and mean, and E[z^2] - E[z]^2 for var, as <agg>_re and <agg>_im."""
    by = list(by)
    bad = {*agg} - {"mean", "sum", "var"}
    if bad:
        raise ValueError(f"no complex form of {', '.join(sorted(bad))}")
    re, im = F.col("re"), F.col("im")
    parts = {"re": re, "im": im} | ({"sq_re": re * re - im * im, "sq_im": 2 * re * im} if "var" in agg else {})
    out = None
    for name, value in parts.items():
        one = measure(binned.select(*by, "bin", value.alias("value"), "n_events"), plan, by, ["mean", "sum"])
        one = one.withColumnsRenamed({"mean": f"mean_{name}", "sum": f"sum_{name}"})
        out = one if out is None else out.join(one.drop("scale_idx", "scale", "n_events", "coverage"), [*by, "window", "bin"])
    if "var" in agg:
        out = out.withColumns({"var_re": F.col("mean_sq_re") - (F.col("mean_re") * F.col("mean_re") - F.col("mean_im") * F.col("mean_im")), "var_im": F.col("mean_sq_im") - 2 * F.col("mean_re") * F.col("mean_im")})
    return out.select(*by, "scale_idx", "scale", "window", "bin", "n_events", "coverage", *[f"{a}_{p}" for a in agg for p in ("re", "im")])
