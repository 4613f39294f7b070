"""Analysis of entities: summaries, rhythms, session and entity scores, ranked findings.

Records are rows (entity, channel, order, value, ...). Tables stay distributed; only results of bounded
size (one row of totals, the top of a ranking) reach the driver, for ``findings`` and ``analyze``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import records_to_signals
from .information import DAY, entropy, folded_day, mutual_information, scales_of_mass, scalemap
from .segments import discover_segments, gaps, make_segments, split_by_gap


@dataclass(frozen=True)
class AnalysisSchema:
    """What the columns of records mean to the analysis.

    Classifiers are Columns or functions that build one. ``families`` maps a name to {"events": [channels],
    "session_key": column}.
    """

    signal_group_key: str | None = None
    entity_group_key: str | None = None
    entity_classifier: Column | Callable[[Column], Column] | None = None
    family_classifier: Column | Callable[[Column], Column] | None = None
    families: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    summary_aliases: Mapping[str, str] = field(default_factory=dict)
    categorical: Sequence[str] = ()


def error_column(categorical: Sequence[str]) -> str | None:
    return next((c for c in categorical if "error" in c.lower()), None)


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def summary(records: DataFrame, categorical: Sequence[str], error: str | Column | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """One row: total_events, time_span_hours, error_rate, unique_<column> of each categorical column."""
    error = error if error is not None else error_column(categorical)
    bad = _given(error) if isinstance(error, str) else error if error is not None else F.lit(False)
    unique = [F.count_distinct(F.when(_given(c), F.col(c))).alias(f"unique_{n}") for c in categorical for n in dict.fromkeys([c, (aliases or {}).get(c, c)])]
    return records.agg(F.count("*").alias("total_events"), F.round((F.max("order") - F.min("order")) / 3600, 1).alias("time_span_hours"), F.round(F.avg(F.when(bad, 1.0).otherwise(0.0)), 4).alias("error_rate"), *unique)


def top_values(records: DataFrame, column: str, n: int = 10) -> DataFrame:
    """column, value, count, rank of the most common values; ties by value."""
    counts = records.where(_given(column)).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    best = counts.orderBy(F.desc("count"), "value").limit(n)
    return best.select(F.lit(column).alias("column"), "value", "count", F.row_number().over(Window.orderBy(F.desc("count"), "value")).alias("rank"))


def estimate_grain(records: DataFrame, least: int = 60) -> DataFrame:
    """One row, grain: the whole median of the positive gaps of all records, at least ``least``."""
    # equal orders have no positive gap between them, so the distinct ones are enough
    return gaps(records.select("order").distinct(), []).agg(F.coalesce(F.greatest(F.lit(least), F.floor(F.percentile("gap", F.lit(0.5))).cast("int")), F.lit(least)).alias("grain"))


def family_sessions(records: DataFrame, entity: Sequence[str], factor: int = 3) -> DataFrame:
    """Segments with a threshold for each entity: max(1, whole 3 medians of its positive gaps)."""
    limit = gaps(records, entity).groupBy(*entity).agg(F.greatest(F.lit(1), F.floor(factor * F.percentile("gap", F.lit(0.5)))).cast("long").alias("_limit"))
    with_limit = records.join(limit, list(entity), "left").withColumn("_limit", F.coalesce("_limit", F.lit(1)))
    return make_segments(split_by_gap(with_limit, entity, F.col("_limit")), entity)


def join_sessions(records: DataFrame, families: Mapping[str, Mapping[str, Any]]) -> dict[str, DataFrame]:
    """Sessions of each family with a session key, over the records of its channels; families of fewer than two records are left out."""
    out = {}
    for name, f in families.items():
        key = f.get("session_key")
        if not key:
            continue
        own = records.where(F.col("channel").isin(*f["events"]) & _given(key))
        if len(own.limit(2).collect()) == 2:
            out[name] = family_sessions(own, [key])
    return out


def metadata_groups(records: DataFrame, group: str) -> DataFrame:
    """channel, <group>: the group value of the first record of each channel."""
    return records.groupBy("channel").agg(F.min_by(group, F.struct("order", "seq")).alias(group))


def mi_pairs(signals: DataFrame, signal: Sequence[str], group: Sequence[str] = (), top: int = 10, label: str = "within") -> DataFrame:
    """group, <signal>_a, <signal>_b, mi: mutual information of the longest signals of each group, pair by pair.

    The values of two signals are paired by position, without aligning their orders; only positive values
    are kept, rounded to four places. At most ``top`` signals of a group meet, so pairs are bounded.
    """
    size = signals.groupBy(*group, *signal).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_n"), *signal))
    best = size.withColumn("_r", rank).where(F.col("_r") <= top).drop("_n")
    pos = F.row_number().over(Window.partitionBy(*group, *signal).orderBy("order"))
    rows = signals.join(best, [*group, *signal]).withColumn("_pos", pos)
    a = rows.select(*group, "_pos", F.col("_r").alias("_ra"), *[F.col(c).alias(f"{c}_a") for c in signal], F.col("value").alias("_va"))
    b = rows.select(*group, "_pos", F.col("_r").alias("_rb"), *[F.col(c).alias(f"{c}_b") for c in signal], F.col("value").alias("_vb"))
    pairs = a.join(b, [*group, "_pos"]).where("_ra < _rb")
    by = [*group, *[f"{c}_a" for c in signal], *[f"{c}_b" for c in signal]]
    out = mutual_information(pairs, by, "_va", "_vb")
    return out.select(*by, F.round("mi", 4).alias("mi"), F.lit(label).alias("kind")).where("mi > 0")


def bridge_pairs(signals: DataFrame, signal: Sequence[str], group: Sequence[str], top: int = 10) -> DataFrame:
    """Pairs between the longest signal of each group, for the groups with the longest."""
    size = signals.groupBy(*group, *signal).agg(F.count("*").alias("_n"))
    first = size.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_n"), *signal))).where("_r = 1").drop("_r", "_n")
    return mi_pairs(signals.join(first, [*group, *signal], "left_semi"), [*group, *signal], (), top, "bridge")


def channel_entropy(signals: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, entropy of the values of each signal, events (its points)."""
    return signals.groupBy(*by).agg(entropy(F.col("value")).alias("entropy"), F.count("*").alias("events"))


def temporal_features(records: DataFrame, entity: str, least: int = 5) -> DataFrame:
    """entity, n, peak_hour, temporal_entropy, spread, anomaly for entities with enough events.

    anomaly is the sum of (share - overall share)^2 / overall share over the hours of the day.
    """
    hours = records.groupBy(entity, F.floor((F.col("order") % DAY) / 3600).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    overall = hours.groupBy("hour").agg(F.sum("n").alias("g"))
    overall = overall.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy()))  # 24 rows
    per = Window.partitionBy(entity)
    share = F.col("n") / F.sum("n").over(per)
    joined = hours.withColumn("p", share).join(F.broadcast(overall), "hour")
    # hours without an event of the entity add their overall share
    out = joined.groupBy(entity).agg(
        F.sum("n").alias("n"), F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"), entropy(F.col("n")).alias("temporal_entropy"),
        (F.sum(F.pow(F.col("p") - F.col("g"), 2) / F.col("g")) + 1 - F.sum("g")).alias("anomaly"),
    ).where(F.col("n") >= least)
    return out.select(entity, "n", "peak_hour", F.round("temporal_entropy", 3).alias("temporal_entropy"), F.round(F.col("temporal_entropy") / math.log2(24), 3).alias("spread"), F.round("anomaly", 4).alias("anomaly"))


def _capped(z: Column) -> Column:
    return F.least(F.abs(z), F.lit(5.0)) / 5.0


def _log_share(share: Column) -> Column:
    return F.log1p(share * 1000) / math.log1p(1000)


def _sigmoid(raw: Column, centre: float) -> Column:
    return 1 / (1 + F.exp(-8 * (raw - centre)))


def score_sessions(segments: DataFrame, total_events: int | Column) -> DataFrame:
    """Segments with event_z, duration_z, n_channels, top_channel, score: size, length, diversity and share of a session."""
    n, d, c = F.col("event_count"), F.col("duration"), F.size("channels")
    stats = segments.agg(F.avg(n).alias("_mn"), F.stddev_pop(n).alias("_sn"), F.avg(d).alias("_md"), F.stddev_pop(d).alias("_sd"), F.max(c).alias("_mc"), F.count("*").alias("_k"))
    df = segments.crossJoin(F.broadcast(stats))  # one row
    spread = lambda s: F.greatest(F.when(F.col("_k") > 1, F.col(s)).otherwise(1.0), F.lit(0.01))
    df = df.withColumns({"event_z": (n - F.col("_mn")) / spread("_sn"), "duration_z": (d - F.col("_md")) / spread("_sd"), "n_channels": c})
    total = total_events if isinstance(total_events, Column) else F.lit(total_events)
    raw = 0.35 * _capped(F.col("event_z")) + 0.25 * _capped(F.col("duration_z")) + 0.20 * c / F.greatest("_mc", F.lit(1)) + 0.20 * _log_share(n / F.greatest(total, F.lit(1)))
    entries = F.map_entries("channels")
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))["n"]
    top_channel = F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top), lambda e: e["key"]))
    return df.withColumns({"top_channel": top_channel, "score": F.round(_sigmoid(raw, 0.3), 4), "event_z": F.round("event_z", 2), "duration_z": F.round("duration_z", 2)}).drop("_mn", "_sn", "_md", "_sd", "_mc", "_k")


def source_features(records: DataFrame, entity: str, source: str) -> DataFrame:
    """entity, unique_sources, total_events, top_source (ties: the least), top_share, diversity."""
    counts = records.where(_given(source)).groupBy(entity, source).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n")).alias("m")
    per = counts.groupBy(entity).agg(F.count("*").alias("unique_sources"), F.sum("n").alias("total_events"), best)
    top = counts.join(per.select(entity, F.col("m.n").alias("n")), [entity, "n"]).groupBy(entity).agg(F.min(source).alias("top_source"))
    share = F.round(F.col("m.n") / F.col("total_events"), 3)
    return per.join(top, entity).select(entity, "unique_sources", "total_events", "top_source", share.alias("top_share"), F.round(1 - F.col("m.n") / F.col("total_events"), 3).alias("diversity"))


def shared_sources(records: DataFrame, entity: str, source: str, least: int = 3) -> DataFrame:
    """source, n_entities of the sources that at least so many entities use."""
    return records.where(_given(source)).groupBy(source).agg(F.count_distinct(entity).alias("n_entities")).where(F.col("n_entities") >= least)


def error_rates(records: DataFrame, entity: str, error: str | Column) -> DataFrame:
    """entity, total, errors, rate, flagged: more than twice the overall rate, and five errors or more."""
    bad = _given(error) if isinstance(error, str) else error
    per = records.groupBy(entity).agg(F.count("*").alias("total"), F.count(F.when(bad, 1)).alias("errors"))
    whole = per.agg((F.sum("errors") / F.greatest(F.sum("total"), F.lit(1))).alias("_g"))
    rate = F.col("errors") / F.col("total")
    return per.crossJoin(F.broadcast(whole)).select(entity, "total", "errors", F.round(rate, 4).alias("rate"), ((rate > 2 * F.col("_g")) & (F.col("errors") >= 5)).alias("flagged"))


def top_errors(records: DataFrame, entity: str, code: str, n: int = 5) -> DataFrame:
    """entity, code, count, rank: the most common error codes of each entity."""
    counts = records.where(_given(code)).groupBy(entity, code).agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("count"), code))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def mfa_features(records: DataFrame, entity: str, login: Column, second_factor: Column) -> DataFrame:
    """entity, logins, with_mfa, without_mfa over login events."""
    with_ = F.count(F.when(second_factor, 1))
    return records.where(login).groupBy(entity).agg(F.count("*").alias("logins"), with_.alias("with_mfa"), (F.count("*") - with_).alias("without_mfa"))


def entity_scores(profile: DataFrame, entity: str, total_events: int | Column, total_entities: int | Column) -> DataFrame:
    """entity, channel, score and its parts from rows (entity, channel, entropy, events).

    The parts: volume against the channel and against the entity, entropy against the channel (z, capped at
    five), rarity of the channel and share of all activity; their weighted sum goes through a sigmoid.
    """
    spread = lambda c: F.greatest(F.when(F.count("*") > 1, F.stddev_pop(c)).otherwise(F.lit(1.0)), F.lit(0.01))
    of_channel = profile.groupBy("channel").agg(F.avg("events").alias("_ce"), spread("events").alias("_cs"), F.avg("entropy").alias("_he"), spread("entropy").alias("_hs"), F.count("*").alias("_users"))
    of_entity = profile.groupBy(entity).agg(F.avg("events").alias("_ee"), spread("events").alias("_es"))
    df = profile.join(of_channel.withColumnRenamed("channel", "_c"), F.col("channel").eqNullSafe(F.col("_c"))).join(of_entity.withColumnRenamed(entity, "_e"), F.col(entity).eqNullSafe(F.col("_e")))
    df = df.withColumns({
        "channel_z": (F.col("events") - F.col("_ce")) / F.col("_cs"), "identity_z": (F.col("events") - F.col("_ee")) / F.col("_es"),
        "entropy_z": F.abs(F.col("entropy") - F.col("_he")) / F.col("_hs"),
    })
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    df = df.withColumns({"rarity": 1 - F.col("_users") / F.greatest(as_col(total_entities), F.lit(1)), "share": F.col("events") / F.greatest(as_col(total_events), F.lit(1))})
    raw = 0.30 * _capped(F.col("channel_z")) + 0.20 * _capped(F.col("identity_z")) + 0.15 * _capped(F.col("entropy_z")) + 0.20 * F.col("rarity") + 0.15 * _log_share(F.col("share"))
    r = lambda c, n: F.round(c, n).alias(c)
    return df.select(entity, "channel", F.round(_sigmoid(raw, 0.4), 4).alias("score"), "events", r("share", 4), r("channel_z", 2), r("identity_z", 2), r("entropy_z", 2), r("rarity", 4))


#: Entities of a block of the comparison of twins, as many blocks as can be of so few, and entities of a block at most.
TWIN_BLOCK, TWIN_BLOCKS, TWIN_LARGEST = 1024, 64, 4096
#: Entities of a block that are compared with another block at once, and least entities that are first compared for the closest twins.
TWIN_SLAB, TWIN_FIRST = 256, 8192


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Finite ``x`` of about one as Spark rounds: halves of the shortest decimal form go up, away from zero. A column's decimals cost more than a comparison."""
    scale = 10.0**places
    y = np.abs(x) * scale + 0.5
    out = np.copysign(np.floor(y) / scale, x)
    close = np.flatnonzero(np.abs(y - np.rint(y)) < 1e-6)  # products are not exact
    if len(close):
        values, which = np.unique(x[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values])[which]
    return out


def _twin_vectors(profile: DataFrame, entity: str, least_common: int) -> DataFrame:
    """e, v (channel, n) of the entities with enough channels, _n (the number of blocks), block."""
    cell = F.struct("channel", F.col("events").cast("double").alias("n"))
    own = profile.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("e")).agg(F.collect_list(cell).alias("v")).where(F.size("v") >= least_common)
    blocks = F.greatest(F.lit(1), F.least(F.lit(TWIN_BLOCKS), F.ceil(F.count("*") / TWIN_BLOCK)), F.ceil(F.count("*") / max(TWIN_BLOCK, TWIN_LARGEST)))
    n = F.broadcast(own.agg(blocks.alias("_n")))  # one row
    return own.crossJoin(n).withColumn("block", F.pmod(F.xxhash64("e"), F.col("_n")))


def _compare_twins(cells: DataFrame, least_common: int, similarity: float, most: int | None = None) -> DataFrame:
    """entity_a, entity_b, n_common, similarity of the twins in the cells (i, j) of rows (e, v, side, i, j).

    A cell holds the blocks of side i and j, or one block where they are equal. Where i is -1, its rows are least
    entities, which the block may hold as well, and twins are those whose lesser entity is of side i. Twins leave a
    cell slab by slab; with ``most`` only so many do, in the order of falling similarity, entity_a, entity_b.
    """
    kind = cells.schema["e"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ids = t["e"].to_pylist()
        mine = t["side"].to_numpy() == t["i"].to_numpy()
        order = np.array(sorted(range(len(ids)), key=lambda r: (ids[r], mine[r])))
        e = t["e"].combine_chunks().take(pa.array(order))
        held = t["channels"].combine_chunks()
        codes = held.flatten().dictionary_encode()
        x = np.zeros((len(ids), len(codes.dictionary)))
        at = np.repeat(np.arange(len(ids)), np.diff(held.offsets.to_numpy())), codes.indices.to_numpy()
        x[at] = t["n"].combine_chunks().flatten().to_numpy()
        has = np.zeros_like(x)
        has[at] = 1
        x, has, first = x[order], has[order], mine[order]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        alone = i == j  # not by the rows: a block may be empty
        left, right = np.flatnonzero(first), np.flatnonzero(first if alone else ~first)
        y, held_y, squares = x[right].T, has[right].T, (x[right] ** 2).T
        names, best, floor = ["entity_a", "entity_b", "n_common", "similarity"], None, -np.inf
        batch = lambda a, b, common, cos: pa.RecordBatch.from_arrays([e.take(pa.array(a)), e.take(pa.array(b)), pa.array(common.astype(np.int32)), pa.array(cos)], names)
        for k in range(0, len(left), TWIN_SLAB):
            part = left[k : k + TWIN_SLAB]
            shared = has[part] @ held_y
            with np.errstate(divide="ignore", invalid="ignore"):
                c = (x[part] @ y) / np.sqrt(((x[part] ** 2) @ held_y) * (has[part] @ squares))
            ok = (shared >= least_common) & (c > similarity) & (c > floor)
            if alone or i < 0:
                ok &= right > part[:, None]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            u, v = np.divmod(at, len(right))
            a, b = part[u], right[v]
            found = np.minimum(a, b), np.maximum(a, b), shared.ravel()[at], rounded(c.ravel()[at], 4)
            if most is None:
                yield batch(*found)
                continue
            best = found if best is None else [np.concatenate(both) for both in zip(best, found, strict=True)]
            if len(best[0]) > most:
                rank = (np.rint((2 - best[3]) * 10_000).astype(np.int64) * len(ids) + best[0]) * len(ids) + best[1]
                kept = np.argpartition(rank, most - 1)[:most]
                best = [values[kept] for values in best]
            if len(best[0]) == most:
                floor = best[3].min() - 0.0001  # what is rounded to less is not among them
        if best is not None:
            yield batch(*best)

    rows = cells.select("e", F.col("v.channel").alias("channels"), F.col("v.n").alias("n"), "side", "i", "j")
    return rows.groupBy("i", "j").applyInArrow(compare, f"entity_a {kind}, entity_b {kind}, n_common int, similarity double")


def behavioural_twins(profile: DataFrame, entity: str, least_common: int = 3, similarity: float = 0.95) -> DataFrame:
    """entity_a, entity_b, n_common, similarity: cosine of the event counts over the channels that two entities share.

    All pairs are asked for. Entities are dealt over blocks; a task compares two blocks by matrix products
    (products, squares and common channels), so no pair is a row before it is a twin, and an entity is
    copied once for each block. Blocks are bounded, and so is what a task holds, however many twins there are.
    """
    return _compare_twins(_twin_cells(_twin_vectors(profile, entity, least_common)), least_common, similarity)


def _twin_cells(own: DataFrame) -> DataFrame:
    dealt = own.select("e", "v", F.col("block").alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("o"))
    return dealt.withColumns({"i": F.least("side", "o"), "j": F.greatest("side", "o")})


def closest_twins(profile: DataFrame, entity: str, most: int, least_common: int = 3, similarity: float = 0.95) -> list[dict]:
    """The first ``most`` of ``behavioural_twins`` by falling similarity, entity_a, entity_b.

    Nothing is above a similarity of 1, so where the least TWIN_FIRST entities have so many twins of 1 among all
    entities, these are the first. Else all pairs are compared; either way a task keeps its ``most`` best only.
    """
    own = _twin_vectors(profile, entity, least_common)

    def best(cells: DataFrame) -> list[dict]:
        found = _compare_twins(cells, least_common, similarity, most)
        return [r.asDict() for r in found.orderBy(F.desc("similarity"), "entity_a", "entity_b").limit(most).collect()]

    to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    least = own.orderBy("e").limit(TWIN_FIRST).select("e", "v", F.lit(-1).cast("long").alias("side"), to_all.alias("j"))
    found = best(least.unionByName(own.select("e", "v", F.col("block").alias("side"), F.col("block").alias("j"))).withColumn("i", F.lit(-1).cast("long")))
    return found if len(found) == most and found[-1]["similarity"] >= 1 else best(_twin_cells(own))


def family_scales(records: DataFrame, grain: int = 0) -> dict[str, Any]:
    """Grain and scales of the folded day of a family's records; no scales below five records."""
    if len(records.limit(5).collect()) < 5:
        return {"grain": grain, "scales": []}
    own = estimate_grain(records).first()["grain"]
    size = max(own, grain)
    n = DAY // size
    day = folded_day(records, size)
    first, last, held = day.agg(F.min("slot"), F.max("slot"), F.count("*")).first()
    if n < 2 or held < 2:
        return {"grain": size, "scales": []}
    scales = scales_of_mass(day.select((F.col("slot") - first).alias("bin"), F.col("n").cast("double").alias("m")), last - first + 1, n, 1, 0.01, 5)
    return {"grain": size, "scales": [{**s, "window_bins": s["window"], "window": s["window"] * size} for s in scales]}


def label_of(seconds: int) -> str:
    for unit, mark in ((86_400, "d"), (3600, "h"), (60, "m")):
        if seconds >= unit:
            return f"{seconds // unit}{mark}"
    return f"{seconds}s"


def findings(scores: Sequence[Mapping], twins: Sequence[Mapping], error_rate: float, bridges: Sequence[Mapping], scales: Sequence[Mapping]) -> list[dict]:
    """Ranked statements from small results, by severity: concern, attention, info. ``scores`` are in falling order."""
    out = []

    def say(severity: str, title: str, description: str, **evidence):
        out.append({"severity": severity, "title": title, "description": description, "evidence": evidence})

    if scores and scores[0]["share"] > 0.1:
        t = scores[0]
        say("attention" if t["share"] > 0.3 else "info", "Dominant identity", f"{t['entity']} makes {t['share']:.0%} of all events through {t['channel']} ({t['events']:,}).", **t)
    for t in twins:
        say("attention", "Behavioural twins", f"{t['entity_a']} and {t['entity_b']} act alike on {t['n_common']} channels (cosine {t['similarity']:.2f}).", **t)
    if error_rate > 0.05:
        say("concern" if error_rate > 0.1 else "attention", "Error rate", f"{error_rate:.1%} of the events are errors.", error_rate=error_rate)
    for s in [s for s in scores if s["rarity"] > 0.9 and s["events"] > 5][:3]:
        say("info", "Rare usage", f"{s['entity']} uses {s['channel']} ({s['events']} events), which few others do.", **s)
    if bridges:
        say("info", "Coupled groups", f"{bridges[0]} moves together across groups.", **bridges[0])
    active = [s for s in scales if s["gain"] > 0.01]
    if len(active) > 5:
        say("info", "Structure at many scales", f"{len(active)} scales carry structure: {', '.join(label_of(s['window']) for s in active[:6])}.", n_scales=len(active))
    return sorted(out, key=lambda f: ("concern", "attention", "info").index(f["severity"]))


def analyze(records: DataFrame, entity: str, schema: AnalysisSchema | None = None, grain: int | None = None, top_n: int = 10, error: str | Column | None = None, shown: int = 200) -> dict[str, Any]:
    """All of the above over one records frame: a dict of distributed tables, small driver results and findings.

    Findings name the ``shown`` highest scores and twins; the tables behind them are whole.
    """
    schema = schema or AnalysisSchema(categorical=(entity, "channel"))
    total = summary(records, list(schema.categorical) or [entity, "channel"], error, schema.summary_aliases)
    t = total.first().asDict()
    grain = grain or estimate_grain(records).first()["grain"]
    counts = records_to_signals(records, [entity, "channel"], "count")
    profile = channel_entropy(counts, [entity, "channel"])
    n_entities = records.agg(F.count_distinct(entity)).first()[0]
    scores = entity_scores(profile, entity, t["total_events"], n_entities)
    sessions = discover_segments(records, [entity])
    scales = family_scales(records, grain)["scales"]
    active = [s["window"] for s in scales if s["gain"] > 0.01]
    twins = behavioural_twins(profile, entity)
    within = mi_pairs(counts, ["channel", entity], (), top_n)
    bridges = bridge_pairs(counts, [entity], ["channel"], top_n)
    ranked = [r.asDict() | {"entity": r[entity]} for r in scores.orderBy(F.desc("score"), entity, "channel").limit(shown).collect()]
    return {
        "summary": t, "grain": grain, "discovered_scales": scales, "channel_entropy": profile, "sessions": sessions, "families": join_sessions(records, schema.families),
        "session_scores": score_sessions(sessions, t["total_events"]), "scores": scores, "temporal": temporal_features(records, entity), "pairwise_mi": within.unionByName(bridges, allowMissingColumns=True),
        "scalemap": scalemap(records, active, grain) if active else None, "errors": error_rates(records, entity, error) if error is not None else None, "twins": twins,
        "findings": findings(ranked, closest_twins(profile, entity, shown), t["error_rate"] or 0.0, [r.asDict() for r in bridges.orderBy(F.desc("mi")).limit(1).collect()], scales),
    }
