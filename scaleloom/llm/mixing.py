"""Mixing of sources to target weights by Pfair scheduling.

A source's documents are cut into blocks. Were sources served continuously, each in proportion to its
weight until it runs out, source k would have had min(n_k, w_k V) blocks at virtual time V, and all of
them together T(V). Block i of k is released at slot floor(T((i - 1) / w_k)) and due at ceil(T(i / w_k));
at each slot the released block with the earliest deadline runs. The rates sum to one at any time, so
every deadline is met and at any slot each source has had its share to within less than one block.
Weights are exact rationals (a float is one) and all times are whole numbers, so nothing is rounded.

The schedule has one entry for each block. Blocks grow with the corpus, so that there are at most SLOTS
of them and one more for each source: the driver's work and the table that is joined stay bounded.

Edge cases: a null source is a source of its own; sources without a positive weight come last, with equal
weights; null ids and repeated rows each get their place; an empty table gives no rows; of clashing
column names the mixing's own (mix_phase, mix_slot, mix_position) win, all others stay as they are.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash

#: Documents in a block at least, blocks of a schedule, rows that one sorting group of a source holds, and rows of a table that is broadcast at most.
BLOCK, SLOTS, GROUP, BROADCAST_ROWS = 64, 1_000_000, 2_000, 1_000_000
OWN = ("mix_phase", "mix_slot", "mix_position")


def exact(weights: Mapping) -> dict:
    """Whole numbers in the very proportions of the weights."""
    parts = {k: Fraction(w) for k, w in weights.items()}
    whole = lcm(*(p.denominator for p in parts.values()))
    return {k: int(p * whole) for k, p in parts.items()}


class Fluid:
    """The continuous service of sources with whole weights: T(V), piecewise linear, in exact arithmetic."""

    def __init__(self, blocks: Mapping, weights: Mapping):
        ends = sorted(blocks, key=lambda k: Fraction(blocks[k], weights[k]))
        self.weights = weights
        self.ends = [Fraction(blocks[k], weights[k]) for k in ends]  # virtual times at which a source runs out
        self.near = [float(e) for e in self.ends]
        self.done, self.rate = [0], [sum(weights.values())]  # blocks of those that ran out, weight of the others
        for k in ends:
            self.done.append(self.done[-1] + blocks[k])
            self.rate.append(self.rate[-1] - weights[k])

    def phase(self, i: int, k) -> int:
        """How many sources have run out when block ``i`` of ``k`` is complete."""
        w = self.weights[k]
        p = bisect_left(self.near, i / w)
        while p > 0 and self.ends[p - 1] * w >= i:
            p -= 1
        while p < len(self.ends) and self.ends[p] * w < i:
            p += 1
        return p

    def slots(self, i: int, k) -> tuple[int, int]:
        """Floor and ceiling of the time at which block ``i`` of ``k`` is complete."""
        p, w = self.phase(i, k), self.weights[k]
        whole, rest = divmod(self.rate[p] * i, w)
        return self.done[p] + whole, self.done[p] + whole + (rest > 0)


def schedule(blocks: Mapping, weights: Mapping) -> dict:
    """By source its (slot, phase) pairs in order; the phase is the number of sources whose share was complete."""
    out: dict = {k: [] for k, n in blocks.items() if n}
    t = phase = 0
    for active in ([k for k in out if (weights.get(k) or 0) > 0], [k for k in out if not (weights.get(k) or 0) > 0]):
        if not active:
            continue
        keys = sorted(active, key=lambda k: (str(k), k is None))
        fluid = Fluid({k: blocks[k] for k in keys}, exact({k: weights[k] if (weights.get(k) or 0) > 0 else 1 for k in keys}))
        ready = [(fluid.slots(1, k)[1], n, 1) for n, k in enumerate(keys)]
        heapq.heapify(ready)
        later: list = []  # (release, block)
        start = t
        for _ in range(sum(blocks[k] for k in keys)):
            while later and later[0][0] <= t - start:
                heapq.heappush(ready, heapq.heappop(later)[1])
            _, n, i = heapq.heappop(ready)
            k = keys[n]
            out[k].append((t, phase + fluid.phase(i, k)))
            t += 1
            if i < blocks[k]:
                heapq.heappush(later, (fluid.slots(i, k)[0], (fluid.slots(i + 1, k)[1], n, i + 1)))
        phase += len(keys)
    return out


def _free(columns: list[str]) -> str:
    """A prefix that no column has."""
    prefix = "_mix_"
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def block_size(n_docs: int, block: int = BLOCK) -> int:
    return max(block, -(-n_docs // SLOTS))


def mix(docs: DataFrame, weights: Mapping | None = None, block: int = BLOCK, key: str = "source", seed: int = 0) -> DataFrame:
    """``docs`` with mix_phase, mix_slot (of the block) and mix_position (of the document: unique, in the order of slots).

    Without ``weights`` a source weighs the square root of its number of documents. One row for each
    source reaches the driver, which lays out the blocks (``block_size`` documents each). Places within
    a source come from hash groups of bounded size with their offsets, so a source with a third of all
    rows is dealt over many tasks.
    """
    docs = docs.drop(*OWN)
    p = _free(docs.columns)
    h, g, src, r, b, num, groups_, before_ = (p + x for x in ("hash", "group", "source", "rank", "block", "number", "groups", "before"))
    rows = docs.withColumn(h, F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    counts = {x[0]: x[1] for x in docs.groupBy(key).count().collect()}
    block = block_size(sum(counts.values()), block)
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    groups = {k: -(-n // GROUP) for k, n in counts.items()}
    sizes = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(groups.items())], T.StructType([T.StructField(src, kind), T.StructField(groups_, T.LongType()), T.StructField(num, T.IntegerType())]))
    rows = rows.join(_small(sizes, len(counts)), F.col(key).eqNullSafe(F.col(src)), "left").withColumn(g, F.pmod(F.col(h), F.col(groups_))).drop(src, groups_)
    plan = schedule({k: -(-n // block) for k, n in counts.items()}, weights if weights is not None else {k: n**0.5 for k, n in counts.items()})
    laid = [(n, i, phase, t) for n, k in enumerate(counts) for i, (t, phase) in enumerate(plan[k])]
    table = spark.createDataFrame(pa.table({c: pa.array([x[i] for x in laid], t) for i, (c, t) in enumerate(((num, pa.int32()), (b, pa.int64()), ("mix_phase", pa.int32()), ("mix_slot", pa.int64())))}))
    per_group = rows.groupBy(num, g).agg(F.count("*").alias(r))
    before = F.coalesce(F.sum(r).over(Window.partitionBy(num).orderBy(g).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stash(per_group.select(num, g, before.alias(before_)), "offsets")
    order = Window.partitionBy(num, g).orderBy(h, *[F.col(c) for c, t in docs.dtypes if c == "doc_id"], F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]))
    ranked = rows.withColumn(r, F.row_number().over(order) - 1).join(_small(offsets, sum(groups.values())), [num, g], "left")
    ranked = ranked.withColumn(r, F.col(r) + F.col(before_)).withColumn(b, F.floor(F.col(r) / block))
    placed = ranked.join(_small(table, len(laid)), [num, b], "left")
    return placed.withColumn("mix_position", F.col("mix_slot") * block + F.pmod(F.col(r), F.lit(block))).select(*docs.columns, *OWN)


def arranged(docs: DataFrame, **options) -> DataFrame:
    """``mix``, with the rows in the order of mix_position within and across the partitions."""
    mixed = mix(docs, **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    block = block_size(n, options.get("block", BLOCK))
    per = max(1, -(-(n + block * 64) // parts))
    return mixed.repartitionById(parts, F.least(F.floor(F.col("mix_position") / per), F.lit(parts - 1)).cast("int")).sortWithinPartitions("mix_position")
