"""Grids of valuations of the integers around an anchor, made by Spark from ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import factorize, to_int


def valuation_column(n: Column, p: Column | int, most: int = 63) -> Column:
    """v_p(n): how many of the powers p, p^2, ... divide n; powers stop where they pass 64 bits."""
    p = F.lit(p) if isinstance(p, int) else p
    power = lambda k: F.round(F.pow(p.cast("double"), k)).cast("decimal(38,0)")
    ks = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.pow(p.cast("double"), k) <= n)
    return F.size(F.filter(ks, lambda k: n.cast("decimal(38,0)") % power(k) == 0))


def primes_of(lo: int, hi: int) -> list[int]:
    return sorted({p for n in range(lo, hi + 1) for p in factorize(n)})


def neighborhood(spark: SparkSession, anchor: int, radius: int, basis: Sequence[int] | None = None) -> DataFrame:
    """prime, n, valuation for n within ``radius`` of the anchor; the basis defaults to every prime that divides one of them."""
    if anchor < 1 or radius < 0:
        raise ValueError("the anchor must be positive and the radius not negative")
    lo, hi = max(1, anchor - radius), anchor + radius
    basis = list(basis) if basis is not None else primes_of(lo, hi)
    primes = spark.createDataFrame([(p,) for p in basis], "prime int")
    grid = spark.range(lo, hi + 1).withColumnRenamed("id", "n").crossJoin(F.broadcast(primes))  # a basis of a few primes
    return grid.select("prime", "n", valuation_column(F.col("n"), F.col("prime")).alias("valuation"))


def neighborhood_from_vector(spark: SparkSession, coord: Mapping[int, int], radius: int) -> DataFrame:
    anchor = to_int(coord)
    lo, hi = max(1, anchor - radius), anchor + radius
    return neighborhood(spark, anchor, radius, sorted({*coord, *primes_of(lo, hi)}))


def residuals(grid: DataFrame) -> DataFrame:
    """n, residual (n without the powers of the basis), is_prime_column (one prime of the basis, once)."""
    part = F.pow(F.col("prime").cast("double"), F.col("valuation"))
    out = grid.groupBy("n").agg(F.round(F.product(part)).cast("long").alias("_q"), F.sum("valuation").alias("_s"), F.max("valuation").alias("_m"))
    return out.select("n", F.expr("n div _q").alias("residual"), ((F.col("_s") == 1) & (F.col("_m") == 1)).alias("is_prime_column"))


def show(grid: DataFrame) -> str:
    """The grid as text; for the neighbourhoods one looks at."""
    rows = grid.collect()
    ns, primes = sorted({r["n"] for r in rows}), sorted({r["prime"] for r in rows})
    at = {(r["prime"], r["n"]): r["valuation"] for r in rows}
    head = "      " + "".join(f"{n:>5}" for n in ns)
    return "\n".join([head, *[f"{p:>5} " + "".join(f"{at[p, n] or '.':>5}" for n in ns) for p in primes]])
