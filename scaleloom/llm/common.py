"""Helpers shared by the text operators: table access, written intermediates, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract of this subpackage defines them.
WS = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="scaleloom-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return _own[key]


def stash(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes what ``stash`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if df._stash_path in _written:
        _written.remove(df._stash_path)


def written() -> int:
    """How many tables ``stash`` has written and ``clear`` not deleted."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Deletes what ``stash`` wrote after ``written`` gave ``since``, but for ``keep``: once a result is written, no table behind it is read again."""
    kept = {df._stash_path for df in keep}
    for at in [p for p in _written[since:] if p not in kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(at)


#: Rows with one key beyond which its entry of a lookup table is broadcast, and entries that are broadcast at most.
FREQUENT, BROADCAST_KEYS = 500, 1_000_000


def lookup(rows: DataFrame, table_: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``table_``, which has one entry for each key and in ``n`` how many rows hold it (dropped).

    Entries of frequent keys, at most one for FREQUENT rows, are broadcast if there are not too many of them: so no
    key brings its rows into one task. The others meet by a shuffle. ``table_`` is read three times.
    """
    keys = list(keys)
    frequent = table_.where(F.col(n) > FREQUENT)
    if not 0 < frequent.count() <= BROADCAST_KEYS:
        return rows.join(table_.drop(n), keys)
    hot = rows.join(F.broadcast(frequent.drop(n)), keys)
    rest = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(table_.where(F.col(n) <= FREQUENT).drop(n), keys)
    return hot.unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); component is the least node reachable.

    Alternating large-star and small-star rounds: every round is two grouped minima (combined
    before the shuffle), a lookup of the first, in which a node with many edges is broadcast, and an equi-join
    of the second; both stars are written to the shared folder, so that no plan holds the lookup twice. The rounds
    end when all is stars around least nodes, that is when no node with a lesser neighbour has another one. Nothing
    is collected but whether there is such a node. Null ends and loops are ignored; no edges give no rows.
    """
    e = stash(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "cc")
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).selectExpr("u", "least(u, m) AS m", "n"), "cc")
        if low.where("m < u AND n > 1").isEmpty():
            break
        large = stash(lookup(both, low, ["u"]).where("v > u").selectExpr("v AS u", "m AS v").distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        new = stash(small.unionByName(least.selectExpr("u", "m AS v")).distinct(), "cc")
        for old in (e, low, large):
            unstash(old)
        e = new
    unstash(e)
    return low.selectExpr("u AS node", "m AS component")
