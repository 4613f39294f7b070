"""Writers of bundles, surfaces and results."""

from __future__ import annotations

import importlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import entity_array
from ..operators.surface_ops import zscores


def safe_name(entity: str) -> str:
    return entity.replace("/", "_").replace(";", "_").replace("=", "-")


def export_csv(bundle: DataFrame, path: str) -> None:
    """A folder of CSV files (channel, scale, time, value) for each entity."""
    rows = bundle.selectExpr("entity", "channel_name AS channel", "scale", "bin AS time", "value")
    rows.write.partitionBy("entity").csv(path, header=True)


def export_numpy(bundle: DataFrame, entity: str, folder: str) -> str:
    """One entity's (channels, scales, bins) array as .npy; returns the file."""
    out = Path(folder) / f"{safe_name(entity)}.npy"
    out.parent.mkdir(parents=True, exist_ok=True)
    np.save(out, entity_array(bundle, entity))
    return str(out)


def packed(bundle: DataFrame) -> DataFrame:
    """entity, shape (channels, scales, bins), data (little-endian float32, nulls as NaN), label if there: a row for each entity, packed on the cluster."""
    labelled = "label" in bundle.columns
    fields = f"entity {bundle.schema['entity'].dataType.simpleString()}, shape array<int>, data binary" + (f", label {bundle.schema['label'].dataType.simpleString()}" if labelled else "")

    def pack(t: pa.Table) -> pa.Table:
        axes = [np.unique(t[c].to_numpy(), return_inverse=True) for c in ("scale", "bin")]
        n = int(np.max(t["channel_idx"].to_numpy())) + 1
        out = np.full((n, *(len(a) for a, _ in axes)), np.nan, np.float32)
        out[t["channel_idx"].to_numpy(), axes[0][1], axes[1][1]] = t["value"].to_numpy()
        row = {"entity": t["entity"][:1], "shape": pa.array([list(out.shape)], pa.list_(pa.int32())), "data": pa.array([out.astype("<f4").tobytes()], pa.binary())}
        return pa.table(row | ({"label": t["label"][:1]} if labelled else {}))

    return bundle.groupBy("entity").applyInArrow(pack, fields)


class SurfaceDataset:
    """The arrays of a bundle, entity by entity, as tensors if torch is there: what a training loop iterates over.

    ``transform`` is applied to each array as it is read. With labels in the bundle items are (array, label). Items
    come from the cluster one at a time, in the order of entities; ``len`` counts them.
    """

    def __init__(self, bundle: DataFrame, transform: Callable | None = None, tensors: bool = False):
        self.rows, self.transform, self.tensors = packed(bundle).orderBy("entity"), transform, tensors

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self):
        make = importlib.import_module("torch").from_numpy if self.tensors else lambda x: x
        for r in self.rows.toLocalIterator():
            x = make(np.frombuffer(r["data"], "<f4").reshape(r["shape"]).copy())
            x = self.transform(x) if self.transform else x
            yield (x, r["label"]) if "label" in self.rows.columns else x


def as_dataset(bundle: DataFrame, transform: Callable | None = None) -> SurfaceDataset:
    return SurfaceDataset(bundle, transform)


def as_torch(bundle: DataFrame) -> list:
    """A tensor for each entity; an ImportError without torch."""
    importlib.import_module("torch")
    return list(SurfaceDataset(bundle.drop("label"), tensors=True))


def save(df: DataFrame, path: str, meta: Mapping | None = None) -> None:
    """Parquet with a JSON description beside it, both through Spark so that any store will do."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(dict(meta or {}), default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def heatmap(surface: DataFrame, by, value: str = "mean", limit: float = 4.0) -> DataFrame:
    """z along each scale row, clipped: what a heat map of a surface shows."""
    z = zscores(surface, by, value)
    return z.selectExpr(*by, "window", "bin", f"greatest(least(z, {limit}), -{limit}) AS z")


def draw_heatmap(surface: DataFrame, by, path: str, value: str = "mean", width: int = 1200, height: int = 12) -> None:
    """A PNG of ``heatmap`` for a surface of one signal: a band of ``height`` pixels for each window, the longest on top, blue below and red above the mean.

    Bins are averaged to ``width`` columns on the cluster, so windows times ``width`` numbers reach the driver.
    """
    z = heatmap(surface, by, value)
    lo, hi = z.agg(F.min("bin"), F.max("bin")).first()
    columns = min(width, hi - lo + 1)
    cells = z.groupBy("window", F.floor((F.col("bin") - lo) * columns / (hi - lo + 1)).cast("int").alias("x")).agg(F.avg("z").alias("z")).collect()
    windows = sorted({r["window"] for r in cells}, reverse=True)
    grid = np.zeros((len(windows), columns))
    for r in cells:
        grid[windows.index(r["window"]), r["x"]] = r["z"] or 0.0
    shade = np.clip(np.abs(grid) / 4.0, 0, 1)
    rgb = np.stack([np.where(grid < 0, 1 - shade, 1.0), 1 - shade, np.where(grid > 0, 1 - shade, 1.0)], axis=-1)
    pixels = np.repeat((rgb * 255).astype(np.uint8), height, axis=0)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", columns, len(pixels), 8, 2, 0, 0, 0)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def to_json(results: Mapping, rows: int = 100) -> str:
    """JSON of a dict of results; of tables the first ``rows`` rows."""

    def plain(v):
        if isinstance(v, DataFrame):
            return [plain(r.asDict(recursive=True)) for r in v.limit(rows).collect()]
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v

    return json.dumps(plain(results), default=str, indent=2)


def report(results: Mapping) -> str:
    """A text report of ``analyze``."""
    lines = ["Summary", *[f"  {k}: {v}" for k, v in results["summary"].items()], f"Grain {results['grain']} s", "Scales"]
    lines += [f"  {s['window']:>8} s  gain {s['gain']:.4f}  entropy {s['entropy']:.3f}" for s in results["discovered_scales"]]
    lines.append("Findings")
    lines += [f"  [{f['severity']}] {f['title']}: {f['description']}" for f in results["findings"]]
    return "\n".join(lines)


def describe(results: Mapping) -> str:
    kinds = [re.sub(r"_", " ", k) for k, v in results.items() if isinstance(v, DataFrame)]
    return f"{results['summary']['total_events']:,} events; tables: {', '.join(kinds)}; {len(results['findings'])} findings"
