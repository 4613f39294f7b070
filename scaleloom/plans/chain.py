"""The fluent form: load, measure, baseline, residual, ...; immutable, nothing runs before ``run``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.records import Schema, auto_ingest
from ..sources.sinks import heatmap as _heatmap
from . import graph


@dataclass(frozen=True)
class Chain:
    source: DataFrame | None = None
    by: tuple[str, ...] = ("channel",)
    steps: tuple[tuple[str, dict[str, Any]], ...] = ()
    is_signal: bool = False

    def _with(self, step: str, **params) -> Chain:
        return replace(self, steps=(*self.steps, (step, params)))

    def measure(self, agg: str | Sequence[str] = "mean", profile: str | None = None, windows: Sequence[int] = (), horizon: int | None = None) -> Chain:
        return self._with("measure", agg=agg, profile=profile, windows=windows, horizon=horizon)

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Chain:
        """Applies to the records before they are measured."""
        return self._with("transform", fn=fn)

    def baseline(self, method: str = "ewma", alpha: float = 0.1, window: int = 10) -> Chain:
        """Of the measured surface, whatever came after it."""
        return self._with("baseline", method=method, alpha=alpha, window=window)

    def residual(self, mode: str = "difference") -> Chain:
        """Of the measured surface against the current one."""
        return self._with("residual", mode=mode)

    def hilbert(self, value: str | None = None) -> Chain:
        return self._with("hilbert", value=value)

    def gradient(self, value: str | None = None) -> Chain:
        return self._with("gradient", value=value)

    def stack(self) -> Chain:
        """The measured surface beside the current one."""
        return self._with("stack")

    def build(self) -> tuple[graph.Node, list[Callable]]:
        node = measured = None
        before = []
        for step, p in self.steps:
            if step == "transform":
                before.append(p["fn"])
                continue
            if step == "measure":
                start = graph.Node("Input", (), graph.Kind.SIGNALS, lambda plan, by, df: df) if self.is_signal else graph.Input()
                node = measured = graph.Measure(**p)(start)
            elif measured is None:
                raise ValueError(f"{step} needs measure before it")
            elif step == "baseline":
                node = graph.Baseline(**p)(measured)
            elif step == "residual":
                node = graph.Residual(**p)(measured, node)
            elif step == "stack":
                node = graph.Stack()(measured, node)
            else:
                node = {"hilbert": graph.Hilbert, "gradient": graph.Gradient}[step](**p)(node)
        if node is None:
            raise ValueError("nothing to run: measure first")
        return node, before

    def run(self, grain: int | None = None, windows: Sequence[int] = (), horizon: int | None = None, cbin: int | None = None) -> graph.Artifact:
        if self.source is None:
            raise ValueError("nothing loaded")
        node, before = self.build()
        frame = self.source
        for fn in before:
            frame = fn(frame)
        return graph.Pipeline(node, self.by, grain, windows, horizon, cbin).run(frame)

    def surfaces(self, **options) -> DataFrame:
        return self.run(**options).frame

    def heatmap(self, value: str = "mean", **options) -> DataFrame:
        return _heatmap(self.surfaces(**options), self.by, value)


def load(source: str | DataFrame, by: Sequence[str] = ("channel",), spark: SparkSession | None = None) -> Chain:
    """A chain over a CSV file of a known layout, or over a records frame."""
    frame = auto_ingest(spark or SparkSession.active(), source) if isinstance(source, str) else source
    if not frame.take(1):
        raise ValueError("no records")
    return Chain(frame, tuple(by))


def load_schema(source: str, schema: Schema | str, spark: SparkSession | None = None) -> Chain:
    schema = Schema.load(schema) if isinstance(schema, str) else schema
    return Chain(schema.read(spark or SparkSession.active(), source), ("channel", *schema.group_by))


def from_signal(signal: DataFrame, by: Sequence[str] = ("channel",)) -> Chain:
    return Chain(signal, tuple(by), is_signal=True)
