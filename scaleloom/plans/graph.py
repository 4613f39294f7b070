"""A typed graph of operators over records frames; nodes are built anew for each run.

Constraints of the operators (grain, windows, horizon) are gathered into one sampling plan before
anything is executed; every node then composes a lazy DataFrame.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregations import get_profile
from ..operators import binning, features, surface, surface_ops
from ..operators.segments import grain_from_orders
from .lattice import SamplingPlan, derive_plan


class Kind(str, Enum):
    RECORDS = "records"
    SIGNALS = "signals"
    BINNED = "binned"
    SURFACES = "surfaces"
    TENSORS = "tensors"
    BUNDLE = "bundle"


@dataclass(frozen=True)
class Artifact:
    """A frame with its kind and a lineage id that depends on plan, operator, parameters and parents only."""

    kind: Kind
    frame: DataFrame
    plan: SamplingPlan
    by: tuple[str, ...]
    id: str
    label: str = ""


@dataclass(frozen=True)
class Node:
    """An operator applied to nodes. ``run`` takes the artifacts of the parents, the plan and the groups."""

    name: str
    takes: tuple[frozenset[Kind], ...]
    gives: Kind
    run: Callable[..., DataFrame]
    params: Mapping[str, Any] = field(default_factory=dict)
    constraints: Mapping[str, Any] = field(default_factory=dict)
    parents: tuple[Node, ...] = ()
    label: str = ""
    many: bool = False

    def __call__(self, *parents: Node) -> Node:
        takes = self.takes * len(parents) if self.many else self.takes
        if len(parents) != len(takes) or not parents and takes:
            raise TypeError(f"{self.name} takes {len(takes)} inputs, not {len(parents)}")
        for p, kinds in zip(parents, takes, strict=True):
            if p.gives not in kinds:
                raise TypeError(f"{self.name} cannot take {p.gives.value} from {p.name}")
        return Node(self.name, self.takes, self.gives, self.run, self.params, self.constraints, parents, self.label, self.many)


def _one(*kinds: Kind) -> tuple[frozenset[Kind], ...]:
    return (frozenset(kinds),)


def Input(mode: str = "signals", agg: str = "mean", grain: int | None = None) -> Node:
    """Records as they are, or as signals with one point for each order."""
    if mode == "records":
        return Node("Input", (), Kind.RECORDS, lambda plan, by, df: df, {"mode": mode}, {"grain": grain})
    return Node("Input", (), Kind.SIGNALS, lambda plan, by, df: binning.records_to_signals(df, by, agg), {"mode": mode, "agg": agg}, {"grain": grain})


def Bin(agg: str | Mapping = "mean", scope: Mapping | None = None) -> Node:
    return Node("Bin", _one(Kind.RECORDS), Kind.BINNED, lambda plan, by, a: binning.materialize(a.frame, plan.cbin, by, agg, scope), {"agg": agg})


def Transform(fn: Callable[[DataFrame], DataFrame]) -> Node:
    """Any function of binned rows."""
    return Node("Transform", _one(Kind.BINNED), Kind.BINNED, lambda plan, by, a: fn(a.frame), {"fn": getattr(fn, "__name__", "fn")})


def Measure(agg: str | Sequence[str] = "mean", profile: str | None = None, windows: Sequence[int] = (), horizon: int | None = None, axis: str | None = None) -> Node:
    names = list(get_profile(profile)) if profile else agg

    def run(plan, by, a):
        if a.kind == Kind.SIGNALS:
            return surface.measure(binning.bin_signal(a.frame, plan.cbin, by), plan, by, names, axis or "signal")
        return surface.measure(a.frame, plan, by, names, axis or "global")

    label = profile or (agg if isinstance(agg, str) else "_".join(agg))
    return Node("Measure", _one(Kind.SIGNALS, Kind.BINNED), Kind.SURFACES, run, {"agg": names}, {"windows": tuple(windows), "horizon": horizon}, label=label)


def Baseline(method: str = "ewma", alpha: float = 0.1, window: int = 10) -> Node:
    return Node("Baseline", _one(Kind.SURFACES), Kind.SURFACES, lambda plan, by, a: surface_ops.baseline(a.frame, by, method, alpha, window), {"method": method, "alpha": alpha, "window": window}, label=f"baseline_{method}")


def Residual(mode: str = "difference") -> Node:
    return Node("Residual", _one(Kind.SURFACES) * 2, Kind.SURFACES, lambda plan, by, m, b: surface_ops.residual(m.frame, b.frame, by, mode), {"mode": mode}, label=f"residual_{mode}")


def Hilbert(value: str | None = None) -> Node:
    return Node("Hilbert", _one(Kind.SURFACES), Kind.SURFACES, lambda plan, by, a: surface_ops.hilbert(a.frame, by, value), {"value": value}, label="hilbert")


def Gradient(value: str | None = None) -> Node:
    return Node("Gradient", _one(Kind.SURFACES), Kind.SURFACES, lambda plan, by, a: surface_ops.gradient(a.frame, plan, by, value), {"value": value}, label="gradient")


def Stack() -> Node:
    """Any number of surfaces side by side, named by their labels."""
    return Node("Stack", _one(Kind.SURFACES), Kind.SURFACES, lambda plan, by, *a: surface_ops.stack([(x.label or f"src{i}", x.frame) for i, x in enumerate(a)], by), label="stack", many=True)


def Engineer(ewma_alpha: float = 0.3, rolling_window: int = 5) -> Node:
    return Node("Engineer", _one(Kind.SURFACES), Kind.TENSORS, lambda plan, by, a: features.engineer(a.frame, plan, by, ewma_alpha, rolling_window), {"ewma_alpha": ewma_alpha, "rolling_window": rolling_window})


def Assemble(entity: Column | None = None) -> Node:
    def run(plan, by, *a):
        name = entity if entity is not None else binning.canonical_keys({k: F.col(k).cast("string") for k in by if k not in ("channel", "metric")})
        return features.assemble([x.frame for x in a], by, name)

    return Node("Assemble", _one(Kind.TENSORS), Kind.BUNDLE, run, many=True)


def nodes_of(*outputs: Node) -> list[Node]:
    """Parents before children, each once."""
    out: list[Node] = []

    def visit(n: Node) -> None:
        if any(n is m for m in out):
            return
        for p in n.parents:
            visit(p)
        out.append(n)

    for n in outputs:
        visit(n)
    return out


class Pipeline:
    """Runs the graph that ends in ``output`` over records grouped by ``by``."""

    def __init__(self, output: Node, by: Sequence[str] = ("channel",), grain: int | None = None, windows: Sequence[int] = (), horizon: int | None = None, cbin: int | None = None):
        self.output, self.by = output, tuple(by)
        self.given = {"grain": grain, "windows": tuple(windows), "horizon": horizon, "cbin": cbin}

    def constraints(self) -> dict[str, Any]:
        """Grain: the largest; windows: the union; horizon: the largest. What was given here replaces them."""
        own = [n.constraints for n in nodes_of(self.output)]
        grains = [c["grain"] for c in own if c.get("grain")]
        horizons = [c["horizon"] for c in own if c.get("horizon")]
        windows = sorted({w for c in own for w in c.get("windows") or ()})
        return {"grain": self.given["grain"] or max(grains, default=None), "windows": self.given["windows"] or tuple(windows), "horizon": self.given["horizon"] or max(horizons, default=None)}

    def resolve(self, records: DataFrame | None = None) -> SamplingPlan:
        """The plan; only an automatic grain reads the data (one small job)."""
        c = self.constraints()
        if self.given["cbin"]:
            return SamplingPlan.from_windows(c["windows"], self.given["cbin"])
        grain, span = c["grain"], None
        if records is not None and grain is None:
            grain = grain_from_orders(records, c["horizon"])
        if records is not None and not c["windows"] and not c["horizon"]:
            lo, hi = records.agg(F.min("order"), F.max("order")).first()
            span = hi - lo + 1 if lo is not None else None
        return derive_plan(grain, c["windows"], c["horizon"], span)

    def run(self, records: DataFrame, plan: SamplingPlan | None = None) -> Artifact:
        plan = plan or self.resolve(records)
        built: dict[int, Artifact] = {}
        for n in nodes_of(self.output):
            parents = [built[id(p)] for p in n.parents]
            frame = n.run(plan, self.by, *(parents or [records]))
            built[id(n)] = Artifact(n.gives, frame, plan, self.by, lineage(n, plan, [p.id for p in parents]), n.label)
        return built[id(self.output)]

    def summary(self) -> str:
        return "\n".join(f"{n.name}({', '.join(f'{k}={v}' for k, v in n.params.items() if v is not None)}) -> {n.gives.value}" for n in nodes_of(self.output))


def lineage(node: Node, plan: SamplingPlan, parents: Sequence[str]) -> str:
    said = json.dumps([node.gives.value, [plan.horizon, plan.grain, plan.cbin, list(plan.windows)], node.name, dict(node.params), list(parents)], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:16]
