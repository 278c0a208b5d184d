"""Settings of a job: keys under `network.`, read from HOCON-like text, JSON or mappings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..operators.filters import RangeFilter
from ..operators.metrics import ALL, metric

_KEYS = {
    "partition.strategy": ("partition_strategy", str), "partition.number": ("partition_number", int),
    "metric.eigencentrality.iterations": ("eigen_iterations", int),
    "metric.pagerank.iterations": ("pagerank_iterations", int), "metric.pagerank.resetProb": ("pagerank_reset", float), "metric.pagerank.tolerance": ("pagerank_tolerance", float),
    "extractGiantComponent": ("giant_component", bool), "sampleData": ("sample", bool), "sampleSize": ("sample_size", int), "removeUnconnected": ("drop_isolated", bool),
    "metric.modularity.useweight": ("modularity_use_weight", bool), "metric.modularity.min.updates": ("modularity_min_updates", int), "metric.modularity.resolution": ("modularity_resolution", float),
    "metric.modularity.increase": ("modularity_increase", float), "metric.modularity.iterations": ("modularity_iterations", int), "metric.modularity.impl": ("modularity_impl", str),
    "metric.betweenness.batchsize": ("betweenness_batch", int), "metric.betweenness.maxpivots": ("betweenness_pivots", int),
    "datasource": ("datasource", str), "exporter": ("exporter", str), "ego": ("ego", int), "ego.relations": ("ego_relations", int),
}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class NetworkConfig:
    type: str
    connection: str
    output: str
    datasource: str = "Elastic"
    exporter: str = "GephiExporter"
    partition_strategy: str = "CanonicalRandomVertexCut"
    partition_number: int = 0
    eigen_iterations: int = 100
    pagerank_iterations: int = 100
    pagerank_reset: float = 0.15
    pagerank_tolerance: float = 0.01
    giant_component: bool = False
    sample: bool = False
    sample_size: int = 20000
    drop_isolated: bool = True
    modularity_use_weight: bool = True
    modularity_min_updates: int = 1
    modularity_resolution: float = 1.0
    modularity_increase: float = 0.001
    modularity_iterations: int = 30
    modularity_impl: str = "louvain"
    betweenness_batch: int = 16
    betweenness_pivots: int = 64
    ego: int = 0
    ego_relations: int = 25
    metrics: tuple[str, ...] = ()
    filters: tuple[RangeFilter, ...] = field(default=())

    @classmethod
    def of(cls, *layers: Mapping[str, object]) -> NetworkConfig:
        """From flat or nested mappings; the first that has a key wins."""
        flat: dict[str, object] = {}
        for layer in layers:
            for k, v in flattened(layer).items():
                flat.setdefault(k, v)
        return cls._of(flat)

    @classmethod
    def _of(cls, flat: Mapping[str, object]) -> NetworkConfig:
        given = {k.removeprefix("network."): v for k, v in flat.items() if k.startswith("network.")}
        lacking = [k for k in ("type", "connectionString", "outputPath") if not given.get(k)]
        if lacking:
            raise ConfigError(f"missing: {', '.join('network.' + k for k in lacking)}")
        values = {name: _cast(given[k], kind, k) for k, (name, kind) in _KEYS.items() if k in given}
        names = [n.strip().upper() for n in str(given.get("metrics") or "").split(",") if n.strip()]
        names = list(dict.fromkeys(x for n in names for x in (ALL if n == "ALL" else (n,))))
        try:
            for n in names:
                metric(n)
        except ValueError as e:
            raise ConfigError(str(e)) from None
        return cls(str(given["type"]), str(given["connectionString"]), str(given["outputPath"]), metrics=tuple(names), filters=_filters(given), **values)

    @classmethod
    def load(cls, path: str, job: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> NetworkConfig:
        """A file under the job's own settings and those of the environment (network.* names)."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        system = {k: v for k, v in (os.environ if environment is None else environment).items() if k.startswith("network.")}
        return cls.of(job or {}, system, parsed(text))


def _cast(value: object, kind: type, key: str) -> object:
    try:
        if kind is bool:
            text = str(value).strip().lower()
            if text not in ("true", "false", "yes", "no", "on", "off"):
                raise ValueError
            return text in ("true", "yes", "on")
        return kind(value)
    except ValueError:
        raise ConfigError(f"network.{key}: {value!r} is no {kind.__name__}") from None


def _filters(given: Mapping[str, object]) -> tuple[RangeFilter, ...]:
    parts: dict[str, dict[str, object]] = {}
    for k, v in given.items():
        if m := re.fullmatch(r"filter\.([^.]+)\.(name|min|max)", k):
            parts.setdefault(m[1], {})[m[2]] = v
    found = []
    for key in sorted(parts):
        p = parts[key]
        try:
            m = metric(str(p.get("name", "")))
        except ValueError as e:
            raise ConfigError(str(e)) from None
        if m.cluster or m.value is None:
            raise ConfigError(f"no filter on {m.name}")
        low, high = (None if p.get(k) is None else float(str(p[k])) for k in ("min", "max"))
        found.append(RangeFilter(m.value, low, high))
    return tuple(dict.fromkeys(found))


def flattened(node: Mapping[str, object], before: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in node.items():
        if isinstance(v, Mapping):
            out |= flattened(v, f"{before}{k}.")
        else:
            out[f"{before}{k}"] = v
    return out


def parsed(text: str) -> dict[str, object]:
    """JSON, or the part of HOCON that such files use: nested blocks, `=` or `:`, comments, quoted strings, lists."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    tokens = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|#[^\n]*|[{}\[\],\n=:]|[^\s{}\[\],=:"#]+(?:[ \t]+[^\s{}\[\],=:"#]+)*', text)
    tokens = [t for t in tokens if not t.startswith(("//", "#"))]
    at = 0

    def skip(signs: str) -> None:
        nonlocal at
        while at < len(tokens) and tokens[at] in signs:
            at += 1

    def plain(t: str) -> object:
        return json.loads(t) if t.startswith('"') else t.strip()

    def value(stop: str = "\n,}") -> object:
        nonlocal at
        skip("\n")
        if at >= len(tokens):
            raise ConfigError("a value is missing")
        t = tokens[at]
        if t == "{":
            at += 1
            return block()
        if t == "[":
            at += 1
            items = []
            while True:
                skip("\n,")
                if at >= len(tokens):
                    raise ConfigError("a list is open")
                if tokens[at] == "]":
                    at += 1
                    return items
                items.append(value("\n,]"))
        at += 1
        out = [plain(t)]
        while at < len(tokens) and tokens[at] not in stop:  # signs inside an unquoted value, as in a path
            out.append(plain(tokens[at]))
            at += 1
        return out[0] if len(out) == 1 else "".join(str(x) for x in out)

    def block() -> dict[str, object]:
        nonlocal at
        out: dict[str, object] = {}
        while True:
            skip("\n,")
            if at >= len(tokens) or tokens[at] == "}":
                at += 1
                return out
            key = str(plain(tokens[at]))
            at += 1
            skip("\n")
            if at < len(tokens) and tokens[at] in "=:":
                at += 1
            got = value()
            rest = key.split(".")
            inner = out
            for part in rest[:-1]:
                inner = inner.setdefault(part, {})
            last = rest[-1]
            inner[last] = {**inner[last], **got} if isinstance(got, dict) and isinstance(inner.get(last), dict) else got

    skip("\n")
    if at < len(tokens) and tokens[at] == "{":
        at += 1
    return block()
