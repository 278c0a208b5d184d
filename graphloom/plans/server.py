"""A job as a job server calls it: first validate its settings, then run it in a session that the server owns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators.metrics import validate as validated
from . import networks
from .config import NetworkConfig
from .job import run


@dataclass(frozen=True)
class Valid:
    pass


@dataclass(frozen=True)
class Invalid:
    reason: str


def validate(settings: Mapping[str, object]) -> Valid | Invalid:
    """Whether the settings name a job: nothing is read or run."""
    try:
        config = NetworkConfig.of(settings)
        network = networks.network(config.type)
        networks.source(config.datasource), networks.exporter(config.exporter)
        validated(config.metrics, network.directed, network.weighted)
    except ValueError as e:
        return Invalid(str(e))
    return Valid()


def run_job(spark: SparkSession, settings: Mapping[str, object]) -> dict[str, object]:
    """Run a job; what it wrote, and how long its phases took. The session stays open."""
    found = validate(settings)
    if isinstance(found, Invalid):
        raise ValueError(found.reason)
    result = run(spark, NetworkConfig.of(settings))
    return {"graph": result.graph_file, "statistics": result.stats_file, "seconds": dict(result.seconds)}
