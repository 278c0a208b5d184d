"""python -m graphloom --conf FILE [key=value ...]"""

from __future__ import annotations

import argparse
import logging

from .plans.config import NetworkConfig
from .plans.job import run
from .plans.stages import stage_report
from .session import opened_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description="Build a network, compute its metrics, save it.")
    parser.add_argument("--conf", required=True, help="settings under network.*")
    parser.add_argument("settings", nargs="*", help="key=value, each before the file's")
    parser.add_argument("--lineage", action="store_true", help="show how the graph was made")
    parser.add_argument("--stages", action="store_true", help="show what each stage did")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    config = NetworkConfig.load(given.conf, dict(s.split("=", 1) for s in given.settings))
    with opened_session(config.type) as spark:
        result = run(spark, config)
        print(result.summary())
        if given.lineage:
            print(result.lineage())
        if given.stages:
            print(stage_report(spark))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
