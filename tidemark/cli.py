"""``python -m tidemark.cli task|sequence --config FILE [--set KEY=VALUE]...`` and ``doctor [--training] [--project-root FOLDER]``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark import doctor
from tidemark.config import load
from tidemark.plans.runner import SequenceRunner, TaskRunner


def arguments(args: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("task", "sequence"):
        command = commands.add_parser(name)
        command.add_argument("--config", required=True)
        command.add_argument("--set", dest="overrides", action="append", default=[], metavar="KEY=VALUE")
    command = commands.add_parser("doctor")
    command.add_argument("--project-root", type=Path)
    command.add_argument("--training", action="store_true", help="also the pinned versions of the training backend")
    return parser.parse_args(args)


def main(args: Sequence[str] | None = None) -> int:
    given = arguments(args)
    if given.command == "doctor":
        report = doctor.report(given.project_root, given.training)
        print(json.dumps(report, indent=2, ensure_ascii=False))
        return int(not doctor.sound(report))
    try:
        config = load(given.config, given.overrides)
        kind = SequenceRunner if given.command == "sequence" else TaskRunner
        print(kind(SparkSession.builder.getOrCreate(), config).run())
    except Exception as error:  # a command line ends with a message and a code
        print(f"tidemark: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
