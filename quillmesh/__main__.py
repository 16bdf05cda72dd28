"""Command line: ``python -m quillmesh run SETTINGS --out FOLDER | tasks | check SETTINGS``."""

from __future__ import annotations

import argparse

from quillmesh.plans.pipeline import execute, parse_plan
from quillmesh.plans.tasks import TASKS
from quillmesh.session import build_session
from quillmesh.sources.settings import load


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmesh")
    actions = parser.add_subparsers(dest="action", required=True)
    run = actions.add_parser("run", help="run the pipeline of a settings file")
    run.add_argument("settings")
    run.add_argument("--out", required=True)
    actions.add_parser("tasks", help="list the tasks")
    check = actions.add_parser("check", help="parse a settings file and resolve its tasks")
    check.add_argument("settings")
    chosen = parser.parse_args(args)
    if chosen.action == "tasks":
        print("\n".join(TASKS.names()))
        return 0
    plan = parse_plan(load(chosen.settings))
    for step in plan.steps:
        TASKS.get(step.task)
    if chosen.action == "run":
        execute(plan, TASKS, build_session(plan.name), chosen.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
