"""Plans of named tasks over DataFrames: registry, parser, runner, hooks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

State = dict[str, DataFrame]
Task = Callable[["Run", Mapping], None]


class PlanError(ValueError):
    """A plan that cannot run."""


class Registry:
    """Tasks by name, with aliases; a name is given once."""

    def __init__(self) -> None:
        self._tasks: dict[str, Task] = {}

    def add(self, name: str, *aliases: str) -> Callable[[Task], Task]:
        def keep(task: Task) -> Task:
            for n in (name, *aliases):
                if n in self._tasks:
                    raise PlanError(f"task {n} is registered twice")
                self._tasks[n] = task
            return task

        return keep

    def get(self, name: str) -> Task:
        if name not in self._tasks:
            raise PlanError(f"unknown task {name}; known: {', '.join(self.names())}")
        return self._tasks[name]

    def names(self) -> list[str]:
        return sorted(self._tasks)


@dataclass(frozen=True)
class Step:
    task: str
    params: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    name: str
    steps: tuple[Step, ...]


def parse_plan(settings: Mapping) -> Plan:
    """The plan of ``pipeline: {name, steps: [{task, params}]}``; a step may be just a task's name."""
    body = settings.get("pipeline")
    if not isinstance(body, Mapping) or not body.get("steps"):
        raise PlanError("settings hold no pipeline.steps")
    steps = []
    for raw in body["steps"]:
        step = {"task": raw} if isinstance(raw, str) else dict(raw)
        if not step.get("task"):
            raise PlanError(f"step without a task: {raw}")
        steps.append(Step(step["task"], dict(step.get("params") or {})))
    return Plan(str(body.get("name", "pipeline")), tuple(steps))


@dataclass
class Run:
    """What tasks share: the session, frames by name, and the folder of artifacts."""

    spark: SparkSession
    folder: Path
    state: State = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)

    def need(self, *names: str) -> DataFrame:
        """The first of ``names`` that an earlier step left; none raises."""
        for name in names:
            if name in self.state:
                return self.state[name]
        raise PlanError(f"no earlier step left any of {', '.join(names)}")

    def write_json(self, name: str, value: object) -> None:
        (self.folder / name).write_text(json.dumps(value, indent=2, sort_keys=True, default=str), encoding="utf-8")


def execute(plan: Plan, registry: Registry, spark: SparkSession, folder: str | Path, before: Callable[[Step], None] | None = None) -> Run:
    """Run a plan's steps in order; timings and any error go to run_metadata.json, also when a step fails.

    Every task is resolved before the first one starts.
    """
    tasks = [(step, registry.get(step.task)) for step in plan.steps]
    run = Run(spark, Path(folder))
    run.folder.mkdir(parents=True, exist_ok=True)
    done: list[dict] = []
    try:
        for step, task in tasks:
            if before:
                before(step)
            began = time.time()
            entry = {"task": step.task, "status": "failed"}
            done.append(entry)
            try:
                task(run, step.params)
                entry["status"] = "ok"
            except Exception as error:
                entry["error"] = f"{type(error).__name__}: {error}"[:500]
                raise
            finally:
                entry["seconds"] = round(time.time() - began, 3)
    finally:
        run.write_json("run_metadata.json", {"plan": plan.name, "steps": done, "notes": run.notes})
    return run
