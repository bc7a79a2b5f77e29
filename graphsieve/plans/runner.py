"""Step runner: a registry of steps with outputs, run in order, one alone or from one on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources.readers import exists


@dataclass(frozen=True)
class Step:
    number: int
    name: str
    run: Callable[[SparkSession], object]
    outputs: list[str] = field(default_factory=list)
    skip_if_exists: bool = False
    required: bool = False


@dataclass(frozen=True)
class Outcome:
    number: int
    name: str
    status: str  # done, skipped or failed
    seconds: float
    error: str = ""


def select(steps: list[Step], start: int | None = None, only: int | None = None) -> list[Step]:
    """The steps to run; a number that isn't there raises ValueError."""
    numbers = {s.number for s in steps}
    for n in (start, only):
        if n is not None and n not in numbers:
            raise ValueError(f"no step {n}")
    return [s for s in sorted(steps, key=lambda s: s.number) if (only is None or s.number == only) and (start is None or s.number >= start)]


def run(spark: SparkSession, steps: list[Step], start: int | None = None, only: int | None = None) -> list[Outcome]:
    """Runs steps in order.  Existing outputs may skip a step; a failure is reported, and ends the run where the step is required."""
    out: list[Outcome] = []
    for step in select(steps, start, only):
        began = time.monotonic()
        if step.skip_if_exists and step.outputs and all(exists(spark, p) for p in step.outputs):
            out.append(Outcome(step.number, step.name, "skipped", 0.0))
            continue
        try:
            step.run(spark)
            missing = [p for p in step.outputs if not exists(spark, p)]
            error = f"no output {', '.join(missing)}" if missing else ""
        except Exception as e:
            error = str(e) or type(e).__name__
        out.append(Outcome(step.number, step.name, "failed" if error else "done", time.monotonic() - began, error))
        if error and step.required:
            break
    return out


def succeeded(outcomes: list[Outcome]) -> bool:
    return all(o.status != "failed" for o in outcomes)
