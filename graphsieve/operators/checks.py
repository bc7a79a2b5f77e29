"""Declarative integrity checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """actual: a one-row, one-column frame, compared with expected as text."""

    name: str
    actual: DataFrame
    expected: object
    severity: str = "error"


def run(checks: list[Check]) -> DataFrame:
    """(check, severity, expected, actual, ok)."""
    rows = []
    for c in checks:
        actual = F.col(c.actual.columns[0]).cast("string")
        rows.append(c.actual.select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.lit(str(c.expected).lower() if isinstance(c.expected, bool) else str(c.expected)).alias("expected"), actual.alias("actual")))
    return reduce(DataFrame.unionAll, rows).withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


@dataclass(frozen=True)
class Measure:
    """actual: an aggregate of a frame, compared as text with expected, a value or another aggregate of that frame."""

    name: str
    actual: Column
    expected: object
    severity: str = "error"


def measured(frame: DataFrame, measures: list[Measure]) -> DataFrame:
    """(check, severity, expected, actual, ok): all measures by one aggregate, so that the frame is read once.

    Plain aggregates, not observed metrics: those of a stage that runs again after an executor is lost count twice.
    An empty frame gives its aggregates' values of no rows.
    """
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    one = lambda m: F.struct(F.lit(m.name).alias("check"), F.lit(m.severity).alias("severity"), text(m.expected).alias("expected"), text(m.actual).alias("actual"))
    rows = frame.agg(F.array(*[one(m) for m in measures]).alias("rows")).select(F.inline("rows"))
    return rows.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def failed(report: DataFrame) -> bool:
    """Whether an error, not a warning, was found."""
    return bool(report.filter("not ok and severity = 'error'").limit(1).count())
