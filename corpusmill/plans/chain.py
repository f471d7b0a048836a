"""Named operators with tags, chosen by tag and run one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from time import perf_counter
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.plans.runtime import checkpoint

Step = Callable[[DataFrame], DataFrame]


class Told(NamedTuple):
    """How a step of a run ended: rows that left it, or the error for which it was passed over, and seconds of planning."""

    name: str
    ok: bool
    rows: int | None
    error: str
    seconds: float


@dataclass
class Registry:
    """Steps from a DataFrame to a DataFrame by name; a name is given once."""

    steps: dict[str, Step] = field(default_factory=dict)
    tags: dict[str, frozenset[str]] = field(default_factory=dict)

    def add(self, name: str, step: Step, *tags: str) -> None:
        if name in self.steps:
            raise ValueError(f"{name} is already registered")
        self.steps[name], self.tags[name] = step, frozenset(tags)

    def select(self, *tags: str) -> list[str]:
        """Names, in order of registration, of the steps that have all the tags."""
        return [name for name, own in self.tags.items() if own.issuperset(tags)]

    def chain(self, rows: DataFrame, names: Iterable[str]) -> DataFrame:
        """One lazy plan of the steps in order, so that filters and columns are pushed through all of them."""
        for name in names:
            rows = rows.transform(self.steps[name])
        return rows

    def run(self, rows: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Told]]:
        """The rows after all steps, in a checkpoint, and how each step ended.

        Still one plan: each step's rows are counted by an observation while they pass. A step that cannot be planned on what it is
        given (an unknown name, a missing column) is passed over; a failure of the job itself is raised.
        """
        told: list[tuple[str, Observation | None, str, float]] = []
        for name in names:
            began = perf_counter()
            try:
                after = rows.transform(self.steps[name])
                after.schema  # noqa: B018  (analyses the plan)
                seen = Observation(f"{name}-{len(told)}")
                rows = after.observe(seen, F.count(F.lit(1)).alias("rows"))
                told.append((name, seen, "", perf_counter() - began))
            except (PySparkException, KeyError) as e:
                told.append((name, None, str(e).split("\n")[0], perf_counter() - began))
        done = checkpoint(rows)
        return done, [Told(name, seen is not None, seen.get["rows"] if seen else None, error, seconds) for name, seen, error, seconds in told]
