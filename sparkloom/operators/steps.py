"""What each super-step did: jobs, tasks and seconds, by job tags and Spark's status tracker."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "step int, active long, active_edges long, mode string, edges_read long, jobs int, tasks int, seconds double"


@dataclass
class StepLog:
    """A row for each super-step; a step's jobs carry a tag, also those of its subqueries and broadcasts."""

    spark: SparkSession
    rows: list[dict[str, Any]] = field(default_factory=list)

    @contextmanager
    def step(self, step: int, active: int, active_edges: int, mode: str) -> Iterator[dict[str, Any]]:
        """The step's row; its body may add ``edges_read``."""
        context, tag, began = self.spark.sparkContext, f"step-{uuid.uuid4().hex}", time.perf_counter()
        row = {"step": step, "active": active, "active_edges": active_edges, "mode": mode, "edges_read": None}
        context.addJobTag(tag)
        try:
            yield row
        finally:
            context.removeJobTag(tag)
        jobs, tasks = figures(self.spark, tag)
        self.rows.append(row | {"jobs": jobs, "tasks": tasks, "seconds": time.perf_counter() - began})

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([[r[c.split()[0]] for c in SCHEMA.split(", ")] for r in self.rows], SCHEMA)


def figures(spark: SparkSession, tag: str) -> tuple[int, int]:
    """Jobs with a tag, and the tasks of their stages (those that Spark still remembers)."""
    context = spark.sparkContext
    tracker, jobs = context.statusTracker(), list(context._jsc.sc().statusTracker().getJobIdsForTag(tag))
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    return len(jobs), sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
