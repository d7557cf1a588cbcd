"""Stages of a search under deadlines: a stage that takes too long has its Spark jobs cancelled and ends with a status."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

#: Seconds that each stage has.
DEADLINE = 180.0


class DeadlineExceeded(TimeoutError):
    def __init__(self, stage: str, seconds: float):
        super().__init__(f"{stage} took more than {seconds:g} s")
        self.stage = stage


def within(spark: SparkSession, seconds: float, stage: str, action: Callable):
    """The result of ``action`` if it ends in time. Its jobs carry a tag of their own; past the deadline they are cancelled, and
    so are jobs that it starts afterwards, until it gives up. Its own errors are raised as they are."""
    context, tag, got = spark.sparkContext, f"{stage}-{uuid.uuid4().hex}", {}

    def run() -> None:
        context.addJobTag(tag)
        try:
            got["value"] = action()
        except BaseException as e:  # raised again in the caller's thread
            got["error"] = e
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        while thread.is_alive():
            context.cancelJobsWithTag(tag)
            thread.join(0.2)
        raise DeadlineExceeded(stage, seconds)
    if "error" in got:
        raise got["error"]
    return got["value"]


@dataclass
class Outcome:
    """What a search came to. status: passed, insufficient_support, invalid_query, or deadline_exceeded, with the stage it ended in; rows
    are there where it passed."""

    status: str = "passed"
    stage: str = ""
    rows: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)

    def run(self, spark: SparkSession, seconds: float, stage: str, action: Callable):
        """A stage of the search: None, with the status set, where it ran out of time."""
        self.stage, began = stage, time.monotonic()
        try:
            return within(spark, seconds, stage, action)
        except DeadlineExceeded as e:
            self.status = "deadline_exceeded"
            self.warnings.append(str(e))
            return None
        finally:
            self.seconds[stage] = round(time.monotonic() - began, 3)
