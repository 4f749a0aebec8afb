"""Progress of streams and cancellation of running work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls report({"query", "batch", "rows", "total_rows", "rows_per_second"}) after each micro-batch, and done(error or
    None) when a query ends."""

    def __init__(self, report: Callable[[dict], None], done: Callable[[str | None], None] | None = None):
        super().__init__()
        self.report, self.done, self.totals = report, done, {}

    def onQueryStarted(self, event):
        self.totals[str(event.runId)] = 0

    def onQueryProgress(self, event):
        p = event.progress
        run = str(p.runId)
        self.totals[run] = self.totals.get(run, 0) + p.numInputRows
        self.report({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "total_rows": self.totals[run], "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.totals.pop(str(event.runId), None)
        if self.done is not None:
            self.done(event.exception)


@contextmanager
def watched(spark: SparkSession, report: Callable[[dict], None], done: Callable[[str | None], None] | None = None) -> Iterator[Progress]:
    """Reports the progress of all streams of the session inside the block."""
    listener = Progress(report, done)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[str]:
    """The jobs that this thread starts inside the block can be stopped from another one by cancel(spark, tag)."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs that carry the tag. The thread that waits for them gets an exception."""
    spark.sparkContext.cancelJobsWithTag(tag)
