"""Counters and progress of a scan while it runs, from the pass that writes its findings."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from veilscan.model import THREAT_RANK
from veilscan.plans.reports import MARK_KIND

COUNTERS = ["files_scanned", "files_with_issues", "total_findings", "threats", "author_marks"]
POLL_SECONDS = 0.2

Progress = Callable[[int, int, dict[str, int]], None]


def counters(findings: str = "findings") -> list[Column]:
    """The corpus counters as aggregates over scanned rows, before findings are exploded."""
    found = F.col(findings)
    threats = F.size(F.filter(found, lambda f: f.severity_rank >= THREAT_RANK))
    marks = F.size(F.filter(found, lambda f: f.kind == MARK_KIND))

    def total(each: Column) -> Column:
        return F.coalesce(F.sum(each), F.lit(0))

    return [
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.size(found) > 0).alias("files_with_issues"),
        total(F.size(found)).alias("total_findings"),
        total(threats).alias("threats"),
        total(marks).alias("author_marks"),
    ]


def observed(scanned: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """Scanned rows, and an observation that holds the counters once an action has read them.

    The counters come from the action itself: its tasks count the rows that pass, and nothing is
    scanned or shuffled a second time. The observation belongs to the first action.
    """
    watch = Observation(name or f"scan-{uuid.uuid4().hex}")
    return scanned.observe(watch, *counters()), watch


def observed_stream(scanned: DataFrame, name: str) -> DataFrame:
    """Scanned rows of a stream whose progress reports carry the counters under `name`."""
    return scanned.observe(name, *counters())


class CounterListener(StreamingQueryListener):
    """Adds up the counters of a stream's batches, and tells them after every batch.

    `progress(batches, rows, counters)` gets the batches so far, the rows read so far, and the
    running sums. Listeners hear of all streams of a session; batches without the observation
    are passed over.
    """

    def __init__(self, name: str, progress: Progress | None = None):
        self.name = name
        self.progress = progress
        self.batches = 0
        self.rows = 0
        self.totals = dict.fromkeys(COUNTERS, 0)
        self._seen: set[tuple[str, int]] = set()
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        batch = (str(event.progress.runId), event.progress.batchId)
        if found is None or batch in self._seen or not found["files_scanned"]:
            return
        self._seen.add(batch)
        self.batches += 1
        self.rows += event.progress.numInputRows
        for counter in COUNTERS:
            self.totals[counter] += found[counter]
        if self.progress:
            self.progress(self.batches, self.rows, dict(self.totals))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def wait(self, seconds: float = 30) -> dict[str, int]:
        """The totals, once a stream has ended and its last events have arrived."""
        self._ended.wait(seconds)
        return dict(self.totals)


def run_with_progress(
    spark: SparkSession, action: Callable[[], None], progress: Callable[[int, int], None]
) -> None:
    """Run an action and tell `progress(tasks done, tasks known)` while its jobs run.

    Tasks are counted over all jobs that the action starts, so the known number grows as Spark
    plans further stages; both numbers are told once more at the end. What the action raises is
    raised here.
    """
    context = spark.sparkContext
    group = f"veilscan-{uuid.uuid4().hex}"
    ended = threading.Event()
    told = (0, 0)

    def tasks() -> tuple[int, int]:
        tracker = context.statusTracker()
        done = known = 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                found = tracker.getStageInfo(stage)
                if found:
                    done, known = done + found.numCompletedTasks, known + found.numTasks
        return done, known

    def watch() -> None:
        nonlocal told
        while not ended.wait(POLL_SECONDS):
            now = tasks()
            if now != told and now >= told:
                told = now
                progress(*now)

    context.setJobGroup(group, "scan with progress")
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        action()
    finally:
        ended.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)
    progress(*max(told, tasks()))
