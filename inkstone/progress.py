"""A file that tells how far running work is: one JSON object (see `sinks.progress`), replaced whole each time.

`Watch` follows the jobs that its block starts, by their tasks; `StreamWatch` follows a stream, by its batches. Both only
look: work neither waits for them nor fails with them, and a file that can't be written is tried again the next time."""

from __future__ import annotations

import logging
import threading
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from .files import place
from .sources.sinks import progress

_log = logging.getLogger(__name__)


def replace(uri: str, text: str) -> None:
    """Writes a file beside, then moves it: a reader sees the old text or the new one."""
    system, path = place(uri)
    beside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside, compression=None) as out:
        out.write(text.encode())
    system.move(beside, path)


class Tasks:
    """Completed and known tasks of a job group. What was seen of a stage is kept, since Spark forgets old ones."""

    def __init__(self, tracker, group: str):
        self.tracker, self.group = tracker, group
        self.stages: dict[int, tuple[int, int]] = {}
        self.over: set[int] = set()

    def count(self) -> tuple[int, int]:
        for job in set(self.tracker.getJobIdsForGroup(self.group)) - self.over:
            info = self.tracker.getJobInfo(job)
            if info is None:
                continue
            done = info.status != "RUNNING"
            for stage in info.stageIds:
                seen = self.tracker.getStageInfo(stage)
                if seen is not None:
                    most = max(seen.numCompletedTasks, self.stages.get(stage, (0, 0))[0])
                    # a job that is over runs no more tasks: what is left of its stages was skipped
                    self.stages[stage] = (most, most if done else max(seen.numTasks, most))
                elif done and stage in self.stages:
                    self.stages[stage] = (self.stages[stage][1],) * 2
            if done:
                self.over.add(job)
        return tuple(map(sum, zip(*self.stages.values(), strict=True))) if self.stages else (0, 0)


class Watch:
    """with Watch(spark, path, combo="..."): the jobs that are started inside, by the thread that entered, are counted every
    `seconds`. Jobs of later stages join the total when Spark plans them, so it grows; the last state says "complete", or
    "failed" with an exception, which goes on. The thread's job group is as before afterwards."""

    KEYS = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")

    def __init__(self, spark: SparkSession, path: str, *, combo: str = "", seconds: float = 1.0):
        self.context, self.path, self.combo, self.seconds = spark.sparkContext, path, combo, seconds
        self.group = f"watch-{uuid.uuid4().hex}"
        self.tasks = Tasks(self.context.statusTracker(), self.group)
        self.ended = threading.Event()

    def write(self, status: str) -> None:
        try:
            completed, total = self.tasks.count()
            eta = (time.monotonic() - self.began) / completed * (total - completed) if completed else 0.0
            replace(self.path, progress(completed, total, eta, self.combo, status))
        except Exception:
            _log.warning("progress of %s was not written", self.combo, exc_info=True)

    def _run(self) -> None:
        while not self.ended.wait(self.seconds):
            self.write("running")

    def __enter__(self) -> Watch:
        self.before = {k: self.context.getLocalProperty(k) for k in self.KEYS}
        self.context.setJobGroup(self.group, self.combo)
        self.began = time.monotonic()
        self.write("running")
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.ended.set()
        self.thread.join()
        for key, value in self.before.items():
            self.context.setLocalProperty(key, value)
        self.write("failed" if kind else "complete")


class StreamWatch(StreamingQueryListener):
    """Batches and rows of the streams that start after spark.streams.addListener(StreamWatch(path)). completed and total are
    rows read so far: what will still arrive nobody knows. The combo names the stream and its last batch."""

    def __init__(self, path: str):
        self.path, self.rows, self.batch = path, {}, {}

    def write(self, run: str, status: str) -> None:
        rows = self.rows.get(run, 0)
        try:
            replace(self.path, progress(rows, rows, 0.0, f"batch {self.batch.get(run, -1)}", status))
        except Exception:
            _log.warning("progress of a stream was not written", exc_info=True)

    def onQueryStarted(self, event) -> None:
        self.write(str(event.runId), "running")

    def onQueryProgress(self, event) -> None:
        run, seen = str(event.progress.runId), event.progress
        if seen.batchId != self.batch.get(run) or seen.numInputRows:
            self.rows[run] = self.rows.get(run, 0) + seen.numInputRows
            self.batch[run] = seen.batchId
        self.write(run, "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write(str(event.runId), "failed" if event.exception else "complete")
