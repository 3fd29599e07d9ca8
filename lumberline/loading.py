"""Loading a log in the background, with progress, and cancelling it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from .operators.ingest import PHASES, AnalysedLog
from .sources.spool import undone_if_failed


class Cancelled(Exception):
    """The load was cancelled; nothing that it wrote is left."""


class Load:
    """A log that is being opened by ``work`` (which gets a function to call at the start of each phase).

    Its jobs are a group of their own, so cancelling stops them and nothing else; what the load has written until then, or
    until it fails, is deleted.
    """

    def __init__(self, spark: SparkSession, work: Callable[[Callable[[str], None]], AnalysedLog]):
        self.spark, self.group = spark, f"load-{uuid.uuid4().hex}"
        self._work, self._cancelled, self._phase = work, threading.Event(), ""
        self._log: AnalysedLog | None = None
        self._error: BaseException | None = None
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            self.spark.sparkContext.setJobGroup(self.group, "loading a log", interruptOnCancel=True)
            with undone_if_failed():
                found = self._work(self._enter)
                self._enter("done")
            self._log = found
        except BaseException as e:  # given to whoever asks for the result
            self._error = Cancelled("the load was cancelled") if self._cancelled.is_set() else e

    def _enter(self, phase: str) -> None:
        if self._cancelled.is_set():
            raise Cancelled
        self._phase = phase

    @property
    def running(self) -> bool:
        return self._thread.is_alive()

    def progress(self) -> dict[str, object]:
        """phase; tasks done and known of its running stages; done: the share of the work, by phases and by these tasks."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for stage in tracker.getActiveStageIds():
            info = tracker.getStageInfo(stage)
            if info and any(self._owns(tracker, j, stage) for j in tracker.getJobIdsForGroup(self.group)):
                done, total = done + info.numCompletedTasks, total + info.numTasks
        passed = PHASES.index(self._phase) if self._phase in PHASES else len(PHASES) if self._log else 0
        share = min(1.0, (passed + (done / total if total else 0.0)) / len(PHASES))
        state = "running" if self.running else "cancelled" if isinstance(self._error, Cancelled) else "failed" if self._error else "done"
        return {"state": state, "phase": self._phase, "tasks_done": done, "tasks": total, "done": 1.0 if state == "done" else round(share, 3)}

    @staticmethod
    def _owns(tracker, job: int, stage: int) -> bool:
        info = tracker.getJobInfo(job)
        return info is not None and stage in list(info.stageIds)

    def cancel(self, timeout: float = 60) -> bool:
        """Stop it; whether it has ended without a log. Jobs that start meanwhile are stopped as well."""
        self._cancelled.set()
        for _ in range(max(1, int(timeout * 5))):
            if not self.running:
                break
            self.spark.sparkContext.cancelJobGroup(self.group)
            self._thread.join(0.2)
        return not self.running and self._log is None

    def result(self, timeout: float | None = None) -> AnalysedLog:
        """The log; raises what the load ended with, and ``TimeoutError`` if it hasn't ended."""
        self._thread.join(timeout)
        if self.running:
            raise TimeoutError("the log is still being loaded")
        if self._error is not None:
            raise self._error
        return self._log
