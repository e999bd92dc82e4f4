"""Streams that stop when there is nothing to do, and start again when there is."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class IdleStop(StreamingQueryListener):
    """Stops a query after so many triggers in a row that found nothing new.

    A trigger without input reports only from time to time that it is idle, so such
    triggers are counted by the time they take: `idle` of them are as many intervals
    since the query last found something or was still at work on it.
    """

    def __init__(self, spark: SparkSession, idle: int, interval_seconds: float) -> None:
        self.spark, self.limit = spark, idle * interval_seconds
        self.watched: dict[str, float] = {}
        self.stopped: set[str] = set()
        self.batches: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}
        self._done = threading.Event()
        self._timer = threading.Thread(target=self._look, args=(min(interval_seconds, 1.0),), daemon=True)
        self._timer.start()

    def watch(self, query: StreamingQuery) -> None:
        self.ended.setdefault(str(query.runId), threading.Event())
        self.watched.setdefault(str(query.runId), time.monotonic())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        # By offsets, as a batch need not read the rows that called for it.
        if any(s.startOffset != s.endOffset for s in event.progress.sources):
            self.batches[run] = self.batches.get(run, 0) + 1
            if run in self.watched:
                self.watched[run] = time.monotonic()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.watched.pop(str(event.runId), None)
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def _look(self, seconds: float) -> None:
        # Not inside a callback: a query cannot end while its listener is being called.
        while not self._done.wait(seconds):
            for query in self.spark.streams.active:
                run = str(query.runId)
                since = self.watched.get(run)
                if since is None:
                    continue
                status = query.status
                at_work = status["isTriggerActive"] and status["isDataAvailable"]
                if at_work or status["message"].startswith("Initializing"):
                    # However long it takes.
                    self.watched[run] = time.monotonic()
                elif time.monotonic() - since >= self.limit:
                    self.stopped.add(run)
                    self.watched.pop(run, None)
                    query.stop()

    def close(self) -> None:
        self._done.set()


def run_until_idle(
    spark: SparkSession, start: Callable[[dict[str, str]], StreamingQuery], interval_seconds: float, idle: int
) -> int:
    """Run a query at an interval until `idle` triggers found nothing. Gives the batches that found something.

    `start` starts the query with the trigger it is given. An error of the query is raised.
    """
    watcher = IdleStop(spark, idle, interval_seconds)
    spark.streams.addListener(watcher)
    try:
        query = start({"processingTime": f"{interval_seconds} seconds"})
        watcher.watch(query)
        query.awaitTermination()
        # What the query reported comes in order; its end is the last of it.
        watcher.ended[str(query.runId)].wait(60)
        return watcher.batches.get(str(query.runId), 0)
    finally:
        watcher.close()
        spark.streams.removeListener(watcher)


def run_while_work_comes(
    spark: SparkSession,
    start: Callable[[dict[str, str]], StreamingQuery],
    has_work: Callable[[], bool],
    interval_seconds: float,
    idle: int,
    rounds: int | None = None,
    wait: Callable[[float], None] = time.sleep,
) -> int:
    """Start the query anew whenever `has_work` says so, `rounds` times or without end.

    In between nothing runs but the question. Gives how often the query was started.
    """
    started = 0
    while rounds is None or started < rounds:
        if has_work():
            run_until_idle(spark, start, interval_seconds, idle)
            started += 1
        else:
            wait(interval_seconds)
    return started
