"""What happens with streams and jobs: events to subscribers, debounced updates, retries and single flights."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Base and longest wait of a retry, in milliseconds.
BASE_MS, LONGEST_MS = 100, 5000


class EventPublisher(StreamingQueryListener):
    """Tells subscribers ``(kind, query id, rows)`` of what the session's streams do: started, updated, ended.

    A subscriber that fails is left out of that event only; ``publish`` gives them events of other kinds.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.subscribers = spark, []
        spark.streams.addListener(self)

    def subscribe(self, f: Callable[[str, str, int], None]) -> None:
        self.subscribers.append(f)

    def publish(self, kind: str, about: str, rows: int = 0) -> None:
        for f in list(self.subscribers):
            try:
                f(kind, about, rows)
            except Exception:  # noqa: BLE001, S112
                continue

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.publish("started", str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self.publish("updated", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.publish("ended", str(event.id))

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def debounced(events: DataFrame, ts: str = "ts", every: str = "5 seconds", *keys: str) -> DataFrame:
    """One update for each stretch of time and key that has events, with their number: ``start, [keys,] n``."""
    return events.groupBy(F.window(F.col(ts), every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def delays_ms(retries: int, base: int = BASE_MS, longest: int = LONGEST_MS) -> list[int]:
    """The wait ahead of each retry: doubled each time, up to the longest."""
    return [min(base << i, longest) for i in range(retries)]


def retry(f: Callable[[], object], retries: int = 3, base: int = BASE_MS, longest: int = LONGEST_MS, retryable: Callable[[Exception], bool] = lambda e: isinstance(e, OSError), sleep: Callable[[float], None] = time.sleep):
    """What ``f`` returns, tried again after each failure that may pass; the last failure is raised."""
    for wait in delays_ms(retries, base, longest):
        try:
            return f()
        except Exception as e:
            if not retryable(e):
                raise
            sleep(wait / 1000)
    return f()


class SingleFlight:
    """Calls of one key at the same time are one run, whose result or failure all of them get."""

    def __init__(self) -> None:
        self._lock, self._open = threading.Lock(), {}

    def run(self, key: str, f: Callable[[], object]):
        with self._lock:
            mine = key not in self._open
            if mine:
                self._open[key] = Future()
            done = self._open[key]
        if mine:
            try:
                done.set_result(f())
            except BaseException as e:  # noqa: BLE001
                done.set_exception(e)
            finally:
                with self._lock:
                    del self._open[key]
        return done.result()
