"""A stream of ids to fetch, with attempts and retries kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of a key is kept by RocksDB, which timers need.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "id string, attempt int, status string, content string"
SUCCESS, FAILED, GIVEN_UP = "success", "failed", "given up"


class Attempts(StatefulProcessor):
    """Fetches each id until it succeeds or ``most`` attempts have failed.

    The state of an id is its attempts and whether it has succeeded.  A failed
    id comes again by a timer, after ``wait`` seconds, twice as long each time.
    An id that has succeeded or waits for its timer is not fetched when it is
    listed again; one that was given up gets one more attempt.
    """

    def __init__(self, fetch: Callable[[str], str], wait: float, most: int) -> None:
        self.fetch, self.wait, self.most = fetch, wait, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "attempts int, status string")

    def _try(self, key: str, now: int) -> pd.DataFrame:
        attempt = (self.state.get()[0] if self.state.exists() else 0) + 1
        try:
            content, status = self.fetch(key), SUCCESS
        except Exception:  # whatever goes wrong with one id is an attempt that failed
            content, status = None, FAILED if attempt < self.most else GIVEN_UP
        if status == FAILED:
            self.handle.registerTimer(now + int(1000 * self.wait * 2 ** (attempt - 1)))
        self.state.update((attempt, status))
        return pd.DataFrame({"id": [key], "attempt": [attempt], "status": [status], "content": [content]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.state.exists() or self.state.get()[1] == GIVEN_UP:
            yield self._try(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] == FAILED:
            yield self._try(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def fetched(ids: DataFrame, fetch: Callable[[str], str], *, wait: float = 60.0, most: int = 5, key: str = "rcept_no") -> DataFrame:
    """(id, attempt, status, content) of every attempt at the ids of a stream; the session needs ``SETTINGS``.

    Null ids are left out.  ``status`` is success, failed (comes again) or given up.
    """
    rows = ids.where(ids[key].isNotNull()).select(ids[key].cast("string").alias("id"))
    return rows.groupBy("id").transformWithStateInPandas(Attempts(fetch, wait, most), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
