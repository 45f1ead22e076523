"""Count-or-timeout batches of a stream of events, in state that outlives the driver and its executors.

Events of a type wait in the state store until `size` of them are there, or `seconds` have passed since the first of them came; then they
go out together. A type may be dealt to several lanes, each with batches of its own, so that a type with most of the events is the
work of several tasks. A batch is named by type, lane and number; the same input gives the same names after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: State with lists and timers lives in this store; the session must name it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "data string, timestamp timestamp_ntz, metadata string"
BATCHED_DDL = "event_type string, lane int, batch_no long, data string, timestamp timestamp_ntz, metadata string"


def batcher(size: int, seconds: float) -> StatefulProcessor:
    """The class is made here so that it goes to the workers whole: they need not have this package."""
    millis, rows, counts = int(seconds * 1000), StructType.fromDDL(_WAITING), StructType.fromDDL("held long, batches long, due long")

    class Batcher(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", rows)
            self.counts = handle.getValueState("counts", counts)

        def _seen(self) -> tuple[int, int, int]:
            found = self.counts.get() if self.counts.exists() else None
            return tuple(found) if found else (0, 0, 0)

        def _out(self, key: tuple, number: int, rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["data", "timestamp", "metadata"])
            out.insert(0, "event_type", key[0])
            out.insert(1, "lane", key[1])
            out.insert(2, "batch_no", number)
            return out

        def _timer(self, old: int, due: int) -> None:
            if old and old != due:
                self.handle.deleteTimer(old)
            if due and old != due:
                self.handle.registerTimer(due)

        def handleInputRows(self, key, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held, number, due = self._seen()
            old, fresh = due, []
            for frame in frames:
                fresh += list(frame[["data", "timestamp", "metadata"]].itertuples(index=False, name=None))
                while held + len(fresh) >= size:  # no more than a batch and a block of input is here at once
                    take = size - held
                    yield self._out(key, number, [*(tuple(r) for r in self.waiting.get()), *fresh[:take]] if held else fresh[:take])
                    self.waiting.clear()
                    fresh, held, number, due = fresh[take:], 0, number + 1, 0
            if fresh:
                self.waiting.appendList(fresh)
                held += len(fresh)
                due = due or timerValues.getCurrentProcessingTimeInMs() + millis
            self._timer(old, due)
            self.counts.update((held, number, due))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held, number, due = self._seen()
            if held and due == expiredTimerInfo.getExpiryTimeInMs():
                yield self._out(key, number, [tuple(r) for r in self.waiting.get()])
                self.waiting.clear()
                self.counts.update((0, number + 1, 0))

        def close(self) -> None:
            pass

    return Batcher()


def batched_stream(events: DataFrame, size: int, seconds: float, lanes: int = 1) -> DataFrame:
    """A stream of events (event_type, data, timestamp, metadata) as one of BATCHED_DDL, a batch's events when it goes out."""
    lane = F.pmod(F.xxhash64("data", "timestamp", "metadata"), F.lit(lanes)).cast("int") if lanes > 1 else F.lit(0)
    rows = events.select("event_type", lane.alias("lane"), "data", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "metadata")
    return rows.groupBy("event_type", "lane").transformWithStateInPandas(batcher(size, seconds), BATCHED_DDL, "append", "processingTime")
