"""Keyed state over streams whose rows come in any order, by event time.

A row waits in the key's list until the watermark has passed it; then the walker takes the
waiting rows by time and place in sequence. So neither the cut into triggers nor the order
of files changes an answer, and the list holds no more than the watermark's delay. Waiting rows are
kept CHUNK at a time in one entry, because an entry costs much more than a row. A timer
fires for the first waiting row. With an idle time, another clears a key that nothing met
for so long, unless its state has no end.
"""

from __future__ import annotations

import math
import pickle
from collections import namedtuple
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of one entry of the list of those that wait.
CHUNK = 1024
CHUNK_ROW = "rows binary"


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


class OrderedWalk(StatefulProcessor):
    """Walks the rows of a key in order; ``walker`` has ``start``, ``step`` and ``forever``."""

    def __init__(self, walker, fields: list[str], state_schema: str,
                 columns: list[str], idle_seconds: float | None) -> None:
        self.walker, self.fields, self.columns = walker, fields, columns
        self.state_schema, self.idle = state_schema, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", CHUNK_ROW)
        self.state = handle.getValueState("walk", self.state_schema)

    def close(self) -> None:
        pass

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def _chunks(self, rows: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(rows[i : i + CHUNK]),) for i in range(0, len(rows), CHUNK)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None:  # a row without a key only tells that time has passed
            for batch in rows:
                columns = [batch[c].tolist() for c in self.fields]
                if any(batch[c].dtype == object for c in self.fields):
                    columns = [list(map(_plain, c)) for c in columns]
                self.waiting.appendList(self._chunks(list(zip(*columns, strict=True))))
                self.handle.registerTimer(math.floor(batch["at"].min() * 1000) + 1)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, at, seq = timerValues.getCurrentWatermarkInMs() / 1000, self.fields.index("at"), self.fields.index("seq")
        rows = sorted(
            (r for chunk in self.waiting.get() for r in pickle.loads(chunk[0])), key=itemgetter(at, seq))
        ready = [r for r in rows if r[at] < passed]
        if len(ready) < len(rows):
            self.waiting.put(self._chunks(rows[len(ready):]))
            self.handle.registerTimer(math.floor(rows[len(ready)][at] * 1000) + 1)
        elif rows:
            self.waiting.clear()
        now = self.state.get() if self.state.exists() else None
        now = self.walker.start if now is None else tuple(map(_plain, now))
        out = []
        call = namedtuple("Call", self.fields)
        for row in map(call._make, ready):
            made, now = self.walker.step(key[0], now, row)
            out.append(made)
        ends = self.idle is not None and not self.walker.forever(now)
        if ends and len(ready) == len(rows) and self.walker.last(now) + self.idle < passed:
            self.state.clear()
        elif ready:
            self.state.update(now)
            if ends:
                self.handle.registerTimer(math.floor((ready[-1][at] + self.idle) * 1000) + 1)
        yield self._rows(out)


def ordered_walk(
    rows: DataFrame, key: str, walker, row_schema: str, state_schema: str, out_schema: str,
    late: str, idle_seconds: float | None,
) -> DataFrame:
    """``rows(key, seq, at, ...)`` of a stream, walked by (at, seq) per key.

    ``at`` is in seconds after 1970. Rows more than ``late`` behind the newest one are dropped by the
    watermark; ``late`` also is how long an answer waits.
    """
    rows.sparkSession.conf.set(STORE, ROCKSDB)  # lists, timers and clearing need this store
    names = [part.split()[0] for part in row_schema.split(", ")]
    timed = rows.select(key, *names, F.timestamp_micros(
        (F.col("at") * 1_000_000).cast("long")).alias("at_time")).withWatermark("at_time", late)
    columns = [part.split()[0] for part in out_schema.split(", ")]
    return timed.groupBy(key).transformWithStateInPandas(
        OrderedWalk(walker, names, state_schema, columns, idle_seconds), out_schema, "append",
        "EventTime")
