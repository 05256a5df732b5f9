"""World state as a stream: the state of each user and place as of the watermark.

Plans and presence hold for a day, returns for good.  So of the events of a key only two
can ever be the state: the last return, and the last plan or presence as long
as it is no older than a day.  Those two are kept, whatever the number of events (their history
is the table of events), and an event-time timer takes the second away when it is stale.

Late events count as long as Spark lets them past the watermark; repeated events change nothing.
The session needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgrove.functions.time import DAY
from quillgrove.operators.world_state import CONFIDENCE

EVENT = "ts long, seq long, status string, text string"
COLUMNS = "user_id long, place string, version long, status string, confidence double, ts long, text string"


def _order(event: tuple) -> tuple:
    ts, seq, _, text = event
    return ts, seq, text


class Places(StatefulProcessor):
    """The last return and the last plan or presence of a user at a place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", EVENT)
        self.live = handle.getValueState("live", EVENT)
        self.told = handle.getValueState("told", f"version long, {EVENT}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, live = self.done.get(), self.live.get()
        before = live
        for pdf in rows:
            for event in zip(pdf["ts"].tolist(), pdf["seq"].tolist(), pdf["status"].tolist(), pdf["text"].tolist(), strict=True):
                if event[2] == "completed":
                    done = max(done, event, key=_order) if done else event
                else:
                    live = max(live, event, key=_order) if live else event
        if done:
            self.done.update(tuple(done))
        if live and live != before:
            self.live.update(tuple(live))
            if before:
                self.handle.deleteTimer(before[0] + DAY + 1)
            self.handle.registerTimer(live[0] + DAY + 1)
        yield from self._tell(key, done, self._fresh(live, timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live = self._fresh(self.live.get(), timerValues)
        if live is None:
            self.live.clear()
        yield from self._tell(key, self.done.get(), live)

    @staticmethod
    def _fresh(live: tuple | None, timerValues) -> tuple | None:
        return live if live and timerValues.getCurrentWatermarkInMs() - live[0] <= DAY else None

    def _tell(self, key: tuple, done: tuple | None, live: tuple | None) -> Iterator[pd.DataFrame]:
        """The state, if it isn't what was told last."""
        now = max((tuple(x) for x in (done, live) if x), key=_order, default=(None,) * 4)
        told = self.told.get()
        version = told[0] + 1 if told else 0
        if tuple(told[1:]) != now if told else now[0] is not None:
            self.told.update((version, *now))
            ts, _, status, text = now
            row = {"user_id": key[0], "place": key[1], "version": version, "status": status, "confidence": CONFIDENCE.get(status), "ts": ts, "text": text}
            yield pd.DataFrame([row]).astype({"ts": "Int64"})


def world_state_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Changes of state from a stream of travel events (``user_id, place, ts`` in ms``, seq, state, text``).

    Each row is a key's state from then on, the greatest ``version`` the present one; a null status says that nothing
    counts any more.  Events with a null in their key, time or order are left out.
    """
    status = F.when(F.col("state") == "arrived", "current").otherwise(F.col("state"))
    known = events.dropna(subset=["user_id", "place", "ts", "seq", "state"]).withColumn("status", status).withColumn("at", F.timestamp_millis("ts"))
    known = known.withColumn("text", F.coalesce("text", F.lit(""))).withWatermark("at", lateness)
    return known.groupBy("user_id", "place").transformWithStateInPandas(Places(), COLUMNS, "Update", "EventTime")
