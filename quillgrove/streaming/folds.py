"""Event streams folded into per-key state.

``echo_state_stream``  commutative counts, as a streaming aggregation.
``fold_moods`` / ``mood_stream``  moving averages that depend on order: the batch
form sorts within each key's partition, the stream keeps the state per key.
``cooled_down`` / ``cooldown_stream``  a minimum distance between accepted events and
a most number in a window that opens with the first event after the last one closed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes after which a bucket has moved most of the way.
TAUS = {"short": 15.0, "medium": 240.0, "long": 2880.0}
ALPHA = 0.35


def echo_state_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Update-mode counts per record; the watermark bounds how late an event may come."""
    seen = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return seen.groupBy("memory_id").agg(
        F.count_if(F.col("kind").isin("echoed", "promoted")).alias("echoes"), F.count_if(F.col("kind") == "promoted").alias("promoted"),
        F.count_if(F.col("kind") == "suppressed").alias("suppressed"), F.max("ts").alias("last_ts"),
    )


def mood_step(state: dict[str, float] | None, minute: float, value: float) -> dict[str, float]:
    """Every bucket decays towards the new value by its own time constant, then takes a share of it."""
    if state is None:
        return {"minute": minute, **{k: value for k in TAUS}}
    gap = max(0.1, minute - state["minute"])
    out = {"minute": minute}
    for k, tau in TAUS.items():
        keep = math.exp(-gap / tau)
        drifted = keep * state[k] + (1 - keep) * value
        out[k] = (1 - ALPHA) * drifted + ALPHA * value if k == "short" else drifted
    return out


def fold_moods(rows: DataFrame) -> DataFrame:
    """``key, short, medium, long`` after all of each key's rows (``key, ts, seq, value``), in order."""
    names = ["key", *TAUS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, minute, value in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if state is not None and k != key:
                    done.append([key, *(state[t] for t in TAUS)])
                    state = None
                key, state = k, mood_step(state, minute, value)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, *(state[t] for t in TAUS))], names)

    ordered = rows.select("key", (F.col("ts").cast("double") / 60).alias("minute"), "seq", "value").where("key IS NOT NULL AND value IS NOT NULL")
    ordered = ordered.repartition("key").sortWithinPartitions("key", "minute", "seq")
    return ordered.mapInArrow(run, "key long, short double, medium double, long double")


def mood_stream(rows: DataFrame) -> DataFrame:
    """The same as a stream: one row per key and batch, with the state after it."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(("minute", *TAUS), held.get, strict=True)) if held.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            state = mood_step(state, ts.timestamp() / 60, value)
        held.update((state["minute"], *(state[t] for t in TAUS)))
        yield pd.DataFrame([{"key": key[0], **{t: state[t] for t in TAUS}}])

    return rows.groupBy("key").applyInPandasWithState(
        step, "key long, short double, medium double, long double", "minute double, short double, medium double, long double", "update", GroupStateTimeout.NoTimeout
    )


def cooldown_step(state: tuple[float, float, int] | None, at: float, apart: float, window: float, most: int) -> tuple[tuple[float, float, int], bool]:
    """State: last accepted, window's start, accepted in it."""
    last, start, n = state or (-math.inf, -math.inf, 0)
    if at - start >= window:
        start, n = at, 0
    if at - last < apart or n >= most:
        return (last, start, n), False
    return (at, start, n + 1), True


def cooled_down(rows: DataFrame, apart: float = 12.0, window: float = 60.0, most: int = 6) -> DataFrame:
    """``key, seq, accepted`` for each row (``key, ts, seq``), in order within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            accepted = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    key, state = k, None
                state, ok = cooldown_step(state, at, apart, window, most)
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(accepted, pa.bool_())], ["key", "seq", "accepted"])

    ordered = rows.select("key", F.col("ts").cast("double").alias("at"), "seq").where("key IS NOT NULL AND ts IS NOT NULL")
    return ordered.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, "key long, seq long, accepted boolean")
