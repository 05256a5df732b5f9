"""What a conversation carries from turn to turn, as of its last turn.

The fold is sequential, but nothing here needs its rows in one task, save the two short lists:

* what a turn sets or clears (topic, need, goal, ...) is the last write: a maximum by turn;
* smoothed values are affine in the value before, and the pressure, which rises faster than
  it falls, is a rising piecewise linear function of it.  Such functions compose, so a range sort cuts
  conversations wherever it likes, each part becomes one function, and a
  conversation's parts, at most one a task, are applied in order;
* the lists keep the last distinct names, and which those are hangs on every mention before: their
  names pass through one task a conversation, in order, and only the lists are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: shares that the value before keeps, lengths of the lists, the least confidence of a need, domains that clear the topic
RISING, FALLING = 0.35, 0.75
TECHNICAL, BREVITY = 0.55, 0.5
ENTITIES, ANCHORS = 12, 8
NEED = 0.58
CLEARING = ["health", "family"]
#: A function whose values differ by less than this is a constant.
FLAT = 1e-15


def _given(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def last_writes(rows: DataFrame) -> DataFrame:
    """``conv_id`` and the fields that a turn sets, clears or leaves alone."""
    soft = F.coalesce("soft", F.lit(False))
    clears = soft | F.coalesce(F.col("domain").isin(CLEARING), F.lit(False))
    topic, frame = (F.when(F.col(x) != "generic", _given(x)) for x in ("topic", "frame"))
    need = F.when(F.col("need_confidence") >= NEED, _given("need"))
    nothing = F.lit(None).cast("string")
    # (value written, whether anything is written)
    writes = {
        "topic": (topic, topic.isNotNull() | clears), "sub_topic": (_given("sub_topic"), _given("sub_topic").isNotNull() | clears),
        "frame": (F.coalesce(frame, F.lit("generic")), frame.isNotNull() | soft), "need": (need, need.isNotNull() | soft),
        **{x: (_given(x), _given(x).isNotNull()) for x in ("goal", "mode", "summary")},
    }
    last = {x: F.max_by(F.struct(F.coalesce(value, nothing).alias("v")), F.when(written, F.col("turn")))["v"] for x, (value, written) in writes.items()}
    default = {"frame": "generic", "mode": "dialogue", "summary": ""}
    return rows.groupBy("conv_id").agg(*(F.coalesce(v, F.lit(default.get(x)).cast("string")).alias(x) for x, v in last.items()))


class Pressure:
    """A rising piecewise linear function of the value before, on [0, 1], by its corners."""

    def __init__(self, x: np.ndarray | None = None, y: np.ndarray | None = None) -> None:
        self.x = np.array([0.0, 1.0]) if x is None else x
        self.y = np.array([0.0, 1.0]) if y is None else y

    def then(self, value: float, reset: bool) -> None:
        """Follow the function with one turn: towards ``value``, from zero if the turn resets."""
        if reset:
            self.x, self.y = np.array([0.0, 1.0]), np.zeros(2)
        if self.y[0] < value < self.y[-1] and self.y[-1] - self.y[0] >= FLAT:
            # the step bends where its input is the value
            at = int(np.searchsorted(self.y, value))
            if self.y[at] != value:
                self.x = np.insert(self.x, at, np.interp(value, self.y[at - 1 : at + 1], self.x[at - 1 : at + 1]))
                self.y = np.insert(self.y, at, value)
        keep = np.where(self.y < value, RISING, FALLING)
        self.y = np.clip(keep * self.y + (1 - keep) * value, 0.0, 1.0)
        if len(self.x) > 2 and self.y[-1] - self.y[0] < FLAT:
            self.x, self.y = self.x[[0, -1]], self.y[[0, -1]]

    def __call__(self, before: float) -> float:
        return float(np.interp(before, self.x, self.y))


NAMES = ["conv_id", "first", "x", "y", "technical_a", "technical_b", "brevity_a", "brevity_b"]
PART = "conv_id long, first long, x array<double>, y array<double>, technical_a double, technical_b double, brevity_a double, brevity_b double"


def smoothed(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``conv_id, pressure, technical, brevity`` after the last turn; ``parts`` of the range sort, else as many as shuffle partitions."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, f, a, b = None, None, None, None, None
        for batch in batches:
            done = []
            for c, turn, pressure, reset, technical, brevity in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if f is None or c != conv:
                    if f is not None:
                        done.append([conv, first, f.x, f.y, a[0], b[0], a[1], b[1]])
                    conv, first, f, a, b = c, turn, Pressure(), [1.0, 1.0], [0.0, 0.0]
                f.then(pressure, reset)
                for i, (keep, value) in enumerate(((TECHNICAL, technical), (BREVITY, brevity))):
                    a[i], b[i] = keep * a[i], keep * b[i] + (1 - keep) * value
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], NAMES)
        if f is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (conv, first, f.x, f.y, a[0], b[0], a[1], b[1])], NAMES)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, _, x, y, *affine in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append([conv, *state])
                    conv, state = c, [0.0, 0.0, 0.0]
                state = [Pressure(np.array(x), np.array(y))(state[0]), affine[0] * state[1] + affine[1], affine[2] * state[2] + affine[3]]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], ["conv_id", "pressure", "technical", "brevity"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (conv, *state)], ["conv_id", "pressure", "technical", "brevity"])

    share = lambda x: F.least(F.greatest(F.coalesce(F.col(x), F.lit(0.0)).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(x)
    turns = rows.select("conv_id", "turn", share("pressure"), F.coalesce("soft", F.lit(False)).alias("soft"), share("technical"), share("brevity"))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    functions = turns.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").mapInArrow(compose, PART)
    ordered = functions.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return ordered.mapInArrow(apply, "conv_id long, pressure double, technical double, brevity double")


def _kept(held: list[str], said: list[str] | None, most: int) -> list[str]:
    named = dict.fromkeys(held)
    named.update(dict.fromkeys(x for raw in said or [] if (x := (raw or "").strip().lower())))
    return list(named)[-most:]


def last_names(rows: DataFrame) -> DataFrame:
    """``conv_id, entities, anchors``: the last distinct names; a hard reset forgets those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, entities, anchors = None, False, [], []
        types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]

        def out(done: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), types, strict=True)], ["conv_id", "entities", "anchors"])

        for batch in batches:
            done = []
            for c, _, hard, named, anchored in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not started or c != conv:
                    if started:
                        done.append([conv, entities, anchors])
                    conv, started, entities, anchors = c, True, [], []
                if hard:
                    entities, anchors = [], []
                entities, anchors = _kept(entities, named, ENTITIES), _kept(anchors, anchored, ANCHORS)
            if done:
                yield out(done)
        if started:
            yield out([[conv, entities, anchors]])

    said = rows.select("conv_id", "turn", F.coalesce("hard", F.lit(False)).alias("hard"), "entities", "anchors")
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, "conv_id long, entities array<string>, anchors array<string>")


def short_memory(rows: DataFrame) -> DataFrame:
    """The memory of each conversation after its last turn.

    ``rows``: conv_id, turn (its rows' order, no two alike), topic, sub_topic, frame, need, need_confidence, goal, mode, summary,
    domain, pressure, technical, brevity (0 to 1; beyond are cut, null is 0), entities, anchors, soft and hard (whether the context shifted).
    Null conversations or turns are left out; null and empty fields say nothing.
    """
    rows = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return last_writes(rows).join(smoothed(rows), "conv_id").join(last_names(rows), "conv_id")
