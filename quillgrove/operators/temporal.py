"""Due dates in text, and world state per place."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def place_states(events: DataFrame, now: Column) -> DataFrame:
    """The last event of each user and place, how many there were, and whether it is stale after a day."""
    last = events.groupBy("user_id", "place").agg(F.max_by("state", F.struct("ts", "id")).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("n"))
    return last.withColumn("stale", F.col("ts") < now - F.expr("INTERVAL 24 HOURS"))


# fixed values: the words for days in the language of the reminders
RELATIVE_DAYS = {"dopodomani": 2, "domani": 1, "oggi": 0}
WEEKDAYS = {"lunedì": 0, "lunedi": 0, "martedì": 1, "martedi": 1, "mercoledì": 2, "mercoledi": 2, "giovedì": 3, "giovedi": 3, "venerdì": 4, "venerdi": 4, "sabato": 5, "domenica": 6}


def due_date(text: str | None, now: datetime) -> tuple[datetime, int | None, str | None] | None:
    """(due, every, unit) of a reminder's text; None if it names neither day nor time."""
    import re

    low = (text or "").lower()
    if m := re.search(r"ogni\s+(\d+)\s+ore", low):
        return now + timedelta(hours=int(m[1])), int(m[1]), "hours"
    daily = "ogni giorno" in low or "quotidianamente" in low
    ahead = next((n for word, n in RELATIVE_DAYS.items() if word in low), None)
    weekday = next((n for word, n in WEEKDAYS.items() if word in low), None)
    day = now + timedelta(days=ahead or 0)
    if weekday is not None:
        day += timedelta(days=(weekday - day.weekday()) % 7 or 7)
    named = ahead is not None or weekday is not None
    clock = re.search(r"(?:alle\s+)?(\d{1,2})(?::(\d{2}))?", low)
    if clock and int(clock[1]) < 24:
        at = day.replace(hour=int(clock[1]), minute=min(59, int(clock[2] or 0)), second=0, microsecond=0)
        if not named and at <= now:
            at += timedelta(days=1)
    elif named:
        at = day.replace(hour=9, minute=0, second=0, microsecond=0) if "oggi" not in low else now.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
    else:
        return None
    return (at, 1, "days") if daily else (at, None, None)


def due_dates(rows: DataFrame, now: datetime) -> DataFrame:
    """``id, due, every, unit`` from texts, a batch of rows at a time; texts without a date are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, *d) for i, t in zip(pdf["id"], pdf["text"], strict=True) if (d := due_date(t, now))]
            yield pd.DataFrame(found, columns=["id", "due", "every", "unit"]).astype({"every": "Int64"})

    return rows.select("id", "text").mapInPandas(run, "id long, due timestamp, every long, unit string")


def linearise(nodes: DataFrame) -> DataFrame:
    """Messages of an exported tree on the path from each conversation's current node to its root, in order.

    ``nodes``: conv_id, node, parent, current (the conversation's current node).  Path
    doubling: each round a node learns the ancestor twice as far, so a path of n
    messages needs log2 n joins instead of one task per conversation.
    """
    from quillgrove.session import materialize

    jump = materialize(nodes.select("conv_id", "node", F.col("parent").alias("far"), F.lit(1).cast("long").alias("hops")), "import-paths")
    on_path = materialize(nodes.where("node = current").select("conv_id", "node", F.lit(0).cast("long").alias("depth")), "import-seen")
    while True:
        step = on_path.join(jump, ["conv_id", "node"]).where("far IS NOT NULL").select("conv_id", F.col("far").alias("node"), (F.col("depth") + F.col("hops")).alias("depth"))
        grown = materialize(on_path.union(step).distinct(), "import-seen")
        if grown.count() == on_path.count():
            break
        on_path = grown
        ahead = jump.select("conv_id", F.col("node").alias("far"), F.col("far").alias("far2"), F.col("hops").alias("hops2"))
        jump = materialize(jump.join(ahead, ["conv_id", "far"], "left").select("conv_id", "node", F.col("far2").alias("far"), (F.col("hops") + F.col("hops2")).alias("hops")), "import-paths")
    order = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    return on_path.withColumn("position", F.row_number().over(order)).select("conv_id", "node", "position")


def classify_message(role: Column, kind: Column, text: Column, least: int = 8) -> Column:
    """Why a message isn't imported; null if it is."""
    return (
        F.when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), "internal").when(~F.coalesce(kind.isin("text", "multimodal_text"), F.lit(False)), "filtered")
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.length(F.trim(text)) < least, "too_short")
    )


MESSAGE_TEXT = T.ArrayType(T.StringType())


def message_text(content: str) -> Column:
    """The text of a message's JSON content: its parts that are strings or have a text, line by line."""
    parts = F.from_json(F.get_json_object(content, "$.parts"), MESSAGE_TEXT)
    readable = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("{")), F.coalesce(F.get_json_object(p, "$.text"), F.get_json_object(p, "$.transcript"))).otherwise(p))
    joined = F.array_join(F.filter(readable, lambda x: x.isNotNull() & (x != "")), "\n")
    return F.trim(F.concat_ws("\n", F.get_json_object(content, "$.text"), F.when(joined != "", joined)))
