"""Conversation logs: tails, exchanges, search, statistics and sequence links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import time as T


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def search_turns(turns: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The newest turns whose text or role contains the query, whatever its case."""
    q = query.lower()
    hit = F.contains(F.lower("text"), F.lit(q)) | F.contains(F.lower("role"), F.lit(q))
    return turns.where(hit).orderBy(F.desc("ts_ms"), "conv_id", "turn").limit(limit)


def statistics(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"),
    )


def exchanges(turns: DataFrame) -> DataFrame:
    """Trusted assistant turns with the user turn right before them."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumns({"before_role": F.lag("role").over(before), "question": F.lag("text").over(before)})
    good = (F.col("role") == "assistant") & (F.col("traffic") == "green") & (F.col("before_role") == "user")
    return paired.where(good).select("conv_id", "turn", "question", F.col("text").alias("answer"))


def last_exchanges(turns: DataFrame, n: int = 5) -> DataFrame:
    return last_turns(exchanges(turns), n)


def sequence_links(turns: DataFrame) -> DataFrame:
    """A link from each turn to the one before, with class and weight of the gap."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    gaps = turns.withColumns({"before": F.lag("turn").over(before), "gap_ms": F.col("ts_ms") - F.lag("ts_ms").over(before)}).where("before IS NOT NULL")
    return gaps.select("conv_id", "before", "turn", "gap_ms", T.gap_class(F.col("gap_ms")).alias("gap_class"), T.gap_weight(F.col("gap_ms")).alias("weight"))


def route(rows: DataFrame, rules: list[tuple[str, str, float]], least: float = 0.0) -> DataFrame:
    """``route, score`` by keyword rules (name, needle, weight): sums per name, the best wins, earlier names win ties.

    The rules are literals of the plan, so each text is scored in its row.
    """
    names = list(dict.fromkeys(r for r, _, _ in rules))
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = [sum((F.when(F.contains(low, F.lit(n)), w).otherwise(0.0) for r, n, w in rules if r == name), F.lit(0.0)) for name in names]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    picked = F.lit(None).cast("string")
    for name, score in reversed(list(zip(names, scores, strict=True))):
        picked = F.when(score == best, name).otherwise(picked)
    routed = rows.withColumns({"route_score": best, "route": picked})
    return routed.withColumn("route", F.when(F.col("route_score") > least, F.col("route")).otherwise("general"))


def relabel(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Turns with the traffic of a label table of the same conversation and turn, where there is one."""
    new = labels.select("conv_id", "turn", F.col("traffic").alias("new_traffic"))
    return turns.join(new, ["conv_id", "turn"], "left").withColumn("traffic", F.coalesce("new_traffic", "traffic")).drop("new_traffic")
