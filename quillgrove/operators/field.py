"""The activation field as a whole: energy, spread, drift, trust, and what context does to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions.activation import clamp


def energy_state(rows: DataFrame, target: float) -> DataFrame:
    """Per user: total activation, what is missing to the target, and counts of two types."""
    total = F.sum("activation")
    return rows.groupBy("user_id").agg(
        total.alias("total"), (F.lit(target) - total).alias("deficit"), F.count_if(F.col("type") == "structural").alias("n_structural"), F.count_if(F.col("type") == "episodic").alias("n_episodic")
    )


def temperature(rows: DataFrame, limit: float = 0.3) -> DataFrame:
    """Per user the population deviation of activation, and whether it calls for redistribution."""
    out = rows.groupBy("user_id").agg(F.stddev_pop("activation").alias("temperature"))
    return out.withColumn("action", F.when(F.col("temperature") > limit, "rebalance").otherwise("none"))


def frozen_decay(rows: DataFrame, gamma: float, threshold: float, factor: float) -> DataFrame:
    """Per user the decay: reduced where the mean activation lies below the threshold.

    The sum is taken in decimals, so that a mean at the threshold doesn't hang on the order of the rows (values
    that no decimal of 18 places holds, such as NaN, are averaged as they are).
    """
    exact = F.expr("try_cast(activation AS decimal(28, 18))")
    mean = F.when(F.count(exact) == F.count("activation"), F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))).otherwise(F.avg("activation"))
    out = rows.groupBy("user_id").agg(mean.alias("mean"))
    return out.withColumn("gamma", F.when(F.col("mean") < threshold, gamma * factor).otherwise(gamma))


def reinforcement_multiplier(events: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per record the variance of its scores; a restless one is reinforced by a tenth less."""
    out = events.groupBy("memory_id").agg(F.var_pop("echo_score").alias("variance"))
    return out.withColumn("multiplier", F.when(F.col("variance") > limit, 0.9).otherwise(1.0))


def reinforce_context(pairs: DataFrame, links: DataFrame, least: float = 0.6) -> DataFrame:
    """Links after records were used together (``id, other, similarity``): a link in either direction
    grows by .05 up to 1; without one, similarity above ``least`` makes a semantic link of .8 of it."""
    ends = lambda df, a, b: df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    asked = ends(pairs.where("id <> other"), "id", "other").groupBy("lo", "hi").agg(F.max("similarity").alias("similarity"))
    known = ends(links, "source_id", "target_id").groupBy("lo", "hi").agg(F.max("weight").alias("weight"))
    joined = asked.join(known, ["lo", "hi"], "left")
    grown = F.when(F.col("weight").isNotNull(), F.least(F.lit(1.0), F.col("weight") + 0.05)).when(F.col("similarity") > least, F.col("similarity") * 0.8)
    return joined.select("lo", "hi", grown.alias("weight"), F.col("weight").isNull().alias("created")).where(F.col("weight").isNotNull())


def pattern_registry(rows: DataFrame) -> DataFrame:
    """Per pattern: how often, the first record that has it and the last time; its records stay rows of the input."""
    return rows.groupBy("pattern").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("ts").alias("last_seen"))


def arrow(drift: Column) -> Column:
    return F.when(drift > 0.02, "up").when(drift < -0.02, "down").otherwise("equal")


def top_drift(rows: DataFrame, k: int = 3, least: float = 0.06) -> DataFrame:
    """``user_id, label, drift, arrow``: the labels whose short-term share moved most from the mean (``short, mean``)."""
    moved = rows.withColumn("drift", F.round(clamp(F.coalesce("short", F.lit(0.0))) - clamp(F.coalesce("mean", F.lit(0.0))), 6))
    moved = moved.where(F.abs("drift") >= least)
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.abs("drift")), "label"))
    return moved.withColumn("nth", nth).where(F.col("nth") <= k).select("user_id", "label", "drift", arrow(F.col("drift")).alias("arrow"))


def trust(confidence: Column) -> Column:
    return clamp((clamp(confidence) - 0.10) / 0.90)


def blend(a: Column, b: Column, t: Column) -> Column:
    return clamp(a * (1 - t) + b * t)


def carried(old: Column, new: Column, same: Column) -> Column:
    """Smoothing: what stays the same moves by .35 to the new value, what changed by .75."""
    share = F.when(same, 0.35).otherwise(0.75)
    return old * (1 - share) + new * share


def top_keys(scores: str) -> list[Column]:
    """``top_key, second_key, max_score`` of a map, largest value first, ties by key."""
    order = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return [F.get(order, 0)["k"].alias("top_key"), F.get(order, 1)["k"].alias("second_key"), (-F.get(order, 0)["v"]).alias("max_score")]
