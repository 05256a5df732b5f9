"""Activation arithmetic and bands as Column expressions.

Three level rules and two cold rules are in use side by side; each has its own name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def computed(previous: Column, reinforcement: Column, days: Column, alpha: float = 0.97, beta: float = 0.15, gamma: float = 0.005) -> Column:
    return clamp(previous * alpha + reinforcement * beta - days * gamma)


def inertia(previous: Column, activation: Column, m: float = 0.95) -> Column:
    return previous * m + activation * (1 - m)


def level(activation: Column) -> Column:
    """Engine bands."""
    return F.when(activation >= 0.7, "short").when(activation >= 0.3, "medium").otherwise("long")


def node_level(activation: Column) -> Column:
    """Node bands: below .15 long, below .3 medium, else short."""
    return F.when(activation < 0.15, "long").when(activation < 0.3, "medium").otherwise("short")


def depth(activation: Column, explicit: Column | None = None) -> Column:
    by_score = F.when(activation >= 0.95, "core").when(activation >= 0.75, "deep").when(activation >= 0.3, "normal").otherwise("temporary")
    if explicit is None:
        return by_score
    return F.when(explicit.isin("core", "deep", "normal", "temporary"), explicit).otherwise(by_score)


def decayed_exponential(activation: Column, rate: Column, days: Column) -> Column:
    return activation * F.exp(-rate * days)


def decayed_linear(activation: Column, rate: Column, days: Column, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(floor), activation * (1 - rate * days))


def accessed(activation: Column, rate: Column, days: Column, link_weight: Column) -> Column:
    """After an access: linear decay, then a boost that grows with the links' weight."""
    return F.least(F.lit(1.0), decayed_linear(activation, rate, days) + 0.15 * (1 + F.log(link_weight + 1)))


def affect(previous: Column, stimulus: Column) -> Column:
    return clamp(previous * 0.98 + stimulus * 0.5, -1.0, 1.0)


def modulated(reinforcement: Column, affective: Column) -> Column:
    return reinforcement * F.when(affective > 0, 1 + affective * 0.3).otherwise(1.0)


def initial(kind: Column, importance: Column) -> Column:
    return (
        F.when(kind == "structural", 0.95).when(kind == "semantic", 0.7).when(kind == "working", 0.9).otherwise(0.4 + 0.5 * importance)
    )


def is_cold(activation: Column, idle_days: Column, idle_limit: float = 60) -> Column:
    return (activation < 0.05) & (idle_days > idle_limit)


def is_cold_node(activation: Column, age_days: Column) -> Column:
    return (age_days > 90) & (activation < 0.05)


def link_weight(weight: Column, reinforcement: Column) -> Column:
    return clamp(weight * 0.95 + reinforcement)


def link_quality(kind: Column) -> Column:
    return F.when(kind == "semantic", 1.0).when(kind == "continuation", 0.25).when(kind == "dialogue_sequence", 0.1).otherwise(0.2)


def tier(kind: Column, storage: Column, memory_depth: Column) -> Column:
    """core, warm, deep or null, as a struct with the reason."""

    def out(value: str | None, reason: str) -> Column:
        return F.struct(F.lit(value).cast("string").alias("tier"), F.lit(reason).alias("reason"))

    return (
        F.when((kind == "super_memory") & (storage == "core"), out("core", "super_core"))
        .when(kind == "super_memory", out(None, "super_not_core"))
        .when(storage.isin("warm", "deep"), F.struct(storage.alias("tier"), F.lit("explicit").alias("reason")))
        .when(storage.isNotNull(), out(None, "unknown_tier"))
        .when(memory_depth.isin("deep", "historical"), out("deep", "legacy_depth"))
        .otherwise(out("warm", "legacy_default"))
    )
