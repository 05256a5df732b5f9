"""Recall: filters, scorers, routing between tiers, dedup and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import activation as A
from quillgrove.functions import text as X


def recall_filter(
    rows: DataFrame, min_activation: float | None = None, types: list[str] | None = None, exclude_tags: list[str] | None = None, exclude_depth: list[str] | None = None
) -> DataFrame:
    """An absent activation is kept; excluded tags and depths drop a row, null ones don't."""
    if min_activation is not None:
        rows = rows.where(~F.coalesce(F.col("activation") < min_activation, F.lit(False)))
    if types:
        rows = rows.where(F.col("type").isin(types))
    if exclude_tags:
        rows = rows.where(~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, exclude_tags))), F.lit(False)))
    if exclude_depth:
        rows = rows.where(~F.coalesce(F.col("memory_depth").isin(exclude_depth), F.lit(False)))
    return rows


def base_score(text_match: Column, activation: Column) -> Column:
    return 0.6 * text_match + 0.4 * activation


def score_texts(rows: DataFrame, query: str) -> DataFrame:
    """Adds ``text_match`` and ``base``; one pass over the text, no shuffle."""
    # a projection of its own, so the text is normalised once and not once a token
    rows = rows.withColumn("_normal", X.normalised(F.col("text")))
    scored = rows.withColumn("text_match", X.token_share(F.col("_normal"), X.query_tokens(query))).drop("_normal")
    return scored.withColumn("base", base_score(F.col("text_match"), F.col("activation")))


def link_boost(scored: DataFrame, links: DataFrame, factor: float = 0.25, cap: float = 0.25) -> DataFrame:
    """Adds ``boost``: what directly matching neighbours pass on along links, capped.

    Only neighbours that match at all enter the join, and sums are partial
    aggregates, so a hub costs one row per task.
    """
    both = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "weight").union(
        links.select("target_id", "source_id", "weight")
    )
    direct = scored.where("text_match > 0").select(F.col("id").alias("other"), F.col("base").alias("other_base"))
    passed = both.join(direct, "other").groupBy("id").agg(F.sum(F.col("weight") * factor * F.col("other_base")).alias("sum"))
    joined = scored.join(passed, "id", "left")
    return joined.withColumn("boost", F.least(F.lit(cap), F.coalesce("sum", F.lit(0.0)))).drop("sum")


def typed_link_boost(scored: DataFrame, links: DataFrame, factor: float = 0.2) -> DataFrame:
    """As above with the link type's quality, capped per type and summed."""
    both = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "weight", "link_type").union(
        links.select("target_id", "source_id", "weight", "link_type")
    )
    direct = scored.where("text_match > 0").select(F.col("id").alias("other"), F.col("base").alias("other_base"))
    gain = F.col("other_base") * F.col("weight") * factor * A.link_quality(F.col("link_type"))
    kind = F.when(F.col("link_type").isin("semantic", "dialogue_sequence"), F.col("link_type")).otherwise("continuation")
    caps = F.when(F.col("kind") == "semantic", 0.2).when(F.col("kind") == "dialogue_sequence", 0.03).otherwise(0.05)
    by_kind = both.join(direct, "other").withColumn("kind", kind).groupBy("id", "kind").agg(F.sum(gain).alias("gain"))
    summed = by_kind.groupBy("id").agg(F.sum(F.least("gain", caps)).alias("boost"))
    return scored.join(summed, "id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def best_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key: at scale an aggregate by key, here a ranked window over it."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def route(results: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Merged results of tiers, deduplicated by id and then by content; and what was suppressed, with the reason."""
    rank = F.when(F.col("tier") == "core", 0).when(F.col("tier") == "warm", 1).otherwise(2)
    order = [F.desc("score"), rank, F.col("id")]
    by_id = results.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    same_id = by_id.where("_n > 1").select("id", F.col("id").alias("kept_id"), F.lit("duplicate_id").alias("reason"))
    unique = by_id.where("_n = 1").drop("_n")
    by_text = unique.withColumns(
        {"_n": F.row_number().over(Window.partitionBy("content_hash").orderBy(*order)), "kept_id": F.first("id").over(Window.partitionBy("content_hash").orderBy(*order))}
    )
    suppressed = by_text.where("_n > 1").select("id", "kept_id", F.lit("duplicate_content").alias("reason"))
    return top(by_text.where("_n = 1").drop("_n", "kept_id"), limit, *order), same_id.union(suppressed)


def uncovered(results: DataFrame, covers: DataFrame) -> DataFrame:
    """Results that no returned summary record has among its sources (``covers``: source ids)."""
    return results.join(covers.select(F.explode("source_ids").alias("id")).distinct(), "id", "left_anti")


def packed_context(ranked: DataFrame, max_chars: int = 4000, max_items: int = 6) -> DataFrame:
    """The first rows by rank until the length or the count runs over."""
    # no more than max_items rows can pass, so only those are summed
    head = ranked.orderBy("rank").limit(max_items)
    running = F.sum(F.length("text")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("running", running).where(F.col("running") <= max_chars)


def index_search(rows: DataFrame, query: str) -> DataFrame:
    """``id, score``: how many query words (repeats count) the record's token index holds."""
    words = [t for t in X.query_tokens(query, ()) if len(t) > 3]
    score = sum((F.when(F.array_contains("_tokens", w), 1).otherwise(0) for w in words), F.lit(0))
    return rows.select("id", X.index_tokens(F.col("text")).alias("_tokens")).select("id", score.cast("long").alias("score")).where("score > 0")
