"""Ranked recall as a whole: expanded concepts, all score terms, prefilters, tiers and fall-backs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import text as X
from quillgrove.functions.activation import clamp
from quillgrove.operators import recall as R
from quillgrove.session import materialize


def expanded_concepts(query: str, aliases: Mapping[str, list[str]], stopwords: tuple[str, ...] = X.STOPWORDS) -> list[str]:
    """Concepts of a query (driver-side): the aliases of every phrase it holds, then its tokens that no such phrase covers."""
    padded = f" {re.sub('[^a-zà-ÿ0-9]+', ' ', query.lower()).strip()} "
    out = list(dict.fromkeys(a.lower() for trigger, names in aliases.items() if f" {trigger} " in padded for a in names))
    phrases = [set(c.split()) for c in out if " " in c]
    for token in re.split(r"[^0-9A-Za-z_]+", query.lower()):
        if (token in aliases or len(token) > 2 and token not in stopwords) and not any(token in p for p in phrases) and token not in out:
            out.append(token)
    return out


def echo_score(rows: DataFrame, query: str, concepts: list[str], generic: list[str] = (), acronym: str = "", phrases: list[str] = (), hints: list[str] = ()) -> DataFrame:
    """Adds ``echo``: acronym and phrase boosts, coverage and density of concepts and the tags' match, less penalties.

    ``generic``: phrases of polite filler; ``hints``: tags that speak for a record by themselves.
    """
    normal = X.normalised(F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"_n": normal, "_t": F.lower(F.replace(F.array_join("tags", " "), F.lit("_"), F.lit(" ")))})
    count = lambda column, words: sum((X.mentions(F.col(column), w).cast("int") for w in words), F.lit(0))
    n, matched = max(1, len(concepts)), count("_n", concepts)
    boost = F.lit(0.0)
    if acronym and acronym in concepts:
        boost = boost + count("_n", [acronym]) * 0.28
    boost = boost + count("_n", [p for p in phrases if p in concepts]) * 0.12
    density = F.least(F.lit(0.25), matched / F.greatest(F.lit(8), F.length("_n") - F.length(F.replace("_n", F.lit(" "))) + 1) * 4)
    hinted = F.size(F.filter("tags", lambda t: F.lower(t).isin(*hints))) if hints else F.lit(0)
    tags = F.least(F.lit(1.0), count("_t", concepts) / n + hinted * 0.08)
    says = sum((F.contains("_n", F.lit(p)).cast("int") for p in generic), F.lit(0))
    assistant = F.array_contains("tags", "assistant")
    filler = F.least(F.lit(0.35), says * 0.08 + F.when(assistant & (says > 0), 0.05).otherwise(0.0) + F.when(assistant & (F.col("memory_depth") == "temporary"), 0.18).otherwise(0.0))
    asked = re.sub(r"\s+", " ", query.strip().lower()).rstrip("?!.,;:")
    said = F.regexp_replace("_n", "[?!.,;:]+$", "")
    few = matched <= 1
    copied = F.when(said == asked, F.when(few, 0.35).otherwise(0.15)).when(
        (F.length(said) <= len(asked) + 30) & F.contains(said, F.lit(asked)), F.when(few, 0.25).otherwise(0.1)
    ).otherwise(0.0)
    score = clamp(boost + matched / n * 0.35 + density + tags * 0.2 - filler - copied)
    return rows.withColumn("echo", F.when(F.col("_n") == "", 0.0).otherwise(score)).drop("_n", "_t")


def final_scores(rows: DataFrame, links: DataFrame, query: str, concepts: list[str], **echo) -> DataFrame:
    """``id, base, echo, boost, score``: .65 base, .25 echo and .10 of the capped boosts of typed links."""
    scored = R.score_texts(echo_score(rows, query, concepts, **echo), query).select("id", "activation", "text_match", "base", "echo")
    scored = materialize(scored, "scored")  # both sides of the links' join read it: texts are scored once
    boosted = R.typed_link_boost(scored, links)
    boost = F.coalesce("boost", F.lit(0.0))
    return boosted.select("id", "base", "echo", boost.alias("boost"), (F.col("base") * 0.65 + F.col("echo") * 0.25 + boost * 0.10).alias("score"))


def warm_prefilter(rows: DataFrame, concepts: list[str]) -> DataFrame:
    """Rows that mention any concept in text or tags; all rows if none does.

    Whether any does is asked first, up to the first that does: so texts are read once where none
    does, and little more where many do.
    """
    said = F.lower(F.concat_ws(" ", "text", F.replace(F.array_join("tags", " "), F.lit("_"), F.lit(" "))))
    marked = rows.withColumn("_said", said)  # a column of its own: every concept reads it
    hits = marked.where(reduce(lambda a, b: a | b, (X.mentions(F.col("_said"), c) for c in concepts), F.lit(False))).drop("_said")
    return rows if hits.select(F.lit(1)).isEmpty() else hits


def by_type(rows: DataFrame, structural: bool = True, episodic: bool = True, max_age: float | None = None, stability: float = 0.5) -> DataFrame:
    """Rows without types that aren't asked for, old episodes and unstable structures; an absent stability passes."""
    gone = F.lit(False)
    if not structural:
        gone = gone | (F.col("type") == "structural")
    if not episodic:
        gone = gone | (F.col("type") == "episodic")
    if max_age:
        gone = gone | ((F.col("type") == "episodic") & (F.col("age") > max_age))
    gone = gone | ((F.col("type") == "structural") & (F.col("stability") < stability))
    return rows.where(~F.coalesce(gone, F.lit(False)))


def normalised_ranking(ranked: DataFrame, known: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` ranks, each id once where it comes first; rows that no ranking may hold)."""
    joined = ranked.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    good = F.coalesce(F.col("_known") & F.col("score").between(0, 1) & ~F.isnan("score"), F.lit(False))
    first = Window.partitionBy("id").orderBy("position")
    kept = joined.where(good).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.orderBy("position").limit(limit).select("id", "position", "score"), joined.where(~good).select("id", "position", "score")


def first_seen(*lists: DataFrame) -> DataFrame:
    """``id, origin, position``: the union of lists, an id where it is first; rows without id are left out."""
    rows = [df.select("id", F.lit(i).alias("origin"), "position") for i, df in enumerate(lists)]
    both = rows[0]
    for df in rows[1:]:
        both = both.union(df)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("origin", "position"))
    return both.where("id IS NOT NULL").withColumn("_n", nth).where("_n = 1").drop("_n")


def with_deep_fallback(near: DataFrame, deep: DataFrame, requests: DataFrame, min_results: int | None, min_best: float | None) -> DataFrame:
    """Results of each request, with those of the deep tier where the others are few or weak, and ``deep_reason``."""
    seen = near.groupBy("request").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    state = requests.select("request").distinct().join(seen, "request", "left")
    few = F.coalesce("n", F.lit(0)) < min_results if min_results is not None else F.lit(False)
    weak = F.col("best").isNull() | (F.col("best") < min_best) if min_best is not None else F.lit(False)
    reason = F.concat_ws("+", F.when(few, "LOW_COUNT"), F.when(weak, "LOW_SCORE"))
    state = state.select("request", F.when(reason == "", "NOT_REQUESTED").otherwise(reason).alias("deep_reason"))
    asked = deep.join(state.where("deep_reason <> 'NOT_REQUESTED'").select("request"), "request", "left_semi")
    return near.unionByName(asked).join(state, "request")


def tier_rows(rows: DataFrame, tier: str) -> DataFrame:
    """What the retriever of one tier may see; an absent kind is taken from the type."""
    kind = F.coalesce("memory_kind", F.when(F.col("type").isin("episodic", "semantic", "structural"), F.col("type")).otherwise("raw"))
    return rows.where(F.col("tier") == tier).withColumn("memory_kind", kind)


def valid_for_tier(tier: str, user: Column, owners: list[str]) -> Column:
    """Whether a reader of one tier accepts a row: owners that are set agree, raw warm rows, or whole core summaries."""
    mine = F.lit(True)
    for c in owners:
        mine = mine & (F.col(c).isNull() | (F.col(c) == user))
    told = F.coalesce(F.length("text") > 0, F.lit(False))
    if tier == "warm":
        fits = (F.col("memory_kind") == "raw") & (F.col("storage_tier") == "warm")
    else:
        sources = F.col("source_ids")
        fits = (F.col("memory_kind") == "super_memory") & (F.col("storage_tier") == "core") & (F.col("processing_state") == "consolidated")
        fits = fits & sources.isNotNull() & (F.size(F.array_distinct("source_ids")) == F.size("source_ids"))
    return F.coalesce(mine & told & fits, F.lit(False))


def reranked(documents: DataFrame, ranks: DataFrame) -> DataFrame:
    """Documents that a reranker returned, with their rank and relevance."""
    return documents.join(ranks, "id")


def covered_by_core(results: DataFrame) -> DataFrame:
    """``id, kept_id``: results that a core summary among them already holds as a source."""
    covers = results.where("tier = 'core' AND memory_kind = 'super_memory'").select(F.col("id").alias("kept_id"), F.explode("source_ids").alias("id"))
    first = covers.groupBy("id").agg(F.min("kept_id").alias("kept_id"))
    return results.where("memory_kind <> 'super_memory'").select("id").join(first, "id")
