"""Conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import text as X
from quillgrove.functions import time as T
from quillgrove.operators import conversation as C
from quillgrove.plans.registry import Registry
from quillgrove.sources.adapters import TRN, turns

query = Registry()


@query(f"WITH {TRN}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM trn) SELECT conv_id, turn, role FROM n WHERE k <= 3")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return C.last_turns(turns(spark, sf), 3).select("conv_id", "turn", "role")


@query(f"WITH {TRN} SELECT conv_id, turn, role FROM trn WHERE contains(lower(text), 'ation') OR contains(lower(role), 'ation') ORDER BY ts_ms DESC, conv_id, turn LIMIT 30")
def turn_search(spark: SparkSession, sf: str) -> DataFrame:
    return C.search_turns(turns(spark, sf), "ATION").select("conv_id", "turn", "role")


@query(
    f"""WITH {TRN} SELECT conv_id, count(*)::BIGINT AS n_turns, count(*) FILTER (role = 'user')::BIGINT AS n_user, count(*) FILTER (role = 'assistant')::BIGINT AS n_assistant,
arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text FROM trn GROUP BY conv_id"""
)
def turn_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.statistics(turns(spark, sf))


@query(
    f"""WITH {TRN}, p AS (SELECT *, lag(role) OVER w AS br, lag(text) OVER w AS question FROM trn WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, turn, question, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM p WHERE role = 'assistant' AND traffic = 'green' AND br = 'user')
SELECT conv_id, turn, question, answer FROM g WHERE k <= 5"""
)
def context_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    return C.last_exchanges(turns(spark, sf))


def _gap(names: list) -> str:
    limits = [300000, 3600000, 86400000, 604800000, 2592000000]
    return "CASE " + " ".join(f"WHEN gap_ms <= {x} THEN {n}" for x, n in zip(limits, names, strict=False)) + f" ELSE {names[-1]} END"


@query(
    f"""WITH {TRN}, g AS (SELECT conv_id, lag(turn) OVER w AS before, turn, ts_ms - lag(ts_ms) OVER w AS gap_ms FROM trn WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, before, turn, gap_ms, {_gap(["'immediate'", "'hour'", "'day'", "'week'", "'month'", "'distant'"])} AS gap_class, ({_gap([0.45, 0.40, 0.32, 0.22, 0.14, 0.08])})::DOUBLE AS weight FROM g WHERE before IS NOT NULL"""
)
def sequence_links(spark: SparkSession, sf: str) -> DataFrame:
    return C.sequence_links(turns(spark, sf))


SAID = ["ti ricordi di me", "ho finito tutto", "ieri  era bello", "domani parto", "adesso piove", "sei già tornato, fatto", "non devi più andare", "niente", "è già fatto", "vero?"]
_SAID = "CASE (conv_id + turn) % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SAID)) + " END"


def _has(phrases: list[str]) -> str:
    return f"regexp_matches(s, '{T.phrase_pattern(phrases)}')"


INTENT_CASE = f"""CASE WHEN contains(s, '?') OR {_has(T.QUESTION)} THEN 'query' WHEN role = 'assistant' AND {_has(T.SUMMARY)} THEN CASE WHEN {_has(T.DONE)} THEN 'completed_event' ELSE 'generic' END
 WHEN {_has(T.COMPLETED)} OR (role = 'assistant' AND {_has(T.ALREADY)} AND {_has(T.DONE)}) THEN 'completed_event' WHEN {_has(T.PAST)} THEN 'past_event'
 WHEN {_has(T.FUTURE)} THEN CASE WHEN role = 'assistant' THEN 'generic' ELSE 'future_intent' END WHEN {_has(T.CURRENT)} THEN 'current_state' ELSE 'generic' END"""
INTENT = f"""said AS (SELECT *, conv_id % 100 AS hours, strip_accents(lower({_SAID} || ' ' || text)) AS s FROM trn), i AS (SELECT *, {INTENT_CASE} AS intent FROM said)"""


@query(
    f"""WITH {TRN}, {INTENT} SELECT conv_id, turn, intent, CASE intent WHEN 'query' THEN 'query' WHEN 'past_event' THEN 'historical' WHEN 'completed_event' THEN 'completed'
 WHEN 'current_state' THEN CASE WHEN hours > 24 THEN 'stale' ELSE 'current' END WHEN 'future_intent' THEN CASE WHEN hours > 36 THEN 'expired_future' ELSE 'future_pending' END
 ELSE CASE WHEN hours > 72 THEN 'stale' ELSE 'recent' END END AS validity,
CASE intent WHEN 'completed_event' THEN 'completed' WHEN 'current_state' THEN 'current' WHEN 'past_event' THEN 'past' WHEN 'query' THEN 'query' WHEN 'future_intent' THEN 'future_intent'
 ELSE CASE WHEN hours >= 24 THEN 'past' ELSE 'current' END END AS state FROM i"""
)
def temporal_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn behind one of ten openings: its intent, and what that means at its age."""
    rows = turns(spark, sf).select("conv_id", "turn", T.temporal_intent(F.concat(F.expr(_SAID), F.lit(" "), F.col("text")), F.col("role")).alias("intent"), (F.col("conv_id") % 100).alias("hours"))
    intent, hours = F.col("intent"), F.col("hours")
    return rows.select("conv_id", "turn", "intent", T.validity(intent, hours).alias("validity"), T.temporal_state(intent, hours).alias("state"))


RULES = [("travel", "the", 1.0), ("travel", "ation", 2.0), ("health", "er", 1.5), ("health", "inthe", 3.0), ("work", "que", 2.5), ("work", "ung", 2.5)]


def _rule(name: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{n}') THEN {w}::DOUBLE ELSE 0 END" for r, n, w in RULES if r == name)


@query(
    f"""WITH {TRN}, s AS (SELECT conv_id, turn, {_rule('travel')} AS a, {_rule('health')} AS b, {_rule('work')} AS c FROM trn)
SELECT conv_id, turn, greatest(a, b, c) AS route_score, CASE WHEN greatest(a, b, c) <= 1 THEN 'general' WHEN a = greatest(a, b, c) THEN 'travel' WHEN b = greatest(a, b, c) THEN 'health' ELSE 'work' END AS route FROM s"""
)
def domain_route(spark: SparkSession, sf: str) -> DataFrame:
    return C.route(turns(spark, sf), RULES, 1.0).select("conv_id", "turn", "route_score", "route")


@query(f"WITH {TRN} SELECT conv_id, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM trn GROUP BY conv_id")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).groupBy("conv_id").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


@query(
    f"""WITH {TRN} SELECT t.conv_id, t.turn, CASE WHEN t.conv_id % 5 = 0 AND t.turn % 2 = 1 THEN 'red' ELSE traffic END AS traffic FROM trn t"""
)
def turn_relabel(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf)
    labels = rows.where("conv_id % 5 = 0 AND turn % 2 = 1").select("conv_id", "turn", F.lit("red").alias("traffic"))
    return C.relabel(rows, labels).select("conv_id", "turn", "traffic")
