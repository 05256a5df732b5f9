"""Time relations of statements: which newer ones confirm, complete or update older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.operators import time_relations as R
from quillgrove.plans.conversation_queries import INTENT_CASE
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table

query = Registry()

#: What is said before a turn's own text, by its place: the tables hold no statements in the records' language.
PLANTED = [
    "Domani devo andare a Roma.", "Devo chiamare Marta.", "Marta ha la febbre.", "Siamo tornati da Roma.", "Ho chiamato Marta.", "Marta sta meglio.",
    "La temperatura resta alta.", "Non ha piu febbre.", "Domani dobbiamo partire per Napoli.", "Viaggio finito a Napoli.", "Sono andato a Napoli.",
    "Devo ancora chiamare Marta?", "Ieri ho visto Marta.", "Ora siamo qui.",
]
SAID = f"element_at(array({', '.join(repr(x) for x in [*PLANTED, '', ''])}), CAST((conv_id * 5 + turn * 3) % {len(PLANTED) + 2} AS int) + 1) || ' ' || text"
HOUR = 3_600_000


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as statements: four conversations a user, a day and a half apart, turns three hours apart."""
    return read_table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "conv_id * 10000 + turn AS id", "conv_id div 4 AS user_id", f"(conv_id % 4 * 12 + turn) * 3 * {HOUR} AS ts", "role", f"{SAID} AS text",
        "CAST(NULL AS array<string>) AS tags", "CAST(NULL AS array<string>) AS domains",
    )


def _words(expression: str, shortest: int) -> str:
    return f"list_distinct(list_filter(list_transform({expression}, lambda x: strip_accents(lower(trim(x)))), lambda x: length(x) >= {shortest}))"


STATEMENTS = f"""trn AS (SELECT conv_id, turn, conv_id * 10000 + turn AS id, conv_id // 4 AS user_id, (conv_id % 4 * 12 + turn) * 3 * {HOUR} AS ts, role,
 [{", ".join(repr(x) for x in [*PLANTED, "", ""])}][(conv_id * 5 + turn * 3) % {len(PLANTED) + 2} + 1] || ' ' || text AS text FROM conversations),
said AS (SELECT *, strip_accents(lower(text)) AS s FROM trn),
st AS (SELECT *, {INTENT_CASE} AS intent, {_words(f"regexp_extract_all(text, '{R.ENTITY.replace(chr(39), chr(39) * 2)}', 0)", 3)} AS ents,
 list_filter(string_split_regex(s, '\\s+'), lambda w: length(w) >= 4 AND NOT list_contains({R.STOPWORDS}, w)) AS words,
 {_words(f"list_transform(regexp_extract_all(text, '{R.PLACE.replace(chr(39), chr(39) * 2)}', 1), lambda x: regexp_replace(x, '[.,;:!?]+$', ''))", 1)} AS places,
 {", ".join(f"regexp_matches(s, '{p}') AS {n}" for n, p in (("call", R.CALL_INTENT), ("called", R.CALL_DONE), ("fever", R.FEVER), ("recovered", R.FEVER_DONE), ("fever_named", R.FEVER_NAMED), ("returned", R.JOURNEY_DONE), ("journey_closed", R.JOURNEY_CLOSED)))},
 regexp_matches(s, '{R.TOMORROW}') AND regexp_matches(s, '{R.LEAVING}') AS leaving FROM said)"""
RULE = """CASE WHEN o.call AND n.called AND (list_has_any(o.ents, n.ents) OR list_has_any(o.words, n.words)) THEN 0 WHEN o.fever AND n.recovered AND list_has_any(o.ents, n.ents) THEN 1
 WHEN o.fever AND n.recovered AND n.fever_named THEN 2 WHEN o.leaving AND n.returned AND list_has_any(o.places, n.places) THEN 3
 WHEN o.leaving AND n.returned AND n.journey_closed AND (list_has_any(o.ents, n.ents) OR list_has_any(o.words, n.words)) THEN 4 END"""
CONTEXT = "(list_has_any(o.ents, n.ents) OR list_has_any(o.words, n.words))"


def _pick(values: dict[int, object]) -> str:
    return f"[{', '.join(repr(values[i]) for i in sorted(values))}][rule + 1]"


@query(
    f"""WITH {STATEMENTS}, p AS (SELECT o.id, n.id AS new_id, n.ts, o.role AS old_role, n.role AS new_role, {RULE} AS rule FROM st o JOIN st n ON n.user_id = o.user_id AND n.ts > o.ts
  WHERE o.intent NOT IN ('query', 'past_event', 'completed_event') AND n.intent <> 'query' AND {CONTEXT} AND NOT (o.role = 'user' AND n.role = 'assistant')),
f AS (SELECT id, arg_min({{'new_id': new_id, 'rule': rule, 'more': CASE WHEN new_role = 'user' AND old_role = 'assistant' THEN {R.MORE_FOR_USER} ELSE 0 END}}, (ts, new_id)) AS f FROM p WHERE rule IS NOT NULL GROUP BY id),
g AS (SELECT id, f.new_id, f.rule AS rule, f.more AS more FROM f)
SELECT st.id, user_id, new_id AS superseded_by, {_pick(R.KIND)} AS relation, CASE WHEN rule IS NOT NULL THEN round(least(1.0, {_pick(R.CONFIDENCE)}::DOUBLE + more::DOUBLE), 6)::DOUBLE END AS confidence FROM st LEFT JOIN g USING (id)"""
)
def supersession(spark: SparkSession, sf: str) -> DataFrame:
    """Per statement the first newer one that completes or updates it."""
    return R.supersede(_statements(spark, sf))


@query(
    f"""WITH {STATEMENTS}, q AS (SELECT *, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM st),
r AS (SELECT o.id, n.id AS new_id, {RULE} AS rule, {CONTEXT} AS context, o.intent AS oi, n.intent AS ni, o.role AS o_role, n.role AS n_role FROM q o JOIN q n ON n.id = o.next_id),
k AS (SELECT *, CASE WHEN rule IS NOT NULL THEN {_pick(R.KIND)} WHEN oi = 'past_event' THEN 'related' WHEN oi = ni THEN 'confirms' ELSE 'related' END AS kind,
 CASE WHEN rule IS NOT NULL THEN {_pick(R.CONFIDENCE)}::DOUBLE WHEN oi = 'past_event' THEN 0.35 WHEN oi = ni THEN 0.55 WHEN ni = 'completed_event' AND oi IN ('future_intent', 'current_state') THEN 0.55 ELSE 0.4 END::DOUBLE AS c FROM r)
SELECT id, new_id, CASE WHEN NOT context THEN 'none' WHEN oi = 'query' OR ni = 'query' THEN 'related' WHEN n_role = 'assistant' AND o_role = 'user' AND kind IN ('completes', 'updates') THEN 'confirms' ELSE kind END AS relation,
 round(CASE WHEN NOT context THEN 0 WHEN oi = 'query' OR ni = 'query' THEN 0.2 WHEN n_role = 'assistant' AND o_role = 'user' THEN greatest(0, c - {R.LESS_FOR_ASSISTANT})
  WHEN n_role = 'user' AND o_role = 'assistant' AND kind IN ('completes', 'updates') THEN least(1, c + {R.MORE_FOR_USER}) ELSE c END, 6)::DOUBLE AS confidence FROM k"""
)
def time_relations(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn says of the one before it."""
    rows = _statements(spark, sf)
    said = R.statements(rows).drop("text", "user_id", "ts")
    after = Window.partitionBy("conv_id").orderBy("turn")
    follows = rows.select(F.col("id").alias("old_id"), F.lead("id").over(after).alias("new_id")).where("new_id is not null")
    for side in ("old", "new"):
        follows = follows.join(said.select(*(F.col(c).alias(f"{side}_{c}") for c in said.columns)), f"{side}_id")
    return R.relation(follows).select(F.col("old_id").alias("id"), "new_id", "relation", "confidence")
