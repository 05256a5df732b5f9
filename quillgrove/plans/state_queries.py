"""World state by what users say of their journeys, and what conversations carry to their last turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.operators import carry as C
from quillgrove.operators import world_state as W
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table

query = Registry()
HOUR = 3_600_000

#: What is said after a turn's own text, by its place: the tables hold no statements in the records' language.
PLANTED = [
    "Domani devo andare a Roma.", "Siamo arrivati a Roma Nord, poi a casa.", "Siamo tornati da Roma.", "Sono in ospedale a San Giovanni di Dio.", "Dove devo andare a Napoli?",
    "Partiremo per Napoli e in Sicilia", "Sono rientrata dall'Universita di Pisa.", "Vado a Torino di nuovo", "Sto per partire in terapia a Milano", "Siamo qui a Milano Centrale Est Ovest",
    "Sono andato a Napoli, sono tornato da Napoli Dopo", "andiamo in Casa e in casa", "", "",
]
SAID = f"coalesce(text, '') || ' ' || element_at(array({', '.join(chr(34) + x + chr(34) for x in PLANTED)}), CAST((conv_id * 5 + turn * 3) % {len(PLANTED)} AS int) + 1)"
AT = f"(conv_id % 4 * 12 + turn) * 3 * {HOUR}"
PRESENT = 47 * 3 * HOUR


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Journeys named in turns: four conversations a user, a day and a half apart, turns three hours apart."""
    return W.travel_events(read_table(spark, sf, "conversations").selectExpr("conv_id div 4 AS user_id", f"{AT} AS ts", "conv_id * 10000 + turn AS seq", f"{SAID} AS text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, {_quoted('|'.join(patterns))})"


def _plain(x: str) -> str:
    return f"strip_accents(lower({x}))"


def _goes_on(x: str) -> str:
    bare = f"replace({_plain(x)}, '''', '')"
    return (
        f"coalesce(NOT list_contains({W.INTRODUCING + W.ENDING}, {bare}) AND NOT regexp_matches({_plain(x)}, {_quoted(W.GLUED)}) AND {x} <> '' AND NOT list_contains({W.NEVER}, {_plain(x)})"
        f" AND (regexp_matches({x}, {_quoted(W.CAPITAL)}) OR list_contains({W.JOINING}, {_plain(x)})), false)"
    )


_JOINS = {x: f"list_contains({W.JOINING}, {_plain(x)})" for x in ("first", "second", "third")}
_STATE = " ".join(f"WHEN {_any('s', patterns)} THEN '{state}'" for state, patterns in W.STATES.items())
EVENTS = f"""trn AS (SELECT row_number() OVER () AS rid, conv_id // 4 AS user_id, {AT.replace("conv_id % 4", "(conv_id % 4)")} AS ts, conv_id * 10000 + turn AS seq,
 coalesce(text, '') || ' ' || [{", ".join(_quoted(x) for x in PLANTED)}][(conv_id * 5 + turn * 3) % {len(PLANTED)} + 1] AS text FROM conversations),
said AS (SELECT *, {_plain("text")} AS s FROM trn),
moves AS (SELECT *, CASE {_STATE} END AS state FROM said WHERE {_any("s", W.MOVES)} AND NOT contains(text, '?') AND NOT {_any("s", W.QUESTIONS)} AND NOT {_any("s", W.THEORY)}),
words AS (SELECT *, list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(x, {_quoted(W.TAIL)}, '')) AS w FROM moves WHERE state IS NOT NULL),
each_word AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM words),
intro AS (SELECT *, list_contains({W.INTRODUCING}, replace({_plain("w[i]")}, '''', '')) AS introduces, regexp_extract({_plain("w[i]")}, {_quoted(W.GLUED)}, 1) AS glued FROM each_word),
begun AS (SELECT *, CASE WHEN introduces THEN w[i + 1] WHEN glued <> '' THEN regexp_replace(substr(w[i], length(glued) + 1), '^''', '') END AS first, w[i + introduces::INT + 1] AS second,
 w[i + introduces::INT + 2] AS third FROM intro),
named AS (SELECT *, CASE WHEN regexp_matches(first, {_quoted(W.CAPITAL)}) AND {_goes_on("second")} THEN 1 + ({_goes_on("third")})::INT ELSE 0 END AS more FROM begun
 WHERE first <> '' AND NOT list_contains({W.NEVER}, {_plain("first")}) AND (list_contains({W.COMMON}, {_plain("first")}) OR regexp_matches(first, {_quoted(W.CAPITAL)}))),
places AS (SELECT *, CASE WHEN more = 2 AND NOT {_JOINS["third"]} THEN concat_ws(' ', first, second, third) WHEN more >= 1 AND NOT {_JOINS["second"]} THEN concat_ws(' ', first, second)
 WHEN NOT {_JOINS["first"]} THEN first ELSE '' END AS place FROM named),
ev AS (SELECT user_id, place, ts, seq, state, text FROM places WHERE place <> '' QUALIFY row_number() OVER (PARTITION BY rid, {_plain("place")} ORDER BY i) = 1)"""


@query(f"WITH {EVENTS} SELECT user_id, place, ts, seq, state FROM ev")
def travel_events(spark: SparkSession, sf: str) -> DataFrame:
    """Places of journeys that turns name, and whether they are planned, reached or done with."""
    return _events(spark, sf).drop("text")


@query(
    f"""WITH {EVENTS}, c AS (SELECT *, CASE WHEN state = 'completed' THEN 'completed' WHEN {PRESENT} - ts <= 86400000 THEN CASE state WHEN 'planned' THEN 'planned' ELSE 'current' END END AS status FROM ev),
l AS (SELECT user_id, place, arg_max({{'status': status, 'ts': ts, 'text': text}}, (ts, seq, text)) AS l, count(DISTINCT (ts, seq))::BIGINT AS n FROM c WHERE status IS NOT NULL GROUP BY 1, 2)
SELECT user_id, place, l.status AS status, CASE l.status WHEN 'completed' THEN 0.95 WHEN 'current' THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence, l.ts AS ts, l.text AS text, n FROM l"""
)
def travel_states(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each user and place that counts at the present."""
    return W.world_states(_events(spark, sf), F.lit(PRESENT))


#: What a turn says, read off its text; both engines know these functions.
FIELDS = {
    "topic": "CASE WHEN said LIKE '%ation%' THEN 'travel' WHEN said LIKE '%sth%' THEN 'generic' WHEN said LIKE '%ver%' THEN 'work' END",
    "sub_topic": "nullif(regexp_extract(said, '[A-Z][a-z]{7,}', 0), '')", "frame": "CASE WHEN said LIKE '%hero%' THEN 'family' WHEN said LIKE '%ou%' THEN 'generic' END",
    "need": "CASE WHEN said LIKE '%thin%' THEN 'explanation' WHEN said LIKE '%ly%' THEN 'decision' END", "need_confidence": "length(said) % 100 / CAST(100 AS double)",
    "goal": "CASE WHEN role = 'user' THEN nullif(regexp_extract(said, '^[A-Z][a-z]+ [a-z]{3,}', 0), '') END", "mode": "CASE WHEN role = 'system' THEN 'execution' END",
    "summary": "CASE WHEN role = 'assistant' THEN regexp_extract(said, '[a-z]{12,}', 0) END", "domain": "CASE WHEN said LIKE '%Hea%' THEN 'health' END",
    "pressure": "least(CAST(1 AS double), (length(said) - length(replace(said, '.', ''))) / CAST(8 AS double))",
    "technical": "least(CAST(1 AS double), (length(said) - length(replace(said, ',', ''))) / CAST(10 AS double))",
    "brevity": "greatest(CAST(0 AS double), 1 - length(said) / CAST(1000 AS double))",
    "entities": "regexp_extract_all(said, '[A-Z][a-z]+', 0)", "anchors": "regexp_extract_all(said, '[a-z]{8,}', 0)", "soft": "said LIKE '%Wh%'", "hard": "said LIKE '%Thand%'",
}
_SAID = f"(SELECT conv_id, turn, role, coalesce(text, '') AS said FROM conversations) x"


def _carried(held: str, said: str, most: int) -> str:
    held = f"(CASE WHEN t.hard THEN []::VARCHAR[] ELSE r.{held} END)"
    return f"list_concat({held}, list_filter(t.{said}, lambda x: NOT list_contains({held}, x)))[-{most}:]"


_DISTINCT = {x: f"list_filter({x}_low, lambda v, i: list_position({x}_low, v) = i)" for x in ("entities", "anchors")}


@query(
    f"""WITH RECURSIVE f AS (SELECT conv_id, turn, {", ".join(f"{e} AS {n}" for n, e in FIELDS.items())} FROM {_SAID}),
g AS (SELECT *, list_transform(entities, lambda v: lower(v)) AS entities_low, list_transform(anchors, lambda v: lower(v)) AS anchors_low, soft OR coalesce(domain IN ('health', 'family'), false) AS clears FROM f),
t AS (SELECT * REPLACE ({_DISTINCT["entities"]} AS entities, {_DISTINCT["anchors"]} AS anchors), row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM g),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, NULL::VARCHAR AS topic, NULL::VARCHAR AS sub_topic, 'generic' AS frame, NULL::VARCHAR AS need, NULL::VARCHAR AS goal, 'dialogue' AS mode, '' AS summary,
 0::DOUBLE AS pressure, 0::DOUBLE AS technical, 0::DOUBLE AS brevity, []::VARCHAR[] AS entities, []::VARCHAR[] AS anchors FROM t
UNION ALL SELECT t.conv_id, t.k, CASE WHEN t.topic <> 'generic' THEN t.topic WHEN NOT t.clears THEN r.topic END, CASE WHEN t.sub_topic IS NOT NULL THEN t.sub_topic WHEN NOT t.clears THEN r.sub_topic END,
 CASE WHEN t.frame <> 'generic' THEN t.frame WHEN t.soft THEN 'generic' ELSE r.frame END, CASE WHEN t.need IS NOT NULL AND t.need_confidence >= 0.58::DOUBLE THEN t.need WHEN NOT t.soft THEN r.need END,
 coalesce(t.goal, r.goal), coalesce(t.mode, r.mode), coalesce(nullif(t.summary, ''), r.summary),
 CASE WHEN t.pressure > CASE WHEN t.soft THEN 0 ELSE r.pressure END THEN 0.35::DOUBLE * CASE WHEN t.soft THEN 0 ELSE r.pressure END + 0.65::DOUBLE * t.pressure
  ELSE 0.75::DOUBLE * CASE WHEN t.soft THEN 0 ELSE r.pressure END + 0.25::DOUBLE * t.pressure END,
 0.55::DOUBLE * r.technical + 0.45::DOUBLE * t.technical, 0.5::DOUBLE * r.brevity + 0.5::DOUBLE * t.brevity, {_carried("entities", "entities", C.ENTITIES)}, {_carried("anchors", "anchors", C.ANCHORS)}
 FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT * EXCLUDE (k) REPLACE (round(pressure + 1e-9, 6) AS pressure, round(technical + 1e-9, 6) AS technical, round(brevity + 1e-9, 6) AS brevity) FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1"""
)
def short_memory(spark: SparkSession, sf: str) -> DataFrame:
    """What each conversation carries after its last turn."""
    said = read_table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "coalesce(text, '') AS said")
    out = C.short_memory(said.selectExpr("conv_id", "turn", *(f"{e} AS {n}" for n, e in FIELDS.items())))
    return out.withColumns({x: F.round(F.col(x) + 1e-9, 6) for x in ("pressure", "technical", "brevity")})
