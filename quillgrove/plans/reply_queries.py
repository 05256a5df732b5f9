"""Replies of models, names in texts, neighbours among current points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.operators import current_neighbours as N
from quillgrove.operators import mentions as M
from quillgrove.operators import replies as R
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table
from quillgrove.sources.adapters import VEC, vectors

query = Registry()

# Replies around the whole texts: braces and escaped quotes in strings, an object that never closes, none at all.
_QUOTED = r"""replace(replace(coalesce(text, ''), chr(92), ''), '"', chr(92) || '"')"""
_STRING = f"replace(replace({_QUOTED}, chr(10), ' '), chr(13), ' ')"
_MOOD = f"""CASE doc_id % 5 WHEN 0 THEN 'Sure: ```json' || chr(10) || '{{"note": "a }} b {{ ' || {_STRING} || '", "labels": {{"stress": 0.' || (doc_id % 9) || ', "joy": 1.5, "calm": null}}, "focus": "0.4", "confidence": 0.' || (doc_id % 7 + 1) || '}}' || chr(10) || '``` {{"stress": 1}}'
 WHEN 1 THEN coalesce(text, '') || '{{"anger": -2, "labels": {{"sadness": 0.3, "joy": 0.1}}}} and }} more' WHEN 2 THEN '{{"note": "}} ' || {_STRING} ELSE coalesce(text, '') END"""
_STR = r'"(?:[^"\\]|\\.)*"'
_FLAT = rf'\{{(?:[^{{}}"]|{_STR})*\}}'
_NESTED = rf'(?s)\{{(?:[^{{}}"]|{_STR}|{_FLAT})*\}}'


def _clamped(k: str, v: float) -> str:
    said = f"coalesce(json_extract_string(o, '$.labels.{k}'), json_extract_string(o, '$.{k}'))"
    return f"CASE WHEN {said} IS NULL THEN {v}::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast({said} AS DOUBLE), 0.0::DOUBLE))) END AS {k}"


_OBJECTS = rf"obj AS (SELECT doc_id AS id, nullif(regexp_extract(regexp_replace({_MOOD}, '(?i)```(?:json)?', '', 'g'), '{_NESTED}'), '') AS o FROM documents)"


@query(f"WITH {_OBJECTS} SELECT id, o AS object FROM obj")
def first_json_objects(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"{_MOOD} AS text")
    return rows.select("id", R.first_object(F.col("text")).alias("object"))


@query(
    f"""WITH {_OBJECTS}, v AS (SELECT id, o, {", ".join(_clamped(k, v) for k, v in R.BASELINE.items())}, greatest(0.2::DOUBLE, least(0.95::DOUBLE, coalesce(json_extract_string(o, '$.confidence')::DOUBLE, 0.35::DOUBLE))) AS sure FROM obj),
w AS (SELECT *, greatest({", ".join(f"abs({k} - {v}::DOUBLE)" for k, v in R.BASELINE.items())}) AS off FROM v), x AS (SELECT *, CASE WHEN off >= 0.25 AND sure < 0.55 THEN 0.65 ELSE sure END AS up FROM w)
SELECT id, {", ".join(R.BASELINE)}, CASE WHEN o IS NULL THEN 0.25 WHEN off >= 0.40 AND up < 0.65 THEN 0.75 ELSE up END::DOUBLE AS confidence FROM x"""
)
def reply_moods(spark: SparkSession, sf: str) -> DataFrame:
    return R.moods(read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"{_MOOD} AS text"))


_AUDIT = f"""CASE doc_id % 3 WHEN 0 THEN 'Audit of ' || source || ':' || chr(10) || '{{"recommendedFixes": [{{"title": "' || {_STRING} || '", "priority": "low", "area": "nowhere"}}, {{"title": "", "reason": "brace }}"}}, {{"area": "memory", "suggestedCodexPrompt": "do ' || doc_id || '"}}], "risks": []}}'
 WHEN 1 THEN '- Fix ' || source || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || '* test: ') ELSE coalesce(text, '') || chr(10) || '  • Riduci il debito di ' || lang END"""
_DEFAULT = "CASE WHEN nth < 2 THEN 'high' ELSE 'medium' END"


@query(
    rf"""WITH a AS (SELECT doc_id AS id, {_AUDIT} AS t FROM documents), j AS (SELECT id, t, regexp_extract(t, '(?s)\{{.*\}}') AS c FROM a),
f AS (SELECT id, unnest(json_extract(c, '$.recommendedFixes[*]')) AS x, generate_subscripts(json_extract(c, '$.recommendedFixes[*]'), 1) - 1 AS nth FROM j WHERE c <> ''),
l AS (SELECT id, list_slice(list_filter(list_transform(regexp_split_to_array(t, '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-*•]\s*', '')), lambda x: regexp_matches(x, '{R.FIX_WORDS}')), 1, 8) AS ls FROM j WHERE c = ''),
m AS (SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS nth FROM l), s AS (SELECT id, nth, nullif(json_extract_string(x, '$.title'), '') AS title, json_extract_string(x, '$.priority') AS p, json_extract_string(x, '$.area') AS a, json_extract_string(x, '$.reason') AS r, json_extract_string(x, '$.suggestedCodexPrompt') AS q FROM f)
SELECT id, nth::INT AS nth, trim(coalesce(title, 'Fix consigliato ' || (nth + 1))) AS title, CASE WHEN p IN ('high', 'medium', 'low') THEN p ELSE {_DEFAULT} END AS priority, CASE WHEN a IN ({", ".join(f"'{x}'" for x in R.AREAS)}) THEN a ELSE 'backend' END AS area,
 coalesce(r, 'Suggerito dal deep audit.') AS reason, trim(coalesce(q, 'Analizza e implementa il fix: ' || coalesce(title, 'fix consigliato'))) AS prompt FROM s
UNION ALL SELECT id, nth::INT, substring(x, 1, 120), {_DEFAULT}, 'backend', 'Estratto da risposta LLM non JSON.', 'Implementa questo fix in modo incrementale: ' || substring(x, 1, 180) FROM m"""
)
def recommended_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return R.fixes(read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"{_AUDIT} AS text"))


@query()
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Names of whole documents, each third with a sentence of places before and a verb behind it."""
    planted = "CASE doc_id % 3 WHEN 0 THEN 'Ieri Anna Bianchi è andata a Roma. ' || coalesce(text, '') || ' Marco deve tornare in Val Rossa' ELSE text END"
    return M.entity_mentions(read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"{planted} AS text"))


_K, _LEAST, _MOST = 3, 0.02, 60
# Points of three users; some of records that have changed or gone.
_POINTS = """id, label % 3 AS user, id AS memory_id, 'm1' AS model, 'r1' AS revision, CASE WHEN id % 50 <> 0 AND (id + label) % 4 = 1 THEN 'old' ELSE 'new' END || id AS content_hash,
CASE WHEN id % 50 <> 0 AND (id + label) % 4 = 1 THEN 'q' ELSE 'p' END || id AS point_id"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).selectExpr("unit", *[x.strip() for x in _POINTS.split(",")])


def _current(points: DataFrame) -> DataFrame:
    """Every eleventh record is gone; of those with an old point, the identity names a newer one."""
    kept = points.where("id % 11 <> 0 OR id % 50 = 0")
    return kept.selectExpr("concat('p', id) AS point_id", "user", "memory_id", "concat('new', id) AS content_hash", "model", "revision")


_ROUNDS = [_K * N.FACTOR ** (r + 1) for r in range(20) if _K * N.FACTOR ** (r + 1) <= _MOST]
_STORE = f"""WITH {VEC}, pts AS (SELECT unit, {_POINTS} FROM vec), st AS (SELECT *, point_id[1] = 'p' AND (id % 11 <> 0 OR id % 50 = 0) AS current FROM pts),
h AS (SELECT q.id, v.id AS other, list_dot_product(q.unit, v.unit) AS score, v.current AND v.user = q.user AS good FROM st q JOIN st v ON q.id <> v.id WHERE q.id % 50 = 0 AND list_dot_product(q.unit, v.unit) >= {_LEAST}),"""


@query(f"{_STORE} r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS nth FROM h WHERE good) SELECT id, other, round(score, 6) AS score, nth::INT AS nth FROM r WHERE nth <= {_K}")
def current_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return N.current_neighbours(points, _current(points), points.where("id % 50 = 0"), _K, _LEAST, _MOST)[0].withColumn("score", F.round("score", 6))


@query(
    f"""{_STORE} r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS nth FROM h), l AS (SELECT unnest({_ROUNDS}) AS wide, generate_subscripts({_ROUNDS}, 1) AS round),
c AS (SELECT q.id, l.round, l.wide, count(r.other) AS fetched, count(r.other) FILTER (r.good) AS kept FROM (SELECT id FROM st WHERE id % 50 = 0) q CROSS JOIN l LEFT JOIN r ON r.id = q.id AND r.nth <= l.wide GROUP BY ALL),
d AS (SELECT id, min(round) AS round, min_by(fetched - kept, round) AS discarded FROM c WHERE kept >= {_K} OR fetched < wide GROUP BY id), g AS (SELECT id, least({_K}, count(*) FILTER (good)) AS hits FROM h GROUP BY id)
SELECT q.id, coalesce(d.round, {len(_ROUNDS) + 1})::INT AS rounds, coalesce(discarded, 0) AS discarded, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) < {_K} THEN 'EXHAUSTED' ELSE 'COMPLETE' END AS status FROM st q LEFT JOIN d USING (id) LEFT JOIN g USING (id) WHERE q.id % 50 = 0"""
)
def neighbour_fetches(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return N.current_neighbours(points, _current(points), points.where("id % 50 = 0"), _K, _LEAST, _MOST)[1]
