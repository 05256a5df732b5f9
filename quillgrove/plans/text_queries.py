"""Ranked recall with all terms, document search and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import text as X
from quillgrove.functions import time as T
from quillgrove.operators import manuals as M
from quillgrove.operators import ranking as K
from quillgrove.operators import signals as S
from quillgrove.plans.recall_queries import QUESTION, SCORED
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table
from quillgrove.sources.adapters import LINK, MEM, links, memories

query = Registry()

ALIASES = {"estion": ["the ation", "estion"], "absent": ["nothing"]}
CONCEPTS = K.expanded_concepts(QUESTION, ALIASES)
GENERIC = ["nst", "the th"]
_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
_PADDED = f"(' ' || trim(regexp_replace({_NORMAL}, '[^a-zà-ÿ0-9]+', ' ', 'g')) || ' ')"
_TAGS = "(' ' || trim(regexp_replace(lower(replace(list_aggregate(tags, 'string_agg', ' '), '_', ' ')), '[^a-zà-ÿ0-9]+', ' ', 'g')) || ' ')"


def _count(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, ' {w} ')::INT" for w in words) + ")"


ECHOES = f"""e0 AS (SELECT id, tags, {_NORMAL} AS n, {_PADDED} AS s, {_TAGS} AS t FROM mem),
e1 AS (SELECT id, tags, n, len(string_split(n, ' ')) AS w, {_count('s', CONCEPTS)} AS k, {_count('t', CONCEPTS)} AS kt, ({' + '.join(f"contains(n, '{g}')::INT" for g in GENERIC)}) AS g FROM e0),
echoes AS (SELECT id, CASE WHEN n = '' THEN 0.0 ELSE greatest(0.0, least(1.0, k / {float(len(CONCEPTS))}::DOUBLE * 0.35 + least(0.25, k / greatest(8, w)::DOUBLE * 4)
 + least(1.0, kt / {float(len(CONCEPTS))}::DOUBLE + list_contains(tags, 'en')::INT * 0.08) * 0.2 - least(0.35, g * 0.08))) END AS echo FROM e1)"""


@query(f"WITH {MEM}, {ECHOES} SELECT id, round(echo, 5) AS echo FROM echoes")
def echo_resonance(spark: SparkSession, sf: str) -> DataFrame:
    return K.echo_score(memories(spark, sf), QUESTION, CONCEPTS, GENERIC, hints=["en"]).select("id", F.round("echo", 5).alias("echo"))


@query(
    f"""WITH {MEM}, {LINK}, {SCORED}, {ECHOES}, both_ways AS (SELECT source_id AS id, target_id AS other, weight, link_type FROM link UNION ALL SELECT target_id, source_id, weight, link_type FROM link),
k AS (SELECT e.id, e.link_type, sum(s.base * e.weight * 0.2 * CASE e.link_type WHEN 'semantic' THEN 1.0 WHEN 'continuation' THEN 0.25 ELSE 0.1 END) AS g
 FROM both_ways e JOIN scored s ON e.other = s.id WHERE s.text_match > 0 GROUP BY 1, 2),
b AS (SELECT id, sum(least(g, CASE link_type WHEN 'semantic' THEN 0.2 WHEN 'dialogue_sequence' THEN 0.03 ELSE 0.05 END)) AS boost FROM k GROUP BY id)
SELECT id, round(base, 5) AS base, round(echo, 5) AS echo, round(coalesce(boost, 0), 5) AS boost, round(base * 0.65 + echo * 0.25 + coalesce(boost, 0) * 0.10, 5) AS score FROM scored JOIN echoes USING (id) LEFT JOIN b USING (id)"""
)
def recall_final(spark: SparkSession, sf: str) -> DataFrame:
    out = K.final_scores(memories(spark, sf), links(spark, sf), QUESTION, CONCEPTS, generic=GENERIC, hints=["en"])
    return out.select("id", *(F.round(c, 5).alias(c) for c in ("base", "echo", "boost", "score")))


@query(f"WITH {MEM}, e0 AS (SELECT id, {_PADDED} AS s, {_TAGS} AS t FROM mem), h AS (SELECT id, contains(s, ' ation ') OR contains(t, ' src1 ') AS hit FROM e0) SELECT id FROM h WHERE hit OR NOT (SELECT bool_or(hit) FROM h)")
def warm_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return K.warm_prefilter(memories(spark, sf), ["ation", "src1"]).select("id")


@query("SELECT doc_id AS id FROM documents")
def warm_prefilter_without_match(spark: SparkSession, sf: str) -> DataFrame:
    return K.warm_prefilter(memories(spark, sf), ["no text has this"]).select("id")


@query(f"WITH {MEM} SELECT id FROM mem WHERE type <> 'working' AND NOT (type = 'episodic' AND idle_days > 60) AND NOT (type = 'structural' AND activation < 0.5)")
def typed_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).where("type <> 'working'").withColumns({"age": F.col("idle_days"), "stability": F.col("activation")})
    return K.by_type(rows, max_age=60).select("id")


_RANKED = "ranked AS (SELECT id, id AS position, CASE WHEN id % 17 = 0 THEN 2.0 ELSE activation END AS score FROM mem UNION ALL SELECT id, id + 3, activation FROM mem WHERE id % 4 = 0 UNION ALL SELECT -id - 1, id, 0.5 FROM mem WHERE id % 50 = 0)"


@query(f"WITH {MEM}, {_RANKED}, g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS n FROM ranked WHERE id >= 0 AND score BETWEEN 0 AND 1) SELECT id, position, score FROM (SELECT * FROM g WHERE n = 1 ORDER BY position LIMIT 30)")
def normalised_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    score = F.when(F.col("id") % 17 == 0, 2.0).otherwise(F.col("activation"))
    ranked = rows.select("id", F.col("id").alias("position"), score.alias("score"))
    ranked = ranked.union(rows.where("id % 4 = 0").selectExpr("id", "id + 3", "activation")).union(rows.where("id % 50 = 0").selectExpr("-id - 1", "id", "0.5D"))
    return K.normalised_ranking(ranked, rows, 30)[0]


@query(
    f"""WITH {MEM}, u AS (SELECT id, 0 AS origin, id AS position FROM mem WHERE id % 9 = 0 UNION ALL SELECT id, 1, id * 2 FROM mem WHERE id % 6 = 0 UNION ALL SELECT id, 2, id * 3 FROM mem),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY origin, position) AS k FROM u) SELECT id, origin, position FROM n WHERE k = 1"""
)
def first_seen_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    take = lambda where, position: rows.where(where).selectExpr("id", f"{position} AS position")
    return K.first_seen(take("id % 9 = 0", "id"), take("id % 6 = 0", "id * 2"), take("true", "id * 3"))


@query(
    f"""WITH {MEM}, near AS (SELECT user_id AS request, id, activation AS score FROM mem WHERE id % 10 = user_id AND id % 30 < 8), deep AS (SELECT user_id AS request, id, 0.1::DOUBLE AS score FROM mem WHERE id % 40 > 35),
s AS (SELECT r.request, count(n.id) AS n, max(n.score) AS best FROM (SELECT DISTINCT user_id AS request FROM mem) r LEFT JOIN near n USING (request) GROUP BY 1),
d AS (SELECT request, CASE WHEN n < 3 AND (best IS NULL OR best < 0.5) THEN 'LOW_COUNT+LOW_SCORE' WHEN n < 3 THEN 'LOW_COUNT' WHEN best < 0.5 THEN 'LOW_SCORE' ELSE 'NOT_REQUESTED' END AS deep_reason FROM s)
SELECT request, id, score, deep_reason FROM (SELECT * FROM near UNION ALL SELECT * FROM deep WHERE request IN (SELECT request FROM d WHERE deep_reason <> 'NOT_REQUESTED')) JOIN d USING (request)"""
)
def deep_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    near = rows.where("id % 30 < 8").selectExpr("user_id AS request", "id", "activation AS score")
    deep = rows.where("id % 40 > 35").selectExpr("user_id AS request", "id", "0.1D AS score")
    return K.with_deep_fallback(near, deep, rows.select(F.col("user_id").alias("request")), 3, 0.5).select("request", "id", "score", "deep_reason")


@query(f"WITH {MEM} SELECT id, CASE WHEN id % 13 = 0 THEN CASE WHEN type IN ('episodic', 'semantic', 'structural') THEN type ELSE 'raw' END ELSE memory_kind END AS memory_kind FROM mem WHERE storage_tier = 'warm'")
def tier_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).withColumns({"tier": F.col("storage_tier"), "memory_kind": F.when(F.col("id") % 13 != 0, F.col("memory_kind"))})
    return K.tier_rows(rows, "warm").select("id", "memory_kind")


_OWNED = "(owner IS NULL OR owner = 3) AND (owner2 IS NULL OR owner2 = 3)"


@query(
    f"""WITH {MEM}, o AS (SELECT *, CASE WHEN id % 4 <> 0 THEN user_id END AS owner, CASE WHEN id % 5 <> 0 THEN (id + id % 2 * 0) % 10 END AS owner2, [id + 1, id + CASE WHEN id % 18 = 0 THEN 1 ELSE 2 END] AS source_ids FROM mem)
SELECT id, 'warm' AS tier FROM o WHERE {_OWNED} AND length(text) > 0 AND memory_kind = 'raw' AND storage_tier = 'warm' UNION ALL
SELECT id, 'core' FROM o WHERE {_OWNED} AND length(text) > 0 AND memory_kind = 'super_memory' AND storage_tier = 'core' AND processing_state = 'consolidated' AND source_ids[1] <> source_ids[2]"""
)
def valid_for_tier(spark: SparkSession, sf: str) -> DataFrame:
    sources = F.array(F.col("id") + 1, F.col("id") + F.when(F.col("id") % 18 == 0, 1).otherwise(2))
    rows = memories(spark, sf).withColumns({"owner": F.when(F.col("id") % 4 != 0, F.col("user_id")), "owner2": F.when(F.col("id") % 5 != 0, F.col("user_id")), "source_ids": sources})
    one = lambda tier: rows.where(K.valid_for_tier(tier, F.lit(3), ["owner", "owner2"])).select("id", F.lit(tier).alias("tier"))
    return one("warm").union(one("core"))


@query(f"WITH {MEM} SELECT id, 101 - id % 101 AS rank, activation AS relevance FROM mem WHERE id % 6 = 1")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    ranks = rows.where("id % 6 = 1").selectExpr("id", "101 - id % 101 AS rank", "activation AS relevance")
    return K.reranked(rows.select("id"), ranks)


@query(
    f"""WITH {MEM}, c AS (SELECT id AS kept_id, unnest([id + 1, id + 2]) AS id FROM mem WHERE memory_kind = 'super_memory' AND storage_tier = 'core')
SELECT m.id, min(c.kept_id) AS kept_id FROM mem m JOIN c USING (id) WHERE m.memory_kind <> 'super_memory' GROUP BY m.id"""
)
def covered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Only core summaries cover their sources."""
    rows = memories(spark, sf).withColumns({"tier": F.col("storage_tier"), "source_ids": F.array(F.col("id") + 1, F.col("id") + 2)})
    return K.covered_by_core(rows)


# ---------------------------------------------------------------- documents and requests

_TRIM = r"regexp_replace({}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_PAGED = "d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 40) || '[ page: 2 ]' || text || '[PAGE:3] ' ELSE text END AS text FROM documents)"


@query(
    rf"""WITH {_PAGED}, p AS (SELECT id, text, regexp_split_to_array(text, '(?i)\[\s*PAGE\s*:\s*[0-9]+\s*\]') AS parts FROM d),
q AS (SELECT id, len(parts) > 1 AS marked, CASE WHEN len(parts) > 1 THEN parts ELSE list_transform(range(0, greatest(1, ceil(length(text) / 3500.0))::BIGINT), lambda i: substring(text, i * 3500 + 1, 3500)) END AS parts FROM p),
r AS (SELECT id, marked, unnest(range(1, len(parts) + 1)) AS page, unnest(parts) AS part FROM q) SELECT id, page, {_TRIM.format('part')} AS text FROM r WHERE NOT marked OR {_TRIM.format('part')} <> ''"""
)
def pseudo_pages(spark: SparkSession, sf: str) -> DataFrame:
    text = "CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 40) || '[ page: 2 ]' || text || '[PAGE:3] ' ELSE text END AS text"
    return M.pseudo_pages(read_table(spark, sf, "documents").selectExpr("doc_id AS id", text))


_PHRASES = "['Codice di riferimento GUASTI', 'tabella e appendice', 'display lcd: impostazione LCD', 'comunicazione bms', 'niente']"


@query(
    f"""WITH s AS (SELECT doc_id AS id, lower({_PHRASES}[doc_id % 5 + 1] || ' ' || coalesce(text, '')) AS t FROM documents)
SELECT id, coalesce(list_aggregate(list_filter([{', '.join(f"CASE WHEN contains(t, '{p}') THEN '{n}' END" for n, p in M.SECTIONS.items())}], lambda x: x IS NOT NULL), 'string_agg', ','), '') AS sections FROM s"""
)
def manual_sections(spark: SparkSession, sf: str) -> DataFrame:
    phrases = "array" + _PHRASES.replace("[", "(").replace("]", ")")
    rows = read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"element_at({phrases}, cast(doc_id % 5 + 1 AS int)) || ' ' || coalesce(text, '') AS t")
    return rows.select("id", F.array_join(M.sections(F.col("t")), ",").alias("sections"))


#: Requests put before the turns' texts, which hold invented words only.
REQUESTS = [
    "Errore: 07 sul bms, tensione 230 e 24", "che significa il codice F 31?", "mostra la tabella del manuale", "perché scatta l'allarme warning 12", "ciao notizie sul clima",
    "Cerca news della partita di oggi, quando inizia", "articoli pubmed sulla memoria di lavoro?", "fammi una ricerca scientifica su sonno e umore.", "cerca su pubmed caffeina", "pubmed",
    "Search full history: the two gardens", "cerca in tutta la memoria viaggio a roma", "cerca nello storico completo", "Il 3/4/2021 Anna Maria vide 12 navi. Era una sera molto calda. Fine", "",
]


_REQUEST = f"element_at(array({', '.join(repr(x) if chr(39) not in x else chr(34) + x + chr(34) for x in REQUESTS)}), CAST((conv_id + turn) % {len(REQUESTS)} + 1 AS int)) || ' ' || coalesce(text, '')"


def _request_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_REQUEST} AS q")


REQ = "req AS (SELECT conv_id, turn, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in REQUESTS) + f"][(conv_id + turn) % {len(REQUESTS)} + 1] || ' ' || coalesce(text, '') AS q FROM conversations)"


@query(
    rf"""WITH {REQ}, l AS (SELECT conv_id, turn, lower(trim(q)) AS q FROM req)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(q, '\b(?:errore|codice|code|fault|warning|avviso)\s*[:#-]?\s*0?([0-9]{{1,3}})\b', 1), ''), nullif(regexp_extract(q, '\bf\s*0?([0-9]{{1,3}})\b', 1), ''))::INT AS error_code,
coalesce(list_aggregate((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(list_transform(regexp_extract_all(q, '\b([0-9]{{1,3}})\b', 1), lambda x: x::INT::VARCHAR)) AS x, generate_subscripts(regexp_extract_all(q, '\b([0-9]{{1,3}})\b', 1), 1) AS i) GROUP BY x)), 'string_agg', ','), '') AS numbers,
regexp_matches(q, 'tabella|table|riga|colonna|manuale|pdf') AS wants_table, regexp_matches(q, 'risoluzione|troubleshooting|causa|perché|motivo|guasto') AS wants_troubleshooting, regexp_matches(q, 'warning|avviso|allarme') AS wants_warnings,
coalesce(list_aggregate(list_filter([{', '.join(f"CASE WHEN contains(q, '{t}') THEN '{t}' END" for t in M.TERMS)}], lambda x: x IS NOT NULL), 'string_agg', ','), '') AS terms FROM l"""
)
def query_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _request_rows(spark, sf).select("conv_id", "turn", *M.query_signals(F.col("q")))


_WORDS = r"'[ \t\n\r\f]+'"


@query(
    rf"""WITH s AS (SELECT doc_id AS id, '3/4/2021 Anna Maria. ' || text AS t FROM documents), k AS (SELECT *, list_slice(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: len(string_split(x, ' ')) BETWEEN 4 AND 9), 1, 3) AS p FROM s)
SELECT id, coalesce(list_aggregate(regexp_extract_all(t, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}'), 'string_agg', ','), '') AS dates,
len(regexp_extract_all(t, '\b[A-Z][a-z]+(?:[ \t\n\r\f]+[A-Z][a-z]+)*\b')) AS n_names, len(regexp_extract_all(t, '\b[0-9]+\b')) AS n_numbers, coalesce(list_aggregate(p, 'string_agg', '|'), '') AS key_phrases FROM k"""
)
def text_invariants(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("3/4/2021 Anna Maria. "), "text").alias("t"))
    return rows.select("id", *M.invariants(F.col("t")))


@query(
    rf"""WITH {REQ}, c AS (SELECT conv_id, turn, q, regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?i)(?:ciao|helper)', '', 'g'), '(?i)(?:news|notizie|aggiornami)', '', 'g'), '(?i)(?:ricerca|cerca|trova)', '', 'g'), '(?i)\b(sul|sulla|su|del|della|dei|delle)\b', '', 'g') AS x FROM req)
SELECT conv_id, turn, trim(regexp_replace(x, {_WORDS}, ' ', 'g')) AS query, regexp_matches(q, '(?i)prossima|quando|orario|calendario|partita|match|fixture|schedule|dove vedere|a che ora') AS event FROM c"""
)
def news_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _request_rows(spark, sf).select("conv_id", "turn", M.news_query(F.col("q"), ("helper",)).alias("query"), M.asks_for_event(F.col("q")).alias("event"))


_OPENING = "CASE doc_id % 4 WHEN 0 THEN 'Here is **all**:' || chr(10) || chr(10) WHEN 1 THEN 'ecco qui: ' WHEN 2 THEN 'I identified two.' || chr(10) ELSE '' END || coalesce(text, '') || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end **now** '"


@query(
    rf"""WITH t AS (SELECT doc_id AS id, {_TRIM.format('(' + _OPENING + ')')} AS t FROM documents),
u AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)^i identified[^\n]*?\n+', ''), '(?i)^here (?:is|are)[^\n]*?\n+', ''), '(?i)^ecco[^\n]*?:[ \t\n]*', '') AS t FROM t),
v AS (SELECT id, regexp_replace(regexp_replace(replace(t, '**', ''), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM u) SELECT id, {_TRIM.format('t')} AS answer FROM v"""
)
def cleaned_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"{_OPENING} AS t")
    return rows.select("id", M.cleaned_answer(F.col("t")).alias("answer"))


_TOPICS = ", ".join(f"nullif(regexp_replace(regexp_extract(trim(q), '{p}', 1), '[?.!,;:]+$', ''), '')" for p in M.TOPIC)


@query(f"WITH {REQ}, t AS (SELECT conv_id, turn, q, trim(coalesce({_TOPICS})) AS t FROM req) SELECT conv_id, turn, CASE WHEN (contains(lower(q), 'pubmed') OR contains(lower(q), 'ricerca scientifica')) AND length(t) >= 2 THEN t END AS topic FROM t")
def topic_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _request_rows(spark, sf).select("conv_id", "turn", M.topic_query(F.col("q")).alias("topic"))


@query(
    rf"""WITH {REQ}, r AS (SELECT conv_id, turn, q, trim(regexp_extract(q, '(?is)^\s*(?:{'|'.join(M.FULL_HISTORY)})(?:\s*[:,-]?\s+)(.*)$', 1)) AS r FROM req)
SELECT conv_id, turn, CASE WHEN r <> '' THEN r ELSE q END AS query, CASE WHEN r <> '' THEN 'full-history' ELSE 'default' END AS mode FROM r"""
)
def recall_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _request_rows(spark, sf).select("conv_id", "turn", *M.recall_request(F.col("q")))


@query(
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<div data-n-au="https://real.example/' || page_id || '">' ELSE '' END || coalesce(html, '') AS h, 'https://news.example/rss/articles/' || page_id AS u FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(h, '(?i)data-n-au="(https?://[^"]+)"', 1), ''), replace(u, '/rss/articles/', '/articles/')) AS url FROM p"""
)
def article_urls(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div data-n-au="https://real.example/'), "page_id", F.lit('">'))).otherwise("")
    rows = read_table(spark, sf, "pages").select("page_id", F.concat(mark, F.coalesce("html", F.lit(""))).alias("h"), F.concat(F.lit("https://news.example/rss/articles/"), "page_id").alias("u"))
    return rows.select("page_id", M.article_url(F.col("h"), F.col("u")).alias("url"))


_PATH = "lang || '/' || CASE doc_id % 4 WHEN 0 THEN 'node_modules/a' WHEN 1 THEN 'build' ELSE 'src' END || '/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PNG' ELSE '.py' END"


@query(f"SELECT doc_id AS id, doc_id % 4 < 2 OR doc_id % 3 = 0 AS ignored FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").selectExpr("doc_id AS id", f"{_PATH} AS p")
    return rows.select("id", M.ignored(F.col("p"), ("node_modules", "build"), (".png", ".zip")).alias("ignored"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'os,re.x' WHEN 1 THEN 'json' ELSE '' END AS imports FROM documents")
def source_imports(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, "import os\nfrom re.x import y\nimport os").when(F.col("doc_id") % 3 == 1, "  require json\nx = 1").otherwise("plain")
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(M.imports(head), ",").alias("imports"))


@query(
    """WITH s AS (SELECT doc_id AS id, coalesce(text, '') AS t, source || ' ' || doc_id || '@x' AS u FROM documents)
SELECT id, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(u, '[^A-Za-z0-9_-]', '_', 'g') AS safe_user, CASE WHEN length(t) > 60 THEN substring(t, 1, 57) || '...' ELSE t END AS short FROM s"""
)
def text_names(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs, names of users that are safe in paths, and texts cut with an ellipsis."""
    rows = read_table(spark, sf, "documents").selectExpr("doc_id AS id", "coalesce(text, '') AS t", "source || ' ' || doc_id || '@x' AS u")
    return rows.select("id", X.slug(F.col("t")).alias("slug"), X.safe_user(F.col("u")).alias("safe_user"), X.shortened(F.col("t")).alias("short"))


@query(
    f"""WITH {MEM}, i AS (SELECT id, CASE id % 5 WHEN 0 THEN 'completed_event' WHEN 1 THEN 'current_state' WHEN 2 THEN 'future_intent' WHEN 3 THEN 'past_event' ELSE 'generic' END AS intent, idle_days AS age FROM mem)
SELECT id, CASE WHEN intent = 'completed_event' THEN 'completed' WHEN intent = 'past_event' THEN 'historical' WHEN intent = 'current_state' AND age > 24 THEN 'stale' WHEN intent = 'current_state' THEN 'current'
 WHEN intent = 'future_intent' AND age > 36 THEN 'expired_future' WHEN intent = 'future_intent' THEN 'future_pending' WHEN age > 72 THEN 'stale' ELSE 'recent' END AS validity FROM i"""
)
def validities(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ["completed_event", "current_state", "future_intent", "past_event", "generic"]))
    intent = F.element_at(names, (F.col("id") % 5 + 1).cast("int"))
    return memories(spark, sf).select("id", T.validity(intent, F.col("idle_days")).alias("validity"))


@query()
def repeat_free_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers cut where a block of lines repeats, and their distinct list entries, in batches."""
    rows = memories(spark, sf).select("id", F.concat("text", F.lit("\n- one\n- One\n- two of it\n- two of it")).alias("text"))

    def run(batches):
        for pdf in batches:
            cut = [S.cut_repeats(t or "") for t in pdf["text"]]
            yield pdf.assign(text=cut, n_bullets=[len(S.distinct_bullets(t or "")) for t in pdf["text"]])

    return rows.mapInPandas(run, "id long, text string, n_bullets long")
