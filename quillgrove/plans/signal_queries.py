"""Concept scores, related records, groups, labels, validation and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.operators import signals as S
from quillgrove.operators import vector as V
from quillgrove.plans.registry import Registry
from quillgrove.plans.vector_queries import PAIRS
from quillgrove.session import read_table
from quillgrove.sources.adapters import LINK, MEM, VEC, links, memories, vectors

query = Registry()
CONCEPTS = ["the", "ation", "en", "src0"]


def _concept_text() -> str:
    return "(' ' || trim(regexp_replace(lower(text), '[^a-zà-ÿ0-9]+', ' ', 'g')) || ' ')"


@query(
    f"""WITH {MEM}, c AS (SELECT id, {_concept_text()} AS x, lower(text) AS low, tags FROM mem), m AS (SELECT id, x, tags, {' + '.join(f"contains(x, ' {c} ')::INT" for c in CONCEPTS)} AS k, len(string_split(trim(x), ' ')) AS w,
len(list_intersect(tags, ['the', 'ation', 'en', 'src0'])) / 4.0::DOUBLE AS t, contains(x, 'nst')::INT * 0.08::DOUBLE AS p FROM c)
SELECT id, round(greatest(0.0, least(1.0, k / 4.0::DOUBLE * 0.35 + least(0.25, k / greatest(8, w)::DOUBLE * 4) + least(1.0, t) * 0.2 - least(0.35, p))), 5) AS echo FROM m"""
)
def concept_echo(spark: SparkSession, sf: str) -> DataFrame:
    return S.concept_echo(memories(spark, sf), "a question none of the texts repeats", CONCEPTS, ["nst"]).select("id", F.round("echo", 5).alias("echo"))


@query(
    """WITH a AS (SELECT doc_id AS id, split_part(text, '.', 1) AS title, text AS abstract, CASE WHEN doc_id % 13 <> 0 THEN 1990 + doc_id % 40 END AS year FROM documents)
SELECT id, coalesce(year, 0) AS year FROM (SELECT * FROM a WHERE (title ILIKE '%the%' OR abstract ILIKE '%the%') AND (title ILIKE '%ation%' OR abstract ILIKE '%ation%') AND (year IS NULL OR year >= 2005) ORDER BY year DESC NULLS LAST, id LIMIT 30)"""
)
def article_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.when(F.col("doc_id") % 13 != 0, F.col("doc_id") % 40 + 1990).alias("year")
    )
    return S.search_articles(rows, ["the", "ation"], 2005, 30).select("id", F.coalesce("year", F.lit(0)).alias("year"))


@query(
    f"""WITH {MEM}, t AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_]+'), lambda x: length(x) > 3)) AS w FROM mem), e AS (SELECT id, len(w) AS n, unnest(w) AS token FROM t),
s AS (SELECT x.id AS new_id, y.id, x.n, y.n AS m, count(*) AS k FROM e x JOIN e y USING (token) WHERE x.id % 50 = 0 AND x.id <> y.id GROUP BY ALL),
r AS (SELECT new_id, id, round(k / (n + m - k), 6) AS score FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, id) AS nth FROM r WHERE score >= 0.1) SELECT new_id, id, score FROM o WHERE nth <= 3"""
)
def related_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    return S.related(rows.where("id % 50 = 0"), rows, 0.1, 3)


@query(
    f"""WITH {MEM}, s AS (SELECT id, id % 97 AS ts, type = 'working' OR memory_depth = 'temporary' AS temporary, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS tokens,
['entity_' || id % 151] AS entities, ['entity_' || id % 151, 'group_' || id % 40, 'team_' || id % 60] AS tags FROM mem),
k AS (SELECT id, 'token' AS kind, unnest(list_distinct(tokens)) AS key FROM s UNION ALL SELECT id, 'entity', unnest(entities) FROM s UNION ALL SELECT id, 'tag', unnest(tags) FROM s),
p AS (SELECT x.id AS new_id, y.id, count(*) FILTER (x.kind = 'token') AS t, count(*) FILTER (x.kind = 'entity') AS e, count(*) FILTER (x.kind = 'tag') AS g FROM k x JOIN k y ON x.kind = y.kind AND x.key = y.key WHERE x.id % 50 = 0 AND x.id <> y.id GROUP BY 1, 2),
j AS (SELECT new_id, p.id, e, g, b.ts, a.temporary OR b.temporary AS temporary, t / greatest(1, len(list_distinct(a.tokens)) + len(list_distinct(b.tokens)) - t) AS alike, greatest(len(a.tokens), len(b.tokens)) AS n FROM p JOIN s a ON a.id = new_id JOIN s b ON b.id = p.id),
o AS (SELECT new_id, id, ts, round(CASE WHEN e > 0 THEN 3 ELSE 0 END + CASE WHEN g >= 2 THEN 2 ELSE 0 END + alike, 6) AS score FROM j WHERE (e > 0 OR g >= 2 OR alike >= CASE WHEN n >= 12 THEN 0.18 ELSE 0.25 END) AND (e > 0 OR NOT temporary))
SELECT new_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, ts DESC, id) AS nth FROM o) WHERE nth <= 3"""
)
def related_by_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Records of entities, groups and teams by id: the three most related to each fiftieth."""
    name = lambda kind, n: F.concat(F.lit(f"{kind}_"), (F.col("id") % n).cast("string"))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))
    temporary = (F.col("type") == "working") | (F.col("memory_depth") == "temporary")
    rows = memories(spark, sf).select(
        "id", (F.col("id") % 97).alias("ts"), temporary.alias("temporary"), tokens.alias("tokens"), F.array(name("entity", 151)).alias("entities"), F.array(name("entity", 151), name("group", 40), name("team", 60)).alias("tags")
    )
    return S.related_by_signals(rows.where("id % 50 = 0"), rows)


@query(
    f"""WITH {VEC}, {PAIRS.replace('>= 0.4', '>= 0.3')}, d AS (SELECT id, id % 40 AS day FROM vec), g AS (SELECT a, count(*) + 1 AS n, min(db.day) AS lo, max(db.day) AS hi, any_value(da.day) AS day FROM pairs JOIN d db ON db.id = b JOIN d da ON da.id = a GROUP BY a)
SELECT a, n::BIGINT AS n, greatest(hi, day) - least(lo, day) AS span FROM g WHERE n >= 3 AND greatest(hi, day) - least(lo, day) < 30"""
)
def repeated_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return S.repeated_groups(rows.select("id", (F.col("id") % 40).alias("day")), V.similar_pairs(rows, 0.3))


@query()
def cluster_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_clusters(vectors(spark, sf), "label", 0.1)


@query(
    """WITH c AS (SELECT user_id, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, name, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, name DESC) AS k FROM s), p AS (SELECT user_id, max(CASE WHEN k = 1 THEN name END) AS n1, max(CASE WHEN k = 1 THEN share END) AS s1, max(CASE WHEN k = 2 THEN name END) AS n2, max(CASE WHEN k = 2 THEN share END) AS s2 FROM o GROUP BY user_id)
SELECT user_id, CASE WHEN s1 < 0.2 THEN 'neutral' WHEN s1 - s2 <= 0.06 THEN n1 || '+' || n2 ELSE n1 END AS mood FROM p"""
)
def dominant_labels(spark: SparkSession, sf: str) -> DataFrame:
    counts = read_table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    total = counts.groupBy("user_id").agg(F.sum("n").alias("total"))
    shares = counts.join(total, "user_id").select("user_id", F.struct(F.round(F.col("n") / F.col("total"), 6).alias("share"), "name").alias("s"))
    return shares.groupBy("user_id").agg(F.collect_list("s").alias("s")).select("user_id", S.dominant(F.col("s")).alias("mood"))


@query(
    f"""WITH {MEM} SELECT id, CASE WHEN activation < 0.1 THEN 'SCORE_TOO_LOW' WHEN storage_tier IS NULL THEN 'NO_TIER' WHEN n_chars > 5000 THEN 'TOO_LONG' END AS reason FROM mem WHERE activation < 0.1 OR storage_tier IS NULL OR n_chars > 5000"""
)
def invalid_results(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("SCORE_TOO_LOW", F.col("activation") < 0.1), ("NO_TIER", F.col("storage_tier").isNull()), ("TOO_LONG", F.col("n_chars") > 5000)]
    return S.validate(memories(spark, sf), rules)[1].select("id", "reason")


@query(
    f"""WITH {MEM}, {LINK}, cold AS (SELECT id FROM mem WHERE activation < 0.3 AND idle_days > 30), e AS (SELECT source_id, target_id, weight, unnest([source_id, target_id]) AS id FROM link),
n AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY id ORDER BY weight DESC, source_id, target_id) AS k FROM e JOIN cold USING (id))
SELECT source_id, target_id FROM link l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k > 1 AND n.source_id = l.source_id AND n.target_id = l.target_id)"""
)
def cold_link_pruning(spark: SparkSession, sf: str) -> DataFrame:
    cold = memories(spark, sf).where("activation < 0.3 AND idle_days > 30")
    return S.prune_cold_links(links(spark, sf), cold, 1).select("source_id", "target_id")


@query()
def cold_link_pruning_in_order(spark: SparkSession, sf: str) -> DataFrame:
    cold = memories(spark, sf).where("activation < 0.3 AND idle_days > 30")
    return S.prune_cold_links_in_order(links(spark, sf), cold, 1).select("source_id", "target_id")


@query(
    f"""WITH {MEM}, c AS (SELECT id, CASE WHEN id % 10 <> 0 THEN id % 8 - 1 END AS hits, CASE WHEN id % 9 = 0 THEN 'old' ELSE 'new' END AS model, CASE WHEN id % 6 = 0 THEN 0 ELSE id % 8 - 1 END AS expected FROM mem),
r AS (SELECT id, CASE WHEN hits IS NULL THEN 'ABSENT' WHEN model <> 'new' THEN 'OTHER_MODEL' WHEN hits < 0 THEN 'NEGATIVE_COUNT' WHEN hits > 5 THEN 'TRUNCATED' WHEN hits <> expected THEN 'COUNT_MISMATCH' ELSE 'OK' END AS reason FROM c)
SELECT id, reason, CASE reason WHEN 'OK' THEN 'VALID' WHEN 'ABSENT' THEN 'ABSENT' ELSE 'INVALID' END AS status FROM r"""
)
def certificates(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.col("id") % 8 - 1
    found = memories(spark, sf).select(
        "id", F.when(F.col("id") % 10 != 0, hits).alias("hits"), F.when(F.col("id") % 9 == 0, "old").otherwise("new").alias("model"), F.when(F.col("id") % 6 == 0, 0).otherwise(hits).alias("expected")
    )
    return S.certificates(found, 5, "new").select("id", "reason", "status")


@query(
    f"""WITH {MEM}, h AS (SELECT id, sha256(id::VARCHAR || '|' || type || '|' || user_id::VARCHAR) AS h FROM mem)
SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h"""
)
def point_identities(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("id", S.point_identity("id", "type", "user_id").alias("point_id"))


@query()
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return S.entities(memories(spark, sf))


@query("SELECT doc_id AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS total FROM documents) WHERE (n - 150 + total) % total < 80")
def maintenance_batch(spark: SparkSession, sf: str) -> DataFrame:
    return S.round_robin(memories(spark, sf).select("id"), 150, 80)[0]
