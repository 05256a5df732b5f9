"""Identities, discovery, maturity, claims, projections, imports and the activation field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.operators import field as E
from quillgrove.operators import identities as I
from quillgrove.operators import projections as P
from quillgrove.operators import vector as V
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table
from quillgrove.sources.adapters import EVT, LINK, MEM, TRN, VEC, links, memories, memory_events, turns, vectors

query = Registry()

IDENT = """ident AS (SELECT 'p' || id AS point_id, id AS memory_id, sha256(text) AS content_hash, CASE WHEN id % 23 = 0 THEN 'm0' ELSE 'm1' END AS model, 'r1' AS revision FROM mem WHERE id % 7 <> 0)"""
HITS = """hits AS (SELECT 'p' || id AS query_point, CASE WHEN id % 19 = 0 THEN 'x' || id ELSE 'p' || (id + id % 3) END AS point_id, CASE WHEN id % 38 = 0 THEN -1 ELSE id + id % 3 END AS memory_id,
 sha256(text) AS content_hash, 'm1' AS model, 'r1' AS revision, activation AS score FROM mem)"""


def _identities(spark: SparkSession, sf: str) -> DataFrame:
    model = F.when(F.col("id") % 23 == 0, "m0").otherwise("m1")
    rows = memories(spark, sf).where("id % 7 <> 0")
    return rows.select(F.concat(F.lit("p"), "id").alias("point_id"), F.col("id").alias("memory_id"), F.sha2("text", 256).alias("content_hash"), model.alias("model"), F.lit("r1").alias("revision"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    other = F.col("id") + F.col("id") % 3
    point = F.when(F.col("id") % 19 == 0, F.concat(F.lit("x"), "id")).otherwise(F.concat(F.lit("p"), other))
    return memories(spark, sf).select(
        F.concat(F.lit("p"), "id").alias("query_point"), point.alias("point_id"), F.when(F.col("id") % 38 == 0, -1).otherwise(other).alias("memory_id"),
        F.sha2("text", 256).alias("content_hash"), F.lit("m1").alias("model"), F.lit("r1").alias("revision"), F.col("activation").alias("score"),
    )


@query(
    f"""WITH {MEM}, {IDENT}, {HITS} SELECT h.query_point, h.point_id, CASE WHEN i.point_id IS NULL THEN CASE WHEN h.memory_id IN (SELECT memory_id FROM ident) THEN 'STALE_IDENTITY' ELSE 'FOREIGN_POINT' END
WHEN h.model <> i.model OR h.revision <> i.revision THEN 'INCOMPATIBLE_PROVENANCE' WHEN h.memory_id <> i.memory_id OR h.content_hash <> i.content_hash THEN 'STALE_IDENTITY'
WHEN h.point_id = h.query_point THEN 'SELF' WHEN h.score < 0.2 THEN 'BELOW_THRESHOLD' ELSE 'KEPT' END AS kind FROM hits h LEFT JOIN ident i USING (point_id)"""
)
def identity_hits(spark: SparkSession, sf: str) -> DataFrame:
    return I.classify_hits(_hits(spark, sf), _identities(spark, sf), 0.2).select("query_point", "point_id", "kind")


@query(
    f"""WITH {MEM}, {IDENT} SELECT count(*) AS n, count(*) = count(DISTINCT point_id) AS unique_points, count(*) = count(DISTINCT memory_id) AS unique_records, count(DISTINCT model || '|' || revision) <= 1 AS one_model,
sum(('0x' || substr(sha256(concat_ws('|', point_id, memory_id::VARCHAR, content_hash, model, revision)), 1, 12))::BIGINT)::BIGINT AS fingerprint FROM ident"""
)
def identity_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return I.identity_snapshot(_identities(spark, sf))


@query(f"WITH {MEM}, {IDENT} SELECT content_hash, count(*) AS n FROM ident GROUP BY content_hash HAVING count(*) > 1")
def repeated_identities(spark: SparkSession, sf: str) -> DataFrame:
    return I.repeated_identities(_identities(spark, sf), "content_hash")


_STATUS = "CASE WHEN id % 31 = 0 THEN 'FAILED' WHEN id % 13 = 0 THEN 'TRUNCATED' WHEN id % 7 = 0 THEN 'UNCERTIFIED' ELSE 'COMPLETE' END"


@query(
    f"""WITH {MEM}, s AS (SELECT id // 10 AS component, {_STATUS} AS status FROM mem), r AS (SELECT component, max(CASE status WHEN 'COMPLETE' THEN 0 WHEN 'UNCERTIFIED' THEN 1 WHEN 'TRUNCATED' THEN 2 ELSE 3 END) AS r FROM s GROUP BY component)
SELECT component, ['COMPLETE', 'UNCERTIFIED', 'TRUNCATED', 'FAILED'][r + 1] AS status FROM r"""
)
def component_completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).select(F.expr("id div 10").alias("component"), F.expr(_STATUS).alias("status"))
    return I.worst_status(rows, "component")


@query(
    f"""WITH {MEM}, s AS (SELECT id // 10 AS component, bool_and({_STATUS} = 'COMPLETE') AS ok FROM mem GROUP BY 1)
SELECT count(*) AS components, count(*) FILTER (ok) AS authorized, CASE WHEN count(*) = count(*) FILTER (ok) THEN 'COMPLETE' WHEN count(*) FILTER (ok) > 0 THEN 'PARTIAL_DEFERRED' ELSE 'DEFERRED' END AS status FROM s"""
)
def discovery_graph_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).select(F.expr("id div 10").alias("component"), F.expr(_STATUS).alias("status"))
    return I.graph_status(I.worst_status(rows, "component").select((F.col("status") == "COMPLETE").alias("authorized")))


_CENTROID = f"""{VEC}, dims AS (SELECT id, label, unnest(unit) AS x, unnest(range(1, len(unit) + 1)) AS p FROM vec), cen AS (SELECT label, p, avg(x) AS c FROM dims GROUP BY 1, 2),
nrm AS (SELECT label, sqrt(sum(c * c)) AS n FROM cen GROUP BY label), cs AS (SELECT d.label, d.id, greatest(-1, least(1, sum(x * c) / any_value(n))) AS cosine FROM dims d JOIN cen USING (label, p) JOIN nrm USING (label) GROUP BY 1, 2)"""


@query(f"WITH {_CENTROID} SELECT label, round(avg(cosine), 6) AS density, label % 6 AS age FROM cs GROUP BY label HAVING avg(cosine) > 0.1 AND label % 6 >= 3")
def stable_clusters(spark: SparkSession, sf: str) -> DataFrame:
    dense = V.density(vectors(spark, sf), "label").select("label", F.col("mean").alias("density"), (F.col("label") % 6).alias("age"))
    return dense.where((F.col("density") > 0.1) & (F.col("age") >= 3)).withColumn("density", F.round("density", 6))


@query(
    f"WITH {_CENTROID.replace('id, label, list_transform(v', 'id, label // 2 AS label, list_transform(v')} SELECT label, count(*) AS n, CASE WHEN count(*) > 100 THEN 'TOO_LARGE' ELSE 'MERGED' END AS status, CASE WHEN count(*) <= 100 THEN round(avg(cosine), 6) END AS density FROM cs GROUP BY label"
)
def merged_clusters(spark: SparkSession, sf: str) -> DataFrame:
    merged = vectors(spark, sf).withColumn("label", F.expr("label div 2").cast("int")).dropDuplicates(["label", "id"])
    n = F.col("n")
    return V.density(merged, "label").select("label", "n", F.when(n > 100, "TOO_LARGE").otherwise("MERGED").alias("status"), F.when(n <= 100, F.round("mean", 6)).alias("density"))


@query(
    f"""WITH {VEC}, c AS (SELECT label AS id, count(*) AS n, max(len(unit)) AS d FROM vec GROUP BY label)
SELECT id, CASE WHEN id % 5 = 4 THEN 'INVALID_CLUSTER' WHEN id % 5 = 3 OR n < 3 THEN 'CLUSTER_SIZE_INCOHERENT' WHEN id % 7 = 2 THEN 'INVALID_EMBEDDING_EVIDENCE' WHEN id % 2 = 0 THEN 'EXPLICITLY_APPROVED' ELSE 'EXPLICIT_APPROVAL_REQUIRED' END AS reason,
NOT (id % 5 >= 3 OR n < 3 OR id % 7 = 2) AND id % 2 = 0 AS mature FROM c"""
)
def maturity_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by label; every fifth repeats a member, another counts wrongly, some lack a cosine."""
    rows = vectors(spark, sf)
    centroid = V.centroids(rows, "label").withColumnRenamed("label", "id")
    grouped = rows.groupBy(F.col("label").alias("id")).agg(F.collect_list("id").alias("m"), F.max(F.size("unit")).alias("dimension")).join(centroid, "id")
    low = F.when(F.col("id") % 7 != 2, 0.0)
    members = F.when(F.col("id") % 5 == 4, F.concat("m", F.slice("m", 1, 1))).otherwise(F.col("m"))
    clusters = grouped.select("id", members.alias("members"), (F.size(members) + (F.col("id") % 5 == 3).cast("int")).alias("density_members"), "dimension", "centroid", low.alias("low"), F.lit(0.5).alias("high"))
    approved = grouped.where("id % 2 = 0").select("id")
    return I.maturity(clusters, approved, 3).select("id", "reason", "mature")


@query(
    f"""WITH {MEM} SELECT id // 4 AS cluster, count(*) AS n, bool_and(processing_state = 'raw' AND id % 12 <> 5) AS claimed FROM mem GROUP BY 1"""
)
def source_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by fours; every twelfth has other content than was expected."""
    expected = F.when(F.col("id") % 12 == 5, "changed").otherwise(F.sha2("text", 256))
    rows = memories(spark, sf).select("id", F.expr("id div 4").alias("cluster"), F.col("processing_state").alias("state"), F.lit(None).cast("string").alias("attempt"), F.sha2("text", 256).alias("content_hash"), expected.alias("expected_hash"))
    return I.claims(rows)


@query(f"WITH {MEM} SELECT id // 4 AS cluster, sha256((min(id) % 3)::VARCHAR || '|' || string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) || '|v1') AS key FROM mem GROUP BY 1")
def cluster_keys(spark: SparkSession, sf: str) -> DataFrame:
    grouped = memories(spark, sf).groupBy(F.expr("id div 4").alias("cluster")).agg((F.min("id") % 3).alias("owner"), F.collect_list("id").alias("members"))
    return grouped.select("cluster", I.repeat_key("owner", "members", "v1").alias("key"))


@query(
    f"WITH {MEM}, p AS (SELECT id // 500 AS batch, id FROM mem WHERE processing_state = 'candidate') SELECT batch, count(*) AS n, sha256(batch::VARCHAR || '|' || string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) || '|plan') AS plan_id FROM p GROUP BY batch"
)
def consolidation_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A plan's id is the hash of its canonical content, so the same selection is the same plan; batches are of bounded size."""
    rows = memories(spark, sf).where("processing_state = 'candidate'").groupBy(F.expr("id div 500").alias("batch")).agg(F.collect_list("id").alias("members"))
    return rows.select("batch", F.size("members").cast("long").alias("n"), I.repeat_key("batch", "members", "plan").alias("plan_id"))


@query(f"WITH {MEM}, {IDENT} SELECT memory_id FROM ident WHERE memory_id % 4 <> 0 OR memory_id % 20 = 0")
def embedding_misses(spark: SparkSession, sf: str) -> DataFrame:
    now = _identities(spark, sf)
    cached = now.where("memory_id % 4 = 0").withColumn("content_hash", F.when(F.col("memory_id") % 20 == 0, "old").otherwise(F.col("content_hash")))
    return I.cache_misses(now.select("memory_id", "content_hash", "model"), cached.select("memory_id", "content_hash", "model")).select("memory_id")


@query(f"WITH {VEC} SELECT id, sha256(list_aggregate(list_transform(unit, lambda x: round(x * 1e6)::BIGINT::VARCHAR), 'string_agg', ',')) AS fingerprint FROM vec")
def vector_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", I.vector_hash("unit").alias("fingerprint"))


@query(
    f"""WITH {VEC} SELECT a.id, round(list_sum(list_transform(range(1, 65), lambda i: a.unit[i] * b.unit[i])) / sqrt(list_sum(list_transform(a.unit, lambda x: x * x)) * list_sum(list_transform(b.unit, lambda x: x * x))), 6) AS cosine
FROM vec a JOIN vec b ON b.id = a.id + 1"""
)
def refiner_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The product of both square sums under one root, as the refiner has it."""
    rows = vectors(spark, sf)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("unit").alias("next"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return rows.join(after, "id").select("id", F.round(V.dot("unit", "next") / F.sqrt(square("unit") * square("next")), 6).alias("cosine"))


@query(f"WITH {MEM} SELECT id, CASE WHEN id % 8 = 0 THEN 'synthesizing' ELSE processing_state END AS processing_state, id % 8 = 0 AS virtual FROM mem")
def processing_overlay(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    states = rows.where("id % 8 = 0").select("id", F.lit("synthesizing").alias("state"))
    return I.overlaid(rows, states).select("id", "processing_state", "virtual")


# ---------------------------------------------------------------- projections

_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g'))"


@query(
    f"""WITH {MEM}, s AS (SELECT *, coalesce(nullif({_FLAT}, ''), id::VARCHAR) AS s FROM mem) SELECT id::VARCHAR AS id, CASE WHEN length(s) > 80 THEN substring(s, 1, 77) || '...' ELSE s END AS label,
CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'unknown' END AS role, CASE id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' ELSE 'unknown' END AS orbit,
CASE WHEN memory_depth IN ('temporary', 'normal', 'deep') THEN memory_depth ELSE 'unknown' END AS depth, activation FROM s"""
)
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 3 == 1, "assistant").otherwise("tool")
    orbit = F.when(F.col("id") % 4 == 0, "short").when(F.col("id") % 4 == 1, "medium").when(F.col("id") % 4 == 2, "long")
    return P.graph_nodes(memories(spark, sf).withColumns({"role": role, "orbit": orbit}))


@query(f"WITH {LINK} SELECT source_id || '_' || target_id AS id, source_id AS source, target_id AS target, CASE WHEN reinforced <> 0 THEN weight END AS weight, link_type AS type FROM link")
def graph_links(spark: SparkSession, sf: str) -> DataFrame:
    written = F.when(F.col("reinforced") != 0, F.col("weight").cast("string")).otherwise("heavy")
    return P.graph_links(links(spark, sf).withColumns({"id": F.lit(None).cast("string"), "weight": written}))


@query(f"WITH {MEM} SELECT id, user_id, type, text, activation, memory_depth AS orbit, id * 60000 AS timestamp, true AS cold FROM mem WHERE activation < 0.2")
def compressed_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).where("activation < 0.2").withColumns({"orbit": F.col("memory_depth"), "timestamp": F.col("id") * 60000})
    return P.compressed(rows)


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE '' END AS title, '' AS description, text AS content, 'u' || doc_id AS url, NULL::VARCHAR AS image, NULL::BIGINT AS published_at,
CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'unknown' END AS source, 'world' AS scope FROM documents"""
)
def normalised_articles(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("title"), none.alias("description"), F.col("text").alias("content"), F.concat(F.lit("u"), "doc_id").alias("url"),
        none.alias("image"), F.lit(None).cast("long").alias("published_at"), F.when(F.col("doc_id") % 3 != 0, F.struct(F.col("source").alias("name"))).alias("source"),
    )
    return P.articles(rows, "world")


@query(
    """WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Utente' WHEN 1 THEN ' BOT ' WHEN 2 THEN NULL ELSE 'tool' END AS role, role AS tag FROM conversations)
SELECT conv_id, turn, coalesce(CASE WHEN trim(lower(role)) IN ('user', 'utente', 'human') THEN 'user' WHEN trim(lower(role)) IN ('assistant', 'assistente', 'ai', 'bot') THEN 'assistant' WHEN trim(lower(role)) = 'system' THEN 'system' END,
CASE WHEN tag IN ('user', 'assistant', 'system') THEN tag END, 'unknown') AS role FROM r"""
)
def normalised_roles(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 5
    rows = turns(spark, sf).withColumns({"tags": F.array(F.lit("misc"), "role"), "role": F.when(k == 0, "Utente").when(k == 1, " BOT ").when(k == 2, F.lit(None)).otherwise("tool"), "sender": F.lit(None).cast("string")})
    return rows.select("conv_id", "turn", P.role(["role", "sender"], "tags").alias("role"))


@query(
    f"WITH {MEM} SELECT id, CASE WHEN id % 3 = 0 THEN 'UNSUPPORTED_SOURCE_CONTRACT' WHEN id % 5 = 0 THEN 'MISSING' WHEN id % 7 = 0 OR id % 11 = 0 THEN 'INVALID' ELSE 'VALID' END AS status FROM mem"
)
def recorded_times(spark: SparkSession, sf: str) -> DataFrame:
    contract = F.when(F.col("id") % 3 == 0, "nested").otherwise("flat")
    stamp = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "soon").when(F.col("id") % 11 == 0, "-5").otherwise((F.col("id") * 60000).cast("string"))
    return memories(spark, sf).select("id", P.recorded_status(contract, stamp).alias("status"))


@query(
    f"""WITH {TRN}, a AS (SELECT conv_id, turn, floor((1000000000 - ts_ms) / 3600000)::BIGINT AS age_hours FROM trn)
SELECT conv_id, turn, age_hours, CASE WHEN age_hours < 24 THEN 'today' WHEN age_hours < 168 THEN 'week' ELSE 'older' END AS age_band, age_hours < 72 AS fresh FROM a"""
)
def turns_with_age(spark: SparkSession, sf: str) -> DataFrame:
    return P.age_status(turns(spark, sf), 1_000_000_000).select("conv_id", "turn", F.col("age_hours").cast("long").alias("age_hours"), "age_band", "fresh")


@query(
    f"WITH {TRN} SELECT count(*) AS n, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (coalesce(trim(text), '') = '') AS n_empty, min(ts_ms) AS oldest, max(ts_ms) AS newest FROM trn"
)
def import_report(spark: SparkSession, sf: str) -> DataFrame:
    return P.import_report(turns(spark, sf))


_FILES = "f AS (SELECT lang AS root, source AS folder, n_chars AS size, doc_id % 7 AS depth, n_chars > 4000 AS skipped, lang || '/' || source || '/' || CASE doc_id % 5 WHEN 0 THEN 'server/api' WHEN 1 THEN 'test/unit' WHEN 2 THEN 'node_modules/x' ELSE 'data' END || '/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PNG' ELSE '.py' END AS path FROM documents)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    part = "CASE doc_id % 5 WHEN 0 THEN 'server/api' WHEN 1 THEN 'test/unit' WHEN 2 THEN 'node_modules/x' ELSE 'data' END"
    return read_table(spark, sf, "documents").selectExpr(
        "lang AS root", "source AS folder", "n_chars AS size", "doc_id % 7 AS depth", "n_chars > 4000 AS skipped", f"lang || '/' || source || '/' || {part} || '/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PNG' ELSE '.py' END AS path"
    )


@query(f"WITH {_FILES} SELECT root, count(*) AS n_files, sum(size)::BIGINT AS n_bytes, max(size) AS largest, count(DISTINCT folder) AS n_folders, max(depth) AS max_depth, count(*) FILTER (skipped) AS n_skipped FROM f GROUP BY root")
def scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.scan_stats(_files(spark, sf))


@query(f"WITH {_FILES} SELECT d.domain, count(*) AS hits FROM f, (VALUES ('backend', 'server|api'), ('testing', 'test'), ('dependencies', 'node_modules')) d(domain, pattern) WHERE regexp_matches(path, pattern) GROUP BY d.domain")
def domain_hits(spark: SparkSession, sf: str) -> DataFrame:
    return P.domain_hits(_files(spark, sf), {"backend": "server|api", "testing": "test", "dependencies": "node_modules"})


@query(
    f"""WITH {TRN}, c AS (SELECT conv_id, turn, text, unnest(range(0, greatest(1, ceil(length(text) / 300.0))::BIGINT)) AS chunk FROM trn), n AS (SELECT *, substr(sha256(conv_id || '|' || turn || '|' || chunk), 1, 24) AS id FROM c),
b AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY turn, chunk) AS before FROM n)
SELECT id, before, CASE WHEN before IS NULL THEN NULL WHEN chunk > 0 THEN 'continuation' ELSE 'dialogue_sequence' END AS link_type, chunk::INT AS chunk, substring(text, chunk * 300 + 1, 300) AS text FROM b"""
)
def import_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return P.import_rows(turns(spark, sf), 300)


@query(
    "SELECT source, lang, doc_id, nth FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id)::INT AS nth FROM documents) WHERE nth <= 3"
)
def brief_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of every section of a brief."""
    rows = read_table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    return P.newest_first_k(rows, ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")], 3).drop("n_chars")


@query(
    f"""WITH {TRN}, n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY ts_ms DESC, turn DESC) AS k FROM trn)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC)::INT AS place FROM n WHERE k <= 5"""
)
def diary_context(spark: SparkSession, sf: str) -> DataFrame:
    """The newest five entries of each diary, oldest first."""
    newest = P.newest_first_k(turns(spark, sf), ["conv_id"], [F.desc("ts_ms"), F.desc("turn")], 5)
    return newest.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("nth"))).alias("place"))


# ---------------------------------------------------------------- the field


@query(
    f"WITH {MEM} SELECT user_id, round(sum(activation), 6) AS total, round(40.0::DOUBLE - sum(activation), 6) AS deficit, count(*) FILTER (type = 'structural') AS n_structural, count(*) FILTER (type = 'episodic') AS n_episodic FROM mem GROUP BY user_id"
)
def energy_state(spark: SparkSession, sf: str) -> DataFrame:
    out = E.energy_state(memories(spark, sf), 40.0)
    return out.withColumns({c: F.round(c, 6) for c in ("total", "deficit")})


@query(f"WITH {MEM} SELECT user_id, round(stddev_pop(activation), 6) AS temperature, CASE WHEN stddev_pop(activation) > 0.29 THEN 'rebalance' ELSE 'none' END AS action FROM mem GROUP BY user_id")
def field_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return E.temperature(memories(spark, sf), 0.29).withColumn("temperature", F.round("temperature", 6))


@query(f"WITH {MEM} SELECT user_id, round(avg(activation), 6) AS mean, CASE WHEN avg(activation) < 0.5 THEN round(0.98::DOUBLE * 0.4, 6) ELSE 0.98::DOUBLE END AS gamma FROM mem GROUP BY user_id")
def frozen_decay(spark: SparkSession, sf: str) -> DataFrame:
    return E.frozen_decay(memories(spark, sf), 0.98, 0.5, 0.4).withColumns({"mean": F.round("mean", 6), "gamma": F.round("gamma", 6)})


@query(f"WITH {EVT}, v AS (SELECT memory_id, var_pop(echo_score) AS v FROM evt GROUP BY memory_id) SELECT memory_id, round(v, 6) AS variance, CASE WHEN v > 0.1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM v")
def restless_records(spark: SparkSession, sf: str) -> DataFrame:
    return E.reinforcement_multiplier(memory_events(spark, sf)).withColumn("variance", F.round("variance", 6))


@query(
    f"""WITH {MEM}, {LINK}, p AS (SELECT least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, max(1.0::DOUBLE - abs(a.activation - b.activation)) AS s FROM mem a JOIN mem b ON b.id IN (a.id + 1, a.id + 7) WHERE a.id % 20 = 0 GROUP BY 1, 2),
k AS (SELECT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, max(weight) AS w FROM link GROUP BY 1, 2)
SELECT lo, hi, round(CASE WHEN w IS NOT NULL THEN least(1.0, w + 0.05) ELSE s * 0.8 END, 6) AS weight, w IS NULL AS created FROM p LEFT JOIN k USING (lo, hi) WHERE w IS NOT NULL OR s > 0.6"""
)
def context_reinforcement(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).select("id", "activation")
    asked = rows.where("id % 20 = 0").select("id", "activation", F.explode(F.array(F.col("id") + 1, F.col("id") + 7)).alias("other"))
    pairs = asked.join(rows.select(F.col("id").alias("other"), F.col("activation").alias("theirs")), "other")
    pairs = pairs.select("id", "other", (1.0 - F.abs(F.col("activation") - F.col("theirs"))).alias("similarity"))
    return E.reinforce_context(pairs, links(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {MEM} SELECT type || ':' || tags[1] AS pattern, count(*) AS n, min(id) AS first_id, max(id * 60000) AS last_seen FROM mem GROUP BY 1")
def pattern_registry(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).select("id", F.concat_ws(":", "type", F.get("tags", F.lit(0))).alias("pattern"), (F.col("id") * 60000).alias("ts"))
    return E.pattern_registry(rows)


_SHARES = "c AS (SELECT user_id, event_type AS label, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS m FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS n, sum(m) AS m FROM c GROUP BY 1), s AS (SELECT c.user_id, label, c.n / t.n AS mean, coalesce(c.m / nullif(t.m, 0), 0) AS short FROM c JOIN t USING (user_id))"


@query(
    f"""WITH {_SHARES}, d AS (SELECT user_id, label, round(short - mean, 6) AS drift FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(drift) DESC, label) AS k FROM d WHERE abs(drift) >= 0.06)
SELECT user_id, label, drift, CASE WHEN drift > 0.02 THEN 'up' WHEN drift < -0.02 THEN 'down' ELSE 'equal' END AS arrow FROM r WHERE k <= 3"""
)
def top_drift(spark: SparkSession, sf: str) -> DataFrame:
    counts = read_table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= "2024-01-20").alias("m"))
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    shares = counts.join(totals, "user_id").select("user_id", "label", (F.col("n") / F.col("tn")).alias("mean"), F.try_divide("m", "tm").alias("short"))
    return E.top_drift(shares)


@query(
    f"""WITH {EVT}, c AS (SELECT event_id, greatest(0.0, least(1.0, (greatest(0.0, least(1.0, echo_score)) - 0.1) / 0.9)) AS t, greatest(0.0, least(1.0, echo_score)) AS r FROM evt)
SELECT event_id, round(t, 10) AS trust, round(0.2 * (1 - t) + r * t, 10) AS blended, round(CASE WHEN event_id % 2 = 0 THEN 0.2 * 0.65 + r * 0.35 ELSE 0.2 * 0.25 + r * 0.75 END, 10) AS carried FROM c"""
)
def trusted_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = E.clamp(F.col("echo_score"))
    t = E.trust(F.col("echo_score"))
    return memory_events(spark, sf).select(
        "event_id", F.round(t, 10).alias("trust"), F.round(E.blend(F.lit(0.2), score, t), 10).alias("blended"), F.round(E.carried(F.lit(0.2), score, F.col("event_id") % 2 == 0), 10).alias("carried")
    )


@query(
    """WITH c AS (SELECT user_id, event_type AS k, count(*) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, k) AS n FROM c)
SELECT user_id, max(k) FILTER (n = 1) AS top_key, max(k) FILTER (n = 2) AS second_key, max(v) AS max_score FROM r GROUP BY user_id"""
)
def score_maps(spark: SparkSession, sf: str) -> DataFrame:
    counts = read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("scores"))
    return maps.select("user_id", *E.top_keys("scores"))
