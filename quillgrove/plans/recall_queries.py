"""Recall, statistics and selection over memory records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import activation as A
from quillgrove.functions import text as X
from quillgrove.operators import dynamics as D
from quillgrove.operators import recall as R
from quillgrove.plans.registry import Registry
from quillgrove.sources.adapters import LINK, MEM, links, memories

query = Registry()
QUESTION = "the estion over inthe ation"
TOKENS = X.query_tokens(QUESTION)


def _share(column: str) -> str:
    low = f"trim(regexp_replace(lower({column}), '\\s+', ' ', 'g'))"
    return "(" + " + ".join(f"contains({low}, '{t}')::INT" for t in TOKENS) + f") / {float(len(TOKENS))}::DOUBLE"


SCORED = f"scored AS (SELECT *, {_share('text')} AS text_match, 0.6::DOUBLE * ({_share('text')}) + 0.4::DOUBLE * activation AS base FROM mem)"


@query(f"WITH {MEM}, {SCORED} SELECT id, round(text_match, 6) AS text_match, round(base, 6) AS score FROM scored ORDER BY round(base, 6) DESC, id LIMIT 10")
def recall_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = R.score_texts(memories(spark, sf), QUESTION).withColumn("score", F.round("base", 6))
    return R.top(scored, 10, F.desc("score"), F.col("id")).select("id", F.round("text_match", 6).alias("text_match"), "score")


@query(
    f"WITH {MEM}, {SCORED} SELECT id, type, round(base, 6) AS score FROM scored WHERE NOT coalesce(activation < 0.4, false) AND type IN ('semantic', 'episodic') "
    "AND NOT list_has_any(tags, ['fr']) AND memory_depth <> 'temporary' ORDER BY round(base, 6) DESC, id LIMIT 20"
)
def recall_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.recall_filter(memories(spark, sf), 0.4, ["semantic", "episodic"], ["fr"], ["temporary"])
    scored = R.score_texts(rows, QUESTION).withColumn("score", F.round("base", 6))
    return R.top(scored, 20, F.desc("score"), F.col("id")).select("id", "type", "score")


@query(
    f"""WITH {MEM}, {LINK}, {SCORED}, both_ways AS (SELECT source_id AS id, target_id AS other, weight FROM link UNION ALL SELECT target_id, source_id, weight FROM link),
b AS (SELECT e.id, sum(e.weight * 0.25 * s.base) AS s FROM both_ways e JOIN scored s ON e.other = s.id WHERE s.text_match > 0 GROUP BY e.id)
SELECT id, round(base, 6) AS base, round(least(0.25, coalesce(s, 0)), 6) AS boost, round(base + least(0.25, coalesce(s, 0)), 6) AS score
FROM scored LEFT JOIN b USING (id) ORDER BY round(base + least(0.25, coalesce(s, 0)), 6) DESC, id LIMIT 50"""
)
def recall_link_boost(spark: SparkSession, sf: str) -> DataFrame:
    boosted = R.link_boost(R.score_texts(memories(spark, sf), QUESTION), links(spark, sf))
    out = boosted.select("id", F.round("base", 6).alias("base"), F.round("boost", 6).alias("boost"), F.round(F.col("base") + F.col("boost"), 6).alias("score"))
    return R.top(out, 50, F.desc("score"), F.col("id"))


@query(
    f"""WITH {MEM}, {LINK}, {SCORED}, both_ways AS (SELECT source_id AS id, target_id AS other, weight, link_type FROM link UNION ALL SELECT target_id, source_id, weight, link_type FROM link),
k AS (SELECT e.id, e.link_type, sum(s.base * e.weight * 0.2 * CASE e.link_type WHEN 'semantic' THEN 1.0 WHEN 'continuation' THEN 0.25 ELSE 0.1 END) AS g
 FROM both_ways e JOIN scored s ON e.other = s.id WHERE s.text_match > 0 GROUP BY 1, 2),
b AS (SELECT id, sum(least(g, CASE link_type WHEN 'semantic' THEN 0.2 WHEN 'dialogue_sequence' THEN 0.03 ELSE 0.05 END)) AS boost FROM k GROUP BY id)
SELECT id, round(boost, 6) AS boost FROM scored LEFT JOIN b USING (id) WHERE boost > 0"""
)
def recall_typed_boost(spark: SparkSession, sf: str) -> DataFrame:
    boosted = R.typed_link_boost(R.score_texts(memories(spark, sf), QUESTION), links(spark, sf))
    return boosted.where("boost > 0").select("id", F.round("boost", 6).alias("boost"))


_RESULTS = (
    "res AS (SELECT id, sha256(text) AS content_hash, round(activation * 0.9, 6) AS score, CASE id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'warm' ELSE 'deep' END AS tier FROM mem "
    "UNION ALL SELECT id, sha256(text), round(activation * 0.5, 6), 'deep' FROM mem WHERE id % 5 = 0)"
)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).withColumn("content_hash", F.sha2("text", 256))
    tier = F.when(F.col("id") % 3 == 0, "core").when(F.col("id") % 3 == 1, "warm").otherwise("deep")
    first = rows.select("id", "content_hash", F.round(F.col("activation") * 0.9, 6).alias("score"), tier.alias("tier"))
    return first.union(rows.where("id % 5 = 0").select("id", "content_hash", F.round(F.col("activation") * 0.5, 6), F.lit("deep")))


_ORDER = "score DESC, CASE tier WHEN 'core' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, id"


@query(
    f"""WITH {MEM}, {_RESULTS}, a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) AS n FROM res),
b AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {_ORDER}) AS m FROM a WHERE n = 1)
SELECT id, tier, score FROM b WHERE m = 1 ORDER BY {_ORDER} LIMIT 40"""
)
def router_merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.route(_results(spark, sf), 40)[0].select("id", "tier", "score")


@query(
    f"""WITH {MEM}, {_RESULTS}, a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) AS n FROM res),
b AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {_ORDER}) AS m, first_value(id) OVER (PARTITION BY content_hash ORDER BY {_ORDER}) AS kept_id FROM a WHERE n = 1)
SELECT id, kept_id, 'duplicate_content' AS reason FROM b WHERE m > 1 UNION ALL SELECT id, id, 'duplicate_id' FROM a WHERE n > 1"""
)
def router_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    return R.route(_results(spark, sf), 40)[1]


@query(f"WITH {MEM} SELECT id FROM mem WHERE id NOT IN (SELECT unnest([id + 1, id + 2]) FROM mem WHERE memory_kind = 'super_memory')")
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    covers = rows.where("memory_kind = 'super_memory'").select(F.array(F.col("id") + 1, F.col("id") + 2).alias("source_ids"))
    return R.uncovered(rows.select("id"), covers)


@query(
    f"""WITH {MEM}, ranked AS (SELECT id, text, row_number() OVER (ORDER BY activation DESC, id) AS rank FROM mem),
r AS (SELECT id, rank, sum(length(text)) OVER (ORDER BY rank) AS running FROM ranked WHERE rank <= 6) SELECT id, rank::BIGINT AS rank, running::BIGINT AS running FROM r WHERE running <= 4000"""
)
def bounded_context(spark: SparkSession, sf: str) -> DataFrame:
    head = R.top(memories(spark, sf), 6, F.desc("activation"), F.col("id"))
    from pyspark.sql import Window

    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("activation"), "id")).cast("long"))
    return R.packed_context(ranked).select("id", "rank", "running")


@query(
    f"""WITH {MEM}, t AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_]+'), lambda x: length(x) > 3)) AS w FROM mem)
SELECT id, (list_contains(w, 'estion')::INT + list_contains(w, 'over')::INT + list_contains(w, 'inthe')::INT + list_contains(w, 'ation')::INT)::BIGINT AS score FROM t
WHERE list_contains(w, 'estion')::INT + list_contains(w, 'over')::INT + list_contains(w, 'inthe')::INT + list_contains(w, 'ation')::INT > 0"""
)
def fulltext_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.index_search(memories(spark, sf), "estion over inthe ation")


@query(f"WITH {MEM} SELECT id, activation FROM mem WHERE activation >= 0.2 ORDER BY activation DESC, id LIMIT 25")
def most_active(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(memories(spark, sf).where("activation >= 0.2"), 25, F.desc("activation"), F.col("id")).select("id", "activation")


@query(
    f"""WITH {MEM}, {LINK}, a AS (SELECT id, activation FROM mem WHERE activation >= 0.3 ORDER BY activation DESC, id LIMIT 10)
SELECT id, activation, count(l.target_id)::BIGINT AS strong_links FROM a LEFT JOIN link l ON l.source_id = a.id AND l.weight > 0.3 GROUP BY 1, 2"""
)
def active_context(spark: SparkSession, sf: str) -> DataFrame:
    head = R.top(memories(spark, sf).where(A.level(F.col("activation")).isin("short", "medium")), 10, F.desc("activation"), F.col("id")).select("id", "activation")
    strong = links(spark, sf).where("weight > 0.3").select(F.col("source_id").alias("id"), "target_id")
    return head.join(strong, "id", "left").groupBy("id", "activation").agg(F.count("target_id").alias("strong_links"))


@query(
    f"""WITH {MEM}, {SCORED} (SELECT 'active' AS section, id FROM mem WHERE activation >= 0.7 ORDER BY activation DESC, id LIMIT 5) UNION ALL
(SELECT 'structural', id FROM mem WHERE type = 'structural' ORDER BY activation DESC, id LIMIT 5) UNION ALL (SELECT 'relevant', id FROM scored ORDER BY round(base, 6) DESC, id LIMIT 3)""".replace(
        ") (SELECT 'active'", ") SELECT * FROM (SELECT 'active'", 1
    )
)
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    active = R.top(rows.where("activation >= 0.7"), 5, F.desc("activation"), F.col("id")).select(F.lit("active").alias("section"), "id")
    fixed = R.top(rows.where("type = 'structural'"), 5, F.desc("activation"), F.col("id")).select(F.lit("structural"), "id")
    relevant = R.top(R.score_texts(rows, QUESTION), 3, F.desc(F.round("base", 6)), F.col("id")).select(F.lit("relevant"), "id")
    return active.union(fixed).union(relevant)


@query(
    f"""WITH {MEM} SELECT type, count(*)::BIGINT AS n, round(avg(activation), 6) AS mean, count(*) FILTER (activation < 0.05 AND idle_days > 60)::BIGINT AS cold,
count(*) FILTER (activation >= 0.7)::BIGINT AS short, count(*) FILTER (activation >= 0.3 AND activation < 0.7)::BIGINT AS medium FROM mem GROUP BY type"""
)
def memory_stats(spark: SparkSession, sf: str) -> DataFrame:
    act = F.col("activation")
    return memories(spark, sf).groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.avg(act), 6).alias("mean"), F.count_if(A.is_cold(act, F.col("idle_days"))).alias("cold"),
        F.count_if(A.level(act) == "short").alias("short"), F.count_if(A.level(act) == "medium").alias("medium"),
    )


@query(f"WITH {MEM} SELECT CASE WHEN activation >= 0.7 THEN 'short' WHEN activation >= 0.3 THEN 'medium' ELSE 'long' END AS level, count(*)::BIGINT AS n FROM mem GROUP BY 1")
def orbit_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).groupBy(A.level(F.col("activation")).alias("level")).agg(F.count("*").alias("n"))


_METRICS = """m AS (SELECT count(*)::BIGINT AS n, avg(activation) AS mean, var_pop(activation) AS variance, count(*) FILTER (activation < 0.05)::BIGINT AS cold,
count(*) FILTER (activation < 0.2)::BIGINT AS bin0, count(*) FILTER (activation >= 0.2 AND activation < 0.4)::BIGINT AS bin1, count(*) FILTER (activation >= 0.4 AND activation < 0.6)::BIGINT AS bin2,
count(*) FILTER (activation >= 0.6 AND activation < 0.8)::BIGINT AS bin3, count(*) FILTER (activation >= 0.8)::BIGINT AS bin4 FROM mem)"""


def _metrics(rows: DataFrame) -> DataFrame:
    bins = [F.count_if((F.col("activation") >= k / 5 if k else F.lit(True)) & (F.col("activation") < (k + 1) / 5 if k < 4 else F.lit(True))).alias(f"bin{k}") for k in range(5)]
    return rows.agg(
        F.count("*").alias("n"), F.avg("activation").alias("mean"), F.var_pop("activation").alias("variance"), F.count_if(F.col("activation") < 0.05).alias("cold"), *bins
    )


@query(f"WITH {MEM}, {_METRICS} SELECT n, round(mean, 6) AS mean, round(variance, 6) AS variance, cold, bin0, bin1, bin2, bin3, bin4 FROM m")
def hard_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(memories(spark, sf)).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


@query(
    f"""WITH {MEM}, {_METRICS} SELECT name FROM (SELECT unnest([CASE WHEN variance > 0.08 THEN 'high_variance' END, CASE WHEN cold > 0.5 * n THEN 'mostly_cold' END,
CASE WHEN mean < 0.1 THEN 'low_mean' END, CASE WHEN mean > 0.4 THEN 'high_mean' END]) AS name FROM m) WHERE name IS NOT NULL"""
)
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds are arguments of the alert rules; these fit the adapter's uniform scores."""
    rules = [(F.col("variance") > 0.08, "high_variance"), (F.col("cold") > 0.5 * F.col("n"), "mostly_cold"), (F.col("mean") < 0.1, "low_mean"), (F.col("mean") > 0.4, "high_mean")]
    return _metrics(memories(spark, sf)).select(F.explode(F.array(*[F.when(c, n) for c, n in rules])).alias("name")).where("name IS NOT NULL")


@query(f"WITH {MEM} SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(tags) AS tag FROM mem) GROUP BY tag ORDER BY n DESC, tag LIMIT 12")
def top_tags(spark: SparkSession, sf: str) -> DataFrame:
    counted = memories(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return R.top(counted, 12, F.desc("n"), F.col("tag"))


@query(
    f"""WITH {MEM}, {LINK} SELECT link_type, count(*)::BIGINT AS n, round(avg(weight), 6) AS mean_weight FROM link GROUP BY link_type"""
)
def link_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).groupBy("link_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query(
    f"""WITH {MEM}, d AS (SELECT user_id, count(*)::BIGINT AS n, round(sum(activation), 6) AS total FROM mem GROUP BY user_id)
SELECT user_id, n, total, coalesce(n - lag(n) OVER (ORDER BY user_id), 0)::BIGINT AS n_change, coalesce(round(total - lag(total) OVER (ORDER BY user_id), 6), 0) AS total_change FROM d"""
)
def trends(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between consecutive snapshots (here: users, numbered without gaps): each joins the one before it."""
    snapshots = memories(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("activation"), 6).alias("total"))
    before = snapshots.select((F.col("user_id") + 1).alias("user_id"), F.col("n").alias("n_before"), F.col("total").alias("total_before"))
    change = lambda c: F.coalesce(F.col(c) - F.col(f"{c}_before"), F.lit(0))
    return snapshots.join(before, "user_id", "left").select("user_id", "n", "total", change("n").alias("n_change"), F.round(change("total"), 6).alias("total_change"))


_TIER = """CASE WHEN memory_kind = 'super_memory' AND storage_tier = 'core' THEN 'core|super_core' WHEN memory_kind = 'super_memory' THEN '|super_not_core'
WHEN storage_tier IN ('warm', 'deep') THEN storage_tier || '|explicit' WHEN storage_tier IS NOT NULL THEN '|unknown_tier' WHEN memory_depth IN ('deep', 'historical') THEN 'deep|legacy_depth' ELSE 'warm|legacy_default' END"""


@query(f"WITH {MEM}, t AS (SELECT id, {_TIER} AS x FROM mem) SELECT id, nullif(split_part(x, '|', 1), '') AS tier, split_part(x, '|', 2) AS reason FROM t")
def tier_classification(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tier(F.col("memory_kind"), F.col("storage_tier"), F.col("memory_depth"))
    return memories(spark, sf).select("id", t.alias("t")).select("id", "t.tier", "t.reason")


_SELECT = """own AS (SELECT id, sha256(text) AS content_hash, CASE WHEN memory_kind = 'super_memory' THEN 'ALREADY_SUPER' WHEN processing_state = 'consolidated' THEN 'ALREADY_CONSOLIDATED'
 WHEN processing_state <> 'raw' THEN 'IN_PROCESS' WHEN storage_tier = 'deep' THEN 'DEEP_TIER' WHEN trim(text) = '' THEN 'EMPTY_TEXT' END AS o FROM mem),
dup AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS n FROM own),
ruled AS (SELECT id, CASE WHEN o IS NOT NULL THEN o WHEN n > 1 THEN 'DUPLICATE_CONTENT' END AS r FROM dup),
nth AS (SELECT id, r, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY r IS NULL ORDER BY id) END AS k FROM ruled),
sel AS (SELECT id, CASE WHEN r IS NOT NULL THEN 'excluded' WHEN k > 200 THEN 'deferred' ELSE 'eligible' END AS decision,
 CASE WHEN r IS NOT NULL THEN r WHEN k > 200 THEN 'LIMIT_EXPLICITLY_APPLIED' ELSE 'ELIGIBLE' END AS reason FROM nth)"""


@query(f"WITH {MEM}, {_SELECT} SELECT id, decision, reason FROM sel")
def candidate_selection(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_candidates(memories(spark, sf), 200).select("id", "decision", "reason")


@query(f"WITH {MEM}, {_SELECT} SELECT decision, reason, count(*)::BIGINT AS n FROM sel GROUP BY 1, 2")
def selection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_candidates(memories(spark, sf), 200).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MEM}, inc AS (SELECT id, CASE WHEN id % 4 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM mem WHERE id % 2 = 0), old AS (SELECT id, sha256(text) AS h FROM mem WHERE id % 3 <> 0)
SELECT inc.id, CASE WHEN old.h IS NULL THEN 'created' WHEN old.h = inc.h THEN 'replayed' ELSE 'conflict' END AS outcome FROM inc LEFT JOIN old USING (id)"""
)
def upsert_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    old = rows.where("id % 3 <> 0").select("id", F.sha2("text", 256).alias("h"))
    new = rows.where("id % 2 = 0").select("id", F.sha2(F.when(F.col("id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return D.upsert(old, new, "id", "h").select("id", "outcome")


@query(
    f"""WITH {MEM} SELECT id, round(0.7 * ({_share('text')}) + 0.3 * activation, 6) AS score,
round(least(1.0, (0.7 * ({_share('text')}) + 0.3 * activation) * CASE WHEN type = 'structural' THEN 1.5 ELSE 1 END), 6) AS typed FROM mem"""
)
def retrieval_bias(spark: SparkSession, sf: str) -> DataFrame:
    scored = R.score_texts(memories(spark, sf), QUESTION)
    score = 0.7 * F.col("text_match") + 0.3 * F.col("activation")
    typed = F.least(F.lit(1.0), score * F.when(F.col("type") == "structural", 1.5).otherwise(1.0))
    return scored.select("id", F.round(score, 6).alias("score"), F.round(typed, 6).alias("typed"))
