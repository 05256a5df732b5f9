"""Updates of activation, energy and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import activation as A
from quillgrove.operators import dynamics as D
from quillgrove.plans.registry import Registry
from quillgrove.sources.adapters import LINK, MEM, links, memories

query = Registry()


def _level(x: str) -> str:
    return f"CASE WHEN {x} >= 0.7 THEN 'short' WHEN {x} >= 0.3 THEN 'medium' ELSE 'long' END"


@query(
    f"""WITH {MEM}, d AS (SELECT id, CASE WHEN type <> 'structural' AND idle_days >= 0.1 THEN activation * exp(-0.05 * idle_days) ELSE activation END AS a FROM mem)
SELECT id, round(a, 6) AS activation, {_level("a")} AS level FROM d"""
)
def decay_exponential(spark: SparkSession, sf: str) -> DataFrame:
    return D.decay(memories(spark, sf)).select("id", F.round("activation", 6).alias("activation"), "level")


@query(f"WITH {MEM} SELECT id, round(greatest(0.01, activation * (1 - 0.01 * idle_days)), 6) AS activation FROM mem")
def decay_linear(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("id", F.round(A.decayed_linear(F.col("activation"), F.lit(0.01), F.col("idle_days")), 6).alias("activation"))


@query(
    f"""WITH {MEM} SELECT id, {_level("activation")} AS engine_level, CASE WHEN activation < 0.15 THEN 'long' WHEN activation < 0.3 THEN 'medium' ELSE 'short' END AS node_level,
CASE WHEN memory_depth IN ('core', 'deep', 'normal', 'temporary') THEN memory_depth WHEN activation >= 0.95 THEN 'core' WHEN activation >= 0.75 THEN 'deep' WHEN activation >= 0.3 THEN 'normal' ELSE 'temporary' END AS depth FROM mem"""
)
def bands(spark: SparkSession, sf: str) -> DataFrame:
    act = F.col("activation")
    return memories(spark, sf).select("id", A.level(act).alias("engine_level"), A.node_level(act).alias("node_level"), A.depth(act, F.col("memory_depth")).alias("depth"))


@query(
    f"""WITH {MEM}, c AS (SELECT id, greatest(0.0, least(1.0, activation * 0.97 + (access_count / 7.0::DOUBLE) * 0.15 - idle_days * 0.005)) AS a, activation FROM mem)
SELECT id, round(a, 6) AS activation, round(activation * 0.95 + a * 0.05, 6) AS state FROM c"""
)
def activation_update(spark: SparkSession, sf: str) -> DataFrame:
    act = F.col("activation")
    new = A.computed(act, F.col("access_count") / 7.0, F.col("idle_days"))
    return memories(spark, sf).select("id", F.round(new, 6).alias("activation"), F.round(A.inertia(act, new), 6).alias("state"))


@query(
    f"""WITH {MEM} SELECT id, round(least(1.0, greatest(0.01, activation * (1 - 0.01 * idle_days)) + 0.15 * (1 + ln(access_count * 0.3 + 1))), 6) AS activation FROM mem"""
)
def access_update(spark: SparkSession, sf: str) -> DataFrame:
    new = A.accessed(F.col("activation"), F.lit(0.01), F.col("idle_days"), F.col("access_count") * 0.3)
    return memories(spark, sf).select("id", F.round(new, 6).alias("activation"))


@query(
    f"""WITH {MEM}, a AS (SELECT id, greatest(-1.0, least(1.0, (activation - 0.5) * 0.98 + (id % 3 - 1) * 0.5)) AS f FROM mem)
SELECT id, round(f, 6) AS affective, round(0.1 * CASE WHEN f > 0 THEN 1 + f * 0.3 ELSE 1 END, 6) AS reinforcement FROM a"""
)
def dual_activation(spark: SparkSession, sf: str) -> DataFrame:
    f = A.affect(F.col("activation") - 0.5, (F.col("id") % 3 - 1).cast("double"))
    return memories(spark, sf).select("id", F.round(f, 6).alias("affective"), F.round(A.modulated(F.lit(0.1), f), 6).alias("reinforcement"))


@query(
    f"""WITH {MEM} SELECT id, round(CASE type WHEN 'structural' THEN 0.95 WHEN 'semantic' THEN 0.7 WHEN 'working' THEN 0.9 ELSE 0.4 + 0.5 * activation END, 6) AS activation FROM mem"""
)
def initial_activation(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("id", F.round(A.initial(F.col("type"), F.col("activation")), 6).alias("activation"))


@query(f"WITH {MEM} SELECT id, activation, {_level('activation')} AS level, true AS cold FROM mem WHERE activation < 0.05 AND idle_days > 30")
def cold_records(spark: SparkSession, sf: str) -> DataFrame:
    cold = memories(spark, sf).where(A.is_cold(F.col("activation"), F.col("idle_days"), 30))
    return cold.select("id", "activation", A.level(F.col("activation")).alias("level"), F.lit(True).alias("cold"))


@query(f"WITH {MEM}, t AS (SELECT sum(activation) AS s FROM mem) SELECT id, round(activation * CASE WHEN s > 100 THEN 100 / s ELSE 1 END, 6) AS activation FROM mem, t")
def energy_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return D.normalise_energy(memories(spark, sf), 100.0).select("id", F.round("activation", 6).alias("activation"))


@query(
    f"""WITH {MEM}, t AS (SELECT greatest(0.8, least(1.2, 100.0::DOUBLE / sum(activation))) AS f, sum(activation) AS s FROM mem),
n AS (SELECT id, type, activation, greatest(0.01, least(1.0, activation * f)) AS a, s FROM mem, t),
c AS (SELECT id, CASE WHEN type <> 'structural' AND abs(s - 100) > 0.1 AND abs(a - activation) > 0.01 THEN a ELSE activation END AS a,
 type <> 'structural' AND abs(s - 100) > 0.1 AND abs(a - activation) > 0.01 AS changed FROM n)
SELECT id, round(a, 6) AS activation, changed, {_level("a")} AS level FROM c"""
)
def energy_stabilise(spark: SparkSession, sf: str) -> DataFrame:
    return D.stabilise(memories(spark, sf)).select("id", F.round("after", 6).alias("activation"), "changed", "level")


@query(
    f"""WITH {MEM}, w AS (SELECT id, CASE WHEN id % 200 = 0 THEN activation ELSE activation / 1000 END AS activation FROM mem), t AS (SELECT sum(activation) AS s, count(*) AS n FROM w),
h AS (SELECT sum(-(activation / s) * log2(activation / s)) / log2(max(n)) AS h FROM w, t WHERE activation > 0)
SELECT id, round(CASE WHEN h >= 0.9 THEN activation WHEN activation > 0.5 THEN activation * (1 - (1 - h) * 0.1) WHEN activation < 0.2 THEN activation * (1 + (1 - h) * 0.1) ELSE activation END, 6) AS activation,
round(h, 6) AS entropy FROM w, h"""
)
def entropy_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).select("id", F.when(F.col("id") % 200 == 0, F.col("activation")).otherwise(F.col("activation") / 1000).alias("activation"))
    return D.rebalance(rows, 0.9).select("id", F.round("after", 6).alias("activation"), F.round("entropy", 6).alias("entropy"))


@query(f"WITH {MEM} SELECT id, round(least(1.0, activation + 50.0::DOUBLE / (SELECT count(*) FROM mem)), 6) AS activation FROM mem")
def energy_inject(spark: SparkSession, sf: str) -> DataFrame:
    return D.inject(memories(spark, sf), 50.0).select("id", F.round("activation", 6).alias("activation"))


@query(
    f"""WITH {MEM}, {LINK}, n AS (SELECT source_id, target_id, weight, activation, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS k FROM link JOIN mem ON id = source_id WHERE weight >= 0.05)
SELECT source_id, target_id, weight FROM n WHERE k <= 3 + floor(activation * 10)"""
)
def link_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    return D.maintain_links(links(spark, sf), memories(spark, sf)).select("source_id", "target_id", "weight")


@query(
    f"""WITH {LINK}, w AS (SELECT source_id, target_id, greatest(0.0, least(1.0, weight * 0.95 + reinforced * 0.01)) AS weight, reinforced + (reinforced > 0)::INT AS n FROM link)
SELECT source_id, target_id, round(weight, 6) AS weight, n::BIGINT AS n FROM w WHERE weight >= 0.05"""
)
def link_reweigh(spark: SparkSession, sf: str) -> DataFrame:
    new = A.link_weight(F.col("weight"), F.col("reinforced") * 0.01)
    rows = links(spark, sf).select("source_id", "target_id", new.alias("weight"), (F.col("reinforced") + F.when(F.col("reinforced") > 0, 1).otherwise(0)).alias("n"))
    return rows.where("weight >= 0.05").withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {LINK}, every AS (SELECT * FROM link UNION ALL SELECT target_id, source_id, weight / 2, link_type, reinforced FROM link WHERE source_id % 3 = 0)
SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, round(avg(weight), 6) AS weight, sum(reinforced)::BIGINT AS reinforced FROM every GROUP BY 1, 2"""
)
def link_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = links(spark, sf)
    back = rows.where("source_id % 3 = 0").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), (F.col("weight") / 2).alias("weight"), "link_type", "reinforced")
    return D.merge_links(rows.unionByName(back)).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {MEM}, {LINK}, g AS (SELECT l.target_id AS id, sum(least(s.activation * l.weight * 0.4, t.activation * 0.3)) AS g FROM link l JOIN mem s ON s.id = l.source_id JOIN mem t ON t.id = l.target_id GROUP BY 1)
SELECT id, round(least(1.0, activation + coalesce(g, 0)), 6) AS activation FROM mem LEFT JOIN g USING (id)"""
)
def propagate_activation(spark: SparkSession, sf: str) -> DataFrame:
    return D.propagate(memories(spark, sf), links(spark, sf)).select("id", F.round("after", 6).alias("activation"))


@query(
    f"""WITH {MEM}, {LINK}, p AS (SELECT id FROM mem ORDER BY activation DESC, id LIMIT 10), e AS (SELECT source_id AS a, target_id AS b, weight FROM link UNION ALL SELECT target_id, source_id, weight FROM link),
n AS (SELECT b AS id, max(weight) AS w FROM e WHERE a IN (SELECT id FROM p) GROUP BY b)
SELECT m.id, round(least(1.0, activation + CASE WHEN p.id IS NOT NULL THEN 0.03 ELSE coalesce(w * 0.01, 0) END), 6) AS activation, access_count + (p.id IS NOT NULL)::INT AS access_count
FROM mem m LEFT JOIN p ON p.id = m.id LEFT JOIN n ON n.id = m.id"""
)
def reinforce_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    picked = rows.orderBy(F.desc("activation"), "id").limit(10)
    return D.reinforce(rows, picked, links(spark, sf)).select("id", F.round("after", 6).alias("activation"), F.col("access_after").alias("access_count"))


@query(
    f"""WITH {LINK}, o AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS w FROM link GROUP BY 1, 2),
n AS (SELECT DISTINCT a, a + 7 AS b FROM o WHERE a % 5 = 0 UNION SELECT a, b FROM o WHERE a % 5 = 1)
SELECT a, b, round(CASE WHEN w IS NULL THEN 0.5 WHEN n.a IS NOT NULL THEN least(1.0, w + 0.1) ELSE w END, 6) AS weight FROM o FULL JOIN n USING (a, b)"""
)
def link_bump(spark: SparkSession, sf: str) -> DataFrame:
    rows = links(spark, sf)
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    pairs = rows.select(low.alias("source_id"), high.alias("target_id"))
    new = pairs.where("source_id % 5 = 0").select("source_id", (F.col("source_id") + 7).alias("target_id"))
    return D.bump_links(rows, new.union(pairs.where("source_id % 5 = 1"))).withColumn("weight", F.round("weight", 6))
