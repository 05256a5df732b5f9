"""Vectors, similarity graphs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.operators import pivot_join as P
from quillgrove.operators import vector as V
from quillgrove.operators.complete_link import BLOCK, Budgets
from quillgrove.operators.vector_clusters import clusters_under, cohesion_of, complete_link_of, forest, leader_clusters_of, settled_of
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table
from quillgrove.sources.adapters import VEC, vectors

query = Registry()
THRESHOLD = 0.4
PAIRS = f"pairs AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.unit, y.unit) AS score FROM vec x JOIN vec y ON x.id < y.id WHERE list_dot_product(x.unit, y.unit) >= {THRESHOLD})"


def _question(spark: SparkSession, sf: str) -> list[float]:
    return vectors(spark, sf).where("id = 7").first().unit


@query(f"WITH {VEC} SELECT v.id, round(list_dot_product(v.unit, q.unit), 6) AS score FROM vec v, vec q WHERE q.id = 7 ORDER BY list_dot_product(v.unit, q.unit) DESC, v.id LIMIT 10")
def knn(spark: SparkSession, sf: str) -> DataFrame:
    return V.nearest(vectors(spark, sf), _question(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(
    f"WITH {VEC} SELECT v.id, round(list_dot_product(v.unit, q.unit), 6) AS score FROM vec v, vec q WHERE q.id = 7 AND v.label IN (1, 3, 5) ORDER BY list_dot_product(v.unit, q.unit) DESC, v.id LIMIT 10"
)
def filtered_knn(spark: SparkSession, sf: str) -> DataFrame:
    return V.nearest(vectors(spark, sf).where("label IN (1, 3, 5)"), _question(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {VEC}, n AS (SELECT q.id, v.id AS other, list_dot_product(v.unit, q.unit) AS score FROM vec q JOIN vec v ON q.id <> v.id WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS nth FROM n) SELECT id, other, round(score, 6) AS score FROM r WHERE nth <= 5"""
)
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return V.neighbours(rows, rows.where("id % 50 = 0"), 5).select("id", "other", F.round("score", 6).alias("score"))


@query(f"WITH {VEC}, {PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs")
def threshold_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.pivot_pairs(vectors(spark, sf), THRESHOLD).withColumn("score", F.round("score", 6))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair as both of its ends see it, one of them a little lower."""
    pairs = P.pivot_pairs(vectors(spark, sf), THRESHOLD)
    return pairs.selectExpr("a AS id", "b AS other", "score").union(pairs.selectExpr("b", "a", "score - 0.01"))


@query(f"WITH {VEC}, {PAIRS} SELECT a, b, round(score, 6) AS score, 2::BIGINT AS observed FROM pairs")
def candidate_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.candidate_edges(_observed(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {VEC}, {PAIRS}, n AS (SELECT count(*)::BIGINT AS n FROM pairs), b AS (SELECT unnest([50, 100000000])::BIGINT AS budget)
SELECT budget, CASE WHEN n > budget THEN 0 ELSE n END AS edges, n AS duplicates, CASE WHEN n > budget THEN 'DEFERRED_EDGE_BUDGET' ELSE 'COMPLETE' END AS status FROM b, n"""
)
def edge_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return P.edge_budgets(P.candidate_edges(_observed(spark, sf)), [50, 100_000_000])


@query(
    f"""WITH {VEC}, {PAIRS}, e AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) SELECT id, count(*)::BIGINT AS hits,
CASE WHEN count(*) > 1 THEN 'INCOMPLETE_TRUNCATED' ELSE 'COMPLETE' END AS status FROM e GROUP BY id"""
)
def discovery_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return V.completeness_of(V.link_counts(vectors(spark, sf), THRESHOLD), 1)


@query(
    f"""WITH RECURSIVE {VEC}, {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT id, id AS root FROM vec UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id, min(root) AS component FROM r GROUP BY id"""
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return V.components(rows, forest(rows, THRESHOLD))  # links enough to connect what all pairs connect


_CENT = """dims AS (SELECT id, label, unnest(unit) AS x, generate_subscripts(unit, 1) AS p FROM vec), cent AS (SELECT label, p, avg(x) AS c FROM dims GROUP BY 1, 2),
cn AS (SELECT label, list(c ORDER BY p) AS c FROM cent GROUP BY label)"""


@query(
    f"""WITH {VEC}, {_CENT}, s AS (SELECT v.label, list_cosine_similarity(v.unit, cn.c) AS c FROM vec v JOIN cn USING (label))
SELECT label, count(*)::BIGINT AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high FROM s GROUP BY label"""
)
def centroid_density(spark: SparkSession, sf: str) -> DataFrame:
    d = V.density(vectors(spark, sf), "label")
    return d.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"WITH {VEC}, {_CENT} SELECT x.label, round(1 - avg(list_cosine_similarity(x.c, y.c)), 6) AS isolation FROM cn x JOIN cn y ON x.label <> y.label GROUP BY x.label")
def isolation(spark: SparkSession, sf: str) -> DataFrame:
    return V.isolation(vectors(spark, sf), "label").withColumn("isolation", F.round("isolation", 6))


@query(
    f"""WITH {VEC}, {PAIRS} SELECT x.label, round(sum(0.1 * (p.a % 10 + 1) / 10 * (p.b % 10 + 1) / 10 / greatest(0.1, 1 - score)), 6) AS potential
FROM pairs p JOIN vec x ON x.id = p.a JOIN vec y ON y.id = p.b WHERE x.label = y.label GROUP BY x.label"""
)
def cluster_potential(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    pairs = V.similar_pairs(rows, THRESHOLD)
    x, y = rows.select(F.col("id").alias("a"), "label"), rows.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
    same = pairs.join(x, "a").join(y, "b").where("label = label_b")
    mass = 0.1 * (F.col("a") % 10 + 1) / 10 * (F.col("b") % 10 + 1) / 10
    return same.groupBy("label").agg(F.round(F.sum(mass / F.greatest(F.lit(0.1), 1 - F.col("score"))), 6).alias("potential"))


@query("SELECT vec_id AS id, len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 AS valid FROM embeddings")
def valid_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).select("id", V.is_valid("v").alias("valid"))


@query()
def clusters_complete_link(spark: SparkSession, sf: str) -> DataFrame:
    return complete_link_of(vectors(spark, sf), 0.3, 3)


@query()
def clusters_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by status under each budget alone, and with the components cut into small blocks."""
    graph = settled_of(vectors(spark, sf), 0.3)  # components, counts of links and clusters once, for all budgets
    runs = {"blocks": None, "rows": Budgets(rows=100), "comparisons": Budgets(comparisons=100), "row_links": Budgets(row_links=20), "cluster": Budgets(cluster=3), "seconds": Budgets(seconds=0)}
    out = None
    for name, budgets in runs.items():
        found = clusters_under(graph, budgets=budgets, block=4096 if name == "blocks" else 200 if name == "seconds" else BLOCK)
        counts = found.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("budget"), "status", "n")
        out = counts if out is None else out.union(counts)
    return out


@query()
def cluster_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    """Per complete-link cluster its size, its least similarity, and whether every pair was found."""
    rows = vectors(spark, sf)
    return cohesion_of(rows, complete_link_of(rows, 0.3), 0.3)


@query()
def clusters_leader(spark: SparkSession, sf: str) -> DataFrame:
    return leader_clusters_of(vectors(spark, sf), 0.3, 3)
