"""Vector search, similarity graphs and clusters over unit vectors.

``unit`` columns hold vectors of length one, so the cosine is a dot product.
Threshold joins go through blocks: a stated query set against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.operators.complete_link import complete_link_clusters  # noqa: F401
from quillgrove.operators.components import connected_components
from quillgrove.operators.pair_grid import DIGITS, all_pairs, link_counts, nearest_rows  # noqa: F401
from quillgrove.session import materialize

#: Vectors that a tile of queries is compared with at a time.
BLOCK = 2048


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def is_valid(v: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & (F.size(v) > 0) & finite & (F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) > 0)


def nearest(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """``id, score`` of the k most similar rows; the query vector is part of the plan."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", dot("unit", literal).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, score`` of all pairs at or above the threshold, ``a < b``.

    Exact, by a grid of groups (:mod:`pair_grid`): what is moved grows with the rows, and a task
    holds one group and a tile of scores.
    """
    return all_pairs(rows, threshold)


def neighbours(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, of: str | None = None) -> DataFrame:
    """The k nearest rows of each query row (itself left out), by a grid of queries and rows (:mod:`pair_grid`).

    With ``of``, only rows that equal the query there.  Scores that agree in nine digits are equal, and go by ``other``.
    """
    found = nearest_rows(rows, queries, k, least, of, BLOCK)
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", DIGITS)), "other"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def completeness(pairs: DataFrame, cap: int) -> DataFrame:
    """Per row, whether its links stay within the cap that a bounded search would apply."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return completeness_of(ends.groupBy("id").agg(F.count("*").alias("hits")), cap)


def completeness_of(counted: DataFrame, cap: int) -> DataFrame:
    """The same of ``id, hits``, such as :func:`pair_grid.link_counts` gives."""
    return counted.withColumn("status", F.when(F.col("hits") > cap, "INCOMPLETE_TRUNCATED").otherwise("COMPLETE"))


def components(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, component`` of every row; a row without links is its own."""
    linked = connected_components(pairs, "a", "b").withColumnRenamed("node", "id")
    return rows.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def centroids(rows: DataFrame, key: str) -> DataFrame:
    """``key, centroid``: mean per dimension, as partial sums."""
    each = rows.select(key, F.posexplode("unit").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def cosine(a: str, b: str) -> Column:
    def norm(v: str) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    return clamped(dot(a, b) / (norm(a) * norm(b)))


def density(rows: DataFrame, key: str) -> DataFrame:
    """Per key: count, and mean, least and greatest cosine to the centroid."""
    joined = rows.join(centroids(rows, key), key).select(key, cosine("unit", "centroid").alias("c"))
    return joined.groupBy(key).agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.min("c").alias("low"), F.max("c").alias("high"))


def isolation(rows: DataFrame, key: str) -> DataFrame:
    """One minus the mean cosine to the other centroids; one if there is none.

    The mean over the others is the dot product with the sum of all unit
    centroids, less the one with itself, so no pairs of centroids are made.
    """
    each = centroids(rows, key).select(key, F.posexplode("centroid").alias("pos", "x"))
    norms = each.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = each.join(norms, key).select(key, "pos", (F.col("x") / F.col("norm")).alias("x"))
    sums = unit.groupBy("pos").agg(F.sum("x").alias("all_x"), F.count("*").alias("n"))
    other = unit.join(sums, "pos").groupBy(key).agg(F.sum(F.col("x") * F.col("all_x")).alias("s"), F.max("n").alias("n"))
    return other.select(key, F.when(F.col("n") < 2, 1.0).otherwise(1 - (F.col("s") - 1) / (F.col("n") - 1)).alias("isolation"))


def leader_clusters(rows: DataFrame, pairs: DataFrame, threshold: float, least: int = 3) -> DataFrame:
    """``id, leader``: in order of id, the first row not taken leads and takes its similar rows (strictly above).

    Rounds of joins: a row leads as soon as no undecided row of a smaller id is similar
    to it, and whatever is similar to a leader of a smaller id follows.  So no group
    meets in one task.
    """
    edges = pairs.where(F.col("score") > threshold).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = left = materialize(edges, "leader-edges")
    open_rows = rows.select("id")
    led = None
    while True:
        lead = materialize(open_rows.join(left.select(F.col("hi").alias("id")).distinct(), "id", "left_anti"), "leaders")
        led = lead if led is None else led.union(lead)
        taken = left.join(lead.withColumnRenamed("id", "lo"), "lo").select(F.col("hi").alias("id"))
        done = materialize(lead.union(taken).distinct(), "leader-done")
        open_rows = materialize(open_rows.join(done, "id", "left_anti"), "leader-open")
        if open_rows.isEmpty():
            break
        still = lambda df, end: df.join(done.withColumnRenamed("id", end), end, "left_anti")
        left = materialize(still(still(left, "lo"), "hi"), "leader-edges")
    follows = edges.join(led.withColumnRenamed("id", "lo"), "lo").groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("leader"))
    named = follows.join(led, "id", "left_anti").union(led.select("id", F.col("id").alias("leader")))
    return named.join(named.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("leader"), "leader").select("id", "leader")
