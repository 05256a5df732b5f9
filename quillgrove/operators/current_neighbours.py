"""Neighbours among points that are still current.

A store of vectors keeps points of records that have changed or gone since, and of other users.  The nearest
hits of a query are fetched over its limit, then its own point, stale ones and those of others go.
Queries that are left short although the store gave all that was asked for ask again for ``FACTOR`` times as many;
only they do.  Past ``MOST_FETCHED``, what is still short searches the current points of its user alone, which
needs no more than the limit.  So hits are the same as those of a search that knew the current points beforehand,
and a query in clean surroundings costs one round.

A point that has the identifier of a current identity without its claims, or the claims without the identifier, is a
conflict: it means a broken store, and a search that meets one fails.

Defined results: a query that isn't current itself has no hits and says so; equal scores go by ``id``; fewer current
points than the limit give what there is.  ``id`` numbers the points and must be distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.operators.vector import neighbours
from quillgrove.session import discard, materialize

FACTOR, MOST_FETCHED = 4, 4000
CLAIMS = ["user", "memory_id", "content_hash", "model", "revision"]


class IdentityConflict(ValueError):
    """A point and the current identity of its name or claims disagree."""


def point_states(points: DataFrame, identities: DataFrame) -> DataFrame:
    """``id, user, state`` of every point: CURRENT, STALE or CONFLICT."""
    named = identities.select("point_id", F.struct(*CLAIMS).alias("expected")).dropDuplicates(["point_id"])
    claimed = identities.select(*CLAIMS, F.col("point_id").alias("expected_point")).dropDuplicates(CLAIMS)
    joined = points.select("id", "point_id", *CLAIMS).join(named, "point_id", "left").join(claimed, CLAIMS, "left")
    by_name, by_claims = F.col("expected").isNotNull(), F.col("expected_point").isNotNull()
    agree = by_name & by_claims & (F.col("expected_point") == F.col("point_id"))
    return joined.select("id", "user", F.when(agree, "CURRENT").when(by_name | by_claims, "CONFLICT").otherwise("STALE").alias("state"))


def current_neighbours(points: DataFrame, identities: DataFrame, queries: DataFrame, k: int, least: float = -1.0, most: int = MOST_FETCHED) -> tuple[DataFrame, DataFrame]:
    """(``id, other, score, nth``; ``id, rounds, discarded, hits, status``) of ``queries``, ids of points.

    ``points`` are ``id, point_id, unit`` with ``CLAIMS``, ``identities`` ``point_id`` with ``CLAIMS``.  ``discarded`` counts
    hits of the query's last fetch that weren't current; status is COMPLETE, EXHAUSTED (fewer than ``k`` exist) or QUERY_NOT_CURRENT.
    """
    states = materialize(point_states(points, identities), "point-states")
    wanted = queries.select("id").distinct().join(states, "id")
    refused = wanted.where("state <> 'CURRENT'").select("id")
    short = materialize(wanted.where("state = 'CURRENT'").select("id", "user"), "short-queries")
    other = states.select(F.col("id").alias("other"), F.col("user").alias("other_user"), "state")
    kept, counts, fetch, rounds = [], [], k * FACTOR, 0
    while not short.isEmpty():
        rounds += 1
        last = fetch > most
        asking = points.join(short.select("id"), "id", "left_semi")
        if last:
            current = points.join(states.where("state = 'CURRENT'").select("id"), "id", "left_semi")
            found = neighbours(current, asking, k, least, of="user")
        else:
            found = neighbours(points, asking, fetch, least)
        judged = found.drop("nth").join(other, "other").join(short, "id")
        judged = materialize(judged.withColumn("good", (F.col("state") == "CURRENT") & (F.col("user") == F.col("other_user"))), "judged-hits")
        if broken := judged.where("state = 'CONFLICT'").select("id", "other").first():
            raise IdentityConflict(f"query {broken.id} meets point {broken.other}, which contradicts a current identity")
        per = short.join(judged.groupBy("id").agg(F.count("*").alias("fetched"), F.count_if("good").alias("kept")), "id", "left").fillna(0, ["fetched", "kept"])
        done = F.lit(True) if last else (F.col("kept") >= k) | (F.col("fetched") < fetch)
        per = materialize(per.withColumn("done", done), "fetched-counts")
        settled = per.where("done").select("id")
        kept.append(judged.where("good").join(settled, "id", "left_semi").select("id", "other", "score"))
        counts.append(per.where("done").select("id", F.lit(rounds).alias("rounds"), (F.col("fetched") - F.col("kept")).alias("discarded"), F.least("kept", F.lit(k)).alias("hits")))
        before, short = short, materialize(per.where("not done").select("id", "user"), "short-queries")
        discard(before)
        fetch *= FACTOR
    spark = points.sparkSession
    hits = reduce(DataFrame.union, kept, spark.createDataFrame([], "id long, other long, score double"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    report = reduce(DataFrame.union, counts, spark.createDataFrame([], "id long, rounds int, discarded long, hits long"))
    report = report.withColumn("status", F.when(F.col("hits") < k, "EXHAUSTED").otherwise("COMPLETE"))
    none = refused.select("id", F.lit(0).alias("rounds"), F.lit(0).cast("long").alias("discarded"), F.lit(0).cast("long").alias("hits"), F.lit("QUERY_NOT_CURRENT").alias("status"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= k), report.union(none)
