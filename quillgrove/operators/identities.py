"""Current identities of points, discovery status, maturity, claims and keys that make a write repeatable.

Fingerprints of whole tables are sums of row hashes: partial aggregates, whatever the order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Discovery states by how much they say against a component, worst last.
PRIORITY = {"COMPLETE": 0, "UNCERTIFIED": 1, "TRUNCATED": 2, "FAILED": 3}


def classify_hits(hits: DataFrame, identities: DataFrame, threshold: float) -> DataFrame:
    """Hits (``query_point, point_id, memory_id, content_hash, model, revision, score``) with ``kind``.

    A hit is KEPT if its point is current, of the same model, revision, record and
    content, isn't the query's own and scores enough; the first fault names it.
    """
    now = identities.select("point_id", *(F.col(c).alias(f"now_{c}") for c in ("memory_id", "content_hash", "model", "revision")))
    known = identities.select("memory_id").distinct().withColumn("known", F.lit(True))
    joined = hits.join(now, "point_id", "left").join(known, "memory_id", "left")
    kind = (
        F.when(F.col("now_memory_id").isNull(), F.when(F.col("known"), "STALE_IDENTITY").otherwise("FOREIGN_POINT"))
        .when((F.col("model") != F.col("now_model")) | (F.col("revision") != F.col("now_revision")), "INCOMPATIBLE_PROVENANCE")
        .when((F.col("memory_id") != F.col("now_memory_id")) | (F.col("content_hash") != F.col("now_content_hash")), "STALE_IDENTITY")
        .when(F.col("point_id") == F.col("query_point"), "SELF").when(F.col("score") < threshold, "BELOW_THRESHOLD").otherwise("KEPT")
    )
    return joined.withColumn("kind", kind).select(*hits.columns, "kind")


def row_hash(*columns: str) -> Column:
    """48 bits of the columns' SHA-256; a long holds sums of 32,768 of them, so :func:`identity_snapshot` adds decimals."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def identity_snapshot(identities: DataFrame) -> DataFrame:
    """One row: counts, whether points and records are unique and of one model, and the fingerprint of all rows.

    The fingerprint is the sum of the rows' hashes modulo 2^63, whatever their number.
    """
    total = F.sum(row_hash("point_id", "memory_id", "content_hash", "model", "revision").cast("decimal(18,0)"))
    return identities.agg(
        F.count("*").alias("n"),
        (F.count("*") == F.count_distinct("point_id")).alias("unique_points"),
        (F.count("*") == F.count_distinct("memory_id")).alias("unique_records"),
        (F.count_distinct("model", "revision") <= 1).alias("one_model"),
        (total % F.lit(Decimal(2**63))).cast("long").alias("fingerprint"),
    )


def repeated_identities(identities: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, which an index of current identities rejects."""
    return identities.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def worst_status(rows: DataFrame, key: str) -> DataFrame:
    """``key, status``: of a component's discovery states the one of highest priority."""
    rank = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[F.col("status")]
    return rows.groupBy(key).agg(F.max_by("status", rank).alias("status"))


def graph_status(components: DataFrame) -> DataFrame:
    """One row of counts and COMPLETE, PARTIAL_DEFERRED or DEFERRED, from ``authorized`` of each component."""
    counted = components.agg(F.count("*").alias("components"), F.count_if("authorized").alias("authorized"))
    status = F.when(F.col("authorized") == F.col("components"), "COMPLETE").when(F.col("authorized") > 0, "PARTIAL_DEFERRED").otherwise("DEFERRED")
    return counted.withColumn("status", status)


def maturity(clusters: DataFrame, approved: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Clusters (``id, members, density_members, dimension, centroid, low, high``) with ``reason`` and ``mature``."""
    marked = clusters.join(approved.select("id").distinct().withColumn("approved", F.lit(True)), "id", "left")
    n = F.size("members")
    invalid = F.col("id").isNull() | F.col("members").isNull() | (n == 0) | (F.size(F.array_distinct("members")) != n)
    wrong_size = (F.col("density_members") != n) | (n < least) | (n > F.lit(most) if most else F.lit(False))
    cosine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(-1, 1)
    embedded = (F.col("dimension") > 0) & (F.size("centroid") == F.col("dimension")) & F.forall("centroid", lambda x: x.isNotNull() & ~F.isnan(x)) & cosine("low") & cosine("high")
    reason = (
        F.when(invalid, "INVALID_CLUSTER").when(F.coalesce(wrong_size, F.lit(True)), "CLUSTER_SIZE_INCOHERENT").when(~F.coalesce(embedded, F.lit(False)), "INVALID_EMBEDDING_EVIDENCE")
        .when(F.col("approved"), "EXPLICITLY_APPROVED").otherwise("EXPLICIT_APPROVAL_REQUIRED")
    )
    return marked.withColumn("reason", reason).withColumn("mature", F.col("reason") == "EXPLICITLY_APPROVED")


def claims(sources: DataFrame) -> DataFrame:
    """``cluster, n, claimed``: a claim takes all sources of a cluster or none.

    A source is free if it is raw, no attempt holds it, and its content hash is the expected one.
    """
    free = (F.col("state") == "raw") & F.col("attempt").isNull() & F.col("content_hash").eqNullSafe(F.col("expected_hash"))
    grouped = sources.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.coalesce(free, F.lit(False))).alias("free"), F.count_distinct("id").alias("ids"))
    return grouped.select("cluster", "n", ((F.col("free") == F.col("n")) & (F.col("ids") == F.col("n"))).alias("claimed"))


def repeat_key(owner: str, members: str, policy: str) -> Column:
    """The key of a cluster: its owner, sorted members and policy, hashed; the same input is written once."""
    return F.sha2(F.concat_ws("|", F.col(owner).cast("string"), F.array_join(F.array_sort(F.transform(members, lambda x: x.cast("string"))), ","), F.lit(policy)), 256)


def cache_misses(identities: DataFrame, cache: DataFrame) -> DataFrame:
    """Identities (``memory_id, content_hash, model``) that no cached embedding is of."""
    return identities.join(cache, ["memory_id", "content_hash", "model"], "left_anti")


def vector_hash(v: str) -> Column:
    """A fingerprint of a vector: SHA-256 of its values in millionths."""
    return F.sha2(F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("long").cast("string")), ","), 256)


def overlaid(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Rows with the authoritative processing state where there is one; written rows drop ``virtual``."""
    joined = rows.join(states.select("id", F.col("state").alias("_state")), "id", "left")
    return joined.withColumn("virtual", F.col("_state").isNotNull()).withColumn("processing_state", F.coalesce("_state", "processing_state")).drop("_state")
