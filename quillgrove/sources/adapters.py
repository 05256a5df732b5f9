"""The library's record shapes, taken from the driver's tables.

``memories``  scored records from ``documents``; ``links`` between neighbouring ones
of a source; ``memory_events`` from ``events``; ``turns`` from ``conversations``;
``vectors`` from ``embeddings``.  The rules are deterministic, and the SQL texts
beside them give DuckDB the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrove.session import read_table

#: The instant that stands for the present: queries never read a clock.
NOW = "2024-02-01 00:00:00"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "text",
        "doc_id % 10 AS user_id",
        "(doc_id % 101) / 100D AS activation",
        "CASE doc_id % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'semantic' WHEN 2 THEN 'episodic' ELSE 'working' END AS type",
        "array(lang, source) AS tags",
        "CAST(doc_id % 120 AS double) AS idle_days",
        "doc_id % 7 AS access_count",
        "CASE WHEN doc_id % 9 = 0 THEN 'super_memory' ELSE 'raw' END AS memory_kind",
        "CASE doc_id % 6 WHEN 0 THEN 'core' WHEN 1 THEN 'deep' WHEN 2 THEN NULL ELSE 'warm' END AS storage_tier",
        "CASE doc_id % 5 WHEN 0 THEN 'historical' WHEN 1 THEN 'temporary' ELSE 'normal' END AS memory_depth",
        "CASE doc_id % 11 WHEN 0 THEN 'candidate' WHEN 1 THEN 'consolidated' WHEN 2 THEN 'failed' ELSE 'raw' END AS processing_state",
        "n_chars",
    )


MEM = """mem AS (SELECT doc_id AS id, text, doc_id % 10 AS user_id, (doc_id % 101)::DOUBLE / 100 AS activation,
 CASE doc_id % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'semantic' WHEN 2 THEN 'episodic' ELSE 'working' END AS type,
 [lang, source] AS tags, (doc_id % 120)::DOUBLE AS idle_days, doc_id % 7 AS access_count,
 CASE WHEN doc_id % 9 = 0 THEN 'super_memory' ELSE 'raw' END AS memory_kind,
 CASE doc_id % 6 WHEN 0 THEN 'core' WHEN 1 THEN 'deep' WHEN 2 THEN NULL ELSE 'warm' END AS storage_tier,
 CASE doc_id % 5 WHEN 0 THEN 'historical' WHEN 1 THEN 'temporary' ELSE 'normal' END AS memory_depth,
 CASE doc_id % 11 WHEN 0 THEN 'candidate' WHEN 1 THEN 'consolidated' WHEN 2 THEN 'failed' ELSE 'raw' END AS processing_state,
 n_chars FROM documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each record to the one before it of the same source and language."""
    near = Window.partitionBy("source", "lang").orderBy("doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.lag("doc_id").over(near).alias("before"))
    return docs.where("before IS NOT NULL").selectExpr(
        "before AS source_id",
        "doc_id AS target_id",
        "CASE WHEN doc_id - before <= 5 THEN 0.45D WHEN doc_id - before <= 20 THEN 0.32D WHEN doc_id - before <= 80 THEN 0.14D ELSE 0.04D END AS weight",
        "CASE doc_id % 3 WHEN 0 THEN 'dialogue_sequence' WHEN 1 THEN 'continuation' ELSE 'semantic' END AS link_type",
        "doc_id % 4 AS reinforced",
    )


LINK = """link AS (SELECT before AS source_id, doc_id AS target_id,
 CASE WHEN doc_id - before <= 5 THEN 0.45 WHEN doc_id - before <= 20 THEN 0.32 WHEN doc_id - before <= 80 THEN 0.14 ELSE 0.04 END::DOUBLE AS weight,
 CASE doc_id % 3 WHEN 0 THEN 'dialogue_sequence' WHEN 1 THEN 'continuation' ELSE 'semantic' END AS link_type, doc_id % 4 AS reinforced
 FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS before FROM documents) WHERE before IS NOT NULL)"""


def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "user_id AS memory_id",
        "CASE event_type WHEN 'click' THEN 'echoed' WHEN 'view' THEN 'echoed' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'suppressed' ELSE 'recall_summary' END AS kind",
        "least(value / 100, 1D) AS echo_score",
        "event_type AS concept",
    )


EVT = """evt AS (SELECT event_id, ts, user_id AS memory_id,
 CASE event_type WHEN 'click' THEN 'echoed' WHEN 'view' THEN 'echoed' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'suppressed' ELSE 'recall_summary' END AS kind,
 least(value / 100, 1.0::DOUBLE) AS echo_score, event_type AS concept FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "role",
        "text",
        "CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN 'green' ELSE 'yellow' END AS traffic",
        "conv_id * 3600000 + turn * turn * 300000 AS ts_ms",
    )


TRN = """trn AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 <> 0 THEN 'green' ELSE 'yellow' END AS traffic,
 conv_id * 3600000 + turn * turn * 300000 AS ts_ms FROM conversations)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as doubles of unit length, so a cosine is a dot product."""
    raw = read_table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "label", "transform(embedding, x -> CAST(x AS double)) AS v")
    return raw.selectExpr("id", "label", "v", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x)) AS norm").where("norm > 0").selectExpr(
        "id", "label", "transform(v, x -> x / norm) AS unit"
    )


VEC = """raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
vec AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS unit FROM raw)"""
