"""Layouts, state machines, commits, reminders, time relations and imports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.operators import records as K
from quillgrove.operators import temporal as P
from quillgrove.operators import vector as V
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table
from quillgrove.sources.adapters import MEM, NOW, memories, vectors

query = Registry()


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """JSON records in the four layouts, by id."""
    rows = memories(spark, sf)
    flat = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("note").alias("content"), "activation", F.lit("short").alias("orbitalLevel"), F.col("access_count").alias("accessCount")))
    nested = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.struct(F.lit("inner").alias("text")).alias("content"), F.struct(F.col("activation").alias("activation_score"), F.lit("long").alias("level")).alias("orbital")))
    hybrid = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","text":"outer","activation":null,"orbital":{"level":"medium","activation_score":0.5}}'))
    other = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('"}'))
    return rows.select(F.when(F.col("id") % 4 == 0, flat).when(F.col("id") % 4 == 1, nested).when(F.col("id") % 4 == 2, hybrid).otherwise(other).alias("record"))


@query(
    f"""WITH {MEM} SELECT id::VARCHAR AS id, ['flat', 'nested', 'hybrid', 'unknown'][id % 4 + 1] AS layout, [ 'note', 'inner', 'outer', NULL][id % 4 + 1] AS text,
CASE id % 4 WHEN 0 THEN activation WHEN 1 THEN activation ELSE -1 END AS activation, ['short', 'long', 'medium', NULL][id % 4 + 1] AS level, CASE WHEN id % 4 = 0 THEN access_count ELSE -1 END AS access_count, id % 4 <> 3 AS has_activation FROM mem"""
)
def layout_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return K.normalise(_raw(spark, sf)).select("id", "layout", "text", F.coalesce("activation", F.lit(-1.0)).alias("activation"), "level", F.coalesce("access_count", F.lit(-1)).alias("access_count"), "has_activation")


@query(f"WITH {MEM} SELECT CASE WHEN id % 4 <> 0 THEN 'NOT_FLAT' END AS reason, count(*)::BIGINT AS n FROM mem WHERE id % 4 <> 0 GROUP BY 1")
def shadow_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return K.shadow_projection(K.normalise(_raw(spark, sf)), 100)[1]


_STATES = "['COLD', 'WARM', 'HOT', 'CONSCIOUS', 'DECAYED', 'SUPPRESSED']"


@query(
    f"""WITH {MEM}, s AS (SELECT id, {_STATES}[id % 6 + 1] AS state, {_STATES}[(id // 6) % 6 + 1] AS wanted FROM mem),
m AS (SELECT *, (state || '>' || wanted IN ('COLD>WARM', 'COLD>DECAYED', 'WARM>HOT', 'WARM>COLD', 'HOT>CONSCIOUS', 'HOT>WARM', 'CONSCIOUS>HOT', 'DECAYED>COLD')) OR (wanted = 'SUPPRESSED' AND state <> 'SUPPRESSED') AS moved FROM s)
SELECT id, moved, CASE WHEN moved THEN wanted ELSE state END AS state_after FROM m"""
)
def lifecycle_moves(spark: SparkSession, sf: str) -> DataFrame:
    states = F.array(*map(F.lit, ["COLD", "WARM", "HOT", "CONSCIOUS", "DECAYED", "SUPPRESSED"]))
    rows = memories(spark, sf).select("id", F.element_at(states, (F.col("id") % 6 + 1).cast("int")).alias("state"), F.element_at(states, (F.floor(F.col("id") / 6) % 6 + 1).cast("int")).alias("wanted"))
    return K.lifecycle_moves(rows).select("id", "moved", "state_after")


@query(
    f"""WITH {MEM}, q AS (SELECT id + 3 AS id, CASE WHEN id % 2 = 0 THEN 'candidate' ELSE 'synthesizing' END AS to_state, id % 2 AS expected FROM mem), j AS (SELECT q.id, processing_state AS s, mem.id % 2 AS rev, to_state, expected FROM q LEFT JOIN mem USING (id))
SELECT id, CASE WHEN s IS NULL THEN 'UNKNOWN_ID' WHEN rev <> expected THEN 'STALE_REVISION' WHEN s || '>' || to_state IN ('raw>candidate', 'candidate>synthesizing', 'failed>candidate') THEN 'APPLIED' ELSE 'NOT_ALLOWED' END AS outcome FROM j"""
)
def processing_moves(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).withColumn("revision", F.col("id") % 2)
    wanted = F.when(F.col("id") % 2 == 0, "candidate").otherwise("synthesizing")
    requests = rows.select((F.col("id") + 3).alias("id"), wanted.alias("to_state"), (F.col("id") % 2).alias("expected_revision"))
    return K.processing_moves(rows, requests).select("id", "outcome")


@query(
    f"""WITH {MEM}, c AS (SELECT 100000 + id AS cluster, unnest([id, id + 1, id + 2]) AS id FROM mem WHERE id % 20 = 5), f AS (SELECT cluster, c.id, activation FROM c JOIN mem ON mem.id = c.id AND processing_state = 'raw'),
w AS (SELECT cluster, avg(activation) AS activation FROM f GROUP BY cluster HAVING count(*) = 3), t AS (SELECT DISTINCT c.id FROM c JOIN w USING (cluster))
SELECT mem.id, CASE WHEN t.id IS NOT NULL THEN 'deep' ELSE storage_tier END AS storage_tier, CASE WHEN t.id IS NOT NULL THEN 'consolidated' ELSE processing_state END AS processing_state, memory_kind, round(activation, 6) AS activation
FROM mem LEFT JOIN t ON t.id = mem.id UNION ALL SELECT cluster, 'core', 'consolidated', 'super_memory', round(activation, 6) FROM w"""
)
def consolidation_commit(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    clusters = rows.where("id % 20 = 5").select((F.col("id") + 100000).alias("cluster"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2).alias("source_ids"))
    return K.consolidate(rows, clusters).withColumn("activation", F.round("activation", 6))


@query(
    f"""WITH r AS (SELECT event_id::VARCHAR AS id, date_trunc('minute', ts) AS due, CASE WHEN event_id % 3 = 0 THEN 'fired' ELSE 'pending' END AS status, CASE event_id % 5 WHEN 0 THEN 'hours' WHEN 1 THEN 'days' END AS unit, event_id % 4 + 1 AS every FROM events WHERE event_id % 10 < 5),
n AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now), a AS (SELECT id, due, status, unit, every, status = 'pending' AND now >= due AS fires, status = 'pending' AND now >= due - INTERVAL 1 HOUR AND now < due AS announced, status = 'fired' AND now >= due + INTERVAL 2 HOURS AS follow_up FROM r, n)
SELECT id, epoch_us(due) AS due_us, CASE WHEN fires THEN 'fired' ELSE status END AS status, announced, follow_up FROM a
UNION ALL SELECT id || '+', epoch_us(due + to_hours(CASE unit WHEN 'hours' THEN every ELSE every * 24 END)), 'pending', false, false FROM a WHERE fires AND unit IS NOT NULL"""
)
def reminder_tick(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "events").where("event_id % 10 < 5").select(
        F.col("event_id").cast("string").alias("id"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("due"), F.when(F.col("event_id") % 3 == 0, "fired").otherwise("pending").alias("status"),
        F.when(F.col("event_id") % 5 == 0, "hours").when(F.col("event_id") % 5 == 1, "days").alias("unit"), (F.col("event_id") % 4 + 1).alias("every"), F.lit(False).alias("announced"), F.lit(False).alias("follow_up"),
    )
    out = K.reminder_tick(rows, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return out.select("id", F.unix_micros("due").alias("due_us"), "status", "announced", "follow_up")


@query(
    """WITH s AS (SELECT event_id, value, value * 0.9 AS disk, value * 1.1 AS temp FROM events), a AS (SELECT event_id, list_filter([CASE WHEN value >= 85 THEN 'critical:ram' WHEN value >= 75 THEN 'warning:ram' END, CASE WHEN disk >= 90 THEN 'critical:disk' WHEN disk >= 80 THEN 'warning:disk' END,
CASE WHEN temp >= 82 THEN 'critical:temp' WHEN temp >= 74 THEN 'warning:temp' END], lambda x: x IS NOT NULL) AS al FROM s)
SELECT event_id, array_to_string(al, ',') AS alerts, CASE WHEN len(list_filter(al, lambda x: starts_with(x, 'critical'))) > 0 THEN 'CRITICAL' WHEN len(al) > 0 THEN 'STRESS' ELSE 'OK' END AS status FROM a"""
)
def system_status(spark: SparkSession, sf: str) -> DataFrame:
    samples = read_table(spark, sf, "events").select("event_id", F.col("value").alias("ram"), (F.col("value") * 0.9).alias("disk"), (F.col("value") * 1.1).alias("temp"))
    out = K.system_alerts(samples, {"ram": (75, 85), "disk": (80, 90), "temp": (74, 82)})
    return out.select("event_id", F.array_join("alerts", ",").alias("alerts"), "status")


@query(
    f"""WITH p AS (SELECT user_id, event_type AS place, arg_max(props, (ts, event_id)) AS state, max(ts) AS ts, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)
SELECT user_id, place, state, n, ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AS stale FROM p"""
)
def world_state(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select("user_id", F.col("event_type").alias("place"), F.col("props").alias("state"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return P.place_states(events, F.lit(NOW).cast("timestamp")).select("user_id", "place", "state", "n", "stale")


_DUE = ["domani alle 11", "chiamare venerdì", "ogni giorno alle 11", "ogni 3 ore", "niente", ""]


@query(
    """SELECT conv_id, turn, due_s, every, unit FROM conversations JOIN (VALUES (0, 1704279600, 0, NULL), (1, 1704445200, 0, NULL), (2, 1704279600, 1, 'days'), (3, 1704204000, 3, 'hours')) t(k, due_s, every, unit) ON k = (conv_id + turn) % 6"""
)
def due_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Reminders said before the turns' texts; two of six say no time."""
    said = F.element_at(F.array(*map(F.lit, _DUE)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    rows = read_table(spark, sf, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    found = P.due_dates(rows, datetime(2024, 1, 2, 11, 0))
    key = [F.floor(F.col("id") / 1_000_000).alias("conv_id"), (F.col("id") % 1_000_000).alias("turn")]
    return found.select(*key, F.unix_timestamp("due").cast("int").alias("due_s"), F.coalesce(F.col("every"), F.lit(0)).cast("int").alias("every"), "unit")


@query(
    """WITH RECURSIVE n AS (SELECT conv_id, turn AS node, CASE WHEN turn > 0 THEN turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END END AS parent, max(turn) OVER (PARTITION BY conv_id) AS cur FROM conversations),
p AS (SELECT conv_id, node, parent, 0 AS d FROM n WHERE node = cur UNION ALL SELECT n.conv_id, n.node, n.parent, d + 1 FROM p JOIN n ON n.conv_id = p.conv_id AND n.node = p.parent)
SELECT conv_id, node, row_number() OVER (PARTITION BY conv_id ORDER BY d DESC)::INT AS position FROM p"""
)
def import_linearise(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("current"))
    parent = F.when(F.col("turn") > 0, F.col("turn") - F.when(F.col("turn") % 3 == 2, 2).otherwise(1))
    return P.linearise(turns.join(last, "conv_id").select("conv_id", F.col("turn").alias("node"), parent.alias("parent"), "current"))


@query(
    """SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'internal' WHEN turn % 4 = 3 THEN 'filtered' WHEN length(trim(substring(text, 1, turn * 3 + 5))) < 8 THEN 'too_short' END AS reason FROM conversations"""
)
def import_classify(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("turn") % 4 == 3, "thoughts").otherwise("text")
    text = F.expr("substring(text, 1, CAST(turn * 3 + 5 AS int))")
    content = F.to_json(F.struct(F.array(text).alias("parts")))
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", kind.alias("kind"), content.alias("content"))
    return rows.select("conv_id", "turn", P.classify_message(F.col("role"), F.col("kind"), P.message_text("content")).alias("reason"))


@query(
    f"""WITH {MEM}, s AS (SELECT id, id % 2 + id % 3 AS e, id % 5 = 0 AS health, id % 7 = 0 AS work, id % 4 = 0 AS future, id % 13 = 0 AS trivial FROM mem)
SELECT id, CASE WHEN trivial THEN 0.1 ELSE round(greatest(0.1, least(0.95, 0.5 + CASE WHEN health AND e > 0 THEN 0.35 WHEN health THEN 0.2 ELSE 0 END + CASE WHEN work THEN 0.1 ELSE 0 END + CASE WHEN future THEN 0.1 ELSE 0 END + CASE WHEN e >= 2 THEN 0.05 ELSE 0 END)), 2) END::DOUBLE AS importance FROM s"""
)
def signal_importance(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("id") % 2 + F.col("id") % 3).cast("int")
    domains = F.array(F.when(F.col("id") % 5 == 0, "health").otherwise(""), F.when(F.col("id") % 7 == 0, "work").otherwise(""))
    hints = F.array(F.when(F.col("id") % 4 == 0, "future").otherwise(""))
    value = K.importance(F.array_repeat(F.lit("x"), n), domains, hints, F.col("id") % 13 == 0)
    return memories(spark, sf).select("id", value.alias("importance"))


@query()
def gravity_influence(spark: SparkSession, sf: str) -> DataFrame:
    """Pull of each record's five most similar ones: mass by mass over squared distance, damped with distance."""
    rows = vectors(spark, sf)
    near = V.neighbours(rows, rows, 5, 0.2)
    mass = lambda c: (F.col(c) % 10 + 1) / 10
    distance = 1 - F.col("score")
    force = 0.1 * mass("id") * mass("other") / F.greatest(F.lit(0.1), distance * distance)
    return near.groupBy("id").agg(F.round(F.avg(force * (1 - distance / 2)), 6).alias("field"), F.count("*").alias("n"))
