"""Records of mixed layouts, state machines, commits, reminders and status rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.functions import activation as A

# fixed values: the fields that tell the flat layout, and those below "orbital" that tell the nested one
FLAT_FIELDS = ["activation", "orbitalState", "orbitalLevel", "memoryDepth", "dualState", "decay_rate", "timestamp", "lastAccess", "accessCount", "tags"]
NESTED_FIELDS = ["level", "activation_score", "decay_rate", "last_access", "access_count", "birth"]

# fixed values: the moves that each state allows (to SUPPRESSED from every state but itself)
LIFECYCLE_MOVES = {"COLD": ["WARM", "DECAYED"], "WARM": ["HOT", "COLD"], "HOT": ["CONSCIOUS", "WARM"], "CONSCIOUS": ["HOT"], "DECAYED": ["COLD"]}
PROCESSING_MOVES = {"raw": ["candidate"], "candidate": ["raw", "synthesizing"], "synthesizing": ["consolidated", "failed"], "failed": ["candidate", "raw"]}


def _has(v: str, path: str) -> Column:
    """Whether the path exists at all: an explicit null does, an absent field doesn't."""
    return F.variant_get(v, f"$.{path}", "variant").isNotNull()


def _either(v: str, flat: str, nested: str, kind: str) -> Column:
    """The flat field if it is present, even as null; else the nested one."""
    return F.when(_has(v, flat), F.try_variant_get(v, f"$.{flat}", kind)).otherwise(F.try_variant_get(v, f"$.{nested}", kind))


def normalise(raw: DataFrame, column: str = "record") -> DataFrame:
    """One canonical row per JSON record; text that isn't JSON gives a row of layout ``unknown``."""
    parsed = raw.withColumn("_v", F.try_parse_json(column))
    flat = reduce(lambda a, b: a | b, (_has("_v", f) for f in FLAT_FIELDS))
    nested = reduce(lambda a, b: a | b, (_has("_v", f"orbital.{f}") for f in NESTED_FIELDS))
    layout = F.when(flat & nested, "hybrid").when(flat, "flat").when(nested, "nested").otherwise("unknown")
    content = F.try_variant_get("_v", "$.content", "string")
    inner = F.try_variant_get("_v", "$.content.text", "string")
    is_text = F.rlike(F.schema_of_variant(F.variant_get("_v", "$.content", "variant")), F.lit("^STRING"))
    text = F.when(is_text, content).when(_has("_v", "content"), inner).otherwise(F.try_variant_get("_v", "$.text", "string"))
    activation = _either("_v", "activation", "orbital.activation_score", "double")
    fields = {
        "id": F.try_variant_get("_v", "$.id", "string"), "layout": layout, "text": text, "activation": activation,
        "level": _either("_v", "orbitalLevel", "orbital.level", "string"),
        "access_count": _either("_v", "accessCount", "orbital.access_count", "bigint"),
        "last_access": _either("_v", "lastAccess", "orbital.last_access", "string"),
        "created_at": _either("_v", "timestamp", "meta.timestamp", "string"),
        "tags": F.try_variant_get("_v", "$.tags", "array<string>"),
        "has_activation": _has("_v", "activation") | _has("_v", "orbital.activation_score"),
    }
    return parsed.select(*[c.alias(k) for k, c in fields.items()])


def shadow_projection(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Records fit for a dry run, and the counts of reasons for those that aren't.

    Every row of a repeated id is left out, found by a count per id.
    """
    counts = rows.groupBy("id").agg(F.count("*").alias("_n"))
    joined = rows.join(counts, rows.id.eqNullSafe(counts.id)).select(rows["*"], "_n")
    reason = (
        F.when(F.col("id").isNull(), "NO_ID").when(F.col("_n") > 1, "DUPLICATE_ID").when(F.col("layout") != "flat", "NOT_FLAT")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "NO_TEXT").when(F.col("activation").isNull(), "NO_ACTIVATION")
    )
    marked = joined.withColumn("reason", reason).drop("_n")
    return marked.where("reason IS NULL").drop("reason").orderBy("id").limit(limit), marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def allowed(moves: dict[str, list[str]], source: Column, target: Column) -> Column:
    """Whether a state machine lets ``source`` become ``target``; an unknown state allows nothing."""
    pairs = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, to in moves.items() for b in to]
    return F.coalesce(F.concat_ws(">", source, target).isin(*pairs), F.lit(False))


def lifecycle_moves(rows: DataFrame) -> DataFrame:
    """Adds ``state_after``: the wanted state where the move is allowed, else the present one."""
    now, wanted = F.col("state"), F.col("wanted")
    ok = allowed(LIFECYCLE_MOVES, now, wanted) | ((wanted == "SUPPRESSED") & (now != "SUPPRESSED"))
    return rows.withColumns({"moved": ok, "state_after": F.when(ok, wanted).otherwise(now)})


def processing_moves(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (``id, to_state, expected_revision``) with their outcome against the present revision."""
    joined = requests.join(rows.select("id", "processing_state", "revision"), "id", "left")
    outcome = (
        F.when(F.col("processing_state").isNull(), "UNKNOWN_ID").when(F.col("revision") != F.col("expected_revision"), "STALE_REVISION")
        .when(allowed(PROCESSING_MOVES, F.col("processing_state"), F.col("to_state")), "APPLIED").otherwise("NOT_ALLOWED")
    )
    return joined.withColumn("outcome", outcome).withColumn("revision_after", F.col("revision") + F.when(F.col("outcome") == "APPLIED", 1).otherwise(0))


def consolidate(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """The table after clusters (``cluster, source_ids``) became summary records.

    A cluster applies only if all its sources exist as raw records; then one row
    is added and its sources move to the deep tier, else nothing of it changes.
    """
    members = clusters.select("cluster", F.size("source_ids").alias("want"), F.explode("source_ids").alias("id"))
    found = members.join(rows.where("processing_state = 'raw'").select("id", "activation"), "id")
    whole = found.groupBy("cluster").agg(F.count("*").alias("have"), F.max("want").alias("want"), F.avg("activation").alias("activation")).where("have = want")
    taken = members.join(whole.select("cluster"), "cluster").select("id").distinct().withColumn("_taken", F.lit(True))
    after = rows.join(taken, "id", "left").select(
        "id", F.when(F.col("_taken"), "deep").otherwise(F.col("storage_tier")).alias("storage_tier"),
        F.when(F.col("_taken"), "consolidated").otherwise(F.col("processing_state")).alias("processing_state"), "memory_kind", "activation",
    )
    made = whole.select(F.col("cluster").alias("id"), F.lit("core").alias("storage_tier"), F.lit("consolidated").alias("processing_state"), F.lit("super_memory").alias("memory_kind"), "activation")
    return after.unionByName(made)


def reminder_tick(rows: DataFrame, now: Column) -> DataFrame:
    """Reminders after a tick at ``now``: announced an hour before, fired when due, followed up two hours on;
    a fired one that recurs adds its next instance."""
    due, pending = F.col("due"), F.col("status") == "pending"
    fires = pending & (now >= due)
    after = rows.withColumns({
        "announced": F.col("announced") | (pending & (now >= due - F.expr("INTERVAL 1 HOUR")) & (now < due)),
        "follow_up": (F.col("status") == "fired") & (now >= due + F.expr("INTERVAL 2 HOURS")),
        "status": F.when(fires, "fired").otherwise(F.col("status")), "_fires": fires,
    })
    hours = F.when(F.col("unit") == "hours", F.col("every")).when(F.col("unit") == "days", F.col("every") * 24)
    again = after.where(F.col("_fires") & hours.isNotNull()).withColumns({
        "due": F.col("due") + F.make_dt_interval(F.lit(0), hours.cast("int")), "status": F.lit("pending"), "announced": F.lit(False), "follow_up": F.lit(False), "id": F.concat("id", F.lit("+")),
    })
    return after.union(again).drop("_fires")


def system_alerts(samples: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds the list of alerts and the status of each sample, from (warning, critical) limits per column."""
    found = F.array(*[F.when(F.col(c) >= high, F.lit(f"critical:{c}")).when(F.col(c) >= low, F.lit(f"warning:{c}")) for c, (low, high) in limits.items()])
    alerts = F.filter(found, lambda x: x.isNotNull())
    status = F.when(F.exists("alerts", lambda x: x.startswith("critical")), "CRITICAL").when(F.size("alerts") > 0, "STRESS").otherwise("OK")
    return samples.withColumn("alerts", alerts).withColumn("status", status)


def importance(entities: Column, domains: Column, hints: Column, trivial: Column) -> Column:
    """Additive importance of a record from its signals, kept within .1 and .95."""
    has = lambda d: F.array_contains(domains, d)
    some = F.size(entities)
    parts = [
        (has("health") & (some > 0), 0.35), (has("health") & (some == 0), 0.2), (has("project") & has("technical"), 0.2), (has("family") & has("emotion"), 0.2),
        (has("finance") | has("work"), 0.1), (F.array_contains(hints, "future") | F.array_contains(hints, "urgent"), 0.1), (some >= 2, 0.05), (F.array_contains(hints, "negative"), 0.05),
    ]
    total = reduce(lambda a, b: a + b, (F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.5))
    return F.when(trivial, 0.1).otherwise(F.round(A.clamp(total, 0.1, 0.95), 2))
