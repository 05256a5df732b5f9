"""A journal of work on clusters: appended once whatever is replayed, and read back as states.

``append``    adds a batch of events that the journal doesn't hold yet, as a table of its own; a batch that is run again replaces
              itself.  ``append_stream`` does so from a stream.
``clusters``  the state of each run's clusters, and what contradicts itself in their events.
``runs``      the state of each run.

States are read by aggregates alone: a field that must have one value is compared by its least and greatest, and events are
out of order where a step's last event comes after the first one of a later step.
So neither a run nor a cluster with very many events meets in one task.

Events: run_id, cluster_id, event_type, timestamp (long), attempt_id, transaction_id, claim_id, claim_attempt, cluster_record_id
(strings), sources and claim_sources (arrays of strings).  Null and empty ids are none, events without a run or type are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillgrove.session import materialize

FIELDS = ["run_id", "cluster_id", "event_type", "timestamp", "attempt_id", "transaction_id", "claim_id", "claim_attempt", "cluster_record_id", "sources", "claim_sources"]
SCHEMA = ", ".join(f"{x} {'bigint' if x == 'timestamp' else 'array<string>' if x in ('sources', 'claim_sources') else 'string'}" for x in FIELDS) + ", event_id string, sequence bigint"
# fixed values: steps of a cluster in their order, and what its events mean, the first that is there
STEPS = {
    "CLUSTER_SELECTED": 1, "CLUSTER_PERSISTED": 2, "SOURCES_CLAIMED": 3, "SYNTHESIS_STARTED": 4, "SYNTHESIS_SUCCEEDED": 5, "SYNTHESIS_FAILED": 5, "COMMIT_STARTED": 6,
    "COMMIT_SUCCEEDED": 7, "COMMIT_FAILED": 7, "SOURCES_FAILED": 8, "RUN_RECONCILED": 9,
}
MEANING = {
    "RUN_RECONCILED": "RECOVERED", "COMMIT_SUCCEEDED": "COMMITTED", "SOURCES_FAILED": "FAILED", "COMMIT_FAILED": "COMMIT_FAILED_NO_SOURCE_TERMINAL",
    "COMMIT_STARTED": "COMMIT_STARTED_NO_RESULT", "SYNTHESIS_FAILED": "SYNTHESIS_FAILED_NO_SOURCE_TERMINAL", "SYNTHESIS_SUCCEEDED": "SYNTHESIS_SUCCEEDED_NO_COMMIT",
    "SYNTHESIS_STARTED": "SYNTHESIS_STARTED_NO_RESULT", "SOURCES_CLAIMED": "CLAIMED_NO_SYNTHESIS", "CLUSTER_PERSISTED": "CLUSTER_PERSISTED_NO_CLAIM",
    "CLUSTER_SELECTED": "CLUSTER_SELECTED_NO_PERSIST",
}
TERMINAL = ["COMMITTED", "FAILED", "RECOVERED"]
RUN_TERMINAL = ["RUN_COMPLETED", "RUN_FAILED", "RUN_RECONCILED"]
AMBIGUOUS = "CORRUPT_OR_AMBIGUOUS"


# ---------------------------------------------------------------- appending
def identified(events: DataFrame) -> DataFrame:
    """The events with ``event_id``, a hash of what they say; equal events are one."""
    said = events.select(*FIELDS).withColumns({x: F.array_sort(F.coalesce(x, F.array().cast("array<string>"))) for x in ("sources", "claim_sources")})
    said = said.where("run_id <> '' AND event_type IS NOT NULL")
    return said.withColumn("event_id", F.sha2(F.to_json(F.struct(*FIELDS)), 256)).dropDuplicates(["event_id"])


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All events with their ``sequence``, from 1 without gaps, and the ``batch`` they came in; a journal that isn't there is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{SCHEMA}, batch bigint")
    return spark.read.schema(f"{SCHEMA}, batch bigint").parquet(path)


def append(events: DataFrame, path: str, batch: int) -> None:
    """Adds the events that the journal doesn't hold, in order of time and id, as batch ``batch``.

    Batches come one after the other, and only the last may be run again: it is compared with those before it, and
    its table is replaced as a whole.
    """
    spark = events.sparkSession
    held = read_journal(spark, path).where(F.col("batch") < batch)
    new = identified(events).join(held.select("event_id"), "event_id", "left_anti").select(*FIELDS, "event_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = new.repartitionByRange(parts, F.col("timestamp").asc_nulls_first(), "event_id").sortWithinPartitions(F.col("timestamp").asc_nulls_first(), "event_id")
    # a partition's number and a row's place in it, in one written table
    place = F.monotonically_increasing_id()
    ordered = materialize(ordered.withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "journal-batch")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per task
    base = held.agg(F.max("sequence")).first()[0] or 0
    numbered = ordered.join(F.broadcast(before), "part").withColumn("sequence", F.col("place") + F.col("before") + base + 1)
    numbered.select(*FIELDS, "event_id", "sequence").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_stream(events: DataFrame, path: str) -> DataStreamWriter:
    """A writer that appends each micro-batch of a stream of events under the batch's own number."""
    return events.writeStream.foreachBatch(lambda df, batch: append(df, path, batch))


# ---------------------------------------------------------------- reading states
def _id(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def _differ(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_low") != F.col(f"{name}_high"), F.lit(False))


def _only(name: str) -> Column:
    return F.when(~_differ(name), F.col(f"{name}_low"))


def clusters(events: DataFrame) -> DataFrame:
    """``run_id, cluster_id, classification, terminal, blocked, reasons, attempt_id, claim_id, sources, first, last`` from events with ``sequence``."""
    step = F.coalesce(*[F.when(F.col("event_type") == x, n) for x, n in STEPS.items()])
    work = events.withColumn("step", step).where("step IS NOT NULL AND cluster_id <> '' AND run_id IS NOT NULL")
    kind = F.col("event_type")
    one_value = {
        "attempt": _id("attempt_id"), "transaction": _id("transaction_id"), "claim": F.when(kind == "SOURCES_CLAIMED", _id("claim_id")),
        "record": F.when(kind == "CLUSTER_PERSISTED", _id("cluster_record_id")), "sources": F.when(F.size("sources") > 0, F.to_json(F.array_sort("sources"))),
    }
    same_claim = F.coalesce((F.col("claim_attempt") == F.col("attempt_id")) & (F.array_sort("claim_sources") == F.array_sort("sources")), F.lit(False))
    last, first = {n: f"last_{n}" for n in set(STEPS.values())}, {n: f"first_{n}" for n in set(STEPS.values())}
    each = work.groupBy("run_id", "cluster_id").agg(
        *(f(value).alias(f"{x}_{end}") for x, value in one_value.items() for f, end in ((F.min, "low"), (F.max, "high"))),
        *(F.bool_or(kind == x).alias(x) for x in STEPS), F.bool_or((kind == "SOURCES_CLAIMED") & ~same_claim).alias("unclaimed"),
        *(F.min(F.when(F.col("step") == n, F.col("sequence"))).alias(x) for n, x in first.items()),
        *(F.max(F.when(F.col("step") == n, F.col("sequence"))).alias(x) for n, x in last.items()),
        F.min("sequence").alias("first"), F.max("sequence").alias("last"),
    )
    behind = [F.coalesce(F.col(last[a]) > F.col(first[b]), F.lit(False)) for a in last for b in first if a < b]
    reasons = {
        "ATTEMPT_ID_CONFLICT": _differ("attempt"), "CLAIM_CORRELATION_MISMATCH": F.col("unclaimed"), "CLAIM_ID_CONFLICT": _differ("claim"),
        "CLUSTER_EVENT_ORDER_INVALID": reduce(lambda a, b: a | b, behind), "CLUSTER_RECORD_ID_CONFLICT": _differ("record"),
        "SOURCE_IDS_CONFLICT": _differ("sources"), "TRANSACTION_ID_CONFLICT": _differ("transaction"),
    }
    each = each.withColumn("reasons", F.array_compact(F.array(*[F.when(found, code) for code, found in reasons.items()]))).withColumn("blocked", F.size("reasons") > 0)
    meaning = F.when(F.col("blocked"), AMBIGUOUS).otherwise(F.coalesce(*[F.when(F.col(x), state) for x, state in MEANING.items()]))
    return each.withColumn("classification", meaning).select(
        "run_id", "cluster_id", "classification", F.col("classification").isin(TERMINAL).alias("terminal"), "blocked", "reasons", _only("attempt").alias("attempt_id"),
        _only("claim").alias("claim_id"), F.from_json(_only("sources"), "array<string>").alias("sources"), "first", "last",
    )


def _shared(owned: DataFrame, name: str, code: str) -> DataFrame:
    """Runs in which a value belongs to more than one cluster."""
    owners = owned.where(F.col(name).isNotNull()).groupBy("run_id", name).agg(F.min("cluster_id").alias("a"), F.max("cluster_id").alias("b"))
    return owners.where("a <> b").select("run_id", F.lit(code).alias("reason")).distinct()


def runs(events: DataFrame) -> DataFrame:
    """``run_id, classification, complete, blocked, reasons, clusters, incomplete`` from events with ``sequence``; recovery's own events aside."""
    events = events.where("run_id IS NOT NULL AND event_type IS NOT NULL AND NOT startswith(event_type, 'RECOVERY_')")
    each = materialize(clusters(events), "journal-clusters")
    kind, lone = F.col("event_type"), F.coalesce(F.col("cluster_id"), F.lit("")) == ""
    of_cluster = [x for x in STEPS if x != "RUN_RECONCILED"]
    ended = [F.bool_or((kind == x) & F.col("cluster_id").isNull()).alias(x) for x in RUN_TERMINAL]
    misses = kind.isin(of_cluster) | ((kind == "RUN_RECONCILED") & F.col("cluster_id").isNotNull())
    run = events.groupBy("run_id").agg(*ended, F.bool_or(misses & lone).alias("missing"))
    count = each.groupBy("run_id").agg(
        F.count("*").alias("clusters"), F.count_if(~F.col("terminal") & ~F.col("blocked")).alias("incomplete"), F.count_if("blocked").alias("bad"), F.min("classification").alias("only"),
    )
    run = run.join(count, "run_id", "left").na.fill(0, ["clusters", "incomplete", "bad"])
    work = events.where(kind.isin(list(STEPS)) & ~lone).withColumns({"attempt": _id("attempt_id"), "claim": F.when(kind == "SOURCES_CLAIMED", _id("claim_id"))})
    ends = [F.col(x).cast("int") for x in RUN_TERMINAL]
    over = sum(ends[1:], ends[0])
    own = F.array_compact(F.array(
        F.when(F.col("missing"), "MISSING_CLUSTER_CORRELATION"), F.when(over > 1, "RUN_TERMINAL_CONFLICT"),
        F.when((over > 0) & (F.col("incomplete") + F.col("bad") > 0), "RUN_TERMINAL_WITH_NONTERMINAL_CLUSTER"),
    ))
    found = run.select("run_id", F.explode(own).alias("reason")).union(_shared(work, "claim", "CLAIM_ID_SHARED_ACROSS_CLUSTERS")).union(_shared(work, "attempt", "ATTEMPT_ID_SHARED_ACROSS_CLUSTERS"))
    found = found.union(_shared(each.select("run_id", "cluster_id", F.explode("sources").alias("source")), "source", "SOURCE_ASSIGNED_TO_MULTIPLE_CLUSTERS"))
    found = found.union(each.select("run_id", F.explode("reasons").alias("reason")))
    named = found.groupBy("run_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # a dozen codes at most
    run = run.join(named, "run_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))).withColumn("blocked", F.size("reasons") > 0)
    state = (
        F.when(F.col("blocked"), AMBIGUOUS).when(F.col("RUN_COMPLETED") | F.col("RUN_RECONCILED"), "COMPLETE").when(F.col("RUN_FAILED"), "FAILED_COMPLETE")
        .when((F.col("clusters") > 1) & (F.col("incomplete") > 0), "MULTI_CLUSTER_INCOMPLETE")
        .when(F.col("clusters") == 1, F.when(F.col("only") == "COMMITTED", "COMMIT_SUCCEEDED_NO_RUN_COMPLETION").otherwise(F.col("only")))
        .when(F.col("clusters") > 0, "ALL_CLUSTERS_TERMINAL_NO_RUN_COMPLETION").otherwise(AMBIGUOUS)
    )
    run = run.withColumn("classification", state)
    return run.select("run_id", "classification", F.col("classification").isin("COMPLETE", "FAILED_COMPLETE").alias("complete"), "blocked", "reasons", "clusters", "incomplete")
