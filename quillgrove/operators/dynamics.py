"""Whole-table updates: decay, energy, entropy, links and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import activation as A
from quillgrove.session import materialize


def decay(rows: DataFrame, rate: float = 0.05) -> DataFrame:
    """Exponential decay of what has been idle for a tenth of a day; structural records stay."""
    moves = (F.col("type") != "structural") & (F.col("idle_days") >= 0.1)
    after = F.when(moves, A.decayed_exponential(F.col("activation"), F.lit(rate), F.col("idle_days"))).otherwise(F.col("activation"))
    return rows.withColumn("activation", after).withColumn("level", A.level(F.col("activation")))


def with_total(rows: DataFrame, **measures) -> DataFrame:
    """Adds the same one-row aggregates to every row: computed once and sent as literals."""
    first = rows.agg(*[m.alias(k) for k, m in measures.items()]).first()
    return rows.withColumns({k: F.lit(first[k]) for k in measures})


def normalise_energy(rows: DataFrame, threshold: float) -> DataFrame:
    scaled = with_total(rows, total=F.sum("activation"))
    factor = F.when(F.col("total") > threshold, threshold / F.col("total")).otherwise(1.0)
    return scaled.withColumn("activation", F.col("activation") * factor).drop("total")


def stabilise(rows: DataFrame, target: float = 100.0) -> DataFrame:
    """Scales towards the target by at most a fifth; small changes and structural rows are left."""
    scaled = with_total(rows, total=F.sum("activation"))
    factor = A.clamp(F.lit(target) / F.col("total"), 0.8, 1.2)
    after = A.clamp(F.col("activation") * factor, 0.01, 1.0)
    moves = (F.col("type") != "structural") & (F.abs(F.col("total") - target) > 0.1) & (F.abs(after - F.col("activation")) > 0.01)
    out = scaled.withColumns({"changed": F.coalesce(moves, F.lit(False)), "after": F.when(moves, after).otherwise(F.col("activation"))})
    return out.withColumn("level", A.level(F.col("after"))).drop("total")


def rebalance(rows: DataFrame, least_entropy: float = 0.5) -> DataFrame:
    """Where the normalised Shannon entropy of shares is low, strong rows shrink and weak rows grow."""
    total = rows.agg(F.sum("activation").alias("t"), F.count("*").alias("n")).first()
    share = F.col("activation") / F.lit(total.t)
    entropy = rows.where("activation > 0").agg(F.sum(-share * F.log2(share)).alias("h")).first().h or 0.0
    import math

    h = entropy / math.log2(total.n) if total.n > 1 else 0.0
    r = (1 - h) * 0.1
    if h >= least_entropy:
        return rows.withColumns({"after": F.col("activation"), "entropy": F.lit(h)})
    after = F.when(F.col("activation") > 0.5, F.col("activation") * (1 - r)).when(F.col("activation") < 0.2, F.col("activation") * (1 + r))
    return rows.withColumns({"after": after.otherwise(F.col("activation")), "entropy": F.lit(h)})


def inject(rows: DataFrame, amount: float) -> DataFrame:
    n = rows.count()
    return rows.withColumn("activation", F.least(F.lit(1.0), F.col("activation") + amount / max(1, n)))


def cap_links(links: DataFrame, rows: DataFrame) -> DataFrame:
    """The strongest links of each source: three, and one more per tenth of its activation."""
    owned = links.join(rows.select(F.col("id").alias("source_id"), "activation"), "source_id")
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id"))
    return owned.withColumn("nth", nth).where(F.col("nth") <= 3 + F.floor(F.col("activation") * 10)).drop("nth")


def maintain_links(links: DataFrame, rows: DataFrame, least: float = 0.05) -> DataFrame:
    """Weak links go, then links without a source, then those over the cap."""
    return cap_links(links.where(F.col("weight") >= least), rows)


def merge_links(links: DataFrame) -> DataFrame:
    """One link per unordered pair: mean weight, summed count."""
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    return links.groupBy(a.alias("a"), b.alias("b")).agg(F.avg("weight").alias("weight"), F.sum("reinforced").alias("reinforced"))


def propagate(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Each link adds the smaller of a share of its source and a share of its target."""
    source = rows.select(F.col("id").alias("source_id"), F.col("activation").alias("from_activation"))
    target = rows.select(F.col("id").alias("target_id"), F.col("activation").alias("to_activation"))
    gain = F.least(F.col("from_activation") * F.col("weight") * 0.4, F.col("to_activation") * 0.3)
    gains = links.join(source, "source_id").join(target, "target_id").groupBy("target_id").agg(F.sum(gain).alias("gain"))
    joined = rows.join(gains.withColumnRenamed("target_id", "id"), "id", "left")
    return joined.withColumn("after", F.least(F.lit(1.0), F.col("activation") + F.coalesce("gain", F.lit(0.0)))).drop("gain")


def reinforce(rows: DataFrame, picked: DataFrame, links: DataFrame) -> DataFrame:
    """Picked rows gain .03 and an access; their neighbours gain .01 of the strongest link's weight."""
    hit = picked.select("id").distinct()
    both = links.select("source_id", "target_id", "weight").union(links.select("target_id", "source_id", "weight"))
    near = both.join(hit.withColumnRenamed("id", "source_id"), "source_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.max("weight").alias("near"))
    marked = rows.join(hit.withColumn("hit", F.lit(True)), "id", "left").join(near, "id", "left")
    gain = F.when(F.col("hit"), 0.03).otherwise(F.coalesce(F.col("near") * 0.01, F.lit(0.0)))
    count = F.col("access_count") + F.when(F.col("hit"), 1).otherwise(0)
    return marked.withColumns({"after": F.least(F.lit(1.0), F.col("activation") + gain), "access_after": count}).drop("hit", "near")


def bump_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """A pair's link gains .1 where it exists in either direction, else one of weight .5 is made."""
    key = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")]
    old = links.groupBy(*key).agg(F.max("weight").alias("old"))
    new = pairs.select(*key).distinct().withColumn("new", F.lit(True))
    weight = F.when(F.col("old").isNull(), 0.5).when(F.col("new"), F.least(F.lit(1.0), F.col("old") + 0.1)).otherwise(F.col("old"))
    return old.join(new, ["a", "b"], "full").select("a", "b", weight.alias("weight"))


def lifecycle(rows: DataFrame) -> DataFrame:
    """Adds ``state`` from activation, idle days and the event counts (null counts are none)."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("echoes", "promoted", "suppressed")}
    act = F.col("activation")
    state = (
        F.when(n["suppressed"] >= 1, "SUPPRESSED").when((act <= 0.03) & (F.col("idle_days") >= 90), "DECAYED")
        .when(F.coalesce(F.col("gate"), F.lit(False)) & ((act >= 0.7) | (n["promoted"] >= 1)), "CONSCIOUS")
        .when((act >= 0.7) | (n["promoted"] >= 1) | (F.coalesce(F.col("energy"), F.lit(0.0)) >= 2), "HOT")
        .when((act >= 0.2) | (n["echoes"] >= 1), "WARM").otherwise("COLD")
    )
    return rows.withColumn("state", state)


def echo_states(events: DataFrame) -> DataFrame:
    """The event log folded per record: counts, score sums, latest instants, concepts."""
    promoted = F.col("kind") == "promoted"
    return events.groupBy("memory_id").agg(
        F.count_if(F.col("kind").isin("echoed", "promoted")).alias("echoes"),
        F.count_if(promoted).alias("promoted"),
        F.count_if(F.col("kind") == "suppressed").alias("suppressed"),
        F.max("ts").alias("last_ts"),
        F.max(F.when(promoted, F.col("ts"))).alias("last_promoted"),
        F.sum("echo_score").alias("energy"),
        F.max("echo_score").alias("top_echo"),
        F.array_sort(F.collect_set("concept")).alias("concepts"),
    )


def echo_memory_updates(states: DataFrame, rows: DataFrame, idle_days: float = 30) -> DataFrame:
    """``memory_id, step, action, delta``: what the folded log calls for, and the decay of records that it has nothing of.

    Steps 1 to 3 are of records with a state, 4 of records without one that have been
    idle so long or since an unknown time.  A null id gets no update.
    """
    ratio = F.col("promoted") / F.greatest(F.col("echoes"), F.lit(1))
    rules = [
        (1, "increase_latent_presence", (F.col("echoes") >= 5) & (ratio <= 0.2), 0.02),
        (2, "allow_orbit_lift", (F.col("promoted") >= 3) & (ratio >= 0.5), 0.015),
        (3, "temporary_inhibition", F.col("suppressed") >= 3, -0.08),
    ]
    made = [F.when(c, F.struct(F.lit(k).alias("step"), F.lit(n).alias("action"), F.lit(d).alias("delta"))) for k, n, c, d in rules]
    echoed = states.where("memory_id IS NOT NULL").select("memory_id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("e")).select("memory_id", "e.*")
    idle = rows.where(F.col("id").isNotNull() & (F.coalesce(F.col("idle_days"), F.lit(idle_days)) >= idle_days)).select(F.col("id").alias("memory_id"))
    dormant = idle.join(states.select("memory_id"), "memory_id", "left_anti")
    return echoed.union(dormant.select("memory_id", F.lit(4), F.lit("slow_dormant_decay"), F.lit(-0.01)))


def echo_link_updates(states: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """``source_id, target_id, concepts``: semantic links whose ends both echo often and share a concept.

    Only linked pairs can be reinforced, so the links are joined with both ends' states:
    no pairs of a concept are listed.  A pair with several semantic links counts once.
    """
    often = states.where((F.col("echoes") >= least) & (F.size("concepts") > 0)).select("memory_id", "concepts")
    semantic = links.where("link_type = 'semantic' AND source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    pairs = semantic.agg(F.min(F.struct("source_id", "target_id")).alias("link"))
    ends = pairs.join(often.select(F.col("memory_id").alias("a"), F.col("concepts").alias("mine")), "a").join(often.select(F.col("memory_id").alias("b"), F.col("concepts").alias("theirs")), "b")
    return ends.select("link.*", F.array_sort(F.array_intersect("mine", "theirs")).alias("concepts")).where(F.size("concepts") > 0)


def echo_plan(states: DataFrame, rows: DataFrame, links: DataFrame, memory_cap: int = 50, link_cap: int = 25) -> DataFrame:
    """``part, action, memory_id, target_id, delta``: the first updates by id, those of the log before dormant ones.

    The caps are the policy's own: ``echo_plan_counts`` says how many updates wait.
    """
    records = echo_memory_updates(states, rows).orderBy(F.col("step") == 4, "memory_id", "step").limit(memory_cap)
    joined = echo_link_updates(states, links).orderBy(F.least("source_id", "target_id"), F.greatest("source_id", "target_id")).limit(link_cap)
    return records.select(F.lit("memory").alias("part"), "action", "memory_id", F.lit(None).cast("long").alias("target_id"), "delta").union(
        joined.select(F.lit("link"), F.lit("reinforce_semantic_link"), "source_id", "target_id", F.lit(0.02))
    )


def echo_plan_counts(states: DataFrame, rows: DataFrame, links: DataFrame, memory_cap: int = 50, link_cap: int = 25) -> DataFrame:
    """``part, planned, skipped``: how many updates of the plan the caps take and leave."""
    parts = [("memory", echo_memory_updates(states, rows), memory_cap), ("link", echo_link_updates(states, links), link_cap)]
    counted = [df.agg(F.lit(p).alias("part"), F.least(F.count("*"), F.lit(c)).alias("planned"), F.greatest(F.count("*") - c, F.lit(0)).alias("skipped")) for p, df, c in parts]
    return counted[0].union(counted[1])


def co_echo_pairs(states: DataFrame, least: int = 3, block: int = 1024) -> DataFrame:
    """``a, b, shared``: pairs of records that echoed often, with the number of concepts they share.

    Records (one row each) of equal concepts form a class: what two classes share is counted once, by an
    equi-join on the concept, and holds for all pairs of their members.  Members meet as blocks of ids, a
    class of any size in as many tasks as there are pairs of its blocks; the pairs themselves are neither
    shuffled nor grouped, and a task holds those of one record and one block at a time.
    """
    often = states.where((F.col("echoes") >= least) & F.col("memory_id").isNotNull() & (F.size("concepts") > 0)).select("memory_id", "concepts")
    often = materialize(often, "often-echoed")
    sized = often.groupBy("concepts").agg(F.ceil(F.count("*") / block).alias("blocks"))
    classes = materialize(sized.withColumn("class", F.sha2(F.to_json("concepts"), 256)), "concept-classes")
    dealt = often.join(classes, "concepts").withColumn("block", F.pmod(F.xxhash64("memory_id"), F.col("blocks")))
    blocks = materialize(dealt.groupBy("class", "block").agg(F.collect_list("memory_id").alias("ids")), "echo-blocks")
    each = classes.select("class", F.explode(F.array_distinct("concepts")).alias("concept"))
    met = each.withColumnRenamed("class", "x").join(each.withColumnRenamed("class", "y"), "concept").where("x <= y")
    shared = met.groupBy("x", "y").agg(F.count("*").alias("shared"))
    left, right = blocks.toDF("x", "i", "ids"), blocks.toDF("y", "j", "ids2")
    pairs = shared.join(left, "x").join(right, "y").where("x < y OR i <= j")
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.repartition(parts, "x", "i", "y", "j").withColumn("same", F.expr("x = y AND i = j"))
    # counted rows pass one by one: without that both lists are unfolded in one piece of generated code, which holds all pairs of two blocks before it gives the first
    each = spread.select("shared", "same", "ids2", F.explode("ids").alias("u")).observe("echo-rows", F.count(F.lit(1)).alias("n"))
    members = each.select("shared", "same", "u", F.explode("ids2").alias("v")).where("NOT same OR u < v")
    return members.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "shared")


def select_candidates(rows: DataFrame, limit: int) -> DataFrame:
    """Adds ``decision`` and ``reason``: ordered rules, then duplicates, then the limit."""
    own = (
        F.when(F.col("id").isNull(), "INVALID_ID").when(F.col("memory_kind") == "super_memory", "ALREADY_SUPER")
        .when(F.col("processing_state") == "consolidated", "ALREADY_CONSOLIDATED").when(F.col("processing_state") != "raw", "IN_PROCESS")
        .when(F.col("storage_tier") == "deep", "DEEP_TIER").when(F.coalesce(F.trim("text"), F.lit("")) == "", "EMPTY_TEXT")
    )
    hashed = rows.withColumn("content_hash", F.sha2(F.col("text"), 256)).withColumn("_own", own)
    same_id = F.row_number().over(Window.partitionBy("id").orderBy("content_hash"))
    numbered = hashed.withColumn("_id_n", same_id)
    same_text = F.row_number().over(Window.partitionBy("content_hash", F.col("_id_n") == 1).orderBy("id"))
    numbered = numbered.withColumn("_text_n", same_text)
    reason = (
        F.when(F.col("_id_n") > 1, "DUPLICATE_ID").when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_text_n") > 1, "DUPLICATE_CONTENT")
    )
    ruled = numbered.withColumn("reason", reason)
    # only the first rows by id are eligible: a top-k decides where the limit falls
    last = ruled.where("reason IS NULL").select("id").orderBy("id").limit(limit).agg(F.max("id").alias("m"), F.count("*").alias("n")).first()
    over = F.lit(last.n == limit) & F.col("reason").isNull() & (F.col("id") > F.lit(last.m))
    decision = F.when(F.col("reason").isNotNull(), "excluded").when(over, "deferred").otherwise("eligible")
    return ruled.withColumns({"decision": decision, "reason": F.when(over, "LIMIT_EXPLICITLY_APPLIED").otherwise(F.coalesce("reason", F.lit("ELIGIBLE")))}).drop(
        "_own", "_id_n", "_text_n"
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Each incoming key as created, replayed (same digest) or conflict."""
    old = existing.select(key, F.col(digest).alias("_old"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col(digest), "replayed").otherwise("conflict")
    return incoming.join(old, key, "left").withColumn("outcome", kind).drop("_old")


def merge_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
