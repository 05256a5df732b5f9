"""Row shapes for other readers: graph nodes and links, cold records, articles, roles, times, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What writers call the roles.
ROLE_NAMES = {"user": ["user", "utente", "human"], "assistant": ["assistant", "assistente", "ai", "bot"], "system": ["system"]}


def one_of(value: Column, *names: str) -> Column:
    return F.when(value.isin(*names), value).otherwise("unknown")


def graph_nodes(rows: DataFrame) -> DataFrame:
    """``id, label, role, orbit, depth, activation`` from ``id, text, role, orbit, memory_depth, activation``."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\f\\r]+", " "))
    source = F.coalesce(F.when(flat != "", flat), F.col("id").cast("string"), F.lit("memory"))
    label = F.when(F.length(source) > 80, F.concat(F.substring(source, 1, 77), F.lit("..."))).otherwise(source)
    return rows.select(
        F.coalesce(F.col("id").cast("string"), F.lit("unknown")).alias("id"), label.alias("label"), one_of(F.col("role"), "user", "assistant").alias("role"),
        one_of(F.col("orbit"), "short", "medium", "long").alias("orbit"), one_of(F.col("memory_depth"), "temporary", "normal", "deep").alias("depth"), "activation",
    )


def graph_links(links: DataFrame) -> DataFrame:
    """``id, source, target, weight, type``; ids and types that are absent get defaults, a weight that is no number is null."""
    end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    ident = F.coalesce(F.col("id").cast("string"), F.concat_ws("_", end("source_id"), end("target_id")))
    return links.select(ident.alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("weight").try_cast("double").alias("weight"), F.coalesce("link_type", F.lit("unknown")).alias("type"))


def compressed(rows: DataFrame) -> DataFrame:
    """What a cold record keeps."""
    return rows.select("id", "user_id", "type", "text", "activation", "orbit", "timestamp", F.lit(True).alias("cold"))


def articles(rows: DataFrame, scope: str) -> DataFrame:
    """Articles with defaults; the source's name comes out of its struct."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "content", "url")]
    return rows.select("id", *texts, "image", "published_at", F.coalesce(F.col("source.name"), F.lit("unknown")).alias("source"), F.lit(scope).alias("scope"))


def _role_of(value: Column) -> Column:
    plain = F.trim(F.lower(value))
    out = F.lit(None).cast("string")
    for role, names in ROLE_NAMES.items():
        out = F.when(plain.isin(*names), role).otherwise(out)
    return out


def role(candidates: list[str], tags: str) -> Column:
    """The first of the candidates that names a role, else the first such tag, else unknown."""
    from_tags = F.get(F.filter(F.transform(tags, _role_of), lambda r: r.isNotNull()), 0)
    return F.coalesce(*(_role_of(F.col(c)) for c in candidates), from_tags, F.lit("unknown"))


def recorded_status(contract: Column, stamp: Column) -> Column:
    """Only records of the flat layout have a time that counts."""
    valid = stamp.try_cast("bigint")
    return F.when(contract != "flat", "UNSUPPORTED_SOURCE_CONTRACT").when(stamp.isNull(), "MISSING").when(valid.isNull() | (valid < 0), "INVALID").otherwise("VALID")


def age_status(rows: DataFrame, now_ms: int) -> DataFrame:
    """Rows with derived columns of time: age in hours, its band, whether it is fresh."""
    hours = F.floor((F.lit(now_ms) - F.col("ts_ms")) / 3_600_000)
    band = F.when(F.col("age_hours") < 24, "today").when(F.col("age_hours") < 168, "week").otherwise("older")
    return rows.withColumn("age_hours", hours).withColumn("age_band", band).withColumn("fresh", F.col("age_hours") < 72)


def import_report(rows: DataFrame) -> DataFrame:
    """One row: how many rows, of which role, without text, and the first and last time."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"), F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"),
    )


def scan_stats(files: DataFrame) -> DataFrame:
    """Per root: files, bytes, the largest, folders, greatest depth, and how many a size limit leaves out (``skipped``)."""
    return files.groupBy("root").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.max("size").alias("largest"), F.count_distinct("folder").alias("n_folders"), F.max("depth").alias("max_depth"), F.count_if("skipped").alias("n_skipped")
    )


def domain_hits(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``domain, hits``: in how many rows' paths a rule's pattern is found."""
    found = [F.struct(F.lit(name).alias("domain"), F.rlike("path", F.lit(pattern)).alias("hit")) for name, pattern in rules.items()]
    return rows.select(F.explode(F.array(*found)).alias("f")).where("f.hit").groupBy("f.domain").agg(F.count("*").alias("hits"))


def import_rows(messages: DataFrame, size: int) -> DataFrame:
    """``id, before, link_type, chunk``: messages cut into chunks, with links to the chunk or message before.

    Ids are 24 hex digits of a hash of conversation, turn and chunk; ``continuation`` links
    chunks of one message, ``dialogue_sequence`` the first chunk to the last of the message before.
    """
    length = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    cut = messages.withColumn("chunk", F.explode(F.sequence(F.lit(0), length - 1)))
    named = cut.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "conv_id", "turn", "chunk"), 256), 1, 24))
    near = Window.partitionBy("conv_id").orderBy("turn", "chunk")
    out = named.withColumn("before", F.lag("id").over(near))
    kind = F.when(F.col("before").isNull(), F.lit(None)).when(F.col("chunk") > 0, "continuation").otherwise("dialogue_sequence")
    return out.select("id", "before", kind.alias("link_type"), "chunk", F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def newest_first_k(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered as ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= k)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
