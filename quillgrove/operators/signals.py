"""Concept scores, related records, entities, labels, validation and discovery certificates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import activation as A
from quillgrove.functions import text as X
from quillgrove.operators.overlap_search import best_overlaps, millionths
from quillgrove.session import discard, materialize


def concept_echo(rows: DataFrame, query: str, concepts: list[str], noise: list[str] = ()) -> DataFrame:
    """Adds ``echo``: coverage and density of concepts and matching tags, less penalties for noise phrases and for echoing the query."""
    text = X.concept_text(F.col("text"))
    n = max(1, len(concepts))
    matched = reduce(lambda a, b: a + b, (F.contains(text, F.lit(f" {c} ")).cast("int") for c in concepts), F.lit(0))
    words = F.size(F.split(F.trim(text), " "))
    density = F.least(F.lit(0.25), matched / F.greatest(F.lit(8), words) * 4)
    tags = F.size(F.array_intersect(F.transform("tags", F.lower), F.array(*map(F.lit, concepts)))) / n
    noisy = F.least(F.lit(0.35), reduce(lambda a, b: a + b, (F.contains(text, F.lit(p)).cast("int") * 0.08 for p in noise), F.lit(0.0)))
    asked = X.normalised(F.lit(query))
    said = X.normalised(F.col("text"))
    copied = F.when(said == asked, 0.35).when(F.contains(said, asked) & (F.length(said) <= F.length(asked) + 30), 0.25).otherwise(0.0)
    return rows.withColumn("echo", A.clamp(matched / n * 0.35 + density + F.least(F.lit(1.0), tags) * 0.2 - noisy - copied))


def search_articles(rows: DataFrame, words: list[str], least_year: int, limit: int) -> DataFrame:
    """Rows in which every word is in the title or the abstract, newest first, undated last."""
    fits = reduce(lambda a, b: a & b, (F.ilike("title", F.lit(f"%{w}%")) | F.ilike("abstract", F.lit(f"%{w}%")) for w in words if len(w) > 2), F.lit(True))
    dated = F.col("year").isNull() | (F.col("year") >= least_year)
    return rows.where(fits & dated).orderBy(F.desc_nulls_last("year"), "id").limit(limit)


def related(new: DataFrame, rows: DataFrame, least: float = 0.25, k: int = 3) -> DataFrame:
    """The k rows most related to each new row by Jaccard similarity of their tokens.

    Overlaps are counted for blocks of new rows and rows (:mod:`overlap_search`), so nothing is made per pair and token.
    """

    def token_set(df: DataFrame) -> DataFrame:
        tokens = F.coalesce(X.index_tokens(F.col("text")), F.array().cast("array<string>"))
        return df.select("id", F.lit(0).alias("order"), tokens.alias("tokens")).withColumn("n", F.size("tokens"))

    def rough(c: dict, r: dict, q: dict) -> np.ndarray:
        about = r["n"] + q["n"] - c["tokens"]
        np.divide(c["tokens"], np.maximum(about, 1, out=about), out=about)
        about *= 1e6
        return np.where((c["tokens"] > 0) & (about >= least * 1e6 - 4), about, np.float32(-1))

    def exact(c: dict, r: dict, q: dict) -> np.ndarray:
        score = millionths(c["tokens"], r["n"] + q["n"] - c["tokens"])
        return np.where(score / 1e6 >= least, score, -1)

    return best_overlaps(token_set(new), token_set(rows), ["tokens"], ["n"], rough, exact, k)


def related_by_signals(new: DataFrame, rows: DataFrame, k: int = 3, near: float = 0.25, near_long: float = 0.18, long_tokens: int = 12) -> DataFrame:
    """``new_id, id, score``: the k rows most related to each new row by entities, strong tags and tokens.

    ``id, ts, temporary, tokens, entities, tags``: a shared entity counts 3, two shared
    tags count 2, and the Jaccard similarity of the tokens is added; a row with none of
    these (the similarity counts from ``near`` on, from ``near_long`` where one text has
    many tokens) isn't related.  Where either row is temporary, only a shared entity
    relates them.  Of equal scores the latest counts first, then the smallest id.

    Overlaps of all three kinds are counted for blocks of new rows and rows (:mod:`overlap_search`).  Null
    lists are empty, a null id is left out, repeated entries of a list count once.
    """

    def side(df: DataFrame) -> DataFrame:
        lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tokens", "entities", "tags")}
        sets = {c: F.array_distinct(x) for c, x in lists.items()}
        order = F.unix_micros(F.col("ts").cast("timestamp")) if dict(df.dtypes)["ts"].startswith(("timestamp", "date")) else F.col("ts")
        facts = {"n": F.size(lists["tokens"]), "distinct": F.size(sets["tokens"]), "temporary": F.coalesce("temporary", F.lit(False)).cast("int")}
        return df.select("id", order.alias("order"), *(x.alias(c) for c, x in (sets | facts).items()))

    def parts(c: dict, r: dict, q: dict, number: type) -> tuple[np.ndarray, ...]:
        union = np.maximum(1, r["distinct"] + q["distinct"] - c["tokens"])
        limit = np.where(np.maximum(r["n"], q["n"]) >= long_tokens, number(near_long), number(near))
        return union, c["entities"] > 0, c["tags"] >= 2, limit, (r["temporary"] + q["temporary"]) == 0

    def rough(c: dict, r: dict, q: dict) -> np.ndarray:
        union, entity, tags, limit, lasting = parts(c, r, q, np.float32)
        alike = c["tokens"] / union
        kept = entity | ((tags | (alike >= limit - 4e-6)) & lasting)
        alike *= 1e6
        alike += np.where(entity, np.float32(3e6), np.float32(0))
        alike += np.where(tags, np.float32(2e6), np.float32(0))
        return np.where(kept, alike, np.float32(-1))

    def exact(c: dict, r: dict, q: dict) -> np.ndarray:
        union, entity, tags, limit, lasting = parts(c, r, q, float)
        kept = entity | ((tags | (c["tokens"] / union >= limit)) & lasting)
        return np.where(kept & ((c["tokens"] > 0) | entity | (c["tags"] > 0)), entity * 3_000_000 + tags * 2_000_000 + millionths(c["tokens"], union), -1)

    return best_overlaps(side(new), side(rows), ["tokens", "entities", "tags"], ["n", "distinct", "temporary"], rough, exact, k)


def repeated_groups(rows: DataFrame, pairs: DataFrame, least: int = 3, days: int = 30) -> DataFrame:
    """Groups of a row and its later similar rows, large enough and within the span (``id, day`` rows)."""
    later = pairs.select("a", "b").join(rows.select(F.col("id").alias("b"), F.col("day").alias("day_b")), "b")
    ends = later.groupBy("a").agg((F.count("*") + 1).alias("n"), F.min("day_b").alias("low"), F.max("day_b").alias("high"))
    whole = ends.join(rows.select(F.col("id").alias("a"), "day"), "a")
    span = F.greatest("high", "day") - F.least("low", "day")
    return whole.withColumn("span", span).where((F.col("n") >= least) & (F.col("span") < days)).select("a", "n", "span")


def split_clusters(rows: DataFrame, key: str, threshold: float = 0.6, least: int = 3) -> DataFrame:
    """``key, id, part``: a cluster's rows in order of id join the first part they are on average similar enough to.

    Parts under ``least`` rows are dropped; a cluster that gives one part only stays
    whole (part 0).  A sorted stream: a task holds a sum per part, never a cluster's rows.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, sums, counts = None, False, [], []
        for batch in batches:
            parts = []
            for k, unit in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or k != now:
                    now, started, sums, counts = k, True, [], []
                u = np.array(unit)
                part = next((p for p, s in enumerate(sums) if u @ s / counts[p] > threshold), len(sums))
                if part == len(sums):
                    sums.append(np.zeros(len(u)))
                    counts.append(0)
                sums[part] += u
                counts[part] += 1
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int64())], [key, "id", "_part"])

    stream = rows.select(key, "id", "unit").repartition(F.col(key)).sortWithinPartitions(key, "id")
    dealt = materialize(stream.mapInArrow(run, f"{key} {kind}, id long, _part long"), "cluster-parts")
    good = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key, "_part")
    several = good.groupBy(key).agg(F.count("*").alias("_k")).where("_k > 1").select(key)
    part = F.row_number().over(Window.partitionBy(key).orderBy("_part")) - 1
    numbered = good.join(several, key).withColumn("part", part.cast("long"))
    split = dealt.join(numbered, [key, "_part"]).select(key, "id", "part")
    return split.union(dealt.join(several, key, "left_anti").select(key, "id", F.lit(0).cast("long").alias("part")))


def round_robin(rows: DataFrame, offset: int, size: int) -> tuple[DataFrame, int]:
    """(the next ``size`` rows in order of id from a cursor's offset on, going round at the end; the next offset).

    Places come from a count per range of ids, so no task sees all rows.
    """
    total = rows.count()
    if not total:
        return rows, 0
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "cursor-ranges")
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1)
    before, bases = 0, []
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # one row a task
        bases.append((r["_part"], before))
        before += r["count"]
    places = within.join(F.broadcast(rows.sparkSession.createDataFrame(bases, "_part int, _base long")), "_part")
    place = F.pmod(F.col("_base") + F.col("_n") - F.lit(offset), F.lit(total))
    return places.where(place < size).drop("_part", "_n", "_base"), (offset + min(size, total)) % total


def dominant(shares: Column, neutral: float = 0.2, near: float = 0.06) -> Column:
    """Up to two strongest names of an array of (share, name) structs: none strong is neutral, a close second is named too."""
    order = F.reverse(F.array_sort(shares))
    first, second = F.get(order, 0), F.get(order, 1)
    close = second.isNotNull() & (first["share"] - second["share"] <= near)
    return F.when(first.isNull() | (first["share"] < neutral), "neutral").when(close, F.concat_ws("+", first["name"], second["name"])).otherwise(first["name"])


def validate(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with ``reason``: the first rule that holds rejects."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def prune_cold_links(links: DataFrame, cold: DataFrame, keep: int = 3) -> DataFrame:
    """Links without those beyond the strongest ``keep`` of a cold row at either end."""
    key = ["source_id", "target_id"]
    ends = links.select(*key, "weight", F.explode(F.array("source_id", "target_id")).alias("id")).join(cold.select("id"), "id")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), *key))
    return links.join(ends.withColumn("nth", nth).where(F.col("nth") > keep).select(*key).distinct(), key, "left_anti")


def prune_cold_links_in_order(links: DataFrame, cold: DataFrame, keep: int = 3) -> DataFrame:
    """Links left after each cold row in turn, by id, has dropped all but its strongest ``keep`` of those left then.

    Rounds instead of a loop over the rows.  A row with at most ``keep`` links left will drop none, whenever its turn is, as links
    only go; so of the others a row may take its turn as soon as no smaller one of them shares a link with it, and no two
    rows that take theirs in one round share a link.  Equal weights go by source and target, null weights are weakest; repeated links
    are one, of their greatest weight, and stay or go together.  Links with a null end, or between rows that aren't cold, stay.
    """
    key = ["source_id", "target_id"]
    whole = links.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    left = materialize(whole.groupBy(*key).agg(F.max("weight").alias("weight")), "cold-links")
    turn, before = cold.select("id").where("id IS NOT NULL").distinct(), []
    while True:
        ends = left.select(*key, "weight", F.explode(F.array_distinct(F.array(*key))).alias("id"))
        turn = materialize(ends.join(turn, "id").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > keep).select("id"), "turns")
        if turn.isEmpty():
            break
        shared = left.where("source_id <> target_id").join(turn.toDF("source_id"), "source_id").join(turn.toDF("target_id"), "target_id")
        ready = turn.join(shared.select(F.greatest(*key).alias("id")).distinct(), "id", "left_anti")
        own = materialize(ends.join(ready, "id"), "turn-links")
        nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("weight"), *key))
        lost = own.join(own.withColumn("nth", nth).where(F.col("nth") <= keep).select(*key), key, "left_anti").select(*key)
        after = materialize(left.join(lost, key, "left_anti"), "cold-links")
        for table in (*before, left, own):
            discard(table)
        left, before = after, [turn]
    gone = whole.select(*key).distinct().join(left, key, "left_anti")
    return links.join(gone, key, "left_anti")


def certificates(found: DataFrame, cap: int, model: str) -> DataFrame:
    """Discovery certificates (``id, hits, model, expected``) as valid or not, with the first reason against."""
    reason = (
        F.when(F.col("hits").isNull(), "ABSENT").when(F.col("model") != model, "OTHER_MODEL").when(F.col("hits") < 0, "NEGATIVE_COUNT")
        .when(F.col("hits") > cap, "TRUNCATED").when(F.col("hits") != F.col("expected"), "COUNT_MISMATCH").otherwise("OK")
    )
    return found.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "OK", "VALID").when(F.col("reason") == "ABSENT", "ABSENT").otherwise("INVALID"))


def point_identity(*fields: str) -> Column:
    """A name-based identifier in the form of a UUID, from the hash of the fields."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), F.conv(cut(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


_NAME = re.compile(r"[A-ZÀ-Ý][\w'’]+(?:\s+[A-ZÀ-Ý][\w'’]+){0,2}")


def entities_of(text: str | None) -> dict[str, int]:
    """Runs of up to three capitalised words with counts; a lone word that opens a sentence isn't one."""
    out: dict[str, int] = {}
    for m in _NAME.finditer(text or ""):
        before = m.start()
        while before and text[before - 1].isspace():
            before -= 1
        opens = before == 0 or text[before - 1] in ".!?\n"
        name = m[0]
        if opens:
            name = " ".join(name.split()[1:])
        if name:
            out[name] = out.get(name, 0) + 1
    return out


def entities(rows: DataFrame) -> DataFrame:
    """``id, entity, n`` of every text, a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, e, n) for i, t in zip(pdf["id"], pdf["text"], strict=True) for e, n in entities_of(t).items()], columns=["id", "entity", "n"])

    return rows.select("id", "text").mapInPandas(run, "id long, entity string, n long")


def cut_repeats(text: str, most: int = 12) -> str:
    """A text up to where a block of up to ``most`` lines repeats the block before it."""
    lines = text.split("\n")
    for end in range(2, len(lines) + 1):
        for w in range(1, min(most, end // 2) + 1):
            if lines[end - w : end] == lines[end - 2 * w : end - w] and any(x.strip() for x in lines[end - w : end]):
                return "\n".join(lines[: end - w])
    return text


def distinct_bullets(text: str, most: int = 12) -> list[str]:
    """List entries of a text, without those that equal or contain one another."""
    out: list[str] = []
    for line in text.split("\n"):
        if m := re.match(r"\s*(?:[-*•]|\d+[.)])\s+(.*\S)", line):
            low = m[1].lower()
            if not any(low in x.lower() or x.lower() in low for x in out):
                out.append(m[1])
    return out[:most]
