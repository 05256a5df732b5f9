"""Complete-link clusters of whole components, in blocks of bounded work.

A row joins the first cluster all of whose members it is linked to, in order of id.
That order is sequential inside a component, so a component is cut, by id, into blocks
of at most ``block`` links and rows.  Round r settles the r-th block of every component:

* links to rows of earlier blocks are counted per (row, cluster) by Spark; where the
  count equals the cluster's size, the row is linked to all of it and may join;
* what is left, the links inside the block and those few clusters, meets in one task,
  which passes over the rows once.

So no task holds more than a block, no component is given up for its size, and each link
moves once.  The number of rounds is the links of the largest component over ``block``.
"""

from __future__ import annotations

import time
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.operators.components import connected_components
from quillgrove.session import materialize

#: Links and rows that one task weighs at a time.
BLOCK = 2_000_000
#: Rounds after which the tables of settled rows become one.
COMPACT = 16


@dataclass(frozen=True)
class Budgets:
    """What a component may cost before it is deferred, whole and with its own status; None: no limit.

    ``rows`` and ``links`` of a component (``DEFERRED_DENSE_COMPONENT``), ``comparisons``: links of all components in order
    of their least id, that one and all later ones (``DEFERRED_PAIRWISE_BUDGET``), ``row_links``: smaller rows that one
    row is linked to, which a block can't cut (``DEFERRED_RSS_BUDGET``), ``seconds``: no new round after them
    (``DEFERRED_TIMEOUT``).  ``cluster`` defers a cluster of more rows alone (``DEFERRED_OVERSIZED_CLUSTER``).
    """

    rows: int | None = None
    links: int | None = None
    comparisons: int | None = None
    row_links: int | None = None
    seconds: float | None = None
    cluster: int | None = None


def _by_row(pairs: Iterable[tuple[int, int]]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for row, other in pairs:
        out[row].append(other)
    return out


def first_fits(rows: Iterable[int], links: Iterable[tuple[int, int]], open_to: Iterable[tuple[int, int]] = ()) -> dict[int, int]:
    """row -> first member of its cluster, for the rows of one block.

    ``links`` are (row, smaller row) inside the block, ``open_to`` (row, cluster) for the clusters
    of earlier blocks that the row is linked to as a whole.
    """
    smaller, earlier = _by_row(links), _by_row(open_to)
    name, size, begun = {}, Counter(), set()
    for row in sorted(rows):
        met = Counter(name[x] for x in smaller.get(row, ()))
        fits = [c for c in earlier.get(row, ()) if met[c] == size[c]] + [c for c, n in met.items() if c in begun and n == size[c]]
        first = min(fits, default=row)
        if first == row:
            begun.add(row)
        name[row] = first
        size[first] += 1
    return name


def _solve(block: pd.DataFrame) -> pd.DataFrame:
    of = lambda kind: block.loc[block["kind"] == kind]
    pairs = lambda part: zip(part["row"].tolist(), part["other"].tolist(), strict=True)
    name = first_fits(of("row")["row"].tolist(), pairs(of("link")), pairs(of("cluster")))
    return pd.DataFrame({"id": list(name), "cluster": list(name.values())})


def _settle(rows: DataFrame, links: DataFrame, open_to: DataFrame | None = None) -> DataFrame:
    """``id, cluster`` of one block a component: rows (``component, id``), links inside (``component, hi, lo``), clusters open to a row."""
    parts = rows.selectExpr("component", "'row' AS kind", "id AS row", "id AS other")
    parts = parts.union(links.selectExpr("component", "'link' AS kind", "hi AS row", "lo AS other"))
    if open_to is not None:
        parts = parts.union(open_to.selectExpr("component", "'cluster' AS kind", "hi AS row", "cluster AS other"))
    return materialize(parts.groupBy("component").applyInPandas(_solve, "id long, cluster long"), "complete-link")


def _cut(rows: DataFrame, block: int) -> DataFrame:
    """``component, id, round`` for rows (``component, id, cost``): a range sort, cut where a block is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, spent = None, None, 0
        for batch in batches:
            firsts = []
            for component, row, cost in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if component != at or spent + cost > block:
                    at, first, spent = component, row, 0
                spent += cost
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.int64())], ["component", "id", "first"])

    total = rows.agg(F.sum("cost")).first()[0] or 0
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * block)))
    ordered = rows.select("component", "id", "cost").repartitionByRange(parts, "component", "id").sortWithinPartitions("component", "id")
    cut = materialize(ordered.mapInArrow(run, "component long, id long, first long"), "blocks")
    # one row a block: as many as there are rounds to run
    rounds = cut.select("component", "first").distinct().withColumn("round", F.row_number().over(Window.partitionBy("component").orderBy("first")) - 1)
    return materialize(cut.join(rounds, ["component", "first"]).select("component", "id", "round"), "rounds")


def _beyond(sizes: DataFrame, most: int) -> DataFrame:
    """Components from the one on, in order, at which the running sum of links passes ``most``."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sizes.select("component", "links").repartitionByRange(parts, "component").withColumn("part", F.spark_partition_id()), "running")
    before = dealt.groupBy("part").agg(F.sum("links").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    running = F.sum("links").over(Window.partitionBy("part").orderBy("component"))
    return dealt.withColumn("running", running).join(F.broadcast(before), "part").where(F.col("running") + F.col("before") > most).select("component")


@dataclass(frozen=True)
class Linked:
    """What clusters under any budgets are made from: links, members and sizes of components, each a table written once."""

    rows: DataFrame
    similar: DataFrame
    member: DataFrame
    sizes: DataFrame


def linked(rows: DataFrame, pairs: DataFrame, threshold: float) -> Linked:
    """The links (``lo, hi``) of pairs at or above the threshold, with the rows of their components."""
    similar = pairs.where((F.col("score") >= threshold - 1e-12) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    similar = materialize(similar, "links")
    return Linked(rows, similar, *members(similar, "lo", "hi", similar.groupBy(F.col("hi").alias("id")).agg(F.count("*").alias("links"))))


def members(links: DataFrame, a: str, b: str, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of components (``component, id, links, cost``) and the components' sizes, from links that connect them and each row's number of smaller linked rows."""
    member = connected_components(links, a, b).select(F.col("node").alias("id"), "component")
    member = materialize(member.join(lower, "id", "left").selectExpr("component", "id", "coalesce(links, 0) AS links", "coalesce(links, 0) + 1 AS cost"), "members")
    sizes = materialize(member.groupBy("component").agg(F.count("*").alias("rows"), F.sum("links").alias("links"), F.max("links").alias("most"), F.sum("cost").alias("cost")), "sizes")
    return member, sizes


def complete_link_clusters(
    rows: DataFrame, pairs: DataFrame, threshold: float, least: int = 3, most_links: int | None = None, largest: int | None = None,
    budgets: Budgets | None = None, block: int = BLOCK,
) -> DataFrame:
    """``id, component, cluster, status`` for every row (``id``), from pairs (``a, b, score``) at or above the threshold.

    Repeated pairs count once; pairs of a row with itself and with nulls are left out; an empty table of
    pairs leaves every row unclustered.  ``most_links`` and ``largest`` are short for the budgets of a component's links and rows.
    """
    return clusters_of(linked(rows, pairs, threshold), least, budgets or Budgets(rows=largest, links=most_links), block)


def clusters_of(graph: Linked, least: int = 3, budgets: Budgets | None = None, block: int = BLOCK) -> DataFrame:
    """:func:`complete_link_clusters` of a graph that several budgets share."""
    started = time.monotonic()
    limits = budgets or Budgets()
    rows, similar, member, sizes = graph.rows, graph.similar, graph.member, graph.sizes

    judged = judge(sizes, limits)
    deferred = judged.where("reason IS NOT NULL").select("component", "reason")

    links = similar.join(member.select(F.col("id").alias("hi"), "component"), "hi")
    narrow, wide = judged.where((F.col("cost") <= block) & F.col("reason").isNull()).select("component"), judged.where((F.col("cost") > block) & F.col("reason").isNull()).select("component")
    settled = _settle(member.join(narrow, "component"), links.join(narrow, "component"))
    if not wide.isEmpty():
        dealt = _cut(member.join(wide, "component"), block)
        place = lambda end: dealt.select(F.col("id").alias(end), F.col("round").alias(f"{end}_round"))
        far = materialize(links.join(wide, "component").join(place("hi"), "hi").join(place("lo"), "lo"), "far-links")
        last = dealt.agg(F.max("round")).first()[0]
        done = None
        for r in range(last + 1):
            if limits.seconds is not None and time.monotonic() - started >= limits.seconds:
                late = dealt.where(F.col("round") >= r).select("component").distinct().withColumn("reason", F.lit("DEFERRED_TIMEOUT"))
                deferred = deferred.union(late)
                break
            now = far.where(F.col("hi_round") == r)
            open_to = None
            if done is not None:
                met = now.where(F.col("lo_round") < r).join(done.withColumnRenamed("id", "lo"), "lo").groupBy("component", "hi", "cluster").agg(F.count("*").alias("n"))
                open_to = met.join(done.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").where("n = size")
            new = _settle(dealt.where(F.col("round") == r), now.where(F.col("lo_round") == r), open_to)
            done = new if done is None else done.union(new)
            if r % COMPACT == COMPACT - 1:
                done = materialize(done, "settled")
        if done is not None:
            settled = settled.union(done)

    return statuses(rows, member, settled, deferred, least, limits)


def _over(column: str, limit: int | None) -> Column:
    return F.lit(False) if limit is None else F.col(column) > limit


def judge(sizes: DataFrame, limits: Budgets) -> DataFrame:
    """``component, cost, reason``: why the budgets for rows, links and comparisons defer a component, or null."""
    reason = F.when(_over("rows", limits.rows) | _over("links", limits.links), "DEFERRED_DENSE_COMPONENT").when(_over("most", limits.row_links), "DEFERRED_RSS_BUDGET")
    judged = sizes.withColumn("reason", reason)
    if limits.comparisons is not None:
        late = _beyond(judged.where("reason IS NULL"), limits.comparisons).withColumn("late", F.lit(True))
        judged = judged.join(late, "component", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("late"), "DEFERRED_PAIRWISE_BUDGET")))
    return materialize(judged.select("component", "cost", "reason"), "judged")


def statuses(rows: DataFrame, member: DataFrame, settled: DataFrame, deferred: DataFrame, least: int, limits: Budgets) -> DataFrame:
    """``id, component, cluster, status`` from settled rows (``id, cluster``) and deferred components (``component, reason``)."""
    sized = settled.join(settled.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least), "cluster")
    named = rows.select("id").join(member.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = named.join(deferred, "component", "left").join(sized, "id", "left")
    status = F.coalesce("reason", F.when(_over("n", limits.cluster), "DEFERRED_OVERSIZED_CLUSTER"), F.when(F.col("cluster").isNotNull(), "CLUSTERED"), F.lit("UNCLUSTERED"))
    return named.select("id", "component", "cluster", status.alias("status")).withColumn("cluster", F.when(F.col("status") == "CLUSTERED", F.col("cluster")))


def cohesion(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cluster, n, low, complete``: rows, least score of two members, and whether all n (n - 1) / 2 pairs are there.

    ``pairs`` (``a, b, score``) hold each pair at most once, as those the clusters were made from.
    """
    named = clusters.where("status = 'CLUSTERED'").select("id", "cluster")
    inside = pairs.join(named.toDF("a", "cluster"), "a").join(named.toDF("b", "cluster_b"), "b").where("cluster = cluster_b")
    found = inside.groupBy("cluster").agg(F.min("score").alias("low"), F.count("*").alias("found"))
    each = named.groupBy("cluster").agg(F.count("*").alias("n"))
    return each.join(found, "cluster", "left").select("cluster", "n", "low", (F.coalesce("found", F.lit(0)) == F.expr("n * (n - 1) div 2")).alias("complete"))
