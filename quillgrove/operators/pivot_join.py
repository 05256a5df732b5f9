"""Exact threshold joins of unit vectors through pivot shards, and candidate edges under a budget.

``pivot_pairs``      all pairs at or above a cosine threshold.
``shard_report``     what the shards' bounds spare: comparisons made against all pairs.
``candidate_edges``  one row per unordered pair of observations, with the highest score.
``edge_budgets``     whether the edges keep within each budget; a graph over it is deferred whole.

Angles are a metric on unit vectors.  Every vector belongs to its nearest pivot's shard;
a shard's radius is the widest angle of its members.  A vector can only be similar to a
member of a shard if its angle to the pivot is at most the radius and the threshold's
angle together, so it asks those shards alone (of two shards the later asks the
earlier).  Inside a shard, members whose own angle differs by more than the threshold's
angle from all that ask are left out.  Shards are dealt in groups, and a vector moves once for each
group that it asks (:mod:`pair_grid`); a task holds one group and a batch of those that ask.

At most ``MOST_PIVOTS`` vectors come to the driver.  In spaces of many dimensions
unrelated vectors lie at right angles of everything: bounds then spare nothing, and the
join costs what comparing all blocks does.

Defined results: rows without a unit vector must be dropped before; equal vectors are
pairs like others; ids must be distinct; fewer than two rows give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.operators.pair_grid import Arrays, compare_cells, groups_for, matrix, paired, tiles
from quillgrove.session import materialize

MOST_PIVOTS = 256
#: Vectors aimed at per shard, and compared with those that ask at a time.
SHARD_ROWS, BLOCK = 1024, 2048
#: Angles may be off by rounding: arccos near 1 loses half of the digits.
SLACK = 1e-6


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors that lie far from each other: farthest-first over a sample of eight times as many."""
    sample = rows.orderBy(F.xxhash64("id"), "id").select("unit").limit(8 * n).collect()
    points = np.array([r.unit for r in sample], float)
    chosen, far = [0], _angles(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angles(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _sharded(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, unit, shard, angle`` to the nearest pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(matrix(batch.column(1)), pivots)
            shard = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(angles[np.arange(len(shard)), shard])], ["id", "unit", "shard", "angle"])

    return materialize(rows.select("id", "unit").mapInArrow(assign, "id long, unit array<double>, shard int, angle double"), "pivot-shards")


def _asking(members: DataFrame, pivots: np.ndarray, radius: np.ndarray, alpha: float, group: np.ndarray) -> DataFrame:
    """``id, unit, shard, target``: members with every group that has a shard, up to their own, that may hold similar ones."""
    groups = int(group.max()) + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, angles = batch["shard"].to_numpy(), _angles(matrix(batch["unit"]), pivots)
            reach = _reach(angles, radius, alpha, own)
            who, target = np.nonzero(np.stack([reach[:, group == g].any(axis=1) for g in range(groups)], axis=1))
            kept = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(target.astype(np.int32))], ["id", "unit", "shard", "target"])

    return members.select("id", "unit", "shard").mapInArrow(ask, "id long, unit array<double>, shard int, target int")


def _reach(angles: np.ndarray, radius: np.ndarray, alpha: float, own: np.ndarray) -> np.ndarray:
    return (angles <= radius + alpha + SLACK) & (np.arange(len(radius)) <= own[:, None])


def _prepared(rows: DataFrame, threshold: float, shard_rows: int) -> tuple[DataFrame, np.ndarray, np.ndarray, float, int] | None:
    """(members, pivots, radii, the threshold's angle, number of rows); None for fewer than two rows."""
    n = rows.count()
    if n < 2:
        return None
    pivots = choose_pivots(rows, min(MOST_PIVOTS, -(-n // shard_rows)))
    members = _sharded(rows, pivots)
    found = {r.shard: r.radius for r in members.groupBy("shard").agg(F.max("angle").alias("radius")).collect()}
    # an empty shard (a pivot that equals another) is asked by none
    radius = np.array([found.get(i, -10.0) for i in range(len(pivots))])
    return members, pivots, radius, float(np.arccos(np.clip(threshold, -1.0, 1.0))), n


def pivot_pairs(rows: DataFrame, threshold: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a, b, score`` of all pairs of ``rows`` (``id, unit``) at or above the threshold, ``a < b``."""
    prepared = _prepared(rows, threshold, shard_rows)
    if prepared is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double")
    members, pivots, radius, alpha, n = prepared
    # shards go by groups of a fixed number, so that a row moves once a group and not once a shard
    groups = min(groups_for(n), len(pivots))
    group = np.arange(len(pivots)) * groups // len(pivots)
    of = F.array(*[F.lit(int(g)) for g in group])[F.col("shard")]
    held = members.withColumns({"source": F.explode(F.sequence(of, F.lit(groups - 1))), "target": of}).select(F.lit(0).alias("side"), "id", "unit", "shard", "angle", "source", "target")
    asks = _asking(members, pivots, radius, alpha, group).select(F.lit(1).alias("side"), "id", "unit", "shard", F.lit(0.0).alias("angle"), of.alias("source"), "target")
    stream = held.union(asks).select((F.col("target") * groups + F.col("source")).alias("cell"), "side", "id", "unit", "shard", "angle")

    def compare(held: Arrays, asks: Arrays) -> Iterator[pa.RecordBatch]:
        angles = _angles(asks["unit"], pivots)
        reach = _reach(angles, radius, alpha, asks["shard"])
        for shard in np.unique(held["shard"]):
            who = np.flatnonzero(reach[:, shard])
            if not len(who):
                continue
            ring = angles[who, shard]
            near = np.flatnonzero((held["shard"] == shard) & (held["angle"] >= ring.min() - alpha - SLACK) & (held["angle"] <= ring.max() + alpha + SLACK))
            a, b, own = asks["id"][who], held["id"][near], asks["shard"][who] == shard
            for p, q, score in tiles(asks["unit"][who], held["unit"][near], threshold, BLOCK):
                keep = np.where(own[p], a[p] < b[q], a[p] != b[q])
                yield paired(a[p][keep], b[q][keep], score[keep])

    return compare_cells(stream, groups * (groups + 1) // 2, compare)


def shard_report(rows: DataFrame, threshold: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard, members, asks, compared, all_pairs``: comparisons that the bounds leave, own shards counted once a pair."""
    prepared = _prepared(rows, threshold, shard_rows)
    if prepared is None:
        return rows.sparkSession.createDataFrame([], "shard int, members long, asks long, compared long, all_pairs long")
    members, pivots, radius, alpha, n = prepared
    # every shard a group of its own: one row for each that a member asks
    asking = _asking(members, pivots, radius, alpha, np.arange(len(pivots))).toDF("id", "unit", "source", "shard")
    counted = asking.groupBy("shard").agg(F.count(F.when(F.col("source") != F.col("shard"), 1)).alias("asks"))
    own = F.col("members") * (F.col("members") - 1) / 2
    joined = members.groupBy("shard").agg(F.count("*").alias("members")).join(counted, "shard")
    return joined.select("shard", "members", "asks", (F.col("asks") * F.col("members") + own).cast("long").alias("compared"), F.lit(n * (n - 1) // 2).alias("all_pairs"))


# ---------------------------------------------------------------- candidate edges

DEFERRED = "DEFERRED_EDGE_BUDGET"


def candidate_edges(observations: DataFrame) -> DataFrame:
    """``a, b, score, observed``: one row per unordered pair of ``id, other, score``, with its highest score.

    Observations of a row with itself, or without score, are none.
    """
    seen = observations.where("id <> other and score is not null")
    ends = seen.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "score")
    return ends.groupBy("a", "b").agg(F.max("score").alias("score"), F.count("*").alias("observed"))


def edge_budgets(edges: DataFrame, budgets: list[int]) -> DataFrame:
    """``budget, edges, duplicates, status`` for each budget: a graph of more edges is deferred, and has none."""
    counted = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("observed") - 1), F.lit(0)).cast("long").alias("duplicates"))
    each = counted.select(F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])).alias("budget"), "n", "duplicates")
    over = F.col("n") > F.col("budget")
    return each.select("budget", F.when(over, 0).otherwise(F.col("n")).cast("long").alias("edges"), "duplicates", F.when(over, DEFERRED).otherwise("COMPLETE").alias("status"))


def within_budget(edges: DataFrame, budget: int) -> DataFrame:
    """The edges if they keep within the budget, else none: a graph is never cut."""
    verdict = edge_budgets(edges, [budget]).where("status = 'COMPLETE'").select("budget")
    return edges.join(F.broadcast(verdict.withColumn("fits", F.lit(True))), F.col("fits"), "left_semi")  # one row
