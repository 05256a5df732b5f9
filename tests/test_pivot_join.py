"""Threshold joins through pivot shards against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrove.operators import pivot_join, vector


def unit_rows(spark, points):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(unit)], "id long, unit array<double>")
    return rows.withColumns({c: F.lit("clash") for c in ("shard", "block", "angle", "score", "rows")}), unit


def plain_pairs(unit, threshold):
    scores = unit @ unit.T
    return {(i, j) for i, j in zip(*np.nonzero(scores >= threshold - 1e-12), strict=True) if i < j}


def clustered(seed, groups, each, spread, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    points = np.concatenate([c + rng.normal(size=(each, 16)) * spread for c in centres])
    return np.concatenate([points, np.repeat(points[:1], copies, axis=0)])


@pytest.mark.parametrize(("threshold", "shard_rows", "block"), [(0.9, 100, 64), (0.7, 50, 2048), (0.2, 200, 100), (-1.0, 500, 333)])
def test_pairs_equal_all_pairs(spark, threshold, shard_rows, block, monkeypatch):
    monkeypatch.setattr(pivot_join, "BLOCK", block)
    rows, unit = unit_rows(spark, clustered(1, 20, 20, 0.3, copies=40))
    got = pivot_join.pivot_pairs(rows, threshold, shard_rows).collect()
    assert {(r.a, r.b) for r in got} == plain_pairs(unit, threshold) and len(got) == len({(r.a, r.b) for r in got})
    assert all(abs(r.score - unit[r.a] @ unit[r.b]) < 1e-9 for r in got)


def test_two_thousand_vectors_and_what_is_spared(spark):
    rows, unit = unit_rows(spark, clustered(2, 100, 20, 0.15))
    got = {(r.a, r.b) for r in pivot_join.pivot_pairs(rows, 0.9, 20).collect()}
    assert got == plain_pairs(unit, 0.9)
    made = pivot_join.shard_report(rows, 0.9, 20).agg(F.sum("compared").alias("compared"), F.max("all_pairs").alias("all_pairs")).first()
    assert made.all_pairs == 2000 * 1999 // 2 and made.compared < 0.35 * made.all_pairs


def test_both_joins_agree(spark):
    rows, _ = unit_rows(spark, clustered(3, 10, 30, 0.5))
    one, other = (sorted((r.a, r.b) for r in df.collect()) for df in (pivot_join.pivot_pairs(rows, 0.6, 40), vector.similar_pairs(rows, 0.6)))
    assert one == other


def test_edges_keep_the_highest_score_and_their_budget(spark):
    seen = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 1, 0.6), (3, 3, 1.0), (4, 1, None)], "id long, other long, score double")
    edges = pivot_join.candidate_edges(seen)
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2, 0.7, 2), (1, 3, 0.6, 1)]
    assert sorted(tuple(r) for r in pivot_join.edge_budgets(edges, [1, 2]).collect()) == [(1, 0, 1, "DEFERRED_EDGE_BUDGET"), (2, 2, 1, "COMPLETE")]
    assert (pivot_join.within_budget(edges, 1).count(), pivot_join.within_budget(edges, 2).count()) == (0, 2)


def test_no_pairs_of_few_rows(spark):
    rows, _ = unit_rows(spark, np.ones((1, 4)))
    assert pivot_join.pivot_pairs(rows, 0.5).count() == 0 and pivot_join.pivot_pairs(rows.limit(0), 0.5).count() == 0
    assert pivot_join.shard_report(rows.limit(0), 0.5).count() == 0
    assert pivot_join.edge_budgets(pivot_join.candidate_edges(spark.createDataFrame([], "id long, other long, score double")), [0]).first().status == "COMPLETE"
