"""Clusters straight from vectors equal those from all pairs, and write no pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrove.operators import complete_link, vector, vector_clusters
from quillgrove.operators.complete_link import Budgets
from quillgrove.plans import catalogue


def unit_rows(spark, points):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    return spark.createDataFrame([(3 * i + 1, u.tolist()) for i, u in enumerate(unit)], "id long, unit array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 6))
    points = np.concatenate([*(c + rng.normal(size=(20, 6)) * 0.6 for c in centres), [[1e3, -1, 0, 0, 0, 0]]])
    return unit_rows(spark, points[rng.permutation(len(points))])


@pytest.mark.parametrize("block", [7, 4096])
def test_clusters_from_vectors_equal_those_from_pairs(spark, cloud, block):
    pairs = vector.similar_pairs(cloud, 0.6)
    want = {r.id: r.leader for r in vector.leader_clusters(cloud, pairs, 0.6, 3).collect()}
    assert {r.id: r.leader for r in vector_clusters.leader_clusters_of(cloud, 0.6, 3, block).collect()} == want and len(set(want.values())) > 3
    want = {tuple(r) for r in vector.complete_link_clusters(cloud, pairs, 0.6, 3).collect()}
    assert {tuple(r) for r in vector_clusters.complete_link_of(cloud, 0.6, 3, max(block, 30)).collect()} == want and len({r[2] for r in want}) > 3


def test_clusters_of_no_rows_and_of_rows_apart(spark):
    rows = unit_rows(spark, np.eye(4))
    assert [r.cluster for r in vector_clusters.complete_link_of(rows, 0.5).collect()] == [None] * 4
    assert sorted((r.id, r.leader) for r in vector_clusters.leader_clusters_of(rows, 0.5, 1).collect()) == [(i, i) for i in (1, 4, 7, 10)]
    assert vector_clusters.leader_clusters_of(rows.limit(0), 0.5).count() == vector_clusters.complete_link_of(rows.limit(0), 0.5).count() == 0


def test_a_dense_table_gives_few_links(spark):
    """300 rows, all linked: 44,850 pairs were moved; a forest of one cell has at most a link a row."""
    rows = unit_rows(spark, np.random.default_rng(1).normal(size=(300, 5)) * 0.05 + np.ones(5))
    assert vector.similar_pairs(rows, 0.3).count() == 44_850
    assert vector_clusters.forest(rows, 0.3).count() < 2 * 300


@pytest.mark.parametrize("budgets", [None, Budgets(rows=15), Budgets(links=60), Budgets(comparisons=90), Budgets(row_links=8), Budgets(cluster=4), Budgets(seconds=0), Budgets(seconds=900)])
def test_budgets_on_vectors_equal_those_on_pairs(spark, cloud, budgets):
    graph = vector_clusters.settled_of(cloud, 0.9, 25)
    pairs = complete_link.linked(cloud, vector.similar_pairs(cloud, 0.9), 0.9)
    lower = {r.component: (r.rows, r.links, r.most, r.cost) for r in pairs.sizes.collect()}
    assert {r.component: (r.rows, r.links, r.most, r.cost) for r in graph.sizes.collect()} == lower and len(lower) > 3
    want = {tuple(r) for r in complete_link.clusters_of(pairs, budgets=budgets, block=40).collect()}
    assert {tuple(r) for r in vector_clusters.clusters_under(graph, budgets=budgets, block=40).collect()} == want
    reasons = {r[3] for r in want} - {"CLUSTERED", "UNCLUSTERED"}
    assert bool(reasons) == (budgets is not None and budgets.seconds != 900)


def test_budgets_make_no_table_of_links(spark, small, monkeypatch):
    def fail(*_):
        raise AssertionError("pairs were made, whose number grows with the square of the rows")

    monkeypatch.setattr(vector, "similar_pairs", fail)
    assert {r.budget for r in catalogue.QUERIES["clusters_budgeted"](spark, small).collect()} == {"blocks", "rows", "comparisons", "row_links", "cluster", "seconds"}


@pytest.mark.parametrize("block", [3, 2048])
def test_cohesion_on_vectors_equals_that_on_pairs(spark, cloud, block):
    pairs = vector.similar_pairs(cloud, 0.6)
    clusters = vector_clusters.complete_link_of(cloud, 0.6, 3)
    for named in (clusters, clusters.withColumn("cluster", F.col("component"))):  # components lack some pairs
        want = {tuple(r) for r in complete_link.cohesion(named, pairs).collect()}
        assert {tuple(r) for r in vector_clusters.cohesion_of(cloud, named, 0.6, block).collect()} == want and want
    assert not next(iter(want))[3]


def test_cohesion_makes_no_table_of_pairs(spark, small, monkeypatch):
    def fail(*_):
        raise AssertionError("pairs were made, whose number grows with the square of the rows")

    monkeypatch.setattr(vector, "similar_pairs", fail)
    found = catalogue.QUERIES["cluster_cohesion"](spark, small).collect()
    assert found and all(r.complete for r in found)
