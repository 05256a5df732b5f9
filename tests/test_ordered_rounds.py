"""Order-dependent passes done in rounds, against the plain loops they stand for."""

import random

import pytest

from quillgrove.operators import signals
from quillgrove.operators.complete_link import Budgets, cohesion, complete_link_clusters, first_fits

PAIRS = "a long, b long, score double"


def plain_clusters(n, links):
    """Seed by seed, each takes every later row that is linked to all it has."""
    name = {}
    for seed in range(n):
        if seed in name:
            continue
        group = [seed]
        name[seed] = seed
        for row in range(seed + 1, n):
            if row not in name and all((m, row) in links for m in group):
                group.append(row)
                name[row] = seed
    return name


def graph(seed, n, share, hub=None):
    rng = random.Random(seed)
    links = {(a, b) for a in range(n) for b in range(a + 1, n) if a // 60 == b // 60 and rng.random() < share}
    return links | ({(min(hub, x), max(hub, x)) for x in range(n) if x != hub} if hub is not None else set())


@pytest.mark.parametrize(("seed", "share"), [(1, 0.1), (2, 0.5), (3, 0.9)])
def test_first_fits_in_one_block(seed, share):
    links = graph(seed, 120, share)
    assert first_fits(range(120), [(b, a) for a, b in links]) == plain_clusters(120, links)


@pytest.mark.parametrize(("seed", "share", "hub", "block"), [(4, 0.3, None, 250), (5, 0.6, 70, 400), (6, 0.2, 0, 60)])
def test_blocks_equal_the_plain_pass(spark, seed, share, hub, block):
    n = 130
    links = graph(seed, n, share, hub)
    rng = random.Random(seed)
    pairs = [(a, b, 0.9) if rng.random() < 0.5 else (b, a, 0.9) for a, b in links]
    pairs += pairs[:5] + [(1, 1, 1.0), (0, n - 1, 0.1), (None, 3, 0.9)]
    rows = spark.range(n + 2)
    got = {r.id: r for r in complete_link_clusters(rows, spark.createDataFrame(pairs, PAIRS), 0.7, 1, block=block).collect()}
    want = plain_clusters(n, links)
    assert len(got) == n + 2 and got[n].status == "UNCLUSTERED" and got[n].component == n
    linked = {x for pair in links for x in pair}
    assert {i: got[i].cluster for i in linked} == {i: want[i] for i in linked}


def test_least_size_and_cohesion(spark):
    pairs = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.75), (2, 3, 0.9), (5, 6, 0.9)], PAIRS)
    out = complete_link_clusters(spark.range(8), pairs, 0.7)
    assert {r.id: r.cluster for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert [tuple(r) for r in cohesion(out, pairs).collect()] == [(0, 3, 0.75, True)]
    assert [r.complete for r in cohesion(out, pairs.where("score <> 0.8")).collect()] == [False]


def test_every_budget_has_its_status(spark):
    # components of 3, 4 and 5 rows, all pairs linked
    groups = [range(3), range(10, 14), range(20, 25)]
    pairs = spark.createDataFrame([(a, b, 0.9) for g in groups for a in g for b in g if a < b], PAIRS)
    rows = spark.createDataFrame([(x,) for g in groups for x in g], "id long")

    def statuses(**limits):
        out = complete_link_clusters(rows, pairs, 0.7, budgets=Budgets(**limits), block=4 if "seconds" in limits else 100).collect()
        return [{r.status for r in out if r.id in g} for g in groups]

    ok, all_of = {"CLUSTERED"}, lambda x: [{x}] * 3
    assert statuses() == [ok] * 3
    assert statuses(rows=4) == [ok, ok, {"DEFERRED_DENSE_COMPONENT"}]
    assert statuses(links=5) == [ok, {"DEFERRED_DENSE_COMPONENT"}, {"DEFERRED_DENSE_COMPONENT"}]
    assert statuses(comparisons=9) == [ok, ok, {"DEFERRED_PAIRWISE_BUDGET"}]
    assert statuses(comparisons=8) == [ok, {"DEFERRED_PAIRWISE_BUDGET"}, {"DEFERRED_PAIRWISE_BUDGET"}]
    assert statuses(row_links=3) == [ok, ok, {"DEFERRED_RSS_BUDGET"}]
    assert statuses(cluster=3) == [ok, {"DEFERRED_OVERSIZED_CLUSTER"}, {"DEFERRED_OVERSIZED_CLUSTER"}]
    assert statuses(seconds=0) == all_of("DEFERRED_TIMEOUT")


def test_no_pairs(spark):
    out = complete_link_clusters(spark.range(3), spark.createDataFrame([], PAIRS), 0.7).collect()
    assert {(r.component, r.cluster, r.status) for r in out} == {(i, None, "UNCLUSTERED") for i in range(3)}
    assert complete_link_clusters(spark.range(0), spark.createDataFrame([], PAIRS), 0.7).count() == 0


def plain_pruning(links, cold, keep):
    for row in sorted(cold):
        own = sorted((x for x in links if row in x[:2]), key=lambda x: (-x[2], x[0], x[1]))
        links = [x for x in links if row not in x[:2] or x in own[:keep]]
    return links


@pytest.mark.parametrize(("seed", "n", "m", "keep"), [(1, 30, 120, 3), (2, 30, 200, 1), (3, 60, 150, 2)])
def test_cold_links_in_order(spark, seed, n, m, keep):
    rng = random.Random(seed)
    ends = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(0, x) for x in range(n)})
    links = [(a, b, rng.randrange(5) / 4) for a, b in ends]
    cold = [x for x in range(n) if rng.random() < 0.7]
    table = spark.createDataFrame(links, "source_id long, target_id long, weight double")
    got = signals.prune_cold_links_in_order(table, spark.createDataFrame([(x,) for x in cold], "id long"), keep)
    want = plain_pruning(links, cold, keep)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) < len(links)


def test_cold_links_of_nothing_and_with_nulls(spark):
    schema = "source_id long, target_id long, weight double"
    cold = spark.createDataFrame([(1,), (None,)], "id long")
    assert signals.prune_cold_links_in_order(spark.createDataFrame([], schema), cold).count() == 0
    rows = [(1, 2, None), (1, 3, 0.5), (1, 3, 0.1), (None, 1, 0.9), (4, 5, 0.1)]
    got = signals.prune_cold_links_in_order(spark.createDataFrame(rows, schema), cold, 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 3, 0.5), (1, 3, 0.1), (None, 1, 0.9), (4, 5, 0.1)]))
