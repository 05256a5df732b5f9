"""Clusters against plain loops, ranked recall and requests against plain Python."""


import numpy as np
import pytest

from quillgrove.operators import identities, projections, ranking, signals, vector


def unit_rows(spark, points):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 3, u.tolist()) for i, u in enumerate(unit)], "id long, label long, unit array<double>")
    return rows, unit


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    return unit_rows(spark, np.concatenate([c + rng.normal(size=(15, 8)) * 0.45 for c in centres]))


def test_leaders_equal_a_plain_pass(spark, cloud):
    rows, unit = cloud
    leader = {}
    for i in range(len(unit)):
        if i not in leader:
            leader |= {j: i for j in range(len(unit)) if j not in leader and (j == i or unit[i] @ unit[j] > 0.7)}
    sizes = {v: list(leader.values()).count(v) for v in leader.values()}
    got = {r.id: r.leader for r in vector.leader_clusters(rows, vector.similar_pairs(rows, 0.7), 0.7, 3).collect()}
    assert got == {i: v for i, v in leader.items() if sizes[v] >= 3} and len(set(got.values())) > 2


def test_complete_link_equals_a_plain_pass(spark, cloud):
    rows, unit = cloud
    similar, name = unit @ unit.T >= 0.7, {}
    for i in range(len(unit)):
        if i not in name:
            name[i] = i
            for j in range(i + 1, len(unit)):
                if j not in name and all(similar[j][m] for m, v in name.items() if v == i):
                    name[j] = i
    sizes = {v: list(name.values()).count(v) for v in name.values()}
    got = vector.complete_link_clusters(rows, vector.similar_pairs(rows, 0.7), 0.7, 3).collect()
    assert {r.id: r.cluster for r in got} == {i: v if sizes[v] >= 3 else None for i, v in name.items()}
    deferred = vector.complete_link_clusters(rows, vector.similar_pairs(rows, 0.7), 0.7, 3, most_links=20).collect()
    assert "DEFERRED_DENSE_COMPONENT" in {r.status for r in deferred} and len(deferred) == len(unit)


def test_split_clusters_equals_a_plain_pass(spark, cloud):
    rows, unit = cloud
    want = {}
    for label in range(3):
        parts = []
        for i in range(label, len(unit), 3):
            part = next((p for p in parts if unit[i] @ np.sum(unit[p], axis=0) / len(p) > 0.5), None)
            parts.append([i]) if part is None else part.append(i)
        good = [p for p in parts if len(p) >= 3]
        want |= {i: k for k, p in enumerate(good if len(good) > 1 else [list(range(label, len(unit), 3))]) for i in p}
    assert {r.id: r.part for r in signals.split_clusters(rows, "label", 0.5).collect()} == want


@pytest.mark.parametrize("block", [9, 1000])
def test_neighbours_equal_a_plain_search(spark, cloud, block, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", block)
    rows, unit = cloud
    got = {(r.id, r.nth): r.other for r in vector.neighbours(rows, rows.where("id % 7 = 0"), 4, 0.1).collect()}
    want = {}
    for i in range(0, len(unit), 7):
        order = sorted((j for j in range(len(unit)) if j != i and unit[i] @ unit[j] >= 0.1), key=lambda j: (-(unit[i] @ unit[j]), j))
        want |= {(i, n + 1): j for n, j in enumerate(order[:4])}
    assert got == want


def test_cursor_visits_every_row_once_a_cycle(spark):
    rows, at = spark.range(103).repartition(5), 40
    for turn in range(5):
        batch, at = signals.round_robin(rows, at, 25)
        assert {r.id for r in batch.collect()} == {(40 + 25 * turn + i) % 103 for i in range(25)}
    assert at == (40 + 125) % 103


def test_concepts_expand_and_cover_tokens():
    aliases = {"deep memory": ["deep memory", "long store"], "zed": ["zed"], "absent": ["x"]}
    assert ranking.expanded_concepts("What does DEEP memory of Zed hold, and the rest?", aliases) == ["deep memory", "long store", "zed", "what", "does", "hold", "rest"]
    assert ranking.expanded_concepts("", aliases) == []


def test_copies_of_the_query_and_filler_are_penalised(spark):
    texts = ["about deep memory", "about deep memory?!", "so: about deep memory, yes", "deep memory is a store about which much can be said here", "happy to help", None]
    rows = spark.createDataFrame([(i, t, ["assistant"] if i == 4 else [], "normal") for i, t in enumerate(texts)], "id long, text string, tags array<string>, memory_depth string")
    got = {r.id: round(r.echo, 4) for r in ranking.echo_score(rows, "About deep memory?", ["deep memory", "about"], ["happy to help"]).collect()}
    assert got[0] == got[1] == round(0.35 + 0.25 - 0.15, 4) and got[2] == round(0.35 + 0.25 - 0.1, 4) and got[3] == 0.6 and got[4] == got[5] == 0.0


def test_hits_and_claims_of_odd_rows(spark):
    none = identities.classify_hits(spark.createDataFrame([("p1", "p9", 9, "h", "m", "r", 0.9)], "query_point string, point_id string, memory_id long, content_hash string, model string, revision string, score double"), spark.createDataFrame([], "point_id string, memory_id long, content_hash string, model string, revision string"), 0.5)
    assert [r.kind for r in none.collect()] == ["FOREIGN_POINT"]
    rows = [(1, 1, "raw", None, "h", "h"), (1, 2, "raw", None, None, None), (2, 3, "raw", "a", "h", "h"), (3, 4, "raw", None, "h", "h"), (3, 4, "raw", None, "h", "h")]
    got = {r.cluster: r.claimed for r in identities.claims(spark.createDataFrame(rows, "cluster long, id long, state string, attempt string, content_hash string, expected_hash string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_roles_come_from_the_first_field_that_names_one(spark):
    rows = spark.createDataFrame([("x", "BOT", ["user"]), (None, None, ["z", "Human"]), (None, "?", None)], "a string, b string, tags array<string>")
    assert [r.role for r in rows.select(projections.role(["a", "b"], "tags").alias("role")).collect()] == ["assistant", "user", "unknown"]


def test_answers_lose_repeats(spark, small):
    from quillgrove.plans import catalogue

    out = catalogue.QUERIES["repeat_free_answers"](spark, small).where("id < 50").collect()
    assert out and all(r.n_bullets == 2 and not r.text.endswith("two of it\n- two of it") for r in out)
