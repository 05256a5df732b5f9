"""Steps that must not grow faster than what they read, against plain forms of the same results."""

import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrove.operators import complete_link, dynamics, field, identities, overlap_search, pair_grid, pivot_join, signals, vector
from quillgrove.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_co_echo_pairs_meet_as_blocks(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), rng.sample("abcd", rng.randrange(5))) for i in range(150)] + [(None, 5, ["a"]), (500, 5, None)]
    states = spark.createDataFrame(rows, "memory_id long, echoes long, concepts array<string>")
    sets = {i: set(c) for i, n, c in rows if n >= 2 and i is not None and c}
    wanted = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    for block in (7, 1024):
        pairs = dynamics.co_echo_pairs(states, 2, block)
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(wanted) and set(got) == wanted
    pairs = dynamics.co_echo_pairs(states, 2)
    # the pairs of records leave the last two explodes as they are: nothing above them groups or moves them
    physical = plan_of(pairs).split("== Physical Plan ==")[1]
    assert not re.search("Aggregate|Exchange|Join", physical[: physical.index("Generate")])
    assert dynamics.co_echo_pairs(states.limit(0), 2).count() == 0


def test_co_echo_pairs_hold_one_record_and_block_at_a_time(spark):
    states = spark.range(300).selectExpr("id AS memory_id", "5L AS echoes", "array('a') AS concepts")
    pairs = dynamics.co_echo_pairs(states, 2, 100)
    pairs.collect()
    lines = [x for x in pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if re.search(r"Generate explode|CollectMetrics", x)][:3]
    # the two explodes aren't in one piece of generated code, which keeps all its rows until the input row is done
    assert [bool(re.search("CollectMetrics", x)) for x in lines] == [False, True, False]
    ids = [re.search(r"\*\((\d+)\)", x).group(1) for x in lines if "Generate" in x]
    assert len(set(ids)) == 2


def test_identity_snapshot_of_many_rows(spark):
    rows = spark.range(100_000).selectExpr("'p' || id AS point_id", "id AS memory_id", "'h' || id AS content_hash", "'m' AS model", "'r' AS revision")
    got = identities.identity_snapshot(rows).first()
    texts = (f"p{i}|{i}|h{i}|m|r" for i in range(100_000))
    total = sum(int(hashlib.sha256(t.encode()).hexdigest()[:12], 16) for t in texts)
    assert total >= 2**63  # more than a long holds
    assert tuple(got) == (100_000, True, True, True, total % 2**63)


def test_frozen_decay_at_the_threshold(spark):
    rows = spark.createDataFrame([(1, 0.1)] * 10 + [(2, 0.1)] * 9 + [(2, 0.09), (3, float("nan")), (4, None)], "user_id long, activation double").coalesce(1)
    got = {r.user_id: r.gamma for r in field.frozen_decay(rows, 0.98, 0.1, 0.5).collect()}  # ten times 0.1 adds up to 0.9999999999999999
    assert got == {1: 0.98, 2: 0.49, 3: 0.98, 4: 0.98}


@pytest.mark.parametrize("chunk", [3, 100])
def test_overlaps_are_counted_in_blocks(spark, chunk, monkeypatch):
    monkeypatch.setattr(overlap_search, "CELLS", 40)
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    texts = {i: " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(12))) for i in range(120)}
    rows = spark.createDataFrame([*texts.items(), (None, "word1"), (900, None)], "id long, text string")
    sets = {i: set(t.split()) for i, t in texts.items()}
    wanted = set()
    for q in range(0, 120, 10):
        scored = [(-round(len(sets[q] & s) / len(sets[q] | s), 6), i) for i, s in sets.items() if i != q and sets[q] & s]
        wanted |= {(q, i, -x) for x, i in sorted((x, i) for x, i in scored if -x >= 0.2)[:4]}
    monkeypatch.setattr(signals, "best_overlaps", functools.partial(overlap_search.best_overlaps, chunk=chunk))
    found = signals.related(rows.where("id % 10 = 0"), rows, 0.2, 4)
    assert {tuple(r) for r in found.collect()} == wanted
    # before: an inverted index joined by token, a row per pair and common token
    assert "Join" not in plan_of(found)


@pytest.mark.parametrize("often", [0.0, 0.03, 2.0])
def test_overlaps_by_lines_by_lists_and_by_pairs(often, monkeypatch):
    """More common keys than a byte counts, keys that no query has, nulls and empty lists."""
    monkeypatch.setattr(overlap_search, "OFTEN", often)
    rng = np.random.default_rng(4)
    draw = lambda n, most: [[None, *(f"k{x}" for x in rng.permutation(900)[: rng.integers(0, most)])] for _ in range(n)]
    asked, rows = [*draw(30, 900), []], [*draw(8, 950), [], None, [f"k{x}" for x in range(2000)]]
    index = overlap_search._Index(pa.array(asked, pa.list_(pa.string())))
    held = pa.array(rows, pa.list_(pa.string()))
    owner, codes = overlap_search._owners(held), overlap_search._codes(held, index.keys)
    owner, codes = owner[codes >= 0], codes[codes >= 0]
    want = np.array([[len((set(r or []) & set(q)) - {None}) for q in asked] for r in rows])
    assert want.max() > 510
    np.testing.assert_array_equal(index.counts(owner, codes, len(rows)), want)
    r, q = np.nonzero(rng.random(want.shape) < 0.4)
    np.testing.assert_array_equal(index.common(owner, codes, r, q), want[r, q])
    np.testing.assert_array_equal(index.common(owner, codes, r, q), want[r, q])  # nothing of the rows stays in the index


@pytest.mark.parametrize("few", [0, 10**9])
def test_related_by_signals_whichever_way_pairs_are_counted(spark, few, monkeypatch):
    monkeypatch.setattr(overlap_search, "FEW", few)  # the tokens of every pair in reach one by one, or of no pair
    monkeypatch.setattr(overlap_search, "CELLS", 300)
    rng = random.Random(8)
    made = [(i, i % 7, rng.random() < 0.2, rng.choices("abcdefghijklmnop", k=rng.randrange(16)), [f"e{i % 11}"], rng.sample("uvwxyz", 2)) for i in range(160)]
    rows = spark.createDataFrame(made, "id long, ts long, temporary boolean, tokens array<string>, entities array<string>, tags array<string>")
    wanted = set()
    for q in made[::8]:
        found = []
        for r in made:
            alike = len(set(q[3]) & set(r[3])) / max(1, len(set(q[3]) | set(r[3])))
            entity, tags = q[4] == r[4], len(set(q[5]) & set(r[5])) >= 2
            if r[0] != q[0] and (entity or ((tags or alike >= (0.18 if max(len(q[3]), len(r[3])) >= 12 else 0.25)) and not (q[2] or r[2]))):
                found.append((-round(3 * entity + 2 * tags + alike, 6), -r[1], r[0]))
        wanted |= {(q[0], i, -score) for score, _, i in sorted(found)[:3]}
    assert {tuple(r) for r in signals.related_by_signals(rows.where("id % 8 = 0"), rows).collect()} == wanted


def test_tokens_are_cut_out_without_splitting_texts(spark):
    from quillgrove.functions import text as X

    said = ["The quick_brown fox, 2024 ÄÖ über K\u212akelvin", "", None, "abc abcd abcd ABCD -- __x_", "naïveté\nzzzz", "\u0130stanbul"]
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    plain = F.array_distinct(F.filter(F.split(F.lower("text"), "[^0-9A-Za-z_]+"), lambda t: F.length(t) > 3))
    tokens = X.index_tokens(F.col("text"))
    assert rows.where(~tokens.eqNullSafe(plain)).count() == 0
    assert "split(" not in plan_of(rows.select(tokens)).lower()  # took five times as long


@pytest.mark.parametrize("join", [vector.similar_pairs, functools.partial(pivot_join.pivot_pairs, shard_rows=40)])
def test_pairs_by_groups(spark, monkeypatch, join):
    monkeypatch.setattr(pair_grid, "LEAST_ROWS", 50)
    monkeypatch.setattr(pair_grid, "TILE", 7)
    x = np.random.default_rng(1).normal(size=(700, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] = x[1]
    scores = x @ x.T
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, unit array<double>")
    pairs = join(rows, 0.9)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(int(a), int(b)) for a, b in np.argwhere(scores >= 0.9) if a < b}
    # before: a join of blocks, each moved for every other block or shard
    assert "Join" not in plan_of(pairs)
    assert pair_grid.groups_for(700) == 12 == pair_grid.groups_for(10**5 * 6)


def test_budgets_share_one_graph(spark, small, monkeypatch):
    calls, inner = [], complete_link.connected_components
    monkeypatch.setattr(complete_link, "connected_components", lambda *a: calls.append(1) or inner(*a))
    catalogue.QUERIES["clusters_budgeted"](spark, small)
    assert len(calls) == 1


def test_next_closing_frames_grow_from_one_side(spark):
    from quillgrove.operators import time_relations

    announcing = spark.createDataFrame([(1, 0, "w:x", 10, 1, "user"), (1, 0, "w:x", 30, 2, "user"), (1, 0, "w:x", 95, 3, "user")], "user_id long, rule int, signal string, ts long, id long, role string")
    closing = spark.createDataFrame([(1, 0, "w:x", 10, 5, "user"), (1, 0, "w:x", 20, 6, "user"), (1, 0, "w:x", 95, 7, "user"), (1, 0, "w:x", 95, 8, "user")], announcing.schema)
    out = time_relations.next_closing(announcing, closing, 50)
    assert {r.id: r.first.id for r in out.collect()} == {1: 6, 2: 7}
    assert "unboundedfollowing" not in plan_of(out).lower()  # such a frame is read anew for every row


@pytest.mark.parametrize("name", ["CALL_INTENT", "CALL_DONE", "FEVER_DONE", "LEAVING", "JOURNEY_DONE", "ENTITY"])
def test_boundaries_beside_letters_equal_those_in_full(spark, name):
    from quillgrove.functions.time import ascii_bounds
    from quillgrove.operators import time_relations

    full = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    pattern, rng = getattr(time_relations, name), np.random.default_rng(3)
    parts = np.array(["devo", "dobbiamo", " ", " ", "chiamare", "ho", "chiamato", "sentito", "sta", "meglio", "sfebbrata", "sono", "andato", "è", "Èva", "Ada", "_", "-", "1", "partire", "à"])
    rows = spark.createDataFrame([("".join(rng.choice(parts, rng.integers(0, 9))),) for _ in range(3000)], "s string")
    found = lambda p: F.regexp_extract_all("s", F.lit(p), F.lit(0))
    assert rows.where(found(ascii_bounds(pattern)) != found(pattern.replace(r"\b", full))).count() == 0
    assert name == "ENTITY" or full not in ascii_bounds(pattern.replace("[oa]", "o"))


def test_concepts_are_found_without_rewriting_texts(spark):
    from quillgrove.functions import text as X
    from quillgrove.operators import ranking

    said = ["ation", "a-ation, b", "xation", "ationé", "deep  memory", "deep-memory.", "deep memories", "the deep\nmemory", "ation÷", "ATION", "", None, "one deep memory's", "\U0001f600ation\U0001f600", "no"]
    rows = spark.createDataFrame([(i, t, ["x_y"]) for i, t in enumerate(said)], "id long, text string, tags array<string>")
    for concept in ("ation", "deep memory", "", "a.b", "Ation", "memory ", "é"):
        assert rows.where(~X.mentions(F.lower("text"), concept).eqNullSafe(F.contains(X.concept_text(F.col("text")), F.lit(f" {concept} ")))).count() == 0
    for concepts, want in ((["ation", "x y"], range(15)), (["deep memory"], [4, 5, 7, 12]), (["nowhere"], range(15)), ([], range(15))):
        out = ranking.warm_prefilter(rows, concepts)
        assert sorted(r.id for r in out.collect()) == list(want)
        assert "regexp_replace" not in plan_of(out).lower()


def test_texts_are_scored_once_for_links(spark):
    from quillgrove.operators import ranking

    rows = spark.createDataFrame([(1, "about ation", 0.5, ["en"], "normal"), (2, "none", 0.1, [], "normal")], "id long, text string, activation double, tags array<string>, memory_depth string")
    links = spark.createDataFrame([(1, 2, 0.4, "semantic")], "source_id long, target_id long, weight double, link_type string")
    out = ranking.final_scores(rows, links, "ation", ["ation"])
    assert "regexp_replace" not in plan_of(out).lower()  # scores are read back, by both sides of the join
    assert {r.id: round(r.boost, 4) for r in out.collect()} == {1: 0.0, 2: round((0.6 + 0.4 * 0.5) * 0.4 * 0.2, 4)}


def test_nearest_rows_equal_a_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = np.concatenate([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(3, 8)), 30, axis=0)])  # many equal scores
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 3, u.tolist()) for i, u in enumerate(unit)], "id long, label long, unit array<double>")
    score = np.round(unit @ unit.T, 9)
    for limits in ({"LEAST_ROWS": 20, "TILE": 7, "TILE_HELD": 11, "KEPT": 5}, {}):
        for name, value in limits.items():
            monkeypatch.setattr(pair_grid, name, value)
        for step, k, least, of in ((1, 5, 0.2, None), (9, 4, -1.0, "label"), (9, 300, -1.0, None), (1, 1, -1.0, None)):
            want = {}
            for i in range(0, len(unit), step):
                fits = [j for j in range(len(unit)) if j != i and score[i, j] >= least and (of is None or i % 3 == j % 3)]
                want |= {(i, n + 1): j for n, j in enumerate(sorted(fits, key=lambda j: (-score[i, j], j))[:k])}
            found = vector.neighbours(rows, rows.where(f"id % {step} = 0"), k, least, of)
            assert {(r.id, r.nth): r.other for r in found.collect()} == want
        monkeypatch.undo()


def test_link_counts_equal_those_of_pairs(spark):
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(3000, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(unit)], "id long, unit array<double>")
    similar = unit @ unit.T >= 0.9
    want = {i: int(n) for i, n in enumerate(similar.sum(axis=1) - 1) if n}
    assert {r.id: r.hits for r in vector.link_counts(rows, 0.9).collect()} == want
    assert {r.id: r.hits for r in vector.completeness(vector.similar_pairs(rows, 0.9), 1).collect()} == want
