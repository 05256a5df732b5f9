"""Graph, clusters, folds, files and edge cases of the core operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrove.functions import activation as A
from quillgrove.functions import text as X
from quillgrove.functions import time as T
from quillgrove.operators import documents, dynamics, recall, vector
from quillgrove.operators.components import connected_components
from quillgrove.sources import files
from quillgrove.streaming import folds


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chain_star_and_random(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    edges += [(5, 5), (7, 7), (3, 2), (2, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 4)], "a long, b long"), "a", "b").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == union_find(nodes, edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def vectors(spark, points):
    rows = [(i, (np.array(p) / np.linalg.norm(p)).tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, unit array<double>")


def test_complete_link_needs_every_pair(spark):
    at = [(np.cos(t), np.sin(t)) for t in (0.0, 0.1, 0.2)]  # a clique
    chain = [(np.cos(t), np.sin(t)) for t in (2.0, 2.7, 3.4)]  # neighbours similar, ends not
    rows = vectors(spark, at + chain)
    pairs = vector.similar_pairs(rows, 0.7)
    out = {r.id: (r.cluster, r.status) for r in vector.complete_link_clusters(rows, pairs, 0.7, 3).collect()}
    assert [out[i][0] for i in range(3)] == [0, 0, 0]
    assert {out[i][1] for i in range(3, 6)} == {"UNCLUSTERED"}


def test_dense_component_is_deferred_whole(spark):
    rows = vectors(spark, [(1, 0.001 * i) for i in range(6)])
    pairs = vector.similar_pairs(rows, 0.9)
    out = vector.complete_link_clusters(rows, pairs, 0.9, 3, largest=5).collect()
    assert {r.status for r in out} == {"DEFERRED_DENSE_COMPONENT"} and len(out) == 6


def test_threshold_is_inclusive_and_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 3))
    rows = vectors(spark, points)
    got = {(r.a, r.b) for r in vector.similar_pairs(rows, 0.8).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.8}
    assert vector.similar_pairs(rows.limit(0), 0.8).count() == 0


def test_recall_keeps_absent_activation(spark):
    rows = spark.createDataFrame([(1, None, "a", ["x"], None), (2, 0.1, "a", ["x"], None), (3, 0.9, "a", None, "deep")], "id long, activation double, type string, tags array<string>, memory_depth string")
    assert {r.id for r in recall.recall_filter(rows, 0.5).collect()} == {1, 3}
    assert {r.id for r in recall.recall_filter(rows, exclude_tags=["x"]).collect()} == {3}
    assert {r.id for r in recall.recall_filter(rows, exclude_depth=["deep"]).collect()} == {1, 2}


def test_selection_is_the_same_in_any_order_and_partitioning(spark):
    data = [(i % 40, f"text {i % 13}", "raw", "raw", "warm") for i in range(90)] + [(None, "x", "raw", "raw", "warm"), (99, "  ", "raw", "raw", "warm")]
    schema = "id long, text string, memory_kind string, processing_state string, storage_tier string"
    results = []
    for n, rows in ((1, data), (7, data[::-1]), (20, data)):
        out = dynamics.select_candidates(spark.createDataFrame(rows, schema).repartition(n), 5)
        results.append(sorted((str(r.id), r.text, r.decision, r.reason) for r in out.collect()))
    assert results[0] == results[1] == results[2]
    assert sum(d == "eligible" for *_, d, _ in results[0]) == 5


def test_bands_and_defaults(spark):
    row = spark.range(1).select(A.level(F.lit(0.7)).alias("a"), A.level(F.lit(0.3)).alias("b"), A.node_level(F.lit(0.15)).alias("c"), A.depth(F.lit(0.96)).alias("d"), A.tier(F.lit("raw"), F.lit(None).cast("string"), F.lit("historical")).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e.tier) == ("short", "medium", "medium", "core", "deep")


def test_instants(spark):
    rows = spark.createDataFrame([("-2208988800000",), ("1970-01-01T00:00:01Z",), ("0",), ("x",), (None,)], "raw string")
    got = [r.s for r in rows.select(T.parse_instant(F.col("raw")).cast("double").alias("s")).collect()]
    assert got == [-2208988800.0, 1.0, 0.0, None, None]


def test_text_functions_on_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("The  ‘Café’ IS here",)], "t string")
    out = rows.select(X.normalised(F.col("t")).alias("n"), X.token_share(F.col("t"), []).alias("s"), X.has_concept(F.col("t"), "is here").alias("c"), X.slug(F.col("t")).alias("g")).collect()
    assert out[0].n is None and out[1].n == "" and out[2].n == "the 'café' is here" and out[2].c and out[2].s == 0.0


def test_chunks_cover_the_text(spark):
    text = "abcdefghij" * 7
    rows = documents.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string"), 16, 4).orderBy("chunk").collect()
    assert {r.id for r in rows} == {1} and rows[0].text + "".join(r.text[4:] for r in rows[1:]) == text


def test_mood_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    data = [(i % 3, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, rng.random()) for i in range(120)]
    rows = spark.createDataFrame(data, "key long, at string, seq long, value double").select("key", F.to_timestamp("at").alias("ts"), "seq", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = folds.mood_stream(stream).writeStream.outputMode("update").format("memory").queryName("moods").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {r.key: round(r.short, 9) for r in spark.table("moods").collect()}
    assert streamed == {r.key: round(r.short, 9) for r in folds.fold_moods(rows).collect()}


def test_echo_stream_equals_batch(spark, small, tmp_path):
    from quillgrove.sources.adapters import memory_events

    rows = memory_events(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.union(rows.limit(20)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = folds.echo_state_stream(stream, "60 days").writeStream.outputMode("update").format("memory").queryName("echoes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {r.memory_id: (r.echoes, r.promoted, r.suppressed) for r in spark.sql("SELECT memory_id, max(echoes) AS echoes, max(promoted) AS promoted, max(suppressed) AS suppressed FROM echoes GROUP BY 1").collect()}
    assert streamed == {r.memory_id: (r.echoes, r.promoted, r.suppressed) for r in dynamics.echo_states(rows).collect()}


def test_collections_logs_and_snapshots(spark, tmp_path):
    schema = spark.createDataFrame([("a", 1)], "id string, n long").schema
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "list.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}]))
    (tmp_path / "c" / "map.json").write_text(json.dumps({"c": {"id": "c", "n": 3}}))
    assert {r.id for r in files.read_collection(spark, str(tmp_path / "c"), schema).collect()} == {"a", "b", "c"}
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b", "n": 2}\n')
    assert files.read_log(spark, str(log), schema).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_log(spark, str(log), schema, strict=True).collect()
    for version in (1, 2):
        files.write_snapshot(spark.range(version), str(tmp_path / "s"), version)
    assert files.read_snapshot(spark, str(tmp_path / "s")).count() == 2
    assert files.read_snapshot(spark, str(tmp_path / "s"), 1).count() == 1
    listed = files.scan_files(spark, str(tmp_path), "*.json", max_bytes=30).collect()
    assert {r.extension for r in listed} == {"json"} and sum(r.preview is None for r in listed) == 1


def test_entities_repeats_and_bullets():
    from quillgrove.operators import signals as S

    assert S.entities_of("The Anna Rossi went. Then Rome was far from Anna Rossi") == {"Anna Rossi": 2, "Rome": 1}
    assert S.entities_of(None) == {}
    assert S.cut_repeats("a\nb\nc\nb\nc\nd") == "a\nb\nc" and S.cut_repeats("a\nb") == "a\nb"
    assert S.distinct_bullets("- One\n* one two\n1. Three\ntext") == ["One", "Three"]


def test_due_dates():
    from datetime import datetime

    from quillgrove.operators.temporal import due_date

    now = datetime(2024, 1, 2, 11, 0)  # a Tuesday
    assert due_date("domani alle 10:30", now) == (datetime(2024, 1, 3, 10, 30), None, None)
    assert due_date("martedì", now) == (datetime(2024, 1, 9, 9, 0), None, None)
    assert due_date("ogni 3 ore", now) == (datetime(2024, 1, 2, 14, 0), 3, "hours")
    assert due_date("", now) is None and due_date(None, now) is None


def test_layouts_keep_null_zero_and_absent_apart(spark):
    from quillgrove.operators.records import normalise

    rows = [
        '{"id": "a", "activation": 0, "accessCount": 0, "orbital": {"activation_score": 0.5}}', '{"id": "b", "activation": null, "orbital": {"activation_score": 0.5}, "tags": null}',
        '{"id": "c", "orbital": {"activation_score": 0.5}, "content": {"text": "t"}, "text": "no"}', '{"id": "d", "content": "plain", "text": "no"}', "not json",
    ]
    out = {r.id: r for r in normalise(spark.createDataFrame([(r,) for r in rows], "record string")).collect()}
    assert (out["a"].layout, out["a"].activation, out["a"].access_count) == ("hybrid", 0.0, 0)
    assert out["b"].activation is None and out["b"].has_activation and out["b"].tags is None
    assert (out["c"].layout, out["c"].text, out["c"].activation) == ("nested", "t", 0.5)
    assert (out["d"].layout, out["d"].text) == ("unknown", "plain") and out[None].layout == "unknown"


def test_temporal_intent_and_what_follows_from_it(spark):
    cases = [
        ("Domani devo chiamare", "user", 1, "future_intent", "future_pending", "future_intent"), ("Domani devo chiamare", "assistant", 1, "generic", "recent", "current"),
        ("domani partiremo", "user", 40, "future_intent", "expired_future", "future_intent"), ("Ho  finito il lavoro", "user", 90, "completed_event", "completed", "completed"),
        ("Sei già tornato a casa", "assistant", 1, "completed_event", "completed", "completed"), ("Non devi più andare", "assistant", 1, "generic", "recent", "current"),
        ("Ieri pioveva", "user", 30, "past_event", "historical", "past"), ("Adesso piove", None, 30, "current_state", "stale", "current"),
        ("Quando parti", "user", 1, "query", "query", "query"), ("ok?", "user", 1, "query", "query", "query"), (None, None, 80, "generic", "stale", "past"), ("", "user", None, "generic", "recent", "current"),
        ("coral", "user", 30, "generic", "recent", "past"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, text string, role string, age int")
    intent = T.temporal_intent(F.col("text"), F.col("role"))
    got = rows.select("i", intent.alias("n"), T.validity(intent, F.col("age")).alias("v"), T.temporal_state(intent, F.col("age")).alias("s")).orderBy("i").collect()
    assert [(r.n, r.v, r.s) for r in got] == [c[3:] for c in cases]


def test_echo_plan_joins_only_linked_pairs_and_counts_what_waits(spark):
    states = spark.createDataFrame([(1, 6, 0, 0, ["a", "b"]), (2, 4, 3, 3, ["b"]), (3, 9, 5, 0, ["c"]), (4, 2, 0, 0, ["b"]), (None, 9, 0, 9, ["a"])], "memory_id long, echoes long, promoted long, suppressed long, concepts array<string>")
    rows = spark.createDataFrame([(1, 90.0), (7, 90.0), (8, 3.0), (9, None), (None, 90.0)], "id long, idle_days double")
    links = spark.createDataFrame([(2, 1, "semantic"), (1, 2, "semantic"), (1, 3, "semantic"), (1, 4, "semantic"), (2, 2, "semantic"), (1, 2, "continuation")], "source_id long, target_id long, link_type string")
    got = [(r.part, r.action, r.memory_id, r.target_id) for r in dynamics.echo_plan(states, rows, links).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("memory", "increase_latent_presence", 1, None), ("memory", "allow_orbit_lift", 2, None), ("memory", "temporary_inhibition", 2, None), ("memory", "allow_orbit_lift", 3, None),
            ("memory", "slow_dormant_decay", 7, None), ("memory", "slow_dormant_decay", 9, None), ("link", "reinforce_semantic_link", 1, 2),
        ],
        key=str,
    )
    capped = dynamics.echo_plan(states, rows, links, 2, 0).collect()
    assert [(r.action, r.memory_id) for r in capped] == [("increase_latent_presence", 1), ("allow_orbit_lift", 2)]
    assert [tuple(r) for r in dynamics.echo_plan_counts(states, rows, links, 2, 0).collect()] == [("memory", 2, 4), ("link", 0, 1)]
    assert dynamics.echo_plan(states.limit(0), rows.limit(0), links.limit(0)).count() == 0


def test_related_by_signals(spark):
    from quillgrove.operators.signals import related_by_signals

    kinds = "id long, ts long, temporary boolean, tokens array<string>, entities array<string>, tags array<string>"
    few, many = ["a", "b", "c"], [f"w{i}" for i in range(12)]
    new = spark.createDataFrame([(1, 0, False, few, ["e"], ["e", "x", "y"]), (2, 0, True, few, ["e"], []), (3, 0, False, many, None, None), (4, 0, None, None, None, None)], kinds)
    rows = spark.createDataFrame(
        [
            (10, 5, False, [], ["e"], ["e", "x"]), (11, 5, False, ["a", "b", "q", "q"], [], []), (12, 9, False, ["a", "b", "q"], [], []), (13, 1, True, few, [], ["x", "y"]),
            (14, 1, False, many[:4] + ["z0", "z1", "z2"], [], []), (15, 1, False, many[:2], [], []), (None, 1, False, few, ["e"], []), (1, 1, False, few, ["e"], []),
        ],
        kinds,
    )
    got = [(r.new_id, r.id, r.score) for r in related_by_signals(new, rows).orderBy("new_id", F.desc("score"), "id").collect()]
    assert got == [(1, 10, 5.0), (1, 11, 0.5), (1, 12, 0.5), (2, 1, 4.0), (2, 10, 3.0), (3, 14, round(4 / 15, 6))]
    assert related_by_signals(new, rows, 2).where("new_id = 1").select("id").collect() == [(10,), (12,)]
    assert related_by_signals(new.limit(0), rows).count() == 0
