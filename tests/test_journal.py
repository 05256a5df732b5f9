"""The journal's appends under replay, and its states against a pass over each run's events in order."""

import random

import pytest

from quillgrove.operators import journal as J

EVENTS = J.SCHEMA.replace(", event_id string", "")


def event(run, cluster, kind, at, **more):
    row = dict.fromkeys(J.FIELDS) | {"run_id": run, "cluster_id": cluster, "event_type": kind, "timestamp": at, "sources": [], "claim_sources": []} | more
    return tuple(row[x] for x in J.FIELDS)


def plain_cluster(events):
    values = lambda x, of=None: {e[x] for e in events if e[x] and (of is None or e["event_type"] == of)}
    reasons = set()
    for code, found in (
        ("ATTEMPT_ID_CONFLICT", values("attempt_id")), ("TRANSACTION_ID_CONFLICT", values("transaction_id")), ("CLAIM_ID_CONFLICT", values("claim_id", "SOURCES_CLAIMED")),
        ("CLUSTER_RECORD_ID_CONFLICT", values("cluster_record_id", "CLUSTER_PERSISTED")), ("SOURCE_IDS_CONFLICT", {tuple(sorted(e["sources"])) for e in events if e["sources"]}),
    ):
        if len(found) > 1:
            reasons.add(code)
    step = 0
    for e in events:
        if J.STEPS[e["event_type"]] < step:
            reasons.add("CLUSTER_EVENT_ORDER_INVALID")
        step = max(step, J.STEPS[e["event_type"]])
        if e["event_type"] == "SOURCES_CLAIMED" and (not e["claim_attempt"] or e["claim_attempt"] != e["attempt_id"] or sorted(e["claim_sources"]) != sorted(e["sources"])):
            reasons.add("CLAIM_CORRELATION_MISMATCH")
    kinds = {e["event_type"] for e in events}
    state = J.AMBIGUOUS if reasons else next(s for k, s in J.MEANING.items() if k in kinds)
    sets = [e["sources"] for e in events if e["sources"]]
    return {"state": state, "reasons": reasons, "sources": sets[0] if sets and "SOURCE_IDS_CONFLICT" not in reasons else [], "events": events}


def plain_run(events):
    events = [e for e in events if not e["event_type"].startswith("RECOVERY_")]
    grouped, reasons = {}, set()
    for e in events:
        if e["event_type"] in J.STEPS and not (e["event_type"] == "RUN_RECONCILED" and e["cluster_id"] is None):
            if e["cluster_id"]:
                grouped.setdefault(e["cluster_id"], []).append(e)
            else:
                reasons.add("MISSING_CLUSTER_CORRELATION")
    clusters = {c: plain_cluster(es) for c, es in grouped.items()}
    for code, owned in (
        ("CLAIM_ID_SHARED_ACROSS_CLUSTERS", lambda c: {e["claim_id"] for e in c["events"] if e["event_type"] == "SOURCES_CLAIMED" and e["claim_id"]}),
        ("ATTEMPT_ID_SHARED_ACROSS_CLUSTERS", lambda c: {e["attempt_id"] for e in c["events"] if e["attempt_id"]}), ("SOURCE_ASSIGNED_TO_MULTIPLE_CLUSTERS", lambda c: set(c["sources"])),
    ):
        held = [x for c in clusters.values() for x in owned(c)]
        if len(held) > len(set(held)):
            reasons.add(code)
    ends = {e["event_type"] for e in events if e["event_type"] in J.RUN_TERMINAL and e["cluster_id"] is None}
    open_ = [c for c in clusters.values() if c["state"] not in J.TERMINAL and not c["reasons"]]
    bad = [c for c in clusters.values() if c["reasons"]]
    if len(ends) > 1:
        reasons.add("RUN_TERMINAL_CONFLICT")
    if ends and (open_ or bad):
        reasons.add("RUN_TERMINAL_WITH_NONTERMINAL_CLUSTER")
    reasons |= {r for c in clusters.values() for r in c["reasons"]}
    states = [c["state"] for c in clusters.values()]
    if reasons:
        state = J.AMBIGUOUS
    elif ends & {"RUN_COMPLETED", "RUN_RECONCILED"}:
        state = "COMPLETE"
    elif ends:
        state = "FAILED_COMPLETE"
    elif len(states) > 1 and open_:
        state = "MULTI_CLUSTER_INCOMPLETE"
    elif len(states) == 1:
        state = "COMMIT_SUCCEEDED_NO_RUN_COMPLETION" if states == ["COMMITTED"] else states[0]
    else:
        state = "ALL_CLUSTERS_TERMINAL_NO_RUN_COMPLETION" if states else J.AMBIGUOUS
    return state, sorted(reasons), len(states), len(open_)


def random_journal(seed):
    rng = random.Random(seed)
    out, now = [], 0
    for r in range(150):
        messy = rng.random() < 0.5
        slip = lambda x: rng.random() < x * messy  # noqa: E731, B023
        for c in range(rng.randrange(4)):
            own = {"attempt_id": f"a{r}.{0 if slip(0.1) else c}", "transaction_id": f"t{c}"}
            good, done = rng.random() < 0.7, rng.randrange(1, 9)
            path = ["CLUSTER_SELECTED", "CLUSTER_PERSISTED", "SOURCES_CLAIMED", "SYNTHESIS_STARTED", "SYNTHESIS_SUCCEEDED" if good else "SYNTHESIS_FAILED"]
            path = (path + (["COMMIT_STARTED", rng.choice(["COMMIT_SUCCEEDED", "COMMIT_FAILED"])] if good else ["SOURCES_FAILED"]))[:done]
            if slip(0.1):
                rng.shuffle(path)
            for kind in path:
                now += 1
                src = [f"s{r}.{0 if slip(0.05) else c}", "y"] if kind == "SOURCES_CLAIMED" else []
                src = [f"{x}.{c}" if x == "y" and not slip(0.2) else x for x in src]
                more = own | ({"sources": src, "claim_sources": src[:1] if slip(0.1) else src[::-1], "claim_id": f"c{c}", "claim_attempt": own["attempt_id"]} if src else {})
                more |= {"attempt_id": "other"} if slip(0.03) else {}
                out.append(event(f"r{r:03d}", None if slip(0.03) else f"k{c}", kind, now, **more))
        for kind in [k for k in J.RUN_TERMINAL if rng.random() < 0.25] + ["RUN_STARTED", "RECOVERY_STARTED"]:
            now += 1
            out.append(event(f"r{r:03d}", None, kind, now))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_states_equal_a_pass_in_order(spark, seed):
    rows = [(*e, i) for i, e in enumerate(random_journal(seed))]
    table = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), EVENTS)
    named = [dict(zip(J.FIELDS, r, strict=False)) for r in rows]
    want = {run: plain_run([e for e in named if e["run_id"] == run]) for run in {e["run_id"] for e in named}}
    got = {r.run_id: (r.classification, r.reasons, r.clusters, r.incomplete) for r in J.runs(table).collect()}
    assert got == want and len({x[0] for x in want.values()}) > 5
    assert J.runs(table.limit(0)).count() == 0


def test_replays_change_nothing(spark, tmp_path):
    path, events = str(tmp_path / "journal"), random_journal(3)[:60]
    table = lambda rows: spark.createDataFrame(rows, J.SCHEMA.split(", event_id")[0])
    assert J.read_journal(spark, path).count() == 0
    J.append(table(events[:30] + events[:10]), path, 0)
    J.append(table(events[20:50]), path, 1)
    before = sorted((r.sequence, r.event_id) for r in J.read_journal(spark, path).collect())
    J.append(table(events[20:50]), path, 1)
    assert sorted((r.sequence, r.event_id) for r in J.read_journal(spark, path).collect()) == before
    J.append(table(events), path, 2)
    whole = sorted(J.read_journal(spark, path).collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in whole] == list(range(1, 61)) and [(r.run_id, r.event_type, r.timestamp) for r in whole] == [(e[0], e[2], e[3]) for e in events]


def test_a_stream_started_again_appends_once(spark, tmp_path):
    schema, events = J.SCHEMA.split(", event_id")[0], random_journal(4)[:40]
    for i in range(2):
        spark.createDataFrame(events[i * 15 : i * 15 + 25], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        q = J.append_stream(stream, str(tmp_path / "journal")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.sequence for r in J.read_journal(spark, str(tmp_path / "journal")).collect()) == list(range(1, 41))
