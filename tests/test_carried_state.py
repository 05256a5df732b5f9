"""World state, batch and stream, and the carry of conversations, against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillgrove.functions.time import DAY
from quillgrove.operators import carry, world_state
from quillgrove.streaming.places import world_state_stream

ROWS = "user_id long, ts long, seq long, text string"
EVENTS = "user_id long, place string, ts long, seq long, state string, text string"


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))


def plain_places(text):
    words = [re.sub(world_state.TAIL, "", w) for w in text.split()]
    capital = lambda w: re.match(r"[A-ZÀ-ÖØ-Þ](?:[^\W_]|['-])*$", w) is not None
    glued = lambda w: re.match("(dall|all|nell|dal|dalla|alla|nella).", plain(w))
    out = {}
    for i, word in enumerate(words):
        rest = words[i + 1 :]
        if plain(word).strip("'’") not in world_state.INTRODUCING:
            if not glued(word):
                continue
            rest = [re.sub("^['’]", "", word[len(glued(word)[1]) :]), *rest]
        if not rest or not rest[0] or plain(rest[0]) in world_state.NEVER or not (capital(rest[0]) or plain(rest[0]) in world_state.COMMON):
            continue
        name = rest[:1]
        for w in rest[1:3] if capital(rest[0]) else []:
            bare = plain(w).replace("'", "")
            if bare in world_state.INTRODUCING + world_state.ENDING or glued(w) or not w or plain(w) in world_state.NEVER or not (capital(w) or plain(w) in world_state.JOINING):
                break
            name.append(w)
        while name and plain(name[-1]) in world_state.JOINING:
            name.pop()
        if name:
            out.setdefault(plain(" ".join(name)), " ".join(name))
    return list(out.values())


def test_places_of_journeys(spark):
    pool = "a A ad da dal Per in verso casa Casa Roma Roma, San Santa di Marco Nord e poi dall'Aquila nell'Universita alla Dallas io Domani , (Pisa) fuori O'Hara dopo Dopo".split()
    rng = random.Random(3)
    texts = ["siamo arrivati " + " ".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], ROWS)
    got = {}
    for r in world_state.travel_events(rows).collect():
        got.setdefault(r.seq, []).append(r.place)
        assert r.state == "arrived"
    assert got == {i: p for i, t in enumerate(texts) if (p := plain_places(t))}


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("Siamo tornati da Roma", "completed"), ("sono andata a Roma, sono tornata", "completed"), ("Siamo arrivati a Roma", "arrived"), ("sono in ufficio", "current"),
        ("Devo andare a Roma", "planned"), ("Devo andare a Roma?", None), ("Quando devo andare a Roma", None), ("Devo andare in terapia a Roma", None), ("Roma bella", None),
        ("andrò a Roma", None), (None, None), ("", None),
    ],
)
def test_states_of_journeys(spark, text, state):
    row = spark.createDataFrame([(text,)], "text string").select(world_state.travel_state(F.col("text"), world_state.plain(F.col("text"))).alias("s")).first()
    assert row.s == state


def plain_states(events, now):
    out = {}
    for user, place, ts, seq, state, text in sorted(set(events), key=lambda e: (e[2], e[3], e[5])):
        status = "completed" if state == "completed" else "planned" if state == "planned" else "current"
        if status == "completed" or now - ts <= DAY:
            out[user, place] = (status, world_state.CONFIDENCE[status], ts, text)
    return out


def random_events(seed, n, hours):
    rng = random.Random(seed)
    states = ["planned", "current", "arrived", "completed"]
    out = [(rng.randrange(4), f"P{rng.randrange(4)}", rng.randrange(hours) * 3_600_000, i, rng.choices(states, (4, 2, 2, 1))[0], f"t{i}") for i in range(n)]
    return out + out[:5]


def test_last_state_that_counts(spark):
    events = random_events(5, 200, 100)
    now = 101 * 3_600_000
    got = world_state.world_states(spark.createDataFrame(events, EVENTS), F.lit(now)).collect()
    assert {(r.user_id, r.place): (r.status, r.confidence, r.ts, r.text) for r in got} == plain_states(events, now)
    assert sum(r.n for r in got) == len({e for e in events if e[4] == "completed" or now - e[2] <= DAY})
    assert world_state.world_states(spark.createDataFrame([], EVENTS), F.lit(now)).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_of_states_equals_batch(spark, rocks, tmp_path):
    rng = random.Random(9)
    hour = 3_600_000
    events = sorted(random_events(9, 160, 96), key=lambda e: e[2])
    # within a file events come in any order and repeat; a user of its own moves the watermark past the stale ones
    files = [events[:60], events[60:110] + events[55:60], events[110:], [(99, "Z", 125 * hour, 1000, "completed", "z")]]
    # one event an hour late still counts, one that comes days late doesn't
    files[2].append((50, "Late", files[1][0][2] - 60 * hour, 1001, "completed", "too late"))
    for i, rows in enumerate(files):
        rng.shuffle(rows)
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={i}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    told = []

    def keep(df, _):
        told.extend(df.collect())

    q = world_state_stream(stream.select("user_id", "place", "ts", "seq", "state", "text")).writeStream.foreachBatch(keep).outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    last = {}
    for r in sorted(told, key=lambda r: r.version):
        last[r.user_id, r.place] = (r.status, r.confidence, r.ts, r.text)
    now = 124 * hour
    want = plain_states([e for f in files for e in f if e[0] != 50], now)
    assert {k: v for k, v in last.items() if v[0] is not None} == want
    assert any(v[0] is None for v in last.values()) and (50, "Late") not in last


FIELDS = [
    "topic", "sub_topic", "frame", "need", "need_confidence", "goal", "mode", "summary", "domain", "pressure", "technical", "brevity", "entities", "anchors", "soft", "hard",
]
TURNS = "conv_id long, turn long, " + ", ".join(
    f"{x} " + ("double" if x in ("need_confidence", "pressure", "technical", "brevity") else "array<string>" if x in ("entities", "anchors") else "boolean" if x in ("soft", "hard") else "string") for x in FIELDS
)


def plain_carry(turns):
    m = {"topic": None, "sub_topic": None, "frame": "generic", "need": None, "goal": None, "mode": "dialogue", "summary": "", "pressure": 0.0, "technical": 0.0, "brevity": 0.0, "entities": [], "anchors": []}
    for t in turns:
        clears = t["soft"] or t["domain"] in ("health", "family")
        m["topic"] = t["topic"] if t["topic"] and t["topic"] != "generic" else None if clears else m["topic"]
        m["sub_topic"] = t["sub_topic"] or (None if clears else m["sub_topic"])
        m["frame"] = t["frame"] if t["frame"] and t["frame"] != "generic" else "generic" if t["soft"] else m["frame"]
        m["need"] = t["need"] if t["need"] and (t["need_confidence"] or 0) >= 0.58 else None if t["soft"] else m["need"]
        for x in ("goal", "mode", "summary"):
            m[x] = t[x] or m[x]
        p, v = 0.0 if t["soft"] else m["pressure"], t["pressure"] or 0.0
        m["pressure"] = 0.35 * p + 0.65 * v if v > p else 0.75 * p + 0.25 * v
        m["technical"] = 0.55 * m["technical"] + 0.45 * (t["technical"] or 0.0)
        m["brevity"] = 0.5 * m["brevity"] + 0.5 * (t["brevity"] or 0.0)
        for x, most in (("entities", 12), ("anchors", 8)):
            held = [] if t["hard"] else m[x]
            for name in t[x] or []:
                name = (name or "").strip().lower()
                held = held + [name] if name and name not in held else held
            m[x] = held[-most:]
    return m


def random_turn(rng, calm):
    some = lambda *values: rng.choice([None, *values])
    names = lambda: some([], [rng.choice([None, " ", f" N{rng.randrange(30)} "]) for _ in range(rng.randrange(6))])
    return {
        "topic": some("generic", "a", "b", ""), "sub_topic": some("s", "t"), "frame": some("generic", "work"), "need": some("x", "y"), "need_confidence": some(0.58, 0.2, 0.9),
        "goal": some("g", "h", ""), "mode": some("m", "n"), "summary": some("q", "r", ""), "domain": some("health", "home", "work"), "pressure": some(rng.random(), rng.random(), 0.5),
        "technical": some(rng.random()), "brevity": rng.random(), "entities": names(), "anchors": names(), "soft": rng.random() < calm, "hard": rng.random() < calm,
    }


@pytest.mark.parametrize("parts", [1, 7])
def test_carry_equals_the_fold_however_it_is_cut(spark, parts):
    rng = random.Random(13)
    # one conversation holds most turns, and never shifts; others are short
    turns = {0: [random_turn(rng, 0.0) for _ in range(600)], **{c: [random_turn(rng, 0.2) for _ in range(rng.randrange(1, 9))] for c in range(1, 40)}}
    rows = [(c, i * 2, *(t[x] for x in FIELDS)) for c, ts in turns.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    table = spark.createDataFrame([*rows, (None, 1, *(None,) * 16), (5, None, *(None,) * 16)], TURNS)
    got = {r.conv_id: r for r in carry.smoothed(table.where("conv_id IS NOT NULL AND turn IS NOT NULL"), parts).collect()}
    want = {c: plain_carry(ts) for c, ts in turns.items()}
    for c, m in want.items():
        assert [got[c][x] for x in ("pressure", "technical", "brevity")] == pytest.approx([m[x] for x in ("pressure", "technical", "brevity")], abs=1e-12)
    if parts == 1:
        whole = {r.conv_id: r for r in carry.short_memory(table).collect()}
        assert {c: {x: r[x] for x in m if x not in ("pressure", "technical", "brevity")} for (c, m), r in zip(want.items(), map(whole.get, want), strict=True)} == {
            c: {x: v for x, v in m.items() if x not in ("pressure", "technical", "brevity")} for c, m in want.items()
        }
        assert set(whole) == set(want)


def test_pressure_as_a_function(spark):
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        f, steps = carry.Pressure(), [(rng.choice([0.0, 1.0, rng.random()]), rng.random() < 0.01) for _ in range(n)]
        for value, reset in steps:
            f.then(value, reset)
        for before in (0.0, 0.2, 0.5, 0.77, 1.0):
            p = before
            for value, reset in steps:
                p = 0.0 if reset else p
                p = 0.35 * p + 0.65 * value if value > p else 0.75 * p + 0.25 * value
            assert f(before) == pytest.approx(p, abs=1e-12)
        assert len(f.x) < 150
