"""Objects in replies, names in texts and current neighbours against plain loops."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrove.operators import current_neighbours as N
from quillgrove.operators import mentions as M
from quillgrove.operators import replies as R
from tests.oracle import connect


def plain_object(text):
    text = re.sub("(?i)```(?:json)?", "", text or "")
    depth, quoted, skip, start = 0, False, False, text.find("{")
    for i in range(start, len(text)) if start >= 0 else ():
        if skip:
            skip = False
        elif text[i] == "\\":
            skip = True
        elif text[i] == '"':
            quoted = not quoted
        elif not quoted and text[i] in "{}":
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def test_first_object_equals_a_scan_by_character(spark):
    rng = random.Random(5)
    parts = ["{", "}", '"', "\\", '\\"', "a", "è😀", "\n", " ", "```json\n", "```", '{"k": "}"}', "x" * 50]
    texts = [None, "", "{}", "}{", '{"a": {"b": "}\\"}"}} tail }', "{" * 3000 + "}" * 3000, *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.object for r in rows.select("id", R.first_object(F.col("text")).alias("object")).collect()}
    assert got == {i: plain_object(t) for i, t in enumerate(texts)}
    assert sum(x is not None for x in got.values()) > 50


def test_moods_of_odd_replies(spark):
    texts = [None, "no object", '{"labels": "none", "joy": true, "confidence": "x"}', '{"labels": {"joy": null, "anger": "0.9"}, "joy": 0.2}', '{"labels": {"joy": }}', '{"labels": {"calm": NaN}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in R.moods(rows).collect()}
    for i in (0, 1, 4):
        assert [got[i][k] for k in R.BASELINE] == list(R.BASELINE.values()) and got[i].confidence == R.UNREAD
    assert (got[2].joy, got[2].confidence) == (1.0, 0.65) and (got[3].joy, got[3].anger, got[3].confidence) == (0.2, 0.9, 0.65)
    assert R.moods(rows.limit(0)).count() == 0


def test_fixes_of_odd_replies(spark):
    fix = {"recommendedFixes": ["loose", {"title": " a ", "priority": "urgent"}, {"title": "b}", "area": "ux", "priority": "low"}, {}]}
    texts = [f"so: {json.dumps(fix)} end", '{"recommendedFixes": "none"}', "{broken fix}\n* test one", "\n".join(f"- fix {i}" for i in range(20)), None, ""]
    got = R.fixes(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id", "nth").collect()
    assert [(r.id, r.nth, r.title, r.priority, r.area) for r in got if r.id < 3] == [
        (0, 0, "Fix consigliato 1", "high", "backend"), (0, 1, "a", "high", "backend"), (0, 2, "b}", "low", "ux"), (0, 3, "Fix consigliato 4", "medium", "backend"),
        (2, 0, "{broken fix}", "high", "backend"), (2, 1, "test one", "high", "backend"),
    ]
    assert [r.title for r in got if r.id == 3] == [f"fix {i}" for i in range(8)] and not [r for r in got if r.id > 3]


def plain_mentions(text):
    """Looks at the rest of the text for every run, and at the names again for every place."""
    text, counts, kinds = text or "", {}, {}
    openings = [0] + [i for i in range(1, len(text)) if re.match("[A-ZÀ-Ý]", text[i]) and re.search(r"[.!?]\s+$", text[max(0, i - 60) : i])]
    for m in re.finditer(r"(?a:\b)[A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[A-ZÀ-Ý][a-zà-ÿ]+){0,2}(?a:\b)", text):
        words = m[0].split()
        name = " ".join(words[1:] if words[0] in M.NO_NAMES else words)
        verb = re.search(rf"\s+(?:{M.VERBS})(?a:\b)", text[m.end() :], re.IGNORECASE)
        if name and name not in M.NO_NAMES and not (m.start() in openings and " " not in name and not verb):
            counts[name] = counts.get(name, 0) + 1
            kinds[name] = "recurring_proper_noun" if counts[name] > 1 else "probable_proper_noun"
    for m in re.finditer(rf"(?a:\b)(?:{M.OF_PLACE})\s+([A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[A-ZÀ-Ý][a-zà-ÿ]+){{0,2}})(?a:\b)", text):
        if m[1] in counts or m[1].split()[0] not in M.NO_NAMES:
            kinds[m[1]] = "place"
            counts.setdefault(m[1], 1)
    return {name: (kinds[name], n) for name, n in counts.items()}


def test_mentions_equal_a_plain_reading(spark, small):
    rng = random.Random(6)
    parts = ["Anna", "Marco Rossi", "Il", "Oggi", "Roma", "a", "in", "vicino a", "da", "va", "è", "ha", "Deve", ".", "! ", "\n", "  ", "Èlia", "McDon", "x9"]
    texts = [None, "", *(" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400))]
    texts += [t for (t,) in connect(small).execute("SELECT text FROM documents LIMIT 60").fetchall()]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in M.entity_mentions(rows).collect():
        got.setdefault(r.id, {})[r.entity] = (r.kind, r.n)
        assert texts[r.id].startswith((r.entity.split()[0], *M.NO_NAMES), r.first_at)
    assert got == {i: m for i, t in enumerate(texts) if (m := plain_mentions(t))}


def test_a_very_long_text_is_read_once():
    assert len(M.mentions_of("Poi Anna Bianchi sta a Roma. Marco ha. " * 100_000)) == 3


# ---------------------------------------------------------------- neighbours


def store(spark, n=300, stale=0.5, broken=()):
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(n, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[5] = unit[4]
    points, identities = [], []
    for i in range(n):
        user, old = i % 3, i >= 20 and rng.random() < stale
        points.append((i, f"{'q' if old else 'p'}{i}", user, i, f"{'old' if old or i in broken else 'new'}{i}", "m", "r", unit[i].tolist()))
        if i % 11 or i < 20:
            identities.append((f"p{i}", user, i, f"new{i}", "m", "r"))
    names = "point_id string, user long, memory_id long, content_hash string, model string, revision string"
    good = {p[0] for p in points if p[1][0] == "p" and (p[0] % 11 or p[0] < 20)}
    return spark.createDataFrame(points, f"id long, {names}, unit array<double>"), spark.createDataFrame(identities, names), unit, good


@pytest.mark.parametrize("most", [0, 40, 4000])
def test_hits_equal_a_filter_without_bound(spark, most):
    points, identities, unit, good = store(spark, stale=0.8)
    hits, report = N.current_neighbours(points, identities, points.where("id < 12"), 4, 0.1, most)
    want = set()
    for q in range(12):
        near = sorted((-float(unit[q] @ unit[i]), i) for i in good if i != q and i % 3 == q % 3 and unit[q] @ unit[i] >= 0.1)[:4]
        want |= {(q, i, n) for n, (_, i) in enumerate(near, 1)}
    assert {(r.id, r.other, r.nth) for r in hits.collect()} == want
    seen = {r.id: r for r in report.collect()}
    assert len(seen) == 12 and all(r.hits == sum(x[0] == r.id for x in want) and (r.status == "COMPLETE") == (r.hits == 4) for r in seen.values())
    assert max(r.rounds for r in seen.values()) == {0: 1}.get(most, max(r.rounds for r in seen.values())) and min(r.rounds for r in seen.values()) >= 1


def test_conflicts_are_fatal_and_stale_queries_refused(spark):
    points, identities, unit, _ = store(spark, broken=(5,))
    with pytest.raises(N.IdentityConflict):
        N.current_neighbours(points, identities, points.where("id = 4"), 3)
    points, identities, _, good = store(spark)
    stale = next(i for i in range(20, 300) if i not in good)
    hits, report = N.current_neighbours(points, identities, points.where(f"id = {stale}"), 3)
    assert hits.count() == 0 and [(r.id, r.status) for r in report.collect()] == [(stale, "QUERY_NOT_CURRENT")]
    hits, report = N.current_neighbours(points, identities, points.limit(0), 3)
    assert hits.count() == 0 and report.count() == 0
