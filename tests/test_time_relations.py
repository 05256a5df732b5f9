"""Relations and supersession of statements against all pairs in plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillgrove.functions import time as T
from quillgrove.operators import time_relations as R

ROWS = "id long, user_id long, ts long, role string, text string, tags array<string>, domains array<string>"


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))


def has(text, pattern):
    return re.search(pattern, plain(text), re.ASCII) is not None


def any_of(text, phrases):
    return has(text, T.phrase_pattern(phrases))


def intent(text, role):
    if "?" in (text or "") or any_of(text, T.QUESTION):
        return "query"
    if role == "assistant" and any_of(text, T.SUMMARY):
        return "completed_event" if any_of(text, T.DONE) else "generic"
    if any_of(text, T.COMPLETED) or role == "assistant" and any_of(text, T.ALREADY) and any_of(text, T.DONE):
        return "completed_event"
    if any_of(text, T.PAST):
        return "past_event"
    if any_of(text, T.FUTURE):
        return "generic" if role == "assistant" else "future_intent"
    return "current_state" if any_of(text, T.CURRENT) else "generic"


class Statement:
    def __init__(self, id, user_id, ts, role, text, tags, domains):
        self.id, self.user, self.ts, self.text = id, user_id, ts, text
        self.role = R.ROLES.get(plain(role).strip(), "unknown")
        self.intent = intent(text, self.role)
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        named = {plain(x) for x in re.findall(rf"(?<![A-Za-z0-9_])[A-Z][{letters}'-]*[A-Za-z](?![A-Za-z0-9_])", text or "") if len(x) >= 3}
        tagged = {plain(x).strip() for x in tags or [] if len(plain(x).strip()) >= 3}
        self.ents, self.words = named, {w for w in plain(text).split() if len(w) >= 4 and w not in R.STOPWORDS}
        self.all_ents, self.domains = named | tagged, tagged | {plain(x).strip() for x in domains or [] if len(plain(x).strip()) >= 3}
        word = rf"[{letters}][{letters}0-9'-]*"
        cap = rf"[A-ZÀ-ÖØ-Þ][{letters}0-9'-]*"
        self.places = {plain(x) for x in re.findall(rf"(?<![A-Za-z0-9_])(?:a|ad|da|dal|dalla|per|in|verso)\s+({cap}(?:\s+{cap}){{0,2}}|{word})", text or "")}

    def shares_text(self, other):
        return bool(self.ents & other.ents or self.words & other.words)

    def shares(self, other):
        return bool(self.all_ents & other.all_ents or self.domains & other.domains or self.words & other.words)


def closes(o, n):
    if has(o.text, R.CALL_INTENT) and has(n.text, R.CALL_DONE) and o.shares_text(n):
        return "completes", 0.9
    if has(o.text, R.FEVER) and has(n.text, R.FEVER_DONE):
        if o.ents & n.ents:
            return "updates", 0.88
        if has(n.text, R.FEVER_NAMED):
            return "updates", 0.72
    if has(o.text, R.TOMORROW) and has(o.text, R.LEAVING) and has(n.text, R.JOURNEY_DONE):
        if o.places & n.places:
            return "completes", 0.9
        if has(n.text, R.JOURNEY_CLOSED) and o.shares_text(n):
            return "completes", 0.68
    return None


def relation(o, n):
    if not o.shares(n):
        return "none", 0.0
    if "query" in (o.intent, n.intent):
        return "related", 0.2
    kind, c = closes(o, n) or (
        ("related", 0.35) if o.intent == "past_event" else ("confirms", 0.55) if o.intent == n.intent
        else ("related", 0.55) if n.intent == "completed_event" and o.intent in ("future_intent", "current_state") else ("related", 0.4)
    )
    if n.role == "assistant" and o.role == "user":
        return ("confirms" if kind in R.REPLACING else kind), max(0, c - 0.25)
    if n.role == "user" and o.role == "assistant" and kind in R.REPLACING:
        return kind, min(1, c + 0.05)
    return kind, c


def superseded(rows):
    out = {}
    for o in rows:
        out[o.id] = (None, None, None)
        if o.intent in ("query", "past_event", "completed_event"):
            continue
        for n in sorted((n for n in rows if n.user == o.user and n.ts > o.ts and n.intent != "query"), key=lambda n: (n.ts, n.id)):
            kind, c = relation(o, n)
            if kind in R.REPLACING and c >= R.LEAST:
                out[o.id] = (n.id, kind, round(c, 6))
                break
    return out


PARTS = [
    "Domani devo andare a Roma", "domani partiamo per casa", "Siamo tornati da Roma", "sono tornato da casa mia", "viaggio finito", "appuntamento fatto con Marta", "Devo chiamare Marta",
    "dobbiamo parlare con Luca Bianchi", "Ho chiamato Marta", "ho sentito Luca", "Marta ha la febbre", "temperatura alta", "Marta sta meglio", "la febbre è passata", "temperatura scesa",
    "sfebbrata", "ora siamo qui", "ieri ho visto Luca", "cosa fai?", "non devi più andare", "perché no", "Città Alta", "pioggia forte", "", "a Po", "da Po",
]


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, *[". ".join(rng.sample(PARTS, rng.choice([1, 1, 2])))] * 15])
        tags = rng.choice([None, [], ["Salute"], ["viaggi", None, "po"]])
        rows.append((i, rng.randrange(4), rng.randrange(60) * 7_200_000, rng.choice(["user", "Utente", "assistant", "bot", "system", None]), text, [t for t in tags if t] if tags else tags, rng.choice([None, ["casa"], ["salute"]])))
    return rows


@pytest.mark.parametrize("slice_ms", [3_600_000, R.SLICE, 10**12])
def test_supersession_equals_all_pairs(spark, slice_ms):
    rows = random_rows(3, 260)
    frame = spark.createDataFrame(rows + rows[:9], ROWS).withColumns({c: F.lit(1) for c in ("rule", "signal", "slice", "first")})
    got = {r.id: (r.superseded_by, r.relation, r.confidence) for r in R.supersede(frame.repartition(3), slice_ms).collect()}
    want = superseded([Statement(*r) for r in rows])
    assert got == want and sum(w[0] is not None for w in want.values()) > 40


def test_relations_equal_the_rules(spark):
    rows = random_rows(5, 90)
    said = R.statements(spark.createDataFrame(rows, ROWS))
    sides = [said.select(*(F.col(c).alias(f"{s}_{c}") for c in said.columns)) for s in ("old", "new")]
    pairs = sides[0].join(sides[1], F.col("old_user_id") == F.col("new_user_id"))
    by_id = {r[0]: Statement(*r) for r in rows}
    got = {(r.old_id, r.new_id): (r.relation, r.confidence) for r in R.relation(pairs).collect()}
    want = {k: relation(by_id[k[0]], by_id[k[1]]) for k in got}
    assert got == {k: (r, round(c, 6)) for k, (r, c) in want.items()} and len({r for r, _ in want.values()}) == 5


@pytest.mark.parametrize(
    ("old", "new", "roles", "expected"),
    [
        ("Devo chiamare Marta", "Ho chiamato Marta", ("user", "user"), ("completes", 0.9)),
        ("Marta ha la febbre", "Marta sta meglio", ("user", "user"), ("updates", 0.88)),
        ("Il bimbo ha la febbre", "Non ha piu febbre", ("user", "user"), ("updates", 0.72)),
        ("Domani devo andare a Roma", "Sono tornato da Roma", ("user", "user"), ("completes", 0.9)),
        ("Domani devo partire, lungo viaggio", "viaggio finito", ("user", "user"), ("completes", 0.68)),
        ("Devo chiamare Marta", "Ho chiamato Marta", ("assistant", "user"), ("completes", 0.95)),
        ("Devo chiamare Marta", "Ho chiamato Marta", ("user", "assistant"), (None, None)),
        ("Devo chiamare Marta", "Ho chiamato Luca", ("user", "user"), (None, None)),
    ],
)
def test_completions(spark, old, new, roles, expected):
    rows = spark.createDataFrame([(1, 1, 0, roles[0], old, None, None), (2, 1, 5, roles[1], new, None, None)], ROWS)
    first = R.supersede(rows).where("id = 1").first()
    assert (first.relation, first.confidence) == expected


def test_no_statements(spark):
    assert R.supersede(spark.createDataFrame([], ROWS)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, None, None), (1, None, None, None, None, None, None), (2, 1, 3, "user", "x" * 200_000, None, None)], ROWS)
    assert sorted((r.id, r.superseded_by) for r in R.supersede(odd).collect()) == [(1, None), (2, None)]
