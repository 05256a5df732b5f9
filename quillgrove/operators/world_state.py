"""Where a user is, plans to go or has come back from, by what they say.

``travel_events``  one row for each place that a statement about a journey names.
``state_history``  the events that count at a given time, with status and confidence.
``world_states``   the last of them for each user and place.

The stream of the same states is :func:`quillgrove.streaming.places.world_state_stream`.

All of it is built-in functions: a statement's words become an array of marked words,
places are read off at each preposition, and the state is a maximum by time, so that
a user or place with many events is a partial aggregate like any other.

Defined results: null texts say nothing; events without a time come at time 0; of one time the
greater ``seq``, then the greater text, is the later; repeated events count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.functions.time import DAY, ascii_bounds, plain

# fixed values: patterns of plain text, in the language of the records
QUESTIONS = [
    r"\bti\s+ricordi\b", r"\bricordi\b", r"\bsai\s+se\b", r"\bche\s+ne\s+pensi\b", r"\bsecondo\s+te\b", r"\bposso\s+farti\s+una\s+domanda\b", r"\bla\s+domanda\s+vera\b",
    r"\bquando\b", r"\bdove\b", r"\bcosa\b", r"\bcome\b", r"\bperche\b", r"\bquanto\b", r"\bquale\b", r"\bquali\b",
]
THEORY = [
    r"\bla\s+domanda\s+vera\b", r"\bsecondo\s+te\b", r"\bche\s+ne\s+pensi\b", r"\bquale\s+differenza\b", r"\bi\s+due\s+\w+\s+sono\b", r"\b\w+\s+patern[oa]\b",
    r"\bterapia\b", r"\bgene\b", r"\bgeni\b", r"\bscientific\w*\b", r"\bteoric\w*\b", r"\be\s+affett[oa]\s+da\b", r"\bha\s+\d+\s+anni\b",
]
MOVES = [
    r"\bandare\b", r"\bandat[oaie]\b", r"\barrivat[oaie]\b", r"\btornat[oaie]\b", r"\brientrat[oaie]\b", r"\bpartire\b", r"\bpartit[oaie]\b", r"\bpartiamo\b",
    r"\bpartiremo\b", r"\bsiamo\s+a\b", r"\bsono\s+a\b", r"\be\s+a\b", r"\bsiamo\s+in\b", r"\bsono\s+in\b", r"\be\s+in\b", r"\bsto\s+a\b", r"\bstiamo\s+a\b",
    r"\bvado\s+a\b", r"\bvado\s+in\b", r"\bandiamo\s+a\b", r"\bandiamo\s+in\b", r"\bsiamo\s+qui\b", r"\bsono\s+qui\b", r"\bsiamo\s+arrivati\b",
    r"\bsono\s+arrivato\b", r"\bsiamo\s+tornati\b", r"\bsono\s+tornato\b",
]
STATES = {
    "completed": [
        r"\bsono\s+tornat[oa]\b", r"\bsiamo\s+tornati\b", r"\bsono\s+rientrat[oa]\b", r"\bsiamo\s+rientrati\b", r"\btornat[oaie]\s+(da|dal|dalla|dall)\b",
        r"\brientrat[oaie]\s+(da|dal|dalla|dall)\b", r"\bsiamo\s+andati\b.*\bsiamo\s+tornati\b", r"\bsono\s+andat[oa]\b.*\bsono\s+tornat[oa]\b",
    ],
    "arrived": [r"\bsono\s+arrivat[oa]\b", r"\bsiamo\s+arrivati\b", r"\barrivat[oaie]\s+a\b", r"\bappena\s+arrivat[oaie]\b"],
    "current": [
        r"\bsono\s+a\b", r"\bsiamo\s+a\b", r"\be\s+a\b", r"\bsono\s+in\b", r"\bsiamo\s+in\b", r"\be\s+in\b", r"\bsto\s+a\b", r"\bstiamo\s+a\b", r"\bsono\s+qui\b",
        r"\bsiamo\s+qui\b",
    ],
    "planned": [
        r"\bdomani\s+part[oi]\b", r"\bdomani\s+partiamo\b", r"\bdevo\s+andare\b", r"\bdobbiamo\s+andare\b", r"\bandremo\b", r"\bpartiremo\b",
        r"\bsto\s+per\s+partire\b", r"\bsi\s+parte\b", r"\bpartiamo\s+per\b", r"\bvado\s+(a|in)\b", r"\bandiamo\s+(a|in)\b",
    ],
}
# fixed values: words that are, can't be, join, end or introduce the name of a place
COMMON = ["casa", "lavoro", "scuola", "ospedale", "aeroporto", "stazione", "ufficio", "universita", "farmacia"]
NEVER = [
    "io", "tu", "lui", "lei", "noi", "voi", "loro", "mi", "ti", "si", "la", "il", "lo", "le", "gli", "un", "una", "uno", "questa", "questo", "domanda", "gene",
    "geni", "terapia", "secondo", "quale", "ecco", "oggi", "domani", "ieri", "ora", "adesso", "ciao", "buongiorno", "buonasera",
]
JOINING = ["di", "del", "della", "dei", "degli", "delle", "san", "santa", "santo"]
ENDING = ["e", "poi", "ma", "pero", "oppure", "o", "anche", "quindi", "dopo", "prima"]
INTRODUCING = ["a", "ad", "da", "dal", "dalla", "dall", "per", "in", "verso", "dentro"]
GLUED = "^(dall|all|nell|dal|dalla|alla|nella)."
CAPITAL = r"^[A-ZÀ-ÖØ-Þ][\p{L}0-9'-]*$"
TAIL = r"""[.,;:!?()\[\]{}"']+$"""
# fixed values: how sure a status is; below the least it doesn't count
CONFIDENCE = {"completed": 0.95, "current": 0.85, "planned": 0.75, "stale_current": 0.4, "stale_planned": 0.4}
LEAST = 0.75


def _any(said: Column, patterns: list[str]) -> Column:
    # every pattern begins at a word's edge: looked for once, not once a pattern at every character
    return F.rlike(said, F.lit(ascii_bounds(r"\b(?:" + "|".join(p.removeprefix(r"\b") for p in patterns) + ")")))


def travel_state(text: Column, said: Column) -> Column:
    """completed, arrived, current or planned; null for questions, theory and what names no movement.  ``said`` is the plain text."""
    tells = _any(said, MOVES) & ~F.contains(F.coalesce(text, F.lit("")), F.lit("?")) & ~_any(said, QUESTIONS) & ~_any(said, THEORY)
    named = F.coalesce(*[F.when(_any(said, patterns), state) for state, patterns in STATES.items()])
    return F.when(tells, named)


def _marked(word: Column) -> Column:
    key = plain(word)
    bare = F.translate(key, "'’", "")
    glued = F.rlike(key, F.lit(GLUED))
    after = F.regexp_replace(F.substr(word, F.length(F.regexp_extract(key, GLUED, 1)) + 1), "^['’]", "")
    introduces = bare.isin(INTRODUCING)
    return F.struct(
        word.alias("word"), F.rlike(word, F.lit(CAPITAL)).alias("capital"), ((word != "") & ~key.isin(NEVER)).alias("good"), key.isin(JOINING).alias("joins"),
        (introduces | bare.isin(ENDING) | glued).alias("stops"), introduces.alias("introduces"), F.when(glued & ~introduces, after).alias("after"),
    )


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: as a generator's output it isn't written out again in every later lambda that reads it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _names(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_places``: names of up to three words after a preposition or glued to one, the first form of each."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, TAIL, ""))
    rows = _once(rows, "_words", F.transform(words, _marked))
    word = lambda i: F.get("_words", i)

    def begins(x: Column, i: Column) -> Column:
        first = F.when(x["introduces"], word(i + 1)["word"]).otherwise(x["after"])
        return F.struct(first.alias("first"), (i + x["introduces"].cast("int")).alias("at"))

    def may_begin(s: Column) -> Column:
        key = plain(s["first"])
        return s["first"].isNotNull() & (s["first"] != "") & ~key.isin(NEVER) & (key.isin(COMMON) | F.rlike(s["first"], F.lit(CAPITAL)))

    def name(s: Column) -> Column:
        second, third = word(s["at"] + 1), word(s["at"] + 2)
        goes_on = lambda x: F.coalesce(~x["stops"] & x["good"] & (x["capital"] | x["joins"]), F.lit(False))
        two = F.rlike(s["first"], F.lit(CAPITAL)) & goes_on(second)
        # a joining word at the end belongs to no name
        size = F.when(two & goes_on(third) & ~third["joins"], 3).when(two & ~second["joins"], 2).when(~plain(s["first"]).isin(JOINING), 1).otherwise(0)
        return F.array_join(F.slice(F.array(s["first"], F.coalesce(second["word"], F.lit("")), F.coalesce(third["word"], F.lit(""))), 1, size), " ")

    rows = _once(rows, "_begins", F.filter(F.transform("_words", begins), may_begin))
    rows = _once(rows, "_named", F.filter(F.transform("_begins", name), lambda x: x != ""))
    rows = _once(rows, "_keys", F.transform("_named", plain))
    return rows.withColumn("_places", F.filter("_named", lambda x, i: F.array_position("_keys", F.get("_keys", i)) == i + 1))


def travel_events(rows: DataFrame) -> DataFrame:
    """``user_id, place, ts, seq, state, text`` from statements (``user_id, ts`` in ms``, seq, text``)."""
    said = _once(rows.select("user_id", F.coalesce("ts", F.lit(0)).cast("long").alias("ts"), "seq", "text"), "_said", plain(F.col("text")))
    moves = _once(said, "state", travel_state(F.col("text"), F.col("_said"))).where("state IS NOT NULL").drop("_said")
    return _names(moves).select("user_id", F.explode("_places").alias("place"), "ts", "seq", "state", "text")


def status_of(state: Column, age_ms: Column) -> Column:
    """What a state means at that age: plans and presence are stale after a day."""
    status = F.when(state == "completed", "completed").when(state == "planned", "planned").when(state.isin("current", "arrived"), "current")
    return F.when((age_ms > DAY) & (status != "completed"), F.concat(F.lit("stale_"), status)).otherwise(status)


def confidence_of(status: Column) -> Column:
    return F.coalesce(*[F.when(status == name, value) for name, value in CONFIDENCE.items()], F.lit(0.5))


def state_history(events: DataFrame, now: Column, least: float = LEAST) -> DataFrame:
    """The events that count at ``now`` (ms), with ``status`` and ``confidence``."""
    known = events.withColumn("status", status_of(F.col("state"), now - F.col("ts"))).withColumn("confidence", confidence_of(F.col("status")))
    return known.where((F.col("confidence") >= least) & F.col("status").isNotNull())


def world_states(events: DataFrame, now: Column, least: float = LEAST) -> DataFrame:
    """``user_id, place, status, confidence, ts, text, n``: the last event that counts, and how many do."""
    counted = state_history(events, now, least)
    last = F.max_by(F.struct("status", "confidence", "ts", "text"), F.struct("ts", "seq", "text")).alias("last")
    each = counted.groupBy("user_id", "place").agg(last, F.count_distinct("ts", "seq").alias("n"))
    return each.select("user_id", "place", "last.*", "n")
