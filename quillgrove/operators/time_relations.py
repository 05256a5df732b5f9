"""What a newer statement says of an older one, and which statements newer ones have replaced.

``statements``  signals of each statement: entities, domains, salient words, places, intent, and
                which actions it announces or closes.
``relation``    relation and confidence of pairs that a caller has joined.
``supersede``   per statement the first newer one of its user that completes or updates it.

Statements that could replace one another share an action (a call, a fever, a journey)
and a signal, so ``supersede`` joins no pairs: both sides go into one inverted index of
(user, rule, signal), and each entry looks for the next closing entry in time.  An
index key is cut into slices of time; inside one a window looks ahead, beyond it the
first closing entry of the next slice that has any is taken, which is a row a slice.

Defined results: null texts say nothing; statements without time come at time 0, of one
time neither is newer; repeated rows are one statement; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions.time import ascii_bounds, plain, temporal_intent
from quillgrove.session import materialize

#: Below this confidence nothing is replaced.
LEAST = 0.65
#: Relations that replace the older statement.
REPLACING = ("completes", "updates", "contradicts")
#: Milliseconds of one slice of an index key.
SLICE = 86_400_000

# fixed values: words that tell nothing of what a statement is about
STOPWORDS = [
    "devo", "dobbiamo", "domani", "andare", "andremo", "faremo", "partire", "chiamare", "chiamato", "fatto", "visto", "sono", "siamo", "stato", "stata",
    "tornato", "tornati", "finito", "passato", "risolto", "meglio", "video",
]
# fixed values: patterns of statements that announce an action and of those that close it
CALL_INTENT = r"\b(devo|dobbiamo)\s+(chiamare|sentire|parlare\s+con)\b"
CALL_DONE = r"\b(ho|abbiamo)\s+chiamato\b|\bsentito\b|\bparlato\s+con\b"
FEVER = r"\bfebbre\b|\btemperatura\b"
FEVER_DONE = r"\bsta\s+meglio\b|\bfebbre\s+e\s+passata\b|\bnon\s+ha\s+piu\s+febbre\b|\btemperatura\s+scesa\b|\bsfebbrat[oa]\b"
FEVER_NAMED = r"\bfebbre\b|\btemperatura\b|\bsfebbrat[oa]\b"
TOMORROW = r"\bdomani\b"
LEAVING = r"\b(devo|dobbiamo|andare|partire|partiamo)\b"
JOURNEY_DONE = r"\bsono\s+andato\b|\bsiamo\s+andati\b|\bsono\s+tornato\b|\bsiamo\s+tornati\b|\bviaggio\s+finito\b|\bappuntamento\s+fatto\b"
JOURNEY_CLOSED = r"\bviaggio\s+finito\b|\bappuntamento\s+fatto\b"
ENTITY = r"\b[A-ZÀ-ÖØ-Þ][\p{L}'-]{2,}\b"
PLACE = r"\b(?:a|ad|da|dal|dalla|per|in|verso)\s+([A-ZÀ-ÖØ-Þ][\p{L}0-9'-]*(?:\s+[A-ZÀ-ÖØ-Þ][\p{L}0-9'-]*){0,2}|\p{L}[\p{L}0-9'-]*)"
ROLES = {"user": "user", "utente": "user", "human": "user", "assistant": "assistant", "assistente": "assistant", "ai": "assistant", "bot": "assistant", "system": "system"}

#: Rules by rank: what the older statement announces, and the confidence of a newer one that closes it.
CALL, SUBJECT_FEVER, NAMED_FEVER, PLACE_JOURNEY, CLOSED_JOURNEY = range(5)
CONFIDENCE = {CALL: 0.9, SUBJECT_FEVER: 0.88, NAMED_FEVER: 0.72, PLACE_JOURNEY: 0.9, CLOSED_JOURNEY: 0.68}
KIND = {CALL: "completes", SUBJECT_FEVER: "updates", NAMED_FEVER: "updates", PLACE_JOURNEY: "completes", CLOSED_JOURNEY: "completes"}
LESS_FOR_ASSISTANT, MORE_FOR_USER = 0.25, 0.05


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(ascii_bounds(pattern)))


def _names(values: Column) -> Column:
    """Normalised names of three characters or more; null is none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(plain(x))), lambda x: F.length(x) >= 3))


def role_of(*candidates: Column) -> Column:
    """The first of the candidates that names a role, in either language; else ``unknown``."""
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(*[F.try_element_at(named, F.trim(plain(c))) for c in candidates], F.lit("unknown"))


def entities(text: Column) -> Column:
    return _names(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_bounds(ENTITY)), F.lit(0)))


def salient_words(said: Column) -> Column:
    """Words of four characters or more of a plain text."""
    words = F.split(said, r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(STOPWORDS)))


def places(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_bounds(PLACE)), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: plain(F.trim(F.regexp_replace(x, r"[.,;:!?]+$", "")))), lambda x: x != ""))


def statements(rows: DataFrame) -> DataFrame:
    """Rows ``id, user_id, ts`` (ms)``, role, text, tags, domains`` with what relations look at, written once."""
    rows = rows.withColumn("_said", plain(F.col("text")))  # a column of its own: many patterns read it
    said, intent = F.col("_said"), temporal_intent(F.col("text"), role_of(F.col("role")))
    named, words, tags = entities(F.col("text")), salient_words(said), _names(F.col("tags"))

    def kept(prefix: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.concat(F.lit(prefix), x))

    domains = F.array_union(_names(F.col("domains")), tags)
    about = F.concat(kept("e:", F.array_union(named, tags)), kept("d:", domains), kept("w:", words))
    spoken = F.concat(kept("e:", named), kept("w:", words))
    signals = {
        "role": role_of(F.col("role")), "intent": intent, "subjects": kept("e:", named), "spoken": spoken, "about": about, "places": places(F.col("text")),
        "call": _has(said, CALL_INTENT), "called": _has(said, CALL_DONE), "fever": _has(said, FEVER), "recovered": _has(said, FEVER_DONE), "fever_named": _has(said, FEVER_NAMED),
        "leaving": _has(said, TOMORROW) & _has(said, LEAVING), "returned": _has(said, JOURNEY_DONE), "journey_closed": _has(said, JOURNEY_CLOSED),
    }
    out = rows.select("id", "user_id", F.coalesce("ts", F.lit(0)).cast("long").alias("ts"), "text", *(c.alias(name) for name, c in signals.items()))
    return materialize(out, "statements")


# ---------------------------------------------------------------- relations of pairs


def _closing_rule(o: str, n: str) -> Column:
    """The first rule by which statement ``n`` closes what ``o`` announces, or null."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    def shared(name: str) -> Column:
        return F.arrays_overlap(c(o, name), c(n, name))

    fever, journey = c(o, "fever") & c(n, "recovered"), c(o, "leaving") & c(n, "returned")
    return (
        F.when(c(o, "call") & c(n, "called") & shared("spoken"), CALL)
        .when(fever & shared("subjects"), SUBJECT_FEVER).when(fever & c(n, "fever_named"), NAMED_FEVER)
        .when(journey & shared("places"), PLACE_JOURNEY).when(journey & c(n, "journey_closed") & shared("spoken"), CLOSED_JOURNEY)
    )


def _by_number(rule: Column, values: dict[int, object]) -> Column:
    """The value of a rule; null for none."""
    return F.coalesce(*[F.when(rule == i, F.lit(v)) for i, v in values.items()])


def relation(pairs: DataFrame) -> DataFrame:
    """Adds ``relation`` and ``confidence`` to pairs of statements with prefixes ``old_`` and ``new_``.

    What an assistant says of a user's statement confirms at most, 0.25 less; what a user
    says of an assistant's counts 0.05 more where it replaces.
    """
    rule, old, new = F.col("_rule"), F.col("old_intent"), F.col("new_intent")
    weak = F.when((old == new) & (old != "past_event"), "confirms").otherwise("related")
    weakly = (
        F.when(old == "past_event", 0.35).when(old == new, 0.55).when((new == "completed_event") & old.isin("future_intent", "current_state"), 0.55).otherwise(0.4)
    )
    out = pairs.withColumn("_rule", _closing_rule("old", "new"))
    out = out.withColumns({"_kind": F.coalesce(_by_number(rule, KIND), weak), "_sure": F.coalesce(_by_number(rule, CONFIDENCE), weakly)})
    replaces, sure = F.col("_kind").isin(*REPLACING), F.col("_sure")
    by_assistant, by_user = (F.col("new_role") == "assistant") & (F.col("old_role") == "user"), (F.col("new_role") == "user") & (F.col("old_role") == "assistant")
    unrelated, asked = ~F.arrays_overlap("old_about", "new_about"), (old == "query") | (new == "query")
    kind = F.when(unrelated, "none").when(asked, "related").when(by_assistant & replaces, "confirms").otherwise(F.col("_kind"))
    confidence = (
        F.when(unrelated, 0.0).when(asked, 0.2).when(by_assistant, F.greatest(F.lit(0.0), sure - LESS_FOR_ASSISTANT))
        .when(by_user & replaces, F.least(F.lit(1.0), sure + MORE_FOR_USER)).otherwise(sure)
    )
    return out.withColumns({"relation": kind, "confidence": F.round(confidence, 6)}).drop("_rule", "_kind", "_sure")


# ---------------------------------------------------------------- supersession


def _keyed(rule: int, signals: Column) -> Column:
    return F.transform(signals, lambda s: F.struct(F.lit(rule).alias("rule"), s.alias("signal")))


def _entries(holds: dict[int, Column], signals: dict[int, Column]) -> Column:
    """Index entries (rule, signal) of a statement."""
    lists = [F.when(holds[rule], _keyed(rule, signals[rule])) for rule in sorted(holds)]
    # a repeated entry changes no minimum, and to find it among structs would compare all with all
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


def index_entries(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(announcing, closing) entries ``user_id, rule, signal, ts, id, role``: equal keys mean that the rule holds.

    The signals of a rule are those that both sides must share; a journey's place counts
    with any other shared signal, so its entries are pairs of the two.
    """
    with_place = F.flatten(F.transform("places", lambda p: F.transform("about", lambda s: F.concat_ws("|", p, s))))
    signals = {CALL: F.col("spoken"), SUBJECT_FEVER: F.col("subjects"), NAMED_FEVER: F.col("about"), PLACE_JOURNEY: with_place, CLOSED_JOURNEY: F.col("spoken")}
    open_to = said.where(~F.col("intent").isin("query", "past_event", "completed_event") & (F.col("call") | F.col("fever") | F.col("leaving")))
    closing = said.where((F.col("intent") != "query") & (F.col("called") | F.col("recovered") | F.col("returned")))
    older = {CALL: F.col("call"), SUBJECT_FEVER: F.col("fever"), NAMED_FEVER: F.col("fever"), PLACE_JOURNEY: F.col("leaving"), CLOSED_JOURNEY: F.col("leaving")}
    newer = {
        CALL: F.col("called"), SUBJECT_FEVER: F.col("recovered"), NAMED_FEVER: F.col("recovered") & F.col("fever_named"),
        PLACE_JOURNEY: F.col("returned"), CLOSED_JOURNEY: F.col("returned") & F.col("journey_closed"),
    }
    return tuple(
        rows.select("user_id", "ts", "id", "role", F.explode(_entries(which, signals)).alias("entry")).select("user_id", "entry.rule", "entry.signal", "ts", "id", "role")
        for rows, which in ((open_to, older), (closing, newer))
    )


def next_closing(announcing: DataFrame, closing: DataFrame, slice_ms: int = SLICE) -> DataFrame:
    """``id`` and ``first`` (ts, id, rule, role): the first closing entry after each announcing one, over all its keys.

    An assistant's closing doesn't count for a user's announcement, so a user's entries look
    among those of all others only: a key has two sides.
    """
    key = ["user_id", "rule", "signal", "strict"]
    found = F.struct(F.col("ts").alias("ts"), F.col("id").alias("id"), F.col("rule").alias("rule"), F.col("role").alias("role"))
    asks = announcing.select("*", (F.col("role") == "user").alias("strict"), F.lit(None).cast(found_type(closing)).alias("found"))
    both = F.when(F.col("role") == "assistant", F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    answers = closing.select("*", F.explode(both).alias("strict"), found.alias("found"))
    rows = asks.withColumn("asks", F.lit(True)).unionByName(answers.withColumn("asks", F.lit(False))).withColumn("slice", F.floor(F.col("ts") / slice_ms))
    # latest first, so that a frame grows by its new rows; one that reaches ahead would be read anew for every row
    ahead = Window.partitionBy(*key, "slice").orderBy(-F.col("ts")).rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.min("found").over(ahead)).where("asks")
    slices = rows.groupBy(*key, "slice").agg(F.min("found").alias("found"))
    later = Window.partitionBy(*key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    # null structs sort last in min, so the nearest slice that has a closing entry gives it
    slices = slices.withColumn("far", F.min("found").over(later)).select(*key, "slice", "far")
    each = near.join(slices, [*key, "slice"]).select("id", F.coalesce("near", "far").alias("first"))
    return each.where("first is not null").groupBy("id").agg(F.min("first").alias("first"))


def found_type(closing: DataFrame) -> str:
    kinds = dict(closing.dtypes)
    return f"struct<ts:{kinds['ts']},id:{kinds['id']},rule:{kinds['rule']},role:{kinds['role']}>"


def supersede(rows: DataFrame, slice_ms: int = SLICE) -> DataFrame:
    """``id, user_id, superseded_by, relation, confidence`` for every statement; null where none replaces it.

    The first newer statement by time, then id; of several rules by which it does the first.
    """
    said = statements(rows.dropDuplicates(["id"]))
    announcing, closing = index_entries(said)
    first = next_closing(announcing, closing, slice_ms)
    joined = said.select("id", "user_id", "role").join(first, "id", "left")
    rule, by_user = F.col("first.rule"), (F.col("first.role") == "user") & (F.col("role") == "assistant")
    confidence = F.when(rule.isNotNull(), F.least(F.lit(1.0), _by_number(rule, CONFIDENCE) + F.when(by_user, MORE_FOR_USER).otherwise(0.0)))
    return joined.select("id", "user_id", F.col("first.id").alias("superseded_by"), _by_number(rule, KIND).alias("relation"), F.round(confidence, 6).alias("confidence"))
