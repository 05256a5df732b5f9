"""Time functions as Column expressions; the present is always an argument."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def gap_class(gap_ms: Column) -> Column:
    return (
        F.when(gap_ms <= 5 * MINUTE, "immediate").when(gap_ms <= HOUR, "hour").when(gap_ms <= DAY, "day")
        .when(gap_ms <= 7 * DAY, "week").when(gap_ms <= 30 * DAY, "month").otherwise("distant")
    )


def gap_weight(gap_ms: Column) -> Column:
    return (
        F.when(gap_ms <= 5 * MINUTE, 0.45).when(gap_ms <= HOUR, 0.40).when(gap_ms <= DAY, 0.32)
        .when(gap_ms <= 7 * DAY, 0.22).when(gap_ms <= 30 * DAY, 0.14).otherwise(0.08)
    )


def time_ago(age_ms: Column) -> Column:
    """In words: minutes, hours (below six), today, yesterday, days, weeks."""
    return (
        F.when(age_ms < HOUR, F.concat(F.floor(age_ms / MINUTE).cast("string"), F.lit(" min")))
        .when(age_ms < 6 * HOUR, F.concat(F.floor(age_ms / HOUR).cast("string"), F.lit(" h")))
        .when(age_ms < DAY, "today").when(age_ms < 2 * DAY, "yesterday")
        .when(age_ms < 7 * DAY, F.concat(F.floor(age_ms / DAY).cast("string"), F.lit(" d")))
        .otherwise(F.concat(F.floor(age_ms / (7 * DAY)).cast("string"), F.lit(" w")))
    )


# fixed values: what statements in the language of the records say of time, after lower-casing and without accents
QUESTION = [
    "ti ricordi", "ricordi", "sai se", "puoi dirmi", "mi dici", "secondo te", "che ne pensi", "posso farti una domanda", "la domanda e", "la domanda vera e",
    "devo ancora", "dobbiamo ancora", "sono ancora", "siamo ancora", "e ancora", "quando", "dove", "cosa", "come", "perche", "quanto", "quale", "quali", "chi",
]
COMPLETED = [
    "ho finito", "abbiamo finito", "siamo tornati", "sono tornato", "siamo rientrati", "sono rientrato", "e passato", "sta meglio", "risolto", "ho chiamato",
    "abbiamo chiamato", "ho sentito", "abbiamo sentito", "ho parlato", "abbiamo parlato", "sono andato", "siamo andati", "appuntamento fatto", "viaggio finito",
]
PAST = ["ieri", "due giorni fa", "la settimana scorsa", "ho visto", "sono stato", "sono stata", "ho fatto", "abbiamo fatto"]
FUTURE = ["domani", "devo", "dobbiamo", "andremo", "faremo", "partiremo", "sto per", "ho da"]
CURRENT = ["ora", "adesso", "oggi", "sto", "sta", "siamo", "sono qui", "siamo qui", "ha la"]
SUMMARY = ["non devi piu", "non e piu", "hai gia detto", "sei gia tornato", "sei gia tornata", "e gia stato fatto", "hai appena detto"]
DONE = ["tornato", "tornata", "rientrato", "rientrata", "fatto", "finito"]
ALREADY = ["sei gia", "siete gia", "e gia"]


def plain(text: Column) -> Column:
    """Lower case without accents of the Latin letters that the records use; null is empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "àáâãäåèéêëìíîïòóôõöùúûüýÿçñ", "aaaaaaeeeeiiiiooooouuuuyycn")


def ascii_bounds(pattern: str) -> str:
    """``pattern`` with word boundaries between ASCII word characters and all others, whatever Java's are.

    Beside a plain letter, or a plain group of which every word begins or ends with one, a boundary needs one look only.
    """
    starts, ends, edge = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    group = r"\((?:[a-z](?:[a-z]|\\s\+)*[a-z]\|)*[a-z](?:[a-z]|\\s\+)*[a-z]\)"
    pattern = re.sub(rf"\\b(?={group}(?![*+?{{])|[a-z](?![*+?{{]))", lambda _: starts, pattern)
    pattern = re.sub(rf"({group}|(?<![a-z\\])[a-z]|[a-z][a-z])\\b", lambda m: m[1] + ends, pattern)
    return pattern.replace(r"\b", edge)


def phrase_pattern(phrases: list[str]) -> str:
    """A pattern of whole words that finds any of the phrases, whatever white space stands inside."""
    return r"\b(" + "|".join(x.replace(" ", r"\s+") for x in phrases) + r")\b"


def temporal_intent(text: Column, role: Column | None = None) -> Column:
    """query, completed_event, past_event, future_intent, current_state or generic: the first rule that fits.

    What an assistant says of summaries or of the future is no statement of its own;
    null and empty texts are generic, a role that isn't ``assistant`` changes nothing.
    """
    said = plain(text)
    has = lambda phrases: F.rlike(said, F.lit(ascii_bounds(phrase_pattern(phrases))))
    by_assistant = F.coalesce(role == "assistant", F.lit(False)) if role is not None else F.lit(False)
    return (
        F.when(F.contains(said, F.lit("?")) | has(QUESTION), "query")
        .when(by_assistant & has(SUMMARY), F.when(has(DONE), "completed_event").otherwise("generic"))
        .when(has(COMPLETED) | (by_assistant & has(ALREADY) & has(DONE)), "completed_event")
        .when(has(PAST), "past_event")
        .when(has(FUTURE), F.when(by_assistant, "generic").otherwise("future_intent"))
        .when(has(CURRENT), "current_state").otherwise("generic")
    )


def validity(intent: Column, age_hours: Column) -> Column:
    """Whether what was said still holds, by intent and age; an unknown age is none of the old ones."""
    return (
        F.when(intent == "query", "query").when(intent == "past_event", "historical").when(intent == "completed_event", "completed")
        .when(intent == "current_state", F.when(age_hours > 24, "stale").otherwise("current"))
        .when(intent == "future_intent", F.when(age_hours > 36, "expired_future").otherwise("future_pending"))
        .when(age_hours > 72, "stale").otherwise("recent")
    )


def temporal_state(intent: Column, age_hours: Column) -> Column:
    """The state that a statement stands for: one without intent is past after a day."""
    named = F.when(intent == "completed_event", "completed").when(intent == "current_state", "current").when(intent == "past_event", "past").when(intent.isin("query", "future_intent"), intent)
    return F.coalesce(named, F.when(age_hours >= 24, "past").otherwise("current"))


def parse_instant(raw: Column) -> Column:
    """Epoch milliseconds, as a number or digits, or an ISO instant; null for anything else."""
    number = F.regexp_extract(raw, r"^(-?\d{1,18})$", 1).try_cast("bigint")
    return F.coalesce(F.timestamp_millis(number), F.try_to_timestamp(raw))
