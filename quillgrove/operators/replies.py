r"""What a model's reply holds: its first JSON object, moods read from it, recommended fixes.

``first_object``  the first balanced object of a text; braces inside strings don't count.
``moods``         values by label and how sure they are, a baseline where the reply has none.
``fixes``         one row per recommended fix; a reply that is no object is read by its lines.

All are built-in functions.  A text is cut into braces, quotes, escapes and the runs between
them, and depth is a fold over these pieces, so a long run costs one step.

Defined results: null and empty texts hold no object; an object that never closes is none; a
value that is no number counts as 0, a null one as missing; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BASELINE = {"stress": 0.05, "calm": 0.10, "fatigue": 0.05, "joy": 0.10, "sadness": 0.05, "anger": 0.02, "urgency": 0.05, "focus": 0.10}
UNREAD = 0.25
PRIORITIES = ["high", "medium", "low"]
AREAS = ["backend", "frontend", "memory", "ai", "storage", "security", "ux"]
FIX_WORDS = "(?i)fix|refactor|test|separa|riduci|aggiungi|migliora|rischio|debito"
MOST_LINES = 8

_PIECES = r'(?s)([{}"]|\\.|[^{}"\\]+|\\)'


def balanced(text: Column) -> Column:
    """From the first opening brace to the one that closes it, else null."""
    tail = F.substring(text, F.instr(text, "{"), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        move = F.when(s["quoted"], 0).when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        depth, size = s["depth"] + move, s["size"] + F.length(piece)
        end = F.when(s["end"] > 0, s["end"]).when(depth == 0, size).otherwise(0)
        return F.struct(depth.alias("depth"), (s["quoted"] != (piece == '"')).alias("quoted"), size.alias("size"), end.alias("end"))

    end = F.aggregate(F.regexp_extract_all(tail, F.lit(_PIECES), F.lit(1)), start, step, lambda s: s["end"])
    return F.when(F.instr(text, "{") > 0, F.when(end > 0, F.substring(tail, F.lit(1), end)))


def first_object(text: Column) -> Column:
    """The first balanced object of a reply, marks of code blocks aside."""
    return balanced(F.regexp_replace(text, "(?i)```(?:json)?", ""))


def _fields(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def _share(value: Column) -> Column:
    x = F.when(F.trim(value) == "true", 1.0).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(x), 0.0).otherwise(x)))


def moods(rows: DataFrame, baseline: dict[str, float] = BASELINE) -> DataFrame:
    """``id``, a value per label, and ``confidence``, of replies ``id, text``.

    A label is looked for under ``labels``, then at the top.  Confidence lies within 0.2 and 0.95, and is raised where a value
    is 0.25 or 0.4 off its baseline; a reply without a readable object has the baseline at 0.25.
    """
    top = rows.select("id", _fields(first_object(F.col("text"))).alias("top")).withColumn("labels", _fields(F.col("top")["labels"]))
    shares = {k: F.coalesce(_share(F.coalesce(F.col("labels")[k], F.col("top")[k])), F.lit(v)) for k, v in baseline.items()}
    found = {k: F.when(F.coalesce(F.col("labels")[k], F.col("top")[k]).isNull(), F.lit(v)).otherwise(shares[k]) for k, v in baseline.items()}
    stated = F.coalesce(F.col("top")["confidence"], F.lit("0.35"))
    read = top.select("id", "top", *(c.alias(k) for k, c in found.items()), F.greatest(F.lit(0.2), F.least(F.lit(0.95), _share(stated))).alias("sure"))
    off = F.greatest(*(F.abs(F.col(k) - v) for k, v in baseline.items()))
    raised = F.when((off >= 0.25) & (F.col("sure") < 0.55), 0.65).otherwise(F.col("sure"))
    raised = F.when((off >= 0.40) & (raised < 0.65), 0.75).otherwise(raised)
    return read.select("id", *baseline, F.when(F.col("top").isNull(), UNREAD).otherwise(raised).alias("confidence"))


def _said(value: Column, otherwise: Column) -> Column:
    return F.trim(F.when(value.isNull() | value.isin("", "false", "0"), otherwise).otherwise(value))


def _one_of(value: Column, names: list[str], otherwise: Column) -> Column:
    return F.when(value.isin(names), value).otherwise(otherwise)


def fixes(rows: DataFrame) -> DataFrame:
    """``id, nth, title, priority, area, reason, prompt`` of replies ``id, text``; ``nth`` counts from 0.

    The object reaches from the first brace to the last.  Of a reply that isn't one, up to eight lines that speak of work
    are taken: that is the rule's own number.  What a fix lacks, or has outside the known names, gets a default by its place.
    """
    cut = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    read = rows.select("id", "text", cut.alias("cut")).withColumn("top", F.when(balanced(F.col("cut")) == F.col("cut"), _fields(F.col("cut"))))
    by_place = lambda n: F.when(n < 2, "high").otherwise("medium")

    def stated(x: Column, n: Column) -> Column:
        f = _fields(x)
        title = F.concat(F.lit("Fix consigliato "), (n + 1).cast("string"))
        prompt = F.concat(F.lit("Analizza e implementa il fix: "), F.coalesce(F.nullif(f["title"], F.lit("")), F.lit("fix consigliato")))
        return F.struct(
            _said(f["title"], title).alias("title"), _one_of(f["priority"], PRIORITIES, by_place(n)).alias("priority"), _one_of(f["area"], AREAS, F.lit("backend")).alias("area"),
            _said(f["reason"], F.lit("Suggerito dal deep audit.")).alias("reason"), _said(f["suggestedCodexPrompt"], prompt).alias("prompt"),
        )

    def from_line(x: Column, n: Column) -> Column:
        prompt = F.concat(F.lit("Implementa questo fix in modo incrementale: "), F.substring(x, 1, 180))
        return F.struct(
            F.substring(x, 1, 120).alias("title"), by_place(n).alias("priority"), F.lit("backend").alias("area"),
            F.lit("Estratto da risposta LLM non JSON.").alias("reason"), prompt.alias("prompt"),
        )

    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[-*•]\s*", ""))
    lines = F.slice(F.filter(lines, lambda x: F.rlike(x, F.lit(FIX_WORDS))), 1, MOST_LINES)
    given = F.coalesce(F.from_json(F.col("top")["recommendedFixes"], "array<string>"), F.array().cast("array<string>"))
    found = F.when(F.col("top").isNotNull(), F.transform(given, stated)).otherwise(F.transform(lines, from_line))
    return read.select("id", F.posexplode(found).alias("nth", "fix")).select("id", "nth", "fix.*")
