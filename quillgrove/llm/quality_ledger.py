"""Quality rules as a ledger: every rule is evaluated once, policies come after.

``ledger``     measurements of each text and one bit per failed rule.
``store``      writes the ledger once, for any number of policies.
``judge``      verdicts of a versioned policy (the rules it counts, as a mask).
``ablations``  what each rule of each policy rejects, and rejects alone, from one
               aggregation of the bits.

Only DataFrame functions.  A text is never exploded: windows are hashed and
sorted inside its row, so nothing is shuffled.

Defined results: a null, empty or blank text has no words, lines or symbols and
fails the rule of too few words; repeated rows and null ids keep a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.session import materialize

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Rules in order of their bits: name, SQL condition under which a text fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A named version of which rules count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base", BASE_RULES)
STANDARD = Policy("2024-1", tuple(name for name, _ in RULES))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each whole text."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    # each step refers at least twice to what the step before computes, so it isn't inlined into loops
    words = text.selectExpr(
        "doc_id",
        f"regexp_extract_all(_t, '{WORD}', 0) AS _w".replace("\\", "\\\\"),
        f"cast(regexp_count(_t, '{SYMBOLS}') AS bigint) AS n_symbols",
        f"filter(split(_t, '\\n', -1), x -> x rlike '{WORD}') AS _l".replace("\\x", "\\\\x"),
    )
    hashed = words.selectExpr(
        "doc_id",
        "n_symbols",
        "cast(size(_w) AS bigint) AS n_words",
        "aggregate(_w, 0L, (n, x) -> n + length(x)) AS word_chars",
        "cast(size(_l) AS bigint) AS n_lines",
        "cast(size(_l) - size(array_distinct(_l)) AS bigint) AS n_dup_lines",
        "transform(_w, x -> xxhash64(x)) AS _h",
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windows = hashed.selectExpr(
        *kept,
        f"if(size(_h) < {WINDOW}, array(), transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64(slice(_h, i + 1, {WINDOW})))) AS _g",
    )
    ordered = windows.selectExpr(
        *kept,
        "if(size(array_distinct(_g)) = size(_g), array(), sort_array(transform(_g, (x, i) -> named_struct('h', x, 'p', i)))) AS _s",
    )
    repeated = ordered.selectExpr(
        *kept,
        "if(size(_s) = 0, array(), sort_array(array_distinct(flatten(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), "
        "(a, b) -> if(a.h = b.h, array(a.p, b.p), cast(array() AS array<int>))))))) AS _p",
    )
    return repeated.selectExpr(
        *kept,
        f"if(size(_p) = 0, 0L, {WINDOW} + aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), "
        f"(a, b) -> cast(least({WINDOW}, b - a) AS bigint)), 0L, (n, x) -> n + x)) AS n_repeat_words",
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the rules' failure bits."""
    bits = " + ".join(f"cast({condition} AS bigint) * {1 << k}" for k, (_, condition) in enumerate(RULES))
    return measure(docs).selectExpr("*", f"{bits} AS failed")


def store(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs``, written to the shared folder."""
    return materialize(ledger(docs), "ledger")


def judge(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """A boolean column: no rule of the policy failed."""
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """``version, rule, n_failed, n_failed_alone``: a text failed alone would be kept without that rule."""
    counted = rows.groupBy("failed").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    entries = [
        F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(1 << k).alias("bit"), F.lit(p.mask).alias("mask"))
        for p in policies
        for k, (name, _) in enumerate(RULES)
        if name in p.rules
    ]
    each = counted.select("failed", "n", F.explode(F.array(*entries)).alias("e")).select("failed", "n", "e.*")
    under = F.col("failed").bitwiseAND(F.col("mask"))
    return each.groupBy("version", "rule").agg(
        F.sum(F.when(under.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(under == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), m AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
  FROM w
), g AS (
  SELECT r, i, list_slice(ws, i, i + 7) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1
), v AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r
), a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN v USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept,
       ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
        + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT)::BIGINT AS failed
FROM a
"""


def _ablation_sql(policies: list[Policy]) -> str:
    rows = [
        f"SELECT '{p.version}' AS version, '{name}' AS rule, coalesce(sum((failed & {p.mask} & {1 << k} <> 0)::BIGINT), 0)::BIGINT AS n_failed, "
        f"coalesce(sum((failed & {p.mask} = {1 << k})::BIGINT), 0)::BIGINT AS n_failed_alone FROM ledger"
        for p in policies
        for k, (name, _) in enumerate(RULES)
        if name in p.rules
    ]
    return f"WITH ledger AS MATERIALIZED ({SQL}) " + " UNION ALL ".join(rows)


ABLATION_SQL = _ablation_sql([BASE, STANDARD])
