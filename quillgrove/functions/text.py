"""Text functions as Column expressions: normalisation, tokens, matching, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = ("the", "and", "for", "with", "that", "this", "was", "are")


def normalised(text: Column) -> Column:
    """Trimmed, lower-cased, straight quotes, single spaces."""
    straight = F.translate(text, "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(F.lower(straight), r"\s+", " "))


def query_tokens(query: str, stopwords: tuple[str, ...] = STOPWORDS) -> list[str]:
    """Tokens of a query (a driver-side string): ASCII words of over two letters, no stopwords."""
    import re

    return [t for t in re.split(r"[^0-9A-Za-z_]+", query.lower()) if len(t) > 2 and t not in stopwords]


def token_share(text: Column, tokens: list[str]) -> Column:
    """The share of tokens that the text contains as substrings; 0 without tokens."""
    if not tokens:
        return F.lit(0.0)
    hits = reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("int") for t in tokens))
    return F.coalesce(hits, F.lit(0)) / F.lit(float(len(tokens)))


def concept_text(text: Column) -> Column:
    """Padded text in which everything but letters and digits is one space, for whole-phrase tests."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-zà-ÿ0-9]+", " ")), F.lit(" "))


def mentions(low: Column, concept: str) -> Column:
    """Whether ``concept_text`` of a lower-cased text holds the concept between spaces, looked up where its first word stands.

    Rewriting every text costs ten times as much; concepts that aren't plain words are looked up in the rewritten text.
    """
    import re

    letter = "[a-zà-ÿ0-9]"
    if not re.fullmatch(f"{letter}+( {letter}+)*", concept):
        return F.contains(concept_text(low), F.lit(f" {concept} "))
    words = concept.split(" ")
    return F.contains(low, F.lit(words[0])) & F.rlike(low, F.lit(f"(?<!{letter}){'[^a-zà-ÿ0-9]+'.join(words)}(?!{letter})"))


def has_concept(text: Column, concept: str) -> Column:
    return F.contains(concept_text(text), F.lit(f" {concept.lower()} "))


def index_tokens(text: Column) -> Column:
    """Distinct ASCII tokens of over three letters, for the inverted index."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z_]{4,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_user(user: Column) -> Column:
    return F.regexp_replace(user, "[^A-Za-z0-9_-]", "_")


def strip_html(text: Column) -> Column:
    """Tags to spaces, the common references decoded, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def shortened(text: Column, limit: int = 60) -> Column:
    """Cut to the limit with an ellipsis of three dots inside it."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def article_key(title: Column) -> Column:
    """Key under which two titles are one article."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), r"\b(the|a|an|of|and|in|on|to)\b", " ")
    return F.substring(F.trim(F.regexp_replace(bare, " +", " ")), 1, 180)


def technical_score(text: Column) -> Column:
    """3 for code fences, 2 each for error words, code words and many symbols."""
    symbols = F.regexp_count(text, F.lit(r"[{}()\[\];=<>$#%&|*]")) / F.greatest(F.length(text), F.lit(1))
    parts = [("```", 3), ("(?i)error|exception|traceback", 2), ("(?i)function|class|const|import|return", 2)]
    score = reduce(lambda a, b: a + b, (F.when(F.rlike(text, F.lit(p)), w).otherwise(0) for p, w in parts))
    return score + F.when(symbols > 0.22, 2).otherwise(0)
