"""Document retrieval: chunks, lexical scores, fusion, article keys and page extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.functions import text as X


def chunks(docs: DataFrame, size: int = 600, overlap: int = 0) -> DataFrame:
    """``id, chunk, text``: windows of ``size`` characters, each ``overlap`` into the last."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1 - overlap) / step)).cast("int"))
    rows = docs.where(F.length("text") > 0).select("id", "text", F.explode(starts).alias("chunk"))
    return rows.select("id", "chunk", F.expr(f"substring(text, chunk * {step} + 1, {size})").alias("text"))


def lexical_score(text: Column, terms: list[str], phrase: str) -> Column:
    """120 for the whole phrase, then weights that fall with a term's place in the query, and 8 per occurrence up to three."""
    low = F.lower(text)
    score = F.when(F.contains(low, F.lit(phrase.lower())), 120).otherwise(0)
    for i, term in enumerate(terms):
        weight = max(40, 90 - 10 * i)
        times = F.least(F.lit(3), ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int"))
        score = score + F.when(times > 0, F.lit(weight) + 8 * times).otherwise(0)
    return score.cast("double")


def fuse(exact: DataFrame, lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """``id, score, sources`` of the best: exact 120 + s, lexical 70 + s, semantic 100 s, summed by id."""
    parts = [
        exact.select("id", (F.col("score") + 120).alias("score"), F.lit("exact").alias("source")),
        lexical.select("id", (F.col("score") + 70).alias("score"), F.lit("lexical").alias("source")),
        semantic.select("id", (F.col("score") * 100).alias("score"), F.lit("semantic").alias("source")),
    ]
    every = parts[0].union(parts[1]).union(parts[2])
    summed = every.groupBy("id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return summed.orderBy(F.desc("score"), "id").limit(k)


def unique_articles(rows: DataFrame) -> DataFrame:
    """The first row of each article key; rows with an empty key go."""
    keyed = rows.withColumn("article", X.article_key(F.col("title"))).where("article <> ''")
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy("article").orderBy("id"))).where("n = 1").drop("n")


def page_text(html: Column, least: int = 50, short: int = 200, most: int = 4000) -> Column:
    """Paragraphs of over ``least`` characters, or all text where that gives too little."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    paragraphs = F.transform(F.regexp_extract_all(bare, F.lit("(?is)<p[^>]*>(.*?)</p>"), 1), X.strip_html)
    joined = F.array_join(F.filter(paragraphs, lambda p: F.length(p) > least), "\n")
    return F.substring(F.when(F.length(joined) < short, X.strip_html(bare)).otherwise(joined), 1, most)


def page_image(html: Column) -> Column:
    """The address of the page's picture: its meta entry, else its first image; null if none."""
    meta = F.regexp_extract(html, r"""(?i)<meta[^>]+(?:og|twitter):image[^>]+content=["']([^"']+)""", 1)
    first = F.regexp_extract(html, r"""(?i)<img[^>]+src=["']([^"']+)""", 1)
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(first, F.lit("")))


def first_matching(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def common_words(rows: DataFrame, share: float = 0.5, least: int = 4) -> DataFrame:
    """Words of ``least`` letters or more found in at least that share of the rows' number."""
    words = rows.select(F.explode(F.split(F.lower("text"), "[^0-9a-zà-ÿ]+")).alias("word")).where(F.length("word") >= least)
    n = rows.count()
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= n * share)
