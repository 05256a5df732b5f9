"""Document retrieval and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.functions import text as X
from quillgrove.operators import chunkers as K
from quillgrove.operators import documents as O
from quillgrove.operators import recall as R
from quillgrove.plans.registry import Registry
from quillgrove.session import read_table

query = Registry()
TERMS, PHRASE = ["estion", "inthe", "ation"], "of the and"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


@query("SELECT doc_id AS id, i::INT AS chunk, md5(substring(text, (i * 600 + 1)::BIGINT, 600)) AS digest FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 600 + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return O.chunks(_docs(spark, sf)).select("id", "chunk", F.md5("text").alias("digest"))


@query(
    "SELECT doc_id AS id, i::INT AS chunk, md5(substring(text, (i * 520 + 1)::BIGINT, 700)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(0, floor((length(text) - 181) / 520.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)"
)
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return O.chunks(_docs(spark, sf), 700, 180).select("id", "chunk", F.md5("text").alias("digest"))


_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_TIDY = f"trim(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK})"


def _mark(mark: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in mark)


def _last(window: str, mark: str) -> str:
    """Where a mark begins for the last time, from 0; -1 if nowhere."""
    at = f"instr(reverse({window}), reverse({_mark(mark)}))"
    return f"CASE WHEN {at} > 0 THEN length({window}) - {at} - {len(mark) - 1} ELSE -1 END"


def _chunks_sql(cut: K.Cut) -> str:
    """The walk as a recursion from one chunk's start to the next."""
    if cut.in_order:
        far = [(f"({_last(f'substring(t, begun + 1, {cut.size + len(m)})', m)})", int(cut.size * cut.least)) for m in cut.marks]
        end = f"CASE {' '.join(f'WHEN {i} >= {least} THEN begun + {i}' for i, least in far)} ELSE begun + {cut.size} END"
        after = f"stop + length(substring(t, stop + 1)) - length(ltrim(substring(t, stop + 1), {_BLANK}))"
    else:
        last = f"greatest({', '.join(_last(f'substring(t, begun + 1, {cut.size})', m) for m in cut.marks)})"
        end = f"CASE WHEN {last} > {cut.size * cut.least}::DOUBLE THEN begun + {last} + 1 ELSE begun + {cut.size} END"
        after = f"greatest(stop - {cut.overlap}, begun + 1)"
    goes_on = f"length(t) - begun > CASE WHEN begun > 0 OR length(t) > {cut.whole} THEN {cut.size} ELSE {cut.whole} END"
    step = f"CASE WHEN {goes_on} THEN {end} ELSE length(t) END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_TIDY if cut.clean else "text"} AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT id, begun, ({step})::BIGINT AS stop FROM (SELECT *, 0::BIGINT AS begun FROM d) WHERE length(t) > 0
 UNION ALL SELECT id, begun, ({step})::BIGINT FROM (SELECT r.id, t, ({after})::BIGINT AS begun FROM r JOIN d USING (id) WHERE stop < length(t))),
c AS (SELECT id, begun, trim(substring(t, begun + 1, stop - begun), {_BLANK}) AS x FROM r JOIN d USING (id))
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY begun) - 1)::INT AS chunk, md5(x) AS digest FROM c WHERE x <> ''"""


def _chunked(spark: SparkSession, sf: str, cut: K.Cut) -> DataFrame:
    return K.break_chunks(_docs(spark, sf), cut).select("id", "chunk", F.md5("text").alias("digest"))


@query(_chunks_sql(K.SENTENCES))
def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, K.SENTENCES)


@query(_chunks_sql(K.TECHNICAL))
def chunk_technical(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, K.TECHNICAL)


@query(_chunks_sql(K.PARAGRAPHS))
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, K.PARAGRAPHS)


def _lex(column: str) -> str:
    parts = [f"CASE WHEN contains({column}, '{PHRASE}') THEN 120 ELSE 0 END"]
    for i, t in enumerate(TERMS):
        n = f"least(3, (length({column}) - length(replace({column}, '{t}', ''))) // {len(t)})"
        parts.append(f"CASE WHEN {n} > 0 THEN {max(40, 90 - 10 * i)} + 8 * {n} ELSE 0 END")
    return "(" + " + ".join(parts) + ")::DOUBLE"


@query(f"WITH s AS (SELECT doc_id AS id, {_lex('lower(text)')} AS score FROM documents) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 40")
def lexical_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    scored = _docs(spark, sf).select("id", O.lexical_score(F.col("text"), TERMS, PHRASE).alias("score")).where("score > 0")
    return R.top(scored, 40, F.desc("score"), F.col("id"))


@query(
    f"""WITH s AS (SELECT doc_id AS id, {_lex('lower(text)')} AS score, (doc_id % 97) / 97.0::DOUBLE AS sem FROM documents),
u AS ((SELECT id, score + 120 AS score, 'exact' AS source FROM s WHERE score >= 300) UNION ALL (SELECT id, score + 70, 'lexical' FROM s WHERE score > 0) UNION ALL (SELECT id, sem * 100, 'semantic' FROM s WHERE sem >= 0.9))
SELECT id, round(sum(score), 6) AS score, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM u GROUP BY id ORDER BY round(sum(score), 6) DESC, id LIMIT 10"""
)
def fusion(spark: SparkSession, sf: str) -> DataFrame:
    scored = _docs(spark, sf).select("id", O.lexical_score(F.col("text"), TERMS, PHRASE).alias("score"), ((F.col("id") % 97) / 97).alias("sem"))
    semantic = scored.where("sem >= 0.9").select("id", F.col("sem").alias("score"))
    return O.fuse(scored.where("score >= 300"), scored.where("score > 0"), semantic, 10).withColumn("score", F.round("score", 6))


_KEY = "substring(trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\\b(the|a|an|of|and|in|on|to)\\b', ' ', 'g'), ' +', ' ', 'g')), 1, 180)"


@query(
    f"""WITH t AS (SELECT doc_id AS id, split_part(text, '.', 1) AS title FROM documents), k AS (SELECT id, {_KEY} AS article FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY id) AS n FROM k WHERE article <> '') SELECT id, article FROM n WHERE n = 1"""
)
def article_dedup(spark: SparkSession, sf: str) -> DataFrame:
    titled = _docs(spark, sf).select("id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    return O.unique_articles(titled).select("id", "article")


CATEGORIES = [("travel", "ation"), ("money", "que"), ("weather", "ung"), ("sport", "ción")]


@query(
    f"""WITH c AS (SELECT CASE {' '.join(f"WHEN contains(text, '{p}') THEN '{n}'" for n, p in CATEGORIES)} ELSE 'general' END AS category FROM documents)
SELECT category, count(*)::BIGINT AS n FROM c GROUP BY category ORDER BY n DESC, category LIMIT 3"""
)
def category_signals(spark: SparkSession, sf: str) -> DataFrame:
    named = _docs(spark, sf).select(O.first_matching(F.col("text"), CATEGORIES, "general").alias("category"))
    return R.top(named.groupBy("category").agg(F.count("*").alias("n")), 3, F.desc("n"), F.col("category"))


@query(
    """WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^0-9a-zà-ÿ]+')) AS word FROM documents), c AS (SELECT word, count(*)::BIGINT AS n FROM w WHERE length(word) >= 4 GROUP BY word)
SELECT word, n FROM c WHERE n >= (SELECT count(*) FROM documents) * 0.5"""
)
def common_words(spark: SparkSession, sf: str) -> DataFrame:
    return O.common_words(_docs(spark, sf))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN substring(text, 1, 57) || '...' ELSE text END AS label, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", X.shortened(F.col("text")).alias("label"), X.slug(F.col("source")).alias("slug"))


@query(
    r"""WITH s AS (SELECT doc_id AS id, text, length(text) - length(regexp_replace(text, '[{}()\[\];=<>$#%&|*]', '', 'g')) AS k FROM documents)
SELECT id, (CASE WHEN contains(text, '```') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)error|exception|traceback') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?i)function|class|const|import|return') THEN 2 ELSE 0 END + CASE WHEN k / greatest(length(text), 1) > 0.22 THEN 2 ELSE 0 END)::INT AS score FROM s"""
)
def technical_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", X.technical_score(F.col("text")).alias("score"))


@query()
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", O.page_text(F.col("html")).alias("text"), O.page_image(F.col("html")).alias("image"))


_STRIP = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"


@query(rf"SELECT page_id, trim(regexp_replace({_STRIP}, '\s+', ' ', 'g')) AS text FROM pages")
def page_strip(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))
