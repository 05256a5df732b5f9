"""Document search: pages, sections and signals of queries; clean-up and parsing of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases that tell a manual's sections.
SECTIONS = {
    "fault_codes": "codice di riferimento guasti", "troubleshooting": "risoluzione dei problemi", "warnings": "indicatore di avviso", "lcd": "display lcd",
    "settings": "impostazione lcd", "appendix": "appendice", "bms": "comunicazione bms", "table": "tabella",
}
#: Technical terms of queries.
TERMS = (
    "bus", "batteria", "bms", "inverter", "tensione", "corrente", "uscita", "ingresso", "sovratensione", "sottotensione",
    "sovracorrente", "carica", "scarica", "fault", "warning", "display", "guasto", "allarme", "troubleshooting",
)
#: What starts a search of the whole history, and of articles.
FULL_HISTORY = ("cerca nello storico completo", "cerca in tutta la memoria", "search full history")
_OF = "(?:su|sul|sulla|sullo|sui|sugli|del|della|dello|dei|degli|di)"
TOPIC = (rf"(?is)pubmed.*?\b{_OF}\b\s+(.+)$", rf"(?is)ricerca scientifica.*?\b{_OF}\b\s+(.+)$", r"(?is)cerca su pubmed\s+(.+)$")

PAGE_SIZE = 3500


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def pseudo_pages(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``id, page, text``: parts between explicit page marks (empty ones left out), else slices of ``size`` characters."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, r"(?i)\[\s*PAGE\s*:\s*[0-9]+\s*\]", -1)
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    marked = F.size(parts) > 1
    cut = rows.select("id", marked.alias("marked"), F.posexplode(F.when(marked, parts).otherwise(slices)).alias("at", "part"))
    pages = cut.select("id", (F.col("at") + 1).cast("long").alias("page"), trimmed(F.col("part")).alias("text"), "marked")
    return pages.where("NOT marked OR text <> ''").drop("marked")


def sections(text: Column) -> Column:
    """The names of the sections whose phrases a text holds, in order."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(phrase)), name) for name, phrase in SECTIONS.items())), lambda x: x.isNotNull())


#: The edge of an ASCII word, on whatever runtime.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def query_signals(q: Column) -> list[Column]:
    """Error code, numbers, wishes and technical terms of a query."""
    low = F.lower(F.trim(q))
    code = F.coalesce(
        *(F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (rf"{EDGE}(?:errore|codice|code|fault|warning|avviso)\s*[:#-]?\s*0?([0-9]{{1,3}}){EDGE}", rf"{EDGE}f\s*0?([0-9]{{1,3}}){EDGE}"))
    )
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(rf"{EDGE}([0-9]{{1,3}}){EDGE}"), 1), lambda x: x.cast("int").cast("string")))
    wants = {"table": "tabella|table|riga|colonna|manuale|pdf", "troubleshooting": "risoluzione|troubleshooting|causa|perché|motivo|guasto", "warnings": "warning|avviso|allarme"}
    terms = F.filter(F.array(*(F.when(F.contains(low, F.lit(t)), t) for t in TERMS)), lambda x: x.isNotNull())
    return [
        code.cast("int").alias("error_code"), F.array_join(numbers, ",").alias("numbers"), *(F.rlike(low, F.lit(p)).alias(f"wants_{n}") for n, p in wants.items()),
        F.array_join(terms, ",").alias("terms"),
    ]


def invariants(text: Column) -> list[Column]:
    """Dates, capitalised names, integers and up to three sentences of 4 to 9 words."""
    whole = lambda p: F.regexp_extract_all(text, F.lit(p), 0)
    phrases = F.slice(F.filter(F.split(text, "[.!?]+", -1), lambda s: F.size(F.split(s, " ", -1)).between(4, 9)), 1, 3)
    return [
        F.array_join(whole(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"), ",").alias("dates"), F.size(whole(rf"{EDGE}[A-Z][a-z]+(?:[ \t\n\r\f]+[A-Z][a-z]+)*{EDGE}")).cast("long").alias("n_names"),
        F.size(whole(rf"{EDGE}[0-9]+{EDGE}")).cast("long").alias("n_numbers"), F.array_join(phrases, "|").alias("key_phrases"),
    ]


def news_query(text: Column, names: tuple[str, ...] = ()) -> Column:
    """A request for news without the words that only ask for it; ``names``: what the assistant is called."""
    out = F.coalesce(text, F.lit(""))
    for pattern in ("|".join(("ciao", *names)), "news|notizie|aggiornami", "ricerca|cerca|trova", rf"{EDGE}(sul|sulla|su|del|della|dei|delle){EDGE}"):
        out = F.regexp_replace(out, f"(?i){pattern}" if "(" in pattern else f"(?i)(?:{pattern})", "")
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f]+", " "))


def asks_for_event(text: Column) -> Column:
    return F.rlike(text, F.lit("(?i)prossima|quando|orario|calendario|partita|match|fixture|schedule|dove vedere|a che ora"))


def cleaned_answer(text: Column) -> Column:
    """A model's answer without its opening phrase, bold marks and surplus line ends."""
    out = trimmed(F.coalesce(text, F.lit("")))
    for pattern in (r"(?i)^i identified[^\n]*?\n+", r"(?i)^here (?:is|are)[^\n]*?\n+", r"(?i)^ecco[^\n]*?:[ \t\n]*"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.replace(out, F.lit("**"), F.lit("")), r"[ \t]+\n", "\n")
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def topic_query(text: Column) -> Column:
    """What a request for scientific articles is about; null for other requests."""
    found = F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract(F.trim(text), p, 1), "[?.!,;:]+$", ""), F.lit("")) for p in TOPIC))
    topic = F.trim(found)
    triggered = F.contains(F.lower(text), F.lit("pubmed")) | F.contains(F.lower(text), F.lit("ricerca scientifica"))
    return F.when(triggered & (F.length(topic) >= 2), topic)


def recall_request(q: Column) -> list[Column]:
    """``query, mode``: one of the commands before the query asks for the full history."""
    pattern = "(?is)^\\s*(?:" + "|".join(FULL_HISTORY) + ")(?:\\s*[:,-]?\\s+)(.*)$"
    rest = F.trim(F.regexp_extract(q, pattern, 1))
    matched = rest != ""
    return [F.when(matched, rest).otherwise(q).alias("query"), F.when(matched, "full-history").otherwise("default").alias("mode")]


def article_url(page: Column, url: Column) -> Column:
    """The address a news page points at, else its own with the feed's part of the path left out."""
    marked = F.nullif(F.regexp_extract(page, r'(?i)data-n-au="(https?://[^"]+)"', 1), F.lit(""))
    return F.coalesce(marked, F.replace(url, F.lit("/rss/articles/"), F.lit("/articles/")))


def ignored(path: Column, folders: tuple[str, ...], endings: tuple[str, ...]) -> Column:
    """Whether a path lies in a folder, or ends in a way, that a scan leaves out."""
    inside = F.rlike(path, F.lit("(^|/)(" + "|".join(folders) + ")(/|$)"))
    return reduce(lambda a, b: a | b, (F.endswith(F.lower(path), F.lit(e)) for e in endings), inside)


def imports(text: Column, lines: int = 80, most: int = 40) -> Column:
    """Names that the first lines of a source text import."""
    head = F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")
    found = F.regexp_extract_all(head, F.lit(r"(?m)^\s*(?:import|from|use|require)\s+([A-Za-z_][A-Za-z0-9_.]*)"), 1)
    return F.slice(F.array_distinct(found), 1, most)
