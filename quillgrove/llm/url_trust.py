"""URL filtering by rules and by trust that spreads over the host graph.

``split_url``    host and path.
``judge_by_rules``  the longest rule that fits.
``host_edges``   links between hosts, from the pages' anchors.
``propagate``    personalised PageRank from seeds, as rounds of join and sum until it settles.
``host_scores``  trust from hosts with allowed pages along the links, distrust from
                 hosts with blocked pages against them.
``judge``        the rule's verdict, else the host's.

Scores are linear in the seeds, so dividing these by their sum would only divide the
scores; they are given in units of a host that no link reaches and all of whose pages a
rule decided, so a threshold means the same whatever the number of seeds.  On reversed
links each keeps its share of the linking host's links: were a blocked host's distrust
divided among those that link to it, the members of a large link farm would escape by
their number.  Links without a host lead to the page's own and count as none;
what hosts without links hold isn't passed on.

Only DataFrame functions.  A seed weighs the share of its host's pages that a rule
decided, so a host with a few blocked pages isn't distrusted as a whole.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html links to nothing; repeated pages keep a row
each; without links only the seeds score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.session import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds end when no host's score changes by more than this share of it (of a whole seed's, if it is
#: below one), which is measured every ``STRETCH`` rounds.
TOLERANCE = 1e-3
STRETCH = 6
MOST_ROUNDS = 300
#: A host is blocked at this distrust or more, if it exceeds its trust.
DISTRUST = 0.5
ANCHOR_HOST = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    parts = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumns(
        {"host": F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), "path": F.regexp_extract(url, parts, 2)}
    )


def fits(rule: str) -> Column:
    """Whether ``host`` is the rule's host or below it and ``path`` starts with its path."""
    cut = rule.index("/")
    name, start = rule[:cut], rule[cut:]
    return ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(start))


def judge_by_rules(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds ``rule`` (null if none fits) and ``ruling``, the verdict it gives.  The rules are part of the plan."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tried first
        rule, ruling = F.when(fits(r), r).otherwise(rule), F.when(fits(r), rules[r]).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, share``: what part of the outgoing links of a host goes to another host."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(ANCHOR_HOST), 1)).alias("dst"))
    pairs = links.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst")
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, score``: each round a host's score is its seed plus damped shares of those that link to it."""
    before = score = seeds
    for i in range(1, MOST_ROUNDS + 1):
        flow = edges.join(score, edges.src == score.host).select(F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
        score = flow.union(seeds).groupBy("host").agg(F.sum("score").alias("score"))
        if i % STRETCH == 0:
            score = materialize(score, "trust")
            both = score.select("host", "score", F.col("score").alias("change")).union(before.select("host", F.lit(0.0), -F.col("score")))
            moved = both.groupBy("host").agg((F.abs(F.sum("change")) / F.greatest(F.lit(1.0), F.sum("score"))).alias("change"))
            if (moved.agg(F.max("change")).first()[0] or 0) < tolerance:
                return score
            before = score
    raise RuntimeError(f"scores did not settle in {MOST_ROUNDS} rounds")


def reverse(edges: DataFrame) -> DataFrame:
    """Links the other way, each with its share of the linking host's links."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")


def host_scores(ruled: DataFrame) -> DataFrame:
    """``host, trust, distrust`` of every host that a seed reaches."""
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruling") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.avg(F.when(F.col("ruling") == "block", 1.0).otherwise(0.0)).alias("blocked"),
    )
    hosts = materialize(hosts, "hosts")
    edges = materialize(host_edges(ruled), "host-edges")
    trusted = hosts.where("allowed > 0").select("host", F.col("allowed").alias("score"))
    blocked = hosts.where("blocked > 0").select("host", F.col("blocked").alias("score"))
    if edges.isEmpty():
        discard(edges)
    else:
        trusted, blocked = propagate(trusted, edges), propagate(blocked, reverse(edges))
    both = trusted.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(
        blocked.select("host", F.lit(0.0), F.col("score"))
    )
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: dict[str, str], distrust: float = DISTRUST) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    ruled = judge_by_rules(split_url(pages.select("page_id", "url", "html")), rules)
    bad = host_scores(ruled).where((F.col("distrust") >= distrust) & (F.col("distrust") > F.col("trust")))
    joined = ruled.drop("html").join(bad.select("host", F.lit("block").alias("_method")), "host", "left")
    verdict = F.coalesce("ruling", "_method", F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle(rules: dict[str, str], damping: float = DAMPING, distrust: float = DISTRUST) -> str:
    """DuckDB SQL for :func:`judge`, with the rounds written out."""
    rounds = 8 * STRETCH

    def case(values: dict[str, str]) -> str:
        arms = []
        for r in sorted(rules, key=lambda r: (len(r), r), reverse=True):
            name, start = r[: r.index("/")], r[r.index("/") :]
            arms.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{values[r]}'")
        return "CASE " + " ".join(arms) + " END"

    anchor = ANCHOR_HOST.replace("'", "''")
    steps = []
    for kind, edge in (("trust", "e"), ("distrust", "back")):
        steps.append(f"{kind}0 AS MATERIALIZED (SELECT host, {'allowed' if kind == 'trust' else 'blocked'} AS score FROM h WHERE score > 0)")
        for i in range(rounds):
            steps.append(
                f"{kind}{i + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT {edge}.dst AS host, {edge}.share * s.score * {damping} AS score "
                f"FROM {edge} JOIN {kind}{i} s ON {edge}.src = s.host UNION ALL SELECT host, score FROM {kind}0) GROUP BY host)"
            )
    return f"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, {case({r: r for r in rules})} AS rule, {case(rules)} AS ruling FROM u),
h AS MATERIALIZED (SELECT host, avg(CASE WHEN ruling = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN ruling = 'block' THEN 1.0 ELSE 0.0 END) AS blocked
      FROM r WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{anchor}', 1)), '{UPPER}', '{LOWER}') AS dst FROM r WHERE host <> ''),
c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY src, dst),
e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM c),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, share FROM e),
{", ".join(steps)},
s AS (SELECT host FROM distrust{rounds} d LEFT JOIN trust{rounds} t USING (host) WHERE d.score >= {distrust} AND d.score > coalesce(t.score, 0))
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN host IN (SELECT host FROM s) THEN 'block' END, 'allow') AS verdict FROM r
"""
