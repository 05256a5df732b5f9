"""Main text of web pages by deduced templates.

``page_tokens``     a page as tags (with their marks) and runs of text.
``host_templates``  per host: tokens whose occurrence vectors over the host's pages
                    are equal form a class; classes that occur on enough pages, in
                    one order, nest into the host's template.
``host_slots``      per host and slot: how much text, and how much of it links, its
                    pages have there.  A slot is named by the template's elements
                    around it, outermost first: tags of classes that occur once a page.
``choose_slots``    which element of the template holds the main text, and which slots
                    inside it are menus.
``extract_text``    the text in those slots, without the text that the template holds
                    itself.

The slots decide: the main element is the innermost one that holds most of the host's
text that isn't links.  Names of tags and classes break ties (a named article around it, or with a good part of the text) and tell noise inside a slot, where a page's own elements are in no class.  Pages
that lack the main element, or whose host has too few pages, are read by names alone.

An occurrence vector is represented by the sum of a hash of (page, count), so it is
summed in parts and no host's pages meet in one task.

Defined results: null or empty html gives an empty text; a page without url belongs
to the empty host; unclosed and misnested tags are taken as browsers do; repeated
pages keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.url_trust import split_url
from quillgrove.session import materialize

#: Templates are sent to the tasks up to this many tokens in all, else joined.
MAX_SENT_TOKENS = 500_000
#: A class must occur on so many pages, and on this share of its host's pages.
MIN_PAGES = 4
MIN_SHARE = 0.5
#: The main element holds this share of a host's text that isn't links; a named article wins from NAMED_SHARE on.
MAIN_SHARE = 0.6
NAMED_SHARE = 0.2
#: A slot with this share of its text in links is a menu.
LINK_SHARE = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = frozenset("script style noscript template textarea svg iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsored sponsor cookie cookies consent gdpr notice alert "
    "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply "
    "replies share sharing social related recommended newsletter subscribe subscription signup login search toolbar widget pagination "
    "pager complementary contentinfo".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset(("main", "articlebody"))
HINT_WORDS = frozenset("article post entry story content".split())
WHOLE = frozenset(("html", "body", "article", "main"))
SPLIT = re.compile(r"[^a-z0-9]+")
HEADING = re.compile("h[1-6]|hgroup")
HEADING_PEERS = frozenset("div section p span td".split())


def page_tokens(page: str | None) -> Iterator[tuple[str, str, frozenset[str]]]:
    """(kind, name or text, words of class, id and role); kinds: open, close, text."""
    for m in TOKEN.finditer(page or ""):
        piece = m[0]
        if piece[0] != "<" or piece == "<":
            yield "text", piece, frozenset()
        elif m[1] is None and (tag := TAG.match(piece)):
            name = tag[2].lower()
            if tag[1]:
                yield "close", name, frozenset()
            else:
                words = frozenset(w for x in MARKS.findall(piece) for w in SPLIT.split("".join(x).lower()) if w) if "=" in piece else frozenset()
                yield ("void" if name in VOID or piece.endswith("/>") and name not in WHOLE else "open"), name, words


class Walker:
    """Where in a page one is: which open elements, and what their names and the template say of them."""

    def __init__(self, once: frozenset[str] = frozenset(), inside: str = ""):
        self.once, self.inside = once, inside  # the template's tags, and the slot path of its main element
        self.stack: list[tuple[str, bool, int, str, bool, bool]] = []  # name, noise, main (2), hint (1) or neither, path, held, link

    def open(self, name: str, words: frozenset[str]) -> None:
        noise, main, path, held, link = self.noise, self.main, self.path, self.held, self.link
        if self.once and (key := token_key("open", name, words)) in self.once:
            path = f"{path}/{key}"
        if self.inside and path == self.inside and not held:
            held, noise = True, False  # whatever the names around it say
        elif name in NOISE_TAGS or name == "header" and main < 2 or (name not in WHOLE or name == "article") and words & NOISE_WORDS:
            noise = True
        if name in MAIN_TAGS or words & MAIN_WORDS:
            main = 2
        elif words & HINT_WORDS and main < 2 and name in ("div", "section"):
            main = max(main, 1)
        self.stack.append((name, noise, main, path, held, link or name == "a"))

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                del self.stack[i:]
                return

    @property
    def noise(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    @property
    def main(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    @property
    def path(self) -> str:
        return self.stack[-1][3] if self.stack else ""

    @property
    def held(self) -> bool:
        """Inside the template's main element."""
        return bool(self.stack) and self.stack[-1][4]

    @property
    def link(self) -> bool:
        return bool(self.stack) and self.stack[-1][5]


def token_key(kind: str, name: str, words: frozenset[str], text_path: str = "") -> str:
    """How a token is told apart: a tag by its name and marks, a run of text by its hash and place."""
    if kind == "text":
        return f"#{text_path}:{xxhash.xxh64_hexdigest(' '.join(name.split()).encode(), 5)}"
    return ("/" if kind == "close" else "") + ".".join([name, *sorted(words)])


def keyed_tokens(page: str | None) -> Iterator[str]:
    """The template tokens of a page, in order; blank text is none."""
    walker = Walker()
    for kind, name, words in page_tokens(page):
        if kind == "text":
            if name.strip():
                yield token_key(kind, name, words, walker.stack[-1][0] if walker.stack else "")
            continue
        yield token_key(kind, name, words)
        if kind == "open":
            walker.open(name, words)
        elif kind == "close":
            walker.close(name)


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, classes``: a host's template as its classes, outermost first.

    A class is a struct of its (negative) number of pages, how often it occurs there on
    average, and its tokens in order of their place.  Tokens of a class share one
    vector, so they keep one order if every token's mean place is its own; classes
    that occur more often on the same pages lie inside the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, vectors, counts, places = [], [], [], [], []
            for page_id, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: Counter[str] = Counter()
                first: dict[str, int] = {}
                for i, key in enumerate(keyed_tokens(page)):
                    seen[key] += 1
                    first.setdefault(key, i)
                for key, n in seen.items():
                    hosts.append(host), tokens.append(key), counts.append(n), places.append(first[key] / (len(first) + 1))
                    vectors.append(xxhash.xxh64_intdigest(f"{page_id}:{n}", 3) >> 24)  # 40 bits: sums fit a long
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(tokens, pa.string()), pa.array(vectors, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.float64())],
                ["host", "token", "vector", "n", "place"],
            )

    read = pages.select(F.col("page_id").cast("long"), "host", "html")
    rows = read.mapInArrow(run, "host string, token string, vector long, n long, place double")
    totals = read.groupBy("host").agg(F.count("*").alias("host_pages"))
    vectors = rows.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum("vector").alias("vector"), F.avg("n").alias("times"), F.avg("place").alias("place")
    )
    common = vectors.where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") >= F.col("host_pages") * min_share)
    classes = common.groupBy("host", "pages", "vector").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("tokens"), F.max("times").alias("times")
    )
    valid = classes.where(F.size(F.array_distinct("tokens.place")) == F.size("tokens"))
    nested = valid.select("host", F.struct((-F.col("pages")).alias("rank"), "times", F.col("tokens.token").alias("tokens")).alias("c"))
    return nested.groupBy("host").agg(F.array_sort(F.collect_list("c")).alias("classes"))


@dataclass(frozen=True)
class Choice:
    """A host's template as extraction needs it: its tags that occur once, its own texts, and the slots to read."""

    once: frozenset[str] = frozenset()
    fixed: frozenset[str] = frozenset()
    inside: str = ""
    named: bool = False
    menus: tuple[str, ...] = ()


def template_tags(classes: list[dict] | None) -> frozenset[str]:
    """Opening tags of the classes that occur once a page."""
    return frozenset(t for c in classes or () if c["times"] == 1 for t in c["tokens"] if t[0] not in "#/")


def slot_texts(page: str | None, once: frozenset[str]) -> dict[str, list[int]]:
    """slot path -> characters outside of links, in links, and of those outside how many the names call noise."""
    out: dict[str, list[int]] = {}
    walker = Walker(once)
    for kind, name, words in page_tokens(page):
        if kind == "open":
            walker.open(name, words)
        elif kind == "close":
            walker.close(name)
        elif kind == "text" and (n := len("".join(name.split()))):
            found = out.setdefault(walker.path, [0, 0, 0])
            found[walker.link] += n
            found[2] += n * (walker.noise and not walker.link)
    return out


def choose_slots(slots: list[tuple[str, int, int, int]]) -> tuple[str, bool, tuple[str, ...]]:
    """(path of the main element, whether its name says so too, paths of menus inside it) from a host's slots.

    From the outside in: an element is entered while it holds ``MAIN_SHARE`` of the
    text that is neither link nor called noise (that is called noise only if nothing
    else is there).
    """
    weight: dict[str, int] = {}
    links: dict[str, list[int]] = {}
    whole = sum(plain for _, plain, _, _ in slots)
    trusted = 10 * sum(plain - noise for _, plain, _, noise in slots) >= 2 * whole  # else the names can't be right
    for path, plain, linked, noise in slots:
        steps = path.split("/")
        for i in range(1, len(steps)):
            above = "/".join(steps[: i + 1])
            weight[above] = weight.get(above, 0) + plain - noise * trusted
            both = links.setdefault(above, [0, 0])
            both[0] += plain
            both[1] += linked
    total, inside = sum(plain - noise * trusted for _, plain, _, noise in slots), ""
    if not total:
        return "", False, ()
    while True:
        inner = [p for p, w in weight.items() if p.rpartition("/")[0] == inside and w >= MAIN_SHARE * total]
        if not inner:
            break
        inside = max(inner, key=weight.get)

    def is_named(path: str) -> bool:
        name, *words = path.rpartition("/")[2].split(".")
        return name in MAIN_TAGS or bool(MAIN_WORDS & set(words))

    around = [p for p in weight if is_named(p) and f"{inside}/".startswith(p + "/")]
    others = [p for p in weight if is_named(p) and weight[p] >= NAMED_SHARE * total]
    named = around or others
    if named:
        inside = max(around, key=len) if around else max(others, key=weight.get)
    elif inside.rpartition("/")[2].split(".")[0] in HEADING_PEERS:
        # a heading stands beside its text
        beside = [p for p in weight if p.rpartition("/")[0] == inside.rpartition("/")[0] and HEADING.fullmatch(p.rpartition("/")[2].split(".")[0])]
        inside = inside.rpartition("/")[0] if beside and inside.rpartition("/")[0] else inside
    menus = tuple(sorted(p for p, (plain, linked) in links.items() if p.startswith(inside + "/") and linked >= LINK_SHARE * (plain + linked) and linked))
    return inside, bool(named), menus


def main_text(page: str | None, choice: Choice = Choice()) -> str:
    """Text of the slots: blocks joined by line feeds, white space inside one made one space."""
    walker = Walker(choice.once, choice.inside)
    blocks: tuple[list[str], ...] = ([], [], [], [])  # in no main element, in a hinted one, in a named one, in the template's
    now: list[str] = []
    level, fills, met = 0, False, False

    def end() -> None:
        nonlocal fills
        if fills and (block := " ".join(html_module.unescape("".join(now)).split())):
            blocks[level].append(block)
        now.clear()
        fills = False

    for kind, name, words in page_tokens(page):
        if kind == "text":
            if walker.noise or walker.held and any(f"{walker.path}/".startswith(m + "/") for m in choice.menus):
                continue
            here = 3 if walker.held else walker.main
            if here != level:
                end()
                level = here
            now.append(name)
            # a block of the template's own text alone fills no slot, unless names too say that it is the article's
            place = walker.stack[-1][0] if walker.stack else ""
            whole = walker.main == 2 or not choice.fixed
            fills = fills or whole or bool(name.strip()) and token_key(kind, name, words, place) not in choice.fixed
            continue
        if name not in INLINE:
            end()
        if kind == "open":
            walker.open(name, words)
            met = met or walker.held
        elif kind == "close":
            walker.close(name)
    end()
    return "\n".join(blocks[3] if met else blocks[2] or blocks[1] or blocks[0])


_SLOTS = "host string, path string, plain long, linked long, noise long"


def _with_classes(pages: DataFrame, templates: DataFrame, extra: list[str]) -> tuple[DataFrame, Callable[[dict], dict]]:
    """The pages, and how to get a row's template: sent to the tasks while they are small, else joined."""
    tokens = templates.agg(F.sum(F.size(F.flatten("classes.tokens")))).first()[0] or 0
    if tokens <= MAX_SENT_TOKENS:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.asDict(recursive=True) for r in templates.collect()})
        return pages, lambda row: sent.value.get(row["host"], {})
    return pages.join(templates.select("host", "classes", *extra), "host", "left"), lambda row: row


def host_slots(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """``host, slots``: array of (path, plain, linked, noise) characters, summed over the host's pages."""
    rows, template_of = _with_classes(pages.select("host", "html"), templates, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[str]] = {}
        for batch in batches:
            out: dict[tuple[str, str], list[int]] = {}
            for row in batch.to_pylist():
                host = row["host"]
                if host not in known:
                    known[host] = template_tags(template_of(row).get("classes"))
                for path, counts in slot_texts(row["html"], known[host]).items() if known[host] else ():
                    held = out.setdefault((host, path), [0, 0, 0])
                    for i, n in enumerate(counts):
                        held[i] += n
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*((*k, *v) for k, v in out.items()), strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "plain", "linked", "noise"])

    summed = rows.mapInArrow(run, _SLOTS).groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("plain", "linked", "noise")))
    return summed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "plain", "linked", "noise"))).alias("slots"))


def choice_of(template: dict) -> Choice:
    """What extraction does for a host with these ``classes`` and ``slots``."""
    classes, slots = template.get("classes"), template.get("slots")
    if not classes or not slots:
        return Choice()
    inside, named, menus = choose_slots([(s["path"], s["plain"], s["linked"], s["noise"]) for s in slots])
    return Choice(template_tags(classes), frozenset(t for c in classes for t in c["tokens"] if t[0] == "#"), inside, named, menus)


def with_slots(pages: DataFrame) -> DataFrame:
    """``host, classes, slots`` of every host with a template; ``pages`` has ``page_id, host, html``."""
    templates = materialize(host_templates(pages), "templates")
    return materialize(templates.join(host_slots(pages, templates), "host", "left"), "template-slots")


def extract_text(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, by_template`` of every page; the last: whether its host's slots decided."""
    pages = split_url(pages.select("page_id", "url", F.col("html").cast("string").alias("html"))).drop("path")
    templates = with_slots(pages) if templates is None else templates
    rows, template_of = _with_classes(pages.select("page_id", "url", "html", "host"), templates, ["slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Choice] = {}
        for batch in batches:
            texts, decided = [], []
            for row in batch.to_pylist():
                if row["host"] not in known:
                    known[row["host"]] = choice_of(template_of(row))
                texts.append(main_text(row["html"], known[row["host"]]))
                decided.append(bool(known[row["host"]].inside))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(decided, pa.bool_())],
                ["page_id", "url", "text", "n_chars", "by_template"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_template boolean")
