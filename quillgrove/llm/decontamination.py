"""Benchmark decontamination by canonical templates.

Words become tokens: numbers, units and names turn into typed placeholders (a run
of names into one), other words are lower-cased without the punctuation around
them.  Windows of tokens are hashed; a document that holds at least half of an
item's windows, and whose slots replace the item's values consistently (one value
for each, and back), contains the item, verbatim or with other parameters.  Both
are judged for each occurrence of the item in the document and for all of its
windows together (a copy in another order); one that passes is enough.

Texts and items are keyed by what they say, so repeated rows are judged once and
every row gets its own text's result, whatever its id.  The items' windows are set in a
bitmap of fixed size; a text's windows that it lacks are in no item and stay where they
are.  The others are joined with the items' windows: first only with the rarest of an
item that a text with enough of them can't do without, then, for the pairs so found,
with all.  Pairs with enough are verified on both texts.

Items most of whose windows hold too few words besides placeholders (numbers, lists
of names) are also looked for as they are: windows of their own words and values,
half of them in one document.  Such a find has no slots: its consistency is 1.

Defined results: null, empty and blank texts contain nothing; items of fewer than
``MIN_TOKENS`` words can't be told from ordinary text and never match; rows with a
null id aren't reported as pairs, but ``decontaminate`` drops a row whose text holds an
item whatever the ids are; repeated rows report a pair once; of rows that share an id
each is judged by its text; empty tables give no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrove.llm.similar_texts import text_key
from quillgrove.llm.worker import held, small_batches
from quillgrove.session import materialize

WINDOW = 8
#: Windows hold at least so many tokens that aren't placeholders.
MIN_WORDS = 4
MIN_TOKENS = 6
COVERAGE = 0.5
CONSISTENCY = 0.8
#: The bitmap of the items' window hashes has 2 ** BITMAP bits (2 MB), however many they are.
BITMAP = 24
#: Items that a task remembers while it verifies pairs.
KEPT_ITEMS = 256
#: Words remembered by a worker.
CACHE_WORDS = 200_000

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*%?")
NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d[\d.,/:]*)([A-Za-z]{1,6})")
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers inch inches foot feet yard yards "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph percent dollar dollars cent cents euro euros degree degrees".split()
)
EDGES = ".,;:!?()[]{}\"'“”‘’«»…"
WORD, NUM, UNIT, NAME = 0, 1, 2, 3


def canonical(word: str) -> list[tuple[int, str]]:
    """(kind, value) of the tokens of a word between white space."""
    core = word.strip(EDGES)
    if not core:
        return []
    if NUMBER.fullmatch(core):
        return [(NUM, core)]
    if (m := NUMBER_UNIT.fullmatch(core)) and m[2].lower() in UNITS:
        return [(NUM, m[1]), (UNIT, m[2].lower())]
    if core.lower() in UNITS:
        return [(UNIT, core.lower())]
    return [(NAME if core[0].isupper() else WORD, core.lower())]


class _Words(dict):
    """word -> number; the tokens of word i are ``start[i] : start[i] + size[i]`` of kinds, hashes and values."""

    def __init__(self):
        super().__init__()
        self.start, self.size, self.kinds, self.hashes, self.values = [], [], [], [], []
        self._arrays = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.uint64))

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.start)
        tokens = canonical(word)
        self.start.append(len(self.kinds)), self.size.append(len(tokens))
        for kind, value in tokens:
            self.kinds.append(kind), self.values.append(value), self.hashes.append(xxhash.xxh64_intdigest(value))
        return number

    def arrays(self) -> tuple[np.ndarray, ...]:
        """start, size, kinds and hashes as arrays."""
        lists = (self.start, self.size, self.kinds, self.hashes)
        if len(self._arrays[0]) < len(self.start):
            self._arrays = tuple(np.concatenate([x, np.array(y[len(x) :], x.dtype)]) for x, y in zip(self._arrays, lists, strict=True))
        return self._arrays


@dataclass
class Template:
    """Tokens of a text: kind and hash of each, and the values in its slots; the hashes of all words as they are."""

    kinds: np.ndarray
    hashes: np.ndarray
    values: list[str]
    exact: np.ndarray


_HASH_OF_KIND = np.array([0, 0x6E756D, 0x756E6974, 0x6E616D65], np.uint64)


def _numbered(texts: list[str | None], words: _Words) -> list[list[int]]:
    """The numbers of each text's words; a full memory of words is emptied first."""
    if len(words) > CACHE_WORDS:
        words.__init__()
        words.clear()
    return [list(map(words.__getitem__, (x or "").split())) for x in texts]


def _tokens_of(numbers: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(token, word position) of every token of these words, in order."""
    start, size, _, _ = words.arrays()
    n = size[numbers]
    return np.repeat(start[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(numbers)), n)


def templates(texts: list[str | None], words: _Words, with_values: bool = False) -> list[Template]:
    """The templates of several texts; their values only where they are asked for."""
    numbers = _numbered(texts, words)
    _, _, kinds, hashes = words.arrays()
    out = []
    for mine in numbers:
        at, _ = _tokens_of(np.array(mine, np.int64), words)
        kind, exact = kinds[at], hashes[at]
        joins = np.zeros(len(at), bool)  # a name that goes on
        joins[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
        values: list[str] = []
        if with_values:
            for i, more in zip(at.tolist(), joins.tolist(), strict=True):
                if more:
                    values[-1] += " " + words.values[i]
                else:
                    values.append(words.values[i])
        kind = kind[~joins]
        out.append(Template(kind, np.where(kind == WORD, exact[~joins], _HASH_OF_KIND[kind]), values, exact))
    return out


def batch_windows(texts: list[str | None], words: _Words, sizes: list[tuple[bool, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text position, hash) of all windows of several texts, for every (as they are, size).

    The texts stand one after the other in one array; windows that reach into the next are left out.
    """
    numbers = _numbered(texts, words)
    _, _, kinds, hashes = words.arrays()
    at, word = _tokens_of(np.fromiter(chain.from_iterable(numbers), np.int64), words)
    text = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])[word]
    kind, exact = kinds[at], hashes[at]
    joins = np.zeros(len(at), bool)
    joins[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (text[1:] == text[:-1])
    kind, of_kind = kind[~joins], text[~joins]
    template = Template(kind, np.where(kind == WORD, exact[~joins], _HASH_OF_KIND[kind]), [], exact)
    for as_is, size in sizes:
        owner = text if as_is else of_kind
        if as_is:
            h = exact_windows(template, size)
            first = np.arange(len(h))
        else:
            first, h = window_hashes(template, size)
        inside = owner[first] == owner[first + size - 1]
        yield owner[first[inside]], h[inside]


def template(text: str | None, words: _Words) -> Template:
    return templates([text], words, with_values=True)[0]


def _rolled(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(hashes) - size + 1
    h = np.full(max(n, 0), seed, np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        h ^= h >> np.uint64(29)
    return h


def window_hashes(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows that hold enough words."""
    h = _rolled(t.hashes, size, size)
    if not len(h):
        return np.zeros(0, np.int64), h
    words = np.cumsum(np.concatenate([[0], t.kinds == WORD]))
    enough = np.nonzero(words[size:] - words[:-size] >= min(MIN_WORDS, size - 1))[0]
    return enough, h[enough]


def occurrences(item_at: np.ndarray, doc_at: np.ndarray) -> list[np.ndarray]:
    """The matches of an item's windows by place in the document, as row numbers of each place.

    Places are found twice.  As runs of nearly equal diagonals, where the distance
    to the next stays below a window.  And in reading order: a match goes on with the
    open place if its item position lies ahead, best on the same diagonal (so text in
    between may be of any length), and opens the next place if none does.
    """
    diagonal = doc_at - item_at
    order = np.argsort(diagonal, kind="stable")
    found = np.split(order, np.nonzero(np.diff(diagonal[order]) >= WINDOW)[0] + 1)
    order = np.lexsort((item_at, doc_at))
    place: list[int] = []
    last_item, last_doc = -1, -1
    for rows in np.split(order, np.nonzero(np.diff(doc_at[order]))[0] + 1):
        at, here = item_at[rows], int(doc_at[rows[0]])
        ahead = np.nonzero(at > last_item)[0]
        same = np.nonzero(at == last_item + here - last_doc)[0]
        if len(ahead):
            pick = same[0] if len(same) else ahead[0]
        else:
            found.append(np.array(place, np.int64))
            place, pick = [], 0
        place.append(int(rows[pick]))
        last_item, last_doc = int(at[pick]), here
    found.append(np.array(place, np.int64))
    return found


def item_window(t: Template) -> int:
    """How long this item's windows are: short items are one window."""
    n = len(t.hashes)
    return 0 if n < MIN_TOKENS else min(WINDOW, n)


def exact_windows(t: Template, size: int) -> np.ndarray:
    """Hashes of all windows of the words as they are."""
    return _rolled(t.exact, size, 1 << 32 | size)


def exact_window(t: Template) -> int:
    """How long an item's windows of words as they are; 0 if its template tells enough or it is too short."""
    n, size = len(t.exact), item_window(t)
    told = len(window_hashes(t, size)[1]) if size else 0
    all_windows = len(t.hashes) - size + 1 if size else 1
    return 0 if n < MIN_TOKENS or told >= COVERAGE * all_windows else min(WINDOW, n)


@dataclass
class Item:
    """An item's template with its windows: (position, hash) of template windows, hashes of windows as they are."""

    template: Template
    size: int
    at: np.ndarray
    hashes: np.ndarray
    exact_size: int
    exact: np.ndarray

    @staticmethod
    def of(text: str | None, words: _Words) -> Item:
        t = template(text, words)
        size, exact_size = item_window(t), exact_window(t)
        at, hashes = window_hashes(t, size) if size else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return Item(t, size, at, hashes, exact_size, np.unique(exact_windows(t, exact_size)) if exact_size else hashes[:0])


def match(item: Item, doc: Template) -> tuple[int, int, float, bool] | None:
    """(windows, matched, consistency, with other values) if ``doc`` holds the item."""
    found = _template_match(item, doc) if len(item.at) else None
    if not found and item.exact_size:
        n = len(np.intersect1d(item.exact, exact_windows(doc, item.exact_size)))
        found = (len(item.exact), n, 1.0, False) if n >= COVERAGE * len(item.exact) else None
    return found


def _template_match(item: Item, doc: Template) -> tuple[int, int, float, bool] | None:
    total = len(item.at)
    at, h = window_hashes(doc, item.size)
    held_here = np.isin(h, item.hashes)
    at, h = at[held_here], h[held_here]
    order = np.argsort(item.hashes, kind="stable")
    low, high = (np.searchsorted(item.hashes[order], h, side) for side in ("left", "right"))
    n = high - low
    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item_at, doc_at = item.at[order[rows]], np.repeat(at, n)
    if not len(item_at) or len(np.unique(item_at)) < COVERAGE * total:
        return None


    def judged(parts: list[np.ndarray]) -> list[tuple[int, float, bool]]:
        out = []
        for part in parts:
            matched = len(np.unique(item_at[part]))
            if matched >= COVERAGE * total:
                share, changed = _slots(item.template, doc, item_at[part], doc_at[part], item.size)
                if share >= CONSISTENCY:
                    out.append((matched, share, not changed))
        return out

    passed = judged(occurrences(item_at, doc_at)) or judged([np.arange(len(item_at))])
    if not passed:
        return None
    matched, share, same = max(passed)
    return total, matched, share, not same


def _slots(item: Template, doc: Template, item_at: np.ndarray, doc_at: np.ndarray, span: int) -> tuple[float, bool]:
    """What share of the aligned slots agrees with the commonest replacement, both ways."""
    pairs = {(a + k, b + k) for a, b in zip(item_at.tolist(), doc_at.tolist(), strict=True) for k in range(span)}
    slots = [(int(item.kinds[a]), item.values[a], doc.values[b]) for a, b in pairs if item.kinds[a] != WORD]
    if not slots:
        return 1.0, False
    forth: dict[tuple, dict[str, int]] = {}
    back: dict[tuple, dict[str, int]] = {}
    for kind, x, y in slots:
        forth.setdefault((kind, x), {}).setdefault(y, 0)
        forth[kind, x][y] += 1
        back.setdefault((kind, y), {}).setdefault(x, 0)
        back[kind, y][x] += 1
    agreed = min(sum(max(c.values()) for c in side.values()) for side in (forth, back))
    return agreed / len(slots), any(x != y for _, x, y in slots)


PAIRS = "doc_id long, item_id long, n_windows long, matched long, consistency double, other_values boolean"


_WINDOWS = "item_key binary, kind boolean, size int, h long, n long, total long"


def _item_windows(items: DataFrame) -> DataFrame:
    """``item_key, kind, size, h, n, total``: the distinct windows of every item text; kind: as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item = Item.of(text, words)
                for as_is, size, hashes in ((False, item.size, item.hashes), (True, item.exact_size, item.exact)):
                    found, times = np.unique(hashes, return_counts=True)
                    rows += [(key, as_is, size, h, n, len(hashes)) for h, n in zip(found.view(np.int64).tolist(), times.tolist(), strict=True)]
            kinds = (pa.binary(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _WINDOWS.split(", ")])

    return materialize(items.select("item_key", "item_text").mapInArrow(run, _WINDOWS), "item-windows")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bitmap of the windows' hashes: whatever their number, at most 2 ** (BITMAP - 6) longs reach the driver."""
    bit = F.col("h").bitwiseAND(F.lit((1 << BITMAP) - 1))
    place = F.shiftright(bit, 6)
    words = windows.groupBy(place.alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[words["place"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _text_hits(texts: DataFrame, sizes: list[tuple[bool, int]], bitmap: np.ndarray) -> DataFrame:
    """``text_key, h``: the windows of the texts that the bitmap has, each once a text."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = held("words", _Words), sent.value
        for batch in batches:
            owners, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for owner, h in batch_windows(batch.column(1).to_pylist(), words, sizes):
                cut = h & np.uint64((1 << BITMAP) - 1)
                held_here = (bits[cut >> np.uint64(6)] >> (cut & np.uint64(63))) & np.uint64(1) == 1
                owners.append(owner[held_here]), hits.append(h[held_here])
            owner, h = np.concatenate(owners), np.concatenate(hits)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
            keys = batch.column(0).take(pa.array(owner[~again]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(h[~again].view(np.int64))], ["text_key", "h"])

    return materialize(texts.mapInArrow(run, "text_key binary, h long").distinct(), "text-hits")


def _keyed(df: DataFrame, name: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.withColumns({f"{name}_text": text, f"{name}_key": text_key(text)})


_FOUND = "text_key binary, item_key binary, n_windows long, matched long, consistency double, other_values boolean"


def _leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``_FOUND`` for the distinct texts (``text_key, text_text``) that hold distinct items (``item_key, item_text``)."""
    small_batches(texts.sparkSession)
    items = materialize(items.select("item_key", "item_text").dropDuplicates(["item_key"]), "items")
    windows = _item_windows(items)
    sizes = sorted((r.kind, r.size) for r in windows.select("kind", "size").distinct().collect())
    texts = texts.select("text_key", "text_text")
    if not sizes:
        return texts.sparkSession.createDataFrame([], _FOUND)
    hits = _text_hits(texts, sizes, _bitmap(windows))
    # a text with the needed windows has one of the rarest: the rest of an item's isn't enough
    shared_by = windows.groupBy("h").agg(F.count("*").alias("items"))
    before = Window.partitionBy("item_key", "kind").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = windows.join(shared_by, "h").withColumn("rest", F.col("total") - F.sum("n").over(before) + F.col("n"))
    needed = ranked.where(F.col("rest") >= F.col("total") * COVERAGE).select("item_key", "kind", "h")
    likely = materialize(hits.join(needed, "h").select("text_key", "item_key", "kind").distinct(), "likely-leaks")
    counted = likely.join(windows, ["item_key", "kind"]).join(hits, ["text_key", "h"]).groupBy("text_key", "item_key", "kind")
    enough = counted.agg(F.sum("n").alias("n"), F.max("total").alias("total")).where(F.col("n") >= F.col("total") * COVERAGE)
    pairs = materialize(enough.select("text_key", "item_key").distinct(), "leak-pairs")
    held_texts = texts.join(pairs.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Words(), {}
        for batch in batches:
            rows = []
            for text_id, item_id, text, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item_id not in known:
                    if len(known) >= KEPT_ITEMS:
                        known.clear()
                    known[item_id] = Item.of(item_text, words)
                if found := match(known[item_id], template(text, words)):
                    rows.append((text_id, item_id, *found))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    both = pairs.join(held_texts, "text_key").join(items, "item_key").select("text_key", "item_key", "text_text", "item_text")
    return materialize(both.mapInArrow(run, _FOUND), "leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of document and item (``PAIRS``)."""
    texts = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").where("doc_id is not null")
    items = _keyed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item").where("item_id is not null")
    found = _leaks(texts, items)
    pairs = texts.select("doc_id", "text_key").join(found, "text_key").join(items.select("item_id", "item_key"), "item_key")
    return pairs.select("doc_id", "item_id", "n_windows", "matched", "consistency", "other_values").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that contain an item."""
    leaks = _leaks(_keyed(docs.select("text"), "text"), _keyed(benchmark.select("text"), "item"))
    gone = leaks.select(F.col("text_key").alias("_text_key")).distinct()
    keyed = docs.withColumn("_text_key", text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return keyed.join(gone, "_text_key", "left_anti").select(*docs.columns)
