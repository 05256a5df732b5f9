"""Near duplicates by similarity of whole word-shingle sets.

``verified_duplicates``  one row per document with its class: texts linked by a
                         Jaccard similarity of at least 0.8 (five words), and
                         whatever links connect.
``drop_duplicates``      the documents without those that an earlier one of the class stands for.

SimHashes of min-wise views, linked by the vantage-point search, propose buckets of
texts; every link is confirmed on the whole texts.  Inside a bucket no pairs are listed.
Its members are compared with a head, those that it doesn't confirm with a second.
Where a bucket still holds several classes, most of its members share a passage at most:
they are dealt to narrow buckets by least hashes (``tables`` keys of ``rows`` each), which
get two heads as well.  Where one of those holds several classes, its head becomes the
vantage point of an exact search by Jaccard distance:

* A member is written as its difference from the head.  If x isn't linked to the head
  and y is similar to x, the triangle bound makes x and y share a part of their
  differences, so only members that share one of the first elements of theirs (as
  many as the bound demands; those that the head lacks, which are rare, come first) are
  compared, and only those that the links found so far leave in different classes.  The
  differences tell their similarity too, so a bucket's members meet in a task with them
  and neither pairs nor texts of pairs are moved; a large bucket is a grid of such tasks.
* Members at similarity below ``MIDDLE`` can only be similar to members below
  ``MIDDLE + 1 - similarity``: those form the far side, which gets a head of its own.

What is far from ``HEADS`` heads of a narrow bucket is compared as it is.

Defined results: rows with the same text form one node; null counts as an empty text;
a null doc_id names a class only if no member has an id; repeated rows share a class;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.simhash_vptree import fingerprints, shingle_hashes, similar_pairs, words_of
from quillgrove.llm.worker import release, small_batches
from quillgrove.operators.components import connected_components
from quillgrove.session import discard, materialize

#: Members less similar to a head than this go to its far side.
MIDDLE = 0.5
#: Vantage points that a narrow bucket gets, one after the other.
HEADS = 3
#: Parts of a bucket of many members, members beyond which there are more, and below which there are fewer.
PARTS, PART_ROWS, LEAST_PART = 12, 16_384, 2048
#: A bucket's rows are dealt to so many keys where they meet its head.
SALTS = 16
#: Shingle sets of heads that a task remembers.
KEPT_HEADS = 16


def text_key(text: Column) -> Column:
    """What stands for a text: the first 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    blocks = [np.unique(b) for b in shingle_hashes(words_of(text), size)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def is_similar(shared: int, a: int, b: int, similarity: float) -> bool:
    return shared >= similarity * (a + b - shared)


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def first_differences(x: np.ndarray, head: np.ndarray, similarity: float) -> tuple[bool, float, np.ndarray, np.ndarray]:
    """(linked to the head, similarity to it, elements to be found by, further elements to ask with).

    With s the similarity, c = (1 - s) / (1 + s) and D the difference of a set from the
    head h, x and y are similar if they differ in at most c (|x| + |y|) elements, so
    they share at least (|Dx| + |Dy| - c (|x| + |y|)) / 2 elements of their
    differences.  For any x, and y not linked to h, this exceeds
    (|Dx| - c (|x| - |h|)) / 2.  For x not linked to h, and any y, it is at least
    (|Dx| - c (|x| + |h|)) / (1 + c), and at least 1.  Two sets that share k elements
    share one of the first |D| - k + 1 of each in one order: here elements that h lacks,
    which tell members apart, then those that it has.

    So two members that aren't linked to h share one of their elements to be found by, and
    one that isn't linked asks with further ones for those that are.
    """
    new, gone = np.setdiff1d(x, head, assume_unique=True), np.setdiff1d(head, x, assume_unique=True)
    shared, n = len(x) - len(new), len(new) + len(gone)
    linked, c = is_similar(shared, len(x), len(head), similarity), (1 - similarity) / (1 + similarity)
    order = np.concatenate([new, gone])
    found_by = max(0, n - int(np.floor((n - c * (len(x) - len(head))) / 2 - 1e-9)))
    asks = found_by if linked else max(0, n - max(1, int(np.ceil((n - c * (len(x) + len(head))) / (1 + c) - 1e-9))) + 1)
    return linked, shared / max(1, shared + n), order[:found_by], order[found_by:asks]


def confirm_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows ``a, b`` whose texts' shingle sets have at least this Jaccard similarity."""
    sides = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[object, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                p, q = _head_set(heads, a.as_py(), x.as_py(), shingle), shingle_set(y.as_py(), shingle)
                keep.append(is_similar(shared_count(p, q), len(p), len(q), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = texts.schema["key"].dataType.simpleString()
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(check, f"a {kind}, b {kind}")


def _head_set(heads: dict[object, np.ndarray], key: object, text: str | None, shingle: int) -> np.ndarray:
    if key not in heads:
        if len(heads) >= KEPT_HEADS:
            heads.clear()
        heads[key] = shingle_set(text, shingle)
    return heads[key]


def _near_keys(words: list[bytes], size: int, tables: int, rows: int) -> np.ndarray:
    """One key per table: the least hashes of ``rows`` permutations, mixed; texts of similarity s share it with s ** rows."""
    odd = np.arange(1, tables * rows + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4E) + np.uint64(1)
    least = np.full(tables * rows, np.iinfo(np.uint64).max)
    for block in shingle_hashes(words, size):
        for at in range(0, len(block), 4096):
            mixed = block[at : at + 4096, None] * odd
            mixed ^= mixed >> np.uint64(31)
            mixed *= odd[::-1]
            least = np.minimum(least, mixed.min(axis=0))
    key = np.arange(tables, dtype=np.uint64)
    for part in least.reshape(tables, rows).T:
        key = (key ^ part) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several keys."""
    several = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    return rows.join(several, "bucket")


def near_buckets(texts: DataFrame, shingle: int, tables: int, rows: int) -> DataFrame:
    """``bucket, key``: for every text one bucket a table, those with one member left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [_near_keys(words_of(x.as_py()), shingle, tables, rows) for x in batch.column(1)]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), tables)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).reshape(-1).view(np.int64)), keys], ["bucket", "key"])

    return materialize(_shared(materialize(texts.select("key", "text").mapInArrow(run, "bucket long, key binary"), "dup-near")), "dup-near-shared")


def rows_with_head(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with ``head`` (and its class), their bucket's key that is first in ``order``; the head's own row is left out.

    A hot bucket is dealt to several keys for the join; its first row is a partial aggregate.
    """
    firsts = [F.min_by(c, F.struct(order, "key")).alias(name) for c, name in (("key", "head"), ("class", "head_class")) if c in rows.columns]
    heads = rows.groupBy("bucket").agg(*firsts)
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(heads, ["bucket", "salt"]).where("key <> head").drop("salt")


def _star_round(left: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Compare a bucket's members with its head: (links, members that it doesn't confirm).

    The head is the member whose prints most texts have, which is closest to what they
    have in common; buckets of one group of copies so agree on it.
    """
    stars = materialize(rows_with_head(left, -F.col("weight")), "dup-stars")
    pairs = stars.select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    links = materialize(confirm_pairs(pairs, texts, shingle, similarity), "dup-links")
    found = links.select(F.col("a").alias("head"), F.col("b").alias("key"))
    return links, materialize(stars.join(found, ["head", "key"], "left_anti").drop("head"), "dup-left")


def merged_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``key, class`` after these links: only classes that they connect are looked at."""
    ends = links.join(classes.select(F.col("key").alias("a"), F.col("class").alias("class_a")), "a")
    ends = ends.join(classes.select(F.col("key").alias("b"), F.col("class").alias("class_b")), "b")
    joined = connected_components(ends.select("class_a", "class_b"), "class_a", "class_b")
    after = classes.join(joined.withColumnRenamed("node", "class"), "class", "left")
    return materialize(after.select("key", F.coalesce("component", "class").alias("class")), "dup-classes")


def _open_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with their ``class``: those of buckets that hold several."""
    named = rows.drop("class").join(classes, "key")
    several = named.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("bucket")
    return materialize(named.join(several, "bucket"), "dup-open")


def _slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the runs ``start, start + 1, ...`` of these lengths, end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def linked_members(size: np.ndarray, gone: np.ndarray, head_size: int, linked: np.ndarray, classes: np.ndarray, side: np.ndarray,
                   before: np.ndarray, asks: np.ndarray, at: np.ndarray, elements: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all pairs of members in different classes connect, as positions; exact.

    A member's difference from the head is ``elements[at[i]:at[i + 1]]``, found by its first ``before[i]`` and
    asking with its first ``asks[i]``.  As x and y share what the head has and neither lacks, and what both
    have beyond it, the shared elements of two differences tell their similarity, without the texts.
    Members of one side only are compared if there is one, else those of side 0 with those of side 1.
    """
    n, (_, ids) = len(size), np.unique(elements, return_inverse=True)
    length, across = np.diff(at), side.any()
    places = _slices(at[:-1], before)
    order = np.argsort(ids[places], kind="stable")
    posted = np.repeat(np.arange(n), before)[order]
    words = int(ids.max(initial=-1)) + 1
    first = np.searchsorted(ids[places][order], np.arange(words + 1))
    group, mark, found = np.unique(classes, return_inverse=True)[1], np.zeros(words, bool), ([], [])
    for x in np.flatnonzero(~linked):
        asked = ids[at[x] : at[x] + asks[x]]
        others = posted[_slices(first[asked], first[asked + 1] - first[asked])]
        others = others[group[others] != group[x]]
        if not len(others):
            continue
        others = np.unique(others)
        # two that aren't linked to the head ask each other: one of them is enough
        others = others[(linked[others] | (others > x)) & ((side[others] != side[x]) if across else True)]
        others = others[np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x]) - 1e-9]
        if not len(others):
            continue
        own = ids[at[x] : at[x + 1]]
        mark[own] = True
        hits = np.r_[0, np.cumsum(mark[ids[_slices(at[others], length[others])]])]
        mark[own] = False
        ends = np.cumsum(length[others])
        shared = head_size - gone[x] - gone[others] + hits[ends] - hits[ends - length[others]]
        for y in others[shared >= similarity * (size[x] + size[others] - shared)]:
            if group[y] != group[x]:
                found[0].append(x), found[1].append(y)
                group[group == group[y]] = group[x]
    return np.array(found[0], np.int64), np.array(found[1], np.int64)


def bucket_links(near: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between members of buckets that hold several classes.

    Members are read end to end, a bucket at a time.  A bucket of many is cut into parts, and two parts meet in a task:
    a member moves once for each part, of which there are at most ``PARTS`` up to ``PARTS * PART_ROWS`` members.
    """
    sizes = near.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    parts = F.greatest(F.ceil(F.col("n") / PART_ROWS), F.least(F.lit(PARTS), F.ceil(F.col("n") / LEAST_PART))).cast("int")
    dealt = near.join(sizes.select("bucket", parts.alias("parts")), "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).withColumn("side", (F.col("part") > F.col("other")).cast("int"))
    kind = near.schema["key"].dataType.simpleString()
    columns = ["key", "class", "size", "gone", "head_size", "linked", "before", "asks", "side", "difference"]

    def links(cell: pa.Table) -> pa.RecordBatch:
        cell = cell.combine_chunks()
        column = lambda name: cell[name].to_numpy()
        lists = cell["difference"].chunk(0)
        at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        classes = cell["class"].chunk(0).dictionary_encode().indices.to_numpy()
        x, y = linked_members(
            column("size"), column("gone"), int(column("head_size")[0]), column("linked"), classes, column("side"),
            column("before"), column("asks"), at, lists.flatten().to_numpy(zero_copy_only=False), similarity,
        )
        keys = cell["key"].chunk(0)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")])
            starts = np.flatnonzero(np.r_[True, (np.diff(names) != 0).any(axis=0)]) if len(batch) else []
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                if held and tuple(names[:, start]) != now:
                    yield links(pa.Table.from_batches(held))
                    held = []
                now = tuple(names[:, start])
                held.append(batch.slice(start, end - start).select(columns))
        if held:
            yield links(pa.Table.from_batches(held))

    by = ["bucket", "low", "high"]
    return cells.select(*by, *columns).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"a {kind}, b {kind}")


def vantage_round(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """One head for each bucket of several classes: (links found near it, rows of its far side)."""
    sides = rows_with_head(rows, -F.col("weight")).join(texts.select("key", "text"), "key")
    sides = sides.join(texts.select(F.col("key").alias("head"), F.col("text").alias("head_text")), "head")
    far_below = MIDDLE + 1 - similarity
    carried = ["bucket", "key", "class", "weight", "head", "head_class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[object, np.ndarray] = {}
        for batch in batches:
            linked, near, far, differences, figures = [], [], [], [], []
            for h, x, y in zip(batch.column("head"), batch.column("text"), batch.column("head_text"), strict=True):
                x_set, h_set = shingle_set(x.as_py(), shingle), _head_set(heads, h.as_py(), y.as_py(), shingle)
                is_linked, alike, found_by, asks = first_differences(x_set, h_set, similarity)
                new, gone = np.setdiff1d(x_set, h_set, assume_unique=True), np.setdiff1d(h_set, x_set, assume_unique=True)
                linked.append(is_linked), near.append(alike >= MIDDLE), far.append(alike <= far_below + 1e-9)
                figures.append((len(x_set), len(gone), len(h_set), len(found_by), len(found_by) + len(asks)))
                difference = np.concatenate([new, gone]).view(np.int64)
                differences.append(difference if alike >= MIDDLE else difference[:0])
            made = [*(pa.array(x, pa.bool_()) for x in (linked, near, far)), *(pa.array(x, pa.int64()) for x in np.array(figures, np.int64).reshape(-1, 5).T)]
            made.append(pa.array(differences, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *made], [*carried, "linked", "near", "far", *numbers, "difference"])

    numbers = ["size", "gone", "head_size", "before", "asks"]
    wanted = sides.select(*carried, "text", "head_text")
    kinds = [f"{c} {wanted.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} boolean" for c in ("linked", "near", "far")] + [f"{c} long" for c in numbers]
    read = materialize(wanted.mapInArrow(run, ", ".join([*kinds, "difference array<long>"])), "dup-differences")
    links = read.where("linked").select(F.col("head").alias("a"), F.col("key").alias("b"))
    # whatever the head confirms is of its class
    is_of = F.when(F.col("linked"), F.col("head_class")).otherwise(F.col("class")).alias("class")
    found = bucket_links(read.where("near").select("bucket", "key", is_of, "linked", *numbers, "difference"), similarity)
    far = read.where("far").select(F.xxhash64("bucket", "head").alias("bucket"), "key", "class", "weight", "near")
    apart = far.where("not near").select("bucket").distinct()
    return materialize(links.union(found), "dup-links"), materialize(far.join(apart, "bucket", "left_semi").drop("near"), "dup-far")


def _open_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs of a bucket that the links don't connect yet; for rests that no head is near to."""
    ours, theirs = (rows.select("bucket", F.col("key").alias(k), F.col("class").alias(f"class_{k}")) for k in ("a", "b"))
    return ours.join(theirs, "bucket").where("class_a < class_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star_rounds(rows: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(classes after two heads a bucket, rows of the buckets that hold several classes still)."""
    left, links = rows, []
    for _ in range(2):
        found, left = _star_round(left, texts, shingle, similarity)
        links.append(found)
    classes = merged_classes(classes, links[0].union(links[1]))
    return classes, _open_rows(rows, classes)


def vantage_rounds(rows: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The classes after all links inside the buckets."""
    for _ in range(HEADS):
        if rows.isEmpty():
            return classes
        found, far = vantage_round(rows, texts, shingle, similarity)
        classes = merged_classes(classes, found)
        rows = _open_rows(far, classes)
    return merged_classes(classes, materialize(confirm_pairs(_open_pairs(rows), texts, shingle, similarity), "dup-links"))


def text_classes(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, views: int = 8, keep: int = 3, radius: int = 2, tables: int = 32, rows: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, key`` of every row, ``key, class_id, class_key``): a class is named by its smallest id and the text that has it."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", text_key(F.col("text")))
    ids = materialize(keyed.select("doc_id", "key"), "dup-ids")
    nodes = ids.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    viewed = fingerprints(keyed.select(F.col("key").alias("doc_id"), "text"), shingle, views, keep)
    prints = materialize(viewed.withColumnRenamed("doc_id", "key").distinct(), "dup-views")
    linked = connected_components(similar_pairs(prints.select("fp").distinct(), radius), "a", "b")
    buckets = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    buckets = materialize(buckets.select("key", F.coalesce("component", "fp").alias("bucket")).distinct(), "dup-buckets")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = buckets.join(sizes, "bucket")
    # how many texts have the same prints: most for what a group of copies has in common
    popular = prints.groupBy("fp").agg(F.count("*").alias("times"))
    weights = prints.join(members.select("key").distinct(), "key", "left_semi").join(popular, "fp").groupBy("key").agg(F.sum("times").alias("weight"))
    weights = materialize(weights, "dup-weights")
    members = materialize(members.select("bucket", "key").join(weights, "key"), "dup-members")
    wanted = nodes.join(weights, "key", "left_semi").select(F.col("key").alias("wanted"), "first_id")
    texts = keyed.join(wanted, (F.col("key") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    texts = materialize(texts.select("key", "text").dropDuplicates(["key"]), "dup-texts")
    classes = materialize(weights.select("key", F.col("key").alias("class")), "dup-classes")
    classes, rest = _star_rounds(members, classes, texts, shingle, similarity)
    if not rest.isEmpty():
        asked = rest.select("key", "weight").distinct()
        narrow = near_buckets(texts.join(asked, "key", "left_semi"), shingle, tables, rows).join(asked, "key")
        classes, rest = _star_rounds(narrow, classes, texts, shingle, similarity)
        classes = vantage_rounds(rest, classes, texts, shingle, similarity)
    rooted = nodes.join(classes, "key", "left").withColumn("root", F.coalesce("class", "key"))
    first = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")
    names = rooted.groupBy("root").agg(F.min(first).alias("first"))
    named = rooted.join(names, "root").select("key", F.col("first.first_id").alias("class_id"), F.col("first.key").alias("class_key"))
    for table in (prints, buckets, members):
        discard(table)
    return ids, named


def verified_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, class_id``: one row per document; a class is named by its smallest id."""
    ids, classes = text_classes(docs, shingle, similarity)
    return ids.join(classes, "key").select("doc_id", "class_id")


def drop_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row for each class: that of the smallest id, whatever columns it has.

    Rows are judged by their text, so one that shares only its id with another stays; of
    repeated rows one stays.
    """
    ids, classes = text_classes(docs, shingle, similarity)
    kept = classes.where("key = class_key").select(F.col("key").alias("_text_key"), F.col("class_id").alias("_kept_id"))
    keyed = docs.withColumn("_text_key", text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = keyed.join(kept, "_text_key").where(F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")))
    repeated = ids.groupBy("key", "doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["_text_key"])
    return rows.select(*docs.columns)
