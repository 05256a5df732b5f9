"""SimHash near-duplicate detection with vantage-point trees.

``fingerprints``  one 64-bit SimHash per document (or several, one per view).
``similar_pairs`` exact Hamming search: a small tree, built on the driver from a
                  bounded sample, deals every fingerprint to one leaf; copies of
                  it go as queries to every other leaf whose region lies within
                  the radius (triangle bound).  Each leaf searches a local tree
                  and reports the links as stars, never as all pairs of a group.
``near_duplicates``  one row per document with its class id.

``similar_texts`` builds on it for similarity of whole shingle sets.

Defined results: a null or blank text has fingerprint zero; repeated rows and
rows with the same doc_id are rows of their own that share a class; empty tables
give empty results; a null doc_id keeps its row and never names a class unless
no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.worker import release, small_batches
from quillgrove.operators.components import connected_components
from quillgrove.session import materialize

SEED = 42
#: Shingle hashes turned into bits at a time: bounds memory for very long texts.
HASH_BLOCK = 1 << 16
#: Fingerprints collected to build the tree that deals out the rest: at most this many.
TREE_SAMPLE = 1 << 15
#: Fingerprints aimed at per leaf of that tree.
LEAF_SIZE = 16_384
LOCAL_LEAF = 48


# ---------------------------------------------------------------- fingerprints


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    if text is None:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words (the whole text if shorter), in blocks."""
    if not words:
        return
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(words) - size + 1)
    for at in range(0, last, HASH_BLOCK):
        stop = min(last, at + HASH_BLOCK)
        yield np.fromiter((digest(join(words[i : i + size]), SEED) for i in range(at, stop)), np.uint64, stop - at)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.uint32).astype(np.int64)


def pack_bits(bits: np.ndarray) -> np.uint64:
    return np.packbits(bits, bitorder="little").view("<u8")[0]


def simhash(words: list[bytes], size: int) -> np.uint64:
    """A bit is 1 where over half of the shingle hashes have it."""
    ones, n = np.zeros(64, np.int64), 0
    for block in shingle_hashes(words, size):
        ones += bit_counts(block)
        n += len(block)
    return pack_bits(ones * 2 > n) if n else np.uint64(0)


def view_simhashes(words: list[bytes], size: int, views: int, keep: int) -> list[int]:
    """One SimHash for each of ``views`` min-wise samples of ``keep`` distinct shingles.

    View v orders the shingles by a multiplicative permutation of their hashes
    and takes the smallest; near copies agree on such a sample with probability
    about similarity ** keep, unlike a SimHash of all shingles, which moves by
    several bits at a similarity of 0.8.
    """
    best = [np.empty(0, np.uint64)] * views
    odd = (np.arange(1, views + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for block in shingle_hashes(words, size):
        block = np.unique(block)
        for v in range(views):
            mixed = block * odd[v]
            mixed ^= mixed >> np.uint64(32)
            mixed *= odd[v]
            if len(mixed) > keep:
                mixed = np.partition(mixed, keep - 1)[:keep]
            best[v] = np.unique(np.concatenate([best[v], mixed]))[:keep]
    out = []
    for v in range(views):
        sample = best[v] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(v)
        sample ^= sample >> np.uint64(29)
        sample *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(int(pack_bits(bit_counts(sample) * 2 > len(sample))) if len(sample) else 0)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, views: int = 0, keep: int = 4) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit pattern): one row a document, or one a view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            if views:
                rows = [view_simhashes(words_of(x.as_py()), shingle, views, keep) for x in texts]
                fps = np.array(rows, np.uint64).reshape(-1)
                ids = ids.take(pa.array(np.repeat(np.arange(len(batch)), views)))
            else:
                fps = np.fromiter((simhash(words_of(x.as_py()), shingle) for x in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()  # a number, or whatever else names a text
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- the shared tree


class VantageTree:
    """A complete binary tree in heap order: node i has children 2i+1 (near) and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        nodes = (1 << depth) - 1
        self.depth, self.vantage, self.reach = depth, np.zeros(nodes, np.uint64), np.zeros(nodes, np.int16)
        held: dict[int, np.ndarray] = {0: sample}
        for i in range(nodes):
            mine = held.pop(i, sample[:0])
            if len(mine):
                self.vantage[i] = mine[0]
                d = np.bitwise_count(mine ^ mine[0])
                self.reach[i] = int(np.median(d[1:])) if len(mine) > 1 else 32
                held[2 * i + 1], held[2 * i + 2] = mine[d <= self.reach[i]], mine[d > self.reach[i]]
            else:
                self.reach[i] = 32

    def deal(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, fingerprint, is_member): each once as a member of its leaf, and as a
        query of every other leaf that may hold a smaller-side partner."""
        node, x, home = np.zeros(len(fps), np.int64), fps, np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(x ^ self.vantage[node]).astype(np.int16)
            reach = self.reach[node]
            near = d <= reach
            # a member goes to its side; if outside but close to the sphere it also asks inside
            go_near = np.where(home, near, d <= reach + radius)
            go_far = np.where(home, ~near, d > reach - radius)
            asks = home & ~near & (d <= reach + radius)
            node = np.concatenate([2 * node[go_near] + 1, 2 * node[go_far] + 2, 2 * node[asks] + 1])
            x = np.concatenate([x[go_near], x[go_far], x[asks]])
            home = np.concatenate([home[go_near], home[go_far], np.zeros(asks.sum(), bool)])
        return node, x, home


# ---------------------------------------------------------------- search in a leaf


class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[x]
            if np.array_equal(up, x):
                return x
            p[x] = p[up]
            x = p[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            np.minimum.at(self.parent, a, b)


def leaf_links(members: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what the pairs within ``radius`` connect, as stars.

    Pairs looked at: two members, or a query and a member.
    """
    points, union = np.concatenate([members, queries]), _Union(len(members) + len(queries))

    def compare(m: np.ndarray, q: np.ndarray) -> None:
        both = np.concatenate([m, q])
        width = max(1, (1 << 20) // max(1, len(m)))
        for at in range(0, len(both), width):
            part = both[at : at + width]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[m][None, :]) <= radius)
            a, b = part[i], m[j]
            union.join(a[a != b], b[a != b])

    stack = [(np.arange(len(members)), np.arange(len(members), len(points)))]
    while stack:
        m, q = stack.pop()
        if not len(m):
            continue
        if len(m) <= LOCAL_LEAF:
            compare(m, q)
            continue
        v = points[m[len(m) // 2]]
        dm, dq = np.bitwise_count(points[m] ^ v).astype(np.int16), np.bitwise_count(points[q] ^ v).astype(np.int16)
        reach = int(np.median(dm))
        inside = dm <= reach
        if inside.all():
            reach -= 1
            inside = dm <= reach
        if inside.all() or not inside.any():  # one sphere holds all of them: no bound tells them apart
            compare(m, q)
            continue
        asks = m[~inside & (dm <= reach + radius)]
        stack.append((m[inside], np.concatenate([q[dq <= reach + radius], asks])))
        stack.append((m[~inside], q[dq > reach - radius]))
    root = union.find(np.arange(len(points)))
    linked = np.nonzero(root != np.arange(len(points)))[0]
    return points[linked], points[root[linked]]


def similar_pairs(distinct: DataFrame, radius: int = 2, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """``a, b``: links between the distinct fingerprints in column ``fp``.

    They connect exactly the classes that all pairs at Hamming distance
    ``radius`` or less connect.
    """
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf_size))))
    sample = distinct.orderBy(F.xxhash64(F.xxhash64("fp"))).limit(TREE_SAMPLE) if depth else distinct.limit(0)
    tree = VantageTree(np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                leaf, x, home = tree.deal(fps[at : at + 4096], radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(x.view(np.int64)), pa.array(home)], ["leaf", "fp", "home"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        a, b = leaf_links(fps[home], fps[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean")
    return dealt.groupBy("leaf").applyInPandas(search, "a long, b long")


# ---------------------------------------------------------------- classes of documents


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """``doc_id, fp, component_id``: exact classes of fingerprints within ``radius``."""
    prints = materialize(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shingle), "simhash")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    linked = connected_components(similar_pairs(firsts, radius, leaf_size), "a", "b")
    rooted = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    names = rooted.where("component is not null").groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = rooted.join(names, "root", "left").select("fp", F.coalesce("class_id", "first_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
