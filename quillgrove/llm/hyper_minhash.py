"""HyperMinHash near duplicates: classes of texts whose shingle sets have a Jaccard similarity of 0.85 or more.

``sketches``        per document its set's size and key, compressed registers, and band keys.
``estimated``       Jaccard similarity of two sketches, corrected for chance collisions.
``near_duplicates`` one row per document with its set's size and its class.

A set's 64-bit shingle hashes fall into buckets by their top bits; a bucket's register
keeps, of its least hash, the number of leading zeros and the ten bits behind the first
one: 16 bits instead of 64.  Empty registers borrow from the bucket that a fixed
sequence of hashes reaches first, for bands only.  Bands of six registers propose
buckets of sets; equal sets are one node from the start.  A bucket's members are
compared with a head: by their sizes, then by the registers (a pair goes unless the
estimate is six standard errors below the limit), then on the whole sets.  Those that
it doesn't confirm get a second head.  Buckets that hold several classes still, and
pairs that no head has met, are searched exactly inside the bucket, by differences
from vantage points (see ``similar_texts``); no pairs of a bucket are listed.

A pair at exactly 0.85 shares no band with probability (1 - 0.85^6)^42, some 2e-9.

Defined results: a null, empty or blank text has an empty set, which is linked with
nothing; repeated rows and rows of one doc_id are rows of their own; a null doc_id
names a class only where no member has an id, and such a row isn't kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.llm.similar_texts import confirm_pairs, merged_classes, rows_with_head, shingle_set, vantage_round
from quillgrove.llm.worker import release, small_batches
from quillgrove.session import discard, materialize

#: Bits that choose a bucket, and bits kept behind the first one.
BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
BAND_ROWS = 6
BANDS = BUCKETS // BAND_ROWS
#: Standard errors that an estimate may lie below the limit.
SLACK = 6.0
#: Vantage points that a bucket gets, one after the other; what the first leaves is little (see README).
HEADS = 1
#: Keys of wanted texts up to this many (some 40 bytes each) are broadcast, so that texts stay where they are; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


# ---------------------------------------------------------------- sketches


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of ascending distinct hashes: leading zeros + 1, then the mantissa; 0 where a bucket is empty."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # ascending: a bucket's least comes first
    rest = hashes[first] << np.uint64(BUCKET_BITS)
    # a float's exponent tells the leading bit; what rounding could carry over is cut off first
    high = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - high, 52)
    behind = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA_BITS) | behind).astype(np.uint16)
    return out


def _borrow_order() -> np.ndarray:
    """For every bucket, in which order the others are asked: by a fixed hash of both."""
    pairs = np.arange(BUCKETS * BUCKETS, dtype=np.uint64)
    pairs = (pairs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    return np.argsort((pairs ^ pairs >> np.uint64(32)).reshape(BUCKETS, BUCKETS), axis=1)


_ORDER = _borrow_order()


def filled(own: np.ndarray) -> np.ndarray:
    """Registers in which every empty one holds that of the first bucket of its order that isn't."""
    if own.all() or not own.any():
        return own
    lender = _ORDER[np.arange(BUCKETS), (own != 0)[_ORDER].argmax(axis=1)]
    return np.where(own != 0, own, own[lender])


def band_keys(own: np.ndarray) -> np.ndarray:
    rows = filled(own)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for part in rows.T:
        key = (key ^ part) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


#: A text is known by two hashes of 64 bits, so that sketches needn't carry it.
TEXT_HASHES = ["text_hash", "text_hash_2"]
SKETCHED = "doc_id long, n_shingles long, key binary, registers binary, bands array<long>, text_hash long, text_hash_2 long"


def hashed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the text's hashes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.withColumns(dict(zip(TEXT_HASHES, (F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")), strict=True)))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, key, registers, bands`` and the text's hashes; equal sets have one key, empty ones none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes, keys, kept, bands = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), shingle)
                own = registers(hashes)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                kept.append(own.tobytes() if len(hashes) else None)
                bands.append(band_keys(own) if len(hashes) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            names = ["doc_id", "n_shingles", "key", "registers", "bands", *TEXT_HASHES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(2), batch.column(3)], names)

    return hashed_texts(docs).mapInArrow(run, SKETCHED)


# ---------------------------------------------------------------- estimates


def chance_of_collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely registers of two disjoint sets of these sizes agree.

    With a and b members a bucket, the least ones have densities a exp(-a x) and b exp(-b x);
    registers agree if both lie in one cell, and cells at z leading zeros are 2^-(z + 1 + mantissa) wide.
    """
    a, b = (np.maximum(x, 1)[:, None] / BUCKETS for x in (n, m))
    level = 2.0 ** -np.arange(64 - BUCKET_BITS)[None, :]
    inside = np.exp(-(a + b) * level / 2) - np.exp(-(a + b) * level)
    return np.minimum(0.5, (level / 2 / (1 << MANTISSA_BITS) * a * b / (a + b) * inside).sum(axis=1))


def estimated(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, registers that they rest on) of pairs: rows of registers and set sizes."""
    used = ((x != 0) | (y != 0)).sum(axis=1)
    agree = ((x == y) & (x != 0)).sum(axis=1) / np.maximum(used, 1)
    by_chance = chance_of_collision(n, m)
    return (agree - by_chance) / (1 - by_chance), used


def may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs that neither sizes nor registers rule out."""
    fits = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    estimate, used = estimated(x, y, n, m)
    return fits & (estimate + SLACK * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1)) >= similarity)


def likely_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows ``a, b`` of ``pairs`` whose sketches may be of similar sets."""
    sides = pairs
    for side in ("a", "b"):
        sides = sides.join(nodes.select(F.col("key").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (4, 5))
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(x, y, n, m, similarity)))

    return sides.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- classes


def shared_buckets(banded: DataFrame) -> DataFrame:
    """``bucket, size, key, weight`` of ``key, bands``: buckets of several sets; a set's weight is how many its buckets hold in all.

    Bands are moved once, as two numbers each; what shares no bucket goes where they are counted.
    """
    each = banded.select("key", F.explode("bands").alias("bucket"))
    sized = each.withColumn("size", F.count("*").over(Window.partitionBy("bucket")))
    shared = materialize(sized.where("size > 1").select("bucket", "size", "key"), "hyper-shared")
    weights = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    members = materialize(shared.join(weights, "key"), "hyper-members")
    discard(shared)
    return members


def narrowed(rows: DataFrame, wanted: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` is in ``wanted`` (or isn't), without a shuffle of theirs where that is small."""
    wanted = materialize(wanted.select(column).distinct(), "hyper-wanted")
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, column, how)


def texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, text`` of the rows ``key, doc_id`` and text hashes, read from the documents again."""
    wanted = materialize(asked.select("key", F.col("doc_id").alias("id"), *(F.col(c).alias(f"{c}_of") for c in TEXT_HASHES)), "hyper-wanted")
    n = wanted.count()
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    for c in TEXT_HASHES:
        same = same & (F.col(c) == F.col(f"{c}_of"))
    found = materialize(hashed_texts(docs).join(F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted, same).select("key", "text"), "hyper-texts")
    return found if found.count() == n else materialize(found.dropDuplicates(["key"]), "hyper-texts")  # repeated rows


def _head_round(rows: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links with the buckets' heads, rows that their head doesn't confirm)."""
    stars = materialize(rows_with_head(rows, -F.col("weight")), "hyper-stars")
    pairs = stars.select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    likely = materialize(likely_pairs(pairs, nodes, similarity), "hyper-likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("key"))
    links = materialize(confirm_pairs(likely, narrowed(texts, ends, "key"), shingle, similarity), "hyper-links")
    found = links.select(F.col("a").alias("head"), F.col("b").alias("key"))
    return links, materialize(stars.join(found, ["head", "key"], "left_anti").drop("head"), "hyper-left")


def unexplained(members: DataFrame, left: DataFrame) -> DataFrame:
    """``bucket, key, weight``: buckets in which two heads haven't met every pair.

    Two members need one head; three need two, and only if the first confirms neither.
    """
    once = left.groupBy("bucket").agg(F.count("*").alias("rest"))
    return members.where("size > 2").join(once, "bucket").where("size > 3 or rest < 2").select("bucket", "key", "weight")


def open_buckets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` of buckets that hold several classes, with ``class`` and the bucket's ``head``."""
    named = rows.join(classes, "key")
    head = F.min_by("key", F.struct(-F.col("weight"), "key")).alias("head")
    several = named.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), head).where("low < high")
    return materialize(named.join(several.select("bucket", "head"), "bucket"), "hyper-open")


def set_classes(members: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``key, class`` of the sets that share a band: what links connect has one class.

    An open bucket's head is its vantage point; buckets of one head are searched as one, so
    that a set comes once for each head and not for each band.  What is far from it goes on
    in its own bands; what is far from ``HEADS`` heads is compared there by sizes and registers.
    """
    first, left = _head_round(members, nodes, texts, shingle, similarity)
    second, _ = _head_round(left, nodes, texts, shingle, similarity)
    classes = members.select("key", F.col("key").alias("class")).distinct()
    classes = merged_classes(materialize(classes, "hyper-classes"), first.union(second))
    rows, one = unexplained(members, left), F.xxhash64("head")
    for _ in range(HEADS):
        opened = open_buckets(rows, classes)
        if opened.isEmpty():
            return classes
        found, far = vantage_round(opened.select(one.alias("bucket"), "key", "weight", "class").distinct(), narrowed(texts, opened, "key"), shingle, similarity)
        classes = merged_classes(classes, found)
        far = far.select(F.col("bucket").alias("far"), "key")
        rows = opened.withColumn("far", F.xxhash64(one, "head")).join(far, ["far", "key"], "left_semi").select("bucket", "key", "weight")
    sized = open_buckets(rows, classes).join(nodes.select("key", "n_shingles"), "key")
    ours, theirs = (sized.select("bucket", F.col("key").alias(k), F.col("class").alias(f"class_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "ab")
    fit = (F.col("n_a") >= similarity * F.col("n_b") - 1e-9) & (F.col("n_b") >= similarity * F.col("n_a") - 1e-9)
    pairs = ours.join(theirs, "bucket").where((F.col("class_a") < F.col("class_b")) & fit).select("a", "b").distinct()
    likely = materialize(likely_pairs(materialize(pairs, "hyper-rest"), nodes, similarity), "hyper-likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("key"))
    return merged_classes(classes, materialize(confirm_pairs(likely, narrowed(texts, ends, "key"), shingle, similarity), "hyper-links"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a class is named by its smallest doc_id, whose row is kept."""
    small_batches(docs.sparkSession)
    sketched = materialize(sketches(docs, shingle).withColumnRenamed("key", "set").withColumn("key", F.monotonically_increasing_id()), "hyper-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    # one row of each set, by its number, has the set's bands and registers; they stay where they are
    nodes = sketched.where("set is not null").groupBy("set").agg(first, F.min("key").alias("key"), F.count("*").alias("n"))
    nodes = materialize(nodes.select("set", "key", F.col("first.doc_id").alias("first_id"), "n"), "hyper-nodes")
    sets = sketched.where("set is not null")
    copied = sets.select("set", "key").join(nodes.where("n > 1").select("set", F.col("key").alias("own")), "set").where("key <> own")
    members = shared_buckets(narrowed(sets.select("key", "bands"), copied, "key", "left_anti"))
    asked = narrowed(sketched.select("key", "doc_id", "n_shingles", "registers", *TEXT_HASHES), members, "key")
    asked = materialize(asked, "hyper-asked")
    classes = set_classes(members, asked, texts_of(docs, asked), shingle, similarity)
    rooted = nodes.select("set", "key", "first_id").join(classes, "key", "left").withColumn("root", F.coalesce("class", "key"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    named = rooted.join(names, "root").select("set", "component")
    out = sketched.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
