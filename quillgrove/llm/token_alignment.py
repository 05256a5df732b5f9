"""Alignment of two tokenizers' tokens of the same text, by the bytes that they cover.

``align``         one row per document: numbers of tokens, groups and links, a digest of
                  its groups, and its linked id pairs with how often each is linked.
``pair_counts``   corpus-wide: how many links hold a pair of ids, and whether that is the
                  highest count of its B id.
``link_scores``   per document, what its links' corpus-wide counts come to.
``group_rows``    the groups themselves: byte spans with the ids of both sides.

A reads a space and the text with a byte-level BPE, B the text with a sentencepiece
model, which adds that space.  Special tokens' strings are plain text to both.  A whole
Arrow batch is aligned at once: its documents' tokens lie end to end, the byte offsets
where tokens end are counted for A and B, groups are cut where both have one, and
differences of running sums at the documents' ends give each document's figures.  Two
tokens overlap in exactly one span between neighbouring ends, so links are those spans.

Defined results: a text that is null or empty, or that a side's tokens don't spell
(U+2581 in it, say), has no tokens: zeros and an empty digest; repeated rows and null
doc_ids are rows of their own; a text of any length is aligned whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrove.llm.worker import held, small_batches
from quillgrove.session import materialize

#: A table of pair counts up to this many pairs (some 20 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: Bits of a pair's number that hold the B id.
B_BITS = 20
SPACE_MARK = "▁"
#: Distinct pieces that a worker remembers; beyond this it starts afresh.
CACHE_PIECES = 800_000
#: A space before white space, before a control or format character, or at the end begins no word of its own.
UNSAFE_SPACE = re.compile(r" (?:[\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|$)")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class _Ids:
    """Ids of numbered pieces, end to end."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.size, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        while self.known + len(sizes) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        here = slice(self.known, self.known + len(sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[here], self.size[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.known = self.used + len(ids), here.stop

    def take(self, numbers: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the pieces' ids end to end, how many there are between the edges)."""
        sizes = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.start[numbers] - ends[:-1], sizes)
        where += np.arange(len(where))
        return self.flat[where], np.diff(ends[edges])


class _Vocabulary:
    """Per id: the bytes of its token, and its number as text with what may follow it in a group."""

    def __init__(self, spelled: list[bytes], last: bytes) -> None:
        self.spelled = np.array(spelled, object)
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        #: an id followed by a comma, or by what ends its side of a group
        self.written = np.array([b"%d%s" % (i, end) for end in (b",", last) for i in range(len(spelled))], object)


class Encoders(dict):
    """Both tokenizers, with the ids of each distinct piece of the texts: piece -> its number.

    Texts are cut before single spaces that a character other than a space precedes and one
    other than white space follows.  There the byte-level BPE begins a new word, and no piece
    of the other model has a space behind another character (else texts aren't cut).
    """

    def __init__(self, path_a: str, path_b: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.bytewise, self.piecewise = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytewise.encode_special_tokens = True
        letters, names = _byte_of_letter(), self.bytewise.get_vocab(with_added_tokens=False)
        spelled = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            spelled[number] = bytes(letters[x] for x in name)
        self.a = _Vocabulary(spelled, b"|")
        names = [self.piecewise.id_to_piece(i) for i in range(self.piecewise.get_piece_size())]
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b = _Vocabulary([bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(x)) else x.replace(SPACE_MARK, " ").encode() for x in names], b";")
        self.cuts = not any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in names)
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.a_ids, self.b_ids, self.is_spelled = _Ids(), _Ids(), np.zeros(0, bool)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number

    def _cut(self, text: str) -> list[str]:
        """Pieces of a space and ``text``."""
        if not self.cuts:
            return [" " + text]
        parts = text.split(" ")
        if parts[0] and not UNSAFE_SPACE.search(text):
            return [" " + x for x in parts]
        out, now = [], " " + parts[0]
        for before, x in pairwise(parts):
            if not before or not x or UNSAFE_SPACE.match(" " + x[0]):
                now += " " + x
            else:
                out.append(now)
                now = " " + x
        return [*out, now]

    def _learn(self) -> None:
        for at in range(0, len(self.fresh), 8192):
            part = self.fresh[at : at + 8192]
            raw = [x.encode() for x in part]
            # pieces follow each other in one string where they may
            heads = [i for i, x in enumerate(part) if not i or UNSAFE_SPACE.match(x)]
            strings = ["".join(part[i:j]) for i, j in pairwise([*heads, len(part)])]
            rows = [e.ids for e in self.bytewise.encode_batch_fast(strings, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(rows), np.int32, sum(map(len, rows)))
            ends = np.searchsorted(np.cumsum(self.a.lengths[ids]), np.cumsum(list(map(len, raw)))) + 1
            self.a_ids.add(ids, np.diff(ends, prepend=0))
            # the model puts the space that a piece begins with there by itself
            rows = self.piecewise.encode([x[1:] for x in part], num_threads=1)
            sizes = np.fromiter(map(len, rows), np.int32, len(rows))
            ids = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
            self.b_ids.add(ids, sizes)
            spells = np.concatenate([[0], np.cumsum(self.b.lengths[ids])])[np.cumsum(sizes)]
            if np.array_equal(spells, np.cumsum(list(map(len, raw)))) and b"".join(self.b.spelled[ids].tolist()) == b"".join(raw):
                good = np.ones(len(part), bool)
            else:
                good = [b"".join(self.b.spelled[row]) == x for row, x in zip(rows, raw, strict=True)]
            self.is_spelled = np.concatenate([self.is_spelled, good])
        self.fresh = []

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids end to end, how many per text, B's, how many, whether both spell the text)."""
        if len(self) > CACHE_PIECES:
            self._reset()
        cut = list(map(self._cut, texts))
        edges = np.cumsum([0, *map(len, cut)])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, int(edges[-1]))
        self._learn()
        unspelled = np.concatenate([[0], np.cumsum(~self.is_spelled[numbers])])  # bytes have tokens of A always
        return *self.a_ids.take(numbers, edges), *self.b_ids.take(numbers, edges), np.diff(unspelled[edges]) == 0


@dataclass
class Alignment:
    """A batch's tokens end to end; offsets are bytes from the batch's begin, ``docs`` the rows that have tokens."""

    docs: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_end: np.ndarray
    a_of_link: np.ndarray
    b_of_link: np.ndarray
    #: per document, how many of each lie before it, and one entry behind the last
    a_from: np.ndarray
    b_from: np.ndarray
    group_from: np.ndarray
    link_from: np.ndarray


def _only(ids: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids, counts) if wanted.all() else (ids[np.repeat(wanted, counts)], counts[wanted])


def align_batch(texts: list[str | None], of: Encoders) -> Alignment:
    docs = np.array([i for i, x in enumerate(texts) if x], np.int64)
    a_ids, a_counts, b_ids, b_counts, ok = of.tokens([texts[i] for i in docs])
    (a_ids, a_counts), (b_ids, b_counts), docs = _only(a_ids, a_counts, ok), _only(b_ids, b_counts, ok), docs[ok]
    a_end, b_end = np.cumsum(of.a.lengths[a_ids]), np.cumsum(of.b.lengths[b_ids])
    total = int(a_end[-1]) if len(a_end) else 0
    ends = np.bincount(a_end, minlength=total + 1).astype(np.int8) + 2 * np.bincount(b_end, minlength=total + 1).astype(np.int8)
    a_from, b_from = (np.concatenate([[0], np.cumsum(c)]) for c in (a_counts, b_counts))
    doc_end = np.concatenate([[0], a_end])[a_from]
    # running sums over byte offsets: how many cuts, links and ends of either side lie at or before each
    cuts, links = np.cumsum(ends == 3, dtype=np.int64), np.cumsum(ends > 0, dtype=np.int64)
    link_end = np.flatnonzero(ends)
    a_before, b_before = np.cumsum(ends & 1, dtype=np.int64), np.cumsum(ends >> 1, dtype=np.int64)
    return Alignment(
        docs, a_ids, b_ids, a_end, b_end, cuts[a_end - 1], cuts[b_end - 1], np.flatnonzero(ends == 3),
        a_before[link_end - 1], b_before[link_end - 1], a_from, b_from, cuts[doc_end], links[doc_end],
    )


def written_groups(x: Alignment, of: Encoders) -> list[bytes]:
    """Per document ``a1,a2|b1;a3|b2,b3``."""
    last_a = np.diff(x.a_group, append=-1) != 0
    last_b = np.diff(x.b_group, append=-1) != 0
    pieces = np.empty(len(x.a_ids) + len(x.b_ids), object)
    # a token's place: those of its own side before it, and the other's in groups before it (for B: up to its own)
    pieces[np.arange(len(x.a_ids)) + np.searchsorted(x.b_group, x.a_group, "left")] = of.a.written[x.a_ids + last_a * len(of.a.spelled)]
    pieces[np.arange(len(x.b_ids)) + np.searchsorted(x.a_group, x.b_group, "right")] = of.b.written[x.b_ids + last_b * len(of.b.spelled)]
    edges = x.a_from + x.b_from
    return [b"".join(pieces[s:e].tolist())[:-1] for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _encoders(path_a: str, path_b: str) -> Encoders:
    return held(f"encoders {path_a} {path_b}", lambda: Encoders(path_a, path_b))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs``; ``pairs`` are its distinct linked pairs (A id << 20 | B id), ``times`` how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _encoders(path_a, path_b)
        for batch in batches:
            x = align_batch(batch.column(1).to_pylist(), of)
            n, rows = np.zeros((4, len(batch)), np.int64), np.zeros(len(batch), np.int64)
            for out, edges in zip(n, (x.a_from, x.b_from, x.group_from, x.link_from), strict=True):
                out[x.docs] = np.diff(edges)
            digests = [""] * len(batch)
            for i, written in zip(x.docs, written_groups(x, of), strict=True):
                digests[i] = hashlib.sha256(written).hexdigest()
            linked = x.a_ids[x.a_of_link].astype(np.int64) << B_BITS | x.b_ids[x.b_of_link]
            pairs, times = [], []
            for s, e in zip(x.link_from[:-1], x.link_from[1:], strict=True):
                found, how_often = np.unique(linked[s:e], return_counts=True)
                pairs.append(found), times.append(how_often.astype(np.int32))
            rows[x.docs] = list(map(len, pairs))
            offsets = pa.array(np.concatenate([[0], np.cumsum(rows)]), pa.int32())
            flat = [np.concatenate(v) if v else np.zeros(0, k) for v, k in ((pairs, np.int64), (times, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, n), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in flat)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def group_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, number, start, stop, a_ids, b_ids``: the groups, with the bytes of a space and the text that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _encoders(path_a, path_b)
        for batch in batches:
            x = align_batch(batch.column(1).to_pylist(), of)
            sizes = np.diff(x.group_from)
            first, doc_start = np.repeat(x.group_from[:-1], sizes), np.repeat(np.concatenate([[0], x.a_end])[x.a_from[:-1]], sizes)
            start = np.concatenate([[0], x.group_end[:-1]])[: len(x.group_end)]
            ids = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(len(x.group_end) + 1)), pa.int32()), pa.array(i, pa.int32())) for g, i in ((x.a_group, x.a_ids), (x.b_group, x.b_ids))]
            rows = batch.column(0).take(pa.array(np.repeat(x.docs, sizes)))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(np.arange(len(first)) - first), pa.array(start - doc_start), pa.array(x.group_end - doc_start), *ids], ["doc_id", "number", "start", "stop", "a_ids", "b_ids"]
            )

    small_batches(docs.sparkSession)
    kinds = "doc_id long, number long, start long, stop long, a_ids array<int>, b_ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, kinds)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, is_best``: links corpus-wide, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = materialize(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "align-pairs")
    own_b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = counts.groupBy(own_b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, own_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("is_best"))


def link_scores(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A document's distinct pairs look their counts up; a broadcast table leaves each
    document's rows in its task, where they are summed before anything is shuffled.
    """
    aligned = materialize(align(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(aligned), "align-counts")
    table = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    scored = each.join(table, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(scored, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
