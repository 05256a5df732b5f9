r"""Line deduplication by content-defined chunks of lines, with the seams between them.

A text's lines (split at ``\n``) are hashed; a rolling hash over the last two line
hashes decides whether a chunk ends after a line, so an inserted line moves only
the boundaries next to it.  A line of ``long_words`` or more words is a chunk of
its own.  Chunks with several lines that aren't blank, and such long lines, that
occur more than once in the corpus are removed everywhere but at their first place
(smallest doc_id, then position), after their bytes have been compared.

Where a repeated passage begins or ends inside a chunk, the chunk differs between
copies.  So lines that follow each other (blank ones between them aside) are seams,
counted the same way but for those inside a chunk that is removed anyway: a repeated
seam carries the removal from a chunk, line by line, up to where the copies part, and
finds passages too short to hold a chunk.  Together: a line goes if it is one of two
neighbours that stand in the same order at an earlier place, or is long and stands at
an earlier place.  A line's first place always stays.  A blank line goes if the lines
around it, blank ones aside, both go.  A line repeated three or more times in a row is
left once.

Only hashes travel until a hash repeats; only texts of repeated hashes are
compared.  The grouping is partial aggregation, so a passage that a third of the
documents share reaches a task as one row per task.

Defined results: a null text stays null, an empty one empty; rows of equal doc_id
and text are one document, of which neither loses to the other; null doc_ids
count as the smallest, texts of one id in order of their hashes; other columns pass through, ``n_chars`` is set anew where
the table has it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrove.llm.worker import release, small_batches
from quillgrove.session import materialize

#: One line in so many ends a chunk, on average.
DIVISOR = 3
LONG_WORDS = 50
NO_ID = -(1 << 63)


class Unit(NamedTuple):
    """A chunk (even number) or a seam (odd number) of a text: both rise with their place."""

    number: int
    hash: int
    lines: list[int]
    #: The chunk that a seam lies in, or -1.
    inside: int

    def raw(self, lines: list[bytes]) -> bytes:
        return b"\n".join(lines[i] for i in self.lines)


def _hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in lines), np.uint64, len(lines))


def chunk_bounds(lines: list[bytes], hashes: np.ndarray, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """(first line, line behind the last) of each chunk."""
    rolled = hashes * np.uint64(0x9E3779B97F4A7C15)
    rolled[1:] ^= hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    ends = (rolled >> np.uint64(33)) % np.uint64(divisor) == 0
    bounds, start = [], 0
    for i, line in enumerate(lines):
        long = _is_long(line, long_words)
        if long and i > start:
            bounds.append((start, i))
            start = i
        if long or ends[i]:
            bounds.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        bounds.append((start, len(lines)))
    return bounds


def _is_long(line: bytes, long_words: int) -> bool:
    return len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words


def units_of(lines: list[bytes], divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[Unit]:
    """The chunks and seams that may be removed, in order of their numbers within each kind."""
    hashes, units = _hashes(lines), []
    full = [i for i, x in enumerate(lines) if x.strip()]
    chunk_of, filled = [-1] * len(lines), np.zeros(len(lines) + 1, np.int64)
    filled[np.array(full, np.int64) + 1] = 1
    filled = filled.cumsum()
    for number, (a, b) in enumerate(chunk_bounds(lines, hashes, divisor, long_words)):
        if filled[b] - filled[a] > 1 or (b - a == 1 and _is_long(lines[a], long_words)):
            units.append(Unit(2 * number, xxhash.xxh64_intdigest(b"\n".join(lines[a:b]), 11) - (1 << 63), list(range(a, b)), -1))
            chunk_of[a:b] = [2 * number] * (b - a)
    if len(full) > 1:
        first, second = hashes[full[:-1]], hashes[full[1:]]
        mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64).tolist()
        for i, j, h in zip(full, full[1:], mixed, strict=False):
            units.append(Unit(2 * i + 1, h, [i, j], chunk_of[i] if chunk_of[i] == chunk_of[j] else -1))
    return units


def without(lines: list[bytes], gone: set[int]) -> list[bytes]:
    """The lines but those of ``gone``, and but blank ones between two of those."""
    kept, blanks, before = [], [], False
    for i, line in enumerate(lines):
        if not line.strip():
            blanks.append(line)
            continue
        if not (before and i in gone):
            kept += blanks
        blanks, before = [], i in gone
        if not before:
            kept.append(line)
    return kept + blanks


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _repeated(units: DataFrame) -> DataFrame:
    """``hash, first`` of hashes at several places."""
    place = F.struct("id", "key", "unit")
    return units.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")


def _later(units: DataFrame, firsts: DataFrame, *keys: str) -> DataFrame:
    return units.join(firsts, list(keys)).where(F.struct("id", "key", "unit") != F.col("first")).select("id", "key", "unit", "hash")


def repeated_units(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """``id, key, unit, hash`` of every chunk and seam to remove: it equals an earlier one byte by byte.

    A row is named by its id and its text's hash: rows without id, or of one id, are told apart.
    """

    def list_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            row, numbers, hashes, inside = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for unit in units_of((text or "").encode().split(b"\n"), divisor, long_words):
                    row.append(i), numbers.append(unit.number), hashes.append(unit.hash), inside.append(unit.inside)
            names = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
            columns = [*names, pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(inside, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "unit", "hash", "inside"])

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted, lines = set(wanted), (text or "").encode().split(b"\n")
                for unit in units_of(lines, divisor, long_words):
                    if unit.number in wanted:
                        for column, value in zip(rows, (i, key, unit.number, unit.hash, unit.raw(lines)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["id", "key", "unit", "hash", "raw"])

    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    found = materialize(keyed.mapInArrow(list_units, "id long, key long, unit int, hash long, inside int"), "line-units")
    chunks, seams = found.where("unit % 2 = 0").drop("inside"), found.where("unit % 2 = 1")
    again = materialize(_repeated(chunks), "line-again")
    later = _later(chunks, again, "hash").select("id", "key", F.col("unit").alias("inside")).distinct()
    seams = materialize(seams.join(later, ["id", "key", "inside"], "left_anti").drop("inside"), "line-seams")
    again = again.union(materialize(_repeated(seams), "line-seams-again")).select("hash")
    wanted = chunks.union(seams.select(chunks.columns)).join(again, "hash").groupBy("id", "key").agg(F.collect_set("unit").alias("wanted"))
    texts = keyed.join(wanted, ["id", "key"]).mapInArrow(cut_texts, "id long, key long, unit int, hash long, raw binary")
    texts = materialize(texts, "line-texts")
    # tables of their own, so that both sides of a join are shuffled for it and a hot unit's side can be split
    firsts = materialize(texts.groupBy("hash", "raw").agg(F.min(F.struct("id", "key", "unit")).alias("first")), "line-firsts")
    versions = materialize(firsts.groupBy("hash").agg(F.count("*").alias("n"), F.min("first").alias("first")), "line-versions")
    # bytes need to meet again only where texts of one hash differ
    alike = _later(texts.drop("raw"), versions.where("n = 1").drop("n"), "hash")
    clashing = texts.join(versions.where("n > 1").select("hash"), "hash", "left_semi")
    return alike.union(_later(clashing, firsts, "hash", "raw")).distinct()


def remove_units(docs: DataFrame, repeated: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` without those chunks and seams, and ``removed_lines``."""
    docs = docs.drop("removed_lines")
    names = docs.columns
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    out = T.StructType([*fields, T.StructField("removed_lines", T.LongType())])
    own = "_" * max(map(len, names))  # a prefix that no column of the documents has
    marks = repeated.groupBy(F.col("id").alias(own + "id"), F.col("key").alias(own + "key")).agg(F.collect_list("unit").alias(own + "marks"))
    joined = docs.withColumns({"text": F.col("text").cast("string"), own + "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), own + "key": F.xxhash64(F.col("text").cast("string"))})
    joined = joined.join(marks, [own + "id", own + "key"], "left").select(*names, own + "marks")
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts, removed = columns[at_text].to_pylist(), [0] * len(batch)
            chars = columns[at_chars].to_pylist() if at_chars >= 0 else []
            for i, marks in enumerate(batch.column(len(names)).to_pylist()):
                if not marks or texts[i] is None:
                    continue
                lines, marked = texts[i].encode().split(b"\n"), set(marks)
                gone = {k for unit in units_of(lines, divisor, long_words) if unit.number in marked for k in unit.lines if lines[k].strip()}
                kept = without(lines, gone)
                removed[i], texts[i] = len(lines) - len(kept), b"\n".join(kept).decode()
                if at_chars >= 0:
                    chars[i] = len(texts[i])
            columns[at_text] = pa.array(texts, pa.string())
            if at_chars >= 0:
                columns[at_chars] = pa.array(chars, columns[at_chars].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], [*names, "removed_lines"])

    return joined.mapInArrow(run, out)


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` without the lines of repeated chunks and seams, and ``removed_lines``."""
    return remove_units(docs, repeated_units(docs, divisor, long_words), divisor, long_words)
