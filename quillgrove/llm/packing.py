"""Packing documents into training sequences as a cutting-stock problem.

A document is cut every ``capacity`` tokens; its full pieces are sequences of
their own, and the remainders form a histogram of lengths, rounded up to the
grain of 8 tokens so that the program stays small (the slack is under 1 %).  A linear program
over cutting patterns (column generation: a knapsack dynamic program prices new
patterns) says how often to use each pattern; counts are rounded down and the
rest is filled best-fit.  The histogram and the patterns are small whatever the
corpus: at most ``capacity`` rows.  Documents are ranked within their length by a
distributed sort and each rank maps to a sequence by arithmetic; offsets are a
running sum within the sequence.

Defined results: a null text counts as empty, so its one piece is the end id;
documents of equal doc_id are cut and placed each for itself; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrove.llm.token_cache import encoder
from quillgrove.llm.token_io import groups_by_size, with_end
from quillgrove.llm.worker import small_batches
from quillgrove.session import materialize

CAPACITY = 1024
#: Lengths are told apart in steps of this many tokens.
GRAIN = 8
#: Column generation ends when the bound is this near, or after so many patterns.
GAP = 1e-3
MAX_COLUMNS = 4000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document's tokens (with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in groups_by_size(np.array([len(x or "") + 1 for x in texts]), 1 << 20):
                flat, sizes = with_end(*encode.encode_all(texts[part]))
                pieces = -(-sizes // capacity)
                nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * capacity
                length = np.minimum(capacity, np.repeat(sizes, pieces) - start)
                raw = flat.astype("<u4")
                ends = np.cumsum(length)
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for n, e in zip(length, ends, strict=True)]
                ids = batch.column(0)[part.start : part.stop].take(pa.array(np.repeat(np.arange(len(sizes)), pieces)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.repeat(sizes, pieces))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the linear program


def _best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of each length that are worth most."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values
    item = np.full(capacity + 1, -1)
    item[lengths] = np.arange(len(lengths))
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = best[room - 1 :: -1] + worth[1 : room + 1] if room > 1 else best[:1] + worth[1:2]
        k = int(np.argmax(gain))
        if gain[k] > best[room - 1]:
            best[room], took[room] = gain[k], k + 1
        else:
            best[room], took[room] = best[room - 1], 0
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if took[room]:
            counts[item[took[room]]] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: how many of each length) and how often the relaxed program uses each.

    Revised simplex on the basis inverse, one priced column a step.
    """
    if not len(lengths):
        return np.zeros((0, 0), np.int64), np.zeros(0)
    copies = capacity // lengths
    basis = np.diag(copies).astype(np.int64)  # column j: pattern j
    inverse, use, bound = np.diag(1.0 / copies), demand / copies, 0.0
    for _ in range(MAX_COLUMNS):
        price = inverse.sum(axis=0)
        value, column = _best_pattern(price, lengths, capacity)
        bound = max(bound, float(price @ demand) / max(value, 1.0))  # price / value is dual feasible
        if use.sum() <= bound * (1 + GAP) or value <= 1 + 1e-9:
            break
        turn = inverse @ column
        ratio = np.where(turn > 1e-9, use / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use = np.maximum(use - step * turn, 0)
        use[out] = step
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
        basis[:, out] = column
    return basis.T, use


@dataclass
class Plan:
    """Patterns that together hold exactly the demanded pieces."""

    lengths: np.ndarray
    patterns: np.ndarray  # pattern x length -> copies
    times: np.ndarray

    def layout(self) -> dict[int, np.ndarray]:
        """By length: rows (first rank, first sequence, copies a sequence), in order of rank."""
        first_sequence = np.cumsum(self.times) - self.times
        out = {}
        for j, length in enumerate(self.lengths):
            rows = np.nonzero(self.patterns[:, j])[0]
            copies = self.patterns[rows, j]
            held = copies * self.times[rows]
            out[int(length)] = np.stack([np.cumsum(held) - held, first_sequence[rows], copies], axis=1)
        return out


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit patterns for the pieces that rounding leaves: longest first, then the longest that still fits."""
    left, patterns = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            fits = np.nonzero((left > 0) & (lengths <= room))[0]
            if not len(fits):
                break
            j = fits[-1]
            n = min(int(left[j]), room // int(lengths[j]))
            pattern[j] += n
            left[j] -= n
            room -= n * int(lengths[j])
        patterns.append(pattern)
    return np.array(patterns, np.int64).reshape(len(patterns), len(lengths))


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Which patterns to use how often, for a histogram of piece lengths."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    patterns, use = solve_patterns(lengths, demand.astype(float), capacity)
    times = np.floor(use).astype(np.int64)
    while len(times) and (over := np.nonzero(patterns.T @ times > demand)[0]).size:  # the inverse is only floating point
        times[np.argmax(patterns[:, over[0]] * (times > 0))] -= 1
    rest = _fill(lengths, demand - (patterns.T @ times if len(times) else 0), capacity)
    used = times > 0
    return Plan(lengths, np.concatenate([patterns[used], rest]), np.concatenate([times[used], np.ones(len(rest), np.int64)]))


# ---------------------------------------------------------------- placing the pieces


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Ranks: a range sort by (length in grains, doc_id, start), numbered within
    each task; what comes before a task is added from one small row per task and
    length.
    """
    spark = pieces.sparkSession
    grains = F.ceil(F.col("length") / grain).cast("int")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            kinds = batch.column(5).to_numpy()
            rank = np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds):
                mine = np.nonzero(kinds == kind)[0]
                rank[mine] = seen.get(kind, 0) + np.arange(len(mine))
                seen[kind] = seen.get(kind, 0) + len(mine)
            names = [*batch.schema.names, "part", "rank"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("grains"), F.col("doc_id"), F.col("start")]
    ranged = pieces.withColumn("grains", grains).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranked = materialize(ranged.mapInArrow(number, PIECES + ", grains int, part int, rank long"), "pack-ranked")
    before: dict[int, dict[int, int]] = {}
    histogram: dict[int, int] = {}
    # a range-sorted task holds few lengths: rows here are at most tasks + capacity / grain
    for r in ranked.groupBy("part", "grains").count().orderBy("part").collect():
        before.setdefault(r["grains"], {})[r["part"]] = histogram.get(r["grains"], 0)
        histogram[r["grains"]] = histogram.get(r["grains"], 0) + r["count"]
    layout = plan(histogram, capacity // grain).layout()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, parts, ranks = (batch.column(i).to_numpy() for i in (5, 6, 7))
            sequence = np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds):
                mine = np.nonzero(kinds == kind)[0]
                base = np.zeros(len(mine), np.int64)
                for part in np.unique(parts[mine]):
                    base[parts[mine] == part] = before[int(kind)][int(part)]
                rank, rows = base + ranks[mine], layout[int(kind)]
                row = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
                sequence[mine] = row[:, 1] + (rank - row[:, 0]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(7), pa.array(sequence)], [*batch.schema.names[:5], "rank", "sequence_id"])

    placed = ranked.mapInArrow(place, PIECES + ", rank long, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank", "doc_id", "start")
    filled = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.withColumn("offset", filled).drop("rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each."""
    # written first: the range sort looks at its input twice
    pieces = materialize(cut_pieces(docs, tokenizer_path, capacity), "pack-pieces")
    placed = pack_pieces(pieces, capacity, grain)
    return placed.withColumn("length", F.col("length").cast("long"))
