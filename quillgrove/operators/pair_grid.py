"""All pairs of rows as a grid: every row is sent to each cell of its line once, however many rows there are.

Groups of rows are compared two by two.  A task reads a cell in order, the rows of one group (held as
arrays) and then those of the other, a batch at a time; tiles of scores bound what is in memory
at once.  With a fixed number of groups what is moved grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of a table of many rows, and rows of a group beyond which there are more groups.
GROUPS, GROUP_ROWS = 12, 65_536
#: Rows below which a group isn't cut further, and rows of both sides of a tile.
LEAST_ROWS, TILE, TILE_HELD = 1024, 512, 2048

PAIRS = "a long, b long, score double"
Arrays = dict[str, np.ndarray]


def groups_for(n: int) -> int:
    return max(1, -(-n // GROUP_ROWS), min(GROUPS, -(-n // LEAST_ROWS)))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _arrays(batch: pa.RecordBatch) -> Arrays:
    return {name: matrix(batch[name]) if name == "unit" else batch[name].to_numpy(zero_copy_only=False) for name in batch.schema.names}


def _slack(x: np.ndarray, y: np.ndarray) -> float:
    """How far a product in single precision may be off (a float's half digit for each of a row's terms and for both factors)."""
    longest = [np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0)) for v in (x, y)]
    return (x.shape[1] + 4) * 2.0**-23 * longest[0] * longest[1]


def scores_of(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of row p of x and row q of y in double precision, which hang on the two rows alone."""
    return np.einsum("ij,ij->i", x[p], y[q])


def tiles(x: np.ndarray, y: np.ndarray, threshold: float, block: int = TILE_HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, score) of all pairs at or above the threshold, a tile at a time.

    Single precision shows what can reach it, double precision decides.
    """
    low, slack = (x.astype(np.float32), y.astype(np.float32)), _slack(x, y)
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), block):
            near = low[0][i : i + TILE] @ low[1][j : j + block].T >= np.float32(threshold - slack)
            p, q = np.divmod(np.flatnonzero(near), near.shape[1])
            score = scores_of(x, y, p + i, q + j)
            keep = score >= threshold - 1e-12
            if keep.any():
                yield p[keep] + i, q[keep] + j, score[keep]


def paired(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score)], ["a", "b", "score"])


def compare_cells(stream: DataFrame, cells: int, compare: Callable[[Arrays, Arrays], Iterator[pa.RecordBatch]], out: str = PAIRS, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """What ``compare(held, asking)`` gives for each cell of rows (``cell, side, ...``): side 0 is held, side 1 asks.

    Several columns may name a cell (``by``), then ``cells`` is the number of partitions they are dealt to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, held = None, [], None
        for batch in batches:
            side = batch["side"].to_numpy()
            cell = np.stack([batch[name].to_numpy() for name in by])
            starts = np.flatnonzero(np.r_[True, (np.diff(cell) != 0).any(axis=0) | (np.diff(side) != 0)]) if len(side) else []
            for start, end in zip(starts, [*starts[1:], len(side)], strict=True):
                if now is None or (cell[:, start] != now).any():
                    now, pieces, held = cell[:, start], [], None
                part = _arrays(batch.slice(start, end - start))
                if side[start] == 0:
                    pieces.append(part)
                elif pieces:
                    held = held or {name: np.concatenate([p[name] for p in pieces]) for name in part}
                    yield from compare(held, part)

    return stream.repartition(cells, *by).sortWithinPartitions(*by, "side").mapInArrow(run, out)


def _square(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows for the cells of a grid in which each pair of groups is one cell, number of cells)."""
    n = groups_for(rows.count())
    dealt = rows.select("id", "unit", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("group"))
    # a group is held in the cells from its own on and asks in those up to it
    held = dealt.select(F.lit(0).alias("side"), "id", "unit", "group", F.explode(F.sequence(F.col("group"), F.lit(n - 1))).alias("other"))
    asks = dealt.select(F.lit(1).alias("side"), "id", "unit", "group", F.explode(F.sequence(F.lit(0), F.col("group"))).alias("other"))
    cell = F.least("group", "other") * n + F.greatest("group", "other")
    return held.union(asks).select(cell.alias("cell"), "side", "id", "unit", "group"), n * (n + 1) // 2


def _met(held: Arrays, asks: Arrays, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row that asks, row held, score): each pair of a cell once."""
    a, b = asks["id"], held["id"]
    same = asks["group"][0] == held["group"][0]
    for p, q, score in tiles(asks["unit"], held["unit"], threshold):
        keep = a[p] < b[q] if same else a[p] != b[q]
        yield p[keep], q[keep], score[keep]


def all_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, score`` of all pairs of ``rows`` (``id, unit``) at or above the threshold, ``a < b``; exact, each pair compared once."""

    def compare(held: Arrays, asks: Arrays) -> Iterator[pa.RecordBatch]:
        for p, q, score in _met(held, asks, threshold):
            yield paired(asks["id"][p], held["id"][q], score)

    return compare_cells(*_square(rows), compare)


def link_counts(rows: DataFrame, threshold: float) -> DataFrame:
    """``id, hits`` of rows with links: of how many pairs of :func:`all_pairs` each is an end; the pairs themselves don't leave their task."""

    def compare(held: Arrays, asks: Arrays) -> Iterator[pa.RecordBatch]:
        hits = [np.zeros(len(asks["id"]), np.int64), np.zeros(len(held["id"]), np.int64)]
        for ends in _met(held, asks, threshold):
            for count, end in zip(hits, ends[:2], strict=True):
                count += np.bincount(end, minlength=len(count))
        for side, count in zip((asks, held), hits, strict=True):
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(side["id"][some]), pa.array(count[some])], ["id", "hits"])

    found = compare_cells(*_square(rows), compare, "id long, hits long")
    return found.groupBy("id").agg(F.sum("hits").alias("hits"))


# ---------------------------------------------------------------- nearest rows

#: Cells of queries against rows, digits to which scores count as equal, and hits kept for a chunk of queries before the best are taken.
CELLS, DIGITS, KEPT = 144, 9, 2_000_000


def _first(q: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k hits of each query by rounded score and id, in order of queries."""
    order = np.lexsort((other, -np.round(score, DIGITS), q))
    q, other, score = q[order], other[order], score[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q))) < k
    return q[keep], other[keep], score[keep]


def best_of(asks: Arrays, held: Arrays, k: int, least: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, other, score): per query the k best held rows at or above ``least``, itself left out; with ``of``, those that equal it there.

    A tile's products in single precision are held against the query's k-th best so far; only what may
    beat it is computed in double precision, so nothing is sorted but that.
    """
    x, y = asks["unit"], held["unit"]
    low, slack = (x.astype(np.float32), y.astype(np.float32)), _slack(x, y) + 10.0**-DIGITS
    for i in range(0, len(x), TILE):
        ids = asks["id"][i : i + TILE]
        bound = np.full(len(ids), least)
        kept, waiting = [], 0

        def settle(kept: list, bound: np.ndarray) -> list:
            q, other, score = _first(*(np.concatenate(part) for part in zip(*kept, strict=True)), k)
            last = np.flatnonzero(np.bincount(q, minlength=len(bound)) == k)
            ends = np.searchsorted(q, last, side="right") - 1
            bound[last] = np.maximum(bound[last], score[ends])
            return [(q, other, score)]

        for j in range(0, len(y), block):
            scores = low[0][i : i + TILE] @ low[1][j : j + block].T
            if "of" in asks:
                scores[asks["of"][i : i + TILE, None] != held["of"][j : j + block]] = -np.inf
            reach = (bound - slack).astype(np.float32)
            near = scores >= reach[:, None]
            if k + 1 < scores.shape[1] and np.count_nonzero(near) > 4 * (k + 1) * len(ids):
                # the query itself may be among the first k + 1
                nth = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
                near = scores >= np.maximum(reach, nth - np.float32(2 * slack))[:, None]
            near &= scores > -np.inf
            p, q = np.divmod(np.flatnonzero(near), near.shape[1])
            score, other = scores_of(x, y, p + i, q + j), held["id"][q + j]
            good = (score >= np.maximum(bound[p] - 10.0**-DIGITS, least)) & (other != ids[p])
            if good.any():
                kept.append((p[good], other[good], score[good]))
                waiting += int(good.sum())
                if waiting > max(4 * k * len(ids), KEPT) or len(kept) < 4:
                    kept, waiting = settle(kept, bound), 0
        if kept:
            q, other, score = settle(kept, bound)[0]
            yield ids[q], other, score


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, of: str | None = None, block: int = TILE_HELD) -> DataFrame:
    """``id, other, score`` of the k best rows of each query inside each cell of a grid of queries and rows; the k best of all are among them.

    Both are cut so that the cells are few and little is moved: many groups of the larger side, few of the smaller.
    """
    n, m = max(1, rows.count()), max(1, queries.count())
    cut = lambda own, other: max(1, -(-own // GROUP_ROWS), min(-(-own // LEAST_ROWS), round((CELLS * own / other) ** 0.5)))
    by_rows, by_queries = cut(n, m), cut(m, n)
    group = [F.xxhash64(of).alias("of")] if of else []
    dealt = lambda df, parts, all_of: df.select("id", "unit", *group, F.pmod(F.xxhash64("id"), F.lit(parts)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(all_of - 1))).alias("met"))
    columns = ["id", "unit", *(["of"] if of else [])]
    held = dealt(rows, by_rows, by_queries).select((F.col("own") * by_queries + F.col("met")).cast("int").alias("cell"), F.lit(0).alias("side"), *columns)
    asks = dealt(queries, by_queries, by_rows).select((F.col("met") * by_queries + F.col("own")).cast("int").alias("cell"), F.lit(1).alias("side"), *columns)

    def compare(held: Arrays, asks: Arrays) -> Iterator[pa.RecordBatch]:
        for query, other, score in best_of(asks, held, k, least, block):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(other), pa.array(score)], ["id", "other", "score"])

    return compare_cells(held.union(asks), by_rows * by_queries, compare, "id long, other long, score double")
