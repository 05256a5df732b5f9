"""Token ids of whole documents in Simple-8b blocks.

Layout: a Parquet table, one row per document in ascending doc_id order (files
in order of ``part``).  ``words`` holds 64-bit little-endian words, ``offsets``
the index of the first word of every block of 256 ids, as 32-bit integers.  The
top four bits of a word select how many ids of how many bits the other 60 hold,
lowest first; selector 15 says that the next word is one value as it is, for
values of more than 60 bits.  Blocks start on a word, so blocks of any number
of documents decode side by side.

Defined results: a null text counts as empty and so holds the end id alone;
documents of equal doc_id keep a row each, in order of their text's hash; null
doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm.token_cache import END_ID, encoder
from quillgrove.session import shared_dir

BLOCK = 1 << 8
#: Fixed values of Simple-8b: how many ids of how many bits, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, offsets binary, words binary"
#: Documents encoded or decoded at once hold about this many ids (or are one document).
IDS_AT_ONCE = 1 << 20


_SHORT_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < 1 << 16:
        return _SHORT_BITS[values]
    bits = np.zeros(len(values), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        high = values >> np.uint64(bits.dtype.type(shift)) != 0
        bits += high * shift
        values = np.where(high, values >> np.uint64(shift), values)
    return bits + (values != 0)


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encode documents laid end to end.

    ``values``: their ids; ``sizes``: how many each has.  Returns the words of
    all blocks in order, each block's number of words, and each document's number
    of blocks.
    """
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), blocks
    # lay the ids out by block, zeros behind a document's last id
    within = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat((np.cumsum(blocks) - blocks) * BLOCK, sizes) + within
    length = np.full(total, BLOCK, np.int64)
    length[np.cumsum(blocks)[sizes > 0] - 1] = (sizes - (blocks - 1) * BLOCK)[sizes > 0]
    grid = np.zeros((total, BLOCK + 60), np.uint64)
    grid.reshape(-1)[place + (place >> 8) * 60] = values  # rows are BLOCK + 60 long
    bits = _bit_lengths(grid.reshape(-1)).reshape(grid.shape).astype(np.uint8)

    # widest[s] at i: the bits that the COUNTS[s] values from i on need
    choice = np.full((total, BLOCK), ESCAPE, np.uint8)
    reach, most = 1, bits
    for s in range(len(COUNTS) - 1, -1, -1):
        while reach < COUNTS[s]:
            step = int(min(reach, COUNTS[s] - reach))
            grown = most.copy()
            grown[:, :-step] = np.maximum(most[:, :-step], most[:, step:])
            reach, most = reach + step, grown
        np.copyto(choice, np.uint8(s), where=most[:, :BLOCK] <= np.uint8(WIDTHS[s]))

    # all blocks step from word to word together: where each word starts, then what it holds
    position, active = np.zeros(total, np.int64), np.arange(total)
    ids_of = np.append(COUNTS, [1, 1])
    starts: list[np.ndarray] = []
    flat_choice, width = choice.reshape(-1), grid.shape[1]
    while len(active):
        at = active * BLOCK + position[active]
        starts.append(at)
        position[active] += ids_of[flat_choice[at]]
        active = active[position[active] < length[active]]
    start = np.sort(np.concatenate(starts))
    selector = flat_choice[start].astype(np.int64)
    block = start // BLOCK
    cell = block * width + start % BLOCK
    values, word = grid.reshape(-1), selector.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        mine = np.nonzero(selector == s)[0]
        one, where = word[mine], cell[mine]
        for k in range(COUNTS[s]):
            one |= values[where + k] << np.uint64(k * WIDTHS[s])
        word[mine] = one
    escaped = np.nonzero(selector == ESCAPE)[0]
    if len(escaped):
        word = np.insert(word, escaped + 1, values[cell[escaped]])
        block = np.insert(block, escaped + 1, block[escaped])
    return word, np.bincount(block, minlength=total), blocks


def unpack(words: np.ndarray, block_words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of blocks laid end to end: ``block_words`` words and ``lengths`` values each."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is a value, whatever its top bits say
    raw = np.zeros(len(words), bool)
    for i in np.nonzero(selector == ESCAPE)[0]:
        if not raw[i]:
            raw[i + 1] = True
    counts = np.append(COUNTS, [0, 0])[selector]
    counts[raw] = 1
    block = np.repeat(np.arange(len(block_words)), block_words)
    first = np.cumsum(counts) - counts
    block_first = first[np.minimum(np.cumsum(block_words) - block_words, max(0, len(words) - 1))] if len(words) else first
    begins = np.cumsum(lengths) - lengths
    start = begins[block] + first - block_first[block]
    stop = (begins + lengths)[block]
    out = np.zeros(int(lengths.sum()), np.uint64)
    out[start[raw]] = words[raw]
    whole = start + counts <= stop  # only a block's last word may hold fewer ids than it has room for
    for s in range(len(COUNTS)):
        mine = np.nonzero((selector == s) & ~raw & whole)[0]
        ends = np.nonzero((selector == s) & ~raw & ~whole)[0]
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        at, word = start[mine], words[mine]
        for k in range(COUNTS[s]):
            out[at + k] = word & mask
            word >>= np.uint64(WIDTHS[s])
            fits = ends[start[ends] + k < stop[ends]] if len(ends) else ends
            out[start[fits] + k] = words[fits] >> np.uint64(k * WIDTHS[s]) & mask
    return out


def groups_by_size(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of items whose sizes add up to about ``most``."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode the whole text of every document and write the table at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for run_of in groups_by_size(np.array([len(x or "") + BLOCK for x in texts.to_pylist()]), IDS_AT_ONCE):
                flat, sizes = encode.encode_all(texts[run_of.start : run_of.stop].to_pylist())
                flat, sizes = with_end(flat, sizes)
                words, block_words, blocks = pack(flat, sizes)
                # word offsets of a document's blocks count from its own first word
                base = np.cumsum(block_words) - block_words
                ends = np.cumsum(blocks)
                doc_first = base[ends - blocks]
                offsets = (base - np.repeat(doc_first, blocks)).astype("<i4")
                edges = np.append(doc_first, len(words))
                begins = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), part, np.int32)),
                        ids[run_of.start : run_of.stop],
                        pa.array(begins),
                        pa.array(sizes),
                        pa.array([offsets[e - b : e].tobytes() for b, e in zip(blocks, ends, strict=True)], pa.binary()),
                        pa.array([words[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    ],
                    ["part", "doc_id", "local_start", "n_tokens", "offsets", "words"],
                )

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows without id, or of one id, are many: their texts' hashes deal them out
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def with_end(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with the end id behind them."""
    return np.insert(flat, np.cumsum(sizes), END_ID), sizes + 1


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the ids decoded, ``start`` counting over all documents before."""
    table = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for run_of in groups_by_size(sizes + BLOCK, IDS_AT_ONCE):
                part = batch.slice(run_of.start, run_of.stop - run_of.start)
                ids = decode_rows(part.column(4).to_pylist(), part.column(5).to_pylist(), sizes[run_of])
                ends = np.concatenate([[0], np.cumsum(sizes[run_of])])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])

    decoded = table.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids array<long>")
    return with_start(decoded, table)


def with_start(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``start`` from ``part`` and ``local_start``: a running sum over the parts, one row each."""
    totals = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]) if totals else [0]
    bases = [(part, int(b)) for (part, _), b in zip(totals, before, strict=False)]
    bases = rows.sparkSession.createDataFrame(bases, "part int, base long")
    joined = rows.join(F.broadcast(bases), "part")
    return joined.withColumn("start", F.col("base") + F.col("local_start")).drop("part", "base", "local_start")


def decode_rows(offsets: list[bytes], words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of documents, end to end, from their rows' binary columns."""
    flat = np.frombuffer(b"".join(words), "<u8")
    first = np.frombuffer(b"".join(offsets), "<i4").astype(np.int64)
    n_words = np.array([len(w) // 8 for w in words], np.int64)
    blocks = np.array([len(o) // 4 for o in offsets], np.int64)
    absolute = first + np.repeat(np.cumsum(n_words) - n_words, blocks)
    block_words = np.diff(np.append(absolute, len(flat)))
    lengths = np.full(int(blocks.sum()), BLOCK, np.int64)
    lengths[np.cumsum(blocks) - 1] = sizes - (blocks - 1) * BLOCK
    return unpack(flat, block_words, lengths)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the table at ``path``."""
    table = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            crc = np.zeros(len(sizes), np.int64)
            for run_of in groups_by_size(sizes + BLOCK, IDS_AT_ONCE):
                part = batch.slice(run_of.start, run_of.stop - run_of.start)
                ids = decode_rows(part.column(4).to_pylist(), part.column(5).to_pylist(), sizes[run_of]).astype("<u4")
                ends = np.cumsum(sizes[run_of])
                crc[run_of] = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(sizes[run_of], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc)], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    decoded = table.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return with_start(decoded, table).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_path(spark: SparkSession, label: str) -> str:
    """A fresh place for a token table in the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/quillgrove/{label}-{uuid.uuid4().hex}"
