"""Chunks of whole documents that end where the text pauses.

Each chunk's end hangs on the text before it, so a document is walked from its start in one task; positions are looked up in
the text itself, so the walk is linear in its length, and chunks leave in batches of bounded size.  Spark's
strings have no index by character, which would make the same walk in built-in functions quadratic.

Lengths are code points.  Null, empty and blank texts have no chunks; chunks that are blank are left out, and ids may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of chunks that leave in one batch.
BATCH = 4_000_000


@dataclass(frozen=True)
class Cut:
    """How long a chunk is and where it may end.

    Without ``in_order`` it ends after the first character of the last of the ``marks`` in its window, if that is beyond ``least`` of its
    size, and the next one begins ``overlap`` before its end.  With it, before the last of the first mark that is far enough,
    a later mark only where no earlier one is, and the next one begins at the next character that isn't white space.  Texts up to
    ``whole`` aren't cut; ``clean`` texts have their white space tidied first.
    """

    size: int
    overlap: int
    marks: tuple[str, ...]
    least: float
    in_order: bool = False
    whole: int = 0
    clean: bool = True


# fixed values: the three ways that documents are cut
SENTENCES = Cut(500, 50, (".", " ", "\n"), 0.7, clean=False)
TECHNICAL = Cut(700, 180, ("\n\n", ". ", ": ", "; ", "\n", " "), 0.55)
PARAGRAPHS = Cut(7500, 0, ("\n\n", "\n", ". ", " "), 0.55, in_order=True, whole=8000)


def tidy(text: str) -> str:
    """Line ends as newlines, one space for blanks in a row, two newlines at most, nothing blank at the ends."""
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _end(text: str, at: int, cut: Cut) -> int:
    stop = at + cut.size
    if cut.in_order:
        far = (i for mark in cut.marks if (i := text.rfind(mark, at, stop + len(mark))) - at >= int(cut.size * cut.least))
        return next(far, stop)
    last = max(text.rfind(mark, at, stop) for mark in cut.marks)
    return last + 1 if last - at > cut.size * cut.least else stop


def chunks_of(text: str | None, cut: Cut) -> Iterator[str]:
    """The chunks of a text, in order."""
    text = tidy(text or "") if cut.clean else text or ""
    at, blank = 0, re.compile(r"\s*")
    while len(text) - at > (cut.size if at or len(text) > cut.whole else cut.whole):
        end = _end(text, at, cut)
        if chunk := text[at:end].strip():
            yield chunk
        at = blank.match(text, end).end() if cut.in_order else max(end - cut.overlap, at + 1)
    if chunk := text[at:].strip():
        yield chunk


def break_chunks(docs: DataFrame, cut: Cut) -> DataFrame:
    """``id, chunk, text`` of documents (``id, text``), chunks of a document numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                for k, chunk in enumerate(chunks_of(text.as_py(), cut)):
                    out.append((row.as_py(), k, chunk))
                    held += len(chunk)
                    if held > BATCH:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, chunk int, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], ["id", "chunk", "text"])
