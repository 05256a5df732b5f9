r"""Names that texts mention, with type, number and first place.

A mention is a run of up to three capitalised words.  Its position says whether it opens a
sentence: a lone word there counts only if a verb follows later in the text.  Leading words
that are capitalised without being names are left off, and are none alone.  A run behind a
word of place is a place.  Each text is read once from its start: runs, openings, verbs and words of
place are marks with positions, so the work grows with the text's length.

Defined results: null and empty texts mention nothing; rows of one id are read apart; edges of words
are those of ASCII words, whatever the runtime.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values.
NO_NAMES = frozenset(
    "Io Tu Lui Lei Noi Voi Loro Il Lo La I Gli Le Un Una Uno E Ma Però Pero Poi Quando Dove Come Cosa Che Se Perché Perche Oggi Ieri Domani".split()
)
VERBS = "ha|è|sta|sono|si|deve|vuole|può|puo|andrà|andra|farà|fara"
OF_PLACE = "a|ad|in|da|verso|presso|vicino a"

_RUN = r"[A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[A-ZÀ-Ý][a-zà-ÿ]+){0,2}"
_RUNS = re.compile(rf"(?a:\b){_RUN}(?a:\b)")
_OPENINGS = re.compile(r"[.!?]\s+(?=[A-ZÀ-Ý])")
_VERB = re.compile(rf"\s(?:{VERBS})(?a:\b)", re.IGNORECASE)
_PLACES = re.compile(rf"(?a:\b)(?:{OF_PLACE})\s+({_RUN})(?a:\b)")


@dataclass
class Mention:
    kind: str
    n: int
    first_at: int


def mentions_of(text: str | None) -> dict[str, Mention]:
    """Names in order of their first place among names, then places known only as such."""
    text, found = text or "", {}
    openings = {0, *(m.end() for m in _OPENINGS.finditer(text))}
    last_verb = max((m.start() for m in _VERB.finditer(text)), default=-1)
    for run in _RUNS.finditer(text):
        words = run[0].split()
        if words[0] in NO_NAMES:
            words = words[1:]
        name = " ".join(words)
        if not words or name in NO_NAMES:
            continue
        if run.start() in openings and len(words) == 1 and last_verb < run.end():
            continue
        known = found.setdefault(name, Mention("probable_proper_noun", 0, run.start()))
        known.n += 1
        if known.n > 1:
            known.kind = "recurring_proper_noun"
    for place in _PLACES.finditer(text):
        name = place[1]
        if name in found:
            found[name].kind = "place"
        elif name.split()[0] not in NO_NAMES:
            found[name] = Mention("place", 1, place.start(1))
    return found


def entity_mentions(rows: DataFrame) -> DataFrame:
    """``id, entity, kind, n, first_at`` of the texts of ``rows`` (``id, text``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(1)):
                for name, m in mentions_of(text.as_py()).items():
                    row.append(i)
                    out.append((name, m.kind, m.n, m.first_at))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            columns = [pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "entity", "kind", "n", "first_at"])

    return rows.select("id", "text").mapInArrow(read, "id long, entity string, kind string, n long, first_at long")
