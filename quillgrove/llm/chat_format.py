r"""Chat formatting: records of any known layout become canonical turns, then marked text.

``layout_paths``   the nested field paths of a record, array positions left out.
``fingerprint``    their hash; it selects the ``Mapping`` that was declared for them.
``canonical_turns``  one row per turn from JSON records of mixed layouts.
``format_turns``   one segment per turn, in order; a conversation is its segments,
                   one after another.
``read_turns``     role and text of each turn, read back from the segments.
``digest_conversations``  digests per conversation of what reading back gives.

Template: ``<turn role="...">text</turn>`` and a line feed.  In roles and texts a
backslash becomes ``\\``, ``<`` becomes ``\l``, ``>`` becomes ``\g`` and ``"``
becomes ``\q``, so no control string can occur inside a text, and reading back
gives every text as it was.

Defined results: null roles and texts count as empty; turns of equal position
keep the order of role, then text; null positions come first; a null conv_id is
a conversation of its own; records whose layout isn't declared are returned by
``unmapped``, never dropped silently; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = '<turn role="', '">', "</turn>\n"
ESCAPES = [("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ('"', "\\q")]
LEARNED_ROLE = "assistant"


def layout_paths(value: Any, prefix: str = "") -> set[str]:
    """Paths such as ``messages[].role`` of every leaf of a JSON value; empty containers are leaves."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in layout_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in layout_paths(v, prefix + "[]")}
    return {prefix}


def fingerprint(paths: set[str]) -> int:
    """A signed 64-bit hash of the sorted paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42) - (1 << 63)


@dataclass(frozen=True)
class Mapping:
    """What turns a layout holds.

    ``turns``: in order, (role, path of the text), or for a list of messages
    (path of the role, path of the text) below ``each``.  ``skip_empty`` leaves out
    turns whose text is absent or empty, for optional fields such as an
    instruction's input.  A record may lack the ``optional`` paths, and have
    ``ignored`` ones that hold no turn.  ``roles`` renames the layout's own roles.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    skip_empty: bool = False
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        if self.each:
            return {f"{self.each}[].{p}" for turn in self.turns for p in turn}
        return {p for _, p in self.turns}

    def prints(self) -> set[int]:
        """The fingerprints of all layouts that the mapping reads: every choice of the paths that may be absent or added."""
        free = [*self.optional, *self.ignored]
        found = {fingerprint({self.each})} if self.each else set()  # no messages
        for choice in range(1 << len(free)):
            picked = {p for i, p in enumerate(free) if choice >> i & 1}
            found.add(fingerprint(self.paths() - set(self.optional) | picked))
        return found


#: Names of roles in the vocabularies of chat layouts.
ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
_EXTRA = ("messages[].name", "messages[].weight", "id", "source")

MAPPINGS = [
    Mapping("turn", (("role", "text"),), each="turns"),
    Mapping("messages", (("role", "content"),), each="messages", ignored=_EXTRA, roles=ROLES),
    Mapping("conversations", (("from", "value"),), each="conversations", ignored=("conversations[].weight", "id", "source"), roles=ROLES),
    Mapping("prompt", (("user", "prompt"), ("assistant", "completion")), ignored=("id", "source")),
    Mapping("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), skip_empty=True, optional=("system",), ignored=("id", "source")),
    Mapping("instruction", (("user", "instruction"), ("user", "input"), ("assistant", "output")), skip_empty=True, optional=("input",), ignored=("id", "source")),
    Mapping("question", (("user", "data.question"), ("assistant", "data.answer")), ignored=("id", "source")),
]


def _at(value: Any, path: str) -> Any:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def extract(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """The (role, text) pairs that a mapping finds in a record."""
    if mapping.each:
        items = _at(record, mapping.each) or []
        found = [(_text(_at(x, role)), _text(_at(x, text))) for x in items for role, text in mapping.turns]
        names = dict(mapping.roles)
        return [(names.get(role, role), text) for role, text in found]
    found = [(role, _text(_at(record, path))) for role, path in mapping.turns]
    return [x for x in found if x[1] or not mapping.skip_empty]


def _read(records: DataFrame, mappings: list[Mapping], known: bool, strict: bool = False) -> DataFrame:
    by_print = {p: m for m in reversed(mappings) for p in m.prints()}  # the first mapping of a layout counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, position, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = raw
                mapping = by_print.get(fingerprint(layout_paths(record)))
                if mapping and known:
                    rows += [(conv, position, i, *turn) for i, turn in enumerate(extract(record, mapping))]
                elif strict and not mapping:
                    raise ValueError(f"no mapping for the record of {conv} at {position}: {sorted(layout_paths(record))}")
                elif not mapping and not known:
                    rows.append((conv, position, 0, ",".join(sorted(layout_paths(record))), raw))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("conv_id", "position", "part", "role", "text"), r, strict=True)) for r in rows],
                pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
            )

    source = records.select(F.col("conv_id").cast("long"), F.col("position").cast("long"), F.col("record").cast("string"))
    return source.mapInArrow(run, "conv_id long, position long, part long, role string, text string")


def canonical_turns(records: DataFrame, mappings: list[Mapping] = MAPPINGS, strict: bool = False) -> DataFrame:
    """``conv_id, position, part, role, text`` from rows ``conv_id, position, record`` (JSON).

    ``strict``: a record of an undeclared layout fails the job; else :func:`unmapped` has it.
    """
    return _read(records, mappings, known=True, strict=strict)


def unmapped(records: DataFrame, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Records of undeclared layouts: ``conv_id, position, paths, record``."""
    rows = _read(records, mappings, known=False)
    return rows.select("conv_id", "position", F.col("role").alias("paths"), F.col("text").alias("record"))


def turn_records(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as JSON records of one turn each.

    Records come in three layouts, by the conversation's id: turns, messages, and
    from/value pairs with their own names for roles.  Roles that such a layout would
    rename, and rows without id, come as turns.
    """
    role, text = F.col("role").cast("string"), F.col("text").cast("string")

    def one(each: str, *fields: Column) -> Column:
        return F.to_json(F.struct(F.array(F.struct(*fields)).alias(each)), {"ignoreNullFields": "false"})

    kind = F.when(role.isin("system", "user", "assistant"), F.pmod(F.col("conv_id").cast("long"), F.lit(3)))
    name = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    record = F.when(kind == 1, one("messages", role.alias("role"), text.alias("content")))
    record = record.when(kind == 2, one("conversations", name.alias("from"), text.alias("value")))
    return rows.select("conv_id", F.col("turn").alias("position"), record.otherwise(one("turns", role.alias("role"), text.alias("text"))).alias("record"))


def escape(text: str) -> str:
    for plain, marked in ESCAPES:
        text = text.replace(plain, marked)
    return text


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    for plain, marked in ESCAPES[1:]:
        parts = [p.replace(marked, plain) for p in parts]
    return "\\".join(parts)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn's marked text and where the loss mask lies in it (empty unless learned)."""
    head, body = f"{OPEN}{escape(role)}{ROLE_END}", escape(text)
    learned = role == LEARNED_ROLE
    return head + body + CLOSE, len(head), len(head) + (len(body) if learned else 0)


def parse_segment(marked: str) -> tuple[str, str]:
    """Role and text back from a segment."""
    if not marked.startswith(OPEN) or not marked.endswith(CLOSE):
        raise ValueError("not a turn")
    role, _, text = marked[len(OPEN) : -len(CLOSE)].partition(ROLE_END)
    return unescape(role), unescape(text)


SEGMENTS = "conv_id long, position long, part long, segment string, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """One marked segment per turn, with the loss mask's span in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [segment(r or "", t or "") for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            text, start, end = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(text, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["conv_id", "position", "part", "segment", "loss_start", "loss_end"],
            )

    return turns.select("conv_id", "position", "part", "role", "text").mapInArrow(run, SEGMENTS)


def read_turns(segments: DataFrame) -> DataFrame:
    """``conv_id, position, part, role, text, learned`` read back from segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parse_segment(x) for x in batch.column(3).to_pylist()]
            learned = [e > s for s, e in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r for r, _ in read], pa.string()), pa.array([t for _, t in read], pa.string()), pa.array(learned, pa.bool_())],
                ["conv_id", "position", "part", "role", "text", "learned"],
            )

    return segments.mapInArrow(run, "conv_id long, position long, part long, role string, text string, learned boolean")


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Per conversation, what reading its segments back gives.

    A sorted stream per task: hashes are updated turn by turn, so a conversation of
    any length needs the memory of one turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        none = object()
        conv, state = none, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def row():
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            for c, marked, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_segment(marked)
                learned = unescape(marked[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(marked)
            if done:
                yield table(done)
        if conv is not none:
            yield table([row()])

    order = ["conv_id", "position", "part", "segment"]
    sorted_rows = segments.repartition(F.col("conv_id")).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _escaped_sql(column: str) -> str:
    for plain, marked in ESCAPES:
        column = f"replace({column}, '{plain}', '{marked}')"
    return column


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned, {_escaped_sql("role")} AS er, {_escaped_sql("text")} AS et FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum({len(OPEN) + len(ROLE_END) + len(CLOSE)} + length(er) + length(et))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
