"""Repair of conversations: the cheapest edits that leave ``(s?(ua)+)?`` as role initials.

``damaged``         rows that a hash of their conversation and turn damages, to measure repairs on.
``signatures``      one row per conversation: its faults, and a signature with a letter per row.
``cheapest_edits``  signature -> cost and edits: signatures, sorted, form a prefix trie; a
                    node's layer of the dynamic program is computed once for all
                    signatures below it, and the answer is read off at a terminal node.
``repaired_turns``  the repaired rows themselves.
``repair_digests``  one row per conversation, with a digest of its repaired rows.

Faults, the first of each row counts: blank (no character but ASCII white space),
duplicate (role and text seen earlier in the conversation), truncated (its last
character that isn't white space is none of ``.!?``).  Edits and costs: keep (K) 0, rerole to user or
assistant (R) 1, delete (D) 2, insert an empty user or assistant turn (I) 5; blank and
duplicate rows must be deleted, truncated ones that stay cost 5 more.  Of equally cheap
edits the ASCII-least are taken; they determine every role.

Rows are taken by turn (nulls first), role and a hash of the text; equal rows are
counted before anything is sorted.  A conversation's letters, edits and texts pass
through a task in order, as SHA-256 chains them; a task holds a byte a row of the
conversation at hand (a signature), a dozen in the trie, and one batch of texts.

Defined results: a null role, text, turn or conv_id counts as one space where it is
hashed or written (a null turn has no part in gaps, null conv_ids form one
conversation); a role that begins with none of s, u and a can't be kept, nor can an
empty one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.worker import small_batches
from quillgrove.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Letter of a row that must go; the others are its role's initial (o: no legal one), a capital where it is truncated.
DOOMED = "x"
BLANK_TEXT, TRUNCATED_TEXT = r"^[\x20\x09-\x0D]*$", r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"
LEGAL = {"su", "ua", "au"}


# ---------------------------------------------------------------- the dynamic program

#: What has been said so far: nothing, a system turn, a user's turn last, an assistant's turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
DONE = {NOTHING, ASSISTANT}


class Layers:
    """Layers of the program: per state the cost above the layer's least, and the rank of its edits in ASCII order.

    Equal layers are held once, so a trie node is a number.  Edits of one layer end with
    that row's own letter: none is a prefix of another, and ranks decide every tie.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.layers: list[tuple] = []
        self.steps: dict[tuple[int, str], tuple] = {}
        self.root = self._number(((0, 0), None, None, None))

    def _number(self, layer: tuple) -> int:
        if layer not in self.known:
            self.known[layer] = len(self.layers)
            self.layers.append(layer)
        return self.known[layer]

    def _after_inserts(self, number: int) -> Iterator[tuple[int, int, int, str, int]]:
        """(state, cost, rank, inserts, state before them)."""
        for before, entry in enumerate(self.layers[number]):
            if entry:
                state, (cost, rank) = before, entry
                for n in range(4):  # more would come back to a state at a higher cost
                    yield state, cost + n * INSERT, rank, "I" * n, before
                    state = NEXT[state]

    def step(self, number: int, letter: str) -> tuple[int, int, tuple]:
        """(next layer, what its costs lie above, per state where it comes from and by which edits)."""
        if (number, letter) in self.steps:
            return self.steps[number, letter]
        best: list[tuple | None] = [None] * 4

        def offer(state: int, cost: int, rank: int, edits: str, before: int) -> None:
            if best[state] is None or (cost, rank, edits) < best[state][:3]:
                best[state] = (cost, rank, edits, before)

        role, stays = letter.lower(), TRUNCATED if letter.isupper() else 0
        for state, cost, rank, inserts, before in self._after_inserts(number):
            offer(state, cost + DELETE, rank, inserts + "D", before)
            if letter == DOOMED:
                continue
            after = NEXT[state]
            offer(after, cost + REROLE + stays, rank, inserts + "R", before)
            if role == ("a" if after == ASSISTANT else "u"):
                offer(after, cost + KEEP + stays, rank, inserts + "K", before)
            if role == "s" and state == NOTHING:
                offer(SYSTEM, cost + KEEP + stays, rank, inserts + "K", before)
        least = min(x[0] for x in best if x)
        order = sorted(x[1:3] for x in best if x)
        layer = tuple((x[0] - least, order.index(x[1:3])) if x else None for x in best)
        made = self.steps[number, letter] = self._number(layer), least, tuple((x[3], x[2]) if x else None for x in best)
        return made

    def answer(self, number: int) -> tuple[int, str, int]:
        """(cost above the layer's least, closing inserts, last state)."""
        cost, _, inserts, before = min((c, r, i, b) for s, c, r, i, b in self._after_inserts(number) if s in DONE)
        return cost, inserts, before


class Path:
    """The trie's path to the signature at hand; sorted signatures are visited in the trie's own order."""

    def __init__(self) -> None:
        self.layers = Layers()
        self.at, self.nodes, self.base, self.computed = "", array("q", [self.layers.root]), array("q", [0]), 0

    def visit(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; layers of the prefix it shares with the last one stay."""
        shared = len(commonprefix([self.at, signature]))
        del self.nodes[shared + 1 :], self.base[shared + 1 :]
        for letter in signature[shared:]:
            number, more, _ = self.layers.step(self.nodes[-1], letter)
            self.nodes.append(number)
            self.base.append(self.base[-1] + more)
            self.computed += 1
        self.at = signature
        cost, inserts, state = self.layers.answer(self.nodes[-1])
        edits = [inserts]
        for i in range(len(signature) - 1, -1, -1):
            state, letters = self.layers.step(self.nodes[i], signature[i])[2][state]
            edits.append(letters)
        return self.base[-1] + cost, "".join(reversed(edits))


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` for each distinct ``signature``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            answers = [path.visit(x) for x in batch.column(0).to_pylist()]
            columns = [batch.column(0).cast(pa.string()), pa.array([x for x, _ in answers], pa.int64()), pa.array([x for _, x in answers], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "cost", "audit"])

    # ranges of the sorted signatures: what shares a prefix meets in one task
    dealt = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(solve, "signature string, cost long, audit string")


# ---------------------------------------------------------------- faults


def _hash_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def plain_rows(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies``: nulls as one space, conversations by their id's text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" "))
    return rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).alias("copies"))


def damaged(plain: DataFrame) -> DataFrame:
    """``plain_rows`` after the damage that crc32 of ``conv_id:turn`` modulo 20 says.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", "conv", turn).cast("binary")), F.lit(20))
    rows = plain.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2 * F.col("copies")).otherwise(F.col("copies"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def with_faults(plain: DataFrame) -> DataFrame:
    """``conv, turn, role, key, n, fault, later``: equal rows once, with their number.

    ``fault`` is the row's own; ``later`` says that an earlier turn has its role and text.
    Of equal rows the first alone may be free of the fault duplicate.
    """
    own = F.when(F.col("text").rlike(BLANK_TEXT), "blank").when(F.col("text").rlike(TRUNCATED_TEXT), "truncated").otherwise("")
    keyed = plain.select("conv", "turn", "role", _hash_of(F.col("text")).alias("key"), "copies", own.alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    counted = keyed.groupBy("conv", "turn", "role", "key").agg(F.sum("copies").alias("n"), F.first("fault").alias("fault"))
    counted = materialize(counted, "repair-counted")
    firsts = counted.groupBy("conv", "role", "key").agg(F.min(place).alias("first"))
    joined = counted.join(firsts, ["conv", "role", "key"])
    return joined.select("conv", "turn", "role", "key", "n", "fault", (place > F.col("first")).alias("later"))


SIGNED = "conv string, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


class _Signing:
    """What a sorted stream gathers of one conversation: counts, and a letter per row."""

    def __init__(self, conv: str) -> None:
        self.conv, self.letters, self.last = conv, bytearray(), ""
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, n: int, fault: str, later: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        self.illegal += n - 1 + (len(self.letters) > 0 and self.last + initial not in LEGAL)
        self.last = initial
        if fault == "blank":
            self.blank += n
            self.letters += DOOMED.encode() * n
            return
        again = n if later else n - 1
        self.duplicate += again
        if not later:
            letter = initial if initial and initial in "sua" else "o"
            self.truncated += fault == "truncated"
            self.letters += (letter.upper() if fault == "truncated" else letter).encode()
        self.letters += DOOMED.encode() * again

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, self.letters.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def signatures(faulty: DataFrame) -> DataFrame:
    """One row per conversation of :func:`with_faults`: its signature and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
        names = ["conv", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            done = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.row())
                    now = _Signing(conv)
                now.add(*row)
            if done:
                yield table(done)
        if now:
            yield table([now.row()])

    ordered = faulty.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "key")
    return ordered.select("conv", "turn", "role", "n", "fault", "later").mapInArrow(run, SIGNED)


# ---------------------------------------------------------------- repaired rows


class Speaker:
    """The roles that edits give, one turn after another."""

    def __init__(self) -> None:
        self.state = NOTHING

    def next_role(self) -> str:
        self.state = NEXT[self.state]
        return "assistant" if self.state == ASSISTANT else "user"

    def keep(self, role: str) -> str:
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        return role


REPAIRED = "conv string, position long, edit string, role string, text string"


def repaired_turns(plain: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv, position, edit, role, text``: the rows that ``audits`` (``conv, audit``) leave or insert.

    A conversation's edits come as the first row of its sorted stream, not as a column of every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, position, speaker, out = None, "", 0, 0, Speaker(), []

        def say(edit: str, role: str, text: str) -> None:
            nonlocal position
            out.append((conv, position, edit, role, text))
            position += 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                say("I", speaker.next_role(), "")
                at += 1

        def table() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 5
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)
            out.clear()
            return made

        names = ["conv", "position", "edit", "role", "text"]
        for batch in batches:
            for now, edits, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies")), strict=True):
                if edits is not None:
                    inserts()
                    conv, audit, at, position, speaker = now, edits, 0, 0, Speaker()
                    continue
                for _ in range(copies):
                    inserts()
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        say(edit, speaker.keep(role) if edit == "K" else speaker.next_role(), text)
            yield table()
        inserts()
        yield table()

    heads = audits.select("conv", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "binary"), ("text", "string"), ("copies", "int"))))
    keyed = plain.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", _hash_of(F.col("text")).alias("key"), "text", "copies")
    stream = heads.union(keyed).repartition("conv")
    ordered = stream.sortWithinPartitions("conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "key")
    return ordered.mapInArrow(run, REPAIRED)


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: of ``role:text`` per turn, joined by newlines, as a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                said = f"{role}:{text}".encode()
                if conv != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(said)
                else:
                    state.update(b"\n" + said)
            yield _digested(done)
        if state:
            yield _digested([(now, state.hexdigest())])

    return turns.repartition("conv").sortWithinPartitions("conv", "position").mapInArrow(run, "conv string, repaired_sha256 string")


def _digested(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["conv", "repaired_sha256"])


def repair(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per conversation its counts, cost and audit; its repaired turns) of :func:`plain_rows`."""
    small_batches(plain.sparkSession)
    plain = materialize(plain, "repair-rows")
    signed = materialize(signatures(with_faults(plain)), "repair-signed")
    solved = materialize(signed.join(cheapest_edits(signed), "signature").drop("signature"), "repair-solved")
    return solved, repaired_turns(plain, solved)


def repair_digests(rows: DataFrame, damage: bool = False) -> DataFrame:
    """One row per conversation of ``rows``: ``conv_id``, faults, cost, audit and the digest of what is left."""
    plain = plain_rows(rows)
    solved, turns = repair(damaged(plain) if damage else plain)
    out = plain.select("conv").distinct().join(solved, "conv", "left").join(turn_digests(turns), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv_id = F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return out.select(conv_id, *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def oracle() -> str:
    """DuckDB SQL for ``repair_digests`` of damaged ``conversations``: the program row by row, without a trie.

    DuckDB lacks crc32, so its table is built from the polynomial.
    """

    def offers(target: int) -> str:
        """All ways into a state, as structs whose order is that of cost, then edits."""
        out = []
        for before in range(4):
            state = before
            for n in range(4):
                cost, edits = f"c[{before + 1}].c + {n * INSERT}", f"c[{before + 1}].e || '{'I' * n}"
                if state == target:
                    out.append(f"{{'c': {cost} + {DELETE}, 'e': {edits}D'}}")
                if NEXT[state] == target:
                    out.append(f"CASE WHEN NOT doomed THEN {{'c': {cost} + {REROLE} + stays, 'e': {edits}R'}} END")
                    initial = "a" if target == ASSISTANT else "u"
                    out.append(f"CASE WHEN NOT doomed AND initial = '{initial}' THEN {{'c': {cost} + stays, 'e': {edits}K'}} END")
                if target == SYSTEM and state == NOTHING:
                    out.append(f"CASE WHEN NOT doomed AND initial = 's' THEN {{'c': {cost} + stays, 'e': {edits}K'}} END")
                state = NEXT[state]
        return "list_sort(list_filter([" + ", ".join(out) + "], lambda x: x.c IS NOT NULL))[1]"

    ends = []
    for before in range(4):
        state = before
        for n in range(4):
            if state in DONE:
                ends.append(f"{{'c': c[{before + 1}].c + {n * INSERT}, 'e': c[{before + 1}].e || '{'I' * n}'}}")
            state = NEXT[state]
    return rf"""
WITH RECURSIVE table_of AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))
), p AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), k AS (
  SELECT p.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS kind FROM p, table_of
), d AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), n AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d
), f AS (
  SELECT *, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM n
), g AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM f GROUP BY conv
), walk AS (
  SELECT conv, 0::BIGINT AS i, [{{'c': 0, 'e': ''}}, NULL, NULL, NULL] AS c FROM g
  UNION ALL
  SELECT conv, i + 1, [{", ".join(offers(t) for t in range(4))}] FROM (
    SELECT w.conv, w.i, w.c, f.initial, f.fault IN ('blank', 'duplicate') AS doomed, CASE WHEN f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS stays
    FROM walk w JOIN f ON f.conv = w.conv AND f.i = w.i + 1)
), solved AS (
  SELECT g.*, list_sort(list_filter([{", ".join(ends)}], lambda x: x.c IS NOT NULL))[1] AS best FROM g JOIN walk w ON w.conv = g.conv AND w.i = g.size
), letters AS (
  SELECT conv, unnest(string_split(best.e, '')) AS edit, generate_subscripts(string_split(best.e, ''), 1) AS spot FROM solved
), placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv ORDER BY spot) AS i FROM letters
), kept AS (
  SELECT l.conv, l.spot, l.edit, CASE WHEN l.edit <> 'I' THEN f.text ELSE '' END AS text, f.role, l.edit = 'K' AND f.initial = 's' AS is_system,
    row_number() OVER (PARTITION BY l.conv ORDER BY l.spot) AS place FROM placed l LEFT JOIN f ON f.conv = l.conv AND f.i = l.i WHERE l.edit <> 'D' AND l.edit <> ''
), spoken AS (
  SELECT *, max(is_system::INT) OVER (PARTITION BY conv) AS after_system FROM kept
), digests AS (
  SELECT conv, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - after_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot)) AS repaired_sha256
  FROM spoken GROUP BY conv
)
SELECT CASE WHEN o.conv <> ' ' THEN o.conv END::BIGINT AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM p) o LEFT JOIN solved USING (conv) LEFT JOIN digests USING (conv)
"""
