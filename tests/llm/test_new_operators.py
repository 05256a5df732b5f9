"""Conversation repair, token alignment and HyperMinHash against brute force and edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrove.llm import conversation_repair, hyper_minhash, token_alignment
from quillgrove.llm.queries import PIECE_MODEL, TOKENIZER
from quillgrove.llm.similar_texts import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    long = " ".join(f"w{i % 500} and.\n" if i % 7 == 0 else f"v{i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "some words here", None, "s", 15), (3, "   \n \t ", "en", "s", 7), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long))]
    rows += [(5, "one", "en", "s", 3), (6, "one", "en", "s", 3), (-9, "ünï ☃ \U0001f600 x", "en", "s", 9), (None, None, None, None, None)]
    clash = ("key", "n_a", "n_links", "pairs", "times", "row", "count", "pair", "bands", "registers", "bucket", "class", "weight", "component", "kept", "n_shingles", "wanted")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in clash})


# ---------------------------------------------------------------- conversation repair


def cheapest_plainly(letters):
    """Least cost first, then ASCII order: all edits, on (role initial, truncated, doomed) rows."""
    heap, best = [(0, "", 0, "")], None
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(letters) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, edits, roles), (cost, edits, roles))
            continue
        ways = [(cost + 5, edits + "I", i, roles + x) for x in "ua"]
        if i < len(letters):
            role, truncated, doomed = letters[i]
            ways.append((cost + 2, edits + "D", i + 1, roles))
            if not doomed:
                ways += [(cost + 1 + 5 * truncated, edits + "R", i + 1, roles + x) for x in "ua"]
                ways += [(cost + 5 * truncated, edits + "K", i + 1, roles + role)] if role else []
        for way in ways:
            if way[0] <= 2 * len(letters) and re.fullmatch("(s?(ua)*u?)?", way[3]):
                heapq.heappush(heap, way)
    return best


def repaired_plainly(rows, damage):
    """What ``repair_digests`` says, row by row in plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = (" " if x is None else x for x in (role, text))
        kept = convs[conv]
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        if kind:
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, said in convs.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in said:
            solid = re.sub(r"[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [(r[:1], f == "truncated", f in ("blank", "duplicate")) for (_, r, _), f in zip(said, faults, strict=True)]
        cost, audit, roles = cheapest_plainly(letters)
        source, done, at = iter(said), [], 0
        for edit in audit:
            row = None if edit == "I" else next(source)
            if edit != "D":
                role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[roles[at]]
                done.append(f"{role}:{row[2] if row else ''}")
                at += 1
        turns = [t for t, *_ in said if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        digest = hashlib.sha256("\n".join(done).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def random_turns(seed, convs, width):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(0, width)):
            text = rng.choice(["Yes.", "No!", "half a", "", " \t\n", "so. \n", "cut off ", None, "Yes.", f"t{turn}?", f"u{turn}"])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("damage", [False, True])
def test_op11_equals_plain_search(spark, damage):
    rows = random_turns(7, 150, 7)
    frame = spark.createDataFrame(rows + rows[:20], TURNS).withColumns({c: F.lit("clash") for c in ("key", "conv", "n", "audit", "signature", "position", "kind", "copies")})
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_digests(frame.repartition(5), damage).collect()}
    assert got == repaired_plainly(rows + rows[:20], damage)


def test_op11_layers_are_computed_once_for_a_prefix():
    rng = random.Random(2)
    signatures = sorted("".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 6))) for _ in range(300))
    path = conversation_repair.Path()
    for s in signatures:
        letters = [("" if x in "oOx" else x.lower(), x.isupper(), x == "x") for x in s]
        assert path.visit(s) == cheapest_plainly(letters)[:2]
    assert path.computed == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})


def test_op11_long_conversation_and_empty_table(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(30_000)]
    (r,) = conversation_repair.repair_digests(spark.createDataFrame(rows, TURNS)).collect()
    said = "\n".join(f"{role}:{text}" for _, _, role, text in rows)
    assert (r.cost, r.audit, r.repaired_sha256) == (0, "K" * 30_000, hashlib.sha256(said.encode()).hexdigest())
    # one row a thousand times over is counted, not gathered
    (r,) = conversation_repair.repair_digests(spark.createDataFrame([(1, 0, "user", "Hi.")] * 1000, TURNS)).collect()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (999, 999, 2000, "D" * 1000)
    assert conversation_repair.repair_digests(spark.createDataFrame([], TURNS), True).count() == 0


def test_op11_turns_are_rows(spark):
    plain = conversation_repair.plain_rows(spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "user", "cut"), (1, 3, "assistant", "B.")], TURNS))
    solved, turns = conversation_repair.repair(plain)
    assert [(r.cost, r.audit) for r in solved.collect()] == [(2, "KKDK")]
    assert [(r.role, r.text, r.edit) for r in turns.orderBy("position").collect()] == [("system", "S.", "K"), ("user", "A.", "K"), ("assistant", "B.", "K")]


# ---------------------------------------------------------------- token alignment


class Plain:
    """Both tokenizers as they are, a text at a time."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE]
        self.letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def spans(self, text):
        encoded = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens, strict=True)]
        names = [(i, self.b.id_to_piece(i)) for i in self.b.encode(text)]
        b = [(i, bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode()) for i, n in names]
        out = []
        for side in (a, b):
            if b"".join(x for _, x in side) != (" " + text).encode():
                return None
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def rows(self, texts):
        """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 by comparing all tokens with all."""
        each, total = [], Counter()
        for text in texts:
            spans = self.spans(text) if text else None
            links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if max(s, t) < min(e, f)] if spans else []
            total.update(links)
            each.append((spans, links))
        best = Counter()
        for (_, j), n in total.items():
            best[j] = max(best[j], n)
        out = []
        for spans, links in each:
            if not spans:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
            written = [[",".join(str(i) for i, _, e in side if low < e <= high) for side in spans] for low, high in zip([0, *cuts], cuts, strict=False)]
            digest = hashlib.sha256(";".join("|".join(g) for g in written).encode()).hexdigest()
            out.append((len(spans[0]), len(spans[1]), len(cuts), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), digest))
        return out


def odd_texts(n):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", " word", " <|endoftext|>", "</s>", "<s>", "é", "é", "☃", "\U0001f600", "'s", "12", "▁", " ", "　", "\x00", "\x7f", ".", "-", "ﬁ", " ", "\r", "don't", "日本"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [0, token_alignment.BROADCAST_PAIRS])
def test_op12_equals_plain_alignment(spark, small, broadcast):
    given = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 1200").limit(40).collect()]
    texts = [*odd_texts(400), *given, None, "", " ", "   ", "one", "one"]
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.link_scores(docs(spark, texts).repartition(7), TOKENIZER, PIECE_MODEL, broadcast).collect()}
    want = Plain().rows(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) < len(texts) - 100


def test_op12_memo_starts_afresh(monkeypatch):
    texts = odd_texts(300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = token_alignment.Encoders(path, PIECE_MODEL)
    monkeypatch.setattr(token_alignment, "CACHE_PIECES", 50)
    parts = token_alignment.Encoders(path, PIECE_MODEL)
    expected = [x for x in map(token_alignment.written_groups, [token_alignment.align_batch(texts, whole)], [whole])][0]
    pieces = [w for at in range(0, 300, 20) for w in token_alignment.written_groups(token_alignment.align_batch(texts[at : at + 20], parts), parts)]
    assert pieces == expected


def test_op12_groups_and_odd_rows(spark):
    rows = token_alignment.group_rows(docs(spark, ["hello world", None, "▁"]), TOKENIZER, PIECE_MODEL).orderBy("doc_id", "number").collect()
    assert [(r.doc_id, r.start, r.stop) for r in rows] == [(0, 0, 6), (0, 6, 12)] and all(r.a_ids and r.b_ids for r in rows)
    out = token_alignment.link_scores(odd_docs(spark), TOKENIZER, PIECE_MODEL).collect()
    assert len(out) == 10 and len({tuple(r) for r in out if r.doc_id == 4}) == 1 and sum(r.n_a == 0 for r in out) == 3
    assert token_alignment.link_scores(spark.createDataFrame([], DOCS), TOKENIZER, PIECE_MODEL).count() == 0


# ---------------------------------------------------------------- HyperMinHash


def plain_classes(texts, similarity_percent=85):
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= similarity_percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return sets, label


def edited(rng, words, n):
    copy = list(words)
    for _ in range(n):
        copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
    return " ".join(copy)


def test_op13_registers_hold_zeros_and_mantissa():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64))
    hashes = np.unique(np.concatenate([hashes, np.array([0, 1, 5, 1 << 56, (1 << 56) + 3, (7 << 56) - 1], np.uint64)]))
    own = hyper_minhash.registers(hashes)
    for bucket in range(hyper_minhash.BUCKETS):
        least = min(int(h) & (1 << 56) - 1 for h in hashes if int(h) >> 56 == bucket)
        zeros = min(52, 56 - least.bit_length())
        assert own[bucket] == (zeros + 1) << 10 | (least << zeros + 1 & (1 << 56) - 1) >> 46


@pytest.mark.parametrize(("n", "similarity"), [(40, 0.85), (400, 0.85), (5000, 0.85), (5000, 0.0), (100_000, 0.5)])
def test_op13_estimates_are_near_the_truth(n, similarity):
    rng, found = np.random.default_rng(n), []
    shared = int(2 * n * similarity / (1 + similarity))
    for _ in range(20):
        all_of = rng.integers(0, 2**64, 2 * n - shared, np.uint64)
        x, y = np.unique(all_of[:n]), np.unique(all_of[n - shared :])
        found.append(hyper_minhash.estimated(hyper_minhash.registers(x)[None], hyper_minhash.registers(y)[None], np.array([n]), np.array([n]))[0][0])
    assert abs(np.mean(found) - shared / (2 * n - shared)) < 0.03


def test_op13_equals_brute_force(spark):
    rng, texts = random.Random(4), []
    for _ in range(40):
        words = [f"W{rng.randint(0, 3000)}" for _ in range(rng.choice([1, 3, 5, 12, 60, 300]))]
        texts += [" ".join(words), " ".join(words).upper(), "\t".join(words)]
        texts += [edited(rng, words, rng.choice([1, 1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 5]))]
    chain = [f"c{i}" for i in range(150)]
    for i in range(12):  # neighbours are similar, ends aren't
        chain[10 * i] = f"d{i}"
        texts.append(" ".join(chain))
    hot = [f"h{i}" for i in range(200)]
    texts += [edited(rng, hot, rng.choice([0, 1, 2, 3, 4, 6])) for _ in range(150)] + [None, "", " \n "]
    sets, label = plain_classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyper_minhash.near_duplicates(docs(spark, texts).repartition(5)).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))}


def test_op13_odd_rows(spark):
    out = [tuple(r) for r in hyper_minhash.near_duplicates(odd_docs(spark)).collect()]
    assert len(out) == 10 and {(d, c) for d, _, c, _ in out if d in (5, 6)} == {(5, 5), (6, 5)}
    assert [x for x in out if x[0] == 4] == [(4, out[[x[0] for x in out].index(4)][1], 4, True)] * 2
    assert all(n == 0 and c == d for d, n, c, _ in out if d in (1, 2, 3)) and not any(k for d, *_, k in out if d is None)
    assert hyper_minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
