"""The operators for language-model data against brute force, round trips and edge cases."""

import hashlib
import html
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillgrove.llm import (
    chat_format,
    decontamination,
    html_template,
    line_dedup,
    packing,
    quality_ledger,
    similar_texts,
    simhash_vptree,
    token_cache,
    token_io,
    toxicity,
    url_trust,
)
from quillgrove.llm.queries import QUERIES, SQL, TOKENIZER
from tests.oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 500} and.\n" if i % 7 == 0 else f"v{i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "some words here", None, "s", 15), (3, "   \n \t ", "en", "s", 7), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long))]
    rows += [(5, "one", "en", "s", 3), (6, "one", "en", "s", 3), (-9, "ünï ☃ \U0001f600 x", "en", "s", 9)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("fp", "score", "part", "hash", "rank", "id", "number", "host", "key", "_id")})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- queries with SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), SQL[name])


# ---------------------------------------------------------------- 1


def test_op1_equals_a_plain_reading_of_the_pages(spark, small):
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op1_html_template"](spark, small).collect()}
    pages = connect(small).execute("SELECT page_id, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, page in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert got[page_id] == (text, len(text))


def test_op1_slots_of_a_page_without_article(spark):
    page = '<html><body class="has-sidebar"><div class="top-menu">Menu</div><div>Welcome to us</div><div class="body"><p>Text &amp; {0}</p><p>more   <b>of</b> it {0}</p></div><div id="comments"><p>nice {0}</p></div><form>Mail</form><aside>x</aside></body></html>'
    rows = spark.createDataFrame([(i, f"http://a.b/{i}", page.format(i)) for i in range(8)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_template.extract_text(rows).collect()}
    assert out[3] == "Text & 3\nmore of it 3"  # the greeting is the template's own text
    templates = html_template.host_templates(url_trust.split_url(rows)).collect()
    assert len(templates) == 1 and any("/div" in c.tokens for c in templates[0].classes)


WORDS = "lorem ipsum dolor sit amet tempor labore magna aliqua veniam quis nostrud".split()


def test_op1_template_tells_menu_from_text_without_names(spark):
    """Elements and classes that say nothing: menus, notices and footers, of fixed and of varying text, are told by the slots."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows, want = [], {}
    for i in range(12):
        title, paragraphs = f"T{i} {say(5)}", [f"P{i}{k} {say(60)}" for k in range(rng.randint(1, 4))]
        menu = "".join(f'<li><a href="/{say(1)}">{say(2)}</a></li>' for _ in range(rng.randint(2, 6)))
        page = (
            f'<html><body><div class="u1"><ul>{menu}</ul></div><div class="u2">{say(4)} {i}</div><div class="u3"><h1>{title}</h1>'
            f'<div class="u4">We use small files</div><div class="u5">{"".join(f"<p>{x}</p>" for x in paragraphs)}</div>'
            f'<div class="u6"><a href="/x">{say(3)}</a> <a href="/y">{say(3)}</a></div></div><div class="u7">All rights {2000 + i % 3}</div></body></html>'
        )
        rows.append((i, f"http://plain.org/{i}", page))
        want[i] = "\n".join([title, *paragraphs])
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r.page_id: (r.text, r.by_template) for r in html_template.extract_text(table).collect()}
    assert out == {i: (t, True) for i, t in want.items()}
    alone = {r.page_id: (r.text, r.by_template) for r in html_template.extract_text(table.limit(1)).collect()}
    assert alone[0][0] != want[0] and not alone[0][1]  # one page of a host has no template


def test_op1_slots_overrule_names(spark):
    """A wrapper whose class sounds like noise holds the text; a named article wins over a long list of comments' peers."""
    body = " ".join(WORDS * 3)
    pages = [(i, f"http://w.org/{i}", f'<body><div class="header-content"><p>{i} {body}</p></div><div class="foot">{i}</div></body>') for i in range(6)]
    pages += [(10 + i, f"http://v.org/{i}", f'<body><article><p>{i} {body}</p></article><div class="z"><p>{i} {body} {body}</p></div></body>') for i in range(6)]
    out = {r.page_id: r.text for r in html_template.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"{i} {body}" and out[10 + i] == f"{i} {body}" for i in range(6))


def test_op1_classes_share_vectors_and_joined_path_is_the_same(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/pages.parquet")
    a = sorted(map(tuple, html_template.extract_text(rows).collect()))
    monkeypatch.setattr(html_template, "MAX_SENT_TOKENS", -1)
    assert a == sorted(map(tuple, html_template.extract_text(rows).collect()))


def test_op1_odd_pages(spark):
    odd = [(1, None, None), (2, "x", ""), (None, "http://h/p", "a < b <p>c<br>d<script>var x='</p>'"), (3, "http://h/p", "<!-- <p>no</p>"), (4, "http://h", "<nav>n</nav>t&eacute;&#x41;&nbsp;z" + "<p>y" * 20000)]
    out = {r.page_id: r.text for r in html_template.extract_text(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()}
    assert out[1] == out[2] == out[3] == "" and out[None] == "a < b\nc\nd" and out[4].startswith("téA z\ny\ny")
    assert html_template.extract_text(empty(spark, "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 2


def link(*hosts):
    return "".join(f'<a class="x" href="https://{h}/p">l</a>' for h in hosts)


def test_op2_distrust_runs_against_links_and_trust_along_them(spark, tmp_path):
    rules = {"bad.net/": "block", "good.org/": "allow"}
    pages = [(1, "http://bad.net/a", None), (2, "http://friend.com/a", link("bad.net")), (3, "http://good.org/x", link("shop.com")), (4, "http://shop.com/y", link("bad.net", "good.org", "good.org", "good.org")), (5, "http://else.com/", ""), (6, None, link("bad.net")), (7, "nothing", None), (8, "HTTP://Sub.BAD.net?x", None)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(rows, rules).collect()}
    assert out[1][2:] == ("bad.net/", "block") and out[2][3] == "block" and out[4][3] == "allow" and out[5][3] == "allow"
    assert out[6] == ("", "", None, "allow") and out[7] == ("", "", None, "allow") and out[8] == ("sub.bad.net", "", None, "allow")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(url_trust.judge(rows, rules), c, url_trust.oracle(rules))
    assert url_trust.judge(rows.limit(0), rules).count() == 0


def test_op2_scores_settle_and_do_not_depend_on_the_number_of_seeds(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 1.0), ("d", "e", 0.5)], "src string, dst string, share double")
    one = url_trust.propagate(spark.createDataFrame([("a", 1.0)], "host string, score double"), edges)
    assert {r.host: round(r.score, 1) for r in one.collect()} == {"a": 3.6, "b": 3.1}
    two = url_trust.propagate(spark.createDataFrame([("a", 1.0), ("c", 0.5)], "host string, score double"), edges)
    assert {r.host: round(r.score, 1) for r in two.collect()} == {"a": 3.6, "b": 3.1, "c": 0.5, "d": 0.4, "e": 0.2}


# ---------------------------------------------------------------- 3


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, radius=2):
    label = np.arange(len(fps))
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= radius
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


def test_op3_equals_brute_force(spark, small):
    texts = dict(connect(small).execute("SELECT doc_id, text FROM documents").fetchall())
    ids = sorted(texts)
    fps = [plain_simhash(texts[i]) for i in ids]
    want = {ids[i]: (f"{fps[i]:016x}", ids[c]) for i, c in enumerate(plain_classes(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_vptree"](spark, small).collect()} == want


@pytest.mark.parametrize("leaf", [16, 100, 10_000])
def test_op3_tree_loses_no_link(spark, leaf):
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 2**64, 600, np.uint64)
    near = base[:300].copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    chain = [base[0]]
    for i in range(100):
        chain.append(chain[-1] ^ np.uint64(1 << int(rng.integers(0, 64))))
    fps = np.unique(np.concatenate([base, near, np.array(chain)]))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = [(r.a, r.b) for r in simhash_vptree.similar_pairs(rows, 2, leaf).collect()]
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        before = label.copy()
        for a, b in pairs:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        if (before == label).all():
            break
    assert (label == plain_classes(fps)).all()


def test_op3_odd_rows(spark):
    out = [(r.doc_id, r.fp, r.component_id) for r in simhash_vptree.near_duplicates(odd_docs(spark)).collect()]
    assert len(out) == 9 and {c for d, f, c in out if f == 0} == {1} and {c for d, _, c in out if d in (5, 6)} == {5}
    assert simhash_vptree.near_duplicates(empty(spark)).count() == 0


def test_shingle_classes_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.class_id for r in similar_texts.verified_duplicates(docs(spark, texts)).collect()}
    assert sum(got[i] != label[i] for i in got) <= 1  # the min-wise views miss a borderline pair in hundreds
    assert len(similar_texts.verified_duplicates(odd_docs(spark)).collect()) == 9


@pytest.mark.parametrize("copies", [2, 3])
def test_shingle_classes_hold_copies_that_only_the_original_links(spark, copies, monkeypatch):
    first = [[f"o{g}w{i}" for i in range(100)] for g in range(8)]
    texts = []
    for words in first:  # each copy at 86 / 106 to the original, two copies at 76 / 116
        texts.append(" ".join(words))
        texts += [" ".join(f"x{c}" if i in (10 + 20 * c, 20 + 20 * c) else w for i, w in enumerate(words)) for c in range(copies)]
    # one bucket for each original with its copies, whatever their prints
    views = lambda rows, *_: rows.select("doc_id", F.xxhash64(F.regexp_extract("text", "o[0-9]+w", 0)).alias("fp"))
    monkeypatch.setattr(similar_texts, "fingerprints", views)
    got = {r.doc_id: r.class_id for r in similar_texts.verified_duplicates(docs(spark, texts)).collect()}
    assert got == {i: i - i % (copies + 1) for i in range(len(texts))}


def brute_classes(texts, similarity=0.8):
    """Class of each text by its smallest number: all pairs of five-word shingle sets, then whatever they connect."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    label, before = list(range(len(texts))), None
    while label != before:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_similar_sets_share_a_first_difference():
    rng, checked = random.Random(8), 0
    for _ in range(4000):
        head = set(range(rng.choice([20, 60, 100])))

        def variant():
            out = {e for e in head if rng.random() < rng.choice([0.8, 0.9, 0.97, 1.0])}
            return out | {1000 + rng.randrange(40) for _ in range(rng.choice([0, 2, 6, 15]))}

        x = variant()
        y = (x if rng.random() < 0.5 else variant()) ^ {rng.randrange(1040) for _ in range(rng.choice([1, 3, 8]))}
        (x_linked, _, a, a_asks), (y_linked, _, b, b_asks) = (
            similar_texts.first_differences(np.array(sorted(v), np.uint64), np.array(sorted(head), np.uint64), 0.8) for v in (x, y)
        )
        if len(x & y) >= 0.8 * len(x | y) and not (x_linked and y_linked):
            checked += 1
            a_all, b_all = set(a.tolist()) | set(a_asks.tolist()), set(b.tolist()) | set(b_asks.tolist())
            assert (b_all if x_linked else set(b.tolist())) & (a_all if y_linked else set(a.tolist()))
    assert checked > 300


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_bucket_gives_the_classes_of_all_pairs(spark, seed, monkeypatch):
    """Groups of copies just above and below the similarity, chains, a passage that all share, in one bucket."""
    rng = random.Random(seed)
    passage, texts = [f"p{i}" for i in range(40)], []
    for g in range(6):
        words = passage + [f"g{g}w{i}" for i in range(60 + 30 * g)]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                at = rng.randrange(len(copy))
                kind = rng.random()
                copy[at : at + 1] = [] if kind < 0.3 else [f"x{rng.randint(0, 30)}"] if kind < 0.8 else [copy[at], f"y{rng.randint(0, 9)}"]
            texts.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 0, 20, 25, 40])]))
    monkeypatch.setattr(similar_texts, "fingerprints", lambda rows, *_: rows.select("doc_id", F.lit(7).cast("long").alias("fp")))
    got = {r.doc_id: r.class_id for r in similar_texts.verified_duplicates(docs(spark, texts)).collect()}
    want = brute_classes([t for t in texts])
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 6


def test_duplicates_are_judged_by_row(spark):
    long = " ".join(f"v{i}" for i in range(100))
    rows = [(7, long), (7, "another text with the same id as it"), (3, long + " end"), (3, long + " end"), (None, long + " fin"), (None, "no id but words"), (9, None), (10, "")]
    got = similar_texts.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")))
    assert got.columns == ["doc_id", "text", "key"]
    want = [(None, "no id but words"), (3, long + " end"), (7, "another text with the same id as it"), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert similar_texts.drop_duplicates(empty(spark)).count() == 0


# ---------------------------------------------------------------- 4


def test_op4_layouts_select_mappings_and_round_trip(spark):
    nasty = 'a\\l <turn role="x">\\\\"</turn>\n\\'
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": nasty}]}, {"prompt": nasty, "completion": "c"}, {"instruction": "do", "input": "", "output": "o"}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"data": {"question": "q", "answer": "a"}}, {"what": 1}]
    rows = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(9, 0, "{bad"), (8, 0, None)], "conv_id long, position long, record string")
    turns = chat_format.canonical_turns(rows)
    segments = chat_format.format_turns(turns)
    back = [(r.conv_id, r.part, r.role, r.text, r.learned) for r in chat_format.read_turns(segments).orderBy("conv_id", "part").collect()]
    assert back == [(0, 0, "user", "q", False), (0, 1, "assistant", nasty, True), (1, 0, "user", nasty, False), (1, 1, "assistant", "c", True), (2, 0, "user", "do", False), (2, 2 - 1, "assistant", "o", True), (3, 0, "user", "h", False), (3, 1, "assistant", "g", True), (4, 0, "user", "q", False), (4, 1, "assistant", "a", True)]
    assert {r.conv_id for r in chat_format.unmapped(rows).collect()} == {5, 8, 9}


@pytest.mark.parametrize("seed", range(5))
def test_op4_escape_is_reversible(seed):
    rng = random.Random(seed)
    for _ in range(500):
        text = "".join(rng.choices('\\lgq<>"/turn \né', k=rng.randint(0, 30)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert chat_format.parse_segment(chat_format.segment(text, text[::-1])[0]) == (text, text[::-1])


def test_op4_digests_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (None, 0, "user", "x"), (1, None, "user", "first"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    turns = chat_format.canonical_turns(chat_format.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    out = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_turns(turns)).collect()}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\nfirst\n\n\nassistant\nb\n").hexdigest() and out[1].loss_chars == 1
    assert out[None].n_turns == 1 and out[2].n_turns == 2
    none = chat_format.canonical_turns(chat_format.turn_records(empty(spark, "conv_id long, turn long, role string, text string")))
    assert chat_format.digest_conversations(chat_format.format_turns(none)).count() == 0


# ---------------------------------------------------------------- 5


def test_op5_learns_and_holds_out(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["lorem", "ipsum", "dolor", "amet", "sit"], k=40) + (["vilegrub"] * 2 if i % 5 == 0 else [])) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = toxicity.predict(docs(spark, texts), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) == bool(r.predicted) for r in out if r.held_out)


def test_op5_ratios_and_scores_equal_plain_counts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["lorem", "Ipsum,", "dolor!", "été", "sit"], k=12) + (["vilegrub"] if i % 3 == 0 else [])) for i in range(300)]
    texts[7] = "ab"

    def grams(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in text.encode())
        padded = toxicity.GAP + raw + toxicity.GAP
        found = set()
        for n in toxicity.NGRAMS:
            for at in range(len(toxicity.GAP) + len(raw)):
                h = 0x9E3779B1 * n & 0xFFFFFFFF
                for c in padded[at : at + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h ^= h >> 15
                found.add((h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - toxicity.BITS)
        return found

    label = [int(i % 3 == 0) for i in range(300)]
    used = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = [Counter(g for i in used if label[i] == k for g in grams(texts[i])) for k in (0, 1)]
    sums = [sum(c.values()) + (1 << toxicity.BITS) for c in counts]
    n = [sum(label[i] == k for i in used) for k in (0, 1)]
    ratio = {g: np.log((counts[1][g] + 1) / n[1]) - np.log((counts[0][g] + 1) / n[0]) for g in counts[0] | counts[1]}
    far = {g for g, r in ratio.items() if abs(r) >= 4.5 * np.sqrt(1 / (counts[1][g] + 1) + 1 / (counts[0][g] + 1))}
    table = docs(spark, texts).union(docs(spark, ["other text of the same id"] * 5, 3))
    model = toxicity.train(table, spark.createDataFrame(list(enumerate(label)), "doc_id long, toxic int"))
    held = np.zeros((2, 1 << toxicity.BITS), np.int64)
    for k in (0, 1):
        held[k, list(counts[k])] = list(counts[k].values())
    chosen, ratios = toxicity._choose(held, np.array(n, float))
    assert set(chosen.tolist()) == far and all(abs(ratio[g] - r) < 1e-9 for g, r in zip(chosen.tolist(), ratios, strict=True)) and all(sums)
    assert set(np.nonzero(model.table)[0].tolist()) <= far and len(far) > 10
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), model).collect()}
    for i in range(300):
        z = model.intercept + sum(model.table[g] for g in grams(texts[i]))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_op5_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (5, 0)], "doc_id long, toxic int")
    out = toxicity.predict(odd_docs(spark), labels).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.predict(odd_docs(spark), labels.limit(0)).count() == 9
    assert toxicity.predict(empty(spark), labels).count() == 0


# ---------------------------------------------------------------- 6 and 8


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_cached_encoding_is_exact(plain):
    rng = random.Random(6)
    alphabet = ["a", "é", " ", "  ", "\n", "\t", "'s", "1", "!", "\x85", "\x1c", "​", "　", "世", "😀", "́", "\x00", "<|endoftext|>", "the", " of"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    flat, sizes = token_cache.encoder(TOKENIZER).encode_all(texts)
    ends = np.cumsum(sizes)
    for text, n, end in zip(texts, sizes, ends, strict=True):
        assert flat[end - n : end].tolist() == plain(text)[:-1].tolist()


@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 2**40, 2**64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for _ in range(20):
        sizes = rng.integers(0, 700, rng.integers(1, 6))
        values = rng.integers(0, top, int(sizes.sum()), np.uint64, endpoint=True)
        words, block_words, blocks = token_io.pack(values, sizes)
        lengths = np.full(int(blocks.sum()), token_io.BLOCK)
        some = sizes > 0
        lengths[np.cumsum(blocks)[some] - 1] = (sizes - (blocks - 1) * token_io.BLOCK)[some]
        assert (token_io.unpack(words, block_words, lengths) == values).all()


def test_op6_equals_the_tokenizer(spark, small, plain):
    texts = dict(connect(small).execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_blocks"](spark, small).collect()}
    start, want = 0, {}
    for i in sorted(texts):
        ids = plain(texts[i])
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_op6_odd_rows(spark, plain):
    path = token_io.token_path(spark, "odd")
    token_io.write_tokens(odd_docs(spark), path, TOKENIZER)
    out = token_io.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, -9, 1, 2, 3, 4, 4, 5, 6] and out[2].ids == out[3].ids == [0]
    assert out[1].ids == plain("ünï ☃ \U0001f600 x").tolist()
    path = token_io.token_path(spark, "none")
    token_io.write_tokens(empty(spark), path, TOKENIZER)
    assert token_io.token_digests(spark, path).count() == 0


def check_packing(pieces, texts, plain):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, rows in by_doc.items():
        ids, at = plain(texts[doc_id]), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert set(by_doc) == set(texts)
    return 1 - sum(r.length for r in pieces) / 1024 / len(by_sequence)


def test_op8_places_every_token_once(spark, small, plain):
    texts = dict(connect(small).execute("SELECT doc_id, text FROM documents").fetchall())
    padding = check_packing(QUERIES["op8_packing"](spark, small).collect(), texts, plain)
    assert padding < 0.02


def test_op8_odd_rows(spark):
    out = packing.pack_documents(odd_docs(spark), TOKENIZER).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 1 and {r.doc_id for r in out} == {None, -9, 1, 2, 3, 4, 5, 6}
    assert sum(r.length for r in out if r.doc_id == 4) == 2 * max(r.doc_tokens for r in out)
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


def test_op8_program_reaches_its_bound():
    rng = np.random.default_rng(7)
    lengths, demand = np.unique(rng.integers(1, 129, 50_000), return_counts=True)
    p = packing.plan(dict(zip(lengths.tolist(), demand.tolist(), strict=True)), 128)
    assert ((p.patterns * p.lengths).sum(1) <= 128).all() and (p.patterns.T @ p.times == demand).all()
    assert p.times.sum() * 128 <= 1.01 * (lengths * demand).sum()


# ---------------------------------------------------------------- 7


def test_op7_removes_shared_passages_and_nothing_else(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(8))
    passage = [line() for _ in range(30)]
    long = " ".join(f"z{rng.randint(0, 9999)}" for _ in range(60))
    texts = []
    for i in range(12):
        own = [line() for _ in range(10)]
        texts.append("\n".join(own[:5] + (passage if i % 3 == 0 else []) + own[5:] + ([long] if i % 4 == 1 else [])))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[1].text == texts[1]
    for i in (3, 6, 9):
        assert out[i].removed_lines >= 20 and out[i].n_chars == len(out[i].text)
        assert set(texts[i].split("\n")) - set(out[i].text.split("\n")) <= {*passage, long}
    for i in (5, 9):
        assert long not in out[i].text
    for i in (2, 4, 7, 8, 10, 11):
        assert out[i].text == texts[i]


def plain_line_dedup(rows: list[tuple[int, str]], long_words: int = 50) -> dict[int, str]:
    """Lines go that stand beside the same neighbour at an earlier place, or are long and stand at an earlier place."""
    seen, out = set(), {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.encode().strip()]
        gone = set()
        for i, j in zip(full, full[1:], strict=False):
            gone |= {i, j} if (lines[i], lines[j]) in seen else set()
            seen.add((lines[i], lines[j]))
        for i in full:
            if len(lines[i].encode().split()) >= long_words:
                gone |= {i} if lines[i] in seen else set()
                seen.add(lines[i])
        for i, j in zip(full, full[1:], strict=False):
            gone |= set(range(i, j)) if {i, j} <= gone else set()
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_op7_equals_brute_force(spark, small):
    rows = connect(small).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    assert {r.doc_id: r.text for r in QUERIES["op7_line_chunks"](spark, small).collect()} == plain_line_dedup(rows)


def test_op7_finds_passages_of_any_number_of_lines(spark):
    rng = random.Random(3)
    line = lambda n=6: " ".join(f"w{rng.randint(0, 999999)}" for _ in range(n))
    texts, shared = [], set()
    for n in range(2, 21):
        for _ in range(8):
            passage = [line() for _ in range(n)]
            shared.update(passage)
            for _ in range(2):
                before, after = ([line() for _ in range(rng.randint(0, 7))] for _ in range(2))
                texts.append("\n".join([*before, *passage, *rng.choice([[], [""], [" "]]), *after]))
    common = line()  # a single line that many documents have is no passage
    texts += [f"{line()}\n{common}\n\n{line()}" for _ in range(40)]
    texts += ["again\nagain\nagain\nend", "one\n\n\ntwo\nthree", "zero\none\ntwo\n\nthree", "\n\n\n", " \n\n"]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert out == plain_line_dedup(list(enumerate(texts)))
    kept = [x for i in range(len(texts)) for x in out[i].split("\n")]
    assert all(kept.count(x) == 1 for x in shared) and kept.count(common) == 40
    assert [out[i] for i in range(len(texts) - 5, len(texts))] == ["again\nend", texts[-4], "zero", "\n\n\n", " \n\n"]


def test_op7_seams_go_beyond_repeated_chunks_alone():
    rng = random.Random(4)
    passage = [b"line %d" % rng.randint(0, 10**9) for _ in range(5)]
    one, two = ([b"own %d" % rng.randint(0, 10**9) for _ in range(4)] + passage + [b"own %d" % rng.randint(0, 10**9)] for _ in range(2))
    found = [{u.hash: u for u in line_dedup.units_of(x)} for x in (one, two)]
    both = [found[0][h] for h in found[0].keys() & found[1].keys()]
    assert {i for u in both if u.number % 2 for i in u.lines} == {4, 5, 6, 7, 8}


def test_op7_odd_rows(spark):
    out = line_dedup.dedup_lines(odd_docs(spark)).collect()
    assert len(out) == 9 and {r.text for r in out if r.doc_id == 1} == {None} and sum(r.removed_lines for r in out if r.doc_id != 4) == 0
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# ---------------------------------------------------------------- 9


def test_op9_odd_rows_and_ablations(spark):
    rows = quality_ledger.ledger(odd_docs(spark))
    out = {r.doc_id: r for r in rows.collect()}
    assert out[1].n_words == out[2].n_words == out[3].n_words == 0 and out[4].n_words == len((odd_docs(spark).where("doc_id = 4").first().text).split())
    judged = quality_ledger.judge(rows, quality_ledger.STANDARD).collect()
    table = {(r.version, r.rule): (r.n_failed, r.n_failed_alone) for r in quality_ledger.ablations(rows, [quality_ledger.BASE, quality_ledger.STANDARD]).collect()}
    bits = [r.failed for r in judged]
    for k, (name, _) in enumerate(quality_ledger.RULES):
        assert table["2024-1", name] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    assert sum(not r.kept for r in judged) == sum(b != 0 for b in bits)
    assert quality_ledger.ledger(empty(spark)).count() == 0


def test_op9_repeated_windows_overlap(spark):
    words = [f"a{i}" for i in range(10)]
    text = " ".join(words + ["x"] + words + ["y"] + words[:8])
    assert quality_ledger.measure(docs(spark, [text])).first().n_repeat_words == 28


# ---------------------------------------------------------------- 10


ITEMS = ["A train leaves Rome at 9 with 240 riders and picks up 35 more riders in Pisa before it reaches Turin in 4 hours, how many riders are aboard then", "too short here"]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_op10_catches_other_parameters_and_needs_consistency(spark):
    filler = "some plain words that belong to no question at all and go on for a while "
    again = ITEMS[0].replace("Rome", "Oslo").replace("240", "310").replace("35", "77").replace("Pisa", "Bergen City")
    mixed = "Nothing of it. A train leaves for the hills with many riders and then it rains for 3 hours"
    texts = [filler + ITEMS[0] + " " + filler, filler + again, mixed, filler, ITEMS[1] + " " + filler, None, ""]
    got = {(r.doc_id, r.item_id): r.other_values for r in decontamination.contaminated(docs(spark, texts), bench(spark)).collect()}
    assert got == {(0, 0): False, (1, 0): True}
    kept = {r.doc_id for r in decontamination.decontaminate(docs(spark, texts), bench(spark)).collect()}
    assert kept == {2, 3, 4, 5, 6}


def test_op10_slots_must_agree(spark):
    item = " ".join(f"take {n} apples and {n} pears from the box number {n} of the store" for n in (5, 5, 5))
    other = " ".join(f"take {n} apples and {m} pears from the box number {k} of the store" for n, m, k in ((1, 2, 3), (4, 6, 7), (8, 9, 10)))
    assert decontamination.contaminated(docs(spark, [other]), bench(spark, [item])).count() == 0
    assert decontamination.contaminated(docs(spark, [item.replace("5", "8")]), bench(spark, [item])).count() == 1


OTHER = ITEMS[0].replace("Rome", "Oslo").replace("240", "310").replace("35", "77").replace("Pisa", "Bergen").replace("Turin", "Malmo").replace("at 9", "at 7").replace("4 hours", "6 hours")
THIRD = ITEMS[0].replace("Rome", "Bonn").replace("240", "88").replace("35", "21").replace("Pisa", "Ulm").replace("Turin", "Graz").replace("at 9", "at 5").replace("4 hours", "3 hours")


def test_op10_judges_every_occurrence_by_itself(spark):
    filler = " and so it goes on with plain words " * 3
    words = OTHER.split()
    broken = " ".join(words[:14]) + filler + " ".join(words[14:])
    texts = [ITEMS[0] + filler + OTHER, OTHER + filler + ITEMS[0], OTHER + filler + THIRD, ITEMS[0] + " " + OTHER + " " + THIRD, broken + filler + THIRD, filler]
    found = decontamination.contaminated(docs(spark, texts), bench(spark, [ITEMS[0], OTHER])).collect()
    got = {(r.doc_id, r.item_id): r.other_values for r in found}
    want = {(0, 0): False, (0, 1): False, (1, 0): False, (1, 1): False, (2, 0): True, (2, 1): False, (3, 0): False, (3, 1): False, (4, 0): True}
    assert {k: v for k, v in got.items() if k != (4, 1)} == want and (4, 1) in got
    assert {r.doc_id for r in decontamination.decontaminate(docs(spark, texts), bench(spark)).collect()} == {5}


def test_op10_finds_copies_of_items_with_few_words(spark):
    items = ["Compute 12, 7, 45, 3 by 8, 19, 4", "Anna Berg, Carl Dahl, Emma Falk, Gustav Holm 3, 5, 7", "17 23 31 42 58 61", *ITEMS]
    filler = "some plain words that belong to no question at all and go on for a while "
    texts = [filler + x + " " + filler for x in items[:3]] + ["With " + items[1], "Compute 11, 9, 44, 2 by 6, 15, 8", "17 23 31 42 58 60", filler, None]
    got = {(r.doc_id, r.item_id, r.consistency, r.other_values) for r in decontamination.contaminated(docs(spark, texts), bench(spark, items)).collect()}
    assert got == {(0, 0, 1.0, False), (1, 1, 1.0, False), (2, 2, 1.0, False), (3, 1, 1.0, False)}
    assert {r.doc_id for r in decontamination.decontaminate(docs(spark, texts), bench(spark, items)).collect()} == {4, 5, 6, 7}


def test_op10_bitmap_size_changes_nothing(spark, monkeypatch):
    """Repeated windows, repeated and null ids; a full bitmap lets every window through."""
    chorus = "row the boat down the stream and sing the song again with all of them "
    items = [chorus * 3 + "until 5 boats have passed", *ITEMS, chorus + "while 3 birds sit on the roof of the mill"]
    filler = "some plain words that belong to no question at all and go on for a while "
    rows = [(1, filler + items[0]), (1, filler), (None, items[1] + " " + filler), (None, None), (2, items[3].replace("3", "9")), (2, items[3].replace("3", "9")), (3, chorus)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    answers = []
    for bits in (24, 6):
        monkeypatch.setattr(decontamination, "BITMAP", bits)
        pairs = sorted(tuple(r) for r in decontamination.contaminated(table, bench(spark, items)).collect())
        kept = sorted(((r.doc_id, r.text) for r in decontamination.decontaminate(table, bench(spark, items)).collect()), key=str)
        answers.append((pairs, kept))
    assert answers[0] == answers[1]
    pairs, kept = answers[0]
    words = decontamination._Words()
    want = {(d, i) for d, t in rows if d for i, item in enumerate(items) if decontamination.match(decontamination.Item.of(item, words), decontamination.template(t, words))}
    assert {(p[0], p[1]) for p in pairs} == want and {(1, 0), (2, 3)} <= want
    assert (1, filler) in kept and (None, None) in kept and not any(d == 2 or t and "train" in t for d, t in kept)


def test_op10_equals_plain_search(spark, small):
    c = connect(small)
    items = [(i, " ".join(t.split())) for i, t in c.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, t in c.execute("SELECT doc_id, text FROM documents").fetchall() for i, item in items if item in " ".join((t or "").split())}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op10_template_windows"](spark, small).collect()} == want


def test_op10_odd_rows(spark):
    assert decontamination.contaminated(odd_docs(spark), bench(spark, [None, "", *ITEMS])).count() == 0
    assert decontamination.decontaminate(odd_docs(spark), bench(spark)).count() == 9
    assert decontamination.contaminated(empty(spark), bench(spark)).count() == 0
    assert decontamination.contaminated(docs(spark, ["x"]), empty(spark, "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, small):
    import corpus_pipeline as P

    docs_now = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs_now.columns
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs_now.collect()}
        docs_now = P.materialize(stage(spark, docs_now, small), name)
        assert docs_now.columns == columns
        after = {r.doc_id: r.text for r in docs_now.collect()}
        assert set(after) <= set(before)
        if name == "benchmark_decontamination":
            items = [" ".join(t.split()) for (t,) in connect(small).execute("SELECT text FROM benchmark").fetchall()]
            assert set(after) == {d for d, t in before.items() if not any(i in " ".join((t or "").split()) for i in items)}
        if name == "simhash_near_dedup":
            gone = Counter(t for d, t in before.items() if d not in after)
            assert len(set(after.values())) == len(after) and sum(gone.values()) == len(before) - len(after)
    packed = P.STAGES[-1][1](spark, docs_now, small)
    assert packed.select("doc_id").distinct().count() == docs_now.count()
    assert isinstance(packed.schema["sequence_id"].dataType, T.LongType)


def test_op10_windows_of_a_batch_equal_those_of_each_text():
    from quillgrove.llm import decontamination as D

    texts = [None, "", "one", "Anna Bell walks 3 km to the Old Mill at 5 pm with Carl", "... !", "Old Mill", "Old Mill at the end of a long green road by the sea " * 40, "12 13 14 15 16 17 18 19"]
    words, sizes = D._Words(), [(False, 6), (False, 8), (True, 6), (True, 8)]
    found = dict(zip(sizes, D.batch_windows(texts, words, sizes), strict=True))
    for i, t in enumerate(D.templates(texts, words)):
        for as_is, size in sizes:
            alone = D.exact_windows(t, size) if as_is else D.window_hashes(t, size)[1]
            owner, h = found[as_is, size]
            assert h[owner == i].tolist() == alone.tolist()
    assert all(len(h) == 0 for _, h in D.batch_windows([], words, sizes))
