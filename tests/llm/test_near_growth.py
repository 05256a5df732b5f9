"""What near-duplicate searches move and write beside their input."""

import os
import random

import numpy as np
import pytest

from quillgrove.llm import hyper_minhash, similar_texts
from quillgrove.session import shared_dir


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_hyper_minhash_keeps_no_copy_of_texts_that_nothing_asks_for(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1500)) for _ in range(60)]
    texts += [texts[0] + " and an end", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = folder_bytes(shared_dir(spark))
    got = {r.doc_id: r.component_id for r in hyper_minhash.near_duplicates(docs).collect()}
    assert got == {i: 0 if i >= 60 else i for i in range(62)}
    assert folder_bytes(shared_dir(spark)) - before < 0.4 * sum(map(len, texts))


def test_a_dense_bucket_makes_no_rows_of_pairs(spark, monkeypatch):
    """Members near one head and just below the similarity to each other: their pairs were rows to be confirmed."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for c in range(30):  # a third of them differ from the head in the same nine places, and share two of nine words there: similarity 0.79
        words = list(base)
        for k in range(9):
            words[20 + 30 * k + 9 * (c % 3)] = f"g{c % 3}k{k}" if k < 2 else f"x{c}k{k}"
        texts.append(" ".join(words))
    texts.append(texts[-1] + " end")
    rows = spark.createDataFrame([(1, i, i, 100 if i == 0 else 1) for i in range(len(texts))], "bucket long, key long, class long, weight long")
    keyed = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    counted, confirm = [], similar_texts.confirm_pairs

    def counting(pairs, *more):
        counted.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(similar_texts, "confirm_pairs", counting)
    links, _ = similar_texts.vantage_round(rows, keyed, 5, 0.8)
    found = [(r.a, r.b) for r in links.collect()]
    assert sum(counted) == 0
    sets = [set(similar_texts.shingle_set(t, 5).tolist()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert [tuple(sorted(x)) for x in found] == [(30, 31)] and alike(30, 31) and not alike(27, 30)


@pytest.mark.parametrize("cut", [False, True])
def test_members_are_linked_as_all_pairs_link_them(spark, cut, monkeypatch):
    """Differences from a head tell what whole sets do, in one task and in a grid of parts."""
    if cut:
        monkeypatch.setattr(similar_texts, "LEAST_PART", 16)
    rng = random.Random(5)
    texts, base = [], [f"w{i}" for i in range(120)]
    for g in range(12):
        words = [w if rng.random() > 0.03 else f"g{g}_{i}" for i, w in enumerate(base)]
        for _ in range(9):
            texts.append(" ".join(w if rng.random() > rng.choice([0.0, 0.01, 0.03]) else f"y{rng.randrange(30)}" for w in words))
    of = lambda t: set(similar_texts.shingle_set(t, 5).tolist())
    head = of(" ".join(base))  # what is far from it is another round's
    texts = [" ".join(base), *dict.fromkeys(t for t in texts if of(t) != head and len(of(t) & head) >= 0.5 * len(of(t) | head))]
    rows = spark.createDataFrame([(1, i, i, 100 if i == 0 else 1) for i in range(len(texts))], "bucket long, key long, class long, weight long")
    keyed = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    links, _ = similar_texts.vantage_round(rows, keyed, 5, 0.8)
    classes = rows.select("key", "class")
    got = {r.key: r["class"] for r in similar_texts.merged_classes(classes, links).collect()}
    sets = [of(t) for t in texts]
    label, before = np.arange(len(texts)), None
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while before is None or (before != label).any():
        before = label.copy()
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label.tolist())) and len(set(got.values())) > 3
