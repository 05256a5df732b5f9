"""Chunks against plain loops over slices of the rest."""

import random
import re
from dataclasses import replace

import pytest

from quillgrove.operators import chunkers
from quillgrove.operators.chunkers import PARAGRAPHS, SENTENCES, TECHNICAL

SMALL = {
    "sentences": replace(SENTENCES, size=40, overlap=6), "technical": replace(TECHNICAL, size=50, overlap=13), "paragraphs": replace(PARAGRAPHS, size=60, whole=75),
}


def plain(text, cut):
    if cut.clean:
        text = re.sub("[ \t]+", " ", re.sub("\r\n|\r", "\n", text))
        text = re.sub("\n\n\n+", "\n\n", text).strip()
    out, rest = [], text
    if len(text) <= cut.whole:
        return [text] if text else []
    while len(rest) > cut.size:
        if cut.in_order:
            found = [i for mark in cut.marks for i in [max([i for i in range(cut.size + 1) if rest.startswith(mark, i)], default=-1)] if i >= int(cut.size * cut.least)]
            out.append(rest[: (found or [cut.size])[0]].strip())
            rest = rest[(found or [cut.size])[0] :].strip()
            continue
        last = max(rest[: cut.size].rfind(mark) for mark in cut.marks)
        end = last + 1 if last > cut.size * cut.least else cut.size
        out.append(rest[:end].strip())
        rest = rest[max(end - cut.overlap, 1) :]
    return [x for x in [*out, rest.strip()] if x]


def texts():
    rng = random.Random(7)
    parts = ["word", "longerword", "x" * 35, "è", ". ", ": ", "; ", "\n", "\n\n", "\n\n\n\n", " ", "  ", "\t", "\r\n", ".", ", "]
    return ["", " \n ", "a" * 500, " " * 300 + "b", *("".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(300))]


@pytest.mark.parametrize("name", SMALL)
def test_chunks_equal_a_plain_loop(name):
    for text in texts():
        assert list(chunkers.chunks_of(text, SMALL[name])) == plain(text, SMALL[name])


def test_chunks_of_a_table(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())] + [(7, None), (None, "a b")]
    got = chunkers.break_chunks(spark.createDataFrame(rows, "id long, text string"), SMALL["technical"]).collect()
    want = [(i, k, c) for i, t in rows for k, c in enumerate(plain(t or "", SMALL["technical"]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_very_long_text_is_walked_once():
    text = "some words here. " * 200_000
    assert sum(1 for _ in chunkers.chunks_of(text, SENTENCES)) > 6_000
