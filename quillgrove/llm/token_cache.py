"""Tokenization of whole texts with the tokenizers library, memoised by word.

A byte-level BPE tokenizer starts a new pre-token at every space that precedes a
non-space, whatever stands around it.  So a text is cut there, and each distinct
piece is encoded once per Python worker; the ids of a text are those of its
pieces, joined.  Added tokens (such as an end of text) that a text spells out are cut
out first, as the library does.  ``encode`` gives exactly what the library gives for
whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from quillgrove.llm.worker import held

END_ID = 0
#: Distinct pieces that a worker remembers; beyond this it starts afresh.
CACHE_PIECES = 1_200_000
#: A space before white space, before a control or format character, or at the
#: end starts no piece of its own.
_UNSAFE = re.compile(r" (?:[\s\x00-\x1f\x7f-\xa0 ᠎ -‏ -  ⁠　﻿]|$)")


class PieceEncoder(dict):
    """piece -> its number; ids of piece i are ``flat[start[i] : start[i] + size[i]]``."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        # the longest of those that begin at one place
        spelled = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.cut_added = re.compile(f"({spelled})").split if spelled else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for written, number in vocabulary.items():  # byte-level: one character a byte
            self.id_bytes[number] = len(written)
        for written, number in self.added.items():
            self.id_bytes[number] = len(written.encode())
        self.joins = not any(" " in x for x in self.added)  # pieces laid end to end spell no added token
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number

    def _learn(self) -> None:
        if not self.fresh:
            return
        first, total = len(self) - len(self.fresh), len(self)
        while total > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        for at in range(0, len(self.fresh), 8192):
            part = self.fresh[at : at + 8192]
            # pieces that begin with a space follow each other; the others start a string each
            heads = [i for i, x in enumerate(part) if x[0] != " " or not self.joins]
            order = [i for i, x in enumerate(part) if x[0] == " " and self.joins] + heads
            strings = ["".join(part[i] for i in order[: len(part) - len(heads)])] + [part[i] for i in heads]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            new = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
            while self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat * 0])
            self.flat[self.used : self.used + len(new)] = new
            # a piece ends where its bytes end
            ends = np.searchsorted(np.cumsum(self.id_bytes[new]), np.cumsum([len(part[i].encode()) for i in order])) + 1
            sizes = np.diff(ends, prepend=0)
            where = first + at + np.array(order)
            self.size[where], self.start[where] = sizes, self.used + ends - sizes
            self.used += len(new)
        self.fresh = []

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, one after another as int32, and how many each has (null: none)."""
        if len(self) > CACHE_PIECES:
            self._reset()
        cut = [self._cut(x) if x else [] for x in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        self._learn()
        sizes = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.start[numbers] - ends[:-1], sizes)
        where += np.arange(len(where))
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[where], np.diff(edges)

    def _cut(self, text: str) -> list[str]:
        parts = self.cut_added(text) if self.cut_added else [text]
        if len(parts) == 1:
            return _pieces(text)
        return [y for x in parts if x for y in ([x] if x in self.added else _pieces(x))]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


def _pieces(text: str) -> list[str]:
    parts = text.split(" ")
    if not _UNSAFE.search(text):
        out = [" " + x for x in parts]
        out[0] = parts[0]
        return out if parts[0] else out[1:]
    out, now = [], parts[0]
    for x in parts[1:]:
        if not x or _UNSAFE.match(" " + x[0]):
            now += " " + x
        else:
            out.append(now)
            now = " " + x
    out.append(now)
    return [x for x in out if x]


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    return held(f"encoder {path}", lambda: PieceEncoder(path))
