"""Toxicity scores from a linear classifier over character n-grams.

A text's features are the hashed n-grams that occur in it at all.  Each is scaled
by its naive Bayes log-count ratio, and a logistic regression is fitted on the
scaled features (NB-SVM with a logistic loss).  Ratios and weights multiply into
one table of ``2 ** BITS`` numbers, which is all that scoring needs.

``train``  fits on at most ``per_class`` labelled ids of each class, those with the
           smallest hashes, one text each; whole texts, never prefixes.  That bound
           is what one task holds: the ratios and the fit are its work alone.
``score``  scores every text; its cost is a few vector operations per byte.

Defined results: a null, empty or blank text has the intercept's score; repeated
rows score alike; of several texts of a labelled id the first in order is learned; a
doc_id labelled twice counts as toxic if any label says so;
null labels are ignored; without labelled texts of both classes every score is the
share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrove.llm.token_io import groups_by_size
from quillgrove.llm.worker import release, small_batches
from quillgrove.session import materialize

NGRAMS = (4, 5, 6)
BITS = 20
#: Labelled texts of each class that the fit uses, at most.
PER_CLASS = 4_000
#: A feature is fitted if its ratio is so many standard errors from none.
MIN_ERRORS = 4.5
SMOOTHING = 1.0
L2 = 1e-4
#: Steps of the fit, at most, and the gradient at which it ends.
STEPS = 120
FLAT = 1e-6
THRESHOLD = 0.3
#: Bytes hashed at a time.
SPAN = 1 << 19
GAP = b" " + b"\0" * max(NGRAMS) + b" "

# letters in lower case; ASCII punctuation and white space as one kind of gap
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _hashed(buffer: np.ndarray, n: int) -> np.ndarray:
    """The feature number of the n-gram at each position."""
    size = len(buffer) - n + 1
    h = np.full(size, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h += buffer[k : k + size]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def text_features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of the text, feature), each once, sorted; ``wanted``: a mask of features to keep."""
    parts = [GAP + (x or "").encode().translate(_FOLD) for x in texts]
    starts = np.cumsum([0] + [len(p) for p in parts])
    buffer = np.frombuffer(b"".join(parts) + GAP, np.uint8)
    found = []
    for at in range(0, len(buffer), SPAN):
        for n in NGRAMS:
            piece = buffer[at : at + SPAN + n - 1]
            if len(piece) < n:
                continue
            h = _hashed(piece, n)
            where = np.nonzero(wanted[h])[0] if wanted is not None else np.arange(len(h))
            text = np.searchsorted(starts, where + at, side="right") - 1
            keys = (text << BITS) | h[where]
            found.append(np.unique(keys[text < len(texts)]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    """``table[f]``: what the occurrence of feature f adds to the log odds."""

    table: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, active = np.full(len(texts), self.intercept), self.table != 0
        for part in groups_by_size(np.array([len(x or "") + 64 for x in texts]), SPAN):
            text, feature = text_features(texts[part], active)
            out[part] += np.bincount(text, weights=self.table[feature], minlength=part.stop - part.start)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def held_out() -> Column:
    """Rows whose crc32 of the doc_id, written as text, leaves 2 divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _choose(counts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features to fit and their ratios, from ``counts[class, feature]`` and each class's number of texts."""
    p, q = counts[1] + SMOOTHING, counts[0] + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # common to the classes' totals: what a feature of equal shares of texts would have
    ratio -= np.log(texts[1] / p.sum()) - np.log(texts[0] / q.sum())
    errors = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    ratio[errors < MIN_ERRORS] = 0
    chosen = np.nonzero(ratio)[0]
    return chosen, ratio[chosen]


def _descend(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """A minimum of a smooth convex function by limited-memory quasi-Newton steps."""
    f, g = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(g).max() < FLAT:
            break
        way, kept = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        slope, length = g @ way, 1.0 if steps else 1.0 / max(1.0, float(np.abs(g).sum()))
        while True:
            there = x - length * way
            f_there, g_there = value_and_slope(there)
            if f_there <= f - 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        s, y = there - x, g_there - g
        x, f, g = there, f_there, g_there
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
    return x


def _fit(columns: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """What each feature adds, and the intercept: logistic regression on features that have their ratio as value.

    ``columns``: which of the chosen features each text has.
    """
    row, column = np.repeat(np.arange(len(columns), dtype=np.int32), list(map(len, columns))), np.concatenate(columns)
    weight = weight / weight.sum()

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[-1] + np.bincount(row, weights=(x[:-1] * ratio)[column], minlength=len(label))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        slope = np.bincount(column, weights=error[row], minlength=len(ratio)) * ratio + L2 * x[:-1]
        loss = weight @ (np.logaddexp(0, z) - label * z) + L2 / 2 * (x[:-1] @ x[:-1])
        return float(loss), np.append(slope, error.sum())

    start = np.append(np.zeros(len(ratio)), np.log(weight[label == 1].sum() / weight[label == 0].sum()))
    x = _descend(value_and_slope, start)
    out = x[:-1] * ratio
    out[np.abs(out) < 1e-3] = 0
    return out, float(x[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = 1 - 1e-6 if totals.get(1) else 1e-6
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == k).orderBy(order).limit(per_class) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            text, feature = text_features(batch.column(0).to_pylist())
            ends = np.cumsum(np.bincount(text, minlength=len(batch)))
            lists = [x.astype("<u4").tobytes() for x in np.split(feature, ends[:-1])] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.binary())], ["toxic", "features"])

    # at most 2 * per_class rows of ids: a proven bound for the broadcast
    sample = materialize(chosen[0].union(chosen[1]), "toxic-sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    rows = materialize(texts.mapInArrow(run, "toxic int, features binary"), "toxic-features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[k, np.frombuffer(x.as_buffer(), "<u4")] += 1
                texts[k] += 1
        if texts.all():
            chosen, ratio = _choose(counts, texts)
            head = [np.array([-1, -2]), chosen], [texts.astype(float), ratio]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in head], ["feature", "weight"])

    # one task at a time reads the bounded sample, a batch after the other; its result is at most 2 ** BITS numbers
    one = rows.coalesce(1)
    picked = {r.feature: r.weight for r in one.mapInArrow(count, "feature long, weight double").collect()}
    if not picked:
        share = totals[1] / (totals[0] + totals[1])
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    sizes = np.array([picked.pop(-1), picked.pop(-2)])
    features = np.array(sorted(picked), np.int64)
    ratios = np.array([picked[f] for f in features])
    per_text = np.array([totals[0], totals[1]]) / sizes

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = np.full(1 << BITS, -1, np.int32)
        number[features] = np.arange(len(features))
        label, columns = [], []
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = number[np.frombuffer(x.as_buffer(), "<u4")]
                label.append(k)
                columns.append(held[held >= 0])
        label = np.array(label)
        weights, intercept = _fit(columns, ratios, label, per_text[label])
        active = np.nonzero(weights)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(features[active], -1)), pa.array(np.append(weights[active], intercept))], ["feature", "weight"])

    fitted = one.mapInArrow(fit, "feature long, weight double").collect()
    table, intercept = np.zeros(1 << BITS), 0.0
    for r in fitted:
        if r.feature < 0:
            intercept = r.weight
        else:
            table[r.feature] = r.weight
    return Model(table, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (one that they have is replaced), from the whole text alone."""
    docs = docs.drop("score")
    small_batches(docs.sparkSession)
    active = np.nonzero(model.table)[0]
    sent = docs.sparkSession.sparkContext.broadcast((active.astype(np.int32), model.table[active], model.intercept))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        where, weights, intercept = sent.value
        table = np.zeros(1 << BITS)
        table[where] = weights
        here = Model(table, intercept)
        at = names.index("text")
        for batch in batches:
            scores = here.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(rows, labels)).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
