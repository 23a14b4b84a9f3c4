"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

A text's features are its words, neighbouring pairs and pairs with one word
between them (skip-grams), each hashed into ``2**BITS`` slots and counted once
a text.  Words are lower-cased (A-Z) and lose marks around them.  Learning
rates are per coordinate, and L1 leaves a few thousand weights, which travel
to the tasks as two short arrays.

Edge cases: a null or empty text scores the bias alone; a null doc_id is never
learned from; labels other than 0 and 1 are ignored; without labels of both
classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, arrow_slices, fold, spread, table, texts
from tessella.llm.textkernel import find_words, hash_spans, mix64, ngram_valid

#: Most labelled rows that the model is fitted on.
FIT_ROWS = 12_000
BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 12.0, 0.1, 3
#: Toxic texts are few, so each counts as so many others while learning.
POSITIVE_WEIGHT = 4.0
#: Scores from here on are predicted toxic.
THRESHOLD = 0.7
#: Labels are learned from ids whose crc32 modulo FOLDS isn't HELD_OUT.
FOLDS, HELD_OUT = 3, 1
#: Bytes that may stand around a word without being part of it.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".,;:!?\"'()[]{}<>*#$%&|~-_/")] = True


@dataclass(frozen=True)
class Weights:
    """The slots whose weight isn't 0, ascending, their weights, and the bias (None: nothing was learned)."""

    slots: np.ndarray
    values: np.ndarray
    bias: float | None

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.slots] = self.values
        return dense


def features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs, each once, ascending by row; only ``wanted`` slots if given."""
    words = find_words(raw, offsets)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        end -= _MARKS[raw[end - 1]] & (end - start > 1) if len(end) else 0
        start += _MARKS[raw[start]] & (end - start > 1) if len(start) else 0
    hashes = hash_spans(raw, start, end, lower=True)
    row, n = words.row, len(hashes)
    keys = [(row, hashes)]
    for gap, seed in ((1, 0x51ED270B), (2, 0x2545F491)):
        valid = ngram_valid(words.first, gap + 1, n)
        if len(valid):
            left, right = hashes[: n - gap][valid], hashes[gap:][valid]
            keys.append((row[: n - gap][valid], mix64(left * np.uint64(0xD1342543DE82EF95) + right + np.uint64(seed))))
    out_row, out_slot = [], []
    for r, h in keys:
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            hit = wanted[slot]
            r, slot = r[hit], slot[hit]
        out_row.append(r)
        out_slot.append(slot)
    both = np.unique((np.concatenate(out_row) << BITS) | np.concatenate(out_slot))
    return both >> BITS, both & ((1 << BITS) - 1)


def train(rows: list[np.ndarray], y: np.ndarray, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS, positive=POSITIVE_WEIGHT) -> Weights:
    """rows: the slots of each text.  The last coordinate is the bias, without L1."""
    if not len(y) or not 0 < y.sum() < len(y):
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), None)
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def current(at: np.ndarray) -> np.ndarray:
        zs, penalty = z[at], np.where(at == bias, 0.0, l1)
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            at = np.append(rows[i], bias)
            w = current(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]) * (positive if y[i] else 1.0)
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    everywhere = current(np.arange(size))
    slots = np.flatnonzero(everywhere[:-1])
    return Weights(slots, everywhere[slots].astype(np.float32), float(everywhere[-1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Weights:
    """Weights from at most ``rows`` labelled documents outside the held-out fold."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
        .orderBy(spread(F.col("doc_id")), "label")
        .limit(rows)
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in arrow_slices(batch):
            row, slot = features(raw, offsets)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(slot, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "label", "slots"])

    joined = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most `rows` rows of two numbers
    # An id with several texts or labels: the first `rows` by a total order, whichever task is first.
    found = arrow_map(joined, run, "doc_id long, label int, slots array<int>").orderBy(spread(F.col("doc_id")), "label", F.xxhash64("slots")).limit(rows).toArrow()
    ids, y = found["doc_id"].to_numpy(), found["label"].to_numpy().astype(float)
    slots = [np.asarray(x.values) for x in found["slots"]]
    order = sorted(range(len(y)), key=lambda i: (ids[i], y[i], len(slots[i])))
    return train([slots[i] for i in order], y[order])


def scores(raw: np.ndarray, offsets: np.ndarray, weights: Weights, dense: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    if weights.bias is None:
        return np.zeros(rows)
    row, slot = features(raw, offsets, dense != 0)
    margin = weights.bias + np.bincount(row, dense[slot].astype(float), minlength=rows)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def score(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dense = weights.table()
        for part, raw, offsets in arrow_slices(batch):
            s = scores(raw, offsets, weights, dense)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = arrow_map(texts(docs), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_toxicity over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    weights = fit(docs, labels)

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        batch, dense = pa.RecordBatch.from_arrays([column], names=["text"]), weights.table()
        out = [scores(raw, offsets, weights, dense) < threshold for _, raw, offsets in arrow_slices(batch)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clean(F.col("text").cast("string")))
