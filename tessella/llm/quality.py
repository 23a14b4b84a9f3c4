"""Quality rules: boosted trees over document statistics, with hard base rules.

Statistics come from whole texts, vectorised over Arrow batches; the trees are
fitted on the driver from at most ``FIT_ROWS`` labelled rows and travel to the
tasks inside the function, as a few thousand numbers.

Edge cases: a null text has no words (and fails the base rules); a null doc_id
is returned as it is; repeated rows are judged each on its own; without labels
of both classes there is no verdict beyond the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import gbdt
from tessella.llm.common import arrow_map, arrow_slices, spread, table, texts
from tessella.llm.textkernel import find_words, hash_spans, is_separator, mix64, ngram_hashes, ngram_valid

#: Most labelled rows that the trees are fitted on.
FIT_ROWS = 16_000
#: Documents whose probability of good quality is lower are rejected.
LEAST_PROBABILITY = 0.5
#: Base rules: fewest words, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bytes whose counts are taken together.
_BYTES = 1 << 20
SYMBOLS = b"#*$%&|<>"
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeated", "capitals", "digits", "exclamations", "pipes", "line_words", "beyond_ascii", "stops", "commas")
#: The verdict can't rise with more symbols, duplicate lines, repeated windows or exclamation marks.
MONOTONE = {2: -1, 3: -1, 4: -1, 7: -1}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[bounds])


def _byte_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte occurs in each row, a block of bytes at a time."""
    rows = len(offsets) - 1
    out = np.zeros(rows * 256, dtype=np.int64)
    for a in range(0, len(raw), _BYTES):
        part = raw[a : a + _BYTES]
        row = np.searchsorted(offsets, a, side="right") - 1
        last = np.searchsorted(offsets, a + len(part), side="left")
        sizes = np.diff(np.clip(offsets[row : last + 1], a, a + len(part)))
        key = np.repeat(np.arange(len(sizes), dtype=np.int64) * 256, sizes) + part
        found = np.bincount(key, minlength=len(sizes) * 256)
        out[row * 256 : row * 256 + len(found)] += found
    return out.reshape(rows, 256)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The exact counts of each row, and its features (rows by features)."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    words = find_words(raw, offsets)
    n_words = np.diff(words.first)
    hist = _byte_counts(raw, offsets)
    continuation = hist[:, 0x80:0xC0].sum(1)
    separators = hist[:, 0x20] + hist[:, 0x09:0x0E].sum(1)
    points = sizes - continuation

    breaks = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))
    line_start, line_end = breaks[:-1], breaks[1:]
    line_end = line_end - (raw[line_end - 1] == 10) if len(line_end) else line_end
    worded = np.searchsorted(words.start, line_start) < np.searchsorted(words.start, line_end)
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    salt = mix64(np.arange(1, rows + 1, dtype=np.uint64))
    lines = (hash_spans(raw, line_start, line_end) ^ salt[line_row])[worded] if len(line_start) else np.zeros(0, np.uint64)
    line_row = line_row[worded] if len(line_start) else line_row
    _, first_seen = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_row, minlength=rows)
    n_dup_lines = n_lines - np.bincount(line_row[first_seen], minlength=rows)

    hashes = hash_spans(raw, words.start, words.end)
    word_row = words.row
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    valid = ngram_valid(words.first, 3, len(hashes))
    at = np.flatnonzero(valid)
    if len(at):
        grams = ngram_hashes(hashes, 3)[at] ^ salt[word_row[at]]
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + 3, 1)
    n_repeat = _per_row(np.cumsum(covered[:-1]) > 0, words.first)

    counts = {
        "n_words": n_words,
        "word_chars": points - separators,
        "n_symbols": hist[:, list(SYMBOLS)].sum(1),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
    }
    some, letters = np.maximum(n_words, 1), np.maximum(hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1), 1)
    features = np.stack(
        [
            np.log1p(n_words),
            counts["word_chars"] / some,
            counts["n_symbols"] / some,
            n_dup_lines / np.maximum(n_lines, 1),
            n_repeat / some,
            hist[:, 65:91].sum(1) / letters,
            hist[:, 48:58].sum(1) / some,
            hist[:, 33] / some,
            hist[:, 124] / some,
            n_words / np.maximum(n_lines, 1),
            continuation / np.maximum(points, 1),
            (hist[:, 46] + hist[:, 63]) / some,
            hist[:, 44] / some,
        ],
        axis=1,
    )
    return counts, features


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part, raw, offsets in arrow_slices(batch):
        _, x = statistics(raw, offsets)
        yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> gbdt.Trees:
    """Trees from at most ``rows`` labelled documents, those with the smallest hashes of their ids."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .orderBy(spread(F.col("doc_id")), "label")
        .limit(rows)
    )
    joined = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most `rows` rows of two numbers
    # An id with several texts or labels: the first `rows` by a total order, whichever task is first.
    found = arrow_map(joined, _features, "doc_id long, label int, x array<double>").orderBy(spread(F.col("doc_id")), "label", "x").limit(rows).toArrow()
    if not found.num_rows:
        return gbdt.fit(np.zeros((0, len(FEATURES))), np.ones(0))
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = found["label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return gbdt.fit(x[order], y[order], MONOTONE)


def judge(docs: DataFrame, model: gbdt.Trees, least: float = LEAST_PROBABILITY) -> DataFrame:
    """doc_id, the exact counts, base_failed, score (probability of good quality), kept."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in arrow_slices(batch):
            counts, x = statistics(raw, offsets)
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            score = model.probability(x) if len(model.roots) else np.ones(len(x))
            columns = [part.column(0), *(pa.array(counts[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return arrow_map(texts(docs), run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_quality_rules over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    model = fit(docs, labels)
    keep = verdict_udf(model)
    return docs.where(keep(F.col("text").cast("string")))


def verdict_udf(model: gbdt.Trees, least: float = LEAST_PROBABILITY):
    """A filter for texts; rows needn't be joined back to their verdicts."""

    @F.arrow_udf("boolean")
    def keep(column: pa.Array) -> pa.Array:
        batch, out = pa.RecordBatch.from_arrays([column], names=["text"]), []
        for _, raw, offsets in arrow_slices(batch):
            counts, x = statistics(raw, offsets)
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            out.append(~failed & ((model.probability(x) if len(model.roots) else np.ones(len(x))) >= least))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return keep
