"""Repeated passages from prefix-partitioned suffix trees.

A passage repeats if some window of ``WINDOW`` words occurs in two documents,
that is, if two suffixes of the corpus meet at a node of depth WINDOW or more
in its suffix tree.  The tree is never held as a whole; its nodes are named by
hashes of the words on their path, and it is cut up by prefixes of different
lengths:

1. A sparse tree first.  Every window picks, among its runs of ``PREFIX``
   words, the one with the smallest hash.  Equal windows pick equal runs, so
   the picked runs split all suffixes into groups and no repeat is torn apart.
   Windows of one document that pick the same run form a *region*; one row
   stands for its 18 windows on average.
2. In a group, the longest paths are tried first: equal regions are one node,
   and every region but those of the smallest doc_id is a repeat as a whole.
   Where a group has one region only, that is all.
3. Only groups with different regions are opened further: the first document
   of each region sends its windows (in all others they are repeats already),
   and nodes of depth WINDOW that are reached from several documents are the
   remaining repeats.  A group of at most GROUP_REGIONS regions is one task's
   subtree; a larger one is split by the longest prefix, the window itself.

Neighbouring repeats merge into maximal ones.  Hot groups (a passage in a
third of all documents) are merged to a row per node within each batch before
they are shuffled, and joined back with skew handling.

Edge cases: null and empty texts have no words; a null doc_id has no smaller
or larger ids, so nothing is removed from it or because of it; rows that
repeat a doc_id aren't repeats of each other, and a span found in one of them
holds for the row it was found in (told apart by a hash of the text); an empty
table has no rows; columns of any other name are kept by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, arrow_slices, private, reliable, table, texts
from tessella.llm.textkernel import Words, find_words, hash_spans, mix64, ngram_hashes, window_hashes

WINDOW, PREFIX = 50, 16
#: Regions of a group that one task opens together.
GROUP_REGIONS = 2_000
_POSITION_BITS = 28


def _row_start_per_word(words: Words) -> np.ndarray:
    return np.repeat(words.first[:-1], np.diff(words.first))


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def regions(words: Words, hashes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(row, group, region, start in the row, windows) of every region."""
    count = len(hashes) - window + 1
    zero = np.zeros(0, np.int64)
    if count <= 0:
        return zero, zero, zero, zero, zero
    row_end = np.repeat(words.first[1:], np.diff(words.first))
    ok = row_end[:count] - np.arange(count) >= window
    grams = ngram_hashes(hashes, prefix)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    keys = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    picked = (_sliding_min(keys, window - prefix + 1)[:count] & low).astype(np.int64)
    at = np.flatnonzero(ok)
    if not len(at):
        return zero, zero, zero, zero, zero
    row = words.row[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (picked[at[1:]] != picked[at[:-1]]) | (row[1:] != row[:-1])
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(at)))
    start, row = at[head], row[head]
    gram_at = picked[start]
    # A region is named by its first and last windows and all between, the place of its run and its size.
    nodes = window_hashes(hashes, window)[at]
    total = np.add.reduceat(nodes * mix64(np.arange(len(at), dtype=np.uint64) - np.repeat(head, size).astype(np.uint64) + np.uint64(7)), head)
    region = mix64(total + mix64((gram_at - start).astype(np.uint64) * np.uint64(4099) + size.astype(np.uint64)))
    return row, grams[gram_at].view(np.int64), region.view(np.int64), start - words.first[row], size


def _words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = find_words(raw, offsets)
    return words, hash_spans(raw, words.start, words.end)


_KEY = ["doc_id", "text_id"]


def region_rows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Every region of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in arrow_slices(batch):
            row, group, region, start, size = regions(*_words_of(raw, offsets), window, prefix)
            ids = part.select(_KEY).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(group), pa.array(region), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=[*_KEY, "group", "region", "start", "windows"])

    return arrow_map(docs, run, "doc_id long, text_id int, group long, region long, start int, windows int")


def region_nodes(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(group, region, low, high): the distinct regions of each batch, with the smallest and largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part, raw, offsets in arrow_slices(batch):
                row, group, region, _, _ = regions(*_words_of(raw, offsets), window, prefix)
                found.append((np.asarray(part.column(0))[row], group, region))
            if not found:
                continue
            doc_id, group, region = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((region, group))
            doc_id, group, region = doc_id[order], group[order], region[order]
            if not len(order):
                continue
            head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (region[1:] != region[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group[head], region[head], np.minimum.reduceat(doc_id, head), np.maximum.reduceat(doc_id, head))], names=["group", "region", "low", "high"])

    return docs.mapInArrow(run, "group long, region long, low long, high long")


def node_rows(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of the wanted regions (doc_id, text_id, spans): a row for each region, or, of hot groups, for each window."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in arrow_slices(batch):
            words, hashes = _words_of(raw, offsets)
            nodes = window_hashes(hashes, window).view(np.int64)
            spans = part.column(part.schema.get_field_index("spans"))
            owner = np.repeat(np.arange(part.num_rows), np.asarray(spans.value_lengths()))
            flat = spans.flatten()
            start, size = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("windows")).astype(np.int64)
            group, hot = np.asarray(flat.field("group")), flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            first = words.first[owner] + start
            cold = np.flatnonzero(~hot)
            blobs = [nodes[a : a + n].tobytes() for a, n in zip(first[cold].tolist(), size[cold].tolist(), strict=True)]
            yield _nodes(part, owner[cold], group[cold], start[cold], blobs, False)
            if hot.any():
                n = size[hot]
                at = np.repeat(start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = np.repeat(owner[hot], n)
                yield _nodes(part, rows, nodes[words.first[rows] + at], at, [None] * len(at), True)

    joined = docs.hint("shuffle_hash").join(wanted.hint("shuffle_hash"), _KEY).select(*_KEY, "spans", "text")
    return arrow_map(joined, run, "doc_id long, text_id int, group long, start int, nodes binary, hot boolean")


def _nodes(part: pa.RecordBatch, rows: np.ndarray, group: np.ndarray, start: np.ndarray, blobs: list, hot: bool) -> pa.RecordBatch:
    ids = part.select(_KEY).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*ids.columns, pa.array(group, pa.int64()), pa.array(start, pa.int32()), pa.array(blobs, pa.binary()), pa.array(np.full(len(rows), hot))], names=[*_KEY, "group", "start", "nodes", "hot"])


def subtree(doc_id: np.ndarray, nodes: list[np.ndarray]) -> list[np.ndarray]:
    """For each of a group's regions, which of its windows also start in a document with a smaller doc_id."""
    sizes = [len(n) for n in nodes]
    flat, owner = np.concatenate(nodes), np.repeat(doc_id, sizes)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    head = np.append(True, flat[1:] != flat[:-1])
    lowest = owner[head][np.cumsum(head) - 1]
    out = np.empty(len(flat), dtype=bool)
    out[order] = owner > lowest
    return np.split(out, np.cumsum(sizes)[:-1])


def _open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> the repeated spans of each group's regions."""
    held: list[tuple] = []

    def close() -> Iterator[tuple]:
        if len({h[0] for h in held}) < 2:
            return
        for (doc_id, text_id, _, start, _), hit in zip(held, subtree(np.array([h[0] for h in held]), [np.frombuffer(h[4], dtype=np.int64) for h in held]), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield doc_id, text_id, start + a, b - a

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*_KEY, "start", "windows"])

    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            if held and row[2] != held[0][2]:
                found += close()
                held = []
            held.append(row)
        yield table_of(found)
    if held:
        yield table_of(list(close()))


def _named(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_id", F.hash("text"))


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, text_id, spans: the windows (start, windows) of each document that also start in one with a smaller doc_id."""
    spark, named = docs.sparkSession, _named(docs).where("doc_id is not null")
    # One exchange, by group: all that follows until `useful` needs no other.
    dealt = region_nodes(named, window, prefix).repartition("group")
    nodes = dealt.groupBy("group", "region").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    groups = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("regions"), F.min("low").alias("first"), F.max("low").alias("last"), F.max("high").alias("end"))
    groups = groups.where("first < end").select("group", "regions", (F.col("first") < F.col("last")).alias("open"))
    useful = nodes.join(groups, "group").where("low < high or open")
    useful = reliable(spark, useful.select("group", "region", "low", "open", (F.col("regions") > GROUP_REGIONS).alias("hot")))

    rows = region_rows(named, window, prefix)
    hits = rows.join(useful, ["group", "region"]).where("doc_id > low or open")
    hits = reliable(spark, hits.select(*_KEY, "start", "windows", "group", "hot", (F.col("doc_id") > F.col("low")).alias("whole")))
    whole = hits.where("whole").select(*_KEY, "start", "windows")
    wanted = hits.where("not whole").groupBy(*_KEY).agg(F.collect_list(F.struct("start", "windows", "group", "hot")).alias("spans"))
    opened = node_rows(named, wanted, window)
    cold = opened.where("not hot").repartition("group").sortWithinPartitions("group").mapInArrow(_open_groups, "doc_id long, text_id int, start int, windows int")
    hot = opened.where("hot").select(*_KEY, F.col("group").alias("node"), "start")
    shared = hot.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("node", "low")
    single = hot.join(shared, "node").where("doc_id > low").select(*_KEY, "start", F.lit(1).alias("windows"))
    return whole.unionAll(cold).unionAll(single).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def covered(n_words: int, spans: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which of a document's words lie in the windows of ``spans``."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[min(n_words, s["start"] + s["windows"] - 1 + window)] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    found = repeats(docs, window)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, _, _ in arrow_slices(batch):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column(2).cast(pa.large_binary()).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if spans:
                    stays = ~covered(len(words), spans, window)
                    words = list(compress(words, stays.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "text_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, text_id int, n_words long, n_removed long, kept string"
    named = _named(docs)
    # The same rows as in `repeats`, so that their exchange is used twice.
    known = named.where("doc_id is not null").hint("shuffle_hash").join(found.hint("shuffle_hash"), _KEY, "left").select(*_KEY, "text", "spans")
    nameless = named.where("doc_id is null").select(*_KEY, "text", F.lit(None).cast("array<struct<start:int,windows:int>>").alias("spans"))
    return arrow_map(known, run, schema).unionAll(arrow_map(nameless, run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_repeated_passages over all of ``documents``."""
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def digest(text: str | None) -> str:
    """What the query's kept_sha256 is for a text of which nothing is removed."""
    return hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest()


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its repeats taken out of text (and n_chars); texts without any stay as they are."""
    own_id, own_text, kept = private(docs, "id", "text", "kept")
    out = remove(docs, window).where("n_removed > 0").select(F.col("doc_id").alias(own_id), F.col("text_id").alias(own_text), F.col("kept").alias(kept))
    named = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_text, F.hash(F.col("text").cast("string")))
    joined = named.hint("shuffle_hash").join(out.dropDuplicates([own_id, own_text]).hint("shuffle_hash"), [own_id, own_text], "left")
    values = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))
