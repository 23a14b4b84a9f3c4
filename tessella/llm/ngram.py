"""Perplexity under an interpolated modified Kneser-Ney model of word pairs.

Counting and scoring are two sides of one exchange.  Documents are dealt into
*chunks* of about ``CHUNK_BYTES`` of text.  A chunk asks for each distinct word
and pair that it holds, once, and adds its training counts to the question.
Questions go to *shards* by the hash of the pair's first word (of a very
frequent first word: of the second, so that no shard gets more than its part).
A shard merges them into sorted hash arrays, which it maps into memory to look
up the answers: in the order of the questions, so they need no keys.

    chunk --words, pairs, counts--> shard: sums; followers and predecessors of words
          --> shard of the word: what is known of each word --> chunk: scores

So the model is spread over the cluster, every number is looked up once for
each chunk, and no task holds more than one chunk or shard.

Words are named by 48-bit hashes.  Probabilities sum to 1 over the vocabulary
of the training texts, their closing token and one unknown word.

Edge cases: a null or empty text is its closing token alone; a null doc_id is
in the training part; without training texts every score is 0.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, arrow_slices, fold, reliable, spread, table, texts
from tessella.llm.textkernel import find_words, hash_spans, mix64

#: Text in one chunk.  Larger chunks repeat fewer questions and need more memory.
CHUNK_BYTES = 32 << 20
#: Texts of so many bytes are packed at a time on their way to their chunks.
_BUFFER_BYTES = 24 << 20
#: Ranges of values that are sorted one after another, and pairs that are scored at a time.
_RANGES, _SCORED = 8, 1 << 19
#: Scores are learned from ids whose crc32 modulo FOLDS isn't HELD_OUT.
FOLDS, HELD_OUT = 7, 2
#: A first word is frequent (its pairs are dealt by the second) if it has such a share of a sample of texts.
SAMPLE_ROWS, FREQUENT = 1_000, 1 / 500
END, START = np.uint64(1), np.uint64(2)
_SHIFT = np.uint64(16)


# ---- compact columns


def _put48(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _get48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _put(a: np.ndarray) -> bytes:
    """Mostly small numbers: a byte each; those of 255 or more follow as 8 bytes."""
    a = np.asarray(a, dtype=np.int64)
    return len(a).to_bytes(8, "little") + np.minimum(a, 255).astype(np.uint8).tobytes() + a[a >= 255].astype("<i8").tobytes()


def _get(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    out = np.frombuffer(b, dtype=np.uint8, count=n, offset=8).astype(np.int64)
    out[out == 255] = np.frombuffer(b, dtype="<i8", offset=8 + n)
    return out


# ---- distinct values


def _ranges(values: np.ndarray, top: int):
    """Where the values of one range after another are, in ascending order of the ranges; all lie below ``top``."""
    step = -(-top // _RANGES)
    for low in range(0, top, step):
        yield np.flatnonzero((values >= low) & (values <= min(low + step, top) - 1))


def distinct(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and the place of each value among them; sorting all at once would take several times their memory."""
    place, found, n = np.empty(len(values), np.int32), [values[:0]], 0
    for at in _ranges(values, top):
        part, inverse = np.unique(values[at], return_inverse=True)
        place[at] = inverse + n
        found.append(part)
        n += len(part)
    return np.concatenate(found), place


# ---- a chunk


@dataclass
class Chunk:
    """The tokens of some texts and their distinct words and pairs, in an order that depends on nothing else."""

    doc_id: pa.Array
    held_out: np.ndarray
    first: np.ndarray  # of each text's tokens
    words: np.ndarray  # ascending
    word_of: np.ndarray  # token -> its place in words
    word_count: np.ndarray  # in training texts
    pair_left: np.ndarray  # places in words, ascending
    pair_right: np.ndarray
    pair_of: np.ndarray  # token -> its place among the pairs
    pair_count: np.ndarray


def read_chunk(blobs: list[bytes]) -> Chunk:
    parts = sorted(blobs)  # the order in which they arrive isn't fixed
    ids, held, tokens, sizes = [], [], [], []
    for blob in parts:
        for batch in pa.ipc.open_stream(blob):
            for part, raw, offsets in arrow_slices(batch):
                words = find_words(raw, offsets)
                hashes = np.maximum(hash_spans(raw, words.start, words.end, lower=True) >> _SHIFT, np.uint64(3))
                tokens.append(np.insert(hashes, words.first[1:], END))
                sizes.append(np.diff(words.first) + 1)
                ids.append(part.column(0))
                held.append(np.asarray(part.column(2).to_numpy(zero_copy_only=False), dtype=bool))
    token, size = np.concatenate(tokens), np.concatenate(sizes)
    del tokens
    held_out, first = np.concatenate(held), np.concatenate([[0], np.cumsum(size)])
    words, word_of = distinct(token, 1 << 48)
    del token
    start = int(np.searchsorted(words, START))
    words = np.insert(words, start, START)
    word_of[word_of >= start] += 1
    trains = np.repeat(~held_out, size)
    key = np.empty(len(word_of), np.int64)
    key[1:] = word_of[:-1]
    key[first[:-1]] = start
    key *= len(words)
    key += word_of
    pairs, pair_of = distinct(key, len(words) ** 2)
    del key
    left, right = (x.astype(np.int32) for x in np.divmod(pairs, len(words)))
    del pairs
    return Chunk(
        pa.concat_arrays(ids), held_out, first, words, word_of,
        np.bincount(word_of[trains], minlength=len(words)),
        left, right, pair_of,
        np.bincount(pair_of[trains], minlength=len(left)),
    )


def shard_of_words(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(words) % np.uint64(shards)).astype(np.int64)


def shard_of_pairs(chunk: Chunk, shards: int, frequent: np.ndarray) -> np.ndarray:
    by_word = shard_of_words(chunk.words, shards)
    often = np.isin(chunk.words, frequent)[chunk.pair_left]
    return np.where(often, by_word[chunk.pair_right], by_word[chunk.pair_left])


_MESSAGE = "dest int, kind string, source int, a binary, b binary, c binary, d binary"


def _messages(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4]
    names = ["dest", "kind", "source", "a", "b", "c", "d"]
    rows = [r + (None,) * (7 - len(r)) for r in rows]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def ask(chunk: Chunk, source: int, shards: int, frequent: np.ndarray) -> list[tuple]:
    """What a chunk sends to the shards."""
    rows = []
    where = shard_of_words(chunk.words, shards)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(shards + 1))
    for s in range(shards):
        if len(at := order[bounds[s] : bounds[s + 1]]):
            rows.append((s, "word", source, _put48(chunk.words[at]), _put(chunk.word_count[at])))
    where = shard_of_pairs(chunk, shards, frequent)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(shards + 1))
    for s in range(shards):
        if len(at := order[bounds[s] : bounds[s + 1]]):
            left = chunk.pair_left[at]
            head = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
            rows.append((s, "pair", source, _put48(chunk.words[left[head]]), _put(np.diff(np.append(head, len(left)))), _put48(chunk.words[chunk.pair_right[at]]), _put(chunk.pair_count[at])))
    return rows


# ---- shards


class Mapped:
    """Sorted hashes and their counts in a file that is mapped into memory and deleted with the object."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.n = len(hashes)
        handle, self._path = tempfile.mkstemp(prefix="tessella-shard-")
        with os.fdopen(handle, "wb") as f:
            f.write(hashes.astype("<u8").tobytes())
            f.write(counts.astype("<i8").tobytes())
        self.hashes = np.memmap(self._path, dtype="<u8", mode="r", shape=(self.n,)) if self.n else np.zeros(0, np.uint64)
        self.counts = np.memmap(self._path, dtype="<i8", mode="r", shape=(self.n,), offset=8 * self.n) if self.n else np.zeros(0, np.int64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Counts; every hash is there, for it was asked for."""
        return self.counts[np.searchsorted(self.hashes, hashes)]

    def __enter__(self) -> Mapped:
        return self

    def __exit__(self, *_) -> None:
        del self.hashes, self.counts
        os.unlink(self._path)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * np.uint64(0xD1342543DE82EF95) + mix64(right))


def merge_pairs(rows: list[dict], shards: int) -> list[tuple]:
    """Answers for the pairs that a shard was asked for, and what they tell about their words."""
    asked = sorted((r for r in rows if r["kind"] == "pair"), key=lambda r: r["source"])
    out = [(r["dest"], "word", r["source"], r["a"], r["b"]) for r in rows if r["kind"] == "word"]
    if not asked:
        return out
    of_left = lambda r: np.repeat(_get48(r["a"]), _get(r["b"]))
    left = np.concatenate([of_left(r) for r in asked])
    right = np.concatenate([_get48(r["c"]) for r in asked])
    counts = np.concatenate([_get(r["d"]) for r in asked])
    of = pair_hashes(left, right)
    found = [], [], [], []
    for at in _ranges(of, 1 << 64):
        part, index, inverse = np.unique(of[at], return_index=True, return_inverse=True)
        for to, x in zip(found, (part, np.bincount(inverse, counts[at], len(part)).astype(np.int64), left[at[index]], right[at[index]]), strict=True):
            to.append(x)
    del of, left, right, counts
    hashes, total, left, right = (np.concatenate(x) for x in found)
    del found
    me = rows[0]["dest"]
    with Mapped(hashes, total) as model:
        del hashes
        for r in asked:
            out.append((r["source"], "pairs", me, _put(model.look_up(pair_hashes(of_left(r), _get48(r["c"]))))))
    seen = total > 0
    left, right, total = left[seen], right[seen], total[seen]
    words, inverse = np.unique(left, return_inverse=True)
    kinds = [np.bincount(inverse, total == 1, len(words)), np.bincount(inverse, total == 2, len(words)), np.bincount(inverse, total > 2, len(words))]
    starts = np.bincount(inverse, total, len(words))
    preceded, times = np.unique(right, return_counts=True)
    where, where_preceded = shard_of_words(words, shards), shard_of_words(preceded, shards)
    for s in range(shards):
        w, p = where == s, where_preceded == s
        if w.any():
            out.append((s, "after", me, _put48(words[w]), _put(starts[w]), _put(np.concatenate([k[w] for k in kinds]))))
        if p.any():
            out.append((s, "before", me, _put48(preceded[p]), _put(times[p])))
    out.append((-1, "pair totals", me, _put(np.array([(total == i).sum() for i in (1, 2, 3, 4)] + [len(total)]))))
    return out


def merge_words(rows: list[dict]) -> list[tuple]:
    """Answers for the words of a shard: count, predecessors, times as a first word, followers by their counts."""
    kinds = {k: [r for r in rows if r["kind"] == k] for k in ("word", "after", "before")}
    out = [tuple(r[k] for k in ("dest", "kind", "source", "a", "b", "c", "d")) for r in rows if r["kind"] in ("pairs", "pair totals")]
    if not kinds["word"]:
        return out
    asked = [(r["source"], _get48(r["a"]), _get(r["b"])) for r in kinds["word"]]
    words = np.unique(np.concatenate([a for _, a, _ in asked]))
    facts = np.zeros((6, len(words)), dtype=np.int64)
    for _, a, n in asked:
        facts[0, np.searchsorted(words, a)] += n
    for r in kinds["before"]:
        facts[1, np.searchsorted(words, _get48(r["a"]))] += _get(r["b"])
    for r in kinds["after"]:
        at = np.searchsorted(words, _get48(r["a"]))
        facts[2, at] += _get(r["b"])
        facts[3:, at] += _get(r["c"]).reshape(3, -1)
    me = kinds["word"][0]["dest"]
    for source, a, _ in asked:
        out.append((source, "words", me, _put(facts[:, np.searchsorted(words, a)].ravel())))
    k, c = facts[1], facts[0]
    out.append((-1, "word totals", me, _put(np.array([*((k == i).sum() for i in (1, 2, 3, 4)), (k > 2).sum(), k.sum(), (c > 0).sum(), c.sum()]))))
    return out


# ---- scores


def discounts(n: np.ndarray) -> np.ndarray:
    """The modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:  # too little to estimate them from
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(float(np.clip(x, 0.05, i + 0.95)) for i, x in enumerate(d))])


def score_chunk(chunk: Chunk, pairs: np.ndarray, words: np.ndarray, pair_totals: np.ndarray, word_totals: np.ndarray) -> pa.Table:
    """pairs: the count of each pair; words: six facts of each word."""
    count, predecessors, starts, one, two, more = words
    d, e = discounts(pair_totals[:4]), discounts(word_totals[:4])
    kinds, vocabulary, total = max(int(word_totals[5]), 1), int(word_totals[6]), int(word_totals[7])
    spare = (e[1] * word_totals[0] + e[2] * word_totals[1] + e[3] * word_totals[4]) / kinds if vocabulary else 1.0
    lower = np.maximum(predecessors - e[np.minimum(predecessors, 3)], 0) / kinds + spare / (vocabulary + 1)
    some = np.maximum(starts, 1)
    weight = np.where(starts > 0, (d[1] * one + d[2] * two + d[3] * more) / some, 1.0)
    left, right = chunk.pair_left, chunk.pair_right
    of_pair = np.empty(len(pairs))
    for i in range(0, len(pairs), _SCORED):
        n, x, y = (a[i : i + _SCORED] for a in (pairs, left, right))
        of_pair[i : i + _SCORED] = np.log10(np.maximum(n - d[np.minimum(n, 3)], 0) / some[x] + weight[x] * lower[y])
    base = np.log10((count + 1) / (total + vocabulary + 1))
    at = chunk.first[:-1]
    known = np.add.reduceat((count > 0)[chunk.word_of], at, dtype=np.int64)
    return pa.table(
        {
            "doc_id": chunk.doc_id,
            "held_out": pa.array(chunk.held_out),
            "n_tokens": pa.array(np.diff(chunk.first)),
            "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(at), total)),
            "base_score": pa.array(np.add.reduceat(base[chunk.word_of], at)),
            "score": pa.array(np.add.reduceat(of_pair[chunk.pair_of], at)),
        }
    )


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- in Spark


def _deal(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, blob): the texts of each chunk, compressed on their way."""

    def run(batches):
        held, size = [], 0

        def flush():
            data = pa.Table.from_batches(held).combine_chunks()
            chunk = data["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            bounds = np.searchsorted(chunk[order], np.arange(chunks + 1))
            names, blobs = [], []
            for i in np.unique(chunk).tolist():
                sink = pa.BufferOutputStream()
                part = data.take(pa.array(order[bounds[i] : bounds[i + 1]])).select(["doc_id", "text", "held_out"]).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                names.append(i)
                blobs.append(sink.getvalue().to_pybytes())
                if sum(map(len, blobs)) > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])
                    names, blobs = [], []
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _BUFFER_BYTES:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    named = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).mapInArrow(run, "chunk int, blob binary")


def _frequent(docs: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Hashes of the most frequent words of a few texts.  What is found here only deals out the work."""

    def run(batch):
        for part, raw, offsets in arrow_slices(batch):
            words = find_words(raw, offsets)
            found, n = np.unique(hash_spans(raw, words.start, words.end, lower=True) >> _SHIFT, return_counts=True)
            often = n >= max(2, FREQUENT * n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(found[often].astype(np.int64)), pa.array(n[often]), pa.array(np.full(often.sum(), n.sum()))], names=["word", "n", "of"])

    sample = texts(docs).orderBy(spread(F.col("doc_id"), 9)).limit(rows)
    found = arrow_map(sample, run, "word long, n long, of long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).where(F.col("n") >= FREQUENT * F.col("of")).toArrow()
    return np.concatenate([found["word"].to_numpy().astype(np.uint64), [START]])


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The log10 probability of every text, and that of a unigram base."""
    spark = docs.sparkSession
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = shards = max(1, -(-size // chunk_bytes))
    frequent = _frequent(docs)
    dealt = _deal(docs, chunks)

    def asking(key, data):
        return _messages(ask(read_chunk(data["blob"].to_pylist()), key[0].as_py(), shards, frequent))

    def pairs(key, data):
        return _messages(merge_pairs(data.to_pylist(), shards))

    def words(key, data):
        return _messages(merge_words(data.to_pylist()))

    asked = dealt.groupBy("chunk").applyInArrow(asking, _MESSAGE)
    answers = asked.groupBy("dest").applyInArrow(pairs, _MESSAGE)
    # Answers for chunks pass the shards of words in groups of their own; they go on to the chunks as they are.
    to = F.when(F.col("kind").isin("pairs", "pair totals"), -2 - F.col("source")).otherwise(F.col("dest"))
    answers = reliable(spark, answers.withColumn("to", to).groupBy("to").applyInArrow(words, _MESSAGE))

    totals = {"pair totals": np.zeros(5, np.int64), "word totals": np.zeros(8, np.int64)}
    for r in answers.where("dest = -1").groupBy("kind").agg(F.collect_list("a").alias("a")).collect():  # a few numbers for each shard
        for a in r["a"]:
            totals[r["kind"]] += _get(a)

    def scoring(key, left, right):
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))
        chunk = read_chunk(left["blob"].to_pylist())
        of_pairs, of_words = np.zeros(len(chunk.pair_left), np.int64), np.zeros((6, len(chunk.words)), np.int64)
        where_pairs, where_words = shard_of_pairs(chunk, shards, frequent), shard_of_words(chunk.words, shards)
        for r in right.to_pylist():
            if r["kind"] == "pairs":
                of_pairs[where_pairs == r["source"]] = _get(r["a"])
            else:
                of_words[:, where_words == r["source"]] = _get(r["a"]).reshape(6, -1)
        return score_chunk(chunk, of_pairs, of_words, totals["pair totals"], totals["word totals"])

    replies = answers.where("dest >= 0").select(F.col("dest").alias("chunk"), "kind", "source", "a")
    return _deal(docs, chunks).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(scoring, _SCORE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_language_model over all of ``documents``."""
    return score(table(spark, sf_dir, "documents"))
