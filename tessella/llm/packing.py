"""Packing token sequences: non-negative least squares over length combinations.

1. Every document is tokenised once.  Its full windows are sequences as they
   are; only the length of what is left over (the *tail*) matters further, and
   the histogram of tails has at most WINDOW - 1 numbers, whatever the corpus.
2. Shallow combinations (two or three lengths that fill a window) are the
   columns of a least-squares problem: how often must each be used so that the
   histogram is used up?  Solved with non-negative counts, rounded down.
3. What rounding leaves is packed greedily, length by length; what doesn't fit
   so is laid end to end and cut at the windows' ends.  So every sequence is
   full up to ``SLACK`` tokens, but for the last.
4. The plan is a list of (length, ranks from-to, sequence, offset).  A tail
   finds its place by its rank among those of its length, computed in Spark.

The plan has at most a few thousand entries and is made on the driver from the
histogram.  Ranks are counted in salted groups, so one very common length is
spread over many tasks.  Only documents that are cut are tokenised again.

Edge cases: a null or empty text has one token, the closing one; rows that
repeat a doc_id are packed each on its own (equal rows are interchangeable);
an empty table has no sequences.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import arrow_map, arrow_slices, reliable, spread, table, texts

VOCABULARY = "word_bpe_49k.json"
WINDOW, CLOSING_ID = 2048, 1
#: Most padding in a sequence that the greedy step accepts.
SLACK = 8
#: Steps between the lengths that combinations of three are made of.
STRIDE = 16
ROUNDS = 400
#: Most words in a worker's cache.
CACHE = 1_000_000
#: Code points below this are cut into parts and lower-cased by a table; words with others go to the library.
_PLAIN = 0x180
_NONE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair encoding of many words at once, a merge in every part at a time.

    Holds for vocabularies that mark a part's last symbol, lower-case, and cut
    words into runs of letters, single digits, and runs of marks.
    """

    def __init__(self, spec: dict):
        vocabulary, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        plain = byte_characters()
        self.inner = np.array([vocabulary[c] for c in plain], dtype=np.int64)
        self.last = np.array([vocabulary[c + end] for c in plain], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], dtype=np.uint64) for i in (0, 1))
        cut = len(end)
        made = [vocabulary[(x[:-cut] if x.endswith(end) and not y else x) + y] for x, y in pairs]
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, _NONE, dtype=np.int32)
        self.made = np.array([*made, 0], dtype=np.int64)
        for r, (key, slot) in enumerate(zip(((left << np.uint64(16)) | right).tolist(), self._slot((left << np.uint64(16)) | right).tolist(), strict=True)):
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] < 0:
                self.keys[slot], self.rank[slot] = key, r
        # 0: the library's; 1 letters, 2 digits, 3 marks.
        self.kind = np.zeros(_PLAIN, dtype=np.uint8)
        self.lower = np.arange(_PLAIN, dtype=np.uint32)
        for i in range(33, _PLAIN):
            c = chr(i)
            if 0x7F <= i <= 0xA0 or c == "'" or len(c.lower()) > 1 or ord(c.lower()) >= _PLAIN:
                continue
            self.kind[i] = 1 if c.isalpha() else 2 if unicodedata.category(c)[0] == "N" else 3
            self.lower[i] = ord(c.lower())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE if it doesn't merge."""
        key = (left << 16) | right
        slot = self._slot(key.view(np.uint64))
        found = self.keys[slot]
        out = np.where(found == key, self.rank[slot], _NONE)
        look = np.flatnonzero((found != key) & (found >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[look]]
            hit = found == key[look]
            out[look[hit]] = self.rank[slot[look[hit]]]
            look = look[~hit & (found >= 0)]
        return out

    def merged(self, symbol: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of parts (part numbers ascend) after all merges, with their parts."""
        done_symbol, done_part = [], []
        rank = np.full(len(symbol), _NONE, dtype=np.int32)
        rank[:-1] = np.where(part[1:] == part[:-1], self.ranks(symbol[:-1], symbol[1:]), _NONE)
        while len(symbol):
            head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(head, len(part)))
            least = np.minimum.reduceat(rank, head)
            going = np.repeat(least != _NONE, size)
            done_symbol.append(symbol[~going])
            done_part.append(part[~going])
            at = np.flatnonzero((rank == np.repeat(least, size)) & going)
            at = at[np.append(True, part[at[1:]] != part[at[:-1]])] if len(at) else at  # the leftmost of each part
            symbol[at] = self.made[rank[at]]
            stays = going
            stays[at + 1] = False
            # Only pairs at the merged symbol have changed.
            moved = np.cumsum(stays) - 1
            at = moved[at]
            symbol, part, rank = symbol[stays], part[stays], rank[stays]
            for i in (at, at[at > 0] - 1):
                inside = i[i + 1 < len(symbol)]
                rank[i] = _NONE
                rank[inside] = np.where(part[inside] == part[inside + 1], self.ranks(symbol[inside], symbol[inside + 1]), _NONE)
        symbol, part = np.concatenate([*done_symbol, np.zeros(0, np.int64)]), np.concatenate([*done_part, np.zeros(0, np.int64)])
        order = np.argsort(part, kind="stable")
        return symbol[order], part[order]

    def encode(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word as little-endian 16-bit numbers; None for those that only the library can cut."""
        if not words:
            return []
        point = np.frombuffer(" ".join(words).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), size)
        point = point[np.arange(len(word)) + word]  # without the blanks
        kind = np.where(point < _PLAIN, self.kind[np.minimum(point, _PLAIN - 1)], 0)
        plain = np.ones(len(words), dtype=bool)
        plain[word[kind == 0]] = False
        keep = plain[word]
        word, kind, point = word[keep], kind[keep], self.lower[np.minimum(point[keep], _PLAIN - 1)]
        fresh = np.ones(len(word), dtype=bool)
        fresh[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        part = np.cumsum(fresh) - 1
        wide = (point >= 0x80).astype(np.int64)
        place = np.arange(len(point)) + np.cumsum(wide)  # of each code point's last byte
        symbol = np.empty(len(point) + int(wide.sum()), dtype=np.int64)
        two = wide.astype(bool)
        symbol[place[two] - 1] = self.inner[0xC0 | (point[two] >> 6)]
        byte = np.where(two, 0x80 | (point & 0x3F), point)
        ends = np.append(fresh[1:], True) if len(fresh) else fresh
        symbol[place] = np.where(ends, self.last[byte], self.inner[byte])
        of_word = word[fresh]
        ids, part = self.merged(symbol, np.repeat(part, 1 + wide))
        count = np.bincount(of_word[part], minlength=len(words)) if len(part) else np.zeros(len(words), np.int64)
        blob, edge = ids.astype("<u2").tobytes(), np.concatenate([[0], np.cumsum(2 * count)]).tolist()
        return [blob[a:b] if p else None for a, b, p in zip(edge[:-1], edge[1:], plain.tolist(), strict=True)]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Tokens:
    """Ids of whole texts by a word-level cache over a tokenizer that drops white space.

    The tokenizer lower-cases and never joins what white space parts, so words
    can be encoded one by one: those of plain letters, digits and marks by
    :class:`Merges`, all others by the library itself.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f))
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.most = cache

    def _learn(self, words: list[bytes]) -> None:
        text = [w.decode() for w in words]
        found = self.merges.encode(text)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([text[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype="<u2").tobytes()
        self.known.update(zip(words, found, strict=True))

    def encode(self, column: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text (UTF-8), with the closing id."""
        out: list[np.ndarray | None] = []
        waits, missing = [], set()
        get, close = self.known.get, np.array([CLOSING_ID], dtype="<u2").tobytes()
        if len(self.known) > self.most:
            self.known.clear()
        for text in column:
            low = (text or b"").lower()
            if b"<|" in low and any(s in low for s in self.special):  # only exact special tokens count: as the library finds them
                ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
                out.append(np.array([*ids, CLOSING_ID], dtype="<u4"))
                continue
            words = low.split()
            found = list(map(get, words))
            if lacks := list(compress(range(len(words)), map(not_, found))):
                missing.update(words[i] for i in lacks)
                waits.append((len(out), words, found, lacks))
                out.append(None)
            else:
                out.append(np.frombuffer(b"".join(found) + close, dtype="<u2").astype("<u4"))
        if missing:
            self._learn(list(missing))
        for at, words, found, lacks in waits:
            for i in lacks:
                found[i] = self.known[words[i]]
            out[at] = np.frombuffer(b"".join(found) + close, dtype="<u2").astype("<u4")
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One for each worker process."""
    return Tokens(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- the plan


def combinations(present: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Rows of three lengths (0: unused) that fill a window, all of which occur."""
    lengths = np.flatnonzero(present)
    pairs = lengths[(lengths * 2 <= window) & (lengths > 0)]
    pairs = pairs[present[window - pairs]]
    two = np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)
    grid = lengths[(lengths % stride == 0) & (lengths * 3 <= window)]
    a, b = np.meshgrid(grid, lengths[lengths % stride == 0], indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c)
    ok[ok] = present[c[ok]]
    return np.concatenate([two, np.stack([a[ok], b[ok], c[ok]], axis=1)])


def solve_counts(columns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with the least squared difference between what x uses of each length and the histogram.

    Accelerated projected gradient; a column has three entries, so a step
    costs a few additions a column.
    """
    if not len(columns):
        return np.zeros(0)
    used = columns > 0
    scale = 1.0 / np.sqrt(np.maximum(histogram, 1.0))  # relative errors: rare lengths count too
    weight = scale[columns] * used
    target = histogram * scale

    def apply(x):
        return np.bincount(columns.ravel(), (weight * x[:, None]).ravel(), minlength=len(histogram))

    def back(r):
        return (weight * r[columns]).sum(1)

    probe = np.ones(len(columns))
    for _ in range(20):
        probe = back(apply(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        fresh = np.maximum(0.0, y - back(apply(y) - target) / (norm * 1.01))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = fresh + (t - 1) / t_next * (fresh - x)
        x, t = fresh, t_next
    return x


@dataclass
class Plan:
    """Where the tails of each length go, by their ranks; arrays of one entry for each slot of a pattern."""

    length: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)  # first rank
    base: list[int] = field(default_factory=list)  # sequence of the first rank, or place in the stream
    offset: list[int] = field(default_factory=list)  # place in the sequence; -1: the stream
    sequences: int = 0  # so many sequences of patterns; the stream's follow
    stream: int = 0  # tokens in the stream

    def add(self, length: int, low: int, base: int, offset: int) -> None:
        for name, value in (("length", length), ("low", low), ("base", base), ("offset", offset)):
            getattr(self, name).append(int(value))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted by (length, first rank)."""
        order = np.lexsort([self.low, self.length])
        return tuple(np.array(x, dtype=np.int64)[order] for x in (self.length, self.low, self.base, self.offset))


def make_plan(histogram: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> Plan:
    """histogram[n]: how many tails of n tokens there are, n from 0 to window (a full window is a pattern of its own)."""
    left, taken, plan = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64), Plan()

    def use(lengths: list[int], times: int) -> None:
        at = 0
        for n in lengths:
            plan.add(n, taken[n], plan.sequences, at)
            taken[n] += times
            left[n] -= times
            at += n
        plan.sequences += times

    if left[window]:
        use([window], int(left[window]))
    columns = combinations(left > 0, window)
    counts = np.floor(solve_counts(columns, histogram * (np.arange(len(histogram)) < window)) + 1e-6).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        lengths = [int(n) for n in columns[i] if n]
        times = int(min([counts[i], *(left[n] // lengths.count(n) for n in lengths)]))
        if times > 0:
            use(lengths, times)
    stream: list[tuple[int, int]] = []
    while left[1:].any():
        first = int(np.flatnonzero(left)[-1])
        pattern, room = [], window
        for n in np.flatnonzero(left)[::-1].tolist():
            if not n:
                break
            times = min(room // n, int(left[n]))
            pattern += [n] * times
            room -= n * times
        if room <= slack:
            use(pattern, min(int(left[n]) // pattern.count(n) for n in set(pattern)))
        else:
            stream.append((first, int(left[first])))
            left[first] = 0
    for n, times in stream:
        plan.add(n, taken[n], plan.stream, -1)
        plan.stream += n * times
    return plan


# ---- in Spark


def _measured(docs: DataFrame, name: str, window: int) -> DataFrame:
    """doc_id, text_id, doc_tokens and the checksums of the full windows and the tail."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = tokens(vocabulary_path(name))
        for part, _, _ in arrow_slices(batch):
            sizes, sums = [], []
            for ids in known.encode(part.column(2).cast(pa.large_binary()).to_pylist()):
                sizes.append(len(ids))
                sums.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, len(ids), window)])
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "text_id", "doc_tokens", "sums"])

    return arrow_map(_named(docs).select("doc_id", "text_id", "text"), run, "doc_id long, text_id long, doc_tokens long, sums array<long>")


def _named(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_id", F.xxhash64("text"))


#: So many cut pieces, some 100 bytes each, are sent to every worker; more are joined by a shuffle.
SENT_CUTS = 100_000

_PIECE = "doc_id long, text_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, name: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    measured = reliable(spark, _measured(docs, name, window))
    at = F.posexplode("sums").alias("i", "ids_crc32")
    pieces = measured.select("doc_id", "text_id", "doc_tokens", at).select("doc_id", "text_id", "doc_tokens", "ids_crc32", (F.col("i").cast("long") * window).alias("start"))
    pieces = pieces.withColumn("length", F.least(F.lit(window), F.col("doc_tokens") - F.col("start")))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_id", "start"), F.lit(_salts(spark))).cast("int"))

    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = reliable(spark, counts)
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["length"]] = r["n"]
    plan = make_plan(histogram, window)

    before = F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")
    ranked = pieces.withColumn("place", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "text_id", "start")))
    ranked = ranked.join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.select("doc_id", "text_id", "doc_tokens", "ids_crc32", "start", "length", (F.col("before") + F.col("place") - 1).alias("rank"))
    arrays, sequences = plan.arrays(), plan.sequences

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lengths, lows, bases, offsets = arrays
        ids, text, total, crc, start, length, rank = (batch.column(i) for i in range(7))
        n, r = np.asarray(length), np.asarray(rank)
        # Slots are sorted by (length, first rank); ranks stay below 2**48.
        slot = np.searchsorted((lengths << 48) | lows, (n << 48) | r, side="right") - 1
        ahead = r - lows[slot]
        streamed = offsets[slot] < 0
        begin = bases[slot] + ahead * n  # in the stream
        sequence = np.where(streamed, sequences + begin // window, bases[slot] + ahead)
        offset = np.where(streamed, begin % window, offsets[slot])
        yield pa.RecordBatch.from_arrays([ids, text, start, length, crc, total, pa.array(sequence), pa.array(offset)], names=["doc_id", "text_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = arrow_map(ranked, place, _PIECE)
    cut = F.col("offset") + F.col("length") > window
    placed = reliable(spark, placed.withColumn("cut", cut))
    whole = placed.where("not cut").drop("cut")
    again = placed.where("cut").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spans"))

    def divide(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = tokens(vocabulary_path(name))
        for part, _, _ in arrow_slices(batch):
            rows = []
            for ids, doc_id, text_id, spans in zip(known.encode(part.column(2).cast(pa.large_binary()).to_pylist()), part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                for s in spans:
                    first = window - s["offset"]
                    for start, length, sequence, offset in ((s["start"], first, s["sequence_id"], s["offset"]), (s["start"] + first, s["length"] - first, s["sequence_id"] + 1, 0)):
                        rows.append((doc_id, text_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset))
            names = ["doc_id", "text_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], names=names)

    key = [F.col("d.doc_id").eqNullSafe(F.col("c.own_id")), F.col("d.text_id") == F.col("c.own_text")]
    asked = again.select(F.col("doc_id").alias("own_id"), F.col("text_id").alias("own_text"), "spans")
    # Texts of few documents are fetched where they lie; only beyond the bound do all texts move to their pieces.
    few = placed.where("cut").limit(SENT_CUTS + 1).count() <= SENT_CUTS
    source, asked = (_named(docs).alias("d"), F.broadcast(asked).alias("c")) if few else (_named(docs).alias("d").hint("shuffle_hash"), asked.alias("c").hint("shuffle_hash"))
    joined = source.join(asked, key[0] & key[1]).select("doc_id", "text_id", "text", "spans")
    if _repeats(measured):
        joined = joined.dropDuplicates(["doc_id", "text_id"])
    return whole.unionByName(arrow_map(joined, divide, _PIECE)).drop("text_id")


def _repeats(measured: DataFrame) -> bool:
    """Whether a row occurs twice: then all its copies' pieces come back with one of them."""
    return not measured.groupBy("doc_id", "text_id").count().where("count > 1").isEmpty()


def _salts(spark: SparkSession) -> int:
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_packing over all of ``documents``."""
    return pack(table(spark, sf_dir, "documents"))
