"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Every text becomes the set of its distinct 5-word shingles; the ``K``
   smallest hashes are its sketch.  Texts with equal sets are one class.
2. Inverted lists of retained values.  Similar classes share at least ``t`` of
   their ``k`` retained values, so if all classes order theirs by how many
   classes hold them, the first common one is among the ``k - t + 1`` rarest
   of both: only these are listed.  A line or passage that many documents
   share is frequent, and lists no class of which it is less than half.
3. In each list the class whose values are most common is the centre (copies
   are closer to their original than to each other), and all others are
   compared with it, on the full sets.  Links make components, and a second
   centre is taken from outside the largest component of each list.
4. What is left are members of one list in different components.  Their
   sketches meet in one task; overlaps of retained values are counted there,
   the sketch of the union estimates the similarity, and only pairs that pass,
   each in the list of its first common value, leave the task and are
   compared on their full sets.  A long list is split into blocks, those
   outside its largest component against all.

At similarity 0.75, fewer than 30 of the union's 64 smallest values are shared
with a probability below 4e-7, fewer than 70 of 128 and 333 of 512 (the
estimate's longer sketches) below 2e-7; sets of up to 48 shingles are compared
without any such chance.

Edge cases: null and empty texts have an empty set and no links; texts of 1 to
4 words have one shingle, their whole sequence; a null doc_id is returned with
component null and kept; rows that repeat a doc_id are one node, whatever
their texts; an empty table has no rows; columns other than doc_id and text
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import graph
from tessella.llm.common import arrow_map, arrow_slices, private, reliable, spread, table, texts
from tessella.llm.textkernel import find_words, hash_spans, mix64, ngram_hashes

WORDS, PERCENT = 5, 75
K, LEAST_SHARED = 64, 30
#: The longer sketches that estimate, in the tasks of the last step: first so many values, then more; most sets are whole in these.
WIDE, WIDE_SHARED = 128, 70
WIDEST, WIDEST_SHARED = 512, 333
#: Members of one centre that one task compares in a row.
STAR_SIZE = 2_000
#: Members of a list, on either side, that one task compares with each other.
BLOCK = 1_024
#: Lists from this size on count overlaps value by value instead of pair by pair.
DENSE = 48
#: Bits of the map that tells which documents' full sets are asked for: 2**23 bytes for any number of documents.
MAP_BITS = 26
_CHUNK = 4096


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each row."""
    words = find_words(raw, offsets)
    hashes = hash_spans(raw, words.start, words.end, lower=True)
    grams = ngram_hashes(hashes, n) >> np.uint64(1)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]).view(np.int64))
        elif b > a:
            short = ngram_hashes(hashes[a:b], b - a)
            out.append((mix64(short + np.uint64(b - a)) >> np.uint64(1)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (together a 128-bit name of the set), sketch."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in arrow_slices(batch):
            sets = shingle_sets(raw, offsets)
            a = [int(mix64(s.view(np.uint64) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            b = [int(np.bitwise_xor.reduce(mix64(s.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0 for s in sets]
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return arrow_map(texts(docs), run, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def least_shared(n: Column, percent: int = PERCENT) -> Column:
    """How many retained values a class of ``n`` shingles shares at least with a similar one."""
    exact = K * percent // 100
    return F.when(n <= exact, F.ceil(n * percent / 100)).otherwise(LEAST_SHARED).cast("int")


def rare_lists(classes: DataFrame) -> DataFrame:
    """rep, set_a, n, shared (its retained values that other classes hold too, rarest first), listed (those that it is listed under), weight."""
    entries = classes.select("rep", "set_a", F.col("n_shingles").alias("n"), F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    known = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_class = entries.join(known, "v").groupBy("rep", "set_a", "n", "k").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"), F.sum("df").alias("total"))
    alone = F.col("k") - F.size("held")
    first = F.greatest(F.lit(0), F.col("k") - least_shared(F.col("n")) + 1 - alone)
    return of_class.select("rep", "set_a", "n", F.col("held.v").alias("shared"), F.slice(F.col("held.v"), F.lit(1), first).alias("listed"), ((F.col("total") + alone) / F.col("k")).alias("weight"))


def _sizes_fit(a, b, percent: int = PERCENT):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles (the sorted 64-bit hashes as bytes) of the documents in ``wanted``.

    A bit map of fixed size lets most other documents go before their texts are
    even cut into words; the join takes what it lets through by chance.
    """
    spark = docs.sparkSession
    place = F.shiftrightunsigned(F.xxhash64("rep"), 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = wanted.select(F.shiftrightunsigned(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    def fold(rows: pa.Table) -> pa.Table:
        word, value = np.asarray(rows.column(0)), np.asarray(rows.column(1))
        out = np.zeros(_CHUNK, dtype=np.int64)
        out[word % _CHUNK] = value
        return pa.table({"chunk": pa.array([int(word[0]) // _CHUNK], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    bits = np.zeros((1 << (MAP_BITS - 6)) // _CHUNK * _CHUNK, dtype=np.int64)
    for row in words.groupBy(F.floor(F.col("word") / _CHUNK)).applyInArrow(fold, "chunk long, bits binary").collect():  # 256 rows of 32 KB at most
        bits[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["bits"], dtype=np.int64)
    bits = spark.sparkContext.broadcast(bits.view(np.uint8))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.asarray(batch.column(2))
        some = batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
        for part, raw, offsets in arrow_slices(some):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(raw, offsets)], pa.binary())], names=["rep", "shingles"])

    asked = texts(docs).where("doc_id is not null").withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MAP_BITS))
    return arrow_map(asked, run, "rep long, shingles binary").join(wanted.select("rep").distinct(), "rep").where(F.length("shingles") > 0).distinct()


def verify(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Each set goes once to each centre ``a`` that it is paired with; a centre
    with many partners is split over several groups, its own set being sent to
    each.  A task holds one centre's set at a time.
    """
    grouped = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / STAR_SIZE).cast("int").alias("groups"))
    members = pairs.join(grouped, "a").select(F.col("b").alias("rep"), F.struct(F.col("a").alias("star"), F.pmod(spread(F.col("b"), 3), "groups").cast("int").alias("part"), F.lit(1).alias("role")).alias("to"))
    centres = grouped.select(F.col("a").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).select("rep", F.struct(F.col("rep").alias("star"), "part", F.lit(0).alias("role")).alias("to"))
    sent = sets.join(members.unionAll(centres), "rep").select("rep", "to.star", "to.part", "to.role", "shingles")
    dealt = sent.repartition("star", "part").sortWithinPartitions("star", "part", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, []
        for batch in batches:
            found = []
            for rep, star, part, role, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (star, part) != at:
                    at, centre = (star, part), []
                own = np.frombuffer(data, dtype=np.int64)
                if role == 0:
                    centre.append(own)
                    continue
                for other in centre:
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * shared >= percent * (len(own) + len(other) - shared) > 0:
                        found.append((star, rep))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The members of lists that lie in several components: v, rep, n, weight, c (their component), major (the list's largest one), size, minor (members outside it)."""
    known = graph.components(lists.sparkSession, links)
    member = lists.join(known, lists.rep == known.node, "left").select("v", "rep", "n", "weight", F.coalesce("component", "rep").alias("c"))
    parts = member.groupBy("v", "c").agg(F.count(F.lit(1)).alias("m"))
    facts = parts.groupBy("v").agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.sum("m").alias("size"), F.max("m").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return reliable(lists.sparkSession, member.join(facts.select("v", "major", "size", (F.col("size") - F.col("m")).alias("minor")), "v"))


def _stars(members: DataFrame, centres: DataFrame, other=None) -> DataFrame:
    """Distinct pairs of the centre of each list (v, c: struct) with its members; ``other``: a condition on them."""
    pairs = members.join(centres, "v").where(F.col("rep") != F.col("centre.rep")).where(_sizes_fit(F.col("n"), F.col("centre.n")))
    pairs = pairs if other is None else pairs.where(other)
    return pairs.select(F.col("centre.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _heaviest(members: DataFrame, *more: str) -> DataFrame:
    return members.groupBy("v").agg(F.max_by(F.struct("rep", "n", *more), F.struct("weight", -F.col("rep"))).alias("centre"))


def estimated(a: np.ndarray, b: np.ndarray, k: int = WIDE, shared: int = WIDE_SHARED, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of sketches (rows, sorted, padded with the largest number) the union's sketch lets through."""
    none = np.iinfo(np.int64).max
    union = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(union.shape, dtype=bool)
    again[:, 1:] = (union[:, 1:] == union[:, :-1]) & (union[:, 1:] != none)
    fresh = ~again & (union != none)
    count = fresh.sum(1)
    last = np.where(count >= k, union[np.arange(len(a)), np.argmax(np.cumsum(fresh, axis=1) >= k, axis=1)], none)
    inside = (again & (union <= last[:, None])).sum(1)
    return np.where(count < k, 100 * inside >= percent * count, inside >= shared)


def list_pairs(v: int, ids: np.ndarray, n: np.ndarray, c: np.ndarray, minor: np.ndarray, x: np.ndarray, y: np.ndarray, sketch: np.ndarray, shared: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs (row numbers) of one list that may be similar, if the list's value is their first common one.

    x, y: the rows of either side; sketch: sorted and padded; shared: dense
    numbers of the values that others hold too, rarest first, padded with -1,
    the list's value being 0.
    """
    a, b = np.flatnonzero(x), np.flatnonzero(y)
    fits = (c[a, None] != c[b]) & (100 * np.minimum(n[a, None], n[b]) >= percent * np.maximum(n[a, None], n[b])) & (~minor[b] | (ids[a, None] < ids[b]))
    if len(a) * len(b) >= DENSE * DENSE and fits.any():
        # Whoever shares an earlier value meets in that value's list.
        at = np.argmax(shared == 0, axis=1)
        early = (np.arange(shared.shape[1]) < at[:, None]) & (shared > 0)
        rows, cols = np.nonzero(early)
        value = shared[rows, cols]
        order = np.argsort(value, kind="stable")
        rows, value = rows[order], value[order]
        place_a, place_b = np.full(len(ids), -1), np.full(len(ids), -1)
        place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
        for run in np.split(rows, np.flatnonzero(np.diff(value)) + 1):
            if len(run) > 1:
                i, j = place_a[run], place_b[run]
                fits[np.ix_(i[i >= 0], j[j >= 0])] = False
    i, j = np.nonzero(fits)
    out = []
    for s in range(0, len(i), 2048):
        p, q = a[i[s : s + 2048]], b[j[s : s + 2048]]
        left, right = shared[p], shared[q]
        common = ((left[:, :, None] == right[:, None, :]) & (left >= 0)[:, :, None]).any(2)
        first = left[np.arange(len(p)), np.argmax(common, axis=1)] == 0
        p, q = p[first], q[first]
        if len(p):
            good = estimated(sketch[p, :WIDE], sketch[q, :WIDE])
            p, q = p[good], q[good]
            for u in range(0, len(p), 256):
                good = estimated(sketch[p[u : u + 256]], sketch[q[u : u + 256]], WIDEST, WIDEST_SHARED)
                out.append(np.stack([p[u : u + 256][good], q[u : u + 256][good]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _padded(column: pa.BinaryArray, width: int = WIDEST) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=np.int64) for x in column.to_pylist()]
    out = np.full((len(parts), width), np.iinfo(np.int64).max, dtype=np.int64)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def _across(opened: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs (a, b) of one list that lie in different components and pass the estimate; each once."""
    blocks = lambda m: F.ceil(F.col(m) / BLOCK).cast("int")
    part = lambda salt, m: F.pmod(spread(F.col("rep"), salt), blocks(m)).cast("int")
    task = lambda i, j, x, y: F.struct(i.alias("i"), j.alias("j"), x.alias("x"), y.alias("y"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    minor = F.col("c") != F.col("major")
    # On one side those outside the largest component, on the other all: a short list is one task.
    asks = F.when(minor, F.transform(F.sequence(zero, blocks("size") - 1), lambda j: task(part(11, "minor"), j, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,x:boolean,y:boolean>>"))
    answers = F.transform(F.sequence(zero, blocks("minor") - 1), lambda i: task(i, part(12, "size"), no, yes))
    tasks = F.when(F.col("size") <= BLOCK, F.array(task(zero, zero, minor, yes))).otherwise(F.concat(asks, answers))
    rows = opened.select("v", "rep", "n", "c", minor.alias("outside"), F.explode(tasks).alias("to"))
    rows = rows.join(profile.select("rep", "sketch", "shared"), "rep").select("v", "to.i", "to.j", "rep", "n", "c", "outside", "to.x", "to.y", "sketch", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                ids, n, c = (np.asarray(rows.column(i)) for i in (3, 4, 5))
                minor, x, y = (rows.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (6, 7, 8))
                if x.any() and y.any():
                    v = rows.column(0)[0].as_py()
                    numbers = np.append(v, np.asarray(rows.column(10).flatten()))
                    _, dense = np.unique(numbers, return_inverse=True)
                    dense = np.where(dense == dense[0], 0, dense + 1)[1:].astype(np.int32)
                    size = np.asarray(rows.column(10).value_lengths()).astype(np.int64)
                    shared = np.full((len(ids), max(1, int(size.max()))), -1, dtype=np.int32)
                    shared[np.arange(shared.shape[1]) < size[:, None]] = dense
                    found = list_pairs(v, ids, n, c, minor, x, y, _padded(rows.column(9)), shared)
                    a, b = ids[found[:, 0]], ids[found[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            held.clear()

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if (now := tuple(key[lo].tolist())) != at:
                    yield from close()
                    at = now
                held.append(batch.slice(lo, hi - lo))
        yield from close()

    keys = ["v", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links, itself included), kept."""
    spark = docs.sparkSession
    found = reliable(spark, sketches(docs))
    named = found.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "set_a", "set_b"]
    classes = reliable(spark, named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    found = reliable(spark, found.drop("sketch"))

    profile = reliable(spark, rare_lists(classes))
    lists = profile.where(F.size("listed") > 0).select("rep", "n", "weight", F.explode("listed").alias("v"))
    lists = reliable(spark, lists.join(lists.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("v"), "v"))
    members = lists.select("rep").distinct()
    sets = reliable(spark, full_sets(docs, members))
    profile = reliable(spark, profile.select("rep", "shared").join(sets.select("rep", F.substring("shingles", 1, 8 * WIDEST).alias("sketch")), "rep"))

    links = reliable(spark, verify(sets, _stars(lists, _heaviest(lists))).unionAll(_same_id(found, classes, key)))
    opened = _open_lists(lists, links)
    if not opened.isEmpty():
        second = _heaviest(opened.where("c <> major"), "c")
        links = reliable(spark, links.unionAll(verify(sets, _stars(opened, second, F.col("c") != F.col("centre.c")))))
        opened = _open_lists(lists, links)
        links = reliable(spark, links.unionAll(verify(sets, reliable(spark, _across(opened, profile).distinct()))))
    known = graph.components(spark, links)

    of_class = classes.join(known, classes.rep == known.node, "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    whole = found.join(of_class, key, "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_id(found: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) between the classes of a doc_id that stands for several texts."""
    own = found.where("n_shingles > 0 and doc_id is not null").select("doc_id", *key)
    several = own.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low <> high").select("doc_id")
    return own.join(several, "doc_id").join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_near_duplicates over all of ``documents``."""
    return link(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns."""
    (own,) = private(docs, "id")
    gone = link(docs).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(own), "left_anti")
