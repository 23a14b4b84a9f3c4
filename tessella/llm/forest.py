"""Nearest neighbours from a hash-prefix forest.

Every vector gets, for each tree, a string of 64 sign bits of random
projections.  A tree is nothing but the sorted array of these strings: the
vectors below a prefix are a range of it.  A query descends to its longest
matching prefix in every tree by binary search, and then all trees ascend
together, one bit at a time, until enough candidates are below them.
Candidates are ranked by their exact inner products.

Rows are dealt into segments that fit in a task, each with its own forest, and
the queries into blocks; a segment answers a block with its best rows, and the
best of all segments are the result.  Every row is indexed and every query goes
to every segment, so the answer doesn't depend on how rows are dealt; the work
grows with queries times segments.

For largest inner products, vectors get one more component that makes all
norms equal; for vectors of one length it is 0.

More trees let fewer bits do: at 64 trees a neighbour at a cosine of 0.3 is
among the candidates with a chance of 0.96 where 0.63 of all rows are, at 16
trees with one of 0.90.  Vectors without any structure, as those of the test
tables, can't be pruned further without losing neighbours.

Edge cases: vectors that are null, all zeros, or hold null or non-finite
components take no part, as queries or as candidates, and neither do those
whose length isn't the most frequent one, nor rows without an id.  Rows that
repeat an id are candidates of their own, but a query never finds its own id;
an empty table has no rows, and columns other than vec_id and embedding aren't
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import table

NEIGHBOURS, QUERY_STEP = 20, 20
TREES, BITS = 64, 64
#: Rows in a segment and queries in a block, about.
SEGMENT_ROWS, BLOCK_ROWS = 16_384, 1_024
#: The trees ascend until so many candidates are below them: a share of the segment, and at least so many.
CANDIDATE_SHARE, LEAST_CANDIDATES = 0.6, 400


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("embedding") == F.col("n")).drop("n")  # one row


def planes(dim: int, trees: int = TREES, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS))


def strings(x: np.ndarray, extra: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The hash strings (rows by trees) as numbers whose order is that of the strings."""
    out = np.empty((len(x), p.shape[1] // BITS), dtype=np.uint64)
    for a in range(0, len(x), 512):  # projections of 512 rows at a time: 17 MB at 64 trees
        bits = (x[a : a + 512] @ p[:-1] + extra[a : a + 512, None] * p[-1]) > 0
        out[a : a + 512] = np.packbits(bits.reshape(len(bits), -1, BITS), axis=2).view(">u8")[:, :, 0]
    return out


@dataclass
class Forest:
    """Sorted strings of each tree, and the row of each."""

    sorted: list[np.ndarray]
    rows: list[np.ndarray]
    size: int

    @staticmethod
    def build(hashes: np.ndarray) -> Forest:
        rows = [np.argsort(h, kind="stable") for h in hashes.T]
        return Forest([h[r] for h, r in zip(hashes.T, rows, strict=True)], rows, len(hashes))

    def bounds(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The range (queries by trees) below each query's prefix of so many bits."""
        low = np.empty(hashes.shape, np.int64)
        high = np.empty(hashes.shape, np.int64)
        rest = np.uint64((1 << (BITS - bits)) - 1)
        for k, h in enumerate(self.sorted):
            low[:, k] = np.searchsorted(h, hashes[:, k] & ~rest, side="left")
            high[:, k] = np.searchsorted(h, hashes[:, k] | rest, side="right")
        return low, high

    def candidates(self, hashes: np.ndarray, least: int) -> np.ndarray:
        """Which rows are candidates of which query (queries by rows)."""
        least = min(least, self.size)
        out = np.zeros((len(hashes), self.size), dtype=bool)
        open_ = np.arange(len(hashes))
        # Where all trees together have fewer rows than asked for, they can't have enough different ones.
        for bits in range(BITS, -1, -1):
            if not len(open_):
                break
            low, high = self.bounds(hashes[open_], bits)
            enough = (high - low).sum(1) >= least
            still = []
            for q, lo, hi, look in zip(open_.tolist(), low, high, enough.tolist(), strict=True):
                if look:
                    mine = out[q]
                    for k in range(len(self.rows)):
                        mine[self.rows[k][lo[k] : hi[k]]] = True
                    if np.count_nonzero(mine) >= least:
                        continue
                still.append(q)
            open_ = np.array(still, dtype=np.int64)
        return out


_FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, share: float = CANDIDATE_SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product of every row for which ``is_query`` holds."""
    rows = usable(vectors)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("int")).alias("q"), F.max(squares).alias("m"), F.max(F.size("embedding")).alias("dim")).first()
    segments, blocks = max(1, -(-facts["n"] // SEGMENT_ROWS)), max(1, -(-(facts["q"] or 0) // BLOCK_ROWS))
    largest, dim = float(facts["m"] or 0.0), int(facts["dim"] or 1)
    segment = F.pmod(F.xxhash64("vec_id"), F.lit(segments)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = rows.select(segment.alias("segment"), every(blocks).alias("block"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("row_vector"))
    asked = rows.where(is_query).select(every(segments).alias("segment"), block.alias("block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))

    def answer(key, left, right):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, x = _matrix(left, dim)
        query_ids, y = _matrix(right, dim)
        p = planes(dim, trees)
        extra = np.sqrt(np.maximum(0.0, largest - (x * x).sum(1)))
        forest = Forest.build(strings(x, extra, p))
        hashes = strings(y, np.zeros(len(y)), p)
        least = max(LEAST_CANDIDATES, int(share * len(x))) + 1
        out = []
        for a in range(0, len(y), 256):
            found = forest.candidates(hashes[a : a + 256], least)
            for q, mine in enumerate(found):
                gathered = np.flatnonzero(mine)
                gathered = gathered[ids[gathered] != query_ids[a + q]]
                if not len(gathered):
                    continue
                row = x[gathered] @ y[a + q]
                keep = min(k, len(row))
                edge = np.partition(row, len(row) - keep)[len(row) - keep]
                # A little below the edge as well: the product of single rows decides ties.
                best = gathered[row >= edge - 1e-9 * max(1.0, abs(edge))]
                score = np.array([float(np.dot(y[a + q], x[b])) for b in best])
                order = np.lexsort((ids[best], -score))[:keep]
                out.append((np.full(len(order), query_ids[a + q]), ids[best][order], score[order]))
        if not out:
            return none
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    key = ("segment", "block")
    found = indexed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(answer, _FOUND)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(data, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, ordered by id and components: the order in which rows arrive isn't fixed."""
    ids = data.column(2).to_numpy()
    x = data.column(3).combine_chunks().flatten().to_numpy().reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.ascontiguousarray(x[order])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_hash_forest: every row whose id is divisible by 20 against all rows of ``embeddings``."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
