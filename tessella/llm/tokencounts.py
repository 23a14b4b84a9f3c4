"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as a small table
that is never recomputed from the corpus.  A *batch* brings signed deltas:
inserts add, deletes subtract, revised counts subtract the old and add the new
number.  Deltas are additive, so partial sums are made before the shuffle and
their order doesn't matter.

A commit writes the new totals beside the old ones and then publishes them by
creating one small file, which fails if someone else was faster (it is then
tried again on the newer totals).  The file names the batches that its totals
contain; a batch that is committed again changes nothing.  A job that dies
before publishing leaves files that nobody reads.  Publishing is a rename onto
a name that must not exist: that excludes a second writer on HDFS and on file
systems that rename like it.  On local folders and plain object stores the
check and the rename are two steps, so there one writer at a time may commit.

Edge cases: a null text has no tokens; null sources and languages are groups
of their own; groups whose documents and tokens are both 0 vanish from the
totals; an empty batch is recorded and changes nothing; rows that repeat a
doc_id or a text count each for itself; a very long text is counted in one
piece, with a few bytes for each of its own; an empty table has no totals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import arrow_map, arrow_slices, reliable, shared_folder, table
from tessella.llm.textkernel import find_words, is_separator

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, documents long, tokens long"


# ---- tokenizers


def words_1(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of anything but white space."""
    return np.diff(find_words(raw, offsets).first)


def runs_2(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of ASCII letters and digits, and every other character that isn't white space."""
    alnum = ((raw - np.uint8(48)) < np.uint8(10)) | (((raw | np.uint8(32)) - np.uint8(97)) < np.uint8(26))
    starts = alnum.copy()
    starts[1:] &= ~alnum[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    starts[inner] = alnum[inner]
    single = ~alnum & ~is_separator(raw) & ((raw & np.uint8(0xC0)) != np.uint8(0x80))
    total = np.concatenate([[0], np.cumsum(starts | single)])
    return np.diff(total[offsets])


def blanks_0(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A first estimate of the words: blanks and one."""
    total = np.concatenate([[0], np.cumsum(raw == 32)])
    return np.diff(total[offsets]) + (np.diff(offsets) > 0)


TOKENIZERS = {"words-1": words_1, "runs-2": runs_2, "blanks-0": blanks_0}


def counted(docs: DataFrame, versions: list[str]) -> DataFrame:
    """doc_id, source, lang and one column of counts for each tokenizer, in one pass."""
    names = [f"n{i}" for i in range(len(versions))]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in arrow_slices(batch):
            columns = [pa.array(TOKENIZERS[v](raw, offsets), pa.int64()) for v in versions]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["doc_id", "source", "lang", *names])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    return arrow_map(rows, run, "doc_id long, source string, lang string, " + ", ".join(f"{n} long" for n in names)).withColumnsRenamed(dict(zip(names, versions, strict=True)))


# ---- deltas


def inserts(counts: DataFrame, version: str, column: str | None = None) -> DataFrame:
    return _delta(counts, version, F.lit(1), F.col(f"`{column or version}`"))


def deletes(counts: DataFrame, version: str, column: str | None = None) -> DataFrame:
    return _delta(counts, version, F.lit(-1), -F.col(f"`{column or version}`"))


def revisions(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    return _delta(counts, version, F.lit(0), F.col(f"`{new}`") - F.col(f"`{old}`"))


def _delta(counts: DataFrame, version: str, documents, tokens) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), documents.cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


# ---- the rollup


class Totals:
    """A versioned table of totals in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._paths(f"{self.path}/commits"))

    def _head(self) -> tuple[int, dict]:
        """The newest version and what it says; versions are whole numbers, from 1."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._paths(f"{self.path}/commits"))]
        version = max((int(n) for n in names if n.isdigit()), default=0)
        if not version:
            return 0, {"totals": None, "batches": []}
        rows = self.spark.read.text(f"{self.path}/commits/{version:010d}", wholetext=True).collect()
        return version, json.loads(rows[0][0])

    def _publish(self, version: int, content: dict) -> bool:
        """Creates the version's file at once and whole, unless it is there."""
        draft = self._paths(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        target = self._paths(f"{self.path}/commits/{version:010d}")
        if not self._fs.exists(target) and self._fs.rename(draft, target):
            return True
        self._fs.delete(draft, False)
        return False

    @property
    def batches(self) -> list[str]:
        return self._head()[1]["batches"]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas; False if it was committed before."""
        change = None
        while True:
            version, head = self._head()
            if batch in head["batches"]:
                return False
            if change is None:  # summed up once, whatever happens to the commit
                change = reliable(self.spark, self._sum(deltas))
            folder = f"{self.path}/totals-{uuid.uuid4().hex}"
            self._sum(change if head["totals"] is None else change.unionByName(self.spark.read.parquet(head["totals"]))).coalesce(1).write.parquet(folder)  # groups, not documents
            if self._publish(version + 1, {"totals": folder, "batches": [*head["batches"], batch]}):
                return True

    @staticmethod
    def _sum(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def read(self) -> DataFrame:
        folder = self._head()[1]["totals"]
        return self.spark.createDataFrame([], DELTA) if folder is None else self.spark.read.parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_token_counts: the totals over all of ``documents``, after eight commits.

    All documents are inserted with an estimate of their words and with their
    runs; the estimates are revised to exact counts; the estimates are also
    loaded as a version of their own, which is retired again; documents in
    German are withdrawn and restored; and one batch is sent twice.
    """
    versions = ["words-1", "runs-2", "blanks-0"]
    counts = reliable(spark, counted(table(spark, sf_dir, "documents"), versions))
    german = counts.where("lang = 'de'")
    totals = Totals(spark, f"{shared_folder(spark)}/token-totals-{uuid.uuid4().hex}")
    totals.commit("load words", inserts(counts, "words-1", "blanks-0"))
    totals.commit("load runs", inserts(counts, "runs-2"))
    totals.commit("load estimates", inserts(counts, "blanks-0"))
    totals.commit("exact words", revisions(counts, "words-1", "blanks-0", "words-1"))
    totals.commit("load runs", inserts(counts, "runs-2"))
    totals.commit("retire estimates", deletes(counts, "blanks-0"))
    totals.commit("withdraw", deletes(german, "words-1").unionByName(deletes(german, "runs-2")))
    totals.commit("restore", inserts(german, "words-1").unionByName(inserts(german, "runs-2")))
    return totals.read()


ORACLE = r"""
WITH counted AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) AS runs
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*)::BIGINT AS documents, sum(words)::BIGINT AS tokens
FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'runs-2' AS tokenizer_version, count(*)::BIGINT AS documents, sum(runs)::BIGINT AS tokens
FROM counted GROUP BY source, lang
"""
