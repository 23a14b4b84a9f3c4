"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.textkernel import slices, text_column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; whatever else the table has, it isn't read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def arrow_slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in parts of bounded size: (rows, their bytes, offsets into these)."""
    raw, offsets = text_column(batch.column(batch.schema.get_field_index(name)))
    for a, b in slices(offsets):
        yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def spread(doc_id: Column, salt: int = 0) -> Column:
    return F.xxhash64(F.lit(salt), doc_id)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    lead = "own"
    while any(f"{lead}_{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}_{n}" for n in names]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is
    made only where that is unset and the master is this machine (tests).
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tessella-shared-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def reliable(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    free(spark)
    return out


def free(spark: SparkSession) -> None:
    """Has the driver drop shuffle files and checkpoints that nothing refers to, instead of when its heap fills up."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give free memory outside of its heap back to the system; False where it has no such command.

    Compilers and codecs of hundreds of threads allocate there, and the C
    library keeps what they free, in the arenas of those threads.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind: str, values: list):
        out = gateway.new_array(getattr(jvm, kind), len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    # The server's own class is closed to callers; the interface isn't.
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", array("Class", [jvm.Class.forName(k) for k in kinds]))
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    command = array("Object", [name, "systemTrimNativeHeap", array("Object", [array("String", [])]), array("String", ["[Ljava.lang.String;"])])
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JJavaError:
        return False
    return True
