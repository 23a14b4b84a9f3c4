"""What a chunk and a shard of the language model hold at once, for each token and pair; what the driver's JVM gives back."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import common, ngram


def peak_of(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def blob_of(n_texts, n_words):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, n_words) % 50_000) for _ in range(n_texts)]
    data = pa.table({"doc_id": pa.array(range(n_texts), pa.int64()), "text": texts, "held_out": [i % 7 == 2 for i in range(n_texts)]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as writer:
        writer.write_table(data)
    return sink.getvalue().to_pybytes()


def test_a_chunk_is_read_within_50_bytes_a_token():
    blob = blob_of(400, 2_000)
    assert peak_of(lambda: ngram.read_chunk([blob])) < 50 * 400 * 2_001


def test_a_shard_is_merged_within_90_bytes_a_pair():
    rows = ngram._messages(ngram.ask(ngram.read_chunk([blob_of(400, 2_000)]), 0, 1, np.array([ngram.START]))).to_pylist()
    pairs = sum(len(r["c"]) // 6 for r in rows if r["kind"] == "pair")
    assert peak_of(lambda: ngram.merge_pairs(rows, 1)) < 90 * pairs


def test_distinct_is_unique_in_ranges():
    draw = np.random.default_rng(4)
    for top in (1, 5, 1 << 48):
        for n in (0, 1, 999):
            values = np.minimum(draw.integers(0, top, n, dtype=np.uint64), draw.integers(0, top, n, dtype=np.uint64))
            values[: n // 9] = top - 1
            found, place = ngram.distinct(values, top)
            expected, inverse = np.unique(values, return_inverse=True)
            assert (found == expected).all() and (place == inverse).all() and found.dtype == values.dtype
    ends = np.array([0, 1 << 63, (1 << 64) - 1, 7], dtype=np.uint64)
    assert sorted(np.concatenate(list(ngram._ranges(ends, 1 << 64)))) == [0, 1, 2, 3]


def test_free_gives_native_memory_back(spark):
    """What the JVM has allocated and freed outside of its heap stays with the C library below any block still in use."""
    jvm, pid = spark._jvm, int(spark._jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getName().split("@")[0])
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) >> 10
    if not common.trim(spark):
        pytest.skip("this JVM has no System.trim_native_heap")
    platform, n = jvm.org.apache.spark.unsafe.Platform, 1 << 16
    data = spark.sparkContext._gateway.new_array(jvm.byte, n)
    blocks = [platform.allocateMemory(n) for _ in range(3_000)]
    for at in blocks:
        platform.copyMemory(data, platform.BYTE_ARRAY_OFFSET, None, at, n)
    for at in blocks[:-1]:
        platform.freeMemory(at)
    jvm.System.gc()
    before = held()
    common.free(spark)
    after = held()
    platform.freeMemory(blocks[-1])
    assert after < before - 120
