"""Results of the second round's findings on small tables that are odd or that would show a product of rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import matching as M
from tessella.functions import text as T
from tessella.operators import hybrid, pairs
from tessella.plans import registry


def plan_of(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_hybrid_rank_makes_no_product_of_queries_and_documents(spark, sf):
    plan = plan_of(registry.QUERIES["hybrid_rank"](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hybrid_top_is_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "SENT", 7)
    draw = np.random.default_rng(5)
    n, dim, k = 300, 8, 4
    vectors = [None if i % 41 == 0 else [float(x) for x in draw.normal(size=dim).astype(np.float32) / 3] for i in range(n)]
    lex = [None if i % 37 == 0 else int(draw.integers(0, 90)) for i in range(n)]
    weight = [0.85 if i % 3 == 0 else 1.0 for i in range(n)]
    docs = spark.createDataFrame([(i, lex[i], weight[i], vectors[i]) for i in range(n)], "doc_id long, lex int, weight double, embedding array<float>")
    queries = docs.where("doc_id % 20 in (0, 1)").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qe"))
    expected, top = set(), max(x for x in lex if x is not None)
    for q in (i for i in range(n) if i % 20 in (0, 1)):
        rows = []
        for i in range(n):
            score = None
            if vectors[q] is not None and vectors[i] is not None and lex[i] is not None:
                product = np.float32(0)
                for x, y in zip(vectors[q], vectors[i], strict=True):
                    product += np.float32(x) * np.float32(y)
                score = math.floor((55 * lex[i] / 100 / top + 0.45 * ((float(product) + 1) / 2)) * weight[i] * 1000 + 0.5) / 1000
            rows.append((score is None, -(score or 0), i, score))
        expected |= {(q, i, score, rank) for rank, (_, _, i, score) in enumerate(sorted(rows)[:k], start=1)}
    assert {tuple(r) for r in hybrid.hybrid_top(queries, docs, k).collect()} == expected


#: What depends on a sentence alone is found where it is read: no join carries sentences to their candidates.
WITHOUT_JOIN = [
    "acceptance_gates",
    "balanced_evidence",
    "candidate_routing",
    "contamination_audit",
    "family_summary",
    "fuzzy_sequences",
    "near_misses",
    "pack_lanes",
    "pack_quality",
    "quote_roles",
    "region_bonus",
    "risk_counts",
    "sentence_scores",
    "support_readiness",
    "support_summary",
    "topic_gate",
]


@pytest.mark.parametrize("name", WITHOUT_JOIN)
def test_candidates_are_not_joined_with_their_sentences(spark, sf, name):
    assert not re.search(r"Join[^\n]*sent_idx", plan_of(registry.QUERIES[name](spark, sf)))


def test_matched_counts_and_finds_runs(spark):
    """Against the column functions: repeated tokens, runs at a row's end, a concept without tokens, null lists."""
    items = spark.createDataFrame([(1, "signal power noise", "signal power"), (2, "power power noise floor", "floor"), (3, "", ""), (4, None, None)], "item_id long, text string, name string")
    texts = ["signal power noise", "noise signall power power", "power noise the floor", "signal", None, "", "floor_signal power noise signal power"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").withColumn("w", T.words(F.col("s")))
    text, name = T.content_tokens(F.col("text")), T.words(F.col("name"))
    found = pairs.matched(rows, items, {"shared": (text, "w"), "near": (name, "w")}, {"exact": (name, "w"), "close": (name, "w")}, least=2, drop=("w",), close=("near", "close"))
    found = {tuple(r) for r in pairs.by_pair(found, "best").select("i", "item_id", "shared", "near", "n_near", "exact", "close").collect()}
    w, wanted = T.words(F.col("s")), T.words(F.col("name"))
    exact = F.contains(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" "))) & (F.size(wanted) > 0)
    both = rows.drop("w").crossJoin(items).withColumn("shared", F.size(F.array_intersect(text, w))).where("shared >= 2")
    plain = both.select("i", "item_id", "shared", M.close_hits(wanted, w), F.size(wanted), exact, M.close_sequence(wanted, w)).collect()
    assert found == {tuple(r) for r in plain} and len(found) == 8


#: Documents lie in one row group here, which one task would read and work on.
DEALT = [
    "contamination_audit",
    "quote_roles",
    "sentence_scores",
    "support_readiness",
]


@pytest.mark.parametrize("name", DEALT)
def test_documents_of_one_row_group_are_dealt_to_all_cores(spark, sf, name):
    assert "RoundRobinPartitioning" in plan_of(registry.QUERIES[name](spark, sf))


def test_dealt_keeps_all_rows(spark):
    rows = spark.createDataFrame([(i % 3 or None, str(i // 2)) for i in range(100)], "doc_id long, text string").coalesce(1)
    found = pairs.dealt(rows)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect())) and found.select(F.spark_partition_id()).distinct().count() > 1


#: The JVM interprets methods of more than 8,000 bytes.
COMPILED = [
    "contamination_audit",
    "sentence_scores",
]


@pytest.mark.parametrize("name", COMPILED)
def test_generated_methods_are_small_enough_to_be_compiled(spark, sf, name):
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan()
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 2 and max(sizes) <= 8_000
