"""Operators that SQL can't express, against plain loops, and edge cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.operators import graph, library, scoring, structure
from tessella.plans import registry


def test_greedy_pack_is_the_plain_loop(spark, sf):
    from pyspark.sql import Window as W

    found = {(r.item_id, r.rank): (r.doc_id, r.sent_idx) for r in registry.QUERIES["greedy_packs"](spark, sf).collect()}
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id", "sent_idx"))
    from tessella.plans.evidence_queries import _candidates

    rows = _candidates(spark, sf).withColumn("rank", rank).where("rank <= 64").collect()
    expected = {}
    for item in {r.item_id for r in rows}:
        left = sorted((r for r in rows if r.item_id == item), key=lambda r: (-r.shared, r.doc_id, r.sent_idx))
        used, n = {}, 0
        while left and n < 8:
            pool = [r for r in left if r.shared / 10 >= left[0].shared / 10 - 0.05]
            best = min(pool, key=lambda r: (used.get(r.doc_id, 0), -r.shared, r.doc_id, r.sent_idx))
            left.remove(best)
            if used.get(best.doc_id, 0) < 2:
                n += 1
                used[best.doc_id] = used.get(best.doc_id, 0) + 1
                expected[item, n] = (best.doc_id, best.sent_idx)
    assert found == expected and found


def test_greedy_distinct_ignores_aliases_of_dropped_items(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["c"]), (1, 4, ["a"])], "g long, o long, names array<string>")
    kept = {r.o for r in scoring.greedy_distinct(rows, "g", "o", "names").collect() if r.kept}
    assert kept == {1, 3}


def test_budget_skips_what_overflows_and_keeps_the_first(spark):
    row = spark.sql("select array(500L, 10L, 395L, 20L) as a, array(100L, 350L, 200L, 90L) as b")
    a, b = row.select(scoring.within_budget(F.col("a"), 400), scoring.within_budget(F.col("b"), 400)).first()
    assert a == [True, False, False, False] and b == [True, False, True, True]


def test_reveal_group_ends_with_its_canonical_page(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:30]), " ".join(words[:36]), " ".join(words[:40]), " ".join(f"x{i}" for i in range(30))]
    pages = spark.createDataFrame([("s", i, i, "h", t) for i, t in enumerate(texts)], "source string, page_index int, doc_id long, heading string, text string")
    found = {r.page_index: (r.group, r.canonical, r.is_canonical) for r in structure.reveal_groups(pages).collect()}
    assert found == {0: (0, 2, False), 1: (0, 2, False), 2: (0, 2, True), 3: (1, 3, True)}


def test_missing_heading_breaks_a_span(spark):
    pages = spark.createDataFrame([("s", i, i, h, "") for i, h in enumerate(["A", "a", "", "A", "B"])], "source string, page_index int, doc_id long, heading string, text string")
    found = sorted((r.start, r.end) for r in structure.heading_spans(pages, 1).collect())
    assert found == [(0, 1), (3, 3), (4, 4)]


def test_closure_of_a_cycle_ends(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    assert graph.closure(nodes, 4).count() == 2 * 5
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(nodes)
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(41)], "node long, parent long")
    assert graph.closure(deep).count() == 41 * 42 // 2


def test_merge_replaces_whole_keys(spark):
    base = spark.createDataFrame([Row(k=1, v="a"), Row(k=1, v="b"), Row(k=2, v="c")])
    new = spark.createDataFrame([Row(k=1, v="z")])
    assert sorted(library.merged(new, base, "k").collect()) == [Row(k=1, v="z"), Row(k=2, v="c")]


def test_functions_on_odd_texts(spark):
    row = spark.sql("select '  A  b\t' as s, '((x)' as p, 'classes parties glass buses' as w")
    got = row.select(T.collapse(F.col("s")), T.balanced(F.col("p"), "(", ")"), F.transform(T.index_tokens(F.col("w")), T.stem), T.snippet(F.col("w"), F.lit("glass"), 8), T.stable_phrase(F.col("w"), 2)).first()
    assert list(got[:3]) == ["A b", False, ["class", "party", "glass", "bus"]]
    assert got[3] == "s glass " and got[4] == "classes parties"


def test_boxes_and_vectors(spark):
    row = spark.sql("select array(0d,0d,2d,2d) as a, array(1d,1d,3d,3d) as b, array(3f,4f) as v")
    iou, scaled, n = row.select(V.overlap_of_boxes(F.col("a"), F.col("b")), V.scaled_box(F.array(*map(F.lit, (100.0, 200.0, 300.0, 400.0))), F.lit(600.0), F.lit(800.0)), V.norm(F.col("v"))).first()
    assert abs(iou - 1 / 7) < 1e-9 and scaled == [60.0, 160.0, 180.0, 320.0] and n == 5.0
