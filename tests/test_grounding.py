"""Matching of labels and quotes, and what has no SQL, against plain Python."""

import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from tessella.functions import matching as M
from tessella.operators import grounding as G
from tessella.plans import registry


def test_strong_form_is_that_of_python(spark):
    texts = ["“Quote” – ﬁne  ½ ²", "Straße ÉTÉ", "", None, "a′b − c\t\n d"]
    folds = {p: to for to, ps in M.STRONG_FOLDS.items() for p in ps}
    plain = lambda x: " ".join(unicodedata.normalize("NFKC", x).translate(folds).split()).casefold()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", M.strong_form(F.col("s")).alias("f")).orderBy("i").collect()
    assert [r.f for r in rows] == [None if t is None else plain(t) for t in texts]


def test_close_tokens_and_sequences(spark):
    rows = [("signal power", "the signall power"), ("signal power", "power signal"), ("cat", "catt"), ("", "x"), ("a b", "a")]
    split = lambda c: F.when(F.length(c) > 0, F.split(c, " ")).otherwise(F.array().cast("array<string>"))
    found = spark.createDataFrame(rows, "a string, b string").select(M.close_sequence(split(F.col("a")), split(F.col("b"))).alias("row"), M.close_hits(split(F.col("a")), split(F.col("b"))).alias("n")).collect()
    assert [(r.row, r.n) for r in found] == [(True, 2), (False, 2), (False, 0), (False, 0), (False, 1)]


def test_labels_and_truth(spark):
    rows = spark.createDataFrame([("The Gradient Descent Method",), ("overview of concepts",), ("Yes ",), (None,)], "s string")
    found = rows.select(M.label_terms(F.col("s")).alias("t"), M.truthy(F.col("s")).alias("b")).collect()
    assert [tuple(found[0].t), tuple(found[1].t)] == [(["gradient", "descent"], ["method"]), (["overview"], ["overview", "concepts"])]
    assert [r.b for r in found] == [False, False, True, False]


def test_block_first_is_a_plain_loop(spark, sf):
    most, per_block = 12, 3
    candidates = registry.QUERIES["concept_candidates"](spark, sf)
    from tessella.operators import scoring
    from tessella.sources.tables import table

    texts = {(r.doc_id, r.sent_idx): " ".join(r.sentence.split()).lower() for r in scoring.sentence_rows(table(spark, sf, "documents")).collect()}
    of_item = {}
    for r in candidates.collect():
        of_item.setdefault(r.item_id, []).append((-r.shared, r.doc_id, r.sent_idx))
    expected = set()
    for item, rows in of_item.items():
        used, quotes, out = Counter(), set(), []
        for limit in (1, per_block):
            for place, (_, doc_id, sent_idx) in enumerate(sorted(rows)[:64], start=1):
                quote = texts[doc_id, sent_idx]
                if len(out) < most and quote not in quotes and used[doc_id] < limit:
                    used[doc_id] += 1
                    quotes.add(quote)
                    out.append((item, len(out) + 1, doc_id, place))
        expected.update(out)
    assert {tuple(r) for r in registry.QUERIES["block_first_quotes"](spark, sf).collect()} == expected


def test_lanes(spark):
    rows = [(1, 0, 0, 0, 0), (1, 1, 0, 0, 0), (0, 1, 0, 0, 0), (0, 1, 1, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 0, 1), (0, 0, 0, 1, 0), (0, 0, 0, 0, 0)]
    found = spark.createDataFrame(rows, "o int, r int, x int, n int, w int").select(G.lane(*(F.col(c) for c in "orxnw")).alias("lane")).collect()
    assert [r.lane for r in found] == ["core_ready", "mixed_core_with_review_or_rejected", "review_only", "mixed_review_and_rejected", "rejected_only", "insufficient_only", "expected_needs_only", "true_empty_or_unknown_schema"]
