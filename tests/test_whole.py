"""Queries do the whole job: no text is cut short and no token or line is left out."""

import re

from tessella.functions import text as T
from tessella.operators import scoring
from tessella.plans import registry
from tessella.sources.tables import table


def content_words(text):
    return {t for t in re.findall(r"[a-z0-9_']+", text.lower()) if len(t) >= 2 and t not in T.STOP_WORDS}


def test_candidates_are_every_sentence_for_every_concept(spark, sf):
    sentences = [(r.doc_id, r.sent_idx, content_words(r.sentence)) for r in scoring.sentence_rows(table(spark, sf, "documents")).collect()]
    items = [(r.item_id, content_words(r.text)) for r in table(spark, sf, "benchmark").collect()]
    expected = {(i, d, n, len(a & b)) for d, n, a in sentences for i, b in items if len(a & b) >= 3}
    assert {tuple(r) for r in registry.QUERIES["concept_candidates"](spark, sf).select("item_id", "doc_id", "sent_idx", "shared").collect()} == expected
    assert expected


def test_frequent_tokens_make_candidates(spark):
    sentences = spark.createDataFrame([(i, 0, "alpha beta gamma") for i in range(50)] + [(99, 0, "alpha beta other")], "doc_id long, sent_idx int, sentence string")
    concepts = spark.createDataFrame([(1, "Alpha beta gamma delta")], "item_id long, text string")
    assert scoring.candidates(sentences, concepts).count() == 50


def folder(spark, at, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_winners_are_those_of_whole_texts(spark, tmp_path):
    start = "The same opening line. " * 10
    rows = [(1, start + "one", "en", "a", 9), (2, start + "two", "en", "a", 9), (3, start + " ONE ", "en", "b", 9), (4, None, "en", "a", 0)]
    found = registry.QUERIES["two_pass_winners"](spark, folder(spark, tmp_path, documents=(rows, DOCS)))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 4]


def plain_budget(lengths, budget):
    used, kept = 0, 0
    for n in lengths:
        if not kept or used + n <= budget:
            used, kept = used + n, kept + 1
    return kept


def test_budget_goes_over_all_lines(spark, sf, tmp_path):
    rows = [(1, "\n".join(["x" * 300] * 14 + ["short"]), "en", "a", 9), (2, "\n".join(["ab"] * 500), "en", "a", 9), (3, "x" * 900 + "\ny", "en", "a", 9), (4, "", "en", "a", 0)]
    for at in (folder(spark, tmp_path, documents=(rows, DOCS)), sf):
        expected = {r.doc_id: plain_budget(map(len, r.text.split("\n")), 400) for r in table(spark, at, "documents").collect()}
        assert {r.doc_id: r.n_kept for r in registry.QUERIES["budgeted_lines"](spark, at).collect()} == expected


def test_distinct_words_are_those_of_the_whole_text(spark, tmp_path):
    words = [f"w{i}" for i in range(90)]
    at = folder(spark, tmp_path, benchmark=([(1, " ".join(words + words[:5]))], "item_id long, text string"))
    assert registry.QUERIES["ordered_distinct"](spark, at).first().words.split() == words


def test_functions_read_whole_texts(spark, tmp_path):
    start = "- Shared opening words of a line " * 6
    rows = [(1, start + "\nalpha  Classes ,", "en", "a", 9), (2, start + "\nbeta parties", "en", "a", 9)]
    at = folder(spark, tmp_path, documents=(rows, DOCS))
    one, two = registry.QUERIES["text_functions"](spark, at).orderBy("doc_id").collect()
    assert one.tokens.split() == re.findall("[a-z0-9]+", rows[0][1].lower()) and two.stems.endswith(" beta party")
    assert one.print != two.print and one.collapsed == " ".join(rows[0][1].split()) and two.slug.endswith("_beta_parties")
    clean = registry.QUERIES["surface_cleanup"](spark, at).orderBy("doc_id").collect()
    assert [r.clean.split("line ")[-1] for r in clean] == ["alpha Classes,.", "beta parties."]


def test_passages_are_looked_for_whole(spark, tmp_path):
    start = "an opening of sixty characters and some more that is shared by both of them "
    rows = [(1, start + "then other words", "en", "a", 9), (2, "before " + start + "then the rest", "en", "a", 9)]
    at = folder(spark, tmp_path, documents=(rows, DOCS), benchmark=([(7, start + "then the rest"), (8, start + "nowhere")], "item_id long, text string"))
    assert [(r.item_id, r.doc_id) for r in registry.QUERIES["quote_provenance"](spark, at).collect()] == [(7, 2)]
    assert registry.QUERIES["hit_rates"](spark, at).first().n_queries == 1
    assert [r.item_id for r in registry.QUERIES["retrieval_validation"](spark, at).collect()] == [7]
