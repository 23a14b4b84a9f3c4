"""Queries over bound and routed candidates, with SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import binding, pairs, scoring
from tessella.plans.evidence_queries import _CANDIDATES, _F, CONCEPTS, content
from tessella.plans.registry import query
from tessella.sources.tables import concepts, table

_TOKS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) <= 40)"

_LINK = binding.LINKERS
_BOUND = f"""{_CANDIDATES},
first AS (SELECT doc_id, source, string_split_regex(text, '\\r?\\n')[1] AS heading FROM documents),
raw AS (SELECT c.item_id, c.doc_id, c.sent_idx, c.shared AS text_shared, s.sentence, k.name, f.source, list_distinct({content("k.name")}) AS nt, list_distinct({content("s.sentence")}) AS st, list_distinct({content("f.heading")}) AS ht,
  contains(' ' || array_to_string({_TOKS.format("s.sentence")}, ' ') || ' ', ' ' || array_to_string({_TOKS.format("k.name")}, ' ') || ' ') AND len({_TOKS.format("k.name")}) > 0 AS exact,
  lower(regexp_extract(s.sentence, '^(.*?){_LINK}', 1)) AS subject
  FROM candidates c JOIN sentences s USING (doc_id, sent_idx) JOIN concepts k USING (item_id) JOIN first f USING (doc_id)),
sized AS (SELECT *, len(list_intersect(nt, st)) AS shared, len(list_intersect(nt, ht)) AS hshared, len(list_intersect(list_distinct({content("subject")}), nt)) / greatest(len(nt), 1) AS sshare FROM raw),
bound AS (SELECT *, CASE WHEN exact THEN 'strong' WHEN shared / greatest(len(nt), 1) >= 0.6 AND shared >= 2 THEN 'usable' WHEN shared >= 1 AND hshared >= 1 THEN 'usable' WHEN shared >= 1 THEN 'weak' ELSE 'none' END AS binding,
  CASE WHEN length(subject) = 0 THEN 'missing' WHEN sshare >= 0.8 THEN 'aligned' WHEN sshare > 0 THEN 'compatible' WHEN regexp_matches(subject, '^(unlike|in contrast|whereas|not )') THEN 'contrastive' ELSE 'mismatch' END AS framing FROM sized),
placed2 AS (SELECT *, max(text_shared) OVER (PARTITION BY doc_id, sent_idx) AS best, count(*) OVER (PARTITION BY doc_id, sent_idx) AS n_use FROM bound)
"""


def _bound(spark, sf_dir):
    """Candidates bound to their concepts.  What depends on the sentence alone is found once for each sentence, not for each pair."""
    items = concepts(spark, sf_dir)
    name, c = T.content_tokens(F.col("name")), F.col
    docs = table(spark, sf_dir, "documents").withColumn("heading_words", pairs.only_known(T.words(T.first_line(c("text"))), items, name))
    rows = pairs.sentence_rows(docs, "source", "heading_words").drop("context")
    rows = rows.withColumn("words", T.words(c("sentence"))).withColumn("index_words", T.index_tokens(c("sentence"))).withColumn("subject_words", T.words(binding.subject_of(c("sentence"))))
    counts = {"shared": (T.content_tokens(c("text")), "words"), "in_name": (name, "words"), "in_heading": (name, "heading_words"), "in_subject": (name, "subject_words")}
    rows = pairs.matched(rows, items, counts, {"exact": (T.index_tokens(c("name")), "index_words")}, drop=("words", "index_words", "subject_words", "heading_words"))
    rows = rows.withColumn("subject", binding.subject_of(c("sentence"))).withColumn("flags", F.struct(*(v.alias(k) for k, v in scoring.flags(c("sentence")).items())))
    rows = rows.withColumn("has_subject", F.length("subject") > 0).withColumn("contrast", binding.contrasts(c("subject"))).withColumn("print", F.md5("sentence"))
    rows = pairs.by_pair(rows, "subject", "sentence")
    label, points = binding.definition_framing(c("has_subject"), c("contrast"), c("in_subject"), c("n_in_name"))
    bound = binding.target_binding(c("exact"), c("in_name"), c("n_in_name"), c("in_heading"))
    return rows.select("item_id", "doc_id", "sent_idx", "source", c("shared").alias("text_shared"), "best", "n_use", "print", "flags", bound.alias("binding"), label.alias("framing"), points.alias("framing_score"))


@query("target_binding", f"WITH {_BOUND} SELECT item_id, doc_id, sent_idx, binding, framing FROM bound")
def target_binding(spark, sf_dir):
    return _bound(spark, sf_dir).select("item_id", "doc_id", "sent_idx", "binding", "framing")


_ROUTED = f"""{_BOUND},
risky AS (SELECT *, list_filter([CASE WHEN binding IN ('none', 'weak') THEN 'weak_binding' END, CASE WHEN {_F["is_formula"]} THEN 'formula' END, CASE WHEN {_F["is_procedure"]} THEN 'procedure' END, CASE WHEN {_F["is_example"]} THEN 'example' END,
  CASE WHEN {_F["is_navigation"]} THEN 'navigation' END, CASE WHEN {_F["is_fragment"]} THEN 'fragment' END, CASE WHEN n_use >= 3 THEN 'shared_by_many' END, CASE WHEN text_shared - best < 0 THEN 'closer_to_other' END], lambda x: x IS NOT NULL) AS risks,
  round(0.5 * text_shared + CASE framing WHEN 'aligned' THEN 2.5 WHEN 'compatible' THEN 1.7 WHEN 'contrastive' THEN -2.5 WHEN 'mismatch' THEN -1.75 ELSE 0.0 END + CASE binding WHEN 'strong' THEN 2.0 WHEN 'usable' THEN 1.0 ELSE 0.0 END, 4)::DOUBLE AS score FROM placed2),
routed AS (SELECT *, CASE WHEN binding = 'none' THEN 'reject' WHEN list_has_any(risks, ['navigation', 'closer_to_other']) THEN 'contamination_review' WHEN score >= 4 AND len(risks) = 0 THEN 'accept'
  WHEN score >= 2.5 AND binding <> 'weak' THEN 'accept_with_review' WHEN score >= 1 THEN 'review' ELSE 'reject' END AS route FROM risky)
"""


def _routed(spark, sf_dir):
    rows = _bound(spark, sf_dir)
    risks = binding.risk_flags(F.col("flags"), F.col("binding"), F.col("n_use"), F.col("text_shared") - F.col("best"))
    score = F.round(0.5 * F.col("text_shared") + F.col("framing_score") + F.when(F.col("binding") == "strong", 2.0).when(F.col("binding") == "usable", 1.0).otherwise(0.0), 4)
    rows = rows.withColumn("risks", risks).withColumn("score", score)
    return rows.withColumn("route", binding.routing(F.col("score"), F.col("risks"), F.col("binding")))


@query("candidate_routing", f"WITH {_ROUTED} SELECT item_id, doc_id, sent_idx, score, array_to_string(risks, ',') AS risks, route FROM routed")
def candidate_routing(spark, sf_dir):
    return _routed(spark, sf_dir).select("item_id", "doc_id", "sent_idx", "score", F.array_join("risks", ",").alias("risks"), "route")


@query("risk_counts", f"WITH {_ROUTED} SELECT risk, route, count(*) AS n FROM (SELECT unnest(risks) AS risk, route FROM routed) GROUP BY ALL")
def risk_counts(spark, sf_dir):
    return _routed(spark, sf_dir).select(F.explode("risks").alias("risk"), "route").groupBy("risk", "route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "support_summary",
    f"""WITH {_ROUTED}, g AS (SELECT item_id, count(*) AS n, count(*) FILTER (route = 'accept') AS n_accept, count(*) FILTER (route = 'accept_with_review') AS n_review, count(DISTINCT CASE WHEN route IN ('accept', 'accept_with_review') THEN doc_id END) AS n_docs FROM routed GROUP BY item_id)
  SELECT item_id, n, n_accept, n_review, n_docs, array_to_string(list_filter([CASE WHEN n_accept = 0 THEN 'no_direct' END, CASE WHEN n_accept + n_review < 3 THEN 'few' END, CASE WHEN n_docs < 2 THEN 'one_document' END], lambda x: x IS NOT NULL), ',') AS weak_reasons,
    CASE WHEN n_accept >= 3 THEN 'ready' WHEN n_accept + n_review >= 3 THEN 'needs_review' WHEN n_accept + n_review > 0 THEN 'thin' ELSE 'insufficient' END AS lane FROM g""",
)
def support_summary(spark, sf_dir):
    return binding.support_summary(_routed(spark, sf_dir), "item_id")


@query("near_misses", f"WITH {_ROUTED} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, sent_idx) AS rank, doc_id, sent_idx, score, coalesce(risks[1], 'low_score') AS diagnosis FROM routed WHERE route NOT IN ('accept', 'accept_with_review') QUALIFY rank <= 6")
def near_misses(spark, sf_dir):
    return binding.near_misses(_routed(spark, sf_dir), "item_id")


@query(
    "region_bonus",
    f"""WITH {_BOUND}, d AS (SELECT item_id, doc_id, min(sent_idx) AS low, max(sent_idx) AS high FROM bound WHERE binding = 'strong' GROUP BY ALL), s AS (SELECT DISTINCT item_id, source FROM bound WHERE binding = 'strong')
  SELECT b.item_id, b.doc_id, b.sent_idx, CASE WHEN b.sent_idx BETWEEN low - 2 AND high + 2 THEN 1.0 WHEN low IS NOT NULL THEN 0.6 WHEN s.source IS NOT NULL THEN 0.3 ELSE 0.0 END::DOUBLE AS bonus
  FROM bound b LEFT JOIN d USING (item_id, doc_id) LEFT JOIN s ON s.item_id = b.item_id AND s.source = b.source""",
)
def region_bonus(spark, sf_dir):
    return binding.region_bonus(_bound(spark, sf_dir)).select("item_id", "doc_id", "sent_idx", "bonus")


@query(
    "phrase_index",
    rf"""WITH {CONCEPTS}, b AS (SELECT item_id, trim(regexp_replace(name, '\s+', ' ', 'g')) AS n FROM concepts),
  v AS (SELECT item_id, unnest([n, trim(regexp_replace(regexp_replace(n, '[-/]', ' ', 'g'), '\s+', ' ', 'g')), trim(regexp_replace(regexp_replace(n, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')), lower(n)]) AS f FROM b),
  t AS (SELECT item_id, {_TOKS.format("f")} AS toks FROM v WHERE length(f) > 0 UNION ALL SELECT item_id, list_slice({content("name")}, 1, 2) FROM concepts UNION ALL SELECT item_id, [x] FROM (SELECT item_id, unnest({content("name")}) AS x FROM concepts)),
  r AS (SELECT DISTINCT item_id, array_to_string(toks, ' ') AS phrase, len(toks) AS n_tokens FROM t WHERE len(toks) > 0), u AS (SELECT phrase, count(DISTINCT item_id) AS n_concepts FROM r GROUP BY phrase)
  SELECT item_id, phrase, n_tokens, n_concepts FROM r JOIN u USING (phrase) WHERE n_tokens > 1 OR n_concepts <= 0.25 * (SELECT count(*) FROM concepts)""",
)
def phrase_index(spark, sf_dir):
    return binding.phrases(concepts(spark, sf_dir))


@query(
    "acceptance_gates",
    f"""WITH {_ROUTED}, g AS (SELECT item_id, count(*) FILTER (route = 'accept') AS a, count(*) FILTER (route = 'contamination_review') AS c, count(*) AS n FROM routed GROUP BY item_id)
  SELECT count(*) AS n_items, count(*) FILTER (a >= 2) AS n_strong, sum(c)::BIGINT AS n_contaminated, round(avg(a / n), 4) AS mean_accept, count(*) FILTER (a >= 2) >= 10 AND sum(c) <= 1000 AS passes FROM g""",
)
def acceptance_gates(spark, sf_dir):
    n = lambda r: F.count_if(F.col("route") == r)
    g = _routed(spark, sf_dir).groupBy("item_id").agg(n("accept").alias("a"), n("contamination_review").alias("c"), F.count(F.lit(1)).alias("n"))
    strong = F.count_if(F.col("a") >= 2)
    return g.agg(F.count(F.lit(1)).alias("n_items"), strong.alias("n_strong"), F.sum("c").alias("n_contaminated"), F.round(F.avg(F.col("a") / F.col("n")), 4).alias("mean_accept"), ((strong >= 10) & (F.sum("c") <= 1000)).alias("passes"))


@query(
    "runtime_package",
    r"""WITH t AS (SELECT b.item_id, b.text, list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]+'), lambda t: length(t) <= 40) AS toks FROM benchmark b)
  SELECT 'pkg:' || item_id AS entry_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS display_text, array_to_string(list_sort(list_distinct(toks)), ' ') AS search_terms, substr(sha256(text), 1, 24) AS text_id FROM t""",
)
def runtime_package(spark, sf_dir):
    terms = F.array_join(F.array_sort(F.array_distinct(T.index_tokens(F.col("text")))), " ")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("pkg:"), "item_id").alias("entry_id"), T.collapse(F.col("text")).alias("display_text"), terms.alias("search_terms"), F.substring(F.sha2("text", 256), 1, 24).alias("text_id"))


@query(
    "review_events",
    """WITH e AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'edit' ELSE 'approve' END AS action, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
  f AS (SELECT *, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE CASE WHEN n_chars > 1000 THEN 'approved_after_edit' ELSE 'edit_pending' END END AS status FROM e)
  SELECT doc_id, action, status, array_to_string(list_filter([CASE WHEN action = 'approve' AND n_chars = 0 THEN 'empty_approved' END, CASE WHEN status = 'edit_pending' AND n_chars > 1000 THEN 'open_edit' END], lambda x: x IS NOT NULL), ',') AS violations,
    status IN ('approved', 'approved_after_edit') AS frozen FROM f""",
)
def review_events(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.withColumn("action", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "edit").otherwise("approve"))
    resolved = F.when(F.col("n_chars") > 1000, "approved_after_edit").otherwise("edit_pending")
    rows = rows.withColumn("status", F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise(resolved))
    bad = F.array_compact(F.array(F.when((F.col("action") == "approve") & (F.col("n_chars") == 0), "empty_approved"), F.when((F.col("status") == "edit_pending") & (F.col("n_chars") > 1000), "open_edit")))
    return rows.select("doc_id", "action", "status", F.array_join(bad, ",").alias("violations"), F.col("status").isin("approved", "approved_after_edit").alias("frozen"))
