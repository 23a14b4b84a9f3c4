"""Queries over quotes and their support for concepts, with SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import matching as M
from tessella.functions import text as T
from tessella.operators import grounding as G
from tessella.operators import pairs, scoring
from tessella.plans.binding_queries import _ROUTED, _TOKS, _routed
from tessella.plans.evidence_queries import _CANDIDATES, _F, CONCEPTS, SENTENCES, _candidates, _sentences, content
from tessella.plans.registry import query
from tessella.plans.text_queries import COLLAPSE
from tessella.sources.tables import concepts, table


def _list(phrases: list[str]) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"


def _count(column: str, phrases: list[str], how: str = "contains") -> str:
    return f"len(list_filter({_list(phrases)}, lambda p: {how}({column}, p)))"


def _some(column: str, phrases: list[str], how: str = "contains") -> str:
    return f"({_count(column, phrases, how)} > 0)"


def _words(column: str, words: str) -> str:
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


def _if(condition: str, value: float) -> str:
    return f"(CASE WHEN {condition} THEN {value}::DOUBLE ELSE 0::DOUBLE END)"


def _tokens(column: str, shortest: int) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9_'']+'), lambda t: length(t) >= {shortest})"


def _names(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


_NAME_PHRASE = f"(contains(' ' || array_to_string({_TOKS.format('s.sentence')}, ' ') || ' ', ' ' || array_to_string({_TOKS.format('k.name')}, ' ') || ' ') AND len({_TOKS.format('k.name')}) > 0)"
_ROLE_SQL = {
    "definition": f"(least(3.0::DOUBLE, 0.75::DOUBLE * overlap) + {_if('exact', 2.5)} + 1.5::DOUBLE * {_count('low', G.ROLE_CUES['definition'])} + {_if(_words('low', G.LINKS), 1.25)} + {_if(_F['is_definition'], 1.25)} + {_if(_F['is_heading'] + ' AND overlap > 0', 0.5)})",
    "equation": f"({_if(f'regexp_matches(quote, $re${G.FORMULA}$re$)', 4.0)} + {_if(_some('quote', G.MATH_MARKS), 1.5)} + {_if(_F['is_formula'], 1.25)})",
    "procedure": f"({_if(f'regexp_matches(quote, $re${G.NUMBERED}$re$)', 2.5)} + {_if(f'regexp_matches(low, $re${G.IF_THEN}$re$)', 2.0)} + {_if(_some('low', G.ROLE_CUES['procedure']), 1.5)} + {_if(_some('low', G.STEP_WORDS), 1.5)} + {_if(_F['is_procedure'], 1.25)})",
    "example": f"({_if(_some('low', G.ROLE_CUES['example']), 2.5)} + {_if(_F['is_example'], 1.25)})",
    "warning": _if(_some("low", G.ROLE_CUES["warning"]), 2.5),
}
_QUOTES = f"""{_CANDIDATES},
around AS (SELECT doc_id, sent_idx, sentence, array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS context FROM sentences),
first AS (SELECT doc_id, lang, string_split_regex(text, '\\r?\\n')[1] AS heading FROM documents),
spots AS (SELECT *, max(shared) OVER (PARTITION BY doc_id, sent_idx) AS best FROM candidates),
named AS (SELECT c.item_id, c.doc_id, c.sent_idx, c.shared, c.best, s.sentence, k.name, k.parent, k.text AS item_text, f.heading, {COLLAPSE.format("s.sentence")} AS quote, {COLLAPSE.format("s.context")} AS source, coalesce(f.lang = 'de', false) AS mismatch, {_NAME_PHRASE} AS exact,
  list_distinct({_tokens("k.name", 2)}) AS n2, list_distinct({_tokens("k.name", 3)}) AS n3, list_distinct({_tokens("s.sentence", 2)}) AS s2, list_distinct({_tokens("s.sentence", 3)}) AS s3, list_distinct({_tokens("f.heading", 3)}) AS h3
  FROM spots c JOIN around s USING (doc_id, sent_idx) JOIN concepts k USING (item_id) JOIN first f USING (doc_id)),
quotes AS MATERIALIZED (SELECT *, lower(quote) AS low, len(list_intersect(n2, s2)) AS overlap, len(list_intersect(n3, s3)) AS hits, len(list_intersect(n3, h3)) AS heading_hits, best - shared AS competitor FROM named)
"""
_SCORED_ROLES = f"""{_QUOTES},
five AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _ROLE_SQL.items())} FROM quotes),
roles AS (SELECT *, CASE WHEN greatest(definition, equation, procedure, example, warning) <= 0.25 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS other FROM five)
"""


def _quotes(spark, sf_dir, close=False):
    """Candidates with their quotes and numbers of matching tokens; what depends on the sentence alone is found once for each sentence."""
    items, c = concepts(spark, sf_dir), F.col
    two, three = M.word_tokens(c("name"), 2), M.word_tokens(c("name"), 3)
    docs = pairs.dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).withColumn("mismatch", F.coalesce(c("lang") == "de", F.lit(False)))
    docs = docs.withColumn("heading_words", pairs.only_known(T.words(T.first_line(c("text"))), items, three))
    rows = pairs.sentence_rows(docs, "mismatch", "heading_words").withColumn("words", T.words(c("sentence"))).withColumn("index_words", T.index_tokens(c("sentence")))
    counts = {"shared": (T.content_tokens(c("text")), "words"), "overlap": (two, "words"), "hits": (three, "words"), "heading_hits": (three, "heading_words")}
    if close:
        counts["n_close"] = M.word_tokens(c("name"), 1), "words"
    runs = {"exact": (T.index_tokens(c("name")), "index_words")} | ({"in_row": (M.word_tokens(c("name"), 1), "words")} if close else {})
    rows = pairs.matched(rows, items, counts, runs, drop=("words", "index_words", "heading_words"), close=("n_close", "in_row"))
    rows = rows.withColumn("quote", T.collapse(c("sentence"))).withColumn("source", T.collapse(c("context"))).withColumn("low", F.lower("quote"))
    flags = F.struct(*(v.alias(k) for k, v in scoring.flags(c("sentence")).items()))
    rows = rows.withColumn("flags", flags).withColumn("marks", G.quote_marks(c("quote"), c("low"), c("source")))
    rows = pairs.by_pair(rows, "context", "source", "low").withColumn("competitor", c("best") - c("shared"))
    return rows.withColumn("shared", c("shared").cast("long")).withColumn("competitor", c("competitor").cast("long"))


def _named_quotes(spark, sf_dir):
    return _quotes(spark, sf_dir).join(concepts(spark, sf_dir).withColumnRenamed("text", "item_text"), "item_id")


def _with_roles(spark, sf_dir):
    return G.quote_roles(_quotes(spark, sf_dir), F.col("marks"), F.col("overlap"), F.col("exact"), F.col("flags"))


_KEY = ["item_id", "doc_id", "sent_idx"]


@query(
    "quote_roles",
    f"""WITH {_SCORED_ROLES}, o AS (SELECT *, list_sort([{", ".join(f"{{'s': -{r}, 'i': {i}, 'role': '{r}'}}" for i, r in enumerate(G.ROLES))}]) AS o FROM roles),
  p AS (SELECT *, -o[1].s AS top_score, o[2].s - o[1].s AS gap FROM o), d AS (SELECT *, o[1].role <> 'other' AND top_score >= {G.DOMINANT} AND gap >= {G.DOMINANT_GAP} AS dominant FROM p),
  r AS (SELECT *, CASE WHEN dominant THEN '' WHEN o[1].role = 'other' THEN 'top_role_other' WHEN top_score < {G.WEAK} THEN 'weak_top_score' WHEN gap <= {G.AMBIGUOUS_GAP} THEN 'top_two_close' ELSE '' END AS reason FROM d)
  SELECT item_id, doc_id, sent_idx, definition, equation, procedure, example, warning, other, o[1].role AS top, top_score, o[2].role AS second, dominant, reason <> '' AS ambiguous, reason FROM r""",
)
def quote_roles(spark, sf_dir):
    return _with_roles(spark, sf_dir).withColumn("ordered", G.ordered_roles(F.col("roles"))).withColumn("verdict", G.role_verdict(F.col("ordered"))).select(*_KEY, "roles.*", "verdict.*")


_READY = f"""{_SCORED_ROLES},
marks AS (SELECT *, len({_tokens("low", 2)}) AS n_tokens, ({_F["is_formula"]} OR regexp_matches(quote, $re${G.FORMULA}$re$)) AS formula, {_words("low", G.LINKS)} AS relation, {_some("low", G.GENERIC_STARTS, "starts_with")} AS generic,
  ({_F["is_navigation"]} OR {_F["is_affiliation"]} OR {_F["is_transition"]}) AS suppressed FROM roles),
parts AS (SELECT *, ({_some("low", G.FRAGMENT_STARTS, "starts_with")} OR {_some("low", G.FRAGMENT_ENDS, "suffix")} OR (n_tokens < 8 AND NOT relation) OR (formula AND n_tokens <= 10 AND NOT relation)) AS fragment,
  (source <> quote AND length(source) >= length(quote) + 20 AND ({_words("lower(source)", G.LINKS)} OR definition >= {G.STRONG_DEFINITION} OR exact)) AS completes FROM marks),
anchors AS (SELECT *, round(definition + {_if("relation", 1.25)} + {_if("exact", 1.0)} + 0.5::DOUBLE * least(2, shared) + 0.35::DOUBLE * least(2, heading_hits) - {_if(_F["is_example"] + " AND NOT relation", 1.5)} - {_if(_F["is_procedure"] + " AND NOT relation", 1.25)} - {_if("formula AND NOT relation", 1.0)}, 6) AS definition_anchor,
  round(0.55::DOUBLE * definition + {_if("completes", 1.5)} + {_if("n_tokens >= 10 AND NOT formula", 1.0)} + 0.5::DOUBLE * least(2, shared) - {_if("generic", 1.0)} - {_if(_F["is_example"] + " AND NOT relation", 1.0)}, 6) AS explanatory_anchor,
  equation + {_if("relation", 0.75)} + {_if("completes", 0.5)} AS formula_support, {_if("fragment AND completes", 3.0)} + {_if("fragment AND relation", 1.0)} + {_if("fragment AND formula AND completes", 0.5)} AS completion,
  {_if("competitor >= 2", 2.0)} + {_if("mismatch", 1.5)} + {_if("suppressed", 2.5)} + {_if("generic", 0.75)} AS penalty FROM parts),
bars AS (SELECT *, (formula AND ((contains(quote, '=') AND n_tokens <= 10) OR NOT relation OR definition_anchor < 4.0) AND NOT completes) AS formula_only, (penalty >= 2.0 OR (competitor >= 1 AND NOT exact)) AS excluded FROM anchors),
preferring AS (SELECT *, CASE WHEN definition_anchor >= greatest(explanatory_anchor, 4.5) AND NOT formula_only THEN 'definitional_anchor' WHEN completion >= 2.5 THEN 'context_completion_anchor' WHEN explanatory_anchor >= 3.0 AND NOT formula_only THEN 'explanatory_anchor'
  WHEN formula_support >= 4.0 THEN 'formula_or_parameter_anchor' WHEN excluded THEN 'contamination_or_sibling_exclusion' ELSE 'other' END AS preferred FROM bars),
ready AS (SELECT *, CASE WHEN preferred = 'definitional_anchor' AND definition_anchor >= 6.0 AND penalty < 2.0 THEN 'strong' WHEN preferred IN ('definitional_anchor', 'explanatory_anchor', 'context_completion_anchor') AND greatest(definition_anchor, explanatory_anchor, completion) >= 4.0 THEN 'usable' ELSE 'weak' END AS quality FROM preferring)
"""


def _ready(spark, sf_dir):
    flags = F.col("flags")
    suppressed = flags["is_navigation"] | flags["is_affiliation"] | flags["is_transition"]
    c = F.col
    rows = _with_roles(spark, sf_dir).withColumn("suppressed", suppressed)
    return G.support_readiness(rows, c("marks"), c("roles"), c("exact"), c("shared"), c("heading_hits"), c("competitor"), c("mismatch"), c("suppressed"), flags)


@query("support_readiness", f"WITH {_READY} SELECT item_id, doc_id, sent_idx, definition_anchor, explanatory_anchor, formula_support, completion, penalty, preferred, quality, completes, fragment, formula_only, excluded FROM ready")
def support_readiness(spark, sf_dir):
    return _ready(spark, sf_dir).select(*_KEY, "ready.*")


_W, _P, _S, _G = G.WEIGHTS, G.PENALTIES, G.SUPPORT_WEIGHTS, G.GATE
_GATED = f"""{_READY},
scored AS (SELECT *, round({_if("exact", _W["exact_name"])} + {_W["canonical_token"]}::DOUBLE * hits + {_W["context_keyword"]}::DOUBLE * shared + {_W["heading_token"]}::DOUBLE * heading_hits + CASE WHEN mismatch THEN -{_P["group_mismatch"]}::DOUBLE ELSE {_W["group_match"]}::DOUBLE END
  + {" + ".join(_if(_F["is_" + k], _W[k]) for k in ("definition", "formula", "procedure", "example"))} - {" - ".join(_if(_F["is_" + k], _P[k]) for k in ("navigation", "affiliation", "transition", "heading"))}
  + {_W["page_present"] + _W["patch_present"]}::DOUBLE + {_if("sent_idx % 5 = 0", _W["canonical_page"])} - {_if("sent_idx % 5 = 4", _P["noncanonical_page"])} - {_P["competitor_token"]}::DOUBLE * competitor
  - CASE WHEN length(quote) < {G.VERY_SHORT} THEN {_P["very_short"]}::DOUBLE WHEN length(quote) < {G.SHORT} THEN {_P["short"]}::DOUBLE ELSE 0 END - {_if("NOT exact AND hits + shared = 0", _P["no_hit"])}
  + CASE preferred WHEN 'definitional_anchor' THEN 1.0::DOUBLE WHEN 'context_completion_anchor' THEN 0.5::DOUBLE ELSE 0 END - {_if("formula_only", 1.0)} - {_if("excluded", 0.75)}, 6) AS score, round(overlap / greatest(len(n2), 1), 4) AS target, -competitor / 10 AS margin FROM ready),
gates AS (SELECT *, CASE WHEN mismatch THEN (exact OR hits > 0 OR shared >= 1) AND target >= {_G["mismatch_target"]} AND margin >= {_G["mismatch_margin"]}
  ELSE ((exact OR hits >= 2) AND target >= {_G["exact_target"]} AND margin >= {_G["exact_margin"]}) OR ((exact OR hits > 0 OR shared >= 1) AND target >= {_G["target"]} AND margin >= CASE WHEN hits >= 2 THEN {_G["multi_margin"]} ELSE {_G["margin"]} END) END AS usual,
  (competitor >= 2 AND hits = 0 AND NOT exact) AS stray, margin < {_G["negative"]} AS beaten FROM scored),
gated AS (SELECT *, round(score + {_W["rerank_target"]}::DOUBLE * target + {_W["rerank_margin"]}::DOUBLE * margin
  + CASE WHEN preferred = 'definitional_anchor' AND quality = 'strong' THEN {_S["strong_anchor"]}::DOUBLE WHEN preferred = 'definitional_anchor' AND quality = 'usable' THEN {_S["usable_anchor"]}::DOUBLE WHEN preferred IN ('explanatory_anchor', 'context_completion_anchor') THEN {_S["explanatory"]}::DOUBLE ELSE 0 END
  + {_if("completes", _S["completion"])} - {_if("formula_only", _S["formula_only"])} - {_if("excluded", _S["contamination"])}, 4) AS final, NOT suppressed AND usual AND NOT stray AS same_topic,
  {_names([("suppressed", "suppressed"), (f"mismatch AND margin < {_G['override']}", "doc_mismatch"), ("beaten", "competitor_beats_target"), ("stray", "competitor_tokens_without_target")])} AS signal_list FROM gates),
judged AS MATERIALIZED (SELECT *, CASE WHEN suppressed OR beaten THEN 'high' WHEN len(signal_list) > 0 THEN 'medium' ELSE 'low' END AS risk FROM gated)
"""


def _gated(spark, sf_dir):
    c = F.col
    rows = pairs.apart(_ready(spark, sf_dir), "sent_idx")
    score = G.sentence_score(c("marks")["length"], c("exact"), c("hits"), c("shared"), c("heading_hits"), c("competitor"), c("mismatch"), c("sent_idx") % 5 == 0, c("sent_idx") % 5 == 4, c("ready"), c("flags"))
    rows = pairs.apart(rows.withColumn("score", score), "sent_idx").withColumn("target", F.round(c("overlap") / F.greatest(c("n_overlap"), F.lit(1)), 4)).withColumn("margin", -c("competitor") / 10)
    gate = G.topic_gate(c("score"), c("target"), c("margin"), c("exact"), c("hits"), c("shared"), c("competitor"), c("mismatch"), c("suppressed"), c("ready"))
    return rows.withColumn("gate", gate)


@query("sentence_scores", f"WITH {_GATED} SELECT item_id, doc_id, sent_idx, score FROM judged")
def sentence_scores(spark, sf_dir):
    return _gated(spark, sf_dir).select(*_KEY, "score")


@query("topic_gate", f"WITH {_GATED} SELECT item_id, doc_id, sent_idx, final, same_topic, array_to_string(signal_list, ',') AS signals, risk FROM judged")
def topic_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select(*_KEY, "gate.*")


@query(
    "contamination_audit",
    f"""WITH {_GATED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id, sent_idx) AS rank FROM judged QUALIFY rank <= 5)
  SELECT item_id, count(*) AS n, count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (same_topic) AS n_same, string_agg(risk, ',' ORDER BY rank) AS risks FROM r GROUP BY item_id""",
)
def contamination_audit(spark, sf_dir):
    """The five best of each concept: how many of them are at a high risk."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("gate.final"), "doc_id", "sent_idx"))
    top = _gated(spark, sf_dir).withColumn("rank", rank).where("rank <= 5").select("item_id", "rank", "gate.risk", "gate.same_topic")
    risks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "risk"))), lambda x: x["risk"]), ",")
    return top.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") == "high").alias("n_high"), F.count_if("same_topic").alias("n_same"), risks.alias("risks"))


_CLOSE = "({0} = {1} OR (length({0}) >= 6 AND {1} = {0} || right({0}, 1)) OR (length({1}) >= 6 AND {0} = {1} || right({1}, 1)))"


@query(
    "fuzzy_sequences",
    f"""WITH {_QUOTES}, t AS (SELECT item_id, doc_id, sent_idx, {_tokens("name", 1)} AS a, {_tokens("sentence", 1)} AS b FROM quotes)
  SELECT item_id, doc_id, sent_idx, len(list_filter(list_distinct(a), lambda x: len(list_filter(b, lambda y: {_CLOSE.format("x", "y")})) > 0)) AS n_close,
    len(a) > 0 AND len(b) >= len(a) AND len(list_filter(range(0, greatest(len(b) - len(a) + 1, 0)), lambda i: len(list_filter(range(1, len(a) + 1), lambda j: NOT {_CLOSE.format("a[j]", "b[i + j]")})) = 0)) > 0 AS in_row FROM t""",
)
def fuzzy_sequences(spark, sf_dir):
    return _quotes(spark, sf_dir, close=True).select(*_KEY, "n_close", "in_row")


_PLAIN = r"regexp_replace(regexp_replace(lower({0}), '[-\s]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', ' | ', 'g')"


@query(
    "alternation_hits",
    f"""WITH {SENTENCES}, {CONCEPTS}, p AS (SELECT item_id, unnest([2, 3]) AS n, {content("name")} AS w FROM concepts WHERE len({content("name")}) > 1),
  q AS (SELECT DISTINCT item_id, ' ' || {_PLAIN.format("array_to_string(w[1:n], ' ')")} || ' ' AS phrase FROM p), t AS (SELECT doc_id, sent_idx, ' ' || {_PLAIN.format("sentence")} || ' ' AS plain FROM sentences)
  SELECT item_id, count(DISTINCT (doc_id, sent_idx)) AS n_sentences, count(DISTINCT doc_id) AS n_documents FROM q JOIN t ON contains(plain, phrase) GROUP BY item_id""",
)
def alternation_hits(spark, sf_dir):
    """Sentences that hold a short form of a concept's name; found among those that share its tokens, so no product is made."""
    words = T.content_tokens(F.col("name"))
    phrases = F.array_distinct(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 1, 3), " ")))
    named = concepts(spark, sf_dir).where(F.size(words) > 1).select("item_id", M.alternation(phrases).alias("pattern"), F.get(words, F.lit(0)).alias("word"))
    rows = _sentences(spark, sf_dir)
    found = rows.select("doc_id", "sent_idx", "sentence", F.explode(F.array_distinct(T.content_tokens(F.col("sentence")))).alias("word")).join(named, "word")
    hits = found.where(F.rlike(F.lower("sentence"), F.col("pattern")))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.countDistinct("doc_id").alias("n_documents"))


_SHAPES = {k: _words("lower({0})", v) for k, v in M.SHAPES.items()}
_SHAPES["formula_relation"] = f"({_SHAPES['formula_relation']} OR regexp_matches({{0}}, $re${M.FORMULA_MARKS.replace('{', '{{').replace('}', '}}')}$re$))"


def _shape_list(column: str) -> str:
    found = _names([(v.replace("\\p{L}", "\\p{{L}}").replace("\\p{N}", "\\p{{N}}").format(column), k) for k, v in sorted(_SHAPES.items())])
    return f"(CASE WHEN len({found}) > 0 THEN {found} ELSE ['context_phrase'] END)"


@query("evidence_shapes", f"WITH {SENTENCES} SELECT doc_id, sent_idx, array_to_string({_shape_list('sentence')}, ',') AS shapes FROM sentences")
def evidence_shapes(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "sent_idx", F.array_join(M.shapes(F.col("sentence")), ",").alias("shapes"))


@query(
    "label_terms",
    f"""WITH l AS (SELECT 'p' || p_partkey AS id, p_name || ' ' || (CASE p_partkey % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'of the model' ELSE '' END) AS label FROM part UNION ALL SELECT 'n' || n_nationkey, 'concept overview' FROM nation),
  t AS (SELECT id, list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in M.GLUE)})) AS toks FROM l),
  u AS (SELECT id, toks, list_filter(toks, lambda t: t NOT IN ({", ".join(f"'{w}'" for w in M.DESCRIPTORS)})) AS heads, list_filter(toks, lambda t: t IN ({", ".join(f"'{w}'" for w in M.DESCRIPTORS)})) AS descriptors FROM t)
  SELECT id, array_to_string(list_sort(CASE WHEN len(heads) > 0 THEN list_distinct(heads) ELSE toks[1:1] END), ' ') AS heads, array_to_string(list_sort(list_distinct(descriptors)), ' ') AS descriptors FROM u""",
)
def label_terms(spark, sf_dir):
    """Names of parts with and without descriptors, and labels of nothing else."""
    kind = F.col("p_partkey") % 3
    tail = F.when(kind == 0, "method").when(kind == 1, "of the model").otherwise("")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", tail).alias("label"))
    bare = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("concept overview").alias("label"))
    rows = parts.unionAll(bare).withColumn("t", M.label_terms(F.col("label")))
    return rows.select("id", F.array_join(F.array_sort("t.heads"), " ").alias("heads"), F.array_join(F.array_sort("t.descriptors"), " ").alias("descriptors"))


_LETTERS, _MARKS = "length(regexp_replace(q, '[^A-Za-z]', '', 'g'))", r"length(regexp_replace(q, '[^=∑∏±×÷<>/\\^_{}\[\]]', '', 'g'))"
_VERBS = _some("(' ' || low || ' ')", [f" {v} " for v in M.DEFINITION_VERBS])
_RISKS = _names(
    [
        (_some("low", M.DISCOURSE, "starts_with"), "discourse_led_surface"),
        (_some("low", M.EXAMPLES, "starts_with"), "example_or_exercise_led_surface"),
        (_some("low", M.PROCEDURES, "starts_with"), "procedure_led_surface"),
        (rf"(regexp_matches(low, '^definition\s+[0-9]') OR {_words('low', '|'.join(M.PROVENANCE))})", "history_or_provenance_surface"),
        (f"({_LETTERS} = 0 OR ({_MARKS} >= 4 AND {_LETTERS} < 18))", "formula_led_surface"),
        (rf"(regexp_matches(low, '^({M.FRAGMENTS})($|[^\p{{L}}\p{{N}}_])') OR (NOT (n_words >= 6 AND ({_VERBS} OR regexp_matches(q, '[.!?]$'))) AND n_words < 8))", "fragmentary_surface"),
    ]
)


@query(
    "surface_risks",
    f"""WITH {SENTENCES}, q AS (SELECT doc_id, sent_idx, {COLLAPSE.format("sentence")} AS q FROM sentences), w AS (SELECT *, lower(q) AS low, len(regexp_extract_all(q, '[A-Za-z0-9]+')) AS n_words FROM q)
  SELECT doc_id, sent_idx, CASE WHEN length(q) = 0 THEN 'missing_surface' ELSE array_to_string({_RISKS}, ',') END AS risks FROM w""",
)
def surface_risks(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "sent_idx", F.array_join(M.surface_risks(T.collapse(F.col("sentence"))), ",").alias("risks"))


_ROUTE_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in M.ROUTE_STOP) + ")))"


@query(
    "route_matches",
    f"""WITH {_QUOTES}, t AS (SELECT item_id, doc_id, sent_idx, {_ROUTE_TOKENS.format("sentence")} AS a, {_ROUTE_TOKENS.format("item_text")} AS b, {COLLAPSE.format("lower(sentence)")} AS x, {COLLAPSE.format("lower(item_text)")} AS y FROM quotes),
  j AS (SELECT *, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) AS jaccard FROM t)
  SELECT item_id, doc_id, sent_idx, round(jaccard, 4) AS jaccard, (length(x) > 0 AND length(y) > 0 AND (contains(x, y) OR contains(y, x))) OR jaccard >= 0.55 AS matches FROM j""",
)
def route_matches(spark, sf_dir):
    a, b = F.col("sentence"), F.col("item_text")
    return _named_quotes(spark, sf_dir).select(*_KEY, F.round(M.route_jaccard(a, b), 4).alias("jaccard"), M.route_match(a, b).alias("matches"))


_A = G.ALIGNMENT


@query(
    "alignment_scores",
    f"""WITH {_QUOTES}, t AS (SELECT *, {_tokens("sentence", 3)} AS toks, {_some("low", G.ROLE_CUES["definition"])}::INTEGER AS cue FROM quotes)
  SELECT item_id, doc_id, sent_idx, round({_if("exact", _A["exact_name"])} + {_A["canonical_token"]}::DOUBLE * hits + {_A["seed_keyword"]}::DOUBLE * shared + {_A["cue_sentence"]}::DOUBLE * least(cue, 3) + {_A["cue_and_name"]}::DOUBLE * least(CASE WHEN hits > 0 THEN cue ELSE 0 END, 2)
    + {_if("NOT exact AND heading_hits > 0", _A["heading_phrase"])} + {_A["heading_token"]}::DOUBLE * least(heading_hits, 3) + {_A["retrieval"]}::DOUBLE * shared
    - {_if("length(trim(sentence)) < 32 OR len(toks) < 4", _A["short_block"])} - {_if("len(list_distinct(toks)) <= 3", _A["generic_block"])}, 4) AS score FROM t""",
)
def alignment_scores(spark, sf_dir):
    c = F.col
    cue = F.exists(F.array(*(F.lit(p) for p in G.ROLE_CUES["definition"])), lambda p: F.contains(F.lower("quote"), p)).cast("int")
    score = G.alignment(c("exact"), c("hits"), c("shared"), cue, F.when(c("hits") > 0, cue).otherwise(0), c("heading_hits"), c("shared"), c("sentence"))
    return _quotes(spark, sf_dir).select(*_KEY, score.alias("score"))


@query(
    "snippet_scores",
    f"""WITH {_QUOTES}, b AS (SELECT parent, list_distinct(flatten(list({content("name")}))) AS branch FROM concepts GROUP BY parent),
  t AS (SELECT q.*, list_distinct({content("name")}) AS a, list_distinct({content("sentence")}) AS toks, branch, {_shape_list("sentence")} AS shapes, competitor > 0 AS sibling FROM quotes q JOIN b USING (parent)),
  s AS (SELECT *, len(list_intersect(a, toks)) AS n, len(list_intersect(branch, toks)) AS m FROM t),
  p AS (SELECT *, {_if("exact", 8.0)} + least(5.0::DOUBLE, 1.25::DOUBLE * n) + least(3.0::DOUBLE, 0.75::DOUBLE * m) + {_if("list_contains(shapes, 'definition_phrase')", 1.5)} + {_if("list_contains(shapes, 'mechanism_description')", 1.5)}
    + {_if("list_contains(shapes, 'formula_relation')", 1.25)} + {_if("list_contains(shapes, 'process_phrase')", 1.25)} - {_if("sibling AND NOT exact", 4.0)} AS score FROM s)
  SELECT item_id, doc_id, sent_idx, CASE WHEN (exact AND len(a) >= 2) OR n >= 2 THEN score ELSE least(score, 0.0) END AS score FROM p""",
)
def snippet_scores(spark, sf_dir):
    branch = concepts(spark, sf_dir).groupBy("parent").agg(F.array_distinct(F.flatten(F.collect_list(T.content_tokens(F.col("name"))))).alias("branch"))
    rows = _named_quotes(spark, sf_dir).join(branch, "parent")
    tokens = F.array_distinct(T.content_tokens(F.col("sentence")))
    return rows.select(*_KEY, G.snippet_score(F.col("exact"), F.array_distinct(T.content_tokens(F.col("name"))), F.col("branch"), tokens, F.col("competitor") > 0, M.shapes(F.col("sentence"))).alias("score"))


@query(
    "diverse_pages",
    f"""WITH {_CANDIDATES}, q AS (SELECT c.item_id, c.doc_id, c.sent_idx, c.shared, c.doc_id // 10 AS page, md5(s.sentence) AS quote FROM candidates c JOIN sentences s USING (doc_id, sent_idx)),
  a AS (SELECT *, row_number() OVER (PARTITION BY item_id, page ORDER BY shared DESC, doc_id, sent_idx) AS in_page FROM q),
  one AS (SELECT * FROM a WHERE in_page = 1), rest AS (SELECT a.* FROM a ANTI JOIN one USING (item_id, doc_id, quote)),
  two AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY item_id, doc_id, quote ORDER BY shared DESC, doc_id, sent_idx) = 1),
  every AS (SELECT 0 AS pass, * FROM one UNION ALL SELECT 1, * FROM two)
  SELECT item_id, doc_id, sent_idx, row_number() OVER (PARTITION BY item_id ORDER BY pass, shared DESC, doc_id, sent_idx) AS rank FROM every QUALIFY rank <= 12""",
)
def diverse_pages(spark, sf_dir):
    """A top-k report: twelve quotes of each concept, one a page first."""
    rows = _candidates(spark, sf_dir).join(_sentences(spark, sf_dir), ["doc_id", "sent_idx"]).withColumn("page", F.floor(F.col("doc_id") / 10)).withColumn("quote", F.md5("sentence"))
    return G.diverse(rows, "item_id", "doc_id", "page", "quote", [F.desc("shared"), F.col("doc_id"), F.col("sent_idx")], 12).select(*_KEY, "rank")


@query(
    "bundle_distances",
    f"""WITH {_CANDIDATES}, p AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id, sent_idx) = 1)
  SELECT c.item_id, c.doc_id, c.sent_idx, (CASE WHEN c.doc_id // 1000 <> p.doc_id // 1000 THEN 99 WHEN c.doc_id = p.doc_id THEN abs(c.sent_idx - p.sent_idx) WHEN c.doc_id // 50 = p.doc_id // 50 THEN CASE WHEN c.doc_id // 10 = p.doc_id // 10 THEN 1 ELSE 2 END
    WHEN c.doc_id // 10 = p.doc_id // 10 THEN 3 WHEN abs(c.doc_id - p.doc_id) <= 1 THEN 4 ELSE 99 END)::INTEGER AS distance FROM candidates c JOIN p USING (item_id)""",
)
def bundle_distances(spark, sf_dir):
    """Distances of a concept's quotes from its best one; ids in tens are pages, in fifties patches, in thousands documents."""
    rows = _candidates(spark, sf_dir)
    best = rows.groupBy("item_id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "doc_id", "sent_idx")).alias("p"))
    same = lambda n: F.floor(F.col("doc_id") / n) == F.floor(F.col("p.doc_id") / n)
    distance = G.bundle_distance(same(1000), F.col("doc_id") == F.col("p.doc_id"), F.col("sent_idx") - F.col("p.sent_idx"), same(50), same(10), F.col("doc_id") - F.col("p.doc_id"))
    return rows.join(best, "item_id").select(*_KEY, distance.alias("distance"))


_SLOT = "CASE WHEN route IN ('accept', 'accept_with_review') THEN CASE framing WHEN 'aligned' THEN 'definition' WHEN 'compatible' THEN 'gloss' WHEN 'missing' THEN 'scope' ELSE 'context' END WHEN route = 'contamination_review' THEN 'contrast' END"


def _slots(spark, sf_dir):
    framing = F.when(F.col("framing") == "aligned", "definition").when(F.col("framing") == "compatible", "gloss").when(F.col("framing") == "missing", "scope").otherwise("context")
    slot = F.when(F.col("route").isin("accept", "accept_with_review"), framing).when(F.col("route") == "contamination_review", "contrast")
    return _routed(spark, sf_dir).withColumn("slot", slot)


@query(
    "pack_quality",
    f"""WITH {_ROUTED}, s AS (SELECT item_id, {_SLOT} AS slot FROM routed),
  g AS (SELECT item_id, count(*) FILTER (slot IN ('definition', 'gloss', 'formula', 'procedure', 'scope')) AS positive, count(*) FILTER (slot = 'definition') AS definitions, count(*) FILTER (slot = 'context') AS auxiliary, count(*) FILTER (slot = 'contrast') AS guard, count(*) AS total FROM s GROUP BY item_id)
  SELECT item_id, positive, definitions, auxiliary, guard, CASE WHEN definitions > 0 AND positive >= 2 THEN 'standard_drafting' WHEN positive > 0 THEN 'partial_grounded_packet' ELSE 'insufficient_support_packet' END AS route, CASE WHEN guard >= 3 THEN 'high' WHEN guard > 0 THEN 'medium' ELSE 'low' END AS sibling_risk,
    array_to_string({_names([("definitions = 0", "definition_anchor_missing"), ("positive = 0", "weak_coverage"), ("auxiliary > 0 AND positive = 0", "auxiliary_without_positive_anchor"), ("guard > 0 AND positive = 0", "guardrail_only_support"), ("guard >= 3", "sibling_contamination_risk")])}, ',') AS insufficient,
    round(positive / total, 6) AS coverage, round((positive + auxiliary) / total, 6) AS density FROM g""",
)
def pack_quality(spark, sf_dir):
    return G.pack_quality(_slots(spark, sf_dir), "item_id")


@query(
    "pack_lanes",
    f"""WITH {_ROUTED}, g AS (SELECT b.item_id, count(*) FILTER (route = 'accept') AS o, count(*) FILTER (route IN ('accept_with_review', 'review')) AS r, count(*) FILTER (route IN ('reject', 'contamination_review')) AS x, count(route) AS n FROM benchmark b LEFT JOIN routed USING (item_id) GROUP BY b.item_id)
  SELECT item_id, o AS n_ordered, r AS n_review, x AS n_rejected, n = 0 AS zero_candidates, CASE WHEN o > 0 AND r = 0 AND x = 0 THEN 'core_ready' WHEN o > 0 THEN 'mixed_core_with_review_or_rejected' WHEN r > 0 AND x = 0 THEN 'review_only' WHEN r > 0 THEN 'mixed_review_and_rejected' WHEN x > 0 THEN 'rejected_only'
    WHEN n = 0 THEN 'insufficient_only' ELSE 'true_empty_or_unknown_schema' END AS lane, CASE WHEN n = 0 THEN 'insufficient_support' ELSE 'packed' END AS status FROM g""",
)
def pack_lanes(spark, sf_dir):
    """A pack for every concept asked for, empty ones with the reason; and the lane that its lists put it in."""
    routed = _routed(spark, sf_dir).select("item_id", "route")
    n = lambda *r: F.count_if(F.col("route").isin(*r))
    g = table(spark, sf_dir, "benchmark").select("item_id").join(routed, "item_id", "left").groupBy("item_id")
    g = g.agg(n("accept").alias("n_ordered"), n("accept_with_review", "review").alias("n_review"), n("reject", "contamination_review").alias("n_rejected"), F.count("route").alias("n"))
    zero = F.col("n") == 0
    lane = G.lane(F.col("n_ordered"), F.col("n_review"), F.col("n_rejected"), F.lit(0), F.when(zero, 1).otherwise(0))
    return g.select("item_id", "n_ordered", "n_review", "n_rejected", zero.alias("zero_candidates"), lane.alias("lane"), F.when(zero, "insufficient_support").otherwise("packed").alias("status"))


_CAPS = {"definition": 3, "gloss": 3, "scope": 2, "context": 2}


@query(
    "balanced_evidence",
    f"""WITH {_ROUTED}, s AS (SELECT item_id, doc_id, sent_idx, score, {_SLOT} AS slot, md5(sentence) AS print FROM routed),
  d AS (SELECT * FROM s WHERE slot IN ('definition', 'gloss', 'scope', 'context') QUALIFY row_number() OVER (PARTITION BY item_id, print ORDER BY score DESC, doc_id, sent_idx) = 1),
  r AS (SELECT *, list_position(['definition', 'gloss', 'scope', 'context'], slot) AS place, row_number() OVER (PARTITION BY item_id, slot ORDER BY score DESC, doc_id, sent_idx) AS in_role FROM d),
  k AS (SELECT * FROM r WHERE in_role <= CASE slot WHEN 'definition' THEN 3 WHEN 'gloss' THEN 3 ELSE 2 END)
  SELECT item_id, doc_id, sent_idx, slot, row_number() OVER (PARTITION BY item_id ORDER BY place, score DESC, doc_id, sent_idx) AS rank FROM k QUALIFY rank <= 8""",
)
def balanced_evidence(spark, sf_dir):
    """Under a cap for each role and eight in all, roles in their order; a text counts once."""
    order = [F.desc("score"), F.col("doc_id"), F.col("sent_idx")]
    rows = _slots(spark, sf_dir).where(F.col("slot").isin(list(_CAPS)))
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("item_id", "print").orderBy(*order))).where("again = 1")
    place = F.array_position(F.array(*(F.lit(k) for k in _CAPS)), F.col("slot"))
    return scoring.capped(rows, "item_id", "slot", order, _CAPS, 1 << 30).drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(place, *order))).where("rank <= 8").select(*_KEY, "slot", "rank")


@query("block_first_quotes")
def block_first_quotes(spark, sf_dir):
    """Quotes of the shortlist, one a document first, then up to three; a loop over each concept's 64 best, checked by a plain one in the tests."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id", "sent_idx"))
    rows = _candidates(spark, sf_dir).withColumn("place", rank.cast("long")).where("place <= 64").join(_sentences(spark, sf_dir), ["doc_id", "sent_idx"])
    return G.block_first(rows.withColumn("quote", F.md5(F.lower(T.collapse(F.col("sentence"))))), "item_id", "doc_id", "quote", "place", 12, 3)


@query("strong_forms")
def strong_forms(spark, sf_dir):
    """The strong normal form of whole texts; DuckDB has no compatibility forms, so a test compares it with Python's."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(M.strong_form(F.col("text"))).alias("form_md5"))


_TRUE = ", ".join(f"'{w}'" for w in M.TRUE_WORDS)


@query("truth_values", f"SELECT doc_id, coalesce(lower(trim(toxic::VARCHAR)) IN ({_TRUE}), false) AS toxic, coalesce(quality <> 0, false) AS quality FROM labels")
def truth_values(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", M.truthy(F.col("toxic")).alias("toxic"), M.truthy_number(F.col("quality")).alias("quality"))


@query(
    "packet_verdicts",
    """WITH v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'excluded' END AS verdict FROM labels), p AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL)
  SELECT coalesce(p.doc_id, v.doc_id) AS doc_id, verdict, CASE WHEN p.doc_id IS NULL THEN 'verdict_without_packet' WHEN v.doc_id IS NULL THEN 'packet_without_verdict' ELSE 'joined' END AS how, CASE WHEN p.doc_id IS NULL OR v.doc_id IS NULL THEN 'none' WHEN verdict = 'approved' THEN 'frozen' ELSE 'sandbox' END AS library FROM p FULL JOIN v ON p.doc_id = v.doc_id""",
)
def packet_verdicts(spark, sf_dir):
    """Packets with their verdicts, what has no partner, and the library that each goes to: approved ones are frozen."""
    verdict = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("excluded")
    v = table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict"), F.lit(True).alias("judged"))
    p = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.lit(True).alias("packed"))
    how = F.when(F.col("packed").isNull(), "verdict_without_packet").when(F.col("judged").isNull(), "packet_without_verdict").otherwise("joined")
    library = F.when(how != "joined", "none").when(F.col("verdict") == "approved", "frozen").otherwise("sandbox")
    return p.join(v, "doc_id", "full").select("doc_id", "verdict", how.alias("how"), library.alias("library"))


@query(
    "topic_candidates",
    f"""WITH {_CANDIDATES} SELECT k.parent, k.item_id, k.name, count(c.item_id) AS n_candidates, count(DISTINCT c.doc_id) AS n_documents FROM concepts k LEFT JOIN candidates c USING (item_id) GROUP BY ALL""",
)
def topic_candidates(spark, sf_dir):
    """The concepts of each topic with what was found for them."""
    rows = _candidates(spark, sf_dir).select("item_id", "doc_id")
    return concepts(spark, sf_dir).select("parent", "item_id", "name").join(rows, "item_id", "left").groupBy("parent", "item_id", "name").agg(F.count("doc_id").alias("n_candidates"), F.countDistinct("doc_id").alias("n_documents"))


@query("library_records", """SELECT 'kc:' || c_custkey AS id, c_name AS label, '{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS payload FROM customer""")
def library_records(spark, sf_dir):
    """Known fields as columns, all others in one payload."""
    rest = F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("kc:"), "c_custkey").alias("id"), F.col("c_name").alias("label"), rest.alias("payload"))


@query(
    "document_map",
    "SELECT coalesce(lang || ':' || (doc_id % 500), '') AS doc_key, count(*) AS n, min(doc_id) AS doc_id, CASE WHEN lang IS NULL THEN 'missing_doc_id' WHEN count(*) > 1 THEN 'duplicate_doc_id' ELSE 'ok' END AS status FROM documents GROUP BY lang, doc_id % 500",
)
def document_map(spark, sf_dir):
    """A manifest's list as a keyed map: each key once, with what is wrong about it."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", (F.col("doc_id") % 500).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    status = F.when(F.col("lang").isNull(), "missing_doc_id").when(F.col("n") > 1, "duplicate_doc_id").otherwise("ok")
    return rows.select(F.coalesce(F.concat_ws(":", F.col("lang"), F.when(F.col("lang").isNotNull(), F.col("slot"))), F.lit("")).alias("doc_key"), "n", "doc_id", status.alias("status"))


@query("family_summary", f"WITH {_ROUTED} SELECT k.parent, route, count(*) AS n, count(DISTINCT r.item_id) AS n_items, round(avg(score), 4) AS mean_score FROM routed r JOIN (SELECT item_id, parent FROM concepts) k USING (item_id) GROUP BY ALL")
def family_summary(spark, sf_dir):
    rows = _routed(spark, sf_dir).join(concepts(spark, sf_dir).select("item_id", "parent"), "item_id")
    return rows.groupBy("parent", "route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("n_items"), F.round(F.avg("score"), 4).alias("mean_score"))
