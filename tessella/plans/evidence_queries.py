"""Queries over sentences, concepts and their candidates, with SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.operators import hybrid, scoring
from tessella.plans.registry import query
from tessella.sources.tables import concepts, table

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def content(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9_'']+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"


SENTENCES = r"""
split AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.?!;:])\s+', '\1' || chr(1), 'g'), '(\r?\n)+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents),
sentences AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS sent_idx, unnest(s) AS sentence FROM split)
"""

CONCEPTS = rf"""
concepts AS (SELECT item_id, text, item_id % 5 AS parent, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 6), ' ') AS name FROM benchmark)
"""


def _flags(column: str = "sentence") -> dict[str, str]:
    low = f"lower({column})"
    out = {f"is_{k}": "(" + " OR ".join(f"contains({low}, '{p}')" for p in v) + ")" for k, v in scoring.CUES.items()}
    tokens = f"len(list_filter(regexp_extract_all({low}, '[a-z0-9]+'), lambda t: length(t) <= 40))"
    out["is_heading"] = f"({tokens} <= 14 AND NOT regexp_matches({column}, '[.!?]$'))"
    out["is_formula"] = rf"regexp_matches({column}, '[=<>^]|\|.*\|')"
    out["is_caption"] = rf"regexp_matches({low}, '^(figure|table|fig\.) *[0-9]*')"
    out["is_fragment"] = f"({tokens} < 4 OR regexp_matches({column}, '^[a-z]'))"
    return out


def _sentences(spark, sf_dir):
    return scoring.sentence_rows(table(spark, sf_dir, "documents"))


@query("sentence_flags", f"WITH {SENTENCES} SELECT doc_id, sent_idx, md5(sentence) AS sentence_md5, " + ", ".join(f"{v} AS {k}" for k, v in _flags().items()) + " FROM sentences")
def sentence_flags(spark, sf_dir):
    s = F.col("sentence")
    return _sentences(spark, sf_dir).select("doc_id", "sent_idx", F.md5(s).alias("sentence_md5"), *(c.alias(k) for k, c in scoring.flags(s).items()))


@query("neighbour_text", f"WITH {SENTENCES} SELECT doc_id, sent_idx, md5(array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ')) AS context_md5 FROM sentences")
def neighbour_text(spark, sf_dir):
    return scoring.neighbour_text(_sentences(spark, sf_dir)).select("doc_id", "sent_idx", F.md5("context").alias("context_md5"))


_CANDIDATES = f"""
{SENTENCES}, {CONCEPTS},
tok AS (SELECT doc_id, sent_idx, unnest(list_distinct({content("sentence")})) AS token FROM sentences),
want AS (SELECT item_id, unnest(list_distinct({content("text")})) AS token FROM concepts),
candidates AS MATERIALIZED (SELECT item_id, doc_id, sent_idx, count(*) AS shared FROM tok JOIN want USING (token) GROUP BY ALL HAVING count(*) >= 3)
"""


def _candidates(spark, sf_dir):
    return scoring.candidates(_sentences(spark, sf_dir), concepts(spark, sf_dir))


@query("concept_candidates", f"WITH {_CANDIDATES} SELECT * FROM candidates")
def concept_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query("concept_candidates_top", f"WITH {_CANDIDATES} SELECT item_id, doc_id, sent_idx, shared, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id, sent_idx) AS rank FROM candidates QUALIFY rank <= 64")
def concept_candidates_top(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id", "sent_idx"))
    return _candidates(spark, sf_dir).withColumn("rank", rank).where("rank <= 64")


_RANKED = f"""{_CANDIDATES},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY shared DESC, item_id) AS place FROM candidates),
one AS (SELECT doc_id, sent_idx, item_id AS first_id, shared AS first FROM placed WHERE place = 1),
two AS (SELECT doc_id, sent_idx, item_id AS second_id, shared AS second FROM placed WHERE place = 2)
"""


@query(
    "competitor_margins",
    f"""WITH {_RANKED} SELECT doc_id, sent_idx, item_id, shared, CASE WHEN item_id = first_id THEN second_id ELSE first_id END AS other_id,
  shared - coalesce(CASE WHEN item_id = first_id THEN second ELSE first END, 0) AS margin FROM candidates JOIN one USING (doc_id, sent_idx) LEFT JOIN two USING (doc_id, sent_idx)""",
)
def competitor_margins(spark, sf_dir):
    return scoring.margins(_candidates(spark, sf_dir), "shared")


@query("broad_tokens", f"WITH {CONCEPTS}, t AS (SELECT item_id, parent, unnest(list_distinct({content('text')})) AS token FROM concepts) SELECT token, count(*) AS n_concepts, count(DISTINCT parent) AS n_parents FROM t GROUP BY token HAVING count(*) >= 4 AND count(DISTINCT parent) >= 2")
def broad_tokens(spark, sf_dir):
    return scoring.broad_tokens(concepts(spark, sf_dir))


@query(
    "competitors_top12",
    f"""WITH {CONCEPTS}, t AS (SELECT item_id, parent, list_distinct({content("text")}) AS toks FROM concepts),
  pairs AS (SELECT a.item_id, b.item_id AS other_id, (a.parent = b.parent)::INTEGER AS same, len(list_intersect(a.toks, b.toks)) AS shared FROM t a, t b WHERE a.item_id <> b.item_id)
  SELECT item_id, other_id, same, shared, row_number() OVER (PARTITION BY item_id ORDER BY same DESC, shared DESC, other_id) AS rank FROM pairs WHERE same = 1 OR shared > 0 QUALIFY rank <= 12""",
)
def competitors_top12(spark, sf_dir):
    return scoring.competitors(concepts(spark, sf_dir))


@query("siblings", f"WITH {CONCEPTS} SELECT a.item_id, string_agg(b.item_id::VARCHAR, ',' ORDER BY b.item_id) AS others FROM concepts a JOIN concepts b ON a.parent = b.parent AND a.item_id <> b.item_id GROUP BY a.item_id")
def siblings(spark, sf_dir):
    rows = scoring.siblings(concepts(spark, sf_dir))
    return rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("other_id")), lambda x: x.cast("string")), ",").alias("others"))


def _value(**weights) -> str:
    f = _flags()
    return "(" + " + ".join(f"CASE WHEN {f['is_' + k]} THEN {v} ELSE 0.0 END" for k, v in weights.items()) + ")"


_ROLES = f"""
roles AS (SELECT doc_id, sent_idx, sentence, {_value(definition=3.0, example=-0.5, fragment=-1.0)}::DOUBLE AS definition, {_value(procedure=2.5, formula=0.5)}::DOUBLE AS procedure, {_value(example=2.5)}::DOUBLE AS example,
  {_value(formula=2.0, fragment=0.25)}::DOUBLE AS formula, {_value(navigation=2.0, heading=1.0, affiliation=2.0, transition=1.0)}::DOUBLE AS context FROM sentences),
led AS (SELECT *, list_sort([{{'s': -context, 'n': 'context'}}, {{'s': -definition, 'n': 'definition'}}, {{'s': -example, 'n': 'example'}}, {{'s': -formula, 'n': 'formula'}}, {{'s': -procedure, 'n': 'procedure'}}]) AS o FROM roles)
"""


@query("sentence_roles", f"WITH {SENTENCES}, {_ROLES} SELECT doc_id, sent_idx, definition, procedure, example, formula, context, CASE WHEN -o[1].s < 1.0 THEN 'none' WHEN o[2].s - o[1].s < 0.9 THEN 'ambiguous' ELSE o[1].n END AS role FROM led")
def sentence_roles(spark, sf_dir):
    rows = _sentences(spark, sf_dir).withColumn("scores", scoring.role_scores(F.col("sentence")))
    return rows.select("doc_id", "sent_idx", "scores.*", scoring.leading_role(F.col("scores")).alias("role"))


_F = _flags()
_ADMITTED = f"""{_CANDIDATES},
printed AS (SELECT c.*, sentence, sha1(trim(regexp_replace(translate(lower(sentence), '‘’“”–— ', '''''""-- '), '\\s+', ' ', 'g'))) AS print FROM candidates c JOIN sentences USING (doc_id, sent_idx)),
usage AS (SELECT print, count(DISTINCT item_id) AS n_concepts FROM printed GROUP BY print),
admitted AS (SELECT item_id, doc_id, sent_idx, shared, n_concepts, CASE WHEN {_F["is_affiliation"]} OR {_F["is_navigation"]} THEN 'reject' WHEN {_F["is_fragment"]} AND NOT {_F["is_formula"]} THEN 'reject'
  WHEN n_concepts >= 3 THEN 'review' WHEN {_F["is_formula"]} THEN 'auxiliary_context' WHEN {_F["is_definition"]} AND shared >= 4 THEN 'definition_kernel' WHEN shared >= 4 THEN 'ordered_evidence' ELSE 'review' END AS decision
  FROM printed JOIN usage USING (print))
"""


def _admitted(spark, sf_dir):
    rows = _candidates(spark, sf_dir).join(_sentences(spark, sf_dir), ["doc_id", "sent_idx"]).withColumn("print", T.fingerprint(F.col("sentence")))
    used = rows.join(scoring.text_usage(rows), "print")
    decision = scoring.admission(scoring.flags(F.col("sentence")), F.col("shared"), F.col("n_concepts"))
    return used.select("item_id", "doc_id", "sent_idx", "shared", "n_concepts", decision.alias("decision"))


@query("evidence_admission", f"WITH {_ADMITTED} SELECT * FROM admitted")
def evidence_admission(spark, sf_dir):
    return _admitted(spark, sf_dir)


@query(
    "admission_counts",
    f"WITH {_ADMITTED} SELECT b.item_id, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d}" for d in ("reject", "review", "auxiliary_context", "definition_kernel", "ordered_evidence")) + ", count(decision) = 0 AS insufficient FROM benchmark b LEFT JOIN admitted a USING (item_id) GROUP BY b.item_id",
)
def admission_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id").join(_admitted(spark, sf_dir), "item_id", "left")
    kinds = ("reject", "review", "auxiliary_context", "definition_kernel", "ordered_evidence")
    return rows.groupBy("item_id").agg(*(F.count_if(F.coalesce(F.col("decision") == d, F.lit(False))).alias(f"n_{d}") for d in kinds), (F.count("decision") == 0).alias("insufficient"))


_CAPS = {"definition_kernel": 2, "ordered_evidence": 3, "auxiliary_context": 2, "review": 4}


@query(
    "evidence_packs",
    f"""WITH {_ADMITTED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, decision ORDER BY shared DESC, doc_id, sent_idx) AS in_role FROM admitted),
  k AS (SELECT * FROM r WHERE in_role <= CASE decision {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _CAPS.items())} ELSE 0 END)
  SELECT item_id, doc_id, sent_idx, decision, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id, sent_idx) AS rank FROM k QUALIFY rank <= 8""",
)
def evidence_packs(spark, sf_dir):
    order = [F.desc("shared"), F.col("doc_id"), F.col("sent_idx")]
    return scoring.capped(_admitted(spark, sf_dir), "item_id", "decision", order, _CAPS, 8).select("item_id", "doc_id", "sent_idx", "decision", "rank")


@query("greedy_packs")
def greedy_packs(spark, sf_dir):
    """Order-dependent: tested against a plain loop."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id", "sent_idx"))
    short = _candidates(spark, sf_dir).withColumn("rank", rank).where("rank <= 64").withColumn("score", F.col("shared") / 10.0)
    return scoring.greedy_pack(short)


_LEVELS = (0.1, 0.5, 0.9)


@query(
    "candidate_statistics",
    f"WITH {_CANDIDATES}, n AS (SELECT b.item_id, count(c.doc_id) AS n FROM benchmark b LEFT JOIN candidates c USING (item_id) GROUP BY b.item_id), o AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS t FROM n) SELECT min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, "
    + ", ".join(f"max(n) FILTER (r = greatest(1, ceil({p} * t))) AS p{int(p * 100)}" for p in _LEVELS)
    + " FROM o",
)
def candidate_statistics(spark, sf_dir):
    counts = table(spark, sf_dir, "benchmark").select("item_id").join(_candidates(spark, sf_dir), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n"))
    nearest = [F.expr(f"cast(percentile_disc({p}) within group (order by n) as bigint)").alias(f"p{int(p * 100)}") for p in _LEVELS]
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), *nearest)


@query(
    "embedding_margin_gate",
    """WITH
  long AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  cent AS (SELECT label, i, avg(x) AS m FROM long GROUP BY ALL),
  sims AS (SELECT l.vec_id, l.label AS own, c.label, sum(l.x * c.m) / (sqrt(sum(c.m * c.m)) * sqrt(sum(l.x * l.x)) + 1e-12) AS s FROM long l JOIN cent c USING (i) GROUP BY ALL),
  pair AS (SELECT vec_id, own, max(s) FILTER (label = own) AS target, max(s) FILTER (label <> own) AS rival FROM sims GROUP BY ALL)
  SELECT vec_id, own AS label, round(target, 4) AS target, round(rival, 4) AS rival, round(target, 4) - round(rival, 4) >= 0.05 AS passes FROM pair""",
)
def embedding_margin_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    long = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroid = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))
    pairs = rows.join(F.broadcast(centroid.select(F.col("label").alias("other"), "centroid")))  # one row for each label
    s = V.dot(F.col("embedding"), F.col("centroid")) / (V.norm(F.col("centroid")) * V.norm(F.col("embedding")) + 1e-12)
    own = F.col("other") == F.col("label")
    both = pairs.withColumn("s", s).groupBy("vec_id", "label").agg(F.round(F.max(F.when(own, F.col("s"))), 4).alias("target"), F.round(F.max(F.when(~own, F.col("s"))), 4).alias("rival"))
    return both.withColumn("passes", F.col("target") - F.col("rival") >= 0.05)


@query(
    "hybrid_rank",
    f"""WITH {SENTENCES}, {CONCEPTS}, v AS (SELECT vec_id, embedding FROM embeddings),
  q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
  lex AS (SELECT doc_id, len({content("text")}) AS lex, source FROM documents),
  s AS (SELECT q.query_id, v.vec_id AS doc_id, lex, source, (list_inner_product(qe, embedding)::DOUBLE / 1 + 1) / 2 AS c FROM q, v JOIN lex ON lex.doc_id = v.vec_id),
  f AS (SELECT query_id, doc_id, round((0.55 * lex / max(lex) OVER (PARTITION BY query_id) + 0.45 * c) * CASE WHEN source = 'src0' THEN 0.85 ELSE 1.0 END, 3) AS score FROM s)
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
)
def hybrid_rank(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    lex = table(spark, sf_dir, "documents").select("doc_id", F.size(T.content_tokens(F.col("text"))).alias("lex"), F.when(F.col("source") == "src0", 0.85).otherwise(1.0).alias("weight"))
    return hybrid.hybrid_top(q, v.join(lex, v.vec_id == lex.doc_id).select("doc_id", "lex", "weight", "embedding"))
