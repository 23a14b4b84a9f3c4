"""Queries over reviews, runs, sets, hierarchies and exchanges, with SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.operators import graph, lexical, library
from tessella.plans.registry import query
from tessella.plans.text_queries import COLLAPSE, TOKENS
from tessella.sources import markup
from tessella.sources.tables import table

_REVIEW = """
rows AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
scored AS (SELECT *, (CASE WHEN quality = 0 THEN 4.0 ELSE 0.0 END + CASE WHEN toxic = 1 THEN 3.0 ELSE 0.0 END + CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END + CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM rows),
bucketed AS (SELECT *, CASE WHEN n_chars < 40 THEN 'blocked' WHEN score >= 6 AND quality IS NOT NULL THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score >= 1 THEN 'low' ELSE 'none' END AS bucket FROM scored)
"""


def _reviewed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    points = {"poor": (F.col("quality") == 0, 4.0), "toxic": (F.col("toxic") == 1, 3.0), "short": (F.col("n_chars") < 300, 1.0), "foreign": (F.col("lang") != "en", 1.0)}
    score, bucket = library.priority(points, ["poor"], F.col("n_chars") < 40)
    return rows.select("doc_id", "source", "lang", "n_chars", "quality", "toxic", score.alias("score"), bucket.alias("bucket"))


@query("review_priority", f"WITH {_REVIEW} SELECT doc_id, score, bucket FROM bucketed")
def review_priority(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("doc_id", "score", "bucket")


_ORDER = "CASE bucket WHEN 'blocked' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query("review_batches", f"WITH {_REVIEW} SELECT source, batch, bucket, count(*) AS n FROM (SELECT source, bucket, ((row_number() OVER (PARTITION BY source ORDER BY {_ORDER}, score DESC, doc_id) - 1) // 12)::INTEGER AS batch FROM bucketed) GROUP BY ALL")
def review_batches(spark, sf_dir):
    place = F.when(F.col("bucket") == "blocked", 0).when(F.col("bucket") == "high", 1).when(F.col("bucket") == "medium", 2).when(F.col("bucket") == "low", 3).otherwise(4)
    rows = library.batches(_reviewed(spark, sf_dir), [place, F.desc("score"), F.col("doc_id")], 12, "source")
    return rows.groupBy("source", "batch", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_tiers",
    """WITH r AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_ev, len(list_distinct(regexp_extract_all(text, '[.?!;:]'))) AS n_roles, n_chars >= 200 AS done FROM documents),
  x AS (SELECT doc_id, n_ev, list_filter([CASE WHEN n_ev < 3 THEN 'little_evidence' END, CASE WHEN n_roles < 2 THEN 'few_roles' END, CASE WHEN NOT done THEN 'incomplete' END], lambda z: z IS NOT NULL) AS why FROM r)
  SELECT doc_id, CASE WHEN len(why) = 0 THEN 2 WHEN n_ev >= 1 THEN 1 ELSE 0 END AS tier, array_to_string(why, ',') AS reasons FROM x""",
)
def document_tiers(spark, sf_dir):
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit("([.?!;:])"), 1))
    tier, reasons = library.tier(F.size(F.split("text", "\n", -1)), F.size(marks), F.col("n_chars") >= 200)
    return table(spark, sf_dir, "documents").select("doc_id", tier.alias("tier"), reasons.alias("reasons"))


def _runs(spark, sf_dir):
    """Two runs over labelled documents: ranks within a source by quality, and by toxicity without the last tenth of the ids."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    a = rows.where("quality is not null").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("quality"), "doc_id")))
    b = rows.where("n_chars >= 200").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("toxic", "doc_id")))
    return a, b


_RUNS = """
j AS (SELECT * FROM documents JOIN labels USING (doc_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS rank FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY toxic, doc_id) AS rank FROM j WHERE n_chars >= 200),
c AS (SELECT doc_id, a.rank AS was, b.rank AS now, a.rank - b.rank AS change, CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'removed' WHEN b.rank < a.rank THEN 'better' WHEN b.rank > a.rank THEN 'worse' ELSE 'same' END AS touch FROM a FULL JOIN b USING (doc_id))
"""


@query("run_comparison", f"WITH {_RUNS} SELECT * FROM c")
def run_comparison(spark, sf_dir):
    return library.comparison(*_runs(spark, sf_dir), "doc_id", "rank")


@query("status_transitions", f"WITH {_RUNS}, s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'direct' ELSE 'fallback' END AS l FROM a), t AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 'direct' ELSE 'fallback' END AS l FROM b) SELECT s.l AS was, t.l AS now, count(*) AS n FROM s FULL JOIN t USING (doc_id) GROUP BY ALL")
def status_transitions(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    old = a.select("doc_id", F.when(F.col("quality") == 1, "direct").otherwise("fallback").alias("l"))
    new = b.select("doc_id", F.when(F.col("toxic") == 0, "direct").otherwise("fallback").alias("l"))
    return library.transitions(old, new, "doc_id", "l")


@query("no_regression_gate", f"WITH {_RUNS} SELECT count(*) FILTER (touch = 'worse') AS n_worse, count(*) FILTER (touch = 'removed') AS n_removed, count(*) FILTER (touch = 'better') AS n_better, count(*) FILTER (touch = 'worse') <= greatest(50, ceil(0.1 * count(*))) AND count(*) FILTER (touch = 'removed') = 0 AS passes FROM c")
def no_regression_gate(spark, sf_dir):
    rows = library.comparison(*_runs(spark, sf_dir), "doc_id", "rank")
    n = lambda t: F.count_if(F.col("touch") == t)
    return rows.agg(n("worse").alias("n_worse"), n("removed").alias("n_removed"), n("better").alias("n_better"), ((n("worse") <= F.greatest(F.lit(50), F.ceil(0.1 * F.count(F.lit(1))))) & (n("removed") == 0)).alias("passes"))


@query("feedback_merge", "WITH acc AS (SELECT source, doc_id, 'new' AS origin FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) AND n_chars > 500) SELECT source, doc_id, origin FROM acc UNION ALL SELECT source, doc_id, 'old' FROM documents WHERE source NOT IN (SELECT source FROM acc)")
def feedback_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    hit = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("source").distinct()
    accepted = docs.join(hit, "source", "left_semi").where("n_chars > 500").select("source", "doc_id", F.lit("new").alias("origin"))
    return library.merged(accepted, docs.select("source", "doc_id", F.lit("old").alias("origin")), "source")


@query(
    "coverage_status",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_drafted' WHEN l.quality = 0 THEN 'quarantined' WHEN l.toxic = 1 THEN 'excluded' WHEN v.vec_id IS NOT NULL THEN 'approved' ELSE 'ready' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = d.doc_id""",
)
def coverage_status(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("drafted", F.lit(True))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("approved"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    status = library.first_status((F.col("drafted").isNull(), "not_drafted"), (F.col("quality") == 0, "quarantined"), (F.col("toxic") == 1, "excluded"), (F.col("approved").isNotNull(), "approved"), otherwise="ready")
    return rows.select("doc_id", status.alias("status"))


@query(
    "coverage_summary",
    """WITH s AS (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'open' WHEN l.quality = 0 OR l.toxic = 1 THEN 'sandbox' ELSE 'frozen' END AS part FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT source, count(*) FILTER (part = 'open') AS n_open, count(*) FILTER (part = 'sandbox') AS n_sandbox, count(*) FILTER (part = 'frozen') AS n_frozen, round(100.0 * count(*) FILTER (part = 'frozen') / count(*), 2) AS percent FROM s GROUP BY source""",
)
def coverage_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    part = F.when(F.col("has").isNull(), "open").when((F.col("quality") == 0) | (F.col("toxic") == 1), "sandbox").otherwise("frozen")
    n = lambda p: F.count_if(F.col("part") == p)
    return rows.withColumn("part", part).groupBy("source").agg(n("open").alias("n_open"), n("sandbox").alias("n_sandbox"), n("frozen").alias("n_frozen"), F.round(100.0 * n("frozen") / F.count(F.lit(1)), 2).alias("percent"))


@query("registry_difference", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def registry_difference(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return library.both_ways(docs, labels, "doc_id").where("side = 'left'").unionByName(library.both_ways(docs, vectors, "doc_id").where("side = 'right'"))


@query(
    "merged_sources",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'clean' ELSE d.lang END AS tag, d.source AS owner FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def merged_sources(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tag"), F.col("source").alias("owner"))
    marked = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean").otherwise("").alias("tag"), F.lit(None).cast("string").alias("owner"))
    return library.last_filled([base, marked], "doc_id", ["tag", "owner"])


@query("latest_runs", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3")
def latest_runs(spark, sf_dir):
    return library.newest(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 3).select("event_type", "event_id")


@query("latest_artifact", "SELECT event_type, max(event_id) AS event_id, arg_max(user_id, (ts, event_id)) AS user_id FROM events GROUP BY event_type")
def latest_artifact(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.max_by("user_id", F.struct("ts", "event_id")).alias("user_id"))


@query("prune_candidates", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def prune_candidates(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("user_id is not null")
    kept = library.newest(events, "event_type", [F.desc("ts"), F.desc("event_id")], 3).select("event_id")
    protected = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return events.join(kept, "event_id", "left_anti").join(protected, "user_id", "left_anti").select("event_id")


@query(
    "json_fields",
    "SELECT event_type, count(*) AS n, count(*) FILTER (props IS NULL OR length(props) = 0) AS n_empty, sum(length(props)) AS total FROM events GROUP BY event_type",
)
def json_fields(spark, sf_dir):
    empty = F.col("props").isNull() | (F.length("props") == 0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("n_empty"), F.sum(F.length("props")).alias("total"))


@query(
    "missing_values",
    "SELECT 'text' AS field, count(*) FILTER (text IS NULL OR text = '') AS n_missing, count(*) AS n FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR lang = ''), count(*) FROM documents UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), count(*) FROM documents LEFT JOIN labels USING (doc_id)",
)
def missing_values(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    names = ["text", "lang", "quality"]
    counts = rows.agg(*(F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in names), F.count(F.lit(1)).alias("n"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing"), F.col("n").alias("n")) for c in names))).alias("r")).select("r.*")


# ---- hierarchy: regions, nations, customers

_NODES = "nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"
_CLOSED = "closed AS (SELECT node AS ancestor, node, 0 AS depth FROM nodes UNION ALL SELECT n.parent, c.node, c.depth + 1 FROM closed c JOIN nodes n ON n.node = c.ancestor WHERE n.parent IS NOT NULL)"


def _nodes(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("label"))
    return region.unionAll(nation).unionAll(customer)


@query("hierarchy_paths", f"WITH RECURSIVE {_NODES}, {_CLOSED} SELECT c.node, string_agg(n.label, '/' ORDER BY c.depth DESC) AS path, max(c.depth) AS depth FROM closed c JOIN nodes n ON n.node = c.ancestor GROUP BY c.node")
def hierarchy_paths(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.paths(nodes, graph.closure(nodes))


@query("hierarchy_rollup", f"WITH RECURSIVE {_NODES}, {_CLOSED} SELECT ancestor AS node, count(*) AS n_leaves FROM closed WHERE node LIKE 'c%' GROUP BY ancestor")
def hierarchy_rollup(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.rollup(graph.closure(nodes), nodes.where("node like 'c%'").select("node"))


@query("hierarchy_statistics", f"WITH RECURSIVE {_NODES}, {_CLOSED}, d AS (SELECT node, max(depth) AS depth FROM closed GROUP BY node) SELECT depth, count(*) AS n FROM d GROUP BY depth")
def hierarchy_statistics(spark, sf_dir):
    return graph.closure(_nodes(spark, sf_dir)).groupBy("node").agg(F.max("depth").alias("depth")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("graph_neighbourhood", f"WITH {_NODES}, k AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent) SELECT a.node, a.parent, coalesce(k.n, 0) AS n_children, coalesce(f.n - 1, 0) AS n_siblings FROM nodes a LEFT JOIN k ON k.parent = a.node LEFT JOIN k f ON f.parent = a.parent")
def graph_neighbourhood(spark, sf_dir):
    return graph.neighbourhood(_nodes(spark, sf_dir))


_BROKEN = f"{_NODES}, broken AS (SELECT CASE WHEN label LIKE '%7' THEN NULL ELSE node END AS node, CASE WHEN parent = 'n3' THEN 'n99' ELSE parent END AS parent, CASE WHEN node IN ('c5', 'c6') THEN 'Twin' ELSE label END AS label FROM nodes UNION ALL SELECT node, parent, label || 'x' FROM nodes WHERE node LIKE 'n1%')"


@query(
    "graph_issues",
    f"""WITH {_BROKEN} SELECT 'MISSING_ID' AS code, label AS record FROM broken WHERE node IS NULL
  UNION ALL SELECT 'DUPLICATE_ID', node FROM broken WHERE node IS NOT NULL GROUP BY node HAVING count(*) > 1
  UNION ALL SELECT 'DANGLING_PARENT', node FROM broken WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM broken WHERE node IS NOT NULL)
  UNION ALL SELECT 'DUPLICATE_NAME', lower(label) FROM broken GROUP BY lower(label) HAVING count(*) > 1""",
)
def graph_issues(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    broken = nodes.select(F.when(F.col("label").like("%7"), None).otherwise(F.col("node")).alias("node"), F.when(F.col("parent") == "n3", "n99").otherwise(F.col("parent")).alias("parent"), F.when(F.col("node").isin("c5", "c6"), "Twin").otherwise(F.col("label")).alias("label"))
    extra = nodes.where("node like 'n1%'").select("node", "parent", F.concat("label", F.lit("x")).alias("label"))
    return graph.issues(broken.unionAll(extra))


# ---- exchanges

_TURNS = "turns AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


@query(
    "exchange_assignment",
    f"""WITH {_TURNS}, lib AS (SELECT item_id, text FROM benchmark),
  tokens AS (SELECT item_id, {TOKENS} AS toks FROM lib), facts AS (SELECT count(*) AS n, avg(coalesce(len(toks), 0)) AS average FROM tokens),
  postings AS (SELECT term, item_id, dl, count(*) AS tf FROM (SELECT item_id, len(toks) AS dl, unnest(toks) AS term FROM tokens) GROUP BY ALL),
  weights AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  asked AS (SELECT conv_id, turn, term, count(*) AS times FROM (SELECT conv_id, turn, unnest({TOKENS}) AS term FROM turns) GROUP BY ALL),
  scores AS (SELECT conv_id, turn, item_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average) + 1e-12))), 4) AS score FROM postings JOIN weights USING (term) JOIN asked USING (term) CROSS JOIN facts GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS r FROM scores),
  best AS (SELECT t.conv_id, t.turn, max(score) FILTER (r = 1) AS top, max(score) FILTER (r = 2) AS second, max(score) FILTER (r = 3) AS third, max(item_id) FILTER (r = 1) AS item_id FROM turns t LEFT JOIN ranked USING (conv_id, turn) GROUP BY ALL)
  SELECT conv_id, turn, item_id, top, CASE WHEN top IS NULL OR top < 4.25 THEN 'no_match' WHEN (third IS NOT NULL AND top - third <= 1.5 AND top < 6.5) OR (second IS NOT NULL AND second >= greatest(0.82 * top, top - 3)) THEN 'ambiguous' ELSE 'single' END AS label FROM best""",
)
def exchange_assignment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("exchange"), "text")
    shelf = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    scores = lexical.bm25(shelf, turns, "exchange", "text")
    ranked = lexical.top(scores, "exchange", 3, F.col("doc_id"))
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    best = ranked.groupBy("exchange").agg(at(1, "score").alias("top"), at(2, "score").alias("second"), at(3, "score").alias("third"), at(1, "doc_id").alias("item_id"))
    rows = turns.select("exchange").join(best, "exchange", "left")
    label = library.assignment(F.col("top"), F.col("second"), F.col("third"), F.lit(False), F.lit(False))
    return rows.select("exchange.conv_id", "exchange.turn", "item_id", "top", label.alias("label"))


# ---- functions

_FOLD = "trim(regexp_replace(translate(lower({0}), '‘’“”–— ', '''''\"\"-- '), '\\s+', ' ', 'g'))"


@query(
    "text_functions",
    rf"""WITH s AS (SELECT doc_id, text AS s FROM documents), c AS (SELECT doc_id, s, {COLLAPSE.format("s")} AS b FROM s),
  w AS (SELECT *, list_filter(string_split(b, ' '), lambda w: regexp_matches(w, '^[A-Za-z]')) AS ws FROM c)
  SELECT doc_id, b AS collapsed, {_FOLD.format("s")} AS weak, sha1({_FOLD.format("s")}) AS print,
    regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
    regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g') AS camel,
    CASE WHEN len(ws) BETWEEN 2 AND 8 THEN upper(array_to_string(list_transform(ws, lambda w: substr(w, 1, 1)), '')) END AS acronym,
    trim(regexp_replace(regexp_replace(trim(s), '\s*\(\d+\)\s*$', ''), '\s+\d+\s*$', '')) AS heading,
    round(length(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) / greatest(length(s), 1), 4) AS alnum,
    array_to_string(list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda t: length(t) <= 40), ' ') AS tokens,
    array_to_string(list_transform(list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda t: length(t) <= 40), lambda t:
      CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN regexp_replace(t, 'ies$', 'y') WHEN length(t) > 4 AND regexp_matches(t, '(ses|xes|zes|ches|shes)$') THEN regexp_replace(t, 'es$', '')
           WHEN length(t) > 3 AND t LIKE '%s' AND NOT t LIKE '%ss' THEN regexp_replace(t, 's$', '') ELSE t END), ' ') AS stems
  FROM w""",
)
def text_functions(spark, sf_dir):
    rows, s = table(spark, sf_dir, "documents"), F.col("text")
    return rows.select(
        "doc_id", T.collapse(s).alias("collapsed"), T.weak_form(s).alias("weak"), T.fingerprint(s).alias("print"), T.slug(s).alias("slug"), T.camel_split(s).alias("camel"), T.acronym(s).alias("acronym"),
        T.heading_form(s).alias("heading"), F.round(T.ratio(s, "A-Za-z0-9"), 4).alias("alnum"), F.array_join(T.index_tokens(s), " ").alias("tokens"), F.array_join(F.transform(T.index_tokens(s), T.stem), " ").alias("stems"),
    )


@query(
    "label_overlaps",
    r"""WITH n AS (SELECT p_partkey, p_name, p_type, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part)
  SELECT p_partkey, len(list_intersect(a, b)) AS shared, round(len(list_intersect(a, b)) / greatest(least(len(a), len(b)), 1), 4) AS of_smaller, contains(' ' || array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9]+'), ' ') || ' ') AS phrase FROM n""",
)
def label_overlaps(spark, sf_dir):
    a, b = F.array_distinct(T.index_tokens(F.col("p_name"))), F.array_distinct(T.index_tokens(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("shared"), F.round(T.overlap_of_smaller(a, b), 4).alias("of_smaller"), T.contains_phrase(F.col("p_name"), F.col("p_type")).alias("phrase"))


_BITS = "list_sum(list_transform(range(62), lambda i: CASE WHEN {0}[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"


@query("hash_distances", f"WITH h AS (SELECT vec_id, {_BITS.format('embedding')} AS h FROM embeddings) SELECT a.vec_id, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id - 1")
def hash_distances(spark, sf_dir):
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 62), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    h = table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("h"))
    before = h.select((F.col("vec_id") + 1).alias("vec_id"), F.col("h").alias("b"))
    return h.join(before, "vec_id").select("vec_id", V.hamming(F.col("h"), F.col("b")).alias("distance"))


_BOX = "boxes AS (SELECT p_partkey AS k, p_partkey % 40 AS page, (p_partkey * 7 % 50)::DOUBLE AS x0, (p_partkey * 11 % 50)::DOUBLE AS y0, (p_partkey * 7 % 50 + p_size)::DOUBLE AS x1, (p_partkey * 11 % 50 + p_size / 2.0)::DOUBLE AS y1, p_partkey % 3 = 0 AS new FROM part)"


@query(
    "salvage_boxes",
    f"""WITH {_BOX}, m AS (SELECT a.k, max(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) /
    ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) + 1e-12)) AS iou
    FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND NOT b.new WHERE a.new GROUP BY a.k) SELECT k AS p_partkey FROM m WHERE coalesce(iou, 0) < 0.3""",
)
def salvage_boxes(spark, sf_dir):
    box = F.array((F.col("p_partkey") * 7 % 50).cast("double"), (F.col("p_partkey") * 11 % 50).cast("double"), (F.col("p_partkey") * 7 % 50 + F.col("p_size")).cast("double"), (F.col("p_partkey") * 11 % 50 + F.col("p_size") / 2.0).cast("double"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("page"), box.alias("box"))
    new, old = rows.where("p_partkey % 3 = 0"), rows.where("p_partkey % 3 <> 0").select(F.col("page").alias("old_page"), F.col("box").alias("old_box"))
    hit = (F.col("page") == F.col("old_page")) & (V.overlap_of_boxes(F.col("box"), F.col("old_box")) >= 0.3)
    return new.join(old, hit, "left_anti").select("p_partkey")


@query(
    "html_blocks",
    r"""WITH t AS (SELECT page_id, 'title' AS kind, unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) AS x FROM pages UNION ALL SELECT page_id, 'heading', unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) FROM pages
  UNION ALL SELECT page_id, 'list_item', unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) FROM pages UNION ALL SELECT page_id, 'footer', unnest(regexp_extract_all(html, '(?s)<footer>(.*?)</footer>', 1)) FROM pages)
  SELECT kind, count(*) AS n_blocks, count(DISTINCT page_id) AS n_pages, sum(length(trim(regexp_replace(x, '<[^>]*>', '', 'g')))) AS n_chars FROM t GROUP BY kind""",
)
def html_blocks(spark, sf_dir):
    rows = markup.typed_blocks(table(spark, sf_dir, "pages"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("page_id").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


@query("safe_ids", r"WITH b AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM pages), c AS (SELECT *, substr(base, 1, 12) AS s FROM b) SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s || '_' || upper(substr(sha1(url), 1, 8)) ELSE s END AS safe_id FROM c")
def safe_ids(spark, sf_dir):
    base = F.substring(T.slug(F.regexp_replace(F.lower("url"), "^https?://", "")), 1, 12)
    rows = table(spark, sf_dir, "pages").select("page_id", "url", base.alias("s"))
    n = F.count(F.lit(1)).over(W.partitionBy("s"))
    return rows.select("page_id", F.when(n > 1, F.concat("s", F.lit("_"), F.upper(F.substring(F.sha1("url"), 1, 8)))).otherwise(F.col("s")).alias("safe_id"))


@query(
    "sentence_contract",
    """WITH x AS (SELECT doc_id, text, substr(text, 1, 40) AS claim, substr(text, 2, 40) AS wrong FROM documents)
  SELECT doc_id, strpos(text, claim) - 1 AS char_start, contains(text, claim) AS holds, substr(text, 1, 40) = wrong AS shifted FROM x""",
)
def sentence_contract(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 40).alias("claim"), F.substring("text", 2, 40).alias("wrong"))
    return rows.select("doc_id", (F.instr(F.col("text"), F.col("claim")) - 1).alias("char_start"), F.contains("text", "claim").alias("holds"), (F.substring("text", 1, 40) == F.col("wrong")).alias("shifted"))


@query(
    "query_expansion",
    f"""WITH t AS (SELECT item_id, unnest(toks) AS term, unnest(range(len(toks))) AS place FROM (SELECT item_id, {TOKENS} AS toks FROM benchmark)),
  g AS (SELECT item_id, term, count(*) AS n, min(place) AS first FROM t WHERE length(term) > 2 GROUP BY ALL)
  SELECT item_id, term, n, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) AS rank FROM g QUALIFY rank <= 8""",
)
def query_expansion(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.index_tokens(F.col("text"))).alias("place", "term")).where("length(term) > 2")
    rows = terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("n"), "first"))
    return rows.withColumn("rank", rank).where("rank <= 8").select("item_id", "term", "n", "rank")


@query(
    "nearest_anchor",
    """WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents), a AS (SELECT source, page FROM p JOIN labels USING (doc_id) WHERE toxic = 1),
  d AS (SELECT p.doc_id, min(abs(p.page - a.page)) AS distance FROM p LEFT JOIN a USING (source) GROUP BY p.doc_id)
  SELECT doc_id, distance, CASE WHEN distance = 0 THEN 1.0 WHEN distance <= 2 THEN 0.6 WHEN distance <= 6 THEN 0.3 ELSE 0.0 END::DOUBLE AS bonus FROM d""",
)
def nearest_anchor(spark, sf_dir):
    """The last anchor before and the first after, by two windows: no product of pages and anchors."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).alias("page"))
    hit = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("anchor"))
    rows = rows.join(hit, "doc_id", "left")
    spot = F.when(F.col("anchor"), F.col("page"))
    w = W.partitionBy("source").orderBy("page")
    before = F.last(spot, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(spot, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    distance = F.least(F.col("page") - before, after - F.col("page"))
    out = rows.select("doc_id", distance.alias("distance"))
    return out.withColumn("bonus", F.when(F.col("distance") == 0, 1.0).when(F.col("distance") <= 2, 0.6).when(F.col("distance") <= 6, 0.3).otherwise(0.0))


@query(
    "location_fallback",
    """SELECT e.event_id, coalesce(a.doc_id, b.vec_id, c.c_custkey) AS owner, CASE WHEN a.doc_id IS NOT NULL THEN 'document' WHEN b.vec_id IS NOT NULL THEN 'vector' WHEN c.c_custkey IS NOT NULL THEN 'customer' ELSE 'none' END AS via
  FROM events e LEFT JOIN documents a ON a.doc_id = e.event_id LEFT JOIN embeddings b ON b.vec_id = e.user_id LEFT JOIN customer c ON c.c_custkey = e.user_id""",
)
def location_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("doc_id").alias("a"))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("vec_id").alias("b"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("c"))
    rows = e.join(a, "event_id", "left").join(b, "user_id", "left").join(c, "user_id", "left")
    via = library.first_status((F.col("a").isNotNull(), "document"), (F.col("b").isNotNull(), "vector"), (F.col("c").isNotNull(), "customer"), otherwise="none")
    return rows.select("event_id", F.coalesce("a", "b", "c").alias("owner"), via.alias("via"))


@query(
    "quote_provenance",
    f"""WITH q AS (SELECT item_id, text AS quote FROM benchmark),
  m AS (SELECT item_id, doc_id, CASE WHEN contains(d.text, quote) THEN 1 WHEN contains({_FOLD.format("d.text")}, {_FOLD.format("quote")}) THEN 2 END AS how FROM q JOIN documents d ON contains({_FOLD.format("d.text")}, {_FOLD.format("quote")}))
  SELECT item_id, doc_id, how FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY how, doc_id) = 1""",
)
def quote_provenance(spark, sf_dir):
    """Literal matches before normalised ones, then the smallest id.  The quotes are the side that Spark may broadcast."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", T.weak_form(F.col("text")).alias("weak"))
    rows = docs.join(quotes, F.contains("weak", T.weak_form(F.col("quote"))))
    how = F.when(F.contains("text", "quote"), 1).otherwise(2)
    place = F.row_number().over(W.partitionBy("item_id").orderBy("how", "doc_id"))
    return rows.select("item_id", "doc_id", how.alias("how")).withColumn("place", place).where("place = 1").drop("place")


@query("contribution", "SELECT d.doc_id // 100 AS shelf, count(*) AS n, round(100.0 * count(l.doc_id) / count(*), 2) AS percent, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def contribution(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("shelf", F.floor(F.col("doc_id") / 100))
    return rows.groupBy("shelf").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count("has") / F.count(F.lit(1)), 2).alias("percent"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query(
    "budgeted_lines",
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {'used': length(x), 'kept': 1::BIGINT}) AS n FROM documents)
  SELECT doc_id, list_reduce(n, lambda a, b: CASE WHEN a.used + b.used <= 400 THEN {'used': a.used + b.used, 'kept': a.kept + 1} ELSE a END).kept AS n_kept FROM l""",
)
def budgeted_lines(spark, sf_dir):
    from tessella.operators.scoring import n_within_budget

    lengths = F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("bigint"))
    return table(spark, sf_dir, "documents").select("doc_id", n_within_budget(lengths, 400).alias("n_kept"))
