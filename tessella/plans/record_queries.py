"""Queries over records: selections, contracts, nesting, and rows that win over others; with SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.operators import lexical
from tessella.plans.registry import query
from tessella.plans.text_queries import COLLAPSE, POSTINGS
from tessella.sources.tables import table


@query("subset_by_ids", "SELECT d.doc_id, d.lang FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l USING (doc_id)")
def subset_by_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(wanted, "doc_id", "left_semi")


@query(
    "unsafe_rows",
    """SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty' WHEN length(text) < 20 THEN 'short' WHEN regexp_matches(lower(substr(text, 1, 300)), '(copyright|isbn|all rights reserved)') THEN 'metadata'
  WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) < 0.4 THEN 'structure_only' ELSE 'safe' END AS verdict FROM documents""",
)
def unsafe_rows(spark, sf_dir):
    t = F.col("text")
    verdict = (
        F.when(t.isNull() | (F.length(F.trim(t)) == 0), "empty")
        .when(F.length(t) < 20, "short")
        .when(F.lower(F.substring(t, 1, 300)).rlike("(copyright|isbn|all rights reserved)"), "metadata")
        .when(T.ratio(t, "A-Za-z") < 0.4, "structure_only")
        .otherwise("safe")
    )
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query(
    "field_order",
    "SELECT field, n, row_number() OVER (ORDER BY n DESC, field) AS place FROM (SELECT 'text' AS field, count(*) FILTER (length(text) > 0) AS n FROM documents UNION ALL SELECT 'lang', count(*) FILTER (length(lang) > 0) FROM documents UNION ALL SELECT 'source', count(*) FILTER (length(source) > 1 AND source <> 'src0') FROM documents)",
)
def field_order(spark, sf_dir):
    """Which text fields are filled most: the order in which to read them."""
    filled = {"text": F.length("text") > 0, "lang": F.length("lang") > 0, "source": (F.length("source") > 1) & (F.col("source") != "src0")}
    counts = table(spark, sf_dir, "documents").agg(*(F.count_if(c).alias(k) for k, c in filled.items()))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in filled))).alias("r")).select("r.*")
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "field")))  # three rows


@query("text_fallback", "SELECT d.doc_id, coalesce(nullif(b.text, ''), left(d.text, 30), '') AS shown, CASE WHEN length(b.text) > 0 THEN 'primary' WHEN d.text IS NOT NULL THEN 'fallback' ELSE 'none' END AS origin FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def text_fallback(spark, sf_dir):
    primary = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.nullif(F.col("text"), F.lit("")).alias("first"))
    rows = table(spark, sf_dir, "documents").join(primary, "doc_id", "left")
    origin = F.when(F.col("first").isNotNull(), "primary").when(F.col("text").isNotNull(), "fallback").otherwise("none")
    return rows.select("doc_id", F.coalesce("first", F.left("text", F.lit(30)), F.lit("")).alias("shown"), origin.alias("origin"))


@query("flattened_turns", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, role, 'turn_' || substr(sha256(conv_id || ':' || turn || ':' || role), 1, 24) AS turn_id, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations")
def flattened_turns(spark, sf_dir):
    """Nested at the sink, flat inside: turns go into one row for each conversation and come out again, with ids made of their keys."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    rows = nested.select("conv_id", F.size("turns").alias("n_turns"), F.posexplode_outer("turns").alias("pos", "t"))
    key = F.concat_ws(":", "conv_id", "t.turn", "t.role")
    return rows.select("conv_id", "pos", "t.role", F.concat(F.lit("turn_"), F.substring(F.sha2(key, 256), 1, 24)).alias("turn_id"), "n_turns")


@query("counter_maps", "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def counter_maps(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    counted = counts.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("m"))
    return counted.select("source", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


@query("json_leaves", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) GROUP BY key")
def json_leaves(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props"))
    return table(spark, sf_dir, "events").where("props is not null").select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "two_pass_winners",
    f"""WITH a AS (SELECT doc_id, source, lang, n_chars, sha1(lower({COLLAPSE.format("text")})) AS print FROM documents),
  one AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source, print ORDER BY n_chars DESC, doc_id) = 1)
  SELECT doc_id FROM one WHERE print IS NULL UNION ALL SELECT doc_id FROM (SELECT * FROM one WHERE print IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, print ORDER BY n_chars DESC, doc_id) = 1)""",
)
def two_pass_winners(spark, sf_dir):
    """The best row of each block, then of each fingerprint; rows without a fingerprint pass the second."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha1(F.lower(T.collapse(F.col("text")))).alias("print"))
    order = [F.desc("n_chars"), F.col("doc_id")]
    one = rows.withColumn("place", F.row_number().over(W.partitionBy("source", "print").orderBy(*order))).where("place = 1")
    two = one.withColumn("place", F.when(F.col("print").isNotNull(), F.row_number().over(W.partitionBy("lang", "print").orderBy(*order))).otherwise(1))
    return two.where("place = 1").select("doc_id")


@query(
    "same_parent_hits",
    f"""WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10)
  SELECT item_id, doc_id, rank, source, count(*) OVER (PARTITION BY item_id, source) - 1 AS n_same FROM r JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""",
)
def same_parent_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = lexical.top(lexical.bm25(docs, table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id", 10, F.col("doc_id"))
    rows = ranked.join(docs.select("doc_id", "source"), "doc_id")
    return rows.select("item_id", "doc_id", "rank", "source", (F.count(F.lit(1)).over(W.partitionBy("item_id", "source")) - 1).alias("n_same"))


@query(
    "retrieval_validation",
    f"""WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 3),
  gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
  SELECT item_id, coalesce(bool_or(r.rank = 1), false) AS top1, coalesce(bool_or(r.rank <= 3), false) AS top3 FROM gold g LEFT JOIN r USING (item_id, doc_id) GROUP BY item_id""",
)
def retrieval_validation(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = lexical.top(lexical.bm25(docs, items, "item_id", "text"), "item_id", 3, F.col("doc_id"))
    gold = docs.select("doc_id", "text").join(items.select("item_id", F.col("text").alias("passage")), F.contains("text", "passage")).select("item_id", "doc_id")
    hit = lambda k: F.coalesce(F.bool_or(F.col("rank") <= k), F.lit(False))
    return gold.join(ranked, ["item_id", "doc_id"], "left").groupBy("item_id").agg(hit(1).alias("top1"), hit(3).alias("top3"))


@query("deterministic_sample", "SELECT doc_id, source, place FROM (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY (l.doc_id IS NULL), d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE place <= 3")
def deterministic_sample(spark, sf_dir):
    """Three of each source, labelled ones first: a sampling operator, the limit is its point."""
    marked = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(marked, "doc_id", "left")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("labelled").isNull(), "doc_id"))
    return rows.select("doc_id", "source", place.alias("place")).where("place <= 3")


@query(
    "surface_cleanup",
    r"""WITH s AS (SELECT doc_id, text AS s FROM documents),
  c AS (SELECT doc_id, s, trim(regexp_replace(regexp_replace(regexp_replace(s, '^[-*•]+\s*', ''), '\s+', ' ', 'g'), '\s+([,.;:])', '\1', 'g')) AS t FROM s),
  e AS (SELECT *, CASE WHEN length(t) > 0 AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END AS clean FROM c)
  SELECT doc_id, clean, array_to_string(list_filter([CASE WHEN regexp_matches(s, '^[-*•]+\s*') THEN 'bullet' END, CASE WHEN clean <> t THEN 'period' END, CASE WHEN regexp_matches(s, '\s\s') THEN 'blanks' END], lambda x: x IS NOT NULL), ',') AS actions FROM e""",
)
def surface_cleanup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s"))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("s", r"^[-*•]+\s*", ""), r"\s+", " "), r"\s+([,.;:])", "$1"))
    rows = rows.withColumn("t", t).withColumn("clean", F.when((F.length("t") > 0) & ~F.col("t").rlike("[.!?]$"), F.concat("t", F.lit("."))).otherwise(F.col("t")))
    log = F.array_compact(F.array(F.when(F.col("s").rlike(r"^[-*•]+\s*"), "bullet"), F.when(F.col("clean") != F.col("t"), "period"), F.when(F.col("s").rlike(r"\s\s"), "blanks")))
    return rows.select("doc_id", "clean", F.array_join(log, ",").alias("actions"))


@query(
    "ordered_distinct",
    "WITH w AS (SELECT item_id, unnest(t) AS x, unnest(range(len(t))) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)), f AS (SELECT item_id, x, min(p) AS p FROM w GROUP BY ALL) SELECT item_id, string_agg(x, ' ' ORDER BY p) AS words FROM f GROUP BY item_id",
)
def ordered_distinct(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_distinct(words), " ").alias("words"))


@query(
    "route_evaluation",
    """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, (contains(t, ' the ') OR contains(t, ' les ')) AS primary_any, (contains(t, 'tion') AND contains(t, 'an')) AS support_all, (contains(t, '%%%') OR contains(t, '!!')) AS negative,
  (contains(t, ' the ') OR contains(t, ' les ')) AND NOT (contains(t, '%%%') OR contains(t, '!!')) AS positive FROM t""",
)
def route_evaluation(spark, sf_dir):
    """Terms of a route as arrays: any of the primary, all of the supporting, none of the negative."""
    t = F.lower("text")
    terms = lambda *x: F.array(*map(F.lit, x))
    some = F.exists(terms(" the ", " les "), lambda x: F.contains(t, x))
    every = F.forall(terms("tion", "an"), lambda x: F.contains(t, x))
    bad = F.exists(terms("%%%", "!!"), lambda x: F.contains(t, x))
    return table(spark, sf_dir, "documents").select("doc_id", some.alias("primary_any"), every.alias("support_all"), bad.alias("negative"), (some & ~bad).alias("positive"))


@query("logistic_scores", "SELECT c_custkey, round(1 / (1 + exp(-least(greatest(c_acctbal / 1000, -12), 12))), 4) AS p, CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'negative' ELSE 'ok' END AS issue FROM customer")
def logistic_scores(spark, sf_dir):
    issue = F.when(F.col("c_acctbal").isNull(), "missing").when(F.col("c_acctbal") < 0, "negative").otherwise("ok")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(V.logistic(F.col("c_acctbal") / 1000), 4).alias("p"), issue.alias("issue"))


@query(
    "packet_contract",
    """WITH p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) AS turns, count(*) FILTER (text IS NULL OR length(trim(text)) = 0) AS empty, count(*) FILTER (role NOT IN ('user', 'assistant', 'system')) AS odd FROM conversations GROUP BY conv_id)
  SELECT conv_id, array_to_string(list_filter([CASE WHEN users = 0 THEN 'no_user' END, CASE WHEN first <> 0 THEN 'late_start' END, CASE WHEN turns <> n THEN 'duplicate_turn' END, CASE WHEN last - first + 1 <> turns THEN 'gap' END, CASE WHEN empty > 0 THEN 'empty_text' END, CASE WHEN odd > 0 THEN 'unknown_role' END], lambda x: x IS NOT NULL), ',') AS issues FROM p""",
)
def packet_contract(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.countDistinct("turn").alias("turns"),
        F.count_if(F.col("text").isNull() | (F.length(F.trim("text")) == 0)).alias("empty"), F.count_if(~F.col("role").isin("user", "assistant", "system")).alias("odd"),
    )
    rules = [("users = 0", "no_user"), ("first <> 0", "late_start"), ("turns <> n", "duplicate_turn"), ("last - first + 1 <> turns", "gap"), ("empty > 0", "empty_text"), ("odd > 0", "unknown_role")]
    return rows.select("conv_id", F.array_join(F.array_compact(F.array(*(F.when(F.expr(r), name) for r, name in rules))), ",").alias("issues"))
