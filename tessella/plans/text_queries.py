"""Queries over lines, pages and the inverted index, with SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import clean, lexical, structure
from tessella.plans.registry import query
from tessella.sources.tables import blocks, concepts, deck_pages, table

TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) <= 40)"

POSTINGS = f"""
tokens AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
facts AS (SELECT count(*) AS n, avg(coalesce(len(toks), 0)) AS average FROM tokens),
postings AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tokens) GROUP BY ALL),
weights AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average) + 1e-12))), 4) AS score
  FROM postings JOIN weights USING (term) JOIN asked USING (term) CROSS JOIN facts GROUP BY ALL)
"""

BLOCKS = r"""
parts AS (SELECT doc_id, source, string_split_regex(text, '\r?\n') AS p FROM documents),
blocks AS (
  SELECT doc_id, source, doc_id * 10000 + line AS block_id, line, line / n AS y_frac, raw
  FROM (SELECT doc_id, source, len(p) AS n, unnest(p) AS raw, unnest(range(len(p))) AS line FROM parts)
  WHERE length(trim(raw)) > 0)
"""

COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
PAGES = rf"""
pages AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_index, doc_id, text,
         trim(regexp_replace(regexp_replace(trim(substr({COLLAPSE.format("string_split_regex(text, '\r?\n')[1]")}, 1, 60)), '\s*\(\d+\)\s*$', ''), '\s+\d+\s*$', '')) AS heading
  FROM documents)
"""


@query("bm25_topk", f"WITH {POSTINGS} SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    scores = lexical.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "text")
    return lexical.top(scores, "item_id", 5, F.col("doc_id"))


@query("index_terms", f"WITH {POSTINGS} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 4) AS idf FROM weights CROSS JOIN facts WHERE df >= 2")
def index_terms(spark, sf_dir):
    return lexical.index_terms(table(spark, sf_dir, "documents"), 2)


@query(
    "library_search",
    rf"""WITH {POSTINGS},
  titled AS (SELECT doc_id, list_filter(regexp_extract_all(lower(substr(string_split_regex(text, '\r?\n')[1], 1, 60)), '[a-z0-9]+'), lambda t: length(t) <= 40) AS title FROM documents),
  query AS (SELECT item_id, {TOKENS} AS q FROM benchmark),
  total AS (
    SELECT item_id, doc_id, round(score
      + CASE WHEN len(title) > 0 AND len(list_filter(title, lambda t: NOT list_contains(q, t))) = 0 THEN 1.4 ELSE 0.0 END
      + 0.15 * len(list_intersect(list_distinct(title), q)), 4) AS score
    FROM scores JOIN titled USING (doc_id) JOIN query USING (item_id))
  SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total WHERE score > 0) WHERE rank <= 10""",
)
def library_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    title = docs.select("doc_id", F.substring(F.element_at(T.lines(F.col("text")), 1), 1, 60).alias("title"))
    asked = items.select("item_id", T.index_tokens(F.col("text")).alias("q"))
    scores = lexical.bm25(docs, items, "item_id", "text").join(title, "doc_id").join(asked, "item_id")
    total = scores.select("item_id", "doc_id", F.round(F.col("score") + lexical.title_bonus(F.col("q"), F.col("title")), 4).alias("score")).where("score > 0")
    return lexical.top(total, "item_id", 10, F.col("doc_id"))


_GOLD = "gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(
    "hit_rates",
    f"""WITH {POSTINGS}, {_GOLD},
  ranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores),
  best AS (SELECT g.item_id, min(r.rank) AS best FROM gold g LEFT JOIN ranked r USING (item_id, doc_id) GROUP BY g.item_id)
  SELECT count(*) AS n_queries, """
    + ", ".join(f"round(avg(CASE WHEN best <= {k} THEN 1.0 ELSE 0.0 END), 4) AS hit_{k}, round(avg(CASE WHEN best <= {k} THEN 1.0 / best ELSE 0.0 END), 4) AS mrr_{k}" for k in (1, 3, 10))
    + " FROM best",
)
def hit_rates(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = lexical.top(lexical.bm25(docs, items, "item_id", "text"), "item_id", 10, F.col("doc_id"))  # no rate looks beyond the tenth
    # Few items against all documents: the items are the broadcast side only below Spark's own size threshold.
    gold = docs.select("doc_id", "text").join(items.select("item_id", F.col("text").alias("passage")), F.contains("text", "passage")).select("item_id", "doc_id")
    return lexical.hits(ranked, gold, "item_id", [1, 3, 10])


@query(
    "patch_navigation",
    f"""WITH {POSTINGS},
  decks AS (SELECT doc_id, source || ':' || lpad(((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10)::VARCHAR, 6, '0') AS patch_id FROM documents),
  found AS (SELECT item_id, patch_id, sum(times * tf * ln((n - df + 0.5) / (df + 0.5) + 1)) AS s FROM postings JOIN weights USING (term) JOIN asked USING (term) JOIN decks USING (doc_id) CROSS JOIN facts GROUP BY ALL),
  every AS (SELECT item_id, patch_id, round(coalesce(s, 0), 4) AS score FROM (SELECT DISTINCT patch_id FROM decks) CROSS JOIN (SELECT item_id FROM benchmark) LEFT JOIN found USING (item_id, patch_id))
  SELECT item_id, patch_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, patch_id) AS rank FROM every) WHERE rank <= 8""",
)
def patch_navigation(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    number = F.floor(F.col("page_index") / 10).cast("string")
    decks = deck_pages(spark, sf_dir).select("doc_id", F.concat_ws(":", "source", F.lpad(number, 6, "0")).alias("patch_id"))
    asked = items.select("item_id", F.explode(T.index_tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    found = lexical.postings(docs).join(asked.select("term").distinct(), "term", "left_semi")
    weights = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    facts = F.broadcast(lexical.collection(docs))  # one row
    part = F.col("times") * F.col("tf") * lexical.idf(F.col("n"), F.col("df"))
    scored = found.join(weights, "term").join(asked, "term").join(decks, "doc_id").crossJoin(facts).groupBy("item_id", "patch_id").agg(F.sum(part).alias("s"))
    # Every patch is a result, those without a shared term with score 0, in order of their ids.  Only items with
    # fewer than 8 scored patches need such, and for these the first 8 + 7 patches are enough.
    short = items.select("item_id").join(scored.groupBy("item_id").count().where("count >= 8"), "item_id", "left_anti")
    spare = decks.select("patch_id").distinct().orderBy("patch_id").limit(15).crossJoin(short)
    zeros = spare.join(scored, ["item_id", "patch_id"], "left_anti").select("item_id", "patch_id", F.lit(0.0).alias("s"))
    every = scored.unionByName(zeros).select("item_id", "patch_id", F.round("s", 4).alias("score"))
    return lexical.top(every, "item_id", 8, F.col("patch_id"))


_LINE = r"lower(trim(regexp_replace(raw, '[ \t\r\x0B\f]+', ' ', 'g')))"
_JUDGED = rf"""
stats AS (SELECT {_LINE} AS norm, count(DISTINCT doc_id) AS n_pages, count(*) AS n_occurrences, round(avg(CASE WHEN y_frac >= 0.85 THEN 1.0 ELSE 0.0 END), 4) AS bottom_share
  FROM blocks WHERE length(rtrim(raw)) <= 120 GROUP BY ALL HAVING length({_LINE}) > 0),
marked AS (SELECT *, (n_pages / greatest((SELECT count(*) FROM documents), 1) >= 0.6 OR n_pages >= 10) AS rep, bottom_share >= 0.6 AS low,
  regexp_matches(norm, '{clean.HARD_PATTERNS["page_number"]}') AS h1, regexp_matches(norm, '{clean.HARD_PATTERNS["address"]}') AS h2, regexp_matches(norm, '{clean.HARD_PATTERNS["copyright"]}') AS h3 FROM stats),
judged AS (SELECT norm, n_pages, n_occurrences, bottom_share,
  array_to_string(list_filter([CASE WHEN rep THEN 'repeated' END, CASE WHEN low THEN 'bottom' END, CASE WHEN h1 THEN 'page_number' END, CASE WHEN h2 THEN 'address' END, CASE WHEN h3 THEN 'copyright' END], lambda x: x IS NOT NULL), ',') AS reasons,
  rep AND (low OR h1 OR h2 OR h3) AS is_boilerplate FROM marked)
"""


def _judged(spark, sf_dir):
    return clean.judged_lines(blocks(spark, sf_dir), table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("pages_total")))


@query("line_statistics", f"WITH {BLOCKS}, {_JUDGED} SELECT * FROM judged WHERE n_pages >= 2")
def line_statistics(spark, sf_dir):
    return _judged(spark, sf_dir).where("n_pages >= 2")


@query("boilerplate_catalog", f"WITH {BLOCKS}, {_JUDGED} SELECT * FROM judged WHERE is_boilerplate ORDER BY n_pages DESC, n_occurrences DESC, norm LIMIT 200")
def boilerplate_catalog(spark, sf_dir):
    return clean.catalog(_judged(spark, sf_dir))


@query(
    "cleaned_text",
    rf"""WITH {BLOCKS}, {_JUDGED},
  marked2 AS (SELECT doc_id, line, raw, (line > 0 AND length(rtrim(raw)) <= 120 AND coalesce(is_boilerplate, false)) AS gone FROM blocks LEFT JOIN (SELECT norm, is_boilerplate FROM judged WHERE is_boilerplate) j ON {_LINE} = j.norm)
  SELECT doc_id, count(*) FILTER (NOT gone) AS n_kept, count(*) FILTER (gone) AS n_removed, md5(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS text_md5 FROM marked2 GROUP BY doc_id""",
)
def cleaned_text(spark, sf_dir):
    return clean.cleaned(blocks(spark, sf_dir), _judged(spark, sf_dir))


@query(
    "formula_coverage",
    f"""WITH r AS (SELECT source, length(text) AS n, length(regexp_replace(text, '[^{clean.MATH}]', '', 'g')) / greatest(length(text), 1) AS ratio FROM documents)
  SELECT source, count(*) AS n_pages, count(*) FILTER (n >= 200 AND ratio >= 0.002) AS n_suspect, round(avg(CASE WHEN n >= 200 AND ratio >= 0.002 THEN 1.0 ELSE 0.0 END), 4) AS share, round(avg(ratio), 6) AS mean_ratio FROM r GROUP BY source""",
)
def formula_coverage(spark, sf_dir):
    return clean.formula_coverage(table(spark, sf_dir, "documents"))


_TITLES = rf"""
scored AS (SELECT doc_id, line, {COLLAPSE.format("raw")} AS title, y_frac FROM blocks),
scored2 AS (SELECT doc_id, line, title, round(CASE WHEN length(title) BETWEEN 4 AND 180 AND length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) / greatest(length(title), 1) >= 0.30
  THEN 0.6 * CASE WHEN y_frac <= 0.25 THEN 1 - y_frac / 0.25 * 0.5 ELSE 0.1 END + 0.4 * CASE WHEN length(title) > 160 THEN 0.4 WHEN length(title) > 120 THEN 0.7 ELSE 1.0 END ELSE 0.0 END, 4) AS score FROM scored)
"""


@query("page_titles", f"WITH {BLOCKS}, {_TITLES} SELECT doc_id, substr(title, 1, 120) AS title, score FROM scored2 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1")
def page_titles(spark, sf_dir):
    return structure.titles(blocks(spark, sf_dir))


@query("title_coverage", f"WITH {BLOCKS}, {_TITLES} SELECT source, count(*) AS n_pages, round(avg(CASE WHEN t.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 4) AS titled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM scored2 WHERE score > 0) t USING (doc_id) GROUP BY source")
def title_coverage(spark, sf_dir):
    found = structure.titles(blocks(spark, sf_dir)).select("doc_id", F.lit(1.0).alias("has"))
    return table(spark, sf_dir, "documents").join(found, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg(F.coalesce("has", F.lit(0.0))), 4).alias("titled"))


@query("page_previews", f"WITH {BLOCKS} SELECT doc_id, string_agg(substr({COLLAPSE.format('raw')}, 1, 400), ' | ' ORDER BY line) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM blocks) WHERE place <= 12 GROUP BY doc_id")
def page_previews(spark, sf_dir):
    return structure.previews(blocks(spark, sf_dir))


@query(
    "page_windows",
    'WITH decks AS (SELECT source, count(*) AS n FROM documents GROUP BY source), sized AS (SELECT source, n, unnest([1, 3, 5]) AS size FROM decks) SELECT source, size, start, start + size - 1 AS "end" FROM (SELECT source, size, unnest(range(0, n - size + 1, 2)) AS start FROM sized WHERE n >= size)',
)
def page_windows(spark, sf_dir):
    return structure.page_windows(deck_pages(spark, sf_dir), [1, 3, 5], 2)


_SPANS = """
marked AS (SELECT *, CASE WHEN lower(heading) = lag(lower(heading)) OVER w AND length(heading) > 0 THEN 0 ELSE 1 END AS fresh FROM pages WINDOW w AS (PARTITION BY source ORDER BY page_index)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY page_index) AS run FROM marked),
spans AS (SELECT source, arg_min(heading, page_index) AS heading, min(page_index) AS start, max(page_index) AS "end" FROM numbered WHERE length(heading) > 0 GROUP BY source, run)
"""


@query("heading_spans", f'WITH {PAGES}, {_SPANS} SELECT source, heading, start, "end" FROM spans WHERE "end" - start + 1 BETWEEN 1 AND 40')
def heading_spans(spark, sf_dir):
    return structure.heading_spans(deck_pages(spark, sf_dir), 1)


_GROUPS = f"""
tok AS (SELECT source, page_index, doc_id, list_distinct({TOKENS}) AS t FROM pages),
prev AS (SELECT *, lag(t) OVER (PARTITION BY source ORDER BY page_index) AS b FROM tok),
joined AS (SELECT *, coalesce(least(len(t), len(b)) >= 10 AND len(list_intersect(t, b)) >= 20 AND len(list_intersect(t, b)) / least(len(t), len(b)) >= 0.8 AND len(t) >= 0.98 * len(b), false) AS j FROM prev),
grouped AS (SELECT source, page_index, doc_id, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY page_index) - 1 AS "group" FROM joined),
groups AS (SELECT *, max(page_index) OVER (PARTITION BY source, "group") AS canonical FROM grouped)
"""


@query("reveal_groups", f'WITH {PAGES}, {_GROUPS} SELECT source, page_index, doc_id, "group"::BIGINT AS "group", canonical, canonical = page_index AS is_canonical FROM groups')
def reveal_groups(spark, sf_dir):
    return structure.reveal_groups(deck_pages(spark, sf_dir))


@query(
    "best_patches",
    """WITH pages AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_index FROM documents),
  patches AS (SELECT source, source || ':' || size || ':' || start AS patch_id, start, start + size - 1 AS "end", CASE WHEN start % 4 = 0 THEN 'h' END AS heading
    FROM (SELECT source, size, unnest(range(0, n - size + 1, 2)) AS start FROM (SELECT source, n, unnest([3, 5]) AS size FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) WHERE n >= size))
  SELECT p.source, p.page_index, q.patch_id, q.heading FROM pages p LEFT JOIN (
    SELECT source, page_index, patch_id, heading FROM (SELECT source, patch_id, heading, start, "end" - start AS span, unnest(range(start, "end" + 1)) AS page_index FROM patches)
    QUALIFY row_number() OVER (PARTITION BY source, page_index ORDER BY heading IS NULL, span, start, patch_id) = 1) q USING (source, page_index)""",
)
def best_patches(spark, sf_dir):
    pages = deck_pages(spark, sf_dir)
    windows = structure.page_windows(pages, [3, 5], 2)
    patches = windows.select("source", F.concat_ws(":", "source", "size", "start").alias("patch_id"), "start", "end", F.when(F.col("start") % 4 == 0, "h").alias("heading"))
    return structure.best_patches(pages, patches)


@query(
    "block_winners",
    rf"""WITH {BLOCKS}, {PAGES}, {_GROUPS},
  prints AS (SELECT b.block_id, b.source, g."group", g.canonical = g.page_index AS c,
    sha1(trim(regexp_replace(translate(lower(raw), '‘’“”–— ', '''''""-- '), '\s+', ' ', 'g'))) AS print FROM blocks b JOIN groups g USING (doc_id)),
  won AS (SELECT block_id, first_value(block_id) OVER (PARTITION BY source, "group", print ORDER BY c DESC, block_id) AS winner FROM prints)
  SELECT block_id, CASE WHEN winner <> block_id THEN winner END AS dup_of FROM won""",
)
def block_winners(spark, sf_dir):
    return structure.block_winners(blocks(spark, sf_dir), structure.reveal_groups(deck_pages(spark, sf_dir)))
