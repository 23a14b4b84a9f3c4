"""Pages of decks: titles, windows, runs of equal headings and of near-duplicate pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T


def by_page():
    """The pages of a deck in order."""
    return W.partitionBy("source").orderBy("page_index")


def title_score(text: Column, y: Column, shortest: int = 4, longest: int = 180, top: float = 0.25, least_alnum: float = 0.30) -> Column:
    """0.6 for standing at the top and 0.4 for a fitting length; 0 if it can't be a title."""
    n = F.length(text)
    alnum = F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) / F.greatest(n, F.lit(1))
    high = F.when(y <= top, 1 - y / top * 0.5).otherwise(0.1)
    size = F.when(n > 160, 0.4).when(n > 120, 0.7).otherwise(1.0)
    return F.when((n >= shortest) & (n <= longest) & (alnum >= least_alnum), 0.6 * high + 0.4 * size).otherwise(0.0)


def titles(blocks: DataFrame) -> DataFrame:
    """doc_id, title, score: the best block of each page, the first of equals; no title where all score 0."""
    rows = blocks.withColumn("title", T.collapse(F.col("raw"))).withColumn("score", F.round(title_score(F.col("title"), F.col("y_frac")), 4))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "line"))
    return rows.where("score > 0").withColumn("place", best).where("place = 1").select("doc_id", F.substring("title", 1, 120).alias("title"), "score")


def previews(blocks: DataFrame, n: int = 12, characters: int = 400) -> DataFrame:
    """doc_id, preview: the first blocks of a page, joined."""
    first = blocks.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("line"))).where(F.col("place") <= n)
    parts = F.array_sort(F.collect_list(F.struct("line", F.substring(T.collapse(F.col("raw")), 1, characters).alias("t"))))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " | ").alias("preview"))


def page_windows(pages: DataFrame, sizes: list[int], stride: int = 1) -> DataFrame:
    """source, size, start, end of all windows of each size that fit; a deck shorter than a window has none."""
    decks = pages.groupBy("source").agg(F.max("page_index").alias("last"))
    sized = decks.select("source", "last", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("last") + 1 >= F.col("size"))
    start = F.explode(F.sequence(F.lit(0), F.col("last") + 1 - F.col("size"), F.lit(stride)))
    return sized.select("source", "size", start.alias("start")).withColumn("end", F.col("start") + F.col("size") - 1)


def runs(rows: DataFrame, breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of a deck's pages; ``breaks`` says where a new one starts."""
    return rows.withColumn("_new", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("_new").over(by_page()) - 1).drop("_new")


def heading_spans(pages: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """source, heading, start, end of consecutive pages under one heading; a missing heading breaks a run."""
    same = (F.lower("heading") == F.lag(F.lower("heading")).over(by_page())) & (F.length("heading") > 0)
    found = runs(pages, ~same).where(F.length("heading") > 0).groupBy("source", "run").agg(F.min("page_index").alias("start"), F.max("page_index").alias("end"), F.min_by("heading", "page_index").alias("heading"))
    return found.where((F.col("end") - F.col("start") + 1).between(least, most)).select("source", "heading", "start", "end")


def reveal_groups(pages: DataFrame, least_overlap: float = 0.80, least_shared: int = 20, least_tokens: int = 10, shrink: float = 0.98) -> DataFrame:
    """source, page_index, doc_id, group, canonical, is_canonical: runs of near-duplicate neighbours; the last page of a run stands for it.

    Only neighbours are compared, so runs are found by one window, not as a graph.
    """
    rows = pages.withColumn("tokens", F.array_distinct(T.index_tokens(F.col("text")))).drop("text")
    before = F.lag("tokens").over(by_page())
    shared = F.size(F.array_intersect("tokens", before))
    smaller = F.least(F.size("tokens"), F.size(before))
    joined = (smaller >= least_tokens) & (shared >= least_shared) & (shared / smaller >= least_overlap) & (F.size("tokens") >= shrink * F.size(before))
    grouped = runs(rows, ~F.coalesce(joined, F.lit(False)), "group")
    last = F.max("page_index").over(W.partitionBy("source", "group"))
    return grouped.select("source", "page_index", "doc_id", "group", last.alias("canonical"), (F.col("page_index") == last).alias("is_canonical"))


def best_patches(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """source, page_index, and the patch that covers the page best: with a heading, then shorter, then earlier.

    patches: source, patch_id, start, end, heading.  Patches are expanded to
    their pages, so the join is on equal keys.
    """
    covered = patches.select("source", "patch_id", "start", "heading", (F.col("end") - F.col("start")).alias("span"), F.explode(F.sequence("start", "end")).alias("page_index"))
    order = W.partitionBy("source", "page_index").orderBy((F.length(F.coalesce("heading", F.lit(""))) > 0).desc(), "span", "start", "patch_id")
    best = covered.withColumn("place", F.row_number().over(order)).where("place = 1").select("source", "page_index", "patch_id", "heading")
    return pages.select("source", "page_index").join(best, ["source", "page_index"], "left")


def block_winners(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """block_id, dup_of: of equal blocks in a reveal group the canonical page's wins, then the smallest id; others point at it."""
    rows = blocks.join(groups.select("doc_id", "group", "is_canonical"), "doc_id").withColumn("print", T.fingerprint(F.col("raw")))
    order = W.partitionBy("source", "group", "print").orderBy(F.col("is_canonical").desc(), "block_id")
    rows = rows.withColumn("winner", F.first("block_id").over(order))
    return rows.select("block_id", F.when(F.col("winner") != F.col("block_id"), F.col("winner")).alias("dup_of"))
