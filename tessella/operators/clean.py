"""Repeated boilerplate lines: statistics, decision, catalog and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

LONGEST_LINE, BOTTOM = 120, 0.85
LEAST_PAGE_SHARE, LEAST_PAGES, BOTTOM_MAJORITY = 0.60, 10, 0.60
#: Patterns that mark a repeated line as boilerplate wherever it stands.
HARD_PATTERNS = {
    "page_number": r"^(page\s*)?[0-9]+\s*(/|of)?\s*[0-9]*\s*$",
    "address": r"https?://\S+|www\.\S+|[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+",
    "copyright": r"(copyright|©|\(c\))",
}
#: Characters that formulas are made of.
MATH = "∑∏√∫≈≠≤≥±×÷∞∂∇∈∉⊂⊆⊄⊇∪∩→←↔⇒⇔αβγδεζηθικλμνξοπρστυφχψω"


def line_statistics(blocks: DataFrame) -> DataFrame:
    """norm, n_pages, n_occurrences, bottom_share of every line that isn't too long."""
    rows = blocks.where(F.length(F.rtrim("raw")) <= LONGEST_LINE).select(T.line_form(F.col("raw")).alias("norm"), "doc_id", (F.col("y_frac") >= BOTTOM).cast("double").alias("low"))
    return rows.where(F.length("norm") > 0).groupBy("norm").agg(F.countDistinct("doc_id").alias("n_pages"), F.count(F.lit(1)).alias("n_occurrences"), F.round(F.avg("low"), 4).alias("bottom_share"))


def judged_lines(blocks: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Line statistics with the reasons found and the decision: repeated, and at the bottom or of a hard pattern."""
    rows = line_statistics(blocks).crossJoin(F.broadcast(n_pages))  # one row
    repeated = (F.col("n_pages") / F.greatest(F.col("pages_total"), F.lit(1)) >= LEAST_PAGE_SHARE) | (F.col("n_pages") >= LEAST_PAGES)
    low = F.col("bottom_share") >= BOTTOM_MAJORITY
    hard = {k: F.col("norm").rlike(p) for k, p in HARD_PATTERNS.items()}
    any_hard = hard["page_number"] | hard["address"] | hard["copyright"]
    reasons = F.array_compact(F.array(F.when(repeated, "repeated"), F.when(low, "bottom"), *(F.when(c, k) for k, c in hard.items())))
    return rows.select("norm", "n_pages", "n_occurrences", "bottom_share", F.array_join(reasons, ",").alias("reasons"), (repeated & (low | any_hard)).alias("is_boilerplate"))


def catalog(judged: DataFrame, n: int = 200) -> DataFrame:
    """The most repeated boilerplate lines."""
    return judged.where("is_boilerplate").orderBy(F.desc("n_pages"), F.desc("n_occurrences"), "norm").limit(n)


def cleaned(blocks: DataFrame, judged: DataFrame) -> DataFrame:
    """doc_id, kept and removed lines, and the text that is left in order.

    Lines are matched by an equi-join on their normal form; a document's first
    line is protected as its title.
    """
    flagged = judged.where("is_boilerplate").select("norm", F.lit(True).alias("flagged"))
    rows = blocks.withColumn("norm", T.line_form(F.col("raw"))).join(flagged, "norm", "left")
    gone = F.coalesce("flagged", F.lit(False)) & (F.col("line") > 0) & (F.length(F.rtrim("raw")) <= LONGEST_LINE)
    parts = F.collect_list(F.when(~gone, F.struct("line", "raw")))
    return rows.groupBy("doc_id").agg(
        F.count_if(~gone).alias("n_kept"), F.count_if(gone).alias("n_removed"), F.md5(F.array_join(F.transform(F.array_sort(parts), lambda x: x["raw"]), "\n")).alias("text_md5")
    )


def formula_coverage(docs: DataFrame, least_ratio: float = 0.002, least_characters: int = 200) -> DataFrame:
    """source, pages, pages that look like formulas, and their share."""
    ratio = F.length(F.regexp_replace("text", f"[^{MATH}]", "")) / F.greatest(F.length("text"), F.lit(1))
    suspect = (F.length("text") >= least_characters) & (ratio >= least_ratio)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(suspect).alias("n_suspect"), F.round(F.avg(suspect.cast("double")), 4).alias("share"), F.round(F.avg(ratio), 6).alias("mean_ratio"))
