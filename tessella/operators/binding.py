"""How a sentence is bound to a target concept, what speaks against it, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T

#: Words between a subject and its definition.
LINKERS = r"(?: is an? | is the | are | denotes | refers to | means | is defined as )"


def target_binding(exact: Column, shared: Column, name_size: Column, heading_shared: Column) -> Column:
    """none, weak, usable or strong, from the name as a phrase, its tokens in the sentence and those in the heading."""
    share = shared / F.greatest(name_size, F.lit(1))
    return F.when(exact, "strong").when((share >= 0.6) & (shared >= 2), "usable").when((shared >= 1) & (heading_shared >= 1), "usable").when(shared >= 1, "weak").otherwise("none")


def subject_of(sentence: Column) -> Column:
    """What stands before the first linker, in lower case; empty without one."""
    return F.lower(F.regexp_extract(sentence, rf"^(.*?){LINKERS}", 1))


def contrasts(subject: Column) -> Column:
    return subject.rlike(r"^(unlike|in contrast|whereas|not )")


def definition_framing(has: Column, contrast: Column, shared: Column, name_size: Column) -> tuple[Column, Column]:
    """(label, score): what a subject has to do with a name of so many tokens that shares some with it."""
    share = shared / F.greatest(name_size, F.lit(1))
    label = F.when(~has, "missing").when(share >= 0.8, "aligned").when(share > 0, "compatible").when(contrast, "contrastive").otherwise("mismatch")
    score = F.when(label == "aligned", 2.5).when(label == "compatible", 1.7).when(label == "contrastive", -2.5).when(label == "mismatch", -1.75).otherwise(0.0)
    return label, score


def risk_flags(flags: Column | dict[str, Column], binding: Column, usage: Column, margin: Column) -> Column:
    """Names of all that speaks against a candidate, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(binding.isin("none", "weak"), "weak_binding"),
            F.when(flags["is_formula"], "formula"),
            F.when(flags["is_procedure"], "procedure"),
            F.when(flags["is_example"], "example"),
            F.when(flags["is_navigation"], "navigation"),
            F.when(flags["is_fragment"], "fragment"),
            F.when(usage >= 3, "shared_by_many"),
            F.when(margin < 0, "closer_to_other"),
        )
    )


def routing(score: Column, risks: Column, binding: Column) -> Column:
    """Where a candidate goes: one of five labels, by the first rule that holds."""
    hard = F.arrays_overlap(risks, F.array(F.lit("navigation"), F.lit("closer_to_other")))
    return (
        F.when(binding == "none", "reject")
        .when(hard, "contamination_review")
        .when((score >= 4) & (F.size(risks) == 0), "accept")
        .when((score >= 2.5) & (binding != "weak"), "accept_with_review")
        .when(score >= 1, "review")
        .otherwise("reject")
    )


def region_bonus(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """Adds bonus: 1.0, 0.6 or 0.3 if a strong row of the same concept is in the same sentence's document line, document or source."""
    strong = rows.where("binding = 'strong'")
    by_doc = strong.groupBy(key, "doc_id").agg(F.min("sent_idx").alias("low"), F.max("sent_idx").alias("high"))
    by_source = strong.select(key, "source").distinct().withColumn("in_source", F.lit(True))
    out = rows.join(by_doc, [key, "doc_id"], "left").join(by_source, [key, "source"], "left")
    near = F.col("sent_idx").between(F.col("low") - 2, F.col("high") + 2)
    return out.withColumn("bonus", F.when(near, 1.0).when(F.col("low").isNotNull(), 0.6).when(F.col("in_source"), 0.3).otherwise(0.0)).drop("low", "high", "in_source")


def phrases(concepts: DataFrame, most_share: float = 0.25) -> DataFrame:
    """item_id, phrase: name variants as token runs; a single token goes if too many concepts share it."""
    forms = concepts.select("item_id", F.explode(T.label_variants(F.col("name"))).alias("form")).select("item_id", T.index_tokens(F.col("form")).alias("tokens"))
    heads = concepts.select("item_id", T.content_tokens(F.col("name")).alias("all")).select("item_id", F.slice("all", 1, 2).alias("tokens"))
    singles = concepts.select("item_id", F.explode(T.content_tokens(F.col("name"))).alias("t")).select("item_id", F.array("t").alias("tokens"))
    rows = forms.unionAll(heads).unionAll(singles).where(F.size("tokens") > 0).select("item_id", F.array_join("tokens", " ").alias("phrase"), F.size("tokens").alias("n_tokens")).distinct()
    total = F.broadcast(concepts.agg(F.count(F.lit(1)).alias("total")))  # one row
    use = rows.groupBy("phrase").agg(F.countDistinct("item_id").alias("n_concepts"))
    kept = rows.join(use, "phrase").crossJoin(total).where((F.col("n_tokens") > 1) | (F.col("n_concepts") <= most_share * F.col("total")))
    return kept.select("item_id", "phrase", "n_tokens", "n_concepts")


def support_summary(rows: DataFrame, key: str) -> DataFrame:
    """Counts of each concept's routed candidates, whether they make a pack, and why not."""
    n = lambda c: F.count_if(c)
    good = n(F.col("route") == "accept")
    some = n(F.col("route") == "accept_with_review")
    docs = F.countDistinct(F.when(F.col("route").isin("accept", "accept_with_review"), F.col("doc_id")))
    out = rows.groupBy(key).agg(good.alias("n_accept"), some.alias("n_review"), docs.alias("n_docs"), F.count(F.lit(1)).alias("n"))
    why = F.array_compact(F.array(F.when(F.col("n_accept") == 0, "no_direct"), F.when(F.col("n_accept") + F.col("n_review") < 3, "few"), F.when(F.col("n_docs") < 2, "one_document")))
    lane = F.when(F.col("n_accept") >= 3, "ready").when(F.col("n_accept") + F.col("n_review") >= 3, "needs_review").when(F.col("n_accept") + F.col("n_review") > 0, "thin").otherwise("insufficient")
    return out.select(key, "n", "n_accept", "n_review", "n_docs", F.array_join(why, ",").alias("weak_reasons"), lane.alias("lane"))


def near_misses(rows: DataFrame, key: str, k: int = 6) -> DataFrame:
    """The best candidates that weren't accepted, and the first thing that stood in their way."""
    left = rows.where(~F.col("route").isin("accept", "accept_with_review"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "doc_id", "sent_idx"))
    return left.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "doc_id", "sent_idx", "score", F.coalesce(F.get("risks", F.lit(0)), F.lit("low_score")).alias("diagnosis"))
