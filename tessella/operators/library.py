"""Reviews, runs, sets and snapshots of a reviewed library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def priority(points: dict[str, tuple[Column, float]], required: Sequence[str], blockers: Column) -> tuple[Column, Column]:
    """(score, bucket) from additive points; a missing required feature caps the bucket, a blocker sets it."""
    score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in points.values()), F.lit(0.0))
    missing = F.lit(False)
    for name in required:
        missing = missing | points[name][0].isNull()
    bucket = F.when(blockers, "blocked").when((score >= 6) & ~missing, "high").when(score >= 4, "medium").when(score >= 1, "low").otherwise("none")
    return score, bucket


def tier(n_evidence: Column, n_roles: Column, complete: Column) -> tuple[Column, Column]:
    """(0, 1 or 2, reasons why it isn't better)."""
    reasons = F.array_compact(F.array(F.when(n_evidence < 3, "little_evidence"), F.when(n_roles < 2, "few_roles"), F.when(~complete, "incomplete")))
    return F.when(F.size(reasons) == 0, 2).when(n_evidence >= 1, 1).otherwise(0), F.array_join(reasons, ",")


def batches(rows: DataFrame, order: list[Column], size: int, group: str) -> DataFrame:
    """Consecutive batches of ``size`` rows within each group."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def transitions(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """How often each label of one run became each of the other; null where a run lacks the key."""
    old, new = before.select(key, F.col(label).alias("was")), after.select(key, F.col(label).alias("now"))
    return old.join(new, key, "full_outer").groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


def comparison(before: DataFrame, after: DataFrame, key: str, rank: str) -> DataFrame:
    """Each key's ranks in both runs, the change and what happened to it."""
    old, new = before.select(key, F.col(rank).alias("was")), after.select(key, F.col(rank).alias("now"))
    both = old.join(new, key, "full_outer")
    touch = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") < F.col("was"), "better").when(F.col("now") > F.col("was"), "worse").otherwise("same")
    return both.select(key, "was", "now", (F.col("was") - F.col("now")).alias("change"), touch.alias("touch"))


def merged(replacing: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``replacing`` from there, the others' from ``base``."""
    return base.join(replacing.select(key).distinct(), key, "left_anti").unionByName(replacing)


def last_filled(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row for each key: of each column the last source's value that isn't null or empty."""
    parts = [s.select(key, *columns, F.lit(i).alias("_order")) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    filled = [F.max_by(c, F.when(F.length(F.col(c).cast("string")) > 0, F.col("_order"))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*filled)


def both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right")))


def newest(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def first_status(*rules: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def assignment(top: Column, second: Column, third: Column, mentioned: Column, several: Column) -> Column:
    """What an exchange is about, from the three best scores and whether titles are mentioned."""
    close = (third.isNotNull()) & (top - third <= 1.5) & (top < 6.5)
    crowded = second.isNotNull() & (second >= F.greatest(0.82 * top, top - 3)) & ~mentioned
    return F.when(several, "multi").when(top.isNull() | ((top < 4.25) & ~mentioned), "no_match").when(close | crowded, "ambiguous").otherwise("single")
