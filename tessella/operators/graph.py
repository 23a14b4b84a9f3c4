"""Trees and small graphs given as parent-child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(nodes: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(ancestor, node, depth) of every node and all above it, itself included (depth 0).

    nodes: node, parent (null at the root).  Steps double: pairs that are 1, 2,
    4 ... levels apart, so a hierarchy of any depth takes a few joins.  A cycle
    is an error, unless a caller who wants no more than ``most_levels`` says so.
    """
    edges = nodes.select("node", "parent")
    out = edges.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    step = edges.where("parent is not null").select(F.col("parent").alias("ancestor"), "node")
    most = edges.count() if most_levels is None else most_levels
    span = 1
    while span <= most and not step.isEmpty():
        above = step.select(F.col("ancestor").alias("above"), F.col("node").alias("ancestor"))
        out = out.unionByName(out.join(above, "ancestor").select(F.col("above").alias("ancestor"), "node", (F.col("depth") + span).alias("depth")))
        step = step.join(above, "ancestor").select(F.col("above").alias("ancestor"), "node").persist()
        span *= 2
    if most_levels is None:
        if not step.isEmpty():  # further apart than there are nodes
            raise ValueError("the hierarchy has a cycle")
        return out
    return out.where(F.col("depth") <= most_levels)


def paths(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """node and its path of labels from the root down.  nodes: node, label."""
    named = closed.join(nodes.select(F.col("node").alias("ancestor"), "label"), "ancestor")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "label")))
    return named.groupBy("node").agg(F.array_join(F.transform(steps, lambda s: s["label"]), "/").alias("path"), F.max("depth").alias("depth"))


def rollup(closed: DataFrame, leaves: DataFrame) -> DataFrame:
    """node and how many leaves are below it.  leaves: node."""
    return closed.join(leaves, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_leaves"))


def neighbourhood(nodes: DataFrame) -> DataFrame:
    """node, parent, number of children and of siblings."""
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    family = children.select(F.col("node").alias("parent"), F.col("n_children").alias("family"))
    rows = nodes.select("node", "parent").join(children, "node", "left").join(family, "parent", "left")
    return rows.select("node", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce(F.col("family") - 1, F.lit(0)).alias("n_siblings"))


def issues(nodes: DataFrame) -> DataFrame:
    """code, record: ids that are missing or used twice, parents that don't exist, names used twice."""
    none = nodes.where("node is null").select(F.lit("MISSING_ID").alias("code"), F.col("label").alias("record"))
    twice = nodes.where("node is not null").groupBy("node").count().where("count > 1").select(F.lit("DUPLICATE_ID").alias("code"), F.col("node").alias("record"))
    lost = nodes.where("parent is not null").join(nodes.select(F.col("node").alias("parent")).distinct(), "parent", "left_anti").select(F.lit("DANGLING_PARENT").alias("code"), F.col("node").alias("record"))
    names = nodes.groupBy(F.lower("label").alias("l")).count().where("count > 1").select(F.lit("DUPLICATE_NAME").alias("code"), F.col("l").alias("record"))
    return none.unionAll(twice).unionAll(lost).unionAll(names)
