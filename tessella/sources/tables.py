"""Tables, and the views of them that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text blocks: block_id = doc_id * 10000 + line, and the place on the page from 0 to 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.lines(F.col("text")).alias("parts"))
    lines = docs.select("doc_id", "source", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("line", "raw"))
    return lines.select("doc_id", "source", (F.col("doc_id") * 10000 + F.col("line")).alias("block_id"), "line", (F.col("line") / F.col("n_lines")).alias("y_frac"), "raw").where(F.length(F.trim("raw")) > 0)


def deck_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in order of their ids as the pages of one deck: source, page_index, doc_id, heading, text."""
    docs = table(spark, sf_dir, "documents")
    page = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    first = T.collapse(F.element_at(T.lines(F.col("text")), 1))
    return docs.select("source", page.alias("page_index"), "doc_id", T.heading_form(F.substring(first, 1, 60)).alias("heading"), "text")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as target concepts: item_id, name (six words), text, parent (a fifth of the items each)."""
    items = table(spark, sf_dir, "benchmark")
    name = F.array_join(F.slice(F.split(T.collapse(F.col("text")), " "), 1, 6), " ")
    return items.select("item_id", name.alias("name"), "text", (F.col("item_id") % 5).alias("parent"))
