"""Typed blocks of HTML pages by plain patterns: a cheap layer beside the learnt extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"title": "title", "heading": "h1", "list_item": "li", "footer": "footer"}


def typed_blocks(pages: DataFrame) -> DataFrame:
    """page_id, kind, text of the blocks of each kind; kinds are layers that are put together."""
    layers = [
        pages.select("page_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)).alias("raw"))
        for kind, tag in KINDS.items()
    ]
    rows = reduce(DataFrame.unionByName, layers)
    return rows.select("page_id", "kind", F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"))
