"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again for the next stage, so a
lost executor costs no more than the stage at hand.  Labels are read from
``sf_dir``; a stage learns from those of the documents that it is given.

Edge cases: a null or empty text is no failure of a stage, but the quality
rules reject whatever has fewer than 50 words, so none reaches the others; a
document with a null doc_id is nobody's duplicate and is packed as it is; rows
that repeat a doc_id stay or go each by its own text; columns of other names,
those that operators use for their own included, are kept up to the last stage;
without labels the rules and weights let everything pass that the counts allow;
an empty table gives no sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import near, packing, quality, repeats, toxicity
from tessella.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that are predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near duplicates the smallest doc_id stays."""
    return near.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages that occur in a document with a smaller doc_id are taken out of text."""
    return repeats.drop_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what is left as pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", sequences),
]

#: Trees, weights and tokenizers can't be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        at = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
