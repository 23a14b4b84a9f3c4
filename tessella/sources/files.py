"""Rows in files: JSON lines, members of archives, and manifests of what is there."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line that isn't blank; what doesn't fit the schema is null."""
    return spark.read.schema(schema).json(path)


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order: files have none of their own once they are split."""
    return rows.orderBy(*order).limit(n)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, keys in alphabetical order."""
    rows.select(*sorted(rows.columns)).write.json(path)


def archive_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(archive, member, line_number, line) of the members of .tar and .tar.gz files.

    An archive is read by one task; many archives are read by many.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for member in archive:
                        if not member.isfile() or not member.name.endswith(suffix):
                            continue
                        lines = archive.extractfile(member).read().decode("utf-8", "replace").splitlines()
                        rows = [(name, member.name, i, x) for i, x in enumerate(lines) if x.strip()]
                        yield pd.DataFrame(rows, columns=["archive", "member", "line_number", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, line_number int, line string")


def archive_rows(spark: SparkSession, path: str, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """The JSON rows of the archives' members."""
    return archive_lines(spark, path, suffix).select("archive", "member", F.from_json("line", schema).alias("row")).select("archive", "member", "row.*")


def manifest(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified and sha256 of the files below a folder, which names their content whatever they are called."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``expected`` (a column path) that ``found`` lacks."""
    return expected.join(found.select("path"), "path", "left_anti")


def page_chunks(files: DataFrame, size: int) -> DataFrame:
    """Long files in chunks of pages: path, first_page, last_page.  files: path, n_pages."""
    start = F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(size)))
    chunks = files.where("n_pages > 0").select("path", "n_pages", start.alias("first_page"))
    return chunks.select("path", "first_page", (F.least(F.col("first_page") + size, F.col("n_pages")) - 1).alias("last_page"))
