"""Versioned datasets: immutable Parquet folders, a manifest for each, and a pointer to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Snapshots:
    """Datasets below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, name: str, content: dict, replace: bool) -> None:
        """Written aside and renamed, so that a reader sees all of it or nothing."""
        target, draft = self._paths(f"{self.path}/{name}"), self._paths(f"{self.path}/.draft-{uuid.uuid4().hex}")
        if not replace and self._fs.exists(target):
            raise FileExistsError(f"{self.path}/{name}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if replace:
            self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise FileExistsError(f"{self.path}/{name}")

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def freeze(self, dataset: str, version: str, rows: DataFrame) -> dict:
        """Writes a version once; a version that exists is never changed.  The manifest holds its size and a hash of its rows."""
        folder = f"{self.path}/{dataset}/{version}"
        rows.write.mode("errorifexists").parquet(folder)
        stored = self.spark.read.parquet(folder)
        facts = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).alias("h")).first()
        manifest = {"dataset": dataset, "version": version, "path": folder, "rows": facts["n"], "content": str(facts["h"]), "schema": stored.schema.json()}
        self._write(f"{dataset}-{version}.json", manifest, replace=False)
        return manifest

    def activate(self, dataset: str, version: str) -> None:
        """Points to a version that has a manifest."""
        self._read(f"{dataset}-{version}.json")
        self._write(f"ACTIVE-{dataset}.json", {"version": version}, replace=True)

    def active(self, dataset: str) -> DataFrame:
        version = self._read(f"ACTIVE-{dataset}.json")["version"]
        return self.spark.read.parquet(self._read(f"{dataset}-{version}.json")["path"])

    def unchanged(self, dataset: str, version: str) -> bool:
        """Whether the rows are those that the manifest was written for."""
        manifest = self._read(f"{dataset}-{version}.json")
        stored = self.spark.read.parquet(manifest["path"])
        facts = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).alias("h")).first()
        return (facts["n"], str(facts["h"])) == (manifest["rows"], manifest["content"])


def extended(core: T.StructType, extension: T.StructType) -> T.StructType:
    """A locked core with optional fields added; fields of the core can't be replaced."""
    taken = {f.name for f in core.fields}
    for field in extension.fields:
        if field.name in taken:
            raise ValueError(f"{field.name} belongs to the core")
        if not field.nullable:
            raise ValueError(f"{field.name} must be optional")
    return T.StructType([*core.fields, *extension.fields])


def without_fields(rows: DataFrame, forbidden: set[str]) -> DataFrame:
    """Drops fields by name at any depth of structs and arrays of structs, and keys of maps."""

    def clean(value, kind: T.DataType):
        if isinstance(kind, T.StructType):
            return F.struct(*(clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in forbidden))
        if isinstance(kind, T.ArrayType) and holds(kind.elementType):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            return F.map_filter(value, lambda k, _: ~k.isin(*forbidden))
        return value

    def holds(kind: T.DataType) -> bool:
        return isinstance(kind, (T.StructType, T.MapType)) or (isinstance(kind, T.ArrayType) and holds(kind.elementType))

    return rows.select(*(clean(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in forbidden))
