"""Files, snapshots, model adapters and streams."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import models
from tessella.sources import files, snapshots
from tessella.streaming import events


def test_json_lines_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"b": 1, "a": "x"}\n\n{"a": "y"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "a string, b int")
    assert sorted((r.a, r.b) for r in rows.collect()) == [("x", 1), ("y", None)]
    files.write_jsonl(rows.where("b = 1"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert list(json.loads(text)) == ["a", "b"]
    assert [r.a for r in files.head(rows, 1, "a").collect()] == ["x"]


def test_archive_members_and_manifest(spark, tmp_path):
    data = b'{"a": 1}\n\n{"a": 2}\n'
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as archive:
        for name in ("m.jsonl", "skip.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    rows = files.archive_rows(spark, str(tmp_path / "x.tar.gz"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2]
    found = files.manifest(spark, str(tmp_path), "*.gz")
    row = found.first()
    assert row.length == (tmp_path / "x.tar.gz").stat().st_size and len(row.sha256) == 64
    expected = spark.createDataFrame([(row.path,), ("file:/lost",)], "path string")
    assert [r.path for r in files.missing_files(expected, found).collect()] == ["file:/lost"]


def test_page_chunks_cover_every_page_once(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 4), ("c", 0)], "path string, n_pages int")
    got = sorted((r.path, r.first_page, r.last_page) for r in files.page_chunks(rows, 2).collect())
    assert got == [("a", 0, 1), ("a", 2, 3), ("a", 4, 4), ("b", 0, 1), ("b", 2, 3)]


def test_snapshots_are_written_once(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path))
    one, two = spark.range(3), spark.range(5)
    store.freeze("d", "v1", one)
    store.freeze("d", "v2", two)
    with pytest.raises(Exception):
        store.freeze("d", "v1", two)
    store.activate("d", "v1")
    assert store.active("d").count() == 3
    store.activate("d", "v2")
    assert store.active("d").count() == 5 and store.unchanged("d", "v1")
    two.write.mode("append").parquet(str(tmp_path / "d" / "v1"))
    assert not store.unchanged("d", "v1")
    with pytest.raises(Exception):
        store.activate("d", "v9")


def test_core_schema_is_locked():
    core = T.StructType([T.StructField("id", T.LongType(), False)])
    more = T.StructType([T.StructField("note", T.StringType(), True)])
    assert snapshots.extended(core, more).names == ["id", "note"]
    with pytest.raises(ValueError):
        snapshots.extended(core, core)


def test_forbidden_fields_go_at_any_depth(spark):
    rows = spark.sql("select 1 as seed, named_struct('a', 1, 'seed', 2) as s, array(named_struct('seed', 1, 'b', 2)) as l, map('seed', 1, 'c', 2) as m")
    got = snapshots.without_fields(rows, {"seed"})
    assert got.columns == ["s", "l", "m"]
    row = got.first()
    assert row.s.asDict() == {"a": 1} and row.l[0].asDict() == {"b": 2} and row.m == {"c": 2}


def test_models_retry_and_fall_back(spark):
    rows = spark.createDataFrame([("a b", "b c"), (None, "x")], "t string, u string")
    got = models.with_model(rows, models.shared_words("t", "u"), "score", "double").collect()
    assert sorted(r.score for r in got) == [0.0, 0.5] and {r.score_by for r in got} == {"model"}

    def broken():
        def model(batch):
            raise RuntimeError("down")

        return model

    got = models.with_model(rows, broken, "e", "array<double>", fallback=models.hashed_embedding("t", 4)()).collect()
    assert all(len(r.e) == 4 and r.e_by == "fallback" for r in got)


def test_streamed_totals_are_the_table_s(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").where("event_id is not null")
    table.union(table.limit(50)).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = events.deduplicated(stream, "400 days")
    query = events.write_batches(once, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    show = lambda df: sorted(map(tuple, events.totals(df).withColumn("total", F.round("total", 4)).collect()))
    assert out.count() == table.count() and show(out) == show(table)
    assert events.sessions(table).agg(F.sum("n")).first()[0] == table.where("user_id is not null").count()
