"""Sharding: failed and repeated appends, two writers, tables without rows, clashing names, large arrivals."""

import pytest
from pyspark.sql import functions as F

from sievelane.llm import sharding


def key(df):
    return sorted(map(tuple, df.collect()), key=repr)


def store(spark, tmp_path, **more):
    return sharding.ShardStore(spark, str(tmp_path / "a b"), **more)


def test_a_failed_append_adds_nothing(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    rows = [(i, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(s, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.append(df, F.floor(F.col("doc_id") / 20))
    assert s.version() == 0
    assert s.append(df, F.floor(F.col("doc_id") / 20)) == 1
    assert key(s.read().select("doc_id", "text")) == sorted(rows, key=repr)
    s.compact()
    assert key(s.read().select("doc_id", "text")) == sorted(rows, key=repr)
    assert s.vacuum(older_than_s=0) == 1 + (s.manifest().select("attempt").distinct().count() == 1)
    assert key(s.read().select("doc_id", "text")) == sorted(rows, key=repr)


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    two = spark.createDataFrame([(2, "b")], "doc_id long, text string")
    commit, lost = a.commit, []

    def late(*args):
        if not lost:
            lost.append(b.append(two, F.lit(0)))
        commit(*args)

    monkeypatch.setattr(a, "commit", late)
    assert a.append(one, F.lit(0)) == 2 and lost == [1]
    assert key(a.read().select("doc_id", "text")) == [(1, "a"), (2, "b")]
    assert key(a.read(1).select("doc_id", "text")) == [(2, "b")]
    # a compaction that another writer overtakes is given up
    lost.clear()
    with pytest.raises(sharding.Conflict):
        a.compact()
    monkeypatch.undo()
    assert key(a.read().select("doc_id")) == [(1,), (2,), (2,)]


def test_tables_without_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert s.append(df.limit(0), F.col("doc_id")) == 1
    assert s.read().columns == ["doc_id", "text", "gen", "shard", "shard_rows", "shard_bytes"] and s.read().count() == 0
    assert s.compact() == 2 and s.read().count() == 0
    s.append(df, F.col("doc_id"))
    assert key(s.read()) == [(1, "a", 3, "1-0", 1, 1)]


def test_columns_with_the_stores_names(spark, tmp_path):
    s = store(spark, tmp_path)
    df = spark.createDataFrame([(i, "x" * i, 7, "mine", 5, "p", 9, "d") for i in range(40)], "doc_id long, text string, gen int, Shard string, _size int, __part string, _share int, `a.b` string")
    s.append(df, F.floor(F.col("doc_id") / 10))
    s.compact()
    got = s.read()
    assert got.columns[:8] == ["doc_id", "text", "gen_in", "Shard_in", "_size", "__part", "_share", "a.b"]
    assert {tuple(r)[2:8] for r in got.collect()} == {(7, "mine", 5, "p", 9, "d")} and got.count() == 40
    assert {r.gen for r in got.collect()} == {2}


def test_later_columns_and_a_large_arrival(spark, tmp_path):
    s = store(spark, tmp_path, small_bytes=100, target_bytes=800)
    many = [(i if i % 3 else None, "y" * 50) for i in range(300)]
    s.append(spark.createDataFrame(many, "doc_id long, text string").repartition(4), F.lit(None))
    s.append(spark.createDataFrame([(900, None, 1.5)], "doc_id long, text string, quality double"), F.lit(4))
    s.compact()
    got = key(s.read().select("doc_id", "text", "quality"))
    assert got == sorted([(*r, None) for r in many] + [(900, None, 1.5)], key=repr)
    with pytest.raises(ValueError, match="another type"):
        s.append(spark.createDataFrame([("x", "y")], "doc_id string, text string"), F.lit(1))
