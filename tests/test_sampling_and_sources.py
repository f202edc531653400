import gzip
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelane import schemas
from sievelane.operators import joins, retrieval, sampling
from sievelane.sources import readers, writers
from sievelane.streaming.incremental import label_stream


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, f"r{i % 3}", f"r{i % 3}/c{i % 12}") for i in range(200)], "item_id long, root string, category string")
    pos = sorted({(t, rng.randrange(200)) for t in range(20) for _ in range(rng.randint(1, 6))})
    return items, spark.createDataFrame(pos, "term_id long, item_id long"), pos


def test_random_negatives(spark, world):
    items, pos, rows = world
    a = sorted(map(tuple, sampling.random_negatives(pos, items, 2).collect()))
    b = sorted(map(tuple, sampling.random_negatives(pos.repartition(5), items.repartition(3), 2).collect()))
    assert a == b and len(a) == len(set(a)) and not set(a) & set(rows)
    need = Counter(t for t, _ in rows)
    assert Counter(t for t, _ in a) == {t: 2 * n for t, n in need.items()}


def test_category_negatives(spark, world):
    items, pos, rows = world
    got = [tuple(r) for r in sampling.category_negatives(pos, items).collect()]
    assert got and not set(got) & set(rows)
    roots = {(t, i % 3) for t, i in rows}
    taken = {(t, i % 12) for t, i in rows}
    assert all((t, i % 3) in roots and (t, i % 12) not in taken for t, i in got)


def test_tiers(spark, world):
    items, pos, rows = world
    lexical = spark.createDataFrame([(t, (t * 7 + k) % 200, k) for t in range(20) for k in range(1, 10)], "term_id long, item_id long, rank int")
    got = sampling.tiered_negatives(pos, items, lexical).collect()
    pairs = [(r.term_id, r.item_id) for r in got]
    assert len(pairs) == len(set(pairs))
    need = Counter(t for t, _ in rows)
    each = Counter((r.term_id, r.sample_type) for r in got)
    assert all(each[t, s] == n for t, n in need.items() for s in ("positive", "random", "category_aware", "lexical_hard"))


def test_folds(spark):
    df = spark.createDataFrame([(t,) for t in range(50) for _ in range(t % 7 + 1)], "term_id long")
    crc = df.select("term_id", sampling.crc32_fold(F.col("term_id")).alias("f")).distinct().collect()
    assert all(r.f == zlib.crc32(str(r.term_id).encode()) % 5 for r in crc)
    load = Counter()
    fold = {r.term_id: r.fold for r in sampling.balanced_folds(df, "term_id").collect()}
    for t in range(50):
        load[fold[t]] += t % 7 + 1
    assert max(load.values()) - min(load.values()) <= 2
    turns = Counter(r.fold for r in sampling.round_robin_folds(df, "term_id").collect())
    assert set(turns.values()) == {10}


def test_exam_ids_tell_nothing(spark, world):
    items, pos, _ = world
    rows = sampling.exam_set(pos, pos, items, 15).collect()
    assert len({r.id for r in rows}) == len(rows) and sum(r.truth for r in rows) == 15


def test_fuzzy_brands_against_brute_force(spark):
    brands, tokens = ["nike", "puma", "polo", "kiğılı", "abc"], ["nikee", "nke", "pumo", "kiğıl", "abd", "solo", "nike", ""]
    got = {r.token: r.brand for r in joins.fuzzy_brands(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(b,) for b in brands], "brand string")).collect()}
    assert got == {"nikee": "nike", "nke": "nike", "pumo": "puma", "kiğıl": "kiğılı", "solo": "polo"}


def test_sparse_top_k_across_blocks(spark, monkeypatch):
    draw = random.Random(5)
    texts = {i: {f"w{draw.randrange(12)}": 1.0 + draw.randrange(3) for _ in range(draw.randrange(1, 6))} | ({"hot": 1.0} if i % 3 else {}) for i in range(90)}
    texts[7] = {"alone": 1.0}
    rows = spark.createDataFrame([(i, t, w) for i, ws in texts.items() for t, w in ws.items()], "id long, token string, w double")
    queries, docs = rows.filter("id < 30").withColumnRenamed("id", "q"), rows.filter("id >= 20").withColumnRenamed("id", "d")
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "TILE_NUMBERS", 100)
    got = sorted((r.q, r["rank"], r.d, r.score) for r in retrieval.sparse_top_k(queries, docs, "q", "d", 4, skip=2).collect())
    want = []
    for q in range(30):
        scores = [(-sum(w * texts[d].get(t, 0.0) for t, w in texts[q].items()), d) for d in range(20, 90)]
        want += [(q, n, d, -s) for n, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0), 1) if 2 < n <= 6]
    assert got == want


def test_sparse_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "q long, token string, w double")
    some = spark.createDataFrame([(1, "a", 1.0)], "d long, token string, w double")
    assert retrieval.sparse_top_k(empty, some, "q", "d", 3).collect() == []
    assert retrieval.sparse_top_k(some.withColumnRenamed("d", "q"), empty.withColumnRenamed("q", "d"), "q", "d", 3).collect() == []


def test_dense_top_k_across_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.item_id) for r in retrieval.dense_top_k(df.filter("id < 5"), df, 7, block=16).collect())
    v = dict(rows)
    expected = []
    for q in range(5):
        best = sorted(v, key=lambda i: (-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i))[:7]
        expected += [(q, k + 1, i) for k, i in enumerate(best)]
    assert got == sorted(expected)


def test_label_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,label\r\nTST_x,1\r\nbroken\r\nTST_y,7\r\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id,label\nTST_z,0\n")
    got = {r.id: r.label for r in readers.read_labels(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")]).collect()}
    assert got == {"TST_x": 1, "TST_z": 0}
    parts = readers.read_parts(spark, str(tmp_path / "*.csv"), schemas.LABEL_FILE)
    assert {r.part for r in parts.select("part").distinct().collect()} == {"a.csv"}


def test_lines_and_scalar(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1 | q | a | b\nbad line\n2 | q2 | p\n")
    got = {r.id: r.product for r in readers.read_judge_lines(spark, str(tmp_path / "in.txt")).collect()}
    assert got == {"1": "a | b", "2": "p"}
    (tmp_path / "t.txt").write_text("0.42\n")
    assert readers.read_scalar(spark, str(tmp_path / "t.txt")) == 0.42


def test_append_resumes(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "id")
    path = str(tmp_path / "out")
    assert writers.append_new(df.filter("id < 6"), path) == 6
    assert writers.append_new(df, path) == 4
    assert writers.append_new(df, path) == 0
    assert writers.Versions(spark, path).read().count() == 10


def test_submission_and_shards(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("prediction"), F.col("id").cast("double").alias("s"))
    writers.write_submission(df, str(tmp_path / "sub"))
    assert readers.read_csv(spark, str(tmp_path / "sub"), schemas.SUBMISSION).count() == 1000
    writers.write_lines(df, F.concat_ws(" | ", "id", "s"), str(tmp_path / "lines"), "s", "id")
    sizes = {r["shard"]: r["count"] for r in spark.read.text(str(tmp_path / "lines")).groupBy("shard").count().collect()}
    assert sizes == {1: 400, 2: 400, 3: 200}


def test_stream_labels_every_file_once(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))
    schema = spark.range(1).schema
    for lo in (0, 5):
        spark.range(lo, lo + 10).coalesce(1).write.mode("append").parquet(landing)
    label = lambda df: df.withColumn("label", (F.col("id") % 2).cast("int"))
    for _ in range(2):
        label_stream(spark, landing, schema, out, checkpoint, label, files_per_trigger=1).awaitTermination(120)
    assert sorted(r.id for r in writers.Versions(spark, out).read().collect()) == list(range(15))
