"""Ranks and quantiles with many ties, negatives against their definition, sinks, models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelane.operators import learn, metrics, sampling, windows
from sievelane.sources import writers


def test_ranks_and_buckets_of_tied_values(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0.0, 0.0, 0.0, 1.0, rng.random()]), f"k{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, name string").repartition(3)
    for key, at in (("id", 0), ("name", 2)):
        got = {r.id: r.rank for r in windows.global_rank(df, "x", key, buckets=16).collect()}
        want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[at])))}
        assert got == want


@pytest.mark.parametrize("values", [[0.5] * 40, [0.0] * 30 + [1.0] * 11, None])
def test_quantiles_are_exact(spark, values):
    values = values or [random.Random(1).random() for _ in range(501)]
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)] + [(None, "a")], "s double, g string").repartition(4)
    got = {r.rate: r.threshold for r in metrics.rate_threshold(df, "s", [0.0, 0.25, 0.33, 1.0]).collect()}
    assert got == {r: pytest.approx(np.quantile(values, 1.0 - r)) for r in (0.0, 0.25, 0.33, 1.0)}
    by = {(r.g, r.rate): r.threshold for r in metrics.rate_threshold(df, "s", [0.4], ["g"]).collect()}
    assert by == {(g, 0.4): pytest.approx(np.quantile([v for i, v in enumerate(values) if ("a" if i % 3 else "b") == g], 0.6)) for g in "ab"}
    assert metrics.rate_threshold(df.limit(0), "s", [0.4]).count() == 0


def test_negatives_fill_every_quota_they_can(spark):
    rng = random.Random(2)
    items = [(i, f"r{i % 3}", f"r{i % 3}/c{i % 12}") for i in range(60)]
    pos = {(t, i) for t in range(8) for i in rng.sample(range(60), [1, 2, 5, 20, 29, 30, 59, 60][t])}
    p = spark.createDataFrame(sorted(pos), "term_id long, item_id long").repartition(3)
    d = spark.createDataFrame(items, "item_id long, root string, category string").repartition(2)
    got = [tuple(r) for r in sampling.random_negatives(p, d, 2).collect()]
    assert len(set(got)) == len(got) and not set(got) & pos
    for t in range(8):
        own = sum(x == t for x, _ in pos)
        assert sum(x == t for x, _ in got) == min(2 * own, 60 - own)
    got = [tuple(r) for r in sampling.category_negatives(p, d).collect()]
    cat = {i: (r, c) for i, r, c in items}
    assert len(set(got)) == len(got)
    for t in range(8):
        closed = {cat[i][1] for x, i in pos if x == t}
        for root in ("r0", "r1", "r2"):
            need = sum(x == t and cat[i][0] == root for x, i in pos)
            free = sum(r == root and c not in closed for r, c in cat.values())
            mine = [i for x, i in got if x == t and cat[i][0] == root]
            assert len(mine) == min(need, free) and all(cat[i][1] not in closed for i in mine)


def test_tables_are_rebuilt_and_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    table = writers.Versions(spark, path)
    writers.replace_table(spark.range(5), path)
    writers.replace_table(table.read().filter("id > 1"), path)  # reads what it replaces
    assert sorted(r.id for r in table.read().collect()) == [2, 3, 4] and table.read(1).count() == 5
    double = lambda df: df.select((F.col("id") * 2 + 1).alias("id"))
    for _ in range(2):
        assert sorted(r.id for r in writers.rebuild(spark, path, double).collect()) == [1, 3, 5, 7, 9]
    calls = []
    build = lambda: calls.append(1) or spark.range(4)
    for reuse in (True, True, False):
        assert writers.cached(spark, str(tmp_path / "c"), build, reuse).count() == 4
    assert len(calls) == 2
    small = writers.narrowed(spark.createDataFrame([(1, 0.5), (None, 2.0)], "a long, b double"), ["a"], ["b"])
    assert dict(small.dtypes) == {"a": "tinyint", "b": "float"} and small.count() == 2
    with pytest.raises(Exception, match="doesn't fit"):
        writers.narrowed(spark.createDataFrame([(300,)], "a long"), ["a"]).collect()


def test_models_are_saved_and_loaded(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i // 10, rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame([(*r, float(r[2] > 0.5), r[1] % 5) for r in rows], "id long, term_id long, s1 double, s2 double, label double, fold int")
    full, features = learn.stacker_features(df, ["s1", "s2"])
    model = learn.pipeline(features, learn.trees(maxIter=2)).fit(full)
    learn.save_model(model, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, learn.predict(m, full).select("id", "score").collect())) for m in (model, learn.load_model(str(tmp_path / "m"))))
    assert a == b
    assert learn.importances(model, features)[0][0] in features
    models = learn.fit_folds(full, features, lambda: [learn.logistic(maxIter=5)])
    new = learn.fold_ensemble(full, models).select("id", "score").collect()
    one = learn.out_of_fold(full, models)
    assert len(new) == 200 and one.count() == 200 and all(0 <= r.score <= 1 for r in new)
