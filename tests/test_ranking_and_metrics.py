import random

import pytest
from pyspark.sql import functions as F

from sievelane.operators import gates, labels, learn, metrics, windows


def test_percent_rank_and_zscore(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0), (2, 5.0)], "t int, x double")
    got = df.select("t", "x", windows.percent_rank_averaged("x", "t").alias("p"), windows.zscore("x", "t").alias("z")).orderBy("t", "x").collect()
    assert [r.p for r in got] == [0.25, 0.625, 0.625, 1.0, 1.0]
    assert got[-1].z is None
    assert got[0].z == pytest.approx(-1.0 / (0.81649658 + 1e-6))


@pytest.mark.parametrize("parts", [1, 5])
def test_global_rank_is_a_row_number(spark, parts):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 0.5, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(parts)
    got = {r.id: r.rank for r in windows.global_rank(df, "x", "id", buckets=7).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((x, i) for i, x in rows))}


def test_tails_and_positions(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    got = {r.id: r.label for r in windows.tails(df, "x", "id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 18: 1, 19: 1}


def test_rate_threshold_interpolates(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 9.0)], "s double")
    assert metrics.rate_threshold(df, "s", [0.33]).first().threshold == pytest.approx(4.05)


def brute_sweep(rows, low, high, scale):
    out = {}
    for g in range(low, high + 1):
        t = g / scale
        tp = sum(y == 1 and s >= t for s, y in rows)
        fp = sum(y == 0 and s >= t for s, y in rows)
        fn, tn = sum(y == 1 for _, y in rows) - tp, sum(y == 0 for _, y in rows) - fp
        f = lambda a, b, c: 2 * a / (2 * a + b + c) if 2 * a + b + c else 0.0
        out[t] = (f(tp, fp, fn) + f(tn, fn, fp)) / 2
    return out


def test_sweep_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([g / 100 for g in range(101)]), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = {r.t: r.macro_f1 for r in metrics.sweep(df, F.col("s"), F.col("y"), 10, 90, 100).collect()}
    expected = brute_sweep(rows, 10, 90, 100)
    assert got.keys() == expected.keys()
    assert all(got[t] == pytest.approx(expected[t]) for t in got)
    best = metrics.best(metrics.sweep(df, F.col("s"), F.col("y"), 10, 90, 100)).first()
    assert best.t == min(t for t in expected if round(expected[t], 12) == round(max(expected.values()), 12))


def test_no_positive_predictions_and_empty(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "s double, y int")
    assert metrics.class_report(df, F.col("y"), (F.col("s") > 0.9).cast("int")).first().f1_1 == 0.0
    empty = df.filter("s > 5")
    assert metrics.best(metrics.sweep(empty, F.col("s"), F.col("y"), 1, 3, 10)).first().t == 0.5


def test_weight_grid_has_66_triples(spark):
    got = spark.range(1).select(F.explode(metrics.weight_grid()).alias("w")).select("w.*").collect()
    assert len(got) == len(set(got)) == 66 and all(a + b + c == pytest.approx(1) for a, b, c in got)


def test_precedence(spark):
    mini = spark.createDataFrame([("a", 0), ("b", 1)], "id string, label int")
    four = spark.createDataFrame([("a", 1)], "id string, label int")
    both = labels.union_sources([("mini", mini), ("4o", four)])
    assert {r.id: (r.label, r.source) for r in labels.by_precedence(both, ["id"]).collect()} == {"a": (1, "4o"), "b": (1, "mini")}
    assert {r.id: r.label for r in labels.by_precedence(both, ["id"], first_wins=True).collect()} == {"a": 0, "b": 1}


def test_decisions(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 1), (0.5, 0), (0.5, None)], "s double, y int")
    assert [r[0] for r in df.select(labels.hybrid_decision(F.col("s"), F.col("y"), 0.45, 0.2, 0.7)).collect()] == [1, 0, 0, 1]
    assert [r[0] for r in df.select(labels.label_or_threshold(F.col("s"), F.col("y"), 0.45)).collect()] == [0, 1, 0, 1]
    assert df.select(F.round(labels.conflict(F.lit(0.05), F.lit(1)), 6)).first()[0] == 0.95


def test_override_base(spark):
    base = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 0, 0)], "term_id int, item_id int, label int, fold int")
    new = spark.createDataFrame([(1, 1, 0), (9, 9, 1)], "term_id int, item_id int, label int")
    assert sorted(map(tuple, labels.override_base(base, new).collect())) == [(1, 1, 0, 0), (1, 2, 0, 0)]


def test_gates(spark):
    good = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "term_id int, item_id int, label int")
    gates.require(gates.train_gate(good, rows=2, positives=1))
    with pytest.raises(gates.GateError):
        gates.require(gates.train_gate(good.union(good)))
    sub = spark.createDataFrame([(1, 0), (2, None)], "id int, prediction int")
    assert {r.check_name for r in gates.submission_gate(sub, 2).collect() if not r.passed} == {"no_nulls", "two_classes"}


def test_rank_average(spark):
    rows = [(i, "a", float(i)) for i in range(3)] + [(i, "b", float(-i)) for i in range(3)] + [(0, "c", 1.0)]
    df = spark.createDataFrame(rows, "id int, model string, score double")
    assert {r.id: r.score for r in learn.rank_average(df, ["a", "b"]).collect()} == {0: 0.5, 1: 0.5, 2: 0.5}
    with pytest.raises(ValueError):
        learn.rank_average(df, ["a"])


def test_failing_scorer_leaves_nulls(spark):
    def scorer(texts):
        if any("bad" in t for t in texts):
            raise OSError
        return [1.0] * len(texts)

    df = spark.createDataFrame([("ok",), ("bad",)], "t string").repartition(1)
    got = {r.t: r.score for r in learn.score_external(df, scorer, "t", batch=1).collect()}
    assert got["ok"] == 1.0 and (got["bad"] is None or got["bad"] != got["bad"])
