"""Queries without SQL that pass through files and folds, against what they must equal."""

import zlib

import pytest

from sievelane.operators import joins, learn, sampling
from sievelane.plans import QUERIES, storing
from sievelane.plans.adapters import pairs


def test_loaded_model_scores_as_the_fitted_one(spark, data):
    p = pairs(spark, data)
    model = learn.pipeline(["s1", "s2", "s3"], learn.logistic()).fit(p.filter("term_id % 2 = 0"))
    expected = {r.id: r.score for r in learn.predict(model, p.filter("term_id % 2 = 1")).select("id", "score").collect()}
    got = {r.id: r.score for r in QUERIES["saved_model"](spark, data).collect()}
    assert got == pytest.approx(expected, abs=1e-9) and got


def test_fold_ensemble_scores_each_new_row_once(spark, data):
    rows = QUERIES["fold_ensemble"](spark, data).collect()
    expected = {r.id for r in pairs(spark, data).filter("term_id % 2 = 1").select("id").collect()}
    assert {r.id for r in rows} == expected and len(rows) == len(expected)
    assert all(0 <= r.score <= 1 for r in rows)


def test_importances_are_sorted_shares(spark, data):
    values = [r.importance for r in QUERIES["importances"](spark, data).collect()]
    assert len(values) == 3 and values == sorted(values, reverse=True) and sum(values) == pytest.approx(1.0)


def test_clean_set_folds_are_crc32(spark, data):
    rows = QUERIES["clean_set"](spark, data).collect()
    assert rows and all(r.fold == zlib.crc32(str(r.term_id).encode()) % 5 for r in rows)
    assert len({r.id for r in rows}) == len(rows)


def test_gzip_and_scratch_paths(spark, data):
    assert storing._fresh(spark) != storing._fresh(spark)


def test_strict_lookup_raises_on_a_missing_key(spark):
    left, known = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="."):
        joins.strict_lookup(left, known, "k").collect()


def test_shuffled_keeps_rows_and_depends_on_keys_only(spark):
    df = spark.range(100)
    first = [r.id for r in sampling.shuffled(df, "id").collect()]
    assert first == [r.id for r in sampling.shuffled(df.repartition(7), "id").collect()]
    assert sorted(first) == list(range(100)) and first != sorted(first)
