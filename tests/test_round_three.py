"""Work that grew with copies, ranks or repeats, and what it gives now."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelane.functions import text as X
from sievelane.operators import learn, retrieval, sampling
from sievelane.plans import QUERIES, retrieving


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dense_lists_across_tasks_with_ties(spark, monkeypatch):
    for name, n in (("TASK_QUERIES", 9), ("TASK_ITEMS", 40), ("STEP", 7)):
        monkeypatch.setattr(retrieval, name, n)
    v = np.random.default_rng(3).integers(-2, 3, (130, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    got = {r.query_id: [(x.item_id, x.score) for x in r.near] for r in retrieval.dense_lists(df.filter("id < 30"), df, 11).collect()}
    s = v[:30] @ v.T
    assert got == {i: [(int(j), float(s[i, j])) for j in sorted(range(130), key=lambda j: (-s[i, j], j))[:11]] for i in range(30)}


@pytest.mark.parametrize("name", ["neg_ann", "neg_remined", "neg_remined_model"])
def test_mined_candidates_are_searched_once(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "MapInArrow" not in text and "CoGroups" not in text


def test_false_negatives_leave_by_a_join_on_the_query_alone(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.86), (1, 3, 0.85), (2, 1, 0.99)], "q long, d long, score double")
    kept = retrieval.drop_false_negatives(ranked, spark.createDataFrame([(1, 1)], "q long, d long"), "q", "d")
    assert sorted(map(tuple, kept.collect())) == [(1, 3, 0.85)] and plan(kept).count("Join") == 1


@pytest.mark.parametrize("ahead, more", [(4.0, 4.0), (0.0, -1.0)])
def test_lists_that_terms_share_are_sampled_as_rows_are(spark, monkeypatch, ahead, more):
    monkeypatch.setattr(sampling, "AHEAD", ahead)
    monkeypatch.setattr(sampling, "MORE", more)
    terms = spark.createDataFrame([(t, t % 3) for t in range(60)], "term_id long, rep long")
    lists = spark.createDataFrame([(0, list(range(150))), (1, list(range(100, 220))), (2, [7, 8])], "rep long, items array<long>")
    pos = spark.createDataFrame([(t, i) for t in range(50) for i in range(t % 4 + 1, 110, 50)], "term_id long, item_id long")
    rows = terms.join(lists, "rep").select("term_id", F.explode("items").alias("item_id"))
    want = sampling.hard_and_random(pos, rows, rows, 2, 0).filter("label = 0").select("term_id", "item_id")
    got = sorted(map(tuple, sampling.sample_lists(terms, lists, pos, 2).collect()))
    assert got == sorted(map(tuple, want.collect())) and got


def test_many_parts_in_a_small_file_are_not_broadcast(spark, tmp_path):
    name = F.concat(F.lit("red bolt"), (F.col("id") % 2).cast("string"))
    spark.range(250_000).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("Brand#1").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400_000).select(F.abs(F.xxhash64("id")).alias("o_orderkey"), F.lit("LOW").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    vocab = spark.createDataFrame([("red", 1.0), ("bolt0", 1.0)], "token string, idf double")
    weights, reps = retrieving._query_weights(spark, str(tmp_path), vocab)
    assert "Broadcast" not in weights._jdf.queryExecution().executedPlan().toString()
    assert reps.count() == 400_000 and sorted(r.token for r in weights.collect()) == ["bolt0", "red", "red"]


def test_weights_of_all_items_are_not_broadcast_whatever_their_file_says(spark):
    counts = spark.createDataFrame([(i, "red", 1) for i in range(20)] + [(0, "blue", 1)], "id long, token string, tf long")
    vocab = retrieval.vocabulary(counts, 20, 10)
    assert "strategy=broadcast" in vocab._jdf.queryExecution().analyzed().toString()
    near = spark.createDataFrame([(1, 0), (1, 4), (2, 5)], "q long, id long")
    new = retrieval.expansion(near, retrieval.tfidf(counts, vocab, "id"), spark.createDataFrame([(2, "red")], "q long, token string"), "q", "id")
    assert "strategy=merge" in plan(new) and sorted(map(tuple, new.collect())) == [(1, "blue", 2), (1, "red", 1)]


def test_held_out_terms_alone_get_candidates(spark, data):
    some = spark.createDataFrame([(4,), (9,)], "term_id long")
    assert {r.term_id for r in retrieving.lexical_candidates(spark, data, 2, some).select("term_id").collect()} == {4, 9}


def test_equal_rows_are_learned_from_as_one(spark):
    rows = spark.createDataFrame([(i, i % 5, float(i * i % 11 > 4), float(i % 7), float(i % 3)) for i in range(2100)], "id long, fold int, label double, a double, b double")
    weighted = learn.weighted_folds(rows, ["a", "b"])
    assert weighted.count() <= 42 and weighted.agg(F.sum("n"), F.sum(sum(F.col(f"n{f}") for f in range(5)))).first()[:] == (2100.0, 2100.0)
    model = learn.fit_folds(rows, ["a", "b"], lambda: [learn.logistic(maxIter=100)])[2][0].stages[-1]
    plain = learn.pipeline(["a", "b"], learn.logistic(maxIter=100)).fit(rows.filter("fold != 2")).stages[-1]
    assert np.allclose(model.coefficients.toArray(), plain.coefficients.toArray(), atol=1e-3)


def test_perturbing_names_its_words_once(spark):
    df = spark.createDataFrame([(1, "kırmızı spor ayakkabı")], "term_id long, query string")
    out = df.select(X.perturb_query(X.normalise_basic(F.col("query")), F.col("term_id")).alias("x"))
    assert plan(out).count("md5(") == 5
