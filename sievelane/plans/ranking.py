"""Queries: windows within terms, global ranks, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, metrics, windows, learn
from ..sources.writers import fan_out, shard_of
from .adapters import PAIRS_SQL, pairs, query, table, with_


@query("scan_prune", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def scan_prune(spark, sf):
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select("l_orderkey", "l_partkey", "l_quantity")


_RANK = "(rank() OVER (PARTITION BY term_id ORDER BY {0} {1}) + (count(*) OVER (PARTITION BY term_id, {0}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY term_id)::DOUBLE"


@query("per_term_top_fraction", with_(PAIRS_SQL) + f"SELECT id, CAST({_RANK.format('price', 'DESC')} <= 0.33 AS INTEGER) AS prediction FROM pairs")
def per_term_top_fraction(spark, sf):
    return pairs(spark, sf).select("id", windows.top_fraction("price", "term_id", 0.33).alias("prediction"))


@query("term_pct_rank", with_(PAIRS_SQL) + f"SELECT id, round({_RANK.format('s1', 'ASC')}, 6) AS pct FROM pairs")
def term_pct_rank(spark, sf):
    return pairs(spark, sf).select("id", F.round(windows.percent_rank_averaged("s1", "term_id"), 6).alias("pct"))


@query(
    "term_zscore",
    with_(PAIRS_SQL)
    + """SELECT id, round((price - avg(price) OVER w) / (stddev_samp(price) OVER w + 1e-6), 5) AS z, count(*) OVER w AS n_cand
FROM pairs WINDOW w AS (PARTITION BY term_id)""",
)
def term_zscore(spark, sf):
    return pairs(spark, sf).select("id", F.round(windows.zscore("price", "term_id"), 5).alias("z"), windows.group_size("term_id").alias("n_cand"))


@query("rank_norm", with_(PAIRS_SQL) + "SELECT id, round((row_number() OVER (ORDER BY price, id) - 1)::DOUBLE / (count(*) OVER () - 1), 9) AS rank_norm FROM pairs")
def rank_norm(spark, sf):
    return windows.rank_normalised(pairs(spark, sf).select("id", "price"), "price", "id").select("id", F.round("rank_norm", 9).alias("rank_norm"))


@query(
    "pseudo_label_tails",
    with_(PAIRS_SQL, "r AS (SELECT id, row_number() OVER (ORDER BY price, id) - 1 AS k, count(*) OVER () AS n FROM pairs)")
    + "SELECT id, CASE WHEN k >= n - floor(0.12::DOUBLE * n) THEN 1 ELSE 0 END AS label FROM r WHERE k >= n - floor(0.12::DOUBLE * n) OR k < floor(0.25::DOUBLE * n)",
)
def pseudo_label_tails(spark, sf):
    return windows.tails(pairs(spark, sf).select("id", "price"), "price", "id").select("id", "label")


@query("ppr_threshold", with_(PAIRS_SQL) + "SELECT r AS rate, round(quantile_cont(s3, 1.0::DOUBLE - r), 9) AS threshold FROM pairs, (SELECT unnest([0.30::DOUBLE, 0.33, 0.36]) AS r) GROUP BY r".replace("quantile_cont(s3, 1.0::DOUBLE - r)", "CASE r WHEN 0.30 THEN quantile_cont(s3, 0.70) WHEN 0.33 THEN quantile_cont(s3, 0.67) ELSE quantile_cont(s3, 0.64) END"))
def ppr_threshold(spark, sf):
    return metrics.rate_threshold(pairs(spark, sf), "s3", [0.30, 0.33, 0.36]).select("rate", F.round("threshold", 9).alias("threshold"))


@query(
    "fan_out_rates",
    with_(PAIRS_SQL, "t AS (SELECT quantile_cont(s3, 0.70) AS a, quantile_cont(s3, 0.67) AS b, quantile_cont(s3, 0.64) AS c FROM pairs)")
    + """SELECT id, unnest([0.30::DOUBLE, 0.33, 0.36]) AS rate, unnest([CAST(s3 >= a AS INTEGER), CAST(s3 >= b AS INTEGER), CAST(s3 >= c AS INTEGER)]) AS prediction FROM pairs, t""",
)
def fan_out_rates(spark, sf):
    p = pairs(spark, sf).select("id", "s3")
    return fan_out(p, metrics.rate_threshold(p, "s3", [0.30, 0.33, 0.36]), "s3")


@query(
    "hybrid_decision",
    with_(PAIRS_SQL)
    + """SELECT id, CASE WHEN s3 > 0.7 THEN 1 WHEN s3 < 0.2 THEN 0 ELSE coalesce(CASE WHEN item_id % 3 = 0 THEN label END, CAST(s3 >= 0.45 AS INTEGER)) END AS prediction,
  coalesce(CASE WHEN item_id % 3 = 0 THEN label END, CAST(s3 >= 0.45 AS INTEGER)) AS final FROM pairs""",
)
def hybrid_decision(spark, sf):
    label = F.when(F.col("item_id") % 3 == 0, F.col("label"))
    return pairs(spark, sf).select("id", labels.hybrid_decision(F.col("s3"), label, 0.45, 0.2, 0.7).alias("prediction"), labels.label_or_threshold(F.col("s3"), label, 0.45).alias("final"))


_MODELS = "scores AS (SELECT id, 'a' AS model, s1 AS score FROM pairs UNION ALL SELECT id, 'b', s2 FROM pairs UNION ALL SELECT id, 'c', s3 FROM pairs WHERE item_id % 2 = 0)"


def model_scores(spark, sf):
    p = pairs(spark, sf)
    one = lambda m, s, d=p: d.select("id", F.lit(m).alias("model"), F.col(s).alias("score"))
    return one("a", "s1").unionByName(one("b", "s2")).unionByName(one("c", "s3", p.filter("item_id % 2 = 0")))


@query(
    "rank_average",
    with_(PAIRS_SQL, _MODELS, "r AS (SELECT id, (row_number() OVER (PARTITION BY model ORDER BY score, id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY model) - 1) AS v FROM scores)")
    + "SELECT id, round(avg(v), 6) AS score FROM r GROUP BY id HAVING count(*) = 3",
)
def rank_average(spark, sf):
    return learn.rank_average(model_scores(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(
    "rank_average_subset",
    with_(PAIRS_SQL, _MODELS, "r AS (SELECT id, (row_number() OVER (PARTITION BY model ORDER BY score, id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY model) - 1) AS v FROM scores WHERE model IN ('a', 'b'))")
    + "SELECT id, round(avg(v), 6) AS score FROM r GROUP BY id HAVING count(*) = 2",
)
def rank_average_subset(spark, sf):
    return learn.rank_average(model_scores(spark, sf), ["a", "b"]).select("id", F.round("score", 6).alias("score"))


@query("wide_scores", with_(PAIRS_SQL, _MODELS) + "SELECT id, max(score) FILTER (model = 'a') AS a, max(score) FILTER (model = 'b') AS b, max(score) FILTER (model = 'c') AS c FROM scores GROUP BY id")
def wide_scores(spark, sf):
    return learn.wide_scores(model_scores(spark, sf), ["a", "b", "c"])


@query(
    "both_splits",
    with_(PAIRS_SQL, _MODELS) + "SELECT model FROM (SELECT DISTINCT model, CASE WHEN id % 2 = 0 OR model = 'b' THEN 'holdout' ELSE 'test' END AS split FROM scores) GROUP BY model HAVING count(*) = 2",
)
def both_splits(spark, sf):
    return learn.both_splits(model_scores(spark, sf).select("model", F.when((F.col("id") % 2 == 0) | (F.col("model") == "b"), "holdout").otherwise("test").alias("split")))


@query("blend_fixed", with_(PAIRS_SQL) + "SELECT id, round(0.65::DOUBLE * s1 + 0.35::DOUBLE * s3, 10) AS score FROM pairs")
def blend_fixed(spark, sf):
    return pairs(spark, sf).select("id", F.round(0.65 * F.col("s1") + 0.35 * F.col("s3"), 10).alias("score"))


@query("judge_shards", with_(PAIRS_SQL) + "SELECT id, CAST(floor((row_number() OVER (ORDER BY price, id) - 1) / 400) + 1 AS INTEGER) AS shard FROM pairs")
def judge_shards(spark, sf):
    return shard_of(pairs(spark, sf).select("id", "price"), "price", "id").select("id", "shard")


@query("rank_positions", with_(PAIRS_SQL, "r AS (SELECT id, term_id, row_number() OVER (PARTITION BY term_id ORDER BY price DESC, item_id) - 1 AS position FROM pairs)") + "SELECT id, term_id, CAST(position AS INTEGER) AS position FROM r WHERE position IN (0, 2, 4)")
def rank_positions(spark, sf):
    return windows.rank_positions(pairs(spark, sf).select("id", "term_id", "item_id", "price"), ["term_id"], [F.desc("price"), F.asc("item_id")], [0, 2, 4]).select("id", "term_id", "position")


@query("rank_band", with_(PAIRS_SQL, "r AS (SELECT id, term_id, row_number() OVER (PARTITION BY term_id ORDER BY price DESC, item_id) AS rank FROM pairs)") + "SELECT id, term_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank BETWEEN 2 AND 4")
def rank_band(spark, sf):
    return windows.top_k(pairs(spark, sf).select("id", "term_id", "item_id", "price"), ["term_id"], [F.desc("price"), F.asc("item_id")], 3, 1).select("id", "term_id", "rank")
