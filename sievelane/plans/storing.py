"""Queries that pass through a file: CSV, gzip, parts, label files, scalars, vectors, appends, replacements, models.

Files go to a fresh path in the folder of ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn
from ..schemas import D, I, L, S, _of
from ..sources import npy, readers, writers
from ..sources.shared import fresh as _fresh
from .adapters import PAIRS_SQL, TERMS_SQL, pairs, query, table, terms, with_


@query("submission_csv", with_(PAIRS_SQL) + "SELECT id, CAST(s3 >= 0.5 AS INTEGER) AS prediction FROM pairs")
def submission_csv(spark, sf):
    """A submission, written as CSV and read with its schema."""
    path = _fresh(spark)
    writers.write_submission(pairs(spark, sf).select("id", (F.col("s3") >= 0.5).cast("int").alias("prediction"), "s1"), path)
    return readers.read_csv(spark, path, _of(id=L, prediction=I))


@query("terms_csv", with_(TERMS_SQL) + "SELECT term_id, query FROM terms")
def terms_csv(spark, sf):
    """Texts with commas and letters beyond ASCII through CSV."""
    path = _fresh(spark)
    terms(spark, sf).write.csv(path, header=True, escape='"')
    return readers.read_csv(spark, path, _of(term_id=L, query=S), escape='"')


@query("parts_csv", "SELECT l_orderkey AS term_id, l_partkey AS item_id, l_quantity AS score, CASE l_returnflag WHEN 'R' THEN 'a' ELSE 'b' END AS folder FROM lineitem")
def parts_csv(spark, sf):
    """Several parts by a pattern, each row with the part it came from."""
    path = _fresh(spark)
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("term_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("double").alias("score"), F.when(F.col("l_returnflag") == "R", "a").otherwise("b").alias("folder"))
    for name in ("a", "b"):
        rows.filter(F.col("folder") == name).drop("folder").write.csv(f"{path}/{name}", header=True)
    parts = readers.read_csv(spark, f"{path}/*", _of(term_id=L, item_id=L, score=D))
    return parts.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))


@query("gzip_ids", with_(PAIRS_SQL) + "SELECT id FROM pairs WHERE label = 1")
def gzip_ids(spark, sf):
    path = _fresh(spark)
    pairs(spark, sf).filter("label = 1").select("id").write.csv(path, header=True, compression="gzip")
    return readers.read_csv(spark, path, _of(id=L))


_LABEL_TEXT = "CASE l_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN 'x' END"


@query("label_file", f"WITH l AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, {_LABEL_TEXT} AS label FROM lineitem) SELECT id, CAST(label AS INTEGER) AS label FROM l WHERE label IN ('0', '1')")
def label_file(spark, sf):
    """A progress file in which some lines hold no label, a word, or a number that is no label."""
    path, k = _fresh(spark), F.col("l_orderkey") % 5
    text = F.when(k == 0, "0").when(k == 1, "1").when(k == 2, "2").when(k == 3, "x")
    table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), text.alias("label")).distinct().write.csv(path, header=True)
    return readers.read_labels(spark, path)


@query("threshold_file", with_(PAIRS_SQL) + "SELECT id, CAST(s3 >= 0.4375 AS INTEGER) AS prediction FROM pairs")
def threshold_file(spark, sf):
    """Predictions at a threshold kept in a text file."""
    path = _fresh(spark)
    spark.range(1).select(F.lit("0.4375").alias("value")).coalesce(1).write.text(path)
    return pairs(spark, sf).select("id", (F.col("s3") >= readers.read_scalar(spark, f"{path}/part-*")).cast("int").alias("prediction"))


@query("append_resume", with_(PAIRS_SQL) + "SELECT id, label FROM pairs")
def append_resume(spark, sf):
    """Two appends of overlapping rows, the second one twice: each row is there once."""
    path, rows = _fresh(spark), pairs(spark, sf).select("id", "label", "term_id")
    writers.append_new(rows.filter("term_id % 3 < 2").select("id", "label"), path)
    for _ in range(2):
        writers.append_new(rows.filter("term_id % 3 > 0").select("id", "label"), path)
    return writers.Versions(spark, path).read()


@query("replaced_table", with_(PAIRS_SQL) + "SELECT id, label + 1 AS label FROM pairs")
def replaced_table(spark, sf):
    """A table replaced by a change of itself."""
    table_ = writers.Versions(spark, _fresh(spark))
    table_.replace(pairs(spark, sf).select("id", "label"))
    table_.replace(table_.read().withColumn("label", F.col("label") + 1))
    return table_.read()


@query("rebuilt_table", with_(PAIRS_SQL) + "SELECT id, label + 1 AS label FROM pairs")
def rebuilt_table(spark, sf):
    """A table changed twice from its backup: the change is there once."""
    path = _fresh(spark)
    writers.replace_table(pairs(spark, sf).select("id", "label"), path)
    for _ in range(2):
        out = writers.rebuild(spark, path, lambda df: df.withColumn("label", F.col("label") + 1))
    return out


@query("cached_table", with_(PAIRS_SQL) + "SELECT id, label FROM pairs")
def cached_table(spark, sf):
    """A table built once: the second build is not run."""
    path, rows = _fresh(spark), pairs(spark, sf).select("id", "label")
    writers.cached(spark, path, lambda: rows)
    return writers.cached(spark, path, lambda: rows.withColumn("label", F.lit(-1)))


@query("vectors_table", "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vectors_table(spark, sf):
    path = _fresh(spark)
    writers.write_table(table(spark, sf, "embeddings").select("vec_id", "embedding"), path)
    return readers.read_vectors(spark, path, "vec_id").select("id", F.size("embedding").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("vectors_npy", "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[-1] AS DOUBLE), 6) AS last FROM embeddings")
def vectors_npy(spark, sf):
    """Vectors through .npy files, in ranges of some hundred rows, ids beside them."""
    path = _fresh(spark)
    npy.write_vectors_npy(table(spark, sf, "embeddings"), path, "vec_id")
    e = npy.read_vectors_npy(spark, path)
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    return e.select("id", F.size("embedding").alias("dims"), at(1).alias("first"), at(-1).alias("last"))


@query("feature_store", with_(PAIRS_SQL) + "SELECT id, round(s1, 5) AS s1, CAST(label AS TINYINT) AS label, CAST(term_id % 5 AS INTEGER) AS fold FROM pairs WHERE term_id % 5 <> 4")
def feature_store(spark, sf):
    """Features with narrow types, a folder per fold; the training folds are read, the held-out folder isn't opened."""
    path = _fresh(spark)
    rows = pairs(spark, sf).select("id", "s1", "label", (F.col("term_id") % 5).cast("int").alias("fold"))
    writers.write_table(writers.narrowed(rows, ["label"], ["s1"]), path, ["fold"])
    return readers.read_parquet(spark, path).filter("fold <> 4").withColumn("s1", F.round(F.col("s1").cast("double"), 5))


_FEATURES = ["s1", "s2", "s3"]


@query("saved_model")
def saved_model(spark, sf):
    """A model fitted on half of the terms, saved, loaded, and applied to the others. Learned, so there is no SQL."""
    path, p = _fresh(spark), pairs(spark, sf)
    learn.save_model(learn.pipeline(_FEATURES, learn.logistic()).fit(p.filter("term_id % 2 = 0")), path)
    return learn.predict(learn.load_model(path), p.filter("term_id % 2 = 1").select("id", *_FEATURES)).select("id", "score")


@query("fold_ensemble")
def fold_ensemble(spark, sf):
    """Five models, each without one fold of half of the terms, averaged over the other terms. Learned, so there is no SQL."""
    p = pairs(spark, sf).withColumn("fold", F.when(F.col("term_id") % 2 == 0, F.floor(F.col("term_id") / 2) % 5))
    models = learn.fit_folds(p.filter("fold IS NOT NULL"), _FEATURES, lambda: [learn.logistic()])
    return learn.fold_ensemble(p.filter("fold IS NULL").select("id", *_FEATURES), models).select("id", "score")


@query("importances")
def importances(spark, sf):
    """The features of a tree model by importance. Learned, so there is no SQL."""
    model = learn.pipeline(_FEATURES, learn.trees(maxIter=5, maxDepth=3)).fit(pairs(spark, sf))
    return spark.createDataFrame(learn.importances(model, _FEATURES), "feature string, importance double")
