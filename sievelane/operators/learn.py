"""Learned scorers on pyspark.ml, out-of-fold; ensembles; the place where an external scorer plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stacker_lexical
from ..sources.shared import staged
from .metrics import weighted_threshold
from .windows import global_rank


def trees(seed: int = 42, **more) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", seed=seed, **({"maxIter": 20, "maxDepth": 4} | more))


def forest(seed: int = 42, **more) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", featuresCol="features", seed=seed, **({"numTrees": 20, "maxDepth": 6} | more))


def logistic(**more) -> LogisticRegression:
    return LogisticRegression(labelCol="label", featuresCol="features", **({"maxIter": 50, "regParam": 0.0} | more))


def pipeline(features: list[str], learner) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), learner])


def predict(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


def weighted_folds(df: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """(features, label, n0, n1, ...): the labelled rows that agree in all features and in the label as one, with how many there are in each fold. A table."""
    each = [F.sum((F.col("fold") == f).cast("int")).cast("double").alias(f"n{f}") for f in range(folds)]
    return staged(df.filter(F.col("label").isNotNull()).groupBy(*features, "label").agg(F.count("*").cast("double").alias("n"), *each))


def fit_folds(df: DataFrame, features: list[str], learners: Callable[[], list], folds: int = 5, weighted: DataFrame | None = None) -> dict[int, list[PipelineModel]]:
    """For each fold, models fitted on the labelled rows of the others; rows alike are one row with their number as its weight (``weighted_folds``)."""
    rows = weighted_folds(df, features, folds) if weighted is None else weighted
    out = {}
    for f in range(folds):
        others = rows.withColumn("weight", F.col("n") - F.col(f"n{f}")).filter("weight > 0")
        out[f] = [pipeline(features, m.setWeightCol("weight")).fit(others) for m in learners()]
    return out


def _averaged(df: DataFrame, models: list[PipelineModel], out: str) -> DataFrame:
    for i, m in enumerate(models):
        df = predict(m, df, f"_s{i}")
    total = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(len(models))]) / len(models)
    return df.withColumn(out, total).drop(*[f"_s{i}" for i in range(len(models))])


def out_of_fold(df: DataFrame, models: dict[int, list[PipelineModel]], out: str = "oof") -> DataFrame:
    """Every row scored by the models that didn't see its fold, averaged."""
    return reduce(DataFrame.unionByName, [_averaged(df.filter(F.col("fold") == f), ms, out) for f, ms in models.items()])


def fold_ensemble(df: DataFrame, models: dict[int, list[PipelineModel]], out: str = "score") -> DataFrame:
    """New rows scored by all models, averaged."""
    return _averaged(df, [m for ms in models.values() for m in ms], out)


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline, over an older one."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stacker_features(df: DataFrame, scores: list[str], by: str = "term_id", query: Column | None = None, title: Column | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with each score's percent rank and z-score among the rows of its term, and how far the scores agree; (frame, names of
    all features). With texts also the tokens that ``query`` and ``title`` share, their Jaccard index, and how many each has."""
    from .windows import group_size, percent_rank_averaged, zscore

    new = {f"{s}_pct": percent_rank_averaged(s, by) for s in scores} | {f"{s}_z": F.coalesce(zscore(s, by), F.lit(0.0)) for s in scores}
    both = F.array(*scores)
    new |= {"candidates": group_size(by).cast("double"), "spread": F.array_max(both) - F.array_min(both), "mean": sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)}
    if query is not None and title is not None:
        shared = stacker_lexical(query, title)
        new |= {n: c.cast("double") for n, c in zip(("shared", "token_jaccard", "query_tokens", "title_tokens"), shared, strict=True)}
    return df.withColumns(new), [*scores, *new]


def validated_rounds(df: DataFrame, features: list[str], valid: Column, most: int = 60, tolerance: float = 0.001, **more) -> int:
    """How many trees boosting takes until the rows of ``valid`` gain no more by another; ``most`` at the most."""
    rows = df.filter(F.col("label").isNotNull()).withColumn("_valid", valid)
    model = pipeline(features, trees(maxIter=most, validationIndicatorCol="_valid", validationTol=tolerance, **more)).fit(rows)
    return len(model.stages[-1].trees)


def refit_folds(df: DataFrame, features: list[str], folds: int = 5, most: int = 60, **more) -> tuple[dict[int, list[PipelineModel]], dict[int, int]]:
    """(models by fold, rounds by fold): each fold's number of trees comes from stopping early on its own rows; the models that infer are
    then fitted to the other folds again, with so many trees and without stopping."""
    labelled = df.filter(F.col("label").isNotNull())
    rounds = {f: validated_rounds(labelled, features, F.col("fold") == f, most, **more) for f in range(folds)}
    return {f: [pipeline(features, trees(maxIter=n, **more)).fit(labelled.filter(F.col("fold") != f))] for f, n in rounds.items()}, rounds


def three_learners(df: DataFrame, features: list[str], folds: int = 5, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores of boosted trees, a random forest and a logistic model, the best weights of the three and their threshold)."""
    makers = {"boosted": lambda: [trees(maxIter=10)], "forest": lambda: [forest()], "linear": lambda: [logistic(maxIter=20)]}
    rows = staged(df.select(key, "fold", "label", *features))
    weighted = weighted_folds(rows, features, folds)
    models = fit_folds(rows, features, lambda: [make()[0] for make in makers.values()], folds, weighted)
    # each fold's rows pass its three models once
    rows = staged(reduce(DataFrame.unionByName, [reduce(lambda part, m: predict(m[1], part, m[0]), zip(makers, ms, strict=True), rows.filter(F.col("fold") == f)) for f, ms in models.items()]))
    scores = rows.select(key, "label", *makers)
    return scores, weighted_threshold(scores, list(makers), F.col("label"))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))


def stack(df: DataFrame, features: list[str], half: str = "half") -> tuple[PipelineModel, PipelineModel, DataFrame]:
    """A logistic stacker: (fitted on half 0, refitted on all labelled rows, half 1 scored by the first for the report)."""
    labelled = df.filter(F.col("label").isNotNull())
    first = pipeline(features, logistic()).fit(labelled.filter(F.col(half) == 0))
    return first, pipeline(features, logistic()).fit(labelled), predict(first, labelled.filter(F.col(half) == 1))


def rank_average(scores: DataFrame, models: list[str] | None = None, key: str = "id", least: int = 2) -> DataFrame:
    """(id, score): the mean of each model's rank-normalised scores, over ids that all of the models have scored.

    ``scores``: (id, model, score). ``models``: a subset; names without scores are skipped, and ``least`` must remain.
    """
    rows = scores if models is None else scores.filter(F.col("model").isin(models))
    names = sorted(r[0] for r in rows.select("model").distinct().collect())  # one row per model
    if len(names) < least:
        raise ValueError(f"{least} models are needed, found {names}")
    ranked = global_rank(rows, "score", key, "_r", by=["model"])
    norm = ranked.withColumn("_v", F.coalesce(F.try_divide(F.col("_r").cast("double"), F.col("n") - 1), F.lit(0.0)))
    return norm.groupBy(key).agg(F.avg("_v").alias("score"), F.count("*").alias("_m")).filter(F.col("_m") == len(names)).drop("_m")


def wide_scores(scores: DataFrame, models: list[str], key: str = "id") -> DataFrame:
    """(id, a column per model)"""
    return scores.groupBy(key).pivot("model", models).agg(F.first("score"))


def both_splits(artifacts: DataFrame) -> DataFrame:
    """The models that have scores for the holdout and for the test rows."""
    return artifacts.filter(F.col("split").isin("holdout", "test")).groupBy("model").agg(F.count_distinct("split").alias("n")).filter("n = 2").select("model")


def score_external(df: DataFrame, scorer: Callable[[list[str]], list[float | None]], text_col: str, out: str = "score", batch: int = 64, tries: int = 3) -> DataFrame:
    """Send texts to an injected scorer, ``batch`` at a time; a call that keeps failing leaves null, never a made-up score."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values: list[float | None] = []
            texts = frame[text_col].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                got: list[float | None] = [None] * len(part)
                for _ in range(tries):
                    try:
                        got = scorer(part)
                        break
                    except (OSError, TimeoutError, ValueError):
                        continue
                values += got
            yield frame.assign(**{out: pd.Series(values, index=frame.index, dtype="float64")})

    return df.mapInPandas(run, schema)
