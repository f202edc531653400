"""Macro-F1, prevalence reweighting, exams, and sweeps over exact grids of thresholds.

A sweep buckets every score by the grid points it reaches and sums the buckets from above, so the work is the number of
rows plus the size of the grid. Grid points are whole numbers over a scale, the same doubles in every engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import order_statistics, value_positions


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 TP / (2 TP + FP + FN), 0 if the denominator is."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2.0


def confusion(df: DataFrame, label: Column, prediction: Column, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn as doubles."""
    w = F.lit(1.0) if weight is None else weight
    cell = lambda y, p: F.coalesce(F.sum(F.when((label == y) & (prediction == p), w)), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def class_report(df: DataFrame, label: Column, prediction: Column) -> DataFrame:
    """precision, recall and F1 of both classes, and macro_f1."""
    c = confusion(df, label, prediction)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    return c.select(
        share(tp, fp).alias("precision_1"), share(tp, fn).alias("recall_1"), f1(tp, fp, fn).alias("f1_1"),
        share(tn, fn).alias("precision_0"), share(tn, fp).alias("recall_0"), f1(tn, fn, fp).alias("f1_0"),
        macro_f1(tp, fp, fn, tn).alias("macro_f1"),
    )


def negative_weight(positives: Column, negatives: Column, prevalence: float) -> Column:
    """The weight of a negative under which positives make up ``prevalence``."""
    return F.try_divide(positives * (1.0 - prevalence), negatives * prevalence)


def all_zeros_score(prevalence: Column) -> Column:
    """Macro-F1 of predicting 0 throughout."""
    return (1.0 - prevalence) / (2.0 - prevalence)


def grid(spark: SparkSession, low: int, high: int, scale: int) -> DataFrame:
    """(g, t): whole numbers low..high and their quotients by ``scale``."""
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias("g"), (F.col("id") / F.lit(float(scale))).alias("t"))


def sweep(df: DataFrame, score: Column, label: Column, low: int, high: int, scale: int, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, t, tp, fp, fn, tn, macro_f1) for every threshold g / scale, low <= g <= high, of ``score >= t``."""
    by = by or []
    w = F.lit(1.0) if weight is None else weight
    # the number of grid points that the score reaches; the product may round across a point, so both neighbours are compared
    near = F.floor(score * scale)
    reached = near + F.when((near + 1) / F.lit(float(scale)) <= score, 1).when(near / F.lit(float(scale)) > score, -1).otherwise(0)
    bucket = F.greatest(F.lit(low - 1), F.least(F.lit(high), reached)).cast("int")
    sums = df.filter(label.isNotNull() & score.isNotNull()).select(*by, bucket.alias("g"), label.alias("_y"), w.alias("_w")).groupBy(*by, "g").agg(
        F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("_w"))), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.when(F.col("_y") == 0, F.col("_w"))), F.lit(0.0)).alias("q")
    )
    groups = sums.select(*by).distinct() if by else None
    points = grid(df.sparkSession, low - 1, high, scale)
    # a grid is a few hundred rows, a literal of the plan; each group gets all of it
    points = points if groups is None else groups.withColumn("_g", F.explode(F.sequence(F.lit(low - 1), F.lit(high)))).select(*by, F.col("_g").alias("g"), (F.col("_g") / F.lit(float(scale))).alias("t"))
    full = points.join(sums, [*by, "g"], "left").fillna(0.0, ["p", "q"])
    above = Window.partitionBy(*by).orderBy(F.desc("g"))
    whole = Window.partitionBy(*by)
    full = full.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("q").over(above), "P": F.sum("p").over(whole), "Q": F.sum("q").over(whole)})
    full = full.filter(F.col("g") >= low).withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("Q") - F.col("fp")})
    return full.select(*by, "t", "tp", "fp", "fn", "tn", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("macro_f1"))


def best(sweeps: DataFrame, largest: bool = False, by: list[str] | None = None) -> DataFrame:
    """The threshold of the highest macro-F1; of equal ones the smallest (or the largest). 0.5 if none is above 0."""
    rank = F.struct(F.round("macro_f1", 12), F.col("t") if largest else -F.col("t"))
    picked = sweeps.groupBy(*(by or [])).agg(F.max_by(F.struct("t", "macro_f1"), rank).alias("b"))
    return picked.select(*(by or []), F.when(F.col("b.macro_f1") > 0, F.col("b.t")).otherwise(F.lit(0.5)).alias("t"), F.col("b.macro_f1").alias("macro_f1"))


def rate_threshold(df: DataFrame, score: str, rates: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, rate, threshold): the exact quantile of the scores at 1 - rate, linear between neighbours.

    Overall, counted parts of the values lead to the two neighbours; within ``by``, ranks of the distinct scores do. No task gets all of them.
    """
    if not by:
        found = rate_thresholds(df, score, rates)
        return df.sparkSession.createDataFrame(list(found.items()), "rate double, threshold double")
    at = value_positions(df.select(*by, F.col(score).cast("double").alias("_v")), "_v", by)
    wanted = F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(1.0 - r).alias("q")) for r in rates])
    held = lambda h: (F.col("before") <= h) & (h < F.col("before") + F.col("times"))
    place = lambda x: x["q"] * (F.col("n") - 1)
    hits = at.select(*by, "_v", "before", "times", "n", F.explode(F.filter(wanted, lambda x: held(F.floor(place(x))) | held(F.ceil(place(x))))).alias("x"))
    h = F.col("x.q") * (F.col("n") - 1)
    ends = hits.groupBy(*by, F.col("x.rate").alias("rate")).agg(
        F.max(F.when(held(F.floor(h)), F.col("_v"))).alias("low"), F.max(F.when(held(F.ceil(h)), F.col("_v"))).alias("high"), F.max(h - F.floor(h)).alias("part")
    )
    return ends.select(*by, "rate", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1.0 - F.col("part")) * F.col("low") + F.col("part") * F.col("high")).alias("threshold"))


def rate_thresholds(df: DataFrame, score: str, rates: list[float]) -> dict[float, float]:
    """The thresholds of ``rate_threshold`` by rate; none without scores."""
    values = df.select(F.col(score).cast("double")).filter(F.col(score).isNotNull())
    n = values.count()
    if not n:
        return {}
    at = {r: (1.0 - r) * (n - 1) for r in rates}
    known = order_statistics(values, sorted({f(h) for h in at.values() for f in (math.floor, math.ceil)}))
    out = {}
    for r, h in at.items():
        low, high, part = known[math.floor(h)], known[math.ceil(h)], h - math.floor(h)
        out[r] = low if low == high else (1.0 - part) * low + part * high
    return out


#: Scores that a batch holds at once while weights are tried.
BATCH_SCORES = 1 << 19


def contingency(df: DataFrame, scores: list[str], label: Column, cuts: list[float], weights: list[tuple[float, ...]] | None = None, digits: int | None = None) -> DataFrame:
    """(w, g, p, q): of each row of ``weights``, how many positives and negatives reach exactly ``g`` of the ascending ``cuts`` with their weighted score.

    A task keeps one table of counts and adds every batch to it, so rows are never multiplied by weights or cuts. Without weights there is one
    score, as it is. ``digits``: scores are rounded to so many. Rows without a label or a score are left out.
    """
    w = np.array(weights if weights is not None else [(1.0,)])
    grid = np.array(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(w), len(grid) + 1), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            step = max(1, BATCH_SCORES // len(w))
            for lo in range(0, len(label), step):
                part = own[lo : lo + step]
                s = part[:, :1] * w[:, 0]
                for i in range(1, w.shape[1]):
                    s = s + part[:, i : i + 1] * w[:, i]
                s = s if digits is None else np.round(s, digits)
                cell = np.searchsorted(grid, s, "right") + np.arange(len(w)) * (len(grid) + 1)
                for y in (0, 1):
                    counts[y] += np.bincount(cell[label[lo : lo + step] == y].ravel(), minlength=counts[y].size).reshape(counts[y].shape)
        i, g = np.nonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(g, pa.int32()), pa.array(counts[1, i, g]), pa.array(counts[0, i, g])], names=["w", "g", "p", "q"])

    rows = df.select(label.cast("int").alias("_y"), *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(scores)]).dropna().filter("_y IN (0, 1)")
    sums = rows.mapInArrow(run, "w int, g int, p long, q long").groupBy("w", "g").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums


def swept(sums: DataFrame, cuts: list[float], weights: list[tuple[float, ...]] | None = None) -> DataFrame:
    """(w, t, tp, fp, fn, tn, macro_f1) for all weights and cuts of ``contingency``: the rows that reach a cut are predicted 1."""
    spark = sums.sparkSession
    n = len(weights) if weights is not None else 1
    # a fixed table of weights times cuts
    points = spark.range(n * (len(cuts) + 1)).select((F.col("id") / (len(cuts) + 1)).cast("int").alias("w"), (F.col("id") % (len(cuts) + 1)).cast("int").alias("g"))
    full = points.join(sums, ["w", "g"], "left").select("w", "g", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("p", "q")])
    above, whole = Window.partitionBy("w").orderBy(F.desc("g")), Window.partitionBy("w")
    full = full.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("q").over(above), "fn": F.sum("p").over(whole), "tn": F.sum("q").over(whole)}).filter("g > 0")
    full = full.withColumns({"fn": F.col("fn") - F.col("tp"), "tn": F.col("tn") - F.col("fp"), "t": F.get(F.array(*[F.lit(float(c)) for c in cuts]), F.col("g") - 1)})
    return full.select("w", "t", "tp", "fp", "fn", "tn", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("macro_f1"))


def weighted_threshold(df: DataFrame, scores: list[str], label: Column, coarse: tuple[int, int, int] = (30, 70, 100), fine: tuple[int, int, int] = (150, 354, 500)) -> DataFrame:
    """(a, b, c, t_coarse, f_coarse, t_fine, f_fine): the first best of all weights of three scores and thresholds low / scale to
    high / scale, and the best threshold of its weights on the finer grid. Weighted scores are rounded to nine digits."""
    points = lambda low, high, scale: [g / scale for g in range(low, high + 1)]
    weights = weight_triples()
    s = swept(contingency(df, scores, label, points(*coarse), weights, 9), points(*coarse), weights)
    first = s.orderBy(F.desc(F.round("macro_f1", 12)), "w", "t").select("w", "t", F.round("macro_f1", 9).alias("f")).first()
    if first is None:
        raise ValueError("there are no labelled rows")
    own = [weights[first["w"]]]
    last = best(swept(contingency(df, scores, label, points(*fine), own, 9), points(*fine), own))
    named = [F.lit(x).alias(n) for n, x in zip("abc", own[0], strict=True)]
    return last.select(*named, F.lit(first["t"]).alias("t_coarse"), F.lit(first["f"]).alias("f_coarse"), F.col("t").alias("t_fine"), F.round("macro_f1", 9).alias("f_fine"))


def sweep_rates(df: DataFrame, score: str, label: Column, rates: list[float]) -> DataFrame:
    """(rate, threshold, tp, fp, fn, tn, macro_f1): the threshold of each positive rate among the scores, and how it does."""
    at = rate_thresholds(df, score, rates)
    cuts = sorted(set(at.values()))
    s = swept(contingency(df, [score], label, cuts), cuts)
    # a row for each rate
    by_rate = df.sparkSession.createDataFrame(list(at.items()), "rate double, t double")
    return s.join(F.broadcast(by_rate), "t").select("rate", F.col("t").alias("threshold"), "tp", "fp", "fn", "tn", "macro_f1")


def carried_rate(holdout: DataFrame, test: DataFrame, score: str, label: Column, rates: list[float]) -> DataFrame:
    """(rate, holdout_threshold, macro_f1, test_threshold): the best positive rate on the holdout, of equal ones the smallest, and
    the threshold that gives this rate among the test rows."""
    f = sweep_rates(holdout, score, label, rates).select("rate", F.col("threshold").alias("holdout_threshold"), "macro_f1")
    top = f.orderBy(F.desc(F.round("macro_f1", 12)), "rate").limit(1)
    return top.join(F.broadcast(rate_threshold(test, score, rates).withColumnRenamed("threshold", "test_threshold")), "rate")


def exam(df: DataFrame, truth: Column, verdict: Column) -> DataFrame:
    """recall on positives and false positive rate on negatives."""
    v = verdict.cast("double")
    return df.agg(F.avg(F.when(truth == 1, v)).alias("recall"), F.avg(F.when(truth == 0, v)).alias("fpr"), F.count("*").alias("n"))


def weight_grid(steps: int = 10) -> Column:
    """All weight triples in steps of 1 / steps that sum to 1, as an array of structs (a, b, c)."""
    scale = float(steps)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(steps) - a), lambda b: F.struct(a.alias("a"), b.alias("b"), (F.lit(steps) - a - b).alias("c")))))
    return F.transform(pairs, lambda s: F.struct((s["a"] / scale).alias("a"), (s["b"] / scale).alias("b"), (s["c"] / scale).alias("c")))


def weight_triples(steps: int = 10) -> list[tuple[float, float, float]]:
    """The triples of ``weight_grid``, in its order."""
    return [(a / steps, b / steps, (steps - a - b) / steps) for a in range(steps + 1) for b in range(steps + 1 - a)]
