"""Label sources: precedence, selection of rows for another judgement, decisions, training sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_number


def by_precedence(labels: DataFrame, key: list[str], priority: str = "priority", first_wins: bool = False) -> DataFrame:
    """One label per key: that of the highest priority (the lowest, if ``first_wins``); partial aggregation, no sort."""
    pick = F.min_by if first_wins else F.max_by
    # equal priorities are settled by the larger label, so the result doesn't depend on the order of rows
    rank = F.struct(F.col(priority), F.col("label"))
    return labels.groupBy(*key).agg(pick(F.struct("label", "source"), rank).alias("_w")).select(*key, "_w.label", "_w.source")


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, (id, label)) in order of rising precedence, as one table with source and priority."""
    return reduce(DataFrame.unionByName, [df.select("id", "label").withColumns({"source": F.lit(n), "priority": F.lit(i)}) for i, (n, df) in enumerate(sources)])


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def in_band(score: Column, low: float, high: float) -> Column:
    return score.between(low, high)


def rescue(main: Column, others: list[Column], low: float = 0.03, high: float = 0.5) -> Column:
    """The main score all but rules it out, another model doesn't."""
    return (main < low) & reduce(lambda a, b: a | b, [o > high for o in others])


def conflict(score: Column, label: Column, low: float = 0.03, high: float = 0.85) -> Column:
    """How strongly label and score disagree, within the band; null if they don't."""
    strength = F.when((label == 0) & (score >= 0.5), score).when((label == 1) & (score <= 0.08), 1.0 - score)
    return F.when(score.between(low, high), strength)


def mean_of(scores: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, scores) / F.lit(float(len(scores)))


def disagreement(label: Column, scores: list[Column]) -> Column:
    return F.abs(label.cast("double") - mean_of(scores))


def disputed_tier(df: DataFrame, label: Column, scores: list[Column], base: Column, cap: int, key: str = "id", low: float = 0.30, high: float = 0.50) -> DataFrame:
    """(key, dispute): the ``cap`` rows in the uncertain band of ``base`` whose label the mean of ``scores`` disputes by ``low`` up to below ``high``,
    strongest first, of equal ones by key."""
    rows = df.filter(in_band(base, 0.03, 0.97) & label.isNotNull()).select(key, F.round(disagreement(label, scores), 9).alias("dispute"))
    return rows.filter((F.col("dispute") >= low) & (F.col("dispute") < high)).orderBy(F.desc("dispute"), key).limit(cap)


def hybrid_decision(score: Column, band_label: Column, threshold: float, low: float, high: float) -> Column:
    """Above the band 1, below it 0; within it the label, or else the threshold."""
    base = (score >= threshold).cast("int")
    return F.when(score > high, 1).when(score < low, 0).otherwise(F.coalesce(band_label.cast("int"), base))


def label_or_threshold(score: Column, label: Column, threshold: float) -> Column:
    return F.coalesce(label.cast("int"), (score >= threshold).cast("int"))


def easy_tails(first: Column, second: Column | None = None) -> Column:
    """0 or 1 where the models are sure, else null; ``second`` may be missing."""
    if second is None:
        return F.when(first < 0.03, 0).when(first > 0.97, 1)
    return F.when((first < 0.03) & (second < 0.3), 0).when((first > 0.97) & (second > 0.7), 1)


def override_base(base: DataFrame, new: DataFrame) -> DataFrame:
    """(term_id, item_id, label, fold) of both; new rows take their term's fold from the base, go without one, and win."""
    folds = base.groupBy("term_id").agg(F.min("fold").alias("fold"))
    fresh = new.select("term_id", "item_id", "label").join(folds, "term_id").filter("fold IS NOT NULL").withColumn("_p", F.lit(0))
    both = fresh.unionByName(base.select("term_id", "item_id", "label", "fold").withColumn("_p", F.lit(1)))
    return both.groupBy("term_id", "item_id").agg(F.min_by(F.struct("label", "fold"), F.struct("_p", "label")).alias("w")).select("term_id", "item_id", "w.label", "w.fold")


def fold_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("positive_rate"))


def merge_synthetic(terms: DataFrame, synthetic: DataFrame, prefix: str = "SYN_") -> DataFrame:
    """Original and synthetic terms, the latter under prefixed keys."""
    copies = synthetic.select(F.concat(F.lit(prefix), F.col("term_id").cast("string")).alias("term_id"), "query")
    return terms.select(F.col("term_id").cast("string").alias("term_id"), "query").unionByName(copies)


def augmented(pairs: DataFrame, terms: DataFrame, noisy: Callable[[Column, Column], Column], train: Column, share: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms) with copies of ``share`` of the training terms: a term that ``noisy`` (query, term) changes comes again under SYN_ and its id, and so
    does each of its ``train`` rows, labels included. Held-out rows are never copied."""
    own = pairs.filter(train).select("term_id").distinct()
    drawn = own.filter(hash_number(F.col("term_id"), F.lit(seed), F.lit("augment")) < F.lit(int(share * 2**32)))
    made = terms.join(drawn, "term_id", "left_semi").select("term_id", F.explode(F.array_compact(F.array(noisy(F.col("query"), F.col("term_id"))))).alias("query"))
    name = F.concat(F.lit("SYN_"), F.col("term_id").cast("string")).alias("term_id")
    copies = pairs.filter(train).join(made.select("term_id"), "term_id", "left_semi")
    text = lambda df: df.withColumn("term_id", F.col("term_id").cast("string"))
    both = text(pairs).unionByName(copies.select(*[name if c == "term_id" else c for c in pairs.columns]))
    return both, text(terms.select("term_id", "query")).unionByName(made.select(name, "query"))
