"""Keyed joins of pairs with their terms, items, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot


def enrich(pairs: DataFrame, terms: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with everything about their term and item; nulls where there is none."""
    return pairs.join(terms, "term_id", "left").join(items, "item_id", "left")


def lookup(pairs: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    return pairs.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def strict_lookup(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """An inner join that raises if a key of ``left`` is missing."""
    missing = [r[0] for r in left.join(table, key, "left_anti").select(key).take(5)]
    if missing:
        raise KeyError(f"no row for {missing}")
    return left.join(table, key)


def similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, out: str = "emb_cos") -> DataFrame:
    """Pairs with the dot product of their two unit vectors, 0 where one is missing. ``left``, ``right``: (key, embedding)."""
    a = left.select(F.col(left.columns[0]).alias(left_key), F.col("embedding").alias("_a"))
    b = right.select(F.col(right.columns[0]).alias(right_key), F.col("embedding").alias("_b"))
    return pairs.join(a, left_key, "left").join(b, right_key, "left").withColumn(out, dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def flag_members(candidates: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates and positives together, each pair once, label 1 for the positives."""
    both = candidates.select(*keys, F.lit(0).alias("label")).unionByName(positives.select(*keys, F.lit(1).alias("label")))
    return both.groupBy(*keys).agg(F.max("label").alias("label"))


def default_prediction(pairs: DataFrame, predictions: DataFrame, key: str = "id", default: int = 0) -> DataFrame:
    """Every pair; those without a prediction get the default."""
    return pairs.join(predictions, key, "left").withColumn("prediction", F.coalesce("prediction", F.lit(default)))


def fuzzy_brands(tokens: DataFrame, brands: DataFrame, token: str = "token", brand: str = "brand", least: int = 4) -> DataFrame:
    """(token, brand): distinct tokens and the smallest brand at edit distance 1, by deletion neighbourhoods.

    Two words at distance 1 share a form with at most one letter removed, so an equi-join on these forms finds all
    candidates; no token meets a brand that isn't near.
    """

    def forms(df: DataFrame, name: str) -> DataFrame:
        c = F.col(name)
        removed = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.concat(F.left(c, i - 1), F.substr(c, i + 1)))
        return df.select(name).distinct().select(name, F.explode(F.array_distinct(F.concat(F.array(c), removed))).alias("_form"))

    near = forms(tokens.filter(F.length(token) > 0), token).join(forms(brands.filter(F.length(brand) >= least), brand), "_form")
    return near.filter(F.levenshtein(token, brand) == 1).groupBy(token).agg(F.min(brand).alias(brand))


def with_condition(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return df.withColumn(name, condition.cast("int"))
