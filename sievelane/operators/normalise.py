"""Normalised texts by a dictionary of their words: each distinct word is corrected once, by a join, not by an edit distance per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import counted_broadcast, staged
from .joins import fuzzy_brands

#: Corrected words up to which the dictionary is part of the plan; a larger one is joined.
DICTIONARY = 256


def brand_dictionary(words: DataFrame, token: str = "token", brands: list[str] = X.BRANDS) -> DataFrame:
    """(token, brand): the distinct ``words`` that have brands of more than three letters at edit distance 1, and the smallest of these.

    Words of which the correction is listed, or that are too long or short, aren't looked at.
    """
    known = [b for b in brands if len(b) > 3]
    c = F.col(token)
    some = words.select(token).filter(F.length(c).between(min(map(len, known)) - 1, max(map(len, known)) + 1) & ~c.isin(list(X.CORRECTIONS))).distinct()
    listed = words.sparkSession.createDataFrame([(b,) for b in known], "brand string")
    return fuzzy_brands(some, listed, token)


def normalise_texts(df: DataFrame, text_col: str, out: str, stemming: bool = True, brands: list[str] = X.BRANDS, dictionary: int = DICTIONARY) -> DataFrame:
    """``df`` with ``out``: what ``functions.text.normalise`` makes of the text.

    The texts' distinct words are corrected by a deletion-neighbourhood join. Few corrections become a map in the plan; more are joined to the words
    of the texts, and only texts with a corrected word are put together again. Null texts give ''.
    """
    spark = df.sparkSession
    cut = X.words(X.clean_punctuation(X.expand_abbreviations(X.turkish_lower(F.col(text_col)))))
    fixes = staged(brand_dictionary(df.select(F.explode(cut).alias("token")), brands=brands))
    listed = F.create_map(*[F.lit(x) for kv in X.CORRECTIONS.items() for x in kv])
    last = X.stem if stemming else (lambda w: w)
    found = fixes.limit(dictionary + 1).collect()
    if len(found) <= dictionary:
        own = F.create_map(*[F.lit(x) for r in found for x in r]) if found else None

        def fix(w: Column) -> Column:
            return last(F.coalesce(F.try_element_at(listed, w), *([F.try_element_at(own, w)] if found else []), w))

        return df.withColumn(out, F.array_join(F.transform(cut, fix), " "))
    # rows are told apart by a number that is written with them
    rows = staged(df.withColumns({"_words": cut, "_row": F.monotonically_increasing_id()}))
    hits = rows.select("_row", F.posexplode("_words").alias("_at", "token")).join(counted_broadcast(fixes), "token")
    hits = hits.groupBy(F.col("_row").alias("_hit")).agg(F.map_from_entries(F.collect_list(F.struct("_at", "brand"))).alias("_fixed"))
    joined = rows.join(hits, F.col("_row") == F.col("_hit"), "left")
    words = F.transform("_words", lambda w, i: last(F.coalesce(F.try_element_at(listed, w), F.try_element_at(F.col("_fixed"), i), w)))
    return joined.withColumn(out, F.array_join(words, " ")).drop("_words", "_row", "_hit", "_fixed")
