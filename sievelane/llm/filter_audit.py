"""Audit of how filters interact: a CUBE over failure flags and part gives every subset's survivors, pairs of subsets give the steps.

The text is read once: each row leaves only its flags, its part and a digest, which go to a table in the shared scratch folder.
Copies are found by digest, smallest id first, with a sum before the shuffle. Then the rows are counted by part, flags and labels,
so what the CUBE expands are a few rows for each part. In a grouping set, the rows whose selected flags are all false are
the survivors of the selected filters. A step of an order takes the survivors of the filters before it and those of the
filters up to it: these are pairs of subsets that differ by one filter, 80 for five filters, and all 600 steps share them.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain, bounded, materialise

#: Salts of rows without an id, which have no label to meet.
NULL_SALTS = 1024


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure by letter: A under 200 words, B under half of the words distinct, C over 2 % capitals, D any of ``#$%&*|``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, a boolean column per letter): one row for each row of ``docs``.

    ``filters``: letter to failure, as expressions of a column ``text`` without nulls. ``copies``: the letter of the filter that fails a row whose
    text equals that of a row with a smaller id; rows without an id neither fail it nor make others fail. A null text is empty, a
    null part the empty string.
    """
    plain = Plain(docs, [], [])
    rows = plain.rows.select(F.col(plain.at(id_col)).alias("id"), F.coalesce(F.col(plain.at(part_col)).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(plain.at(text_col)), F.lit("")).alias("text"))
    filters = standard_filters(F.col("text")) if filters is None else filters
    flags = [c.alias(x) for x, c in filters.items()]
    if copies is None:
        return rows.select("id", "part", *flags)
    slim = materialise(rows.select("id", "part", *flags, F.unhex(F.sha2("text", 256)).alias("_digest")))
    # a table of its own, so that Spark can split the rows of a text that very many rows have
    least = materialise(slim.groupBy("_digest").agg(F.min("id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1").select("_digest", "_least"))
    return slim.join(bounded(least, 64), "_digest", "left").select("id", "part", *filters, F.coalesce(F.col("id") > F.col("_least"), F.lit(False)).alias(copies))


def with_labels(rows: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id") -> DataFrame:
    """``rows`` (id, ...) with a 0 or 1 for each of ``names``: whether any row of ``labels`` with this id has a 1 there."""
    plain = Plain(labels, [], [])
    known = plain.rows.select(F.col(plain.at(id_col)).alias("id"), *[F.col(plain.at(n)).alias(f"_{n}") for n in names]).filter("id IS NOT NULL")
    known = known.groupBy("id").agg(*[F.max((F.col(f"_{n}") == 1).cast("int")).alias(n) for n in names])
    # rows without an id would all meet in one task
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(NULL_SALTS)) + 1).otherwise(0)
    left = rows.withColumns({"_id": F.coalesce("id", F.lit(0)), "_salt": salt})
    joined = left.join(known.withColumnRenamed("id", "_id").withColumn("_salt", F.lit(0).cast("bigint")), ["_id", "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def subset_survivors(counts: DataFrame, letters: str, sums: list[str]) -> DataFrame:
    """(part, mask, sums): what passes every filter of the subset ``mask`` (bit i is letter i), zeros included, for all subsets.

    ``counts``: (part, a boolean per letter, sums). A part has a row for the empty subset, so it has all of them.
    """
    cube = counts.cube("part", *letters).agg(*[F.sum(s).alias(s) for s in sums], F.grouping("part").alias("_all"), *[F.grouping(x).alias(f"_{x}") for x in letters])
    passed = reduce(lambda a, x: a & ~F.coalesce(F.col(x), F.lit(False)), letters, F.col("_all") == 0)
    mask = reduce(lambda a, i: a + (1 - F.col(f"_{letters[i]}").cast("int")) * (1 << i), range(len(letters)), F.lit(0))
    found = cube.filter(passed).select("part", mask.alias("mask"), *sums)
    every = found.filter("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in sums])


def steps(spark, letters: str) -> DataFrame:
    """(filter_order, step, letter, before): all orders of the filters; a fixed table of n! * n rows."""
    rows = [("".join(p), i + 1, p[i], sum(1 << letters.index(x) for x in p[:i])) for p in permutations(letters) for i in range(len(letters))]
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, before int")


def audit(rows: DataFrame, letters: str, losses: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <loss>_lost, shapley) for every part, order and step.

    ``rows``: (part, a boolean per letter, a 0/1 column per loss), each letter an upper-case name of a filter. Of a part: ``kept`` after the step, ``removed`` by it, ``redundant`` fail its filter and
    were removed before, ``unique_fails`` fail this filter alone, ``<loss>_lost`` are removed rows with a 1, ``shapley`` sums ``removed``
    of the step's filter over all orders, wherever it stands in them. An empty table has no parts and gives no rows; repeated rows count as often as they are there.
    """
    counts = rows.groupBy("part", *letters).agg(F.count("*").alias("n"), *[F.sum(x).cast("bigint").alias(x) for x in losses])
    sums = ["n", *losses]
    subsets = materialise(subset_survivors(counts, letters, sums))
    all_bits = (1 << len(letters)) - 1
    letter = F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(letters)]))
    before = subsets.select("part", F.col("mask").alias("before"), *[F.col(s).alias(f"_{s}") for s in sums], letter.alias("_l")).select("*", "_l.*").filter(F.col("before").bitwiseAND(F.col("bit")) == 0)
    after = subsets.withColumnRenamed("mask", "_after")
    pairs = before.withColumn("_after", F.col("before") + F.col("bit")).join(after, ["part", "_after"])
    pairs = pairs.select("part", "before", "letter", "bit", F.col("n").alias("kept"), (F.col("_n") - F.col("n")).alias("removed"), *[(F.col(f"_{x}") - F.col(x)).alias(f"{x}_lost") for x in losses])
    whole = Window.partitionBy("part", "letter")
    own = lambda when: F.max(F.when(when, F.col("removed"))).over(whole)
    # a pair stands in as many orders as its earlier filters and its later ones can be arranged
    n = len(letters)
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    pairs = pairs.withColumns({"unique_fails": own(F.col("before") == F.lit(all_bits) - F.col("bit")), "_fails": own(F.col("before") == 0), "shapley": F.sum(F.col("removed") * times).over(whole)})
    pairs = pairs.withColumn("redundant", F.col("_fails") - F.col("removed"))
    out = pairs.join(F.broadcast(steps(rows.sparkSession, letters)), ["letter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in losses], "shapley")
