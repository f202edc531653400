"""The logical tables as views over the driver's tables, each with the SQL that gives the same rows.

Pairs come from lineitem (term = order, item = part, one row per pair), items from part, terms from orders; query texts
take the words of a part, so that they overlap with titles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, and the SQL of its rows where SQL can say them."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PAIRS_SQL = """pairs AS (
  SELECT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS term_id, l_partkey AS item_id, max(l_extendedprice) AS price, max(l_discount) * 10.0::DOUBLE AS s1,
    max(l_tax) * 12.5::DOUBLE AS s2, max(l_extendedprice) / 110000.0::DOUBLE AS s3, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, term_id, item_id, price, s1, s2, s3, label); dealt by term once, for the aggregate and for windows by term."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    g = li.groupBy(F.col("l_orderkey").alias("term_id"), F.col("l_partkey").alias("item_id")).agg(
        F.max("l_extendedprice").alias("price"), (F.max("l_discount") * 10.0).alias("s1"), (F.max("l_tax") * 12.5).alias("s2"),
        (F.max("l_extendedprice") / 110000.0).alias("s3"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"),
    )
    return g.select((F.col("term_id") * 10000000 + F.col("item_id")).alias("id"), "term_id", "item_id", "price", "s1", "s2", "s3", "label")


ITEMS_SQL = """items AS (
  SELECT p_partkey AS item_id, p_name AS title, p_type || '/' || split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) AS category, lower(p_brand) AS brand,
    CASE p_size % 3 WHEN 0 THEN 'erkek' WHEN 1 THEN 'kadın' END AS gender, CASE WHEN p_size % 2 = 0 THEN 'yetişkin' ELSE 'bebek' END AS age_group,
    CASE p_size % 4 WHEN 0 THEN 'renk: Mavi, materyal: ' || split_part(p_name, ' ', 2) WHEN 1 THEN 'materyal: ' || split_part(p_name, ' ', 2) || ', renk: kırmızı'
      WHEN 2 THEN 'boy: ' || CAST(p_size AS VARCHAR) END AS attributes
  FROM part)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.concat_ws("/", "p_type", word(1), word(2)).alias("category"),
        F.lower("p_brand").alias("brand"),
        F.when(size % 3 == 0, "erkek").when(size % 3 == 1, "kadın").alias("gender"),
        F.when(size % 2 == 0, "yetişkin").otherwise("bebek").alias("age_group"),
        F.when(size % 4 == 0, F.concat(F.lit("renk: Mavi, materyal: "), word(2)))
        .when(size % 4 == 1, F.concat(F.lit("materyal: "), word(2), F.lit(", renk: kırmızı")))
        .when(size % 4 == 2, F.concat(F.lit("boy: "), size.cast("string")))
        .alias("attributes"),
    )


TERMS_SQL = """terms AS (
  SELECT o_orderkey AS term_id, lower(p_type) || ' ' || p_name || CASE o_orderkey % 6 WHEN 0 THEN ' erkek, Gömlek!' WHEN 1 THEN ' bayan 10 KG' WHEN 2 THEN ' çocuk kırmızı'
    WHEN 3 THEN ' ' || lower(p_brand) WHEN 4 THEN ' mavi evlerde' ELSE ' red red' END AS query
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """(term_id, query)"""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    n = table(spark, sf, "part").count()
    key = F.col("o_orderkey")
    tail = (
        F.when(key % 6 == 0, " erkek, Gömlek!").when(key % 6 == 1, " bayan 10 KG").when(key % 6 == 2, " çocuk kırmızı")
        .when(key % 6 == 3, F.concat(F.lit(" "), F.lower("p_brand"))).when(key % 6 == 4, " mavi evlerde").otherwise(" red red")
    )
    o = table(spark, sf, "orders").select("o_orderkey").withColumn("p_partkey", key % n)
    return o.join(p, "p_partkey").select(key.alias("term_id"), F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name"), tail).alias("query"))


POSITIVES_SQL = "positives AS (SELECT term_id, item_id FROM pairs WHERE label = 1)"


def positives(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of label 1, without the others being grouped first."""
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return li.select(F.col("l_orderkey").alias("term_id"), F.col("l_partkey").alias("item_id")).distinct()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
