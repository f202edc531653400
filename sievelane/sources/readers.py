"""Sources: explicit schemas, pruned columns, several parts, delimited lines, service replies, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import JUDGE_REPLY, LABEL_FILE


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """CSV with a header; gzip by its ending; CRLF line ends are no part of the values."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df if columns is None else df.select(*columns)


def read_parts(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All CSV parts that match, with ``part``, the name of the file, so that an order of parts can set precedence."""
    return read_csv(spark, pattern, schema).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, label) of progress files: lines that don't fit are skipped, and so are labels other than 0 and 1."""
    rows = spark.read.schema(LABEL_FILE).options(header=True, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    return rows.filter("id IS NOT NULL AND label IN (0, 1)")


def split_line(line: Column) -> tuple[Column, Column, Column]:
    """(id, query, product) of ``id | query | product``; the product may hold the separator; nulls if there are fewer fields."""
    parts = F.split(line, r" \| ", 3)
    ok = F.size(parts) == 3
    return tuple(F.when(ok, F.get(parts, F.lit(i))) for i in range(3))


def split_bare(line: Column) -> tuple[Column, Column, Column]:
    """As ``split_line``, at bare pipes; fields trimmed, the rest rejoined with pipes."""
    parts = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    ok = F.size(parts) >= 3
    tail = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "|")
    return F.when(ok, F.get(parts, F.lit(0))), F.when(ok, F.get(parts, F.lit(1))), F.when(ok, tail)


def read_judge_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, product) of judge inputs; lines with fewer fields go."""
    i, q, p = split_line(F.col("value"))
    return spark.read.text(path).select(i.alias("id"), q.alias("query"), p.alias("product")).filter("id IS NOT NULL")


def parse_reply(line: Column) -> Column:
    return F.from_json(line, JUDGE_REPLY)


def reply_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """(custom_id, status_code, content, prompt_tokens, completion_tokens, failed) of service output lines; blank lines go."""
    r = lines.filter(F.trim(column) != "").select(parse_reply(F.col(column)).alias("r"))
    body = "r.response.body"
    ok = F.coalesce(F.col("r.response.status_code") == 200, F.lit(False))
    return r.select(
        "r.custom_id", "r.response.status_code", F.when(ok, F.get(F.col(f"{body}.choices"), F.lit(0))["message"]["content"]).alias("content"),
        f"{body}.usage.prompt_tokens", f"{body}.usage.completion_tokens", (~ok).alias("failed"),
    )


def request_line(custom_id: Column, model: str, prompt: Column, max_tokens: int = 4) -> Column:
    """A request of a batch file as JSON."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"), F.lit(0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return F.to_json(F.struct(custom_id.cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def read_scalar(spark: SparkSession, path: str) -> float:
    """A number kept in a text file."""
    return float(spark.read.text(path, wholetext=True).first()[0].strip())


def read_vectors(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias("id"), "embedding")
