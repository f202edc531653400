"""Incremental labelling over a landing folder: an extension in the spirit of appends that can resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_new


def label_stream(spark: SparkSession, landing: str, schema: T.StructType, out: str, checkpoint: str, label, key: str = "id", files_per_trigger: int = 100) -> StreamingQuery:
    """Label every file that lands, once: ``label`` maps a batch to rows with ``key``; keys already in ``out`` are left out,
    so a batch that is replayed after a failure appends nothing twice. ``out`` holds a table of ``writers.Versions``. Ends when all present files are done."""

    def batch(df: DataFrame, _: int) -> None:
        append_new(label(df).dropDuplicates([key]), out, key)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
