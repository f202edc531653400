"""Shared helpers: reading tables, the shared scratch folder, cutting lineage."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast hints are given only to sides whose bytes were counted and lie under this.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievelane-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/sievelane-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has written with ``materialise``, once no result reads them any more."""
    drop_path(spark, scratch(spark).rpartition("/")[0])


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back: cuts the lineage and
    lets several consumers share one computation. Lost executors only cost the readers a retry."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._scratch_path)


def bounded(side: DataFrame, row_bytes: int) -> DataFrame:
    """``side``, to be broadcast if its counted rows stay under BROADCAST_BYTES; else Spark shuffles."""
    return F.broadcast(side) if side.count() * row_bytes * 2 <= BROADCAST_BYTES else side


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of 64, if the session sets no limit itself: each task holds a batch several times over, outside the JVM's heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


def trim() -> None:
    """Give freed memory back to the system: idle Python workers stay, and a later stage shares the executor with them."""
    pa.default_memory_pool().release_unused()
    release_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release_heap is not None:
        release_heap(0)


def finite_vector(c: Column) -> Column:
    """True for a vector with components, none of them null, NaN or infinite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad, F.lit(False))


class Plain:
    """A table whose columns are called c0, c1, ..., so that no name of the input can clash with an operator's own.

    ``out``: the names under which the ``keep`` columns come out. One that bears a name of ``new``, in any case of its
    letters, comes out with ``_in`` behind it, as often as that takes.
    """

    def __init__(self, df: DataFrame, keep: list[str], new: list[str]):
        self.names = df.columns
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.kept = [self.at(c) for c in keep]
        self.out: list[str] = []
        taken = {c.lower() for c in new}
        for c in keep:
            while c.lower() in taken:
                c += "_in"
            taken.add(c.lower())
            self.out.append(c)

    def at(self, name: str) -> str:
        """What the column ``name`` is called now."""
        if name in self.names:
            return f"c{self.names.index(name)}"
        return f"c{[c.lower() for c in self.names].index(name.lower())}"

    def schema(self, *new: T.StructField) -> T.StructType:
        """The kept columns under their names, and the new ones."""
        fields = [self.rows.schema[c] for c in self.kept]
        return T.StructType([*(T.StructField(n, f.dataType, f.nullable) for n, f in zip(self.out, fields, strict=True)), *new])


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows: sizes partitions, never results."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))
