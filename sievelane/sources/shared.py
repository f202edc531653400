"""The folder that driver and executors share: fresh paths in it, tables that cut lineage, broadcasts of counted sides."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast, once they were counted.
BROADCAST_ROWS = 200_000


def fresh(spark: SparkSession) -> str:
    """A path that nothing else uses, in the folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievelane-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/files-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to a fresh path and read back: computed once, whatever is lost afterwards. The owner of the folder removes it."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_broadcast(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``rows`` rows, which are counted; else as it is."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
