"""Sinks: submissions, tables, appends that can resume, shards of fixed size, one output per target rate."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import global_rank


def write_submission(df: DataFrame, path: str) -> None:
    df.select("id", "prediction").write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Conflict(OSError):
    """Another writer has committed meanwhile."""


class Versions:
    """A table as versions below one path: each a list of folders, named by one small file that is created once and never changed.

    ``_log/000...N`` holds the names of version N's folders, a line each. A version exists as soon as its file has content; the file is written aside, whole, and then put in
    place by an operation that fails if the name is taken: a rename that doesn't overwrite, or on stores whose rename isn't atomic a create that doesn't. So a reader sees the version before or the one after,
    a writer that stops at any step leaves the version before, and of two writers one fails and may try again. Folders that no version names are left to ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.log = _path(spark, f"{self.path}/_log")

    def _child(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.log, name)

    def latest(self) -> int:
        """The number of the last version, from 1; 0 for none."""
        if not self.fs.exists(self.log):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.log) if s.getLen() > 0]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        version = self.latest() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._child(f"{version:012d}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().split()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last one by default."""
        folders = self.folders(version)
        if not folders:
            raise FileNotFoundError(f"{self.path} has no version {version or ''}")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def write(self, df: DataFrame) -> str:
        """The name of a new folder with ``df``; no version names it yet."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, folders: list[str], after: int) -> int:
        """Make ``folders`` the version ``after`` + 1; Conflict if there is one already."""
        aside, place = self._child(f".{uuid.uuid4().hex}"), self._child(f"{after + 1:012d}")
        self.fs.mkdirs(self.log)
        if self.fs.exists(place):
            raise Conflict(f"{self.path} has a version {after + 1}")
        self._put(aside, "\n".join(folders))
        self._publish(aside, place, "\n".join(folders))
        return after + 1

    def _put(self, where, text: str) -> None:
        out = self.fs.create(where, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _publish(self, aside, place, text: str) -> None:
        if self.fs.getScheme() in ("file", "hdfs", "viewfs"):
            try:  # FileContext's rename fails if the target exists
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(place).toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(place), none)
                return
            except Py4JJavaError as e:
                if not self.fs.exists(place):
                    raise
                raise Conflict(f"{place} was committed by another writer") from e
        # an object store: the file appears with its content when it is closed
        try:
            self._put(place, text)
        except Py4JJavaError as e:
            raise Conflict(f"{place} was committed by another writer") from e

    def replace(self, df: DataFrame) -> int:
        """A version of ``df`` alone; ``df`` may read the versions before, which stay."""
        after = self.latest()
        return self.commit([self.write(df)], after)

    def append(self, df: DataFrame, key: str, tries: int = 5) -> int:
        """A version with the rows of ``df`` whose key isn't there yet; returns how many. Where another writer was first, what is new is found again, so no row is doubled."""
        for _ in range(tries):
            after = self.latest()
            folders = self.folders(after)
            new = df.join(self.read(after).select(key), key, "left_anti") if folders else df
            name = self.write(new)
            # counted from the files' footers; an Observation would leave in the session what the models' functions can't be sent with
            n = self.spark.read.schema(new.schema).parquet(f"{self.path}/{name}").count()
            if not n and folders:
                return 0
            try:
                self.commit([*folders, name], after)
                return n
            except Conflict:
                continue
        raise Conflict(f"{self.path} was changed {tries} times meanwhile")

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the last ``keep`` versions names, and the versions before. Not while others write or read older versions."""
        last = self.latest()
        named = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.folders(v)}
        for v in range(1, max(1, last - keep + 1)):
            self.fs.delete(self._child(f"{v:012d}"), False)
        for s in self.fs.listStatus(self.log.getParent()):
            if s.getPath().getName() not in named | {"_log"}:
                self.fs.delete(s.getPath(), True)


def append_new(df: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key isn't there yet; running it again appends nothing. Returns how many were new. See ``Versions``."""
    return Versions(df.sparkSession, path).append(df, key)


def replace_table(df: DataFrame, path: str) -> int:
    """``df`` as the next version of ``path``: readers see the version before or this one, and ``df`` may read the one before. Returns its number."""
    return Versions(df.sparkSession, path).replace(df)


def rebuild(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``path`` again from its first version: running it twice changes nothing more."""
    table = Versions(spark, path)
    return table.read(table.replace(change(table.read(1))))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """The table at ``path``; built and written there if it is absent, or if ``reuse`` is off."""
    table = Versions(spark, path)
    if not (reuse and table.latest()):
        table.replace(build())
    return table.read()


def narrowed(df: DataFrame, bytes_: list[str] = (), floats: list[str] = ()) -> DataFrame:
    """Columns of small whole numbers as one byte, of scores as single precision; a number that doesn't fit is an error."""
    checked = {c: F.when(F.col(c).isNull() | F.col(c).between(-128, 127), F.col(c).cast("tinyint")).otherwise(F.raise_error(F.concat(F.lit(f"{c} doesn't fit a byte: "), F.col(c).cast("string"))).cast("tinyint")) for c in bytes_}
    return df.withColumns(checked | {c: F.col(c).cast("float") for c in floats}) if bytes_ or floats else df


def shard_of(df: DataFrame, order: str, key: str, size: int = 400) -> DataFrame:
    """``df`` with ``shard``, from 1, ``size`` rows each in the given order."""
    return global_rank(df, order, key, "_r").withColumn("shard", (F.floor(F.col("_r") / size) + 1).cast("int")).drop("_r", "n")


def write_lines(df: DataFrame, line: Column, path: str, order: str, key: str, size: int = 400) -> None:
    shards = shard_of(df.withColumn("value", line), order, key, size)
    shards.select("value", "shard").repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)


def fan_out(df: DataFrame, thresholds: DataFrame, score: str) -> DataFrame:
    """(id, rate, prediction): every row decided at each target rate; a handful of rates, broadcast."""
    return df.join(F.broadcast(thresholds)).select("id", "rate", (F.col(score) >= F.col("threshold")).cast("int").alias("prediction"))
