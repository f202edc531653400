"""Sharding by size-tiered compaction under a versioned manifest.

Native: DataFrame functions only.

Layout under ``root``: each write has a folder of its own, ``data/<attempt>/part=S/``, whose files are never changed;
``manifest/vNNNNNNNNNN`` lists the live shards of a version with the paths of their files, and its schema is that of the rows.
A version is written aside and renamed into place; it fails if another writer took the number, so a version is never
overwritten. An append that lost such a race commits its shards on top of the winner's; a compaction that lost is given up.
Readers take the highest number and open the files that it lists, nothing else. What a failed job or a writer
that gave up has left is listed nowhere, so a second attempt adds nothing twice; ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Plain, bounded, drop_path

#: Slices from which an arrival is shuffled by slice, so that not every task writes a file for each.
SPREAD = 8
#: Races that an append may lose before it gives up.
TRIES = 20
#: Columns of the store's own in the files; a column of the rows called so, but for leading underscores, gets one underscore more.
_OWN = re.compile(r"_+(shard|arrival|slice|size|part)", re.IGNORECASE)


def hash_share(key: Column) -> Column:
    """Of a key, a number in [0, 1) that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") / F.lit(2**32)


def plan_compaction(shards: DataFrame, target_bytes: int, fanout: int = 4, tiers: int = 3, range_size: int = 4096) -> DataFrame:
    """(arrival, slice, bytes, rows) to the same rows with ``into_arrival``, ``into_slice``: the shard that each ends up in.

    A shard of less than target / fanout^(tiers - t) bytes is of tier t; shards of target / fanout or
    more are settled. From the lowest tier up, each ``fanout`` neighbours of a tier merge into one under
    the name of the first, so a merged shard never exceeds the target. Groups that aren't full wait for
    more arrivals. Neighbours are looked for within ``range_size`` arrivals, which bounds every sort.
    """
    bounds = [target_bytes // fanout ** (tiers - t) for t in range(tiers)]
    # shards of one range carry (into_arrival, into_slice) and the size of what they are merged in so far
    state = shards.withColumns({"_range": F.floor(F.col("arrival") / range_size), "into_arrival": F.col("arrival"), "into_slice": F.col("slice")})
    for t, bound in enumerate(bounds):
        runs = state.groupBy("_range", "into_arrival", "into_slice").agg(F.sum("bytes").alias("_run"))
        low = bounds[t - 1] if t else 0
        tier = runs.filter((F.col("_run") < bound) & (F.col("_run") >= low))
        group = F.floor((F.row_number().over(Window.partitionBy("_range").orderBy("into_arrival", "into_slice")) - 1) / fanout)
        tier = tier.withColumn("_group", group)
        whole = Window.partitionBy("_range", "_group")
        first = F.min(F.struct("into_arrival", "into_slice")).over(whole)
        merged = tier.withColumns({"_n": F.count("*").over(whole), "_first": first}).filter(F.col("_n") == fanout)
        names = merged.select("_range", "into_arrival", "into_slice", F.col("_first.into_arrival").alias("_a"), F.col("_first.into_slice").alias("_s"))
        state = state.join(names, ["_range", "into_arrival", "into_slice"], "left")
        state = state.withColumns({"into_arrival": F.coalesce("_a", "into_arrival"), "into_slice": F.coalesce("_s", "into_slice")}).drop("_a", "_s")
    return state.drop("_range")


class Conflict(RuntimeError):
    """Another writer committed the version."""


class ShardStore:
    """Append, compact and read the shards under ``root``.

    ``id_col`` deals the rows of a large arrival to slices; ``text_col`` gives the size of a row (null: 0; a text of any length is
    one row of one shard). Columns may have any name; appends may differ in columns, a missing one is null. Tables
    without rows make a version without new shards. Repeated rows stay.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id", text_col: str = "text", small_bytes: int = 4 << 20, target_bytes: int = 128 << 20):
        self.spark, self.root, self.id_col, self.text_col = spark, root.rstrip("/"), id_col, text_col
        self.small_bytes, self.target_bytes = small_bytes, target_bytes

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The highest committed version, 0 if there is none."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version (the highest): gen, attempt, shard, arrival, slice, rows, bytes, files (paths below data)."""
        return self.spark.read.parquet(f"{self.root}/manifest/v{version or self.version():010d}")

    def _schema(self, manifest: DataFrame) -> T.StructType:
        return T.StructType.fromJson(json.loads(manifest.schema["files"].metadata["rows"]))

    def commit(self, entries: DataFrame, version: int, schema: T.StructType | None = None) -> None:
        """Make ``entries`` the manifest of ``version``, for rows of ``schema`` (that of the entries)."""
        schema = self._schema(entries) if schema is None else schema
        _, aside = self._aside(entries.withColumn("files", F.col("files").alias("files", metadata={"rows": schema.json()})))
        fs, src = self._fs(aside)
        _, dst = self._fs(f"{self.root}/manifest/v{version:010d}")
        taken = fs.exists(dst) or not fs.rename(src, dst)
        _, below = self._fs(f"{self.root}/manifest/v{version:010d}/{src.getName()}")
        if not taken and fs.exists(below):  # where rename() moves into a folder that came up meanwhile
            fs.delete(below, True)
            taken = True
        if taken:
            fs.delete(src, True)
            raise Conflict(f"manifest version {version} was committed by another writer")

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write rows with _shard, _arrival, _slice, _size under a folder of their own: its name, and its shards."""
        attempt = uuid.uuid4().hex
        folder = f"{self.root}/data/{attempt}"
        rows.withColumn("_part", F.col("_shard")).write.option("compression", "zstd").partitionBy("_part").parquet(folder)
        fs, p = self._fs(folder)
        names = ["attempt string", "shard string", "arrival bigint", "slice bigint", "rows bigint", "bytes bigint", "files array<string>"]
        if not any(s.isDirectory() for s in fs.listStatus(p)):  # no row
            return attempt, self.spark.range(0).select(*[F.lit(None).cast(n.split()[1]).alias(n.split()[0]) for n in names])
        own = T.StructType([T.StructField("_shard", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("_arrival", "_slice", "_size"))])
        written = self.spark.read.schema(own).option("recursiveFileLookup", "true").parquet(folder)
        file = F.concat(F.lit(f"{attempt}/"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1))
        shards = written.groupBy(F.col("_shard").alias("shard"), F.col("_arrival").alias("arrival"), F.col("_slice").alias("slice"))
        shards = shards.agg(F.count("*").alias("rows"), F.sum("_size").cast("bigint").alias("bytes"), F.sort_array(F.collect_set(file)).alias("files"))
        return attempt, shards.select(F.lit(attempt).alias("attempt"), "shard", "arrival", "slice", "rows", "bytes", "files")

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Write each arrival (a whole number; null counts as -1) as small shards and commit; the version.

        Rows aren't shuffled, but for arrivals of more than SPREAD slices; an arrival of more than ``small_bytes`` is dealt to
        slices by a hash of the id."""
        schema = rows.schema
        size = F.coalesce(F.octet_length(rows[self.text_col]), F.lit(0)).cast("bigint")
        own = [F.coalesce(arrival.cast("bigint"), F.lit(-1)).alias("_arrival"), size.alias("_size"), hash_share(rows[self.id_col]).alias("_share")]
        rows = rows.select(*[rows[f"`{c.replace('`', '``')}`"].alias(f"_{c}" if _OWN.fullmatch(c) or c.lower() == "_share" else c) for c in rows.columns], *own)
        slices = rows.groupBy("_arrival").agg(F.greatest(F.lit(1), F.ceil(F.sum("_size") / self.small_bytes)).cast("bigint").alias("_slices"))
        slices, path = self._aside(slices)
        rows = rows.join(bounded(slices, 16), "_arrival").withColumn("_slice", F.floor(F.col("_share") * F.col("_slices")))
        rows = rows.withColumn("_shard", F.concat_ws("-", "_arrival", "_slice")).drop("_share")
        if slices.filter(F.col("_slices") > SPREAD).limit(1).count():
            rows = rows.filter(F.col("_slices") <= SPREAD).unionByName(rows.filter(F.col("_slices") > SPREAD).repartition("_shard"))
        _, entries = self._write(rows.drop("_slices"))
        for _ in range(TRIES):
            before = self.version()
            new, columns = entries.withColumn("gen", F.lit(before + 1)), schema
            if before:
                live = self.manifest(before)
                columns = self._schema(live)
                known = {f.name: f for f in columns.fields}
                if other := [f.name for f in schema.fields if f.name in known and known[f.name].dataType != f.dataType]:
                    raise ValueError(f"columns {other} have another type than in version {before}")
                columns = T.StructType([*columns.fields, *(f for f in schema.fields if f.name not in known)])
                new = live.unionByName(new)
            try:
                self.commit(new, before + 1, columns)
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{TRIES} versions were committed by other writers meanwhile")
        drop_path(self.spark, path)
        return before + 1

    def _aside(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _open(self, shards: DataFrame, schema: T.StructType) -> DataFrame:
        """The rows of shards as they are in the files, with _attempt. The driver gets the paths of the files that are read, as it does
        from Spark's own listing of a folder."""
        files = [f"{self.root}/data/{r[0]}" for r in shards.select(F.explode("files")).collect()]
        stored = [T.StructField(f"_{f.name}" if _OWN.fullmatch(f.name) or f.name.lower() == "_share" else f.name, f.dataType) for f in schema.fields]
        own = [T.StructField("_shard", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("_arrival", "_slice", "_size"))]
        whole = T.StructType([*stored, *own])
        if not files:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in whole.fields], F.lit(None).cast("string").alias("_attempt"))
        rows = self.spark.read.schema(whole).parquet(*files)
        return rows.withColumn("_attempt", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+/[^/]+$", 1))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with gen, shard, shard_rows and shard_bytes of their shard; a column of the rows with such a
        name comes out with ``_in`` behind it."""
        live = self.manifest(version)
        schema = self._schema(live)
        new = ["gen", "shard", "shard_rows", "shard_bytes"]
        rows = self._open(live, schema)
        plain = Plain(self.spark.range(0).select(*[F.lit(0).alias(c) for c in schema.names]), schema.names, new)
        named = [rows[f"`{c.replace('`', '``')}`"].alias(out) for c, out in zip(rows.columns[: len(schema.names)], plain.out, strict=True)]
        side = live.select(F.col("attempt").alias("_a"), F.col("shard").alias("_s"), F.col("gen").alias("_g"), F.col("rows").alias("_r"), F.col("bytes").alias("_b"))
        joined = rows.join(bounded(side, 96), (rows["_attempt"] == side["_a"]) & (rows["_shard"] == side["_s"]))
        return joined.select(*named, side["_g"].alias("gen"), side["_s"].alias("shard"), side["_r"].alias("shard_rows"), side["_b"].alias("shard_bytes"))

    def compact(self, fanout: int = 4, tiers: int = 3) -> int:
        """Merge by ``plan_compaction`` and commit; shards that don't merge stay as they are."""
        before = self.version()
        gen = before + 1
        live = self.manifest(before)
        schema = self._schema(live)
        plan = plan_compaction(live, self.target_bytes, fanout, tiers)
        runs = Window.partitionBy("into_arrival", "into_slice")
        plan = plan.withColumns({"_parts": F.count("*").over(runs), "_bytes": F.sum("bytes").over(runs)})
        plan, path = self._aside(plan)
        moved = plan.filter("_parts > 1")
        count, total = moved.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        new = plan.filter("_parts = 1").select(*live.columns)
        if count:  # shards of null and empty texts have rows but no bytes
            into = moved.select(F.col("arrival").alias("_arrival"), F.col("slice").alias("_slice"), "into_arrival", "into_slice").distinct()
            rows = self._open(moved, schema).drop("_attempt", "_shard").join(bounded(into, 32), ["_arrival", "_slice"])
            rows = rows.withColumns({"_arrival": F.col("into_arrival"), "_slice": F.col("into_slice"), "_shard": F.concat_ws("-", "into_arrival", "into_slice")}).drop("into_arrival", "into_slice")
            _, merged = self._write(rows.repartition(max(1, -(-total // self.target_bytes) * 2), "_shard"))
            new = new.unionByName(merged.withColumn("gen", F.lit(gen)))
        self.commit(new, gen, schema)
        drop_path(self.spark, path)
        return gen

    def vacuum(self, versions: int = 1, older_than_s: float = 86_400.0) -> int:
        """Forget all but the last ``versions`` versions and delete the folders of writes that none of them lists, if they are
        older than ``older_than_s`` (a younger one may belong to a writer at work); how many folders went."""
        kept = self._versions()[-versions:]
        for v in self._versions()[:-versions]:
            drop_path(self.spark, f"{self.root}/manifest/v{v:010d}")
        live = {r[0] for v in kept for r in self.manifest(v).select("attempt").distinct().collect()}  # one per write
        fs, p = self._fs(f"{self.root}/data")
        now = self.spark._jvm.System.currentTimeMillis()
        dead = [s for s in fs.listStatus(p) if s.getPath().getName() not in live and now - s.getModificationTime() >= older_than_s * 1000] if fs.exists(p) else []
        for s in dead:
            fs.delete(s.getPath(), True)
        return len(dead)
