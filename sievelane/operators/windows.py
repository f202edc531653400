"""Rankings and scalings within a term and over everything."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import counted_broadcast, staged


def percent_rank_averaged(value: str, by: str, descending: bool = False) -> Column:
    """Rank in the group over its size, ties at their average rank."""
    order = F.desc(value) if descending else F.asc(value)
    ranked, tied, group = Window.partitionBy(by).orderBy(order), Window.partitionBy(by, value), Window.partitionBy(by)
    return (F.rank().over(ranked) + (F.count("*").over(tied) - 1) / F.lit(2.0)) / F.count("*").over(group)


def top_fraction(value: str, by: str, fraction: float) -> Column:
    """1 for the rows of a group whose descending percent rank is at most ``fraction``."""
    return (percent_rank_averaged(value, by, True) <= fraction).cast("int")


def zscore(value: str, by: str) -> Column:
    """(x - mean) / (sample deviation + 1e-6); null in a group of one row."""
    w = Window.partitionBy(by)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + F.lit(1e-6))


def group_size(by: str) -> Column:
    return F.count("*").over(Window.partitionBy(by))


#: The rows of one partition are numbered below this.
_ROWS = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` as a table with ``_p``, the number of a range of ``order``, and ``_r``, a row's place in it, both from 0.

    Spark cuts the ranges by the real values, whatever their type, so ties of the first column are cut by the next one. The table is
    written, since another run would draw other cuts.
    """
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = staged(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumns({"_p": F.shiftright("_at", 33), "_r": F.col("_at").bitwiseAND(F.lit(_ROWS))}).drop("_at")


def _offsets(placed: DataFrame, by: list[str], size: Column) -> DataFrame:
    """(_b0, _b1, ..., _o, _first, _before, n): of each group and range the place of its first row, the sum of ``size`` in the ranges before, and over all."""
    names = [f"_b{i}" for i in range(len(by))]
    sizes = placed.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col("_p").alias("_o")).agg(size.alias("_size"), F.min("_r").alias("_first"))
    whole = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted_broadcast(sizes.select(*names, "_o", "_first", before.alias("_before"), F.sum("_size").over(whole).alias("n")))


def _with_offsets(placed: DataFrame, by: list[str], size: Column) -> DataFrame:
    same = reduce(lambda a, x: a & F.col(x[1]).eqNullSafe(F.col(f"_b{x[0]}")), enumerate(by), F.col("_p") == F.col("_o"))
    return placed.join(_offsets(placed, by, size), same).drop("_o", *[f"_b{i}" for i in range(len(by))])


def global_rank(df: DataFrame, value: str, key: str, out: str = "rank", by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` with the row number (from 0) by (value, key), overall or within ``by``, and ``n``, the number of rows.

    No task gets all rows: they are dealt to ranges of (by, value, key), as many as there are shuffle partitions or ``buckets``, numbered within
    theirs, and the counted sizes of the ranges before are added. Nulls stand first.
    """
    by = by or []
    placed = _ranged(df, list(dict.fromkeys([*by, value, key])), buckets)
    ranked = _with_offsets(placed, by, F.count("*"))
    return ranked.withColumn(out, F.col("_before") + F.col("_r") - F.col("_first")).select(*df.columns, "n", out)


def value_positions(df: DataFrame, value: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(by, value, before, times, n): of each distinct value, how many rows are smaller, how many have it, and how many there are.

    Equal values are summed before they are shuffled, so ties cost nothing; null values are left out."""
    by = by or []
    each = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    placed = _with_offsets(_ranged(each, [*by, value], buckets), by, F.sum("times"))
    own = F.sum("times").over(Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
    return placed.withColumn("before", F.col("_before") + own).select(*by, value, "before", "times", "n")


#: Values that are sampled to choose cuts, cuts, and values that may be brought to the driver.
SAMPLE, CUTS, FETCHED = 20_000, 2_048, 50_000


def order_statistics(values: DataFrame, places: list[int]) -> dict[int, float]:
    """The values at ``places`` (from 0) in ascending order of the one double column of ``values``, which holds no nulls.

    Cuts from a sample part the values; the values of each part are counted, and only the parts that hold a place are looked at
    again, until they are few. The sample decides how much work it is, not what comes out.
    """
    values = staged(values.toDF("_v"))
    found: dict[int, float] = {}
    wanted, kept, size = {p: p for p in places}, lambda v: np.ones(len(v), bool), values.count()  # place: place among the values kept
    for _ in range(100):
        if not wanted:
            return found
        drawn = [x for t in values.sample(min(1.0, SAMPLE / max(1, size)), 42).mapInArrow(_kept_values(kept), "_v double").limit(4 * SAMPLE).toLocalIterator() for x in t]
        drawn = np.sort(np.array(drawn))
        some = drawn[np.linspace(0, len(drawn) - 1, CUTS).astype(int)] if len(drawn) else np.zeros(0)
        cuts, times = np.unique(some, return_counts=True)
        # what is drawn several times gets a part of its own
        cuts = np.unique(np.concatenate([cuts, np.nextafter(cuts[times > 1], np.inf)]))
        counts = np.zeros(len(cuts) + 1, np.int64)
        for r in values.mapInArrow(_part_counts(kept, cuts), "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():  # a row for each part
            counts[r["part"]] = r["n"]
        ends = np.cumsum(counts)
        part = {p: int(np.searchsorted(ends, at, "right")) for p, at in wanted.items()}
        for p, i in part.items():
            if i and (cuts[i - 1] == np.inf or (i < len(cuts) and np.nextafter(cuts[i - 1], np.inf) == cuts[i])):
                found[p] = float(cuts[i - 1])
        left = sorted({i for p, i in part.items() if p not in found})
        before = dict(zip(left, np.concatenate([[0], np.cumsum(counts[left])[:-1]]).tolist() if left else [], strict=True))
        wanted = {p: wanted[p] - int(ends[part[p]] - counts[part[p]]) + before[part[p]] for p in wanted if p not in found}
        kept, size = _in_parts(kept, cuts, left), int(counts[left].sum())
        if wanted and size <= FETCHED:
            rest = sorted(r[0] for r in values.mapInArrow(_kept_values(kept), "_v double").collect())
            return found | {p: rest[at] for p, at in wanted.items()}
    raise ArithmeticError("the parts don't get smaller")


def _in_parts(kept, cuts: np.ndarray, parts: list[int]):
    inside = np.zeros(len(cuts) + 1, bool)
    inside[parts] = True
    return lambda v: kept(v) & inside[np.searchsorted(cuts, v, "right")]


def _kept_values(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(v[kept(v)])], names=["_v"])

    return run


def _part_counts(kept, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            total += np.bincount(np.searchsorted(cuts, v[kept(v)], "right"), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["part", "n"])

    return run


def rank_normalised(df: DataFrame, value: str, key: str, out: str = "rank_norm") -> DataFrame:
    """The global rank scaled to [0, 1]; 0 for a single row."""
    ranked = global_rank(df, value, key, "_rank")
    return ranked.withColumn(out, F.coalesce(F.try_divide(F.col("_rank").cast("double"), F.col("n") - 1), F.lit(0.0))).drop("_rank", "n")


def tails(df: DataFrame, value: str, key: str, top: float = 0.12, bottom: float = 0.25) -> DataFrame:
    """Pseudo-labels: the highest floor(top * n) rows 1, the lowest floor(bottom * n) rows 0; the others go."""
    ranked = global_rank(df, value, key, "_rank")
    low, high = F.floor(F.lit(bottom) * F.col("n")), F.col("n") - F.floor(F.lit(top) * F.col("n"))
    label = F.when(F.col("_rank") >= high, 1).when(F.col("_rank") < low, 0)
    return ranked.withColumn("label", label).filter("label IS NOT NULL").drop("_rank", "n")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` + 1 to ``skip`` + k of each group; Spark keeps only those in the partial sort."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") > skip) & (F.col("rank") <= skip + k))


def rank_positions(df: DataFrame, by: list[str], order: list[Column], positions: list[int]) -> DataFrame:
    """The rows at fixed 0-based ranks of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    deepest = max(positions) + 1
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= deepest).withColumn("position", F.col("rank") - 1).filter(F.col("position").isin(positions)).drop("rank")
