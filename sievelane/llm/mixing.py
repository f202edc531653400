"""Mixing sources to target weights by Pfair scheduling.

Native: DataFrame functions only.

Time is cut into slots, each holding one block of one source. With weights c_s / W (integers, W their
sum), block i (from 0) of source s is released at slot floor(i * W / c_s) and due by slot
ceil((i + 1) * W / c_s). Earliest deadline first among the released blocks keeps every source within one
block of its weight at every slot. The schedule repeats every W slots, in which source s gets exactly c_s
blocks, so one period is scheduled (an expression over W slots, W bounded by ``resolution``) and every
block then finds its slot by arithmetic. A source that has run out leaves its slots empty; the others
keep their proportions, and no row is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain, bounded, materialise

#: Rows a bucket aims at while ranks are counted; a hot source is split into as many as it needs.
BUCKET_ROWS = 4096


def integer_weights(weights: DataFrame, resolution: int = 1000) -> DataFrame:
    """(source, weight) to (source, share): integers of at least 1 that sum to about ``resolution``."""
    w = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(0.0)
    # decimals, since a sum of doubles would depend on the order in which sources are added
    total = F.sum(F.round(w, 6).cast("decimal(30,6)")).over(Window.partitionBy()).cast("double")
    scaled = weights.withColumn("total", total)
    return scaled.select("source", F.greatest(F.lit(1), F.coalesce(F.round(w * resolution / F.nullif("total", F.lit(0.0))), F.lit(0.0)).cast("int")).alias("share"))


def period(shares: DataFrame) -> DataFrame:
    """(source, share) to one period of the schedule: source, share, nth (of the source), slot, length."""
    listed = shares.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"), F.sum("share").alias("w"))
    ceil_div = lambda a, b: F.floor((a + b - 1) / b)

    def step(state: Column, t: Column) -> Column:
        def offer(done: Column, i: Column) -> Column:
            c = F.get("shares", i)
            released = F.floor(done * F.col("w") / c) <= t
            return F.when((done < c) & released, F.struct(ceil_div((done + 1) * F.col("w"), c).alias("due"), i.alias("i")))

        pick = F.array_min(F.transform(state["done"], offer))["i"]
        done = F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.concat(state["order"], F.array(pick)).alias("order"))

    listed = listed.select(F.col("s.source").alias("sources"), F.col("s.share").alias("shares"), F.col("w").cast("bigint").alias("w")).filter("w > 0")
    start = F.struct(F.transform("shares", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0), (F.col("w") - 1).cast("int")), start, step)["order"]
    slots = listed.select("sources", "shares", "w", F.posexplode(order).alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return slots.select(F.get("sources", F.col("i")).alias("source"), F.get("shares", F.col("i")).alias("share"), nth.alias("nth"), "slot", F.col("w").alias("length"))


def ranked(rows: DataFrame, group: str, key: Column, counts: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in each group by a hash of ``key``, without gathering a group in one task.

    The hash deals a group into buckets of about BUCKET_ROWS rows; a bucket's first rank is the sum of
    the counts before it, and only its own rows are sorted together.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2**32)
    spread = rows.join(bounded(counts.select(group, F.ceil(F.col("n") / BUCKET_ROWS).alias("_buckets")), 64), group).withColumns({"_digest": digest, "_bucket": F.floor(share * F.col("_buckets"))})
    sizes = spread.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    first = F.sum("_size").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_size")
    own = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_digest", key)) - 1
    return spread.join(bounded(sizes.select(group, "_bucket", first.alias("_first")), 64), [group, "_bucket"]).withColumn("rank", F.col("_first") + own).drop("_buckets", "_digest", "_bucket", "_first")


def mix(docs: DataFrame, weights: DataFrame, block_rows: int = 64, resolution: int = 1000, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` with block, slot and place: slots in order make the mix.

    ``block``: of its source, from 0, ``block_rows`` rows each (the last may be smaller), rows in the
    order of a hash of the id. ``slot``: where the block stands. ``place``: of the row in its block.
    ``weights``: (source, weight), a row for each source; sources without one, or with null, NaN or
    weights <= 0, get the smallest share. Null sources count as ''. Null ids go first by their hash; rows with equal ids are interchangeable. Other columns of ``docs`` come along; one called block, slot or place comes out with ``_in``
    behind it. Texts aren't looked at. At most ``resolution`` sources are meant: the period is bounded by
    ``resolution`` plus their number, and is scheduled in one task.
    """
    plain = Plain(docs, docs.columns, ["block", "slot", "place"])
    id_, source = plain.at(id_col), plain.at(source_col)
    rows = plain.rows.withColumn("_mix_source", F.coalesce(F.col(source), F.lit("")))
    counts = rows.groupBy("_mix_source").agg(F.count("*").alias("n"))
    named = weights.select(F.coalesce("source", F.lit("")).alias("source"), "weight").groupBy("source").agg(F.max("weight").alias("weight"))
    known = counts.select(F.col("_mix_source").alias("source")).join(named, "source", "left")
    slots = materialise(period(integer_weights(known, resolution)).withColumnRenamed("source", "_mix_source").withColumnRenamed("slot", "_slot"))
    out = ranked(rows, "_mix_source", F.col(id_), counts)
    out = out.withColumns({"block": F.floor(F.col("rank") / block_rows), "place": (F.col("rank") % block_rows).cast("int")})
    share = slots.filter("nth = 0").select("_mix_source", F.col("share").alias("_share"), F.col("length").alias("_length"))
    out = out.join(bounded(share, 96), "_mix_source").withColumn("_nth", (F.col("block") % F.col("_share")).cast("int"))
    out = out.join(bounded(slots.select("_mix_source", F.col("nth").alias("_nth"), "_slot"), 96), ["_mix_source", "_nth"])
    slot = F.floor(F.col("block") / F.col("_share")) * F.col("_length") + F.col("_slot")
    return out.select(*[F.col(c).alias(o) for c, o in zip(plain.kept, plain.out, strict=True)], "block", slot.alias("slot"), "place")


def tempered(docs: DataFrame, power: float = 0.5, source_col: str = "source") -> DataFrame:
    """Target weights in proportion to the rows of each source to ``power``."""
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    return counts.select("source", F.pow("n", F.lit(power)).alias("weight"))
