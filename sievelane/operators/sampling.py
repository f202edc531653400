"""Deterministic sampling: every draw is a hash of keys and a seed, so partitions and retries change nothing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_number
from ..sources.shared import counted_broadcast, staged


#: Bits of a hash that one pass tells apart; their counts come to the driver.
PASS_BITS = 12


def _last_hash(hashes: DataFrame, n: int) -> tuple[int, int]:
    """(h, k): the n-th smallest of the one column of hashes below 2^32, and how many rows of this very hash belong to the first n.

    Each pass counts the rows by the next bits of their hash, among those that agree with the n-th in the bits before.
    """
    low, width, before = 0, 32, 0
    while width:
        bits = min(PASS_BITS, width)
        width -= bits
        part = F.shiftright(F.col("_h") - F.lit(low), width)
        inside = hashes.filter(F.col("_h").between(low, low + (1 << (width + bits)) - 1))
        counts = {r["part"]: r["n"] for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # 2^PASS_BITS rows at most
        for i in sorted(counts):
            if before + counts[i] >= n:
                low += i << width
                break
            before += counts[i]
    return low, n - before


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows of ``df`` that come first in the order of a hash of ``key`` (all, if fewer; rows of equal hash by key).

    The hash of the n-th row is found by counting, and the rows up to it are filtered, so however large ``n`` is no task sorts
    them and they stand in the order of ``df``. ``key`` must tell rows apart.
    """
    rows = df.withColumn("_h", hash_number(F.col(key), F.lit(seed)))
    hashes = staged(rows.select("_h"))
    if n <= 0 or hashes.count() <= n:
        return df if n > 0 else df.limit(0)
    last, ties = _last_hash(hashes, n)
    if hashes.filter(F.col("_h") == last).limit(ties + 1).count() <= ties:
        return rows.filter(F.col("_h") <= last).drop("_h")
    # rows of one hash of 32 bits: a few
    edge = rows.filter(F.col("_h") == last).orderBy(key).limit(ties)
    return rows.filter(F.col("_h") < last).unionByName(edge).drop("_h")


def keep_share(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """A subsample of floor(share * rows) rows, in the order in which they stand."""
    return sample_rows(df, math.floor(share * df.count()), key, seed)


def sample_per_group(df: DataFrame, by: list[str], key: str, n: Column | int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group without replacement; ``n`` may be a column."""
    w = Window.partitionBy(*by).orderBy(hash_number(*[F.col(c) for c in by], F.col(key), F.lit(seed)), key)
    limit = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_number(F.col(key), F.lit(seed)), key)


def shuffled_places(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``place``: where each row stands once it is shuffled, from 0."""
    from .windows import global_rank

    return global_rank(df.withColumn("_h", hash_number(F.col(key), F.lit(seed))), "_h", key, "place").drop("_h", "n")


def hash_half(key: Column, seed: int = 42) -> Column:
    """0 or 1: the side of a key in a split into two halves."""
    return (hash_number(key, F.lit(seed)) % 2).cast("int")


def hash_fold(key: Column, folds: int = 5, seed: int = 42) -> Column:
    return (hash_number(key, F.lit(seed)) % folds).cast("int")


def crc32_fold(key: Column, folds: int = 5) -> Column:
    return (F.crc32(key.cast("string")) % folds).cast("int")


def round_robin_folds(terms: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold): terms in hash order take folds in turn; numbered in buckets, so no task gets all of them."""
    from .windows import global_rank

    hashed = terms.select(key).distinct().withColumn("_h", hash_number(F.col(key), F.lit(seed)))
    return global_rank(hashed, "_h", key, "_r").select(key, (F.col("_r") % folds).cast("int").alias("fold"))


def fold_segments(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, past, order): how equal groups, numbered from 0, go to folds: group i of a segment to ``order[(i - first) % len(order)]``.

    ``sizes``: (size, how many groups), largest first. Each group goes to the lightest fold, of equally light ones the first. Groups
    of one size go round the folds that are less than a group heavier than the lightest, until another fold becomes one of them; so
    a size takes at most one segment for each fold, however many groups it has.
    """
    load, out = [0] * folds, []
    for size, many in sizes:
        at = 0
        while at < many:
            low = min(load)
            order = sorted((f for f in range(folds) if load[f] < low + size), key=lambda f: (load[f], f))
            rest = [f for f in range(folds) if f not in order]
            rounds = min([(load[f] - low) // size for f in rest], default=many)
            past = min(many, at + max(1, rounds) * len(order))
            out.append((size, at, past, order))
            full, more = divmod(past - at, len(order))
            for i, f in enumerate(order):
                load[f] += size * (full + (i < more))
            at = past
    return out


def balanced_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """(key, fold): groups go, from the largest on, of equal ones by key, to the lightest fold, of equally light ones the first.

    Only how many groups there are of each size comes to the driver; the groups of a size are numbered in Spark and find their fold by
    their number. Sizes add up to the rows, so N rows have fewer than sqrt(2 N) different ones.
    """
    from .windows import global_rank

    groups = staged(df.groupBy(key).agg(F.count("*").alias("n")))
    sizes = sorted(((r["n"], r["many"]) for r in groups.groupBy("n").agg(F.count("*").alias("many")).collect()), reverse=True)
    segments = df.sparkSession.createDataFrame(fold_segments(sizes, folds), "_size long, _first long, _past long, _order array<int>")
    ranked = global_rank(groups.withColumnRenamed("n", "_n"), "_n", key, "_i", by=["_n"])
    inside = (F.col("_n") == F.col("_size")) & (F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_past"))
    found = ranked.join(counted_broadcast(segments), inside)
    return found.select(key, F.get("_order", ((F.col("_i") - F.col("_first")) % F.size("_order")).cast("int")).alias("fold"))


def random_negatives(positives: DataFrame, items: DataFrame, per_positive: int = 1, seed: int = 42, taken: DataFrame | None = None) -> DataFrame:
    """(term_id, item_id): per term with P positives, per_positive * P distinct items that aren't positive (nor in ``taken``), or all
    there are.

    Items are numbered in hash order; each term reads a run of these numbers from a place of its own, as long as what it needs and
    what it may not have together, so the run holds enough: no term ever meets all items.
    """
    from .windows import global_rank

    numbered = global_rank(items.select("item_id").distinct().withColumn("_h", hash_number(F.col("item_id"), F.lit(seed))), "_h", "item_id", "_i")
    need = positives.groupBy("term_id").agg((F.count("*") * per_positive).alias("need"))
    used = positives.select("term_id", "item_id")
    used = (used if taken is None else used.unionByName(taken.select("term_id", "item_id"))).distinct()
    # the number of items is one row
    total = numbered.agg(F.count("*").alias("_n")).filter("_n > 0")
    runs = need.join(used.groupBy("term_id").agg(F.count("*").alias("_used")), "term_id").join(F.broadcast(total))
    draws = runs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.col("need") + F.col("_used")) - 1)))
    draws = draws.withColumn("_i", (hash_number(F.col("term_id"), F.lit(seed)) + F.col("draw")) % F.col("_n"))
    free = draws.join(numbered.select("_i", "item_id"), "_i").join(used, ["term_id", "item_id"], "left_anti")
    w = Window.partitionBy("term_id").orderBy("draw")
    return free.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= F.col("need")).select("term_id", "item_id")


def category_negatives(positives: DataFrame, items: DataFrame, per_positive: int = 1, seed: int = 42) -> DataFrame:
    """(term_id, item_id): for each positive ``per_positive`` items of its root category, from categories in which the term has no
    positive, or all there are.

    ``items``: (item_id, root, category). A root's items are numbered category by category, in hash order within one, so a category is a
    range of numbers. What a term may have are the numbers outside its own categories' ranges; it takes them at even
    distances from a place of its own and joins them by number, so a large root is never joined whole.
    """
    from .windows import global_rank

    known = items.select("item_id", "root", "category").filter("root IS NOT NULL AND category IS NOT NULL")
    placed = global_rank(known.withColumn("_h", hash_number(F.col("item_id"), F.lit(seed))), "_h", "item_id", "_r", by=["root", "category"])
    sizes = known.groupBy("root", "category").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("lo", F.sum("size").over(Window.partitionBy("root").orderBy("category").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    numbered = placed.join(sizes, ["root", "category"]).select("root", (F.col("lo") + F.col("_r")).alias("_i"), "item_id")
    own = positives.select("term_id", "item_id").join(known, "item_id")
    need = own.groupBy("term_id", "root").agg((F.count("*") * per_positive).alias("need"))
    ranges = own.select("term_id", "root", "category").distinct().join(sizes, ["root", "category"]).groupBy("term_id", "root")
    ranges = ranges.agg(F.sort_array(F.collect_list(F.struct("lo", "size"))).alias("own"), F.sum("size").alias("closed"))
    runs = need.join(ranges, ["term_id", "root"]).join(sizes.groupBy("root").agg(F.sum("size").alias("_n")), "root")
    runs = runs.withColumn("free", F.col("_n") - F.col("closed")).withColumn("k", F.least("need", "free")).filter("k > 0")
    runs = runs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    place = (hash_number(F.col("term_id"), F.col("root"), F.lit(seed)) + F.col("draw") * F.floor(F.col("free") / F.col("k"))) % F.col("free")
    runs = runs.withColumn("_i", F.aggregate("own", place, lambda i, r: i + F.when(r["lo"] <= i, r["size"]).otherwise(F.lit(0).cast("bigint"))))
    return runs.join(numbered, ["root", "_i"]).select("term_id", "item_id")


def tiered_negatives(positives: DataFrame, items: DataFrame, lexical: DataFrame, seed: int = 42) -> DataFrame:
    """(term_id, item_id, label, sample_type): the positives and, for each of a term's P, one negative of each of three tiers.

    Tiers: ``lexical`` candidates (term_id, item_id, rank) by rank, category-constrained, and random ones. Tiers take turns in this order: what an
    earlier tier took is closed to later ones, and a tier that comes short is made up from random draws under its own name.
    """
    need = positives.groupBy("term_id").agg(F.count("*").alias("P"))
    free = lexical.join(positives.select("term_id", "item_id"), ["term_id", "item_id"], "left_anti").join(need, "term_id")
    w = Window.partitionBy("term_id").orderBy("rank", "item_id")
    hard = free.withColumn("_k", F.row_number().over(w)).filter("_k <= P").select("term_id", "item_id", F.lit(1).alias("_t"))
    category = category_negatives(positives, items, 2, seed=seed).withColumn("_t", F.lit(2))
    # enough random draws to fill all three tiers
    random = random_negatives(positives, items, 5, seed=seed).withColumn("_t", F.lit(3))
    pool = hard.unionByName(category).unionByName(random).groupBy("term_id", "item_id").agg(F.min("_t").alias("_t")).join(need, "term_id")
    place = F.row_number().over(Window.partitionBy("term_id", "_t").orderBy(hash_number(F.col("term_id"), F.col("item_id"), F.lit(seed)), "item_id"))
    pool = pool.withColumn("_k", place).filter("_t = 3 OR _k <= P")
    count = lambda t: F.sum(F.when(F.col("_t") == t, 1).otherwise(0)).over(Window.partitionBy("term_id"))
    pool = pool.withColumns({"_short1": F.col("P") - count(1), "_short2": F.col("P") - count(2)})
    name = F.when(F.col("_t") == 1, "lexical_hard").when(F.col("_t") == 2, "category_aware").when(F.col("_k") <= F.col("P"), "random")
    name = name.when(F.col("_k") <= F.col("P") + F.col("_short1"), "lexical_hard").when(F.col("_k") <= F.col("P") + F.col("_short1") + F.col("_short2"), "category_aware")
    negatives = pool.withColumn("sample_type", name).filter("sample_type IS NOT NULL").select("term_id", "item_id", F.lit(0).alias("label"), "sample_type")
    return positives.select("term_id", "item_id", F.lit(1).alias("label"), F.lit("positive").alias("sample_type")).unionByName(negatives)


def hard_and_random(positives: DataFrame, items: DataFrame, ranked: DataFrame, hard: int, rand: int, pool: Callable[[DataFrame], DataFrame] | None = None, seed: int = 42) -> DataFrame:
    """(term_id, item_id, label): positives, up to hard * P sampled from the ranked candidates, rand * P random ones.

    ``pool`` narrows the candidates (a rank band, a cut of false negatives, a model's score) before positives are taken out.
    """
    positives = staged(positives.select("term_id", "item_id"))
    cand = (pool(ranked) if pool else ranked).select("term_id", "item_id").join(own_positives(positives), "term_id")
    cand = cand.filter(~F.array_contains("own", F.col("item_id"))).drop("own")
    return with_random(positives, items, sample_per_group(cand, ["term_id"], "item_id", F.col("P") * hard, seed), rand, seed)


def own_positives(positives: DataFrame) -> DataFrame:
    """(term_id, P, own): each term's positives together."""
    return positives.groupBy("term_id").agg(F.count("*").alias("P"), F.collect_list("item_id").alias("own"))


def with_random(positives: DataFrame, items: DataFrame, mined: DataFrame, rand: int, seed: int = 42) -> DataFrame:
    """(term_id, item_id, label): positives, the ``mined`` negatives and rand * P random ones."""
    mined = staged(mined.select("term_id", "item_id"))
    other = random_negatives(positives, items, rand, seed=seed, taken=mined)
    zero = mined.unionByName(other).withColumn("label", F.lit(0))
    return positives.select("term_id", "item_id", F.lit(1).alias("label")).unionByName(zero)


#: How far a first pass over shared lists looks: so many standard deviations beyond what it expects to need, and so many candidates more.
AHEAD, MORE = 4.0, 4.0


def sample_lists(terms: DataFrame, lists: DataFrame, positives: DataFrame, hard: int, seed: int = 42) -> DataFrame:
    """(term_id, item_id): as ``hard_and_random`` mines, for candidates that many terms share: ``terms`` (term_id, rep), each once, and ``lists`` (rep, items).

    What comes first in hash order has small hashes, so a first pass lets only those under a bound of the term's own pass on from a list. Terms that got too few so are
    looked at again without a bound.
    """
    asked = staged(terms.join(own_positives(positives), "term_id"))
    lists = staged(lists)
    mark = F.substring(F.md5(F.concat_ws("|", F.col("term_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed)))), 1, 8)

    def drawn(some: DataFrame, bound: bool) -> DataFrame:
        need = F.col("P") * hard
        share = (need + AHEAD * F.sqrt(need) + MORE + F.size("own")) / F.size("items")
        high = F.when(share < 1, F.lower(F.lpad(F.hex(F.floor(share * float(2**32)).cast("bigint")), 8, "0"))).otherwise("g") if bound else F.lit("g")
        met = some.join(lists, "rep").select("term_id", "P", "own", high.alias("_high"), F.explode("items").alias("item_id"))
        # hexadecimal digits compare as their numbers do
        return met.filter(mark < F.col("_high")).filter(~F.array_contains("own", F.col("item_id"))).select("term_id", "P", "item_id")

    first = staged(sample_per_group(drawn(asked, True), ["term_id"], "item_id", F.col("P") * hard, seed).select("term_id", "item_id"))
    got = first.groupBy("term_id").agg(F.count("*").alias("_got"))
    short = staged(asked.join(got, "term_id", "left").filter(F.coalesce("_got", F.lit(0)) < F.col("P") * hard).drop("_got"))
    again = sample_per_group(drawn(short, False), ["term_id"], "item_id", F.col("P") * hard, seed).select("term_id", "item_id")
    return first.join(short.select("term_id"), "term_id", "left_anti").unionByName(again)


def mined_negatives(ranked: DataFrame, positives: DataFrame, items: DataFrame, hard: int = 5, rand: int = 2, first: int = 80, share: float = 0.95, seed: int = 42) -> DataFrame:
    """Negatives by dense retrieval: of each term's ``ranked`` candidates (term_id, item_id, score) those that aren't likely false
    negatives, the ``first`` of them by score, ``hard`` sampled for each positive, and ``rand`` random ones."""
    from .retrieval import drop_false_negatives
    from .windows import top_k

    def pool(r: DataFrame) -> DataFrame:
        return top_k(drop_false_negatives(r, positives, "term_id", "item_id", share), ["term_id"], [F.desc("score"), F.asc("item_id")], first)

    return hard_and_random(positives, items, ranked, hard, rand, pool, seed)


def remined_negatives(ranked: DataFrame, positives: DataFrame, items: DataFrame, score: str = "p", low: float = 0.0, high: float = 0.5, hard: int = 6, rand: int = 1, seed: int = 42, below: float | None = None) -> DataFrame:
    """Negatives re-mined with a model: candidates that it scores above ``high`` are likely positives and those at ``low`` or below too
    easy; ``hard`` of the rest for each positive, and ``rand`` random ones. ``below``: instead, all that it scores below this, the clean ones, are candidates. Those without a score are
    left out."""
    if below is not None:
        return hard_and_random(positives, items, ranked, hard, rand, lambda r: r.filter(F.col(score) < below), seed)
    return hard_and_random(positives, items, ranked, hard, rand, lambda r: r.filter((F.col(score) > low) & (F.col(score) <= high)), seed)


def surrogate_ids(df: DataFrame, keys: list[str], prefix: str = "TRN_SAMPLED_", seed: int = 42) -> DataFrame:
    """``df`` with ``id``: the prefix and seven digits, numbered from 0 in the hash order of ``keys``, which must tell rows apart."""
    from .windows import global_rank

    keyed = df.withColumn("_k", F.concat_ws("|", *keys)).withColumn("_h", hash_number(F.col("_k"), F.lit(seed)))
    return global_rank(keyed, "_h", "_k", "_r").withColumn("id", F.concat(F.lit(prefix), F.lpad(F.col("_r").cast("string"), 7, "0"))).drop("_k", "_h", "_r", "n")


def tier_counts(training: DataFrame) -> DataFrame:
    """(sample_type, n, n_terms): how many rows each tier gave, and for how many terms."""
    return training.groupBy("sample_type").agg(F.count("*").alias("n"), F.count_distinct("term_id").alias("n_terms"))


def random_pairs(left: DataFrame, right: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` pairings of queries with items, both in hash order, each used once."""
    a = sample_rows(left.select("term_id").distinct(), n, "term_id", seed)
    b = sample_rows(right.select("item_id").distinct(), n, "item_id", seed + 1)
    number = lambda df, k: df.withColumn("_n", F.row_number().over(Window.orderBy(hash_number(F.col(k), F.lit(seed)), k)))
    # n rows a side by construction
    return number(a, "term_id").join(number(b, "item_id"), "_n").drop("_n")


def exam_set(positives: DataFrame, terms: DataFrame, items: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """(id, term_id, item_id, truth): n known positives and n random pairs that aren't, under ids that tell nothing."""
    good = sample_rows(positives.select("term_id", "item_id", F.concat_ws("|", "term_id", "item_id").alias("_k")), n, "_k", seed).select("term_id", "item_id", F.lit(1).alias("truth"))
    bad = random_pairs(terms, items, n, seed).join(positives.select("term_id", "item_id"), ["term_id", "item_id"], "left_anti").withColumn("truth", F.lit(0))
    both = good.unionByName(bad)
    order = Window.orderBy(hash_number(F.col("term_id"), F.col("item_id"), F.lit(seed)), "term_id", "item_id")
    return both.withColumn("id", F.format_string("EXM_%05d", F.row_number().over(order))).select("id", "term_id", "item_id", "truth")
