"""URL filtering by host and path rules: a blocked Bloom filter in front of an exact hash join.

Native: DataFrame functions only.

A rule is a pair (host, path). It fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's; so every rule that can fit a url is one of the *canonical keys* of that
url: a suffix of its host at a label boundary followed by a prefix of its path. The keys are formed for
the (host length, path length) shapes that occur among the rules, probed in the Bloom filter, and only
the possible hits reach the exact join, which removes the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES

WORDS = 8  # 32-bit words of a block; each key sets one bit in each
BITS_PER_KEY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; '' if there is no ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def bloom_blocks(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // (32 * WORDS)))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bit"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row per non-empty block: ``block`` and ``w0``..``w7``."""
    masks = keys.select(_block(F.col(key), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def probe_bloom(candidates: DataFrame, key: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The candidates that may be listed; never loses one that is."""
    small = n_blocks * (8 + 4 * WORDS) * 2 <= BROADCAST_BYTES
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col(key))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    joined = candidates.withColumn("block", _block(F.col(key), n_blocks)).join(F.broadcast(bloom) if small else bloom, "block")
    return joined.filter(hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge ``pages`` (page_id, url) by ``rules`` (host, path, verdict): page_id, host, path, rule, verdict.

    The longest fitting rule (host and path together) wins, then the longer host, then ``block``.
    A url that no rule fits, a null url and one without ``://`` get a null rule and ``default``.
    One row per row of ``pages``: repeated and null page_ids stay; other columns are ignored.
    Rules with a null host are no rules; a null path counts as ''. The collected shapes are pairs of
    string lengths, so their number is bounded by the lengths of hosts and paths, not by the rules.
    """
    rules = rules.filter(F.col("host").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).withColumn("key", F.concat("rule_host", "rule_path"))
    shapes = [tuple(r) for r in rules.select(F.length("rule_host"), F.length("rule_path")).distinct().collect()]
    n_keys, n_bytes = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    pages = pages.select("page_id", "url")
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    host, path = F.col("host"), F.col("path")
    boundary = lambda n: (F.length(host) == n) | ((F.length(host) > n) & (F.substr(host, F.length(host) - n, F.lit(1)) == "."))
    fits = lambda s: (F.length(path) >= s["path"]) & boundary(s["host"])
    key = lambda s: F.concat(F.right(host, s["host"]), F.left(path, s["path"]))
    all_shapes = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path")) for h, p in sorted(shapes)])
    urls = pages.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = urls.filter(F.instr("url", "://") > 0).select("url", F.explode(F.transform(F.filter(all_shapes, fits), key)).alias("key"))

    blocks = bloom_blocks(n_keys)
    possible = probe_bloom(keys, "key", build_bloom(rules, "key", blocks), blocks)
    hits = possible.join(F.broadcast(rules) if n_bytes + 64 * n_keys <= BROADCAST_BYTES else rules, "key")
    rank = F.struct(F.length("key"), F.length("rule_host"), (F.col("rule_verdict") == "block").alias("blocks"), F.col("key"), F.col("rule_verdict"))
    best = hits.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.key").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    return parts.join(best, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
