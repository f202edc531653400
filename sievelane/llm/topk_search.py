"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, and cut in that order into annuli: runs
of one pivot between two distances. For a query q, a pivot p and an annulus of distances [lo, hi] whose vectors
have norms of at most R, the triangle inequality bounds |q - x| from below by gap = max(0, |q - p| - hi, lo - |q - p|), so

    q . x  =  (|q|^2 + |x|^2 - |q - x|^2) / 2  <=  (|q|^2 + R^2 - gap^2) / 2,

and also q . x <= q . p + |q| hi and q . x <= |q| R. Annuli are opened in order of their bound until no
bound reaches a query's k-th best score, which starts at what the pivots themselves give (they are rows of
the table too). The result is exact: the scores are integers, and every row not reached is bounded.

Queries and annuli meet in blocks: a task holds one block of queries and one shard of annuli, and gives up to k
rows for each of its queries; a last ranking by query merges the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vector, materialise, pieces

PIVOTS = 64
ANNULUS = 1024
SHARD_ANNULI = 16
QUERY_BLOCK = 1024
#: Added to bounds, relative to their terms, for rounding in floating point.
SLACK = 1e-9


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component as a whole number, for ids that aren't null and finite
    vectors. Of several rows with one id, the smallest vector stays."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    good = vectors.filter(F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)))
    return good.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pack(ids: np.ndarray, m: np.ndarray) -> dict:
    return {"n": len(ids), "ids": ids.astype(np.int64).tobytes(), "vs": m.astype(np.int64).astype(_kind(m)).tobytes(), "kind": np.dtype(_kind(m)).str}


def _kind(m: np.ndarray) -> type:
    top = int(np.abs(m).max(initial=0))
    return np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64


def _unpack(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vs"], np.dtype(row["kind"])).reshape(-1, dims)


PACKED = "n int, ids binary, vs binary, kind string"


def build_index(vectors: DataFrame, dims: int, pivots: np.ndarray, n_rows: int) -> DataFrame:
    """(id, v) to annuli: shard, pivot, lo, hi, norm and the packed vectors."""
    p = pivots.astype(float)
    square = (p * p).sum(1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), dims).astype(float)
            d2 = np.maximum((m * m).sum(1)[:, None] - 2 * (m @ p.T) + square, 0)
            near = d2.argmin(1) if len(m) else np.zeros(0, int)
            dist = np.sqrt(((m - p[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(dist)], names=["id", "v", "pivot", "dist"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            pivot, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            change = np.flatnonzero(np.diff(pivot, prepend=-1))
            out = []
            for a, b in zip(change, [*change[1:], len(ids)], strict=True):
                for lo in range(a, b, ANNULUS):
                    own = slice(lo, min(b, lo + ANNULUS))
                    norm = np.sqrt((m[own].astype(float) ** 2).sum(1)).max()
                    out.append({"pivot": int(pivot[a]), "lo": float(dist[own].min()), "hi": float(dist[own].max()), "norm": float(norm), **_pack(ids[own], m[own])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("norm", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vs", pa.binary()), ("kind", pa.string())]))

    rows = vectors.mapInArrow(keyed, "id long, v array<long>, pivot int, dist double")
    parts = pieces(n_rows, ANNULUS * SHARD_ANNULI)
    ordered = rows.repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    annuli = ordered.mapInArrow(cut, f"pivot int, lo double, hi double, norm double, {PACKED}")
    return annuli.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))


def _pack_queries(queries: DataFrame, dims: int, n_blocks: int) -> DataFrame:
    """(id, v) to blocks: block and the packed vectors, QUERY_BLOCK at most in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, ids, m = batch.column(2).to_numpy(), batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            out = [{"block": int(b), **_pack(ids[block == b], m[block == b])} for b in np.unique(block)]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vs", pa.binary()), ("kind", pa.string())]))

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    return dealt.repartition(n_blocks, "block").mapInArrow(run, f"block int, {PACKED}")


def search_tile(q_ids: np.ndarray, q: np.ndarray, annuli: list[dict], pivots: np.ndarray, pivot_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the annuli for each query: (query index, id, score), by query, score downwards, id."""
    dims = q.shape[1]
    top = max([int(np.abs(x).max(initial=0)) for x in (q, pivots)] + [int(np.abs(a["m"]).max(initial=0)) for a in annuli])
    exact = np.float32 if dims * top * top < 1 << 24 else np.float64 if dims * top * top < 1 << 53 else np.int64
    qx, qf, pf = q.astype(exact), q.astype(float), pivots.astype(float)
    q_norm = np.sqrt((qf * qf).sum(1))
    to_pivot = np.sqrt(((qf[:, None, :] - pf[None]) ** 2).sum(2)) if len(q) * len(pf) * dims < 1 << 24 else np.stack([np.sqrt(((x - pf) ** 2).sum(1)) for x in qf])
    dot_pivot = qf @ pf.T
    # the k-th best score among the pivots is reached by k rows of the table, the query's own left out
    seed = np.where(pivot_ids[None, :] == q_ids[:, None], -np.inf, dot_pivot)
    floor = np.sort(seed, 1)[:, -k] if len(pf) >= k else np.full(len(q), -np.inf)
    bounds = np.empty((len(annuli), len(q)))
    for j, a in enumerate(annuli):
        d = to_pivot[:, a["pivot"]]
        gap = np.maximum(0, np.maximum(d - a["hi"], a["lo"] - d) - SLACK * (d + a["hi"]))
        bounds[j] = np.minimum((q_norm**2 + a["norm"] ** 2 - gap**2) / 2, np.minimum(dot_pivot[:, a["pivot"]] + q_norm * a["hi"], q_norm * a["norm"]))
        bounds[j] += SLACK * (1 + q_norm**2 + a["norm"] ** 2)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for j in np.argsort(-bounds.max(1), kind="stable") if len(annuli) else []:
        live = np.flatnonzero(bounds[j] >= floor)
        if not len(live):
            continue
        ids = annuli[j]["ids"]
        scores = qx[live] @ annuli[j]["m"].astype(exact).T
        qi, xi = np.nonzero(scores >= (floor - 1e-15 * np.abs(floor))[live, None])
        own = ids[xi] != q_ids[live[qi]]
        qi, xi = qi[own], xi[own]
        cand = (live[qi], ids[xi], scores[qi, xi].astype(np.int64))
        best = _keep(tuple(np.concatenate(x) for x in zip(best, cand, strict=True)), k)
        starts = np.searchsorted(best[0], np.arange(len(q)))
        full = np.searchsorted(best[0], np.arange(len(q)), "right") - starts >= k
        floor[full] = np.maximum(floor[full], best[2][starts[full] + k - 1])
    return best


def _keep(rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    q, i, s = (x[order] for x in rows)
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], i[rank < k], s[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """For each row that ``is_query`` (of ``id``) marks, its k highest inner products among all other rows:
    query_id, rank (from 1), vec_id, score. Ties go to the smaller id; all rows, if there are fewer than k.

    Components become floor(scale * x). Null ids, null or empty vectors and those with null, NaN or infinite
    components take no part; rows that repeat an id count once (the smallest vector). Vectors meet only
    vectors of their own length. Other columns are ignored. The pivots are a sample of ``n_pivots`` rows of each length, by a hash of the id.
    """
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, id_col, vec_col, scale))
    out = None
    # lengths in use: a model gives one, so this loops once
    for dims, n_rows in sorted(rows.groupBy(F.size("v")).count().collect()):
        own = rows.filter(F.size("v") == dims)
        chosen = own.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
        pivots, pivot_ids = np.array([r["v"] for r in chosen], np.int64), np.array([r["id"] for r in chosen], np.int64)
        queries = own.filter(is_query)
        n_queries = queries.count()
        if not n_queries:
            continue
        index = build_index(own, dims, pivots, n_rows)
        blocks, shards = pieces(n_queries, QUERY_BLOCK), pieces(n_rows, ANNULUS * SHARD_ANNULI)
        packed = _pack_queries(queries, dims, blocks)
        left = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(blocks * shards, "shard", "block")
        right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        out_part = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_tile(dims, pivots, pivot_ids, k), "query_id long, vec_id long, score long")
        out = out_part if out is None else out.unionByName(out_part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tile(dims: int, pivots: np.ndarray, pivot_ids: np.ndarray, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        annuli = []
        for row in right.to_pylist():
            ids, m = _unpack(row, dims)
            annuli.append({"pivot": row["pivot"], "lo": row["lo"], "hi": row["hi"], "norm": row["norm"], "ids": ids, "m": m})
        out = [(np.zeros(0, np.int64),) * 3]
        for row in left.to_pylist() if annuli else []:
            q_ids, q = _unpack(row, dims)
            for at in range(0, len(q_ids), QUERY_BLOCK):
                part = slice(at, at + QUERY_BLOCK)
                qi, ids, scores = search_tile(q_ids[part], q[part], annuli, pivots, pivot_ids, k)
                out.append((q_ids[part][qi], ids, scores))
        query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": query, "vec_id": vec, "score": score})

    return run
