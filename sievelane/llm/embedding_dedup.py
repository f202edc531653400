"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, then exact cosines where these leave doubt.

A vector x, scaled to length 1, is rounded to xq = s * k, k whole numbers of at most 127 in absolute value. With
e_x = |x - xq| computed for the vector itself,

    |x . y - xq . yq|  <=  e_x |yq| + |xq| e_y + e_x e_y,

so a pair whose quantised product plus that bound stays below the threshold has no link, and only the
others are recomputed in double precision. Products of tiles run in single precision, in which whole numbers
below 2^24 are exact. All pairs of tiles are covered, each by one task that holds two tiles; a task gives a row per linked
vector, with its links and its component within the two tiles, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vector, materialise, pieces
from .components import connected_components, local_roots

TILE = 4096
STRIP = 1024
#: Covers the rounding of the bound itself in double precision.
SLACK = 1e-9


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that no square overflows or vanishes."""
    m = m.astype(float)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to (k as int8, s, |xq|, e_x)."""
    s = np.abs(u).max(1) / 127
    k = np.rint(u / s[:, None]).astype(np.int8)
    xq = k * s[:, None]
    return k, s, np.sqrt((xq * xq).sum(1)), np.sqrt(((u - xq) ** 2).sum(1))


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y) of the linked pairs, a strip at a time; y None: pairs within x, each once."""
    kx, sx, nx, ex = quantise(unit_rows(x))
    ky, sy, ny, ey = (kx, sx, nx, ex) if y is None else quantise(unit_rows(y))
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fy = ky.astype(exact).T
    other = x if y is None else y
    for a in range(0, len(x), STRIP):
        rows = slice(a, a + STRIP)
        first = a if y is None else 0
        product = (kx[rows].astype(exact) @ fy[:, first:]).astype(float)
        product *= sx[rows, None]
        product *= sy[first:]
        product += ex[rows, None] * (ny[first:] + ey[first:]) + nx[rows, None] * ey[first:]
        i, j = np.nonzero(product >= threshold - SLACK)
        i, j = i + a, j + first
        if y is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            u, v = x[p].astype(float), other[q].astype(float)
            u, v = u / np.abs(u).max(1, keepdims=True), v / np.abs(v).max(1, keepdims=True)
            cosine = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
            link = cosine >= threshold
            yield p[link], q[link]


def _pair(threshold: float, dims: int):
    def run(table: pa.Table) -> pa.Table:
        tiles: dict[int, list] = {}
        for row in table.select(["tile", "ids", "vs"]).to_pylist():
            tiles.setdefault(row["tile"], []).append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vs"], np.float64 if len(row["vs"]) == 8 * dims * (len(row["ids"]) // 8) else np.float32).reshape(-1, dims)))
        sides = [tuple(np.concatenate(x) for x in zip(*tiles[t], strict=True)) for t in sorted(tiles)]
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        if len(sides) == 1 and lo != hi:  # the other tile is empty
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        ids = np.concatenate([s[0] for s in sides])
        shift = len(sides[0][0]) if len(sides) == 2 else 0
        counts = np.zeros(len(ids), np.int64)
        a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for p, q in tile_links(sides[0][1], sides[1][1] if shift else None, threshold):
            np.add.at(counts, p, 1)
            np.add.at(counts, q + shift, 1)
            a.append(ids[p])
            b.append(ids[q + shift])
            size += len(p)
            if size > 1_000_000:  # as stars, a group's pairs need room for its members only
                nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
                a, b, size = [nodes], [roots], 0
        nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
        linked = np.flatnonzero(counts)
        root = roots[np.searchsorted(nodes, ids[linked])] if len(linked) else ids[linked]
        return pa.table({"id": ids[linked], "n": counts[linked], "root": root})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept, the id called as ``id_col``.

    n_links: other ids whose vector has a cosine of at least ``threshold`` with this one's, in double precision; component_id: the
    smallest id reachable by links, itself included; kept: whether that is its own. Null, empty and zero vectors and
    those with null, NaN or infinite components link with nothing, nor do vectors of unlike lengths or with
    a null id (whose component_id and kept are null). Rows that repeat an id are one vector, the smallest of theirs, and
    all get its result. ``threshold`` must be above 0. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col(id_col).cast("bigint").alias("id"))
    zero = ~F.exists(F.col(vec_col), lambda x: x != 0)
    good = vectors.filter(F.col(id_col).isNotNull() & finite_vector(F.col(vec_col))).filter(~zero)
    single = good.schema[vec_col].dataType.elementType.typeName() == "float"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    good = materialise(good.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v")))
    found = None
    for dims, n in sorted(good.groupBy(F.size("v")).count().collect()):  # a model gives one length
        tiles = pieces(n, TILE)
        rows = good.filter(F.size("v") == dims).withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))

        def pack(batches: Iterator[pa.RecordBatch], dims: int = dims) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tile, own = batch.column(2).to_numpy(), batch.column(0).to_numpy()
                m = batch.column(1).flatten().to_numpy().reshape(-1, dims)
                each = np.unique(tile)
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array([own[tile == t].tobytes() for t in each], pa.binary()), pa.array([m[tile == t].tobytes() for t in each], pa.binary())], names=["tile", "ids", "vs"])

        packed = rows.repartition(tiles, "tile").mapInArrow(pack, "tile int, ids binary, vs binary")
        other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        pairs = packed.withColumn("other", other).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other")
        part = pairs.repartition(tiles * (tiles + 1) // 2, "lo", "hi").groupBy("lo", "hi").applyInArrow(_pair(threshold, dims), "id long, n long, root long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.sql("SELECT CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS root LIMIT 0")
    found = materialise(found)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = ids.join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
