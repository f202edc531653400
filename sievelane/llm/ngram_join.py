"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists.

Two sets of n and m shingles with Jaccard similarity of at least t share at least T = t (n + m) / (1 + t) shingles.

1. Every document's shingles are hashed and dealt to buckets as packed arrays; documents with equal sets form a class, which is sent
   once by each task. A bucket counts in how many sets each hash occurs and returns the shared ones, with that count, to their
   sets. A shingle of a single set is in no intersection, and a set of which more than a share 1 - t is unshared can have no
   partner, so it is done.
2. One document stands for its class from here on. Its shortest lists, in a
   global order by (logarithm of the count, hash), are those of which any partner must appear in one. Documents that meet in such
   a list, directly or through others, form a cell; small cells share a task, and a large one is cut into
   blocks, each pair of which is a task.
3. A task searches its inverted lists for each document: lists are divided into short and long ones, the short, sorted runs, are
   merged by a sort (with a heap the search of a cell of 1,041 sets took nine times as long), documents that reach T less the number of long lists are probed for in the long lists by
   binary search, and those that reach T are linked. Documents that earlier links already
   connect are taken out of the lists before they are merged, since they can't change a component; a group of near copies thus costs
   one comparison a document. Tasks give links that span their components, never all pairs.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, text_bytes, trim
from .components import connected_components
from .fingerprints import U, column_words, mix

#: Shingles that a bucket is meant to hold; a word has about six bytes.
BUCKET_SHINGLES = 2 << 20
#: Documents whose hashes are packed together.
DOCS_SENT = 2048
#: Documents of a large cell that a search task holds (twice, where two blocks meet).
BLOCK = 1024
#: Documents of small cells that share a search task, as it is meant.
SHARED = 512
#: Bytes of a hash that are sent besides the bits that choose a bucket.
SENT = 5


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of every row; a text of fewer words than ``size`` is one shingle, one without words none."""
    for lo, hi, w in column_words(column, lower=True):
        whole = w.windows(size)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= size:
                yield lo + i, np.unique(whole[a : b - size + 1])
            elif b > a:
                h = np.array([b - a], U)
                for k in range(a, b):
                    h = mix(h * U(31) + w.hash[k : k + 1])
                yield lo + i, h
            else:
                yield lo + i, np.zeros(0, U)


def _least_shared(n: int, t: Fraction) -> int:
    """The fewest shingles of a set of n that a partner holds."""
    return math.ceil(n * t)


def _digest(hashes: np.ndarray) -> int:
    """64 bits that tell sets apart; rows with equal ones form a class."""
    return int(mix(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True, dtype=U) + U(len(hashes)))[0].view(np.int64)) if len(hashes) else 0


def _shared(docs: DataFrame, size: int, t: Fraction, id_col: str, text_col: str) -> DataFrame:
    """(kind, id, n, digest, hashes, logs).

    Kind 0, one row per document: id, n, digest. Kind 1, one row per set that may have a partner: n, digest, the hashes it
    shares with other sets, and for each the logarithm of how many sets have it, as a byte.

    Sets have a home, chosen by their digest. What buckets find goes to the homes in one row for each bucket and home, so that
    the number of rows doesn't grow with buckets times sets.
    """
    total = text_bytes(docs, text_col)
    bits = max(0, round(math.log2(max(1, total / 6 / BUCKET_SHINGLES))))
    homes = 1 << bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, sets = [], []
            for row, hashes in shingle_sets(batch.column(1), size):
                rows.append(ids[row])
                sets.append(hashes)
                if len(rows) == DOCS_SENT:
                    yield _pack(rows, sets, bits)
                    rows, sets = [], []
            if rows:
                yield _pack(rows, sets, bits)
            del batch, rows, sets
        trim()

    def count(table: pa.Table) -> pa.Table:
        out = counted(table)
        del table
        trim()
        return out

    def by_home(digests: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(home, places of its digests)"""
        home = (digests.view(U) % U(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        each, starts = np.unique(home[order], return_index=True)
        return [(int(h), order[a:b]) for h, a, b in zip(each, starts, [*starts[1:], len(order)], strict=True)] if len(order) else []

    def counted(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        sent, out = [], []
        for i, n, d, s, h in zip(*(table[c] for c in ("ids", "ns", "digests", "sizes", "hashes")), strict=True):
            digest = np.frombuffer(d.as_buffer(), np.int64)
            if not h.is_valid:  # documents on their way through; their sets' sizes go to the homes
                out.append((bucket % homes, 0, bucket, i.as_py(), n.as_py(), d.as_py(), None, None, None))
                names, first = np.unique(digest, return_index=True)
                ns = np.frombuffer(n.as_buffer(), np.int64)[first]
                out += [(home, 1, bucket, None, ns[at].tobytes(), names[at].tobytes(), None, None, None) for home, at in by_home(names)]
            else:
                sent.append((digest, np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(h.as_buffer(), np.uint8).reshape(-1, SENT)))
        if sent:
            names = np.unique(np.concatenate([d for d, _, _ in sent]))
            room = U(max(1, int(len(names) - 1).bit_length()))
            # one number for a hash and a set, so that one sort brings equal hashes together, and copies of a set from other tasks
            pair, at = np.empty(sum(len(h) for _, _, h in sent), U), 0
            for digest, sizes, data in sent:
                wide = np.zeros((len(data), 8), np.uint8)
                wide[:, :SENT] = data
                pair[at : at + len(data)] = wide.view(U).ravel() << room | np.repeat(np.searchsorted(names, digest), sizes).astype(U)
                at += len(data)
            pair.sort()
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] >> room != pair[:-1] >> room]))
            df = np.diff(starts, append=len(pair))
            pair = pair[np.repeat(df > 1, df)]
            logs = np.repeat(np.minimum(255, np.log2(df[df > 1]) * 8).astype(np.uint8), df[df > 1])
            name = (pair & ((U(1) << room) - U(1))).astype(np.int64)
            order = np.argsort(name, kind="stable")
            name, logs = name[order], logs[order]
            data = (pair >> room)[order].view(np.uint8).reshape(-1, 8)[:, :SENT]
            for home, at in by_home(names[name]):
                who, sizes = np.unique(name[at], return_counts=True)
                out.append((home, 2, bucket, None, None, names[who].tobytes(), sizes.astype(np.int32).tobytes(), data[at].tobytes(), logs[at].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.int32()] * 3 + [pa.binary()] * 6
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(FOUND.split(", "), columns, kinds, strict=True)})

    def gather(table: pa.Table) -> pa.Table:
        out = gathered(table)
        del table
        trim()
        return out

    def gathered(table: pa.Table) -> pa.Table:
        ids, ns, digests, sizes_of = [], [], [], {}
        who, values, logs = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.uint8)]
        for kind, bucket, i, n, d, s, h, g in zip(*(table[c] for c in ("kind", "bucket", "ids", "ns", "digests", "sizes", "hashes", "logs")), strict=True):
            digest = np.frombuffer(d.as_buffer(), np.int64)
            if kind.as_py() == 0:
                ids += [None if x == _NULL else x for x in np.frombuffer(i.as_buffer(), np.int64).tolist()]
                ns += np.frombuffer(n.as_buffer(), np.int64).tolist()
                digests += digest.tolist()
            elif kind.as_py() == 1:
                sizes_of.update(zip(digest.tolist(), np.frombuffer(n.as_buffer(), np.int64).tolist(), strict=True))
            else:
                wide = np.zeros((len(h.as_buffer()) // SENT, 8), np.uint8)
                wide[:, :SENT] = np.frombuffer(h.as_buffer(), np.uint8).reshape(-1, SENT)
                values.append(wide.view(U).ravel() | U(bucket.as_py()) << U(8 * SENT))
                logs.append(np.frombuffer(g.as_buffer(), np.uint8))
                who.append(np.repeat(digest, np.frombuffer(s.as_buffer(), np.int32)))
        k = len(ids)
        own, value, log = (np.concatenate(x) for x in (who, values, logs))
        order = np.argsort(own, kind="stable")
        own, value, log = own[order], value[order], log[order]
        names, starts = np.unique(own, return_index=True)
        kept = [(d, a, b) for d, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)][: len(starts)], strict=True) if b - a >= _least_shared(sizes_of[d], t)]
        m = len(kept)
        return pa.table(
            {
                "kind": pa.array([0] * k + [1] * m, pa.int32()),
                "id": pa.array(ids + [None] * m, pa.int64()),
                "n": pa.array(ns + [sizes_of[d] for d, _, _ in kept], pa.int64()),
                "digest": pa.array(digests + [d for d, _, _ in kept], pa.int64()),
                "hashes": pa.array([None] * k + [value[a:b].tobytes() for _, a, b in kept], pa.binary()),
                "logs": pa.array([None] * k + [log[a:b].tobytes() for _, a, b in kept], pa.binary()),
            }
        )

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    sent = rows.mapInArrow(emit, "bucket int, ids binary, ns binary, digests binary, sizes binary, hashes binary")
    found = sent.groupBy("bucket").applyInArrow(count, FOUND)
    return found.groupBy("home").applyInArrow(gather, "kind int, id long, n long, digest long, hashes binary, logs binary")


FOUND = "home int, kind int, bucket int, ids binary, ns binary, digests binary, sizes binary, hashes binary, logs binary"
_NULL = np.iinfo(np.int64).min


def _pack(ids: list[int | None], sets: list[np.ndarray], bits: int) -> pa.RecordBatch:
    digests = np.array([_digest(s) for s in sets], np.int64)
    # the documents themselves go through some bucket, too, so that one exchange serves both
    numbers = np.array([_NULL if i is None else i for i in ids], np.int64)
    out: list[tuple] = [(int(digests[0]) & ((1 << bits) - 1), numbers.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), digests.tobytes(), None, None)]
    seen: dict[int, np.ndarray] = {}  # copies are sent once
    for i, d, s in zip(ids, digests.tolist(), sets, strict=True):
        if i is not None and len(s):
            seen[d] = s
    if seen:
        names = np.array(list(seen), np.int64)
        values = np.concatenate(list(seen.values()))
        own = np.repeat(np.arange(len(names)), [len(s) for s in seen.values()])
        bucket = (values >> U(64 - bits)).astype(np.uint32) if bits else np.zeros(len(values), np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        each, starts = np.unique(bucket[order], return_index=True)
        low = (values >> U(64 - bits - 8 * SENT)) & U((1 << 8 * SENT) - 1)
        for b, start, end in zip(each.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            at = order[start:end]
            who, sizes = np.unique(own[at], return_counts=True)
            data = low[at].view(np.uint8).reshape(-1, 8)[:, :SENT]
            out.append((b, None, None, names[who].tobytes(), sizes.astype(np.int32).tobytes(), data.tobytes()))
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "ids", "ns", "digests", "sizes", "hashes"])


class Found:
    """The components over the documents of a task; ``label``: the smallest document of each one's."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [np.array([i]) for i in range(n)]

    def join(self, i: int, j: int) -> None:
        a, b = sorted((int(self.label[i]), int(self.label[j])))
        if a != b:
            self.label[self.members[b]] = a
            self.members[a] = np.concatenate([self.members[a], self.members[b]])
            self.members[b] = np.zeros(0, np.int64)


def search(sets: list[np.ndarray], sizes: list[int], sides: list[int] | None, t: Fraction) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the join of ``sets`` with themselves.

    ``sets``: hashes that others may share, out of ``sizes`` in all; ``sides``: link only across two sides.
    """
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], i))
    size = [sizes[i] for i in order]
    sizes_ = np.array(size, np.int64)
    side = np.array([sides[i] for i in order]) if sides else None
    doc = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    if not len(doc):
        return []
    value = np.concatenate([sets[i] for i in order])
    by = np.lexsort((doc, value))
    starts = np.flatnonzero(np.diff(value[by], prepend=value[by[:1]] - U(1)))
    number = np.empty(len(value), np.int64)
    number[by] = np.repeat(np.arange(len(starts)), np.diff([*starts, len(by)]))
    ends = [*starts[1:].tolist(), len(by)]
    docs_by = doc[by]
    lists = [docs_by[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]  # ascending document numbers
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in order])])
    found, links = Found(len(order)), []
    label = found.label
    for x in range(len(order)):
        n = size[x]
        mine = [lists[k] for k in number[first[x] : first[x + 1]].tolist() if len(lists[k]) > 1]
        least = _least_shared(n, t)  # partners have at most n shingles, and at least n * t
        if len(mine) < least:
            continue
        low = bisect_left(size, n * t)
        mine.sort(key=len)
        # partners stand before x: the part of a list that counts ends at x
        longest = math.log2(len(mine[-1]) + 1)
        n_long = min(least - 1, max(0, int(least / (0.01 * longest + 1))))
        short, long = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        parts = [part[np.searchsorted(part, low) : np.searchsorted(part, x)] for part in short]
        flat = np.concatenate(parts)

        def apart(flat: np.ndarray, x: int = x) -> np.ndarray:
            """Of list entries, those that a link to x would join to its component."""
            new = label[flat] != label[x]
            return new & (side[flat] != side[x]) if side is not None else new

        new = apart(flat)
        # a document that an earlier one of its group is likely to link is tried first; then the group is out of the lists
        if new.any():
            y = int(flat[new][0])
            own = value[first[x] : first[x + 1]]
            both = len(np.intersect1d(own, value[first[y] : first[y + 1]], assume_unique=True))
            if both >= math.ceil(t * (n + size[y]) / (1 + t)):
                found.join(x, y)
                links.append((order[x], order[y]))
                new = apart(flat)
        if not new.any():
            continue
        ys, count = np.unique(flat[new], return_counts=True)  # sorted runs, which the sort merges
        near = count >= least - n_long
        ys, count = ys[near], count[near]
        need = -(-t.numerator * (n + sizes_[ys]) // (t.numerator + t.denominator))
        for rest, part in zip(range(n_long, 0, -1), long):
            near = count + rest >= need
            if not near.all():
                ys, count, need = ys[near], count[near], need[near]
                if not len(ys):
                    break
            at = np.searchsorted(part, ys)
            count = count + (part[np.minimum(at, len(part) - 1)] == ys)
        for y in ys[count >= need].tolist():
            if label[x] != label[y]:
                found.join(x, y)
                links.append((order[x], order[y]))
    return links


def similar_components(docs: DataFrame, size: int = 4, threshold: str = "85/100", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row per row of ``docs``, the id called as ``id_col``.

    Texts are lower-cased in A-Z and cut into words at spaces and control characters 0x09-0x0D; the set of a text is its distinct shingles
    of ``size`` words; a text with fewer words is one shingle, and one without words, or null, has none and links with
    nothing. Two rows link when intersection / union >= ``threshold``, taken as an exact fraction. component_id: the smallest id
    reachable by links, itself included. Repeated rows stay; rows with one id are one node, whose links are those of
    any of them. A row with a null id keeps its n_shingles, links with nothing and has a null component_id. Other columns are ignored.
    """
    t = Fraction(threshold)
    parts = materialise(_shared(docs, size, t, id_col, text_col))
    rows = parts.filter("kind = 0").select("id", "n", "digest")
    known = rows.filter("id IS NOT NULL AND n > 0")
    classes = known.groupBy("digest", "n").agg(F.min("id").alias("rep"))
    reps = materialise(parts.filter("kind = 1").select("digest", "n", "hashes", "logs").join(classes, ["digest", "n"]).select("rep", "n", "hashes", "logs"))

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rep, n, h, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value, log = np.frombuffer(h, U), np.frombuffer(g, np.uint8)
                take = n - _least_shared(n, t) + 1 - (n - len(value))  # unshared shingles come first in the order
                order = np.lexsort((value, log))[: max(0, take)]
                hashes.append(value[order].view(np.int64))
                who.append(np.full(len(order), rep))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(who))], names=["hash", "rep"])
            del batch, hashes, who
        trim()

    lists = reps.select("rep", "n", "hashes", "logs").mapInArrow(shortest, "hash long, rep long")
    heads = lists.groupBy("hash").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).filter("head < last")
    cells = materialise(connected_components(lists.join(heads, "hash").filter("rep > head").select(F.col("rep").alias("a"), F.col("head").alias("b"))))
    links = _links(reps, cells, t)
    copies = known.join(classes, ["digest", "n"]).filter("id > rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(copies.unionByName(links))
    out = rows.join(components.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _links(reps: DataFrame, cells: DataFrame, t: Fraction) -> DataFrame:
    """Links that span the components within each cell."""
    # partners' sizes are within t of each other, so they stand in one band of sizes or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / t) + 1e-9).cast("int")
    cells = cells.select("component", F.col("node").alias("rep")).join(reps.select("rep", band.alias("band")), "rep")
    sizes = cells.groupBy("component").agg(F.count("*").alias("size"))
    small = F.col("size") <= BLOCK
    cells = cells.join(sizes, "component").withColumn("small", small)
    few = cells.filter("small").select("rep", F.pmod(F.xxhash64("component"), F.lit(pieces(cells.count(), SHARED))).alias("cell"), "small", F.lit(0).alias("band"))
    # a document of a large cell meets those of its own band and of both neighbours
    many = cells.filter("NOT small").select("rep", F.col("component").alias("cell"), "small", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    placed = many.join(many.groupBy("cell", "band").agg(F.count("*").alias("size")), ["cell", "band"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    placed = few.withColumn("blocks", F.lit(1)).unionByName(placed).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("rep", "cell", "small", "band", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = paired.join(reps.select("rep", "n", "hashes"), "rep")

    def run(table: pa.Table) -> pa.Table:
        one = table["lo"][0].as_py() == table["hi"][0].as_py()
        sets = [np.sort(np.frombuffer(h, U)) for h in table["hashes"].to_pylist()]
        found = search(sets, table["n"].to_pylist(), None if one else table["block"].to_pylist(), t)
        reps_ = table["rep"].to_pylist()
        return pa.table({"a": pa.array([reps_[i] for i, _ in found], pa.int64()), "b": pa.array([reps_[j] for _, j in found], pa.int64())})

    return rows.groupBy("cell", "small", "band", "lo", "hi").applyInArrow(run, "a long, b long")
