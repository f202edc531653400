"""Phrase collocations: depth-limited count tries, one per shard, merged by prefix range.

1. Tasks cut texts into words and write shards: the distinct words of some MB of one language, with counts, and the text as
   codes of these words, 0 at the end of a piece. Texts are read once and never shuffled.
2. Shards send their words, packed, to buckets by hash, where the counts are summed. A word below the least frequency can't stand in a phrase that reaches it, so only the others get an id, dense
   and small for frequent words, and the bucket answers each shard with the ids of its own words.
3. A shard's trie of all runs of up to DEPTH ids comes level by level; it is serialised sorted, cut at the bounds of prefix ranges. Bounds are whole paths at
   quantiles of a sample, so a frequent first word, or pair, or triple, is cut as finely as any other.
4. A range merges its k tries pairwise, smallest first, and walks the result: what is frequent comes out with the counts of the nodes above it, its left parts.
   A node that a bound runs through has a count in several ranges; these few are summed afterwards.
5. A suffix link leads from a phrase to the same words without the first; following it k times is a join of the nodes with the last words of the phrases, which gives the right parts.

What the sample chooses is where ranges are cut, never what is counted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain, bounded, materialise, pieces, release, text_bytes, trim
from .fingerprints import Words

DEPTH = 5
#: Bytes of text that a shard is meant to hold; a longer text is a shard of its own.
SHARD_TEXT = 8 << 20
#: Bytes of text that are cut into words at once; a longer text is cut alone.
CUT_BYTES = 1 << 20
#: Bytes of text whose words a bucket is meant to hold.
BUCKET_TEXT = 64 << 20
#: Paths that a range is meant to hold, and the most ranges: beyond, ranges get larger. Each task gets all bounds, 20 bytes each.
RANGE_PATHS, MOST_RANGES = 3 << 20, 1 << 16
#: Paths that a shard gives to the sample; of all these at most so many for each range are sorted.
SHARD_SAMPLE, RANGE_SAMPLE = 512, 64

_SEPARATOR = np.zeros(256, np.uint8)
_SEPARATOR[[0x20, 0x09]] = 1
_SEPARATOR[[*b".,;:!?", 10, 11, 12, 13]] = 2  # these end a piece, too


def cut_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in order, for each whether it is the first of a piece); A-Z lower-cased, null texts have none."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = (np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    kind = _SEPARATOR[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets - offsets[0]] = True
    before, after = np.concatenate([[False], word]), np.concatenate([word, [False]])
    start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    ends = np.concatenate([[0], np.cumsum((kind == 2) | edge[:-1], dtype=np.int64)])  # piece ends, and first bytes of texts, up to a place
    at = ends[np.minimum(start + 1, len(data))]
    fresh = np.ones(len(start), bool)
    fresh[1:] = at[1:] != at[:-1]
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(lower[word])), fresh


_PACKED = pa.Codec("zstd", 1)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, as planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + _PACKED.compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_PACKED.decompress(data[8:], decompressed_size=4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


#: A row for the text of a shard (codes) and one for each bucket that its words go to (words, counts, and at: their codes, from 0).
SHARDS = "shard long, lang string, codes binary, bucket int, words array<string>, counts binary, at binary"


def _shard_rows(shard: int, lang: str, parts: list[tuple[pa.Array, np.ndarray]], buckets: int) -> pa.RecordBatch:
    coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64) + 1
    first = np.concatenate([f for _, f in parts])
    line = np.zeros(len(code) + int(first.sum()), np.int64)  # a 0 before each piece
    line[np.arange(len(code)) + np.cumsum(first)] = code
    counts = np.bincount(code, minlength=len(words) + 1)[1:]
    joined = np.frombuffer(" ".join(words.to_pylist()).encode(), np.uint8)
    own = (Words(joined, np.array([0, len(joined)]), False).hash % np.uint64(buckets)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    at = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[at], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edges)).tolist()
    sent = [at[edges[i] : edges[i + 1]] for i in some]
    n = len(some) + 1
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0, 0], np.cumsum([len(x) for x in sent], dtype=np.int64)]).astype(np.int32)), words.take(pa.array(at)).cast(pa.string()))
    binary = lambda values: pa.array(values, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * n, pa.int64()), pa.array([lang] * n, pa.string()), binary([packed(line), *[None] * len(some)]), pa.array([None, *some], pa.int32()), lists, binary([None, *(packed(counts[x]) for x in sent)]), binary([None, *(packed(x) for x in sent)])],
        names=["shard", "lang", "codes", "bucket", "words", "counts", "at"],
    )


def shards(batches: Iterator[pa.RecordBatch], buckets: int, size: int = SHARD_TEXT) -> Iterator[pa.RecordBatch]:
    """Shards of the rows (lang, text) of one task, of about ``size`` bytes; see SHARDS."""
    made, held, bytes_held = 0, {}, 0
    for batch in batches:
        for lang in batch["lang"].unique().to_pylist():
            text = batch["text"].filter(pc.equal(batch["lang"], lang))
            sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), min(CUT_BYTES, size), "right")))
                held.setdefault(lang, []).append(cut_words(text.slice(lo, hi - lo)))
                bytes_held += int(sizes[lo:hi].sum())
                lo = hi
                if bytes_held >= size:
                    for own, parts in held.items():
                        yield _shard_rows(made << 33 | TaskContext.get().partitionId(), own, parts, buckets)
                        made += 1
                    held, bytes_held = {}, 0
                    trim()
    for own, parts in held.items():
        yield _shard_rows(made << 33 | TaskContext.get().partitionId(), own, parts, buckets)
        made += 1
    trim()


KNOWN = "shard long, at binary, ids binary, lang string, word string, id long"


def vocabulary(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """Of a bucket: a row (lang, word, id) for each word that occurs ``least`` times in its language, ids from 1, each once over all buckets, nearly dense, smaller for frequent words; and
    for each shard a row (shard, at, ids): which of its codes have which ids."""
    langs, flat = table["lang"].to_pylist(), table["words"].combine_chunks()
    counts, at = ([unpacked(x) for x in table[c].to_pylist()] for c in ("counts", "at"))
    kept: list[tuple[int, str, str, int]] = []  # (-f, lang, word, code)
    codes: dict[str, tuple[list[int], np.ndarray]] = {}
    of_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        of_lang.setdefault(lang, []).append(i)
    for lang, rows in of_lang.items():
        coded = flat.take(pa.array(rows)).flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        f = np.bincount(code, np.concatenate([counts[i] for i in rows]), len(coded.dictionary)).astype(np.int64)
        codes[lang] = rows, code
        kept += [(-int(f[i]), lang, coded.dictionary[i].as_py(), i) for i in np.flatnonzero(f >= least).tolist()]
    kept.sort(key=lambda x: (x[0], x[1], x[2].encode()))
    bucket = table["bucket"][0].as_py()
    ids = [i * buckets + bucket + 1 for i in range(len(kept))]
    if ids and ids[-1] >= 1 << 32:
        raise OverflowError("more than 2^32 frequent words")
    out: list[tuple[int, bytes, bytes]] = []
    new = {lang: np.zeros(int(code.max()) + 1, np.int64) for lang, (_, code) in codes.items()}
    for (_, lang, _, i), own in zip(kept, ids, strict=True):
        new[lang][i] = own
    for lang, (rows, code) in codes.items():
        found, lo = new[lang][code], 0
        for i in rows:
            part = found[lo : lo + len(at[i])]
            lo += len(at[i])
            out.append((table["shard"][i].as_py(), packed(at[i][part > 0]), packed(part[part > 0])))
    n, m = len(out), len(kept)
    columns = [[x[0] for x in out] + [None] * m, [x[1] for x in out] + [None] * m, [x[2] for x in out] + [None] * m, [None] * n + [x[1] for x in kept], [None] * n + [x[2] for x in kept], [None] * n + ids]
    kinds = pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64()
    trim()
    return pa.table(dict(zip(("shard", "at", "ids", "lang", "word", "id"), (pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), strict=True)))


def paths_at(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of up to DEPTH ids from ``at``, a row each, 0 from their end on. ``line`` has DEPTH zeros behind it."""
    out = line[at[:, None] + np.arange(DEPTH)]
    return out * (np.cumsum(out == 0, axis=1) == 0)


CODED = "shard long, lang string, ids binary, words long, n long, sample array<binary>"


def coded(shard: pa.Table, known: pa.Table) -> pa.Table:
    """A shard's ids for its codes, 0 for infrequent words and ends of pieces, the numbers of its words and of its ids, and a sample of its paths."""
    if not shard.num_rows:
        return pa.table({"shard": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "ids": pa.array([], pa.binary()), "words": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "sample": pa.array([], pa.list_(pa.binary()))})
    line = unpacked(shard["codes"][0].as_py())
    ids = np.zeros(int(line.max()) + 1 if len(line) else 1, np.uint32)
    for at, own in zip(known["at"].to_pylist(), known["ids"].to_pylist(), strict=True):
        ids[unpacked(at) + 1] = unpacked(own)
    many = int((line > 0).sum())
    line = ids[line]
    line = line[(line > 0) | np.concatenate([[False], line[:-1] > 0])]  # of several zeros, one
    at = np.flatnonzero(line)
    some = at[:: max(1, -(-len(at) // SHARD_SAMPLE))]
    sample = [p.tobytes() for p in paths_at(np.concatenate([line, np.zeros(DEPTH, np.uint32)]), some).astype(">u4")]
    row = [shard["own"][0].as_py()], [shard["lang"][0].as_py()], [packed(line)], [many], [len(at)], [sample]
    kinds = pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary())
    out = pa.table(dict(zip(("shard", "lang", "ids", "words", "n", "sample"), (pa.array(v, k) for v, k in zip(row, kinds, strict=True)), strict=True)))
    trim()
    return out


def sorted_paths(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct paths in order, counts): the leaves of the trie, built level by level from the nodes above."""
    at = np.flatnonzero(line)
    padded = np.concatenate([line, np.zeros(DEPTH, line.dtype)])
    alive, node, words, parents = np.ones(len(at), bool), np.zeros(len(at), np.uint64), [], []
    for d in range(DEPTH):
        word = padded[at + d] * alive
        alive = word > 0
        keys, node = np.unique((node << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
        node = node.astype(np.uint64)
        words.append((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        parents.append((keys >> np.uint64(32)).astype(np.int64))
    counts = np.bincount(node.astype(np.int64), minlength=len(words[-1]))
    out = np.empty((len(words[-1]), DEPTH), np.uint32)
    row = np.arange(len(out))
    for d in reversed(range(DEPTH)):
        out[:, d] = words[d][row]
        row = parents[d][row]
    return out, counts


def _text_key(paths: np.ndarray) -> np.ndarray:
    """A bytes value for each path that compares as the path does."""
    return np.ascontiguousarray(paths.astype(">u4")).view(f"S{4 * DEPTH}").ravel()


def serialised(paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct paths: at which level each leaves the one before, the ids from there on, level by level, and the counts."""
    new = np.ones(paths.shape, bool)
    new[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
    level = (DEPTH - new.sum(1)).astype(np.uint32)
    parts = [packed(level), packed(counts), *(packed(paths[new[:, d], d]) for d in range(DEPTH))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


class Trie:
    """Levels of nodes: ``keys`` (the number of the parent, shifted, and the word), ascending; ``counts`` of the last level."""

    __slots__ = ("keys", "counts")

    def __init__(self, keys: list[np.ndarray], counts: np.ndarray):
        self.keys, self.counts = keys, counts

    @classmethod
    def read(cls, data: bytes) -> Trie:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(unpacked(data[at + 8 : at + 8 + n]))
            at += 8 + n
        level, counts, words = parts[0], parts[1].astype(np.int64), parts[2:]
        keys, parent = [], np.zeros(len(level), np.int64)
        for d in range(DEPTH):
            new = level <= d
            keys.append((parent[new] << 32) | words[d].astype(np.int64))
            parent = np.cumsum(new) - 1
        return cls(keys, counts)

    def merged(self, other: Trie) -> Trie:
        """One trie of both; nodes of equal paths become one."""
        keys, mine, theirs = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
        for x, y in zip(self.keys, other.keys, strict=True):
            a = (mine[x >> 32] << 32) | (x & 0xFFFFFFFF)
            b = (theirs[y >> 32] << 32) | (y & 0xFFFFFFFF)
            place = np.searchsorted(a, b)
            both = np.zeros(len(b), bool)
            inside = place < len(a)
            both[inside] = a[place[inside]] == b[inside]
            fresh = ~both
            # a node of mine moves by the fresh ones before it, one of theirs stands behind mine that are smaller
            moved = np.bincount(place[fresh], minlength=len(a) + 1)
            mine = np.arange(len(a)) + np.cumsum(moved[: len(a)])
            theirs = place + np.cumsum(fresh) - fresh
            theirs[both] = mine[place[both]]
            level = np.empty(len(a) + int(fresh.sum()), np.int64)
            level[mine] = a
            level[theirs] = b
            keys.append(level)
        counts = np.zeros(len(keys[-1]), np.int64)
        counts[mine] = self.counts
        counts[theirs] += other.counts  # theirs has each place once
        return Trie(keys, counts)

    def totals(self) -> list[np.ndarray]:
        """The counts of the nodes of every level: those of a node are the sum of those below it."""
        out = [self.counts]
        for keys, above in zip(self.keys[:0:-1], self.keys[-2::-1], strict=True):
            out.append(np.add.reduceat(out[-1], np.searchsorted(keys >> 32, np.arange(len(above)))))
        return out[::-1]

    def along(self, path: np.ndarray) -> list[int]:
        """The numbers of the nodes along ``path``, level by level, as far as there are any; not those of its zeros."""
        found, node = [], 0
        for d, word in enumerate(path.tolist()):
            key = node << 32 | word
            node = int(np.searchsorted(self.keys[d], key))
            if not word or node == len(self.keys[d]) or self.keys[d][node] != key:
                break
            found.append(node)
        return found


def merged(tries: list[Trie]) -> Trie:
    """All tries as one: the two smallest are merged until one is left."""
    heap = [(len(t.counts), i, t) for i, t in enumerate(tries)]
    heapq.heapify(heap)
    i = len(heap)
    while len(heap) > 1:
        t = heapq.heappop(heap)[2].merged(heapq.heappop(heap)[2])
        heapq.heappush(heap, (len(t.counts), i, t))
        i += 1
    return heap[0][2]


NODES = "lang string, path array<long>, f long, left array<long>, cut boolean"


class Ranges:
    """Paths from ``bounds[i - 1]`` up to below ``bounds[i]`` are range i."""

    def __init__(self, bounds: list[bytes], least: int):
        self.bounds, self.least = bounds, least

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (range, lang, trie) for each range in which a shard has paths."""
        bounds = np.array(self.bounds, f"S{4 * DEPTH}")
        for batch in batches:
            for lang, ids in zip(batch["lang"], batch["ids"], strict=True):
                paths, counts = sorted_paths(unpacked(ids.as_py()))
                edges = np.concatenate([[0], np.searchsorted(_text_key(paths), bounds), [len(paths)]])
                own = np.flatnonzero(np.diff(edges)).tolist()
                tries = [serialised(paths[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]]) for i in own]
                del paths, counts
                trim()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([lang.as_py()] * len(own), pa.string()), pa.array(tries, pa.binary())], names=["range", "lang", "trie"])

    def count(self, table: pa.Table) -> pa.Table:
        """The frequent nodes of a range and a language with the counts above them, and those that a bound runs through, whatever their count."""
        lang, i = table["lang"][0].as_py(), table["range"][0].as_py()
        trie = merged([Trie.read(x.as_py()) for x in table["trie"]])
        totals = trie.totals()
        shared = [set() for _ in range(DEPTH)]
        for bound in self.bounds[max(0, i - 1) : i + 1]:
            for d, node in enumerate(trie.along(np.frombuffer(bound.ljust(4 * DEPTH, b"\0"), ">u4"))):
                shared[d].add(node)
        paths, f, left, cut = [], [], [], []
        for d in range(DEPTH):
            known = (totals[d] >= self.least) & ((trie.keys[d] & 0xFFFFFFFF) > 0)
            known[list(shared[d])] = True
            at = np.flatnonzero(known)
            cut += [int(x) in shared[d] for x in at]
            f.append(totals[d][at])
            words, counts, node = [], [], at
            for e in reversed(range(d + 1)):
                words.append(trie.keys[e][node] & 0xFFFFFFFF)
                counts.append(totals[e][node])
                node = trie.keys[e][node] >> 32
            paths += np.stack(words[::-1], 1).tolist()
            left += np.stack(counts[::-1], 1)[:, :-1].tolist()
        out = pa.table({"lang": pa.array([lang] * len(cut), pa.string()), "path": pa.array(paths, pa.list_(pa.int64())), "f": pa.array(np.concatenate(f), pa.int64()), "left": pa.array(left, pa.list_(pa.int64())), "cut": pa.array(cut, pa.bool_())})
        del trie, totals
        trim()
        return out


def _bounds(samples: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 paths at quantiles of the sample, of which a bounded number is drawn by hash and sorted by Spark."""
    if ranges < 2:
        return []
    most = ranges * RANGE_SAMPLE
    n = samples.agg(F.sum(F.size("sample"))).first()[0] or 0
    each = samples.select("shard", F.posexplode("sample").alias("_i", "path"))
    if n > most:
        each = each.filter(F.pmod(F.xxhash64("shard", "_i"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    cuts = each.groupBy("path").agg(F.count("*").alias("n")).orderBy("path").toLocalIterator()
    out, seen, share = [], 0, max(1.0, min(n, most) / ranges)
    for r in cuts:
        if seen >= share * (len(out) + 1):
            out.append(bytes(r["path"]))
            while seen >= share * (len(out) + 1):
                seen -= share
        seen += r["n"]
    return out[: ranges - 1]


def phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", shard_text: int = SHARD_TEXT, range_paths: int = RANGE_PATHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, words, totals): the words and phrases of up to DEPTH words that occur ``least`` times in their language.

    nodes: (lang, path, f, left) with ids for words, the number of occurrences, overlaps included, and those of the first 1, 2, ... words. words: (lang, word, id). totals:
    (lang, n), all words of a language. All three are tables in the shared scratch folder.

    A-Z are lower-cased; ``[.,;:!?]`` and line ends end a piece, spaces and tabs a word. Null texts are empty, a null language is ``und``. A text is cut into words whole, however long it is, in
    one task. Rows that repeat count as often as they are there; an empty table gives empty ones. No other column plays a part.
    """
    plain = Plain(docs, [], [])
    rows = plain.rows.select(F.coalesce(F.col(plain.at(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.col(plain.at(text_col)).alias("text"))
    buckets = pieces(text_bytes(rows, "text"), BUCKET_TEXT, 16)
    made = materialise(rows.mapInArrow(lambda batches: shards(batches, buckets, shard_text), SHARDS))
    own = made.filter("bucket IS NULL").select(F.col("shard").alias("own"), "lang", "codes")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces(own.count(), 8))
    sent = made.filter("bucket IS NOT NULL").select("shard", "lang", "bucket", "words", "counts", "at")
    known = materialise(sent.groupBy("bucket").applyInArrow(lambda table: vocabulary(table, least, buckets), KNOWN))
    answers, words = known.filter("shard IS NOT NULL").select("shard", "at", "ids"), known.filter("shard IS NULL").select("lang", "word", "id")
    ids = materialise(own.repartition(parts, "own").groupBy("own").cogroup(answers.repartition(parts, "shard").groupBy("shard")).applyInArrow(coded, CODED))
    totals = materialise(ids.groupBy("lang").agg(F.sum("words").alias("n")))
    release(made)
    n = ids.agg(F.sum("n")).first()[0] or 0
    ranges = Ranges(_bounds(ids.select("shard", "sample"), min(MOST_RANGES, pieces(n, range_paths))), least)
    # a lambda: Spark counts a bound method's self as an argument
    tries = ids.select("lang", "ids").mapInArrow(lambda batches: ranges.cut(batches), "range int, lang string, trie binary")
    found = materialise(tries.groupBy("range", "lang").applyInArrow(lambda table: ranges.count(table), NODES))
    release(ids)
    # a row for each level of each bound and side of it: their number follows the number of ranges
    through = found.filter("cut").groupBy("lang", "path").agg(F.sum("f").alias("total"), F.first("left").alias("left"))
    through = bounded(materialise(through.filter(F.col("total") >= least)), 120)
    whole = found.filter("NOT cut").select("lang", "path", "f", "left").unionByName(through.select("lang", "path", F.col("total").alias("f"), "left"))
    # the nodes above one that a bound runs through are of this kind themselves
    above = lambda k: F.slice("path", 1, k)
    for k in range(1, DEPTH):
        sums = through.filter(F.size("path") == k).select("lang", F.col("path").alias("_above"), "total")
        whole = whole.withColumn("_above", F.when(F.size("path") > k, above(k))).join(sums, ["lang", "_above"], "left")
        whole = whole.withColumn("left", F.transform("left", lambda x, i: F.when((i == k - 1) & F.col("total").isNotNull(), F.col("total")).otherwise(x))).drop("_above", "total")
    return materialise(whole), words, totals


def _contained(candidates: DataFrame) -> DataFrame:
    """(lang, path, f): what lies in a candidate one word longer that is as frequent. A longer one that holds a phrase and is as frequent
    holds one of these between them, which is then as frequent as both."""
    inner = F.explode(F.array(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1)))
    return candidates.filter(F.size("path") > 2).select("lang", inner.alias("path"), "f")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", shard_text: int = SHARD_TEXT, range_paths: int = RANGE_PATHS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to DEPTH words.

    Cut after its first k words, a phrase of frequency a has parts of frequencies l and r, and the score floor(1000 a n / (l r)); the lowest-scoring cut counts, of equal ones the first. Phrases
    inside a longer one that is as frequent are left out. Ranks go by score and frequency, both descending, then by the phrase's bytes. See ``phrases`` for what a word is and for null and empty values.
    """
    nodes, words, totals = phrases(docs, least, text_col, lang_col, shard_text, range_paths)
    candidates = nodes.filter(F.size("path") > 1)
    kept = candidates.join(_contained(candidates), ["lang", "path", "f"], "left_anti")
    cuts = kept.select("lang", "path", F.col("f").alias("a"), F.posexplode("left").alias("k", "l"))
    # the k-th suffix link of a phrase leads to its words from the k-th on
    right = nodes.select("lang", F.col("path").alias("_rest"), F.col("f").alias("r"))
    cuts = cuts.withColumn("_rest", F.slice("path", F.col("k") + 2, F.size("path") - F.col("k") - 1)).join(right, ["lang", "_rest"])
    cuts = cuts.join(bounded(totals, 60), "lang")
    cuts = cuts.withColumn("score", F.expr("CAST(1000 * a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    lowest = cuts.groupBy("lang", "path", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spelt = lowest.select("*", F.posexplode("path").alias("_i", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "path", "a", "n", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    # a language may hold most phrases: each part of it gives its own best, so one task ranks ``top`` of each part at most
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("b.score"), F.desc("a"), F.asc("phrase")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))).filter(F.col("rank") <= top)
    out = best(best(spelt.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))), "_part"))
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
