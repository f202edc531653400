"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, counted in Spark.

Texts are dealt once to chunks of about CHUNK_TEXT bytes by a hash of the row; the three passes below
read that one exchange.

1. A chunk sends the distinct hashes of its windows, cut to 32 bits beside the bits that choose a bucket, to the buckets
   as packed arrays. A bucket answers each chunk with one bit per hash: whether another one equals it.
   Windows that really repeat in several chunks always get a 1; one in a thousand or so of the others does, too. What repeats
   within a chunk the chunk knows itself.
2. The windows that may repeat are sent again, with 128 bits and the smallest doc_id that the chunk has for them. A bucket finds
   the smallest doc_id of all and answers with a bit for each window: whether it lies below the chunk's.
3. A chunk marks the words covered by windows that start in a document with a smaller doc_id; overlapping windows merge into
   maximal intervals, and the other words are kept.

All that is sent is a function of the *set* of a chunk's rows, sorted by hash, so answers fit whatever order the rows
arrive in: after a retry, a spill, or from another executor. An answer carries a checksum of what it answers, and a chunk
that has other windows fails rather than takes it.

A chunk sends a window once, however often it has it, so a passage that many documents share costs its buckets a few bytes per
chunk; its windows have different hashes, which spread over the buckets. Rows too short for a window
never leave their task. Ids that many rows share are dealt to several chunks. No text and no pair of documents ever meets another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Plain, bounded, materialise, pieces, text_bytes, trim
from .fingerprints import U, column_words

#: Bytes of text that a chunk is meant to hold.
CHUNK_TEXT = 2 << 20
#: Text that a partition of the exchange is meant to hold; it holds whole chunks.
PARTITION_TEXT = 256 << 20
#: Windows that a bucket is meant to hold; a word has about six bytes.
BUCKET_WINDOWS = 4 << 20
#: Rows of one id from which they are dealt to several chunks.
HOT_ROWS = 1024
NULL_ID = np.iinfo(np.int64).max  # a null doc_id is smaller than none


def _windows(text: pa.ChunkedArray, window: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column's whole windows in order: hash, row, first word (counted in the row)."""
    hashes, rows, words = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, _, w in column_words(text, family=family):
        own = np.maximum(np.diff(w.first) - window + 1, 0)
        row = np.repeat(np.arange(len(own)), own)
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        hashes.append(w.windows(window)[w.first[row] + at] if len(row) else np.zeros(0, U))
        rows.append(row + lo)
        words.append(at)
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(words)


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start and end."""
    edge = np.flatnonzero(ascending[1:] != ascending[:-1]) + 1
    return np.concatenate([[0], edge])[: len(ascending)].astype(np.int64), np.concatenate([edge, [len(ascending)]])[: len(edge) + bool(len(ascending))]


def _checksum(values: np.ndarray) -> int:
    return int(values.sum(dtype=U).view(np.int64)) ^ len(values)


ANSWER = "chunk int, kind int, bucket int, proof long, bits binary"
SENT = "chunk int, bucket int, hashes binary"
SENT_AGAIN = "chunk int, bucket int, hashes binary, sizes binary, ids binary"


class Passes:
    """What chunks and buckets do with their rows; ``bits``: of a hash, those that choose the bucket."""

    def __init__(self, window: int, bits: int):
        self.window, self.bits = window, bits

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def low(self, hashes: np.ndarray) -> np.ndarray:
        """The 32 bits after the bucket's."""
        return (hashes >> U(32 - self.bits)).astype(np.uint32)

    def _sent(self, ascending: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        starts, ends = _runs(self.bucket(ascending))
        low = self.low(ascending)
        return self.bucket(ascending[starts]).tolist(), [low[a:b] for a, b in zip(starts, ends, strict=True)]

    def first_pass(self, table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        buckets, parts = self._sent(np.unique(_windows(table["_text"], self.window)[0]))
        return pa.table({"chunk": pa.array([chunk] * len(parts), pa.int32()), "bucket": pa.array(buckets, pa.int32()), "hashes": pa.array([p.tobytes() for p in parts], pa.binary())})

    def first_count(self, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        same = values[order[1:]] == values[order[:-1]]
        flag = np.zeros(len(values), bool)
        flag[order[1:]] = same
        flag[order[:-1]] |= same
        return self._answers(table, flag, parts, 1)

    @staticmethod
    def _answers(table: pa.Table, flags: np.ndarray, parts: list[np.ndarray], kind: int) -> pa.Table:
        cuts = np.split(flags, np.cumsum([len(p) // kind for p in parts])[:-1])  # in the second pass two numbers are a hash
        n = table.num_rows
        proof, bits = [_checksum(p) for p in parts], [np.packbits(c).tobytes() for c in cuts]
        return pa.table({"chunk": table["chunk"], "kind": pa.array([kind] * n, pa.int32()), "bucket": table["bucket"], "proof": pa.array(proof, pa.int64()), "bits": pa.array(bits, pa.binary())})

    @staticmethod
    def _answered(answers: pa.Table, kind: int, buckets: list[int], parts: list[np.ndarray]) -> np.ndarray:
        """The bits of all ``parts`` in order."""
        known = {b: (p, x) for k, b, p, x in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "proof", "bits")), strict=True) if k == kind}
        out = [np.zeros(0, bool)]
        for b, part in zip(buckets, parts, strict=True):
            proof, x = known.get(b, (None, b""))
            if proof != _checksum(part):
                raise RuntimeError(f"bucket {b} answered other windows than the chunk has: its rows changed between the passes")
            out.append(np.unpackbits(np.frombuffer(x, np.uint8), count=len(part) // kind).astype(bool))
        return np.concatenate(out)

    def _candidates(self, table: pa.Table, answers: pa.Table) -> dict:
        """The windows that may repeat (row, word, id), and the distinct ones among them, by bucket, smallest id and hash."""
        hashes, row, word = _windows(table["_text"], self.window)
        distinct, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
        buckets, parts = self._sent(distinct)
        flag = (self._answered(answers, 1, buckets, parts) | (count > 1))[place]
        hashes, row, word = hashes[flag], row[flag], word[flag]
        rows, own = np.unique(row, return_inverse=True)
        again, row2, word2 = _windows(table["_text"].take(pa.array(rows)), self.window, family=1)
        # a row's windows stand in order, so its k-th one is at the row's first place + k
        second = again[np.searchsorted(row2, np.arange(len(rows)))[own] + word] if len(rows) else np.zeros(0, U)
        ids = table["_id"].to_numpy()[row]
        order = np.lexsort((ids, second, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        lead = order[new]  # of each distinct window, the one with the smallest id
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        by = np.lexsort((second[lead], hashes[lead], ids[lead], self.bucket(hashes[lead])))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        lead = lead[by]
        return {"row": row, "word": word, "id": ids, "entry": rank[entry], "h1": hashes[lead], "h2": second[lead], "least": ids[lead]}

    def _packed(self, c: dict) -> tuple[list[int], list[np.ndarray], list[tuple[int, int]]]:
        """Of each bucket with candidates: its number, the hashes (h1, h2 in turn), its range of entries."""
        bucket = self.bucket(c["h1"])
        spans = list(zip(*(x.tolist() for x in _runs(bucket)), strict=True))
        return [int(bucket[a]) for a, _ in spans], [np.stack([c["h1"][a:b], c["h2"][a:b]], 1).ravel() for a, b in spans], spans

    def second_pass(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        c = self._candidates(table, answers)
        buckets, parts, spans = self._packed(c)
        sizes, ids = [], []
        for a, b in spans:
            starts, ends = _runs(c["least"][a:b])
            sizes.append((ends - starts).astype(np.int32).tobytes())
            ids.append(c["least"][a:b][starts].tobytes())
        columns = [pa.array([table["_chunk"][0].as_py()] * len(parts), pa.int32()), pa.array(buckets, pa.int32()), *(pa.array(x, pa.binary()) for x in ([p.tobytes() for p in parts], sizes, ids))]
        return pa.table(dict(zip((f.split()[0] for f in SENT_AGAIN.split(", ")), columns, strict=True)))

    def second_count(self, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, U) for x in table["hashes"].to_pylist()]
        ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(s, np.int32)) for i, s in zip(table["ids"].to_pylist(), table["sizes"].to_pylist(), strict=True)])
        both = np.concatenate(parts)
        h1, h2 = both[::2], both[1::2]
        order = np.lexsort((ids, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        later = np.empty(len(order), bool)
        later[order] = ids[order] > ids[order[new]][np.cumsum(new) - 1]
        return self._answers(table, later, parts, 2)

    def third_pass(self, table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(row, first word) of the windows to remove, by row."""
        c = self._candidates(table, answers)
        buckets, parts, _ = self._packed(c)
        later = self._answered(answers, 2, buckets, parts)
        gone = later[c["entry"]] | (c["id"] > c["least"][c["entry"]])
        return c["row"][gone], c["word"][gone]


NEW = ["n_words", "n_removed", "kept_text", "kept_sha256", "spans"]
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def _cut(texts: list[str | None], row: np.ndarray, word: np.ndarray, window: int) -> list[pa.Array]:
    """The new columns of texts that lose the windows at (row, word), given by row."""
    starts = np.searchsorted(row, np.arange(len(texts) + 1))
    n_words, n_removed, kept, digests, cut = [], [], [], [], []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        first = word[starts[i] : starts[i + 1]]
        found: list[dict] = []
        words_kept = words
        if len(first):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + window, -1)
            change = np.flatnonzero(np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0)).tolist()
            found = [{"first": a, "past": b} for a, b in zip(change[::2], change[1::2], strict=True)]
            edges = [0, *change, len(words)]
            words_kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
        text_kept = b" ".join(words_kept)
        n_words.append(len(words))
        n_removed.append(len(words) - len(words_kept))
        kept.append(text_kept.decode("utf-8", "surrogatepass"))
        digests.append(hashlib.sha256(text_kept).hexdigest())
        cut.append(found)
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string()), pa.array(cut, _SPANS)]


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all but the text), then n_words, n_removed, kept_text, kept_sha256, spans.

    A word is removed if a window that covers it has a word sequence that also starts in a row with a
    smaller id; windows are judged on the input, and compared by 128 bits of hash. ``spans``: the maximal removed intervals
    as (first word, one past the last). ``kept_text``: the kept words
    joined by one space; ``kept_sha256``: of its UTF-8, lowercase hex. A null text has no words; a text of
    fewer words than ``window`` has no window; a text of any length is taken whole, alone in its chunk if it is longer than one.
    Rows with equal ids never remove each other's words, nor
    does a row its own. A row with a null id loses words to rows with an id, and takes none. Repeated rows stay. A kept column
    with a new one's name comes out with ``_in`` behind it.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    plain = Plain(docs, keep, NEW)
    id_, text = plain.at(id_col), plain.at(text_col)
    total = text_bytes(plain.rows, text)
    chunks = pieces(total, CHUNK_TEXT)
    bits = max(0, int(np.ceil(np.log2(max(1, total / 6 / BUCKET_WINDOWS)))))
    passes = Passes(window, bits)
    kept = plain.kept
    rows = plain.rows.select(*[c for c in dict.fromkeys(kept) if c != text], F.coalesce(F.col(id_).cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text"))
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType(), spans]
    schema = plain.schema(*(T.StructField(n, t) for n, t in zip(NEW, kinds, strict=True)))

    names = schema.names

    def finished(table, row: np.ndarray, word: np.ndarray) -> list[pa.Array]:
        new = _cut(table["_text"].to_pylist(), row, word, window)
        return [*(table["_text" if c == text else c] for c in kept), *new]

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(finished(batch, np.zeros(0, np.int64), np.zeros(0, np.int64)), names=names)

    def third_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table(dict(zip(names, finished(table, *passes.third_pass(table, answers)), strict=True)))

    has_window = F.coalesce(F.octet_length("_text") >= 2 * window - 1, F.lit(False))
    short = rows.filter(~has_window).mapInArrow(untouched, schema)
    long = _dealt(rows.filter(has_window), rows, chunks, pieces(total, PARTITION_TEXT))

    def frugal(f):
        """``f`` of a table, and its memory back afterwards."""

        def run(table: pa.Table) -> pa.Table:
            out = f(table)
            del table
            trim()
            return out

        return run

    def frugal_two(f):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            out = f(table, answers)
            del table, answers
            trim()
            return out

        return run

    # answers go to chunks that asked, so every group below has its texts
    by_chunk = long.groupBy("_chunk")
    sent = by_chunk.applyInArrow(frugal(passes.first_pass), SENT)
    known = sent.groupBy("bucket").applyInArrow(frugal(passes.first_count), ANSWER)
    again = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(frugal_two(passes.second_pass), SENT_AGAIN)
    later = again.groupBy("bucket").applyInArrow(frugal(passes.second_count), ANSWER)
    answers = known.unionByName(later)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(frugal_two(third_pass), schema).unionByName(short)


def _dealt(rows: DataFrame, all_rows: DataFrame, chunks: int, partitions: int) -> DataFrame:
    """``rows`` with the ``_chunk`` of each, in whole chunks by partition."""
    salt = F.lit(0)
    hot = all_rows.groupBy("_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS)
    if hot.limit(1).count():
        # which of an id's equal rows goes where is chosen once, and written
        numbered = rows.join(bounded(hot, 16), "_id", "left").withColumn("_salt", F.when(F.col("_n") > 0, F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_n") / HOT_ROWS))).otherwise(0))
        rows, salt = materialise(numbered.drop("_n")), F.col("_salt")
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_text", salt), F.lit(chunks)).cast("int")).drop("_salt")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(min(chunks, max(least, partitions)), "_chunk")
