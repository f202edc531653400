"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words of letters of a text, cut to their first STEM letters, which stand for their stem. All terms of
the examples, toxic and clean, span the vectors; a weight is tf * idf, with document frequencies counted over all documents
and smoothed by SMOOTHING of their number. Examples with the same vector
form one entry that carries how many of them are toxic, so ties need no arbitrary choice.

The index keeps, for each term, postings in order of entry, cut into blocks of entries, and the largest
weight in each block; terms that many entries have keep a block's postings as a dense row. For a text, short lists are merged at once.
The bound of a block is the sum over the other terms of the text's weight times the block's largest, and the best that the
short lists give in the block; the blocks of highest bounds are opened first, then all whose bound reaches the k-th best cosine found there.
Cosines are computed in single precision with a rigorous bound on the error, and again in double precision for all entries
that may be among the nearest, so the result is exact. The nearest entries vote with their cosine squared, and an isotonic
fit of leave-one-out votes on the examples makes the share of toxic votes a probability. The entries are the evidence.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Plain, materialise, release, trim

#: Labelled rows that the classifier is fitted on: at most so many, in order of a hash of their id.
MAX_EXAMPLES = 4_096
STEM = 4
#: Added to document frequencies, as a share of all documents: keeps what is rare by chance from outweighing everything.
SMOOTHING = 0.01
NEIGHBOURS = 8
BLOCK = 128
#: Blocks opened before the others are judged by what these gave.
FIRST_BLOCKS = 2
#: Terms that more than one in so many entries have keep dense rows.
DENSE_SHARE = 16
#: Texts searched together.
TEXTS = 64

#: Bytes of text that are cut into words at once; a longer text is cut alone.
TEXT_BYTES = 1 << 20

Terms = tuple[tuple[int, int], ...]


def stem(word: str) -> str:
    return word[:STEM]


def stems(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, stem) of every word of an Arrow array of texts; a null text has none. There may be empty stems."""
    words = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+")
    cut = pc.utf8_slice_codeunits(words.flatten(), 0, STEM)
    return np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy())), cut


def spans(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of at most TEXTS rows and about TEXT_BYTES."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = int(sizes[lo - 1]) if lo else 0
        hi = min(lo + TEXTS, max(lo + 1, int(np.searchsorted(sizes, before + TEXT_BYTES, "right"))))
        yield texts.slice(lo, hi - lo)
        lo = hi


class Vocabulary:
    """The terms; finds them in texts."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}

    def __getstate__(self) -> dict:
        return {"ids": self.ids}

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the known terms, by text and term."""
        if not hasattr(self, "_values"):
            self._values = pa.array(list(self.ids), pa.string())
        who, cut = stems(texts)
        term = pc.index_in(cut, value_set=self._values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        room = len(self.ids) + 1
        key, count = np.unique(who[term >= 0] * room + term[term >= 0], return_counts=True)
        return key // room, key % room, count

    def find(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text an array of (term, count), by term."""
        who, term, count = self.numbers(texts)
        return np.split(np.stack([term, count], 1), np.searchsorted(who, np.arange(1, len(texts)))) if len(texts) else []


_BUILT: dict[str, tuple] = {}  # of the last index that a worker used: what isn't sent with it


class BlockMaxIndex:
    """Entries with unit vectors, how many examples each stands for and how many of these are toxic."""

    def __init__(self, entries: list[tuple[Terms, int, int, int]], idf: np.ndarray, prior: float):
        """``entries``: (terms, examples, toxic ones, smallest id); the one without terms, if any, is no neighbour."""
        self.idf, self.prior, self.name = idf, prior, uuid.uuid4().hex
        self.empty = next(((n, y) for terms, n, y, _ in entries if not terms), (0, 0))
        # neighbours in the order of entries share their strongest terms, which keeps the blocks' bounds tight
        vectors = [(self.vector(terms), terms, n, y, i) for terms, n, y, i in entries if terms]
        strongest = [tuple(v[0][np.argsort(-v[1], kind="stable")[:3]].tolist()) for v, *_ in vectors]
        vectors = [vectors[k] for k in sorted(range(len(vectors)), key=lambda k: (strongest[k], vectors[k][1]))]
        self.n = np.array([e[2] for e in vectors], float)
        self.y = np.array([e[3] for e in vectors], float)
        self.id = [e[4] for e in vectors]
        self.terms = [e[1] for e in vectors]
        self.blocks = -(-len(vectors) // BLOCK)
        self.first = np.cumsum([0, *(len(e[0][0]) for e in vectors)])
        self.own_terms = np.concatenate([np.zeros(0, np.int32), *(e[0][0] for e in vectors)]).astype(np.int32)
        self.own_weights = np.concatenate([np.zeros(0), *(e[0][1] for e in vectors)])

    def _lists(self) -> tuple:
        """(place of a term among the dense ones or -1, dense rows by entry, their largest weights by block, starts, entries and
        weights of the short lists); built once in a process."""
        if self.name not in _BUILT:
            n_terms, n = len(self.idf), len(self.id)
            entry = np.repeat(np.arange(n), np.diff(self.first))
            df = np.bincount(self.own_terms, minlength=n_terms)
            frequent = np.flatnonzero(df * DENSE_SHARE > n)
            place = np.full(n_terms, -1)
            place[frequent] = np.arange(len(frequent))
            at = place[self.own_terms]
            dense = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
            dense[entry[at >= 0], at[at >= 0]] = self.own_weights[at >= 0]
            tops = dense.reshape(self.blocks, BLOCK, -1).max(1)
            short = np.flatnonzero(at < 0)
            short = short[np.argsort(self.own_terms[short], kind="stable")]
            starts = np.concatenate([[0], np.cumsum(np.where(place < 0, df, 0))])
            _BUILT.clear()
            _BUILT[self.name] = (place, dense, tops, starts, entry[short], self.own_weights[short])
        return _BUILT[self.name]

    def vector(self, terms: Terms | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.asarray(terms, np.int64).reshape(-1, 2)
        w = both[:, 1] * self.idf[both[:, 0]]
        return both[:, 0], w / math.sqrt(float(w @ w)) if len(w) else w

    def nearest(self, terms: Terms, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k entries of highest cosine above 0, and all that tie with the last; (cosine, entry), best first.

        ``without``: an entry left out.
        """
        return self.nearest_of([terms], k, [without])[0]

    def nearest_of(self, queries: list[Terms] | list[np.ndarray], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of many texts at once."""
        if not self.blocks:
            return [[] for _ in queries]
        place, dense, tops, starts, post_entry, post_weight = self._lists()
        vectors = [self.vector(q) for q in queries]
        n, width = len(queries), self.blocks * BLOCK
        sizes = np.array([len(ids) for ids, _ in vectors])
        who = np.repeat(np.arange(n), sizes)
        ids, w = (np.concatenate(x) for x in zip(*vectors, strict=True))
        at = place[ids]
        q = np.zeros((n, dense.shape[1]), np.float32)
        q[who[at >= 0], at[at >= 0]] = w[at >= 0]
        rest = at < 0
        lo, many = starts[ids[rest]], starts[ids[rest] + 1] - starts[ids[rest]]
        posting = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        merged = np.bincount(np.repeat(who[rest], many) * width + post_entry[posting], np.repeat(w[rest], many) * post_weight[posting], n * width).reshape(n, width).astype(np.float32)
        slack = np.float32((sizes.max(initial=0) + 4) * 2.0**-23)  # no vector is longer than 1
        bounds = q @ tops.T + merged.reshape(n, self.blocks, BLOCK).max(2) + slack
        scores = np.full((n, width), -1, np.float32)

        def open_blocks(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(0)).tolist():
                own, span = np.flatnonzero(which[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                scores[own, span] = q[own] @ dense[span].T + merged[own, span]

        def close() -> None:
            scores[:, len(self.id) :] = -1
            if without is not None:
                scores[np.flatnonzero(out >= 0), out[out >= 0]] = -1

        def floor(seen: np.ndarray) -> np.ndarray:
            kth = min(k, seen.shape[1])
            return np.partition(seen, seen.shape[1] - kth, 1)[:, seen.shape[1] - kth] - 2 * slack

        out = np.array(without if without is not None else [])
        best = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, best, True, 1)
        open_blocks(first)
        close()
        low = floor(np.take_along_axis(scores.reshape(n, self.blocks, BLOCK), best[:, :, None], 1).reshape(n, -1))
        open_blocks(~first & (bounds >= np.maximum(low, 0)[:, None]))
        close()
        low = floor(scores)
        found, own = [], np.zeros(len(self.idf))
        for row, (ids, w) in enumerate(vectors):
            near = np.flatnonzero(scores[row] >= max(low[row], 0))
            own[ids] = w
            exact = [float(self.own_weights[a:b] @ own[self.own_terms[a:b]]) for a, b in zip(self.first[near].tolist(), self.first[near + 1].tolist(), strict=True)]
            own[ids] = 0
            best = sorted((-c, e) for c, e in zip(exact, near.tolist(), strict=True) if c > 0)
            if len(best) > k:
                best = [x for x in best if x[0] <= best[k - 1][0] + 1e-12]
            found.append([(-c, e) for c, e in best])
        return found

    def votes(self, near: list[tuple[float, int]], minus: tuple[int, int, int] = (-1, 0, 0)) -> float:
        """The share of toxic votes; the prior where nobody votes. ``minus``: (entry, examples, toxic ones) not to count."""
        total = toxic = 0.0
        for cosine, e in near:
            gone = minus[1:] if e == minus[0] else (0, 0)
            total += cosine * cosine * (self.n[e] - gone[0])
            toxic += cosine * cosine * (self.y[e] - gone[1])
        return toxic / total if total > 0 else self.prior

    def empty_share(self) -> float:
        return (self.empty[1] + self.prior) / (self.empty[0] + 1.0)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """(x, mean y, weight) to the knots of the best rising step function, joined by straight lines."""
    pools: list[list[float]] = []  # x sum, y sum, weight
    for x, y, w in sorted(points):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [(p[1] + 0.5 * p[1] / p[2]) / (p[2] + 0.5) for p in pools]


class ToxicityModel:
    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, k: int = NEIGHBOURS):
        self.vocabulary, self.index, self.k = vocabulary, index, k
        points = [(index.empty_share(), index.empty[1] / index.empty[0], float(index.empty[0]))] if index.empty[0] else []
        for lo in range(0, len(index.terms), TEXTS):
            own = range(lo, min(lo + TEXTS, len(index.terms)))
            # an entry of one example is left out of its own search, one of several loses a vote there
            found = index.nearest_of([index.terms[e] for e in own], k, [e if index.n[e] == 1 else -1 for e in own])
            for e, near in zip(own, found, strict=True):
                n, y = int(index.n[e]), int(index.y[e])
                for label, count in ((1, y), (0, n - y)):
                    if count:
                        points.append((index.votes(near, (e, 1, label)), float(label), float(count)))
        index.terms = []  # only the votes above read them
        _BUILT.clear()
        self.xs, self.ys = isotonic(points) if points else ([0.0], [index.prior])

    def scores(self, texts: list[np.ndarray]) -> list[tuple[float, list[tuple[int, float, float]]]]:
        """Of each: the probability of label 1, and (example id, cosine, toxic share) of up to three nearest entries."""
        out = []
        for near in self.index.nearest_of(texts, self.k):
            raw = self.index.votes(near) if near else self.index.empty_share()
            p = min(1.0, max(0.0, float(np.interp(raw, self.xs, self.ys))))
            out.append((p, [(self.index.id[e], s, float(self.index.y[e] / self.index.n[e])) for s, e in near[:3]]))
        return out


def sample(labels: DataFrame, bound: int = MAX_EXAMPLES, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled ids, by a hash of the id. Null ids and labels are left out;
    an id with several labels is toxic if any says so."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows of ``docs``; the document frequencies are those of all rows.

    The examples are a sample bounded by ``max_examples``; what reaches the driver are their terms and counts. Rows that repeat
    a labelled id are examples, too. Without labelled rows every score is 0.5.
    """
    chosen = F.broadcast(sample(labels, max_examples, id_col, label_col))  # max_examples rows of two numbers
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    examples = materialise(texts.join(chosen, "doc_id"))
    pos, total = examples.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.unique(pa.concat_arrays([stems(x)[1] for x in spans(batch.column(0))])) if batch.num_rows else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([found], names=["term"])

    found = examples.select("text").mapInArrow(terms, "term string").filter("term <> ''").distinct().toArrow()["term"].to_pylist()
    vocabulary = Vocabulary(sorted(found))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.ravel().tolist() for part in spans(batch.column(2)) for x in vocabulary.find(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "label", "terms"])

    rows = examples.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, terms array<int>")
    grouped = rows.groupBy("terms").agg(F.count("*").alias("n"), F.sum("label").alias("y"), F.min("doc_id").alias("i")).toArrow()
    release(examples)
    size = len(found)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in spans(batch.column(0)):
                df += np.bincount(vocabulary.numbers(part)[1], minlength=size)
            del batch
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *own.tolist()], pa.int32()), pa.array([n, *df[own].tolist()], pa.int64())], names=["term", "n"])
        trim()

    counted = texts.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counted = dict(zip(counted["term"].to_pylist(), counted["n"].to_pylist(), strict=True))
    n = counted.get(-1, 0)
    base = 1 + n * SMOOTHING
    idf = np.array([math.log((n + base) / (counted.get(i, 0) + base)) + 0.05 for i in range(size)])
    entries = [(tuple(zip(t[::2], t[1::2], strict=True)), m, y, i) for t, m, y, i in zip(*(grouped[c].to_pylist() for c in ("terms", "n", "y", "i")), strict=True)]
    return ToxicityModel(vocabulary, BlockMaxIndex(entries, idf, pos / total if total else 0.5), k)


NEW = ["score", "predicted", "evidence"]


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all), then score double, predicted int, evidence array of (doc_id, cosine, toxic_share).

    Every row is scored by its whole text alone, however long; a null, empty or term-free text gets the score of examples without
    terms and no evidence. Repeated rows score alike. A kept column with a new one's name comes out with ``_in`` behind it.
    """
    plain = Plain(docs, docs.columns if keep is None else keep, NEW)
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic_share", T.DoubleType())]))
    schema = plain.schema(T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", evidence))
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[tuple] = []
            for part in spans(batch.column(batch.num_columns - 1)):
                scores += model.scores(model.vocabulary.find(part))
            found = pa.array([[{"doc_id": i, "cosine": c, "toxic_share": s} for i, c, s in e] for _, e in scores], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([p for p, _ in scores], pa.float64()), pa.array([int(p >= threshold) for p, _ in scores], pa.int32()), found], names=names)
            del batch, scores, found
        _BUILT.clear()  # an idle worker must not keep it beside the stages that follow
        trim()

    rows = plain.rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(plain.kept)], F.col(plain.at(text_col)).alias("_text"))
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
