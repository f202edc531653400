"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. In each state it follows the output links, from the longest piece that
ends there to the shortest, and each of these relaxes the best score of the position. A position that no
single-character piece covers is relaxed by an unknown character, which becomes byte pieces. Scores are
those of the model file, summed as doubles, and among segmentations of the same score the one with the longest last piece wins.

Many strings go through the automaton at once, a character each per step, as NumPy arrays. Texts are
first cut where no piece can lie across: between a character and the space mark after it (and around line
breaks) if no piece has that pair of characters, so the cut changes no result; else they stay whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Plain, trim

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the lowest score of a piece: what an unknown character costs.
UNKNOWN_PENALTY = 10.0
#: Pieces of this many strings are remembered by a task.
CACHE_ENTRIES = 100_000
#: Characters that go through the automaton at once.
STEP_CHARS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints for varints, bytes for the rest."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model, and the automaton over those that a text can hold."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.pieces, self.dummy_prefix = pieces, dummy_prefix
        self.byte_ids = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.unknown_score = min([0.0, *(s for _, s, kind in pieces if kind == NORMAL)]) - UNKNOWN_PENALTY
        words = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p]
        self._build(words)
        text = "\n".join(p for p, _, _ in words)
        if re.search(f"[^{SPACE}\n]{SPACE}", text):
            self.cuts = None
        elif any("\n" in p for p, _, _ in words):
            self.cuts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cuts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """From a ``.model`` file. Models that rewrite characters (a normalisation table) are refused."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, dummy = [], True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 3:
                own = dict(_fields(value))
                dummy = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models that keep all characters and spaces are supported")
        return cls(pieces, dummy)

    def _build(self, words: list[tuple[str, float, int]]) -> None:
        children: list[dict[str, int]] = [{}]
        piece = [-1]
        for p, _, i in words:
            state = 0
            for ch in p:
                nxt = children[state].get(ch)
                if nxt is None:
                    nxt = children[state][ch] = len(children)
                    children.append({})
                    piece.append(-1)
                state = nxt
            piece[state] = i
        n = len(children)
        fail, link = [0] * n, [0] * n  # link: the nearest state down the fail links that ends a piece, 0 if none
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for ch, nxt in children[state].items():
                if state:
                    f = fail[state]
                    while f and ch not in children[f]:
                        f = fail[f]
                    fail[nxt] = children[f].get(ch, 0)
                f = fail[nxt]
                link[nxt] = f if piece[f] >= 0 else link[f]
                queue.append(nxt)
        self.fail, self.link = np.array(fail, np.int32), np.array(link, np.int32)
        self.piece = np.array(piece, np.int32)
        self.length = np.zeros(n, np.int32)
        self.score = np.zeros(n)
        for s in range(n):
            if piece[s] >= 0:
                self.length[s], self.score[s] = len(self.pieces[piece[s]][0]), self.pieces[piece[s]][1]
        edges = [(s << 21 | ord(ch), nxt) for s, own in enumerate(children) for ch, nxt in own.items()]
        bits = max(4, int(np.ceil(np.log2(len(edges) * 2 + 2))))
        self._shift = np.uint64(64 - bits)
        self._keys, self._next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for slot, (key, nxt) in zip(self._slot(np.array([k for k, _ in edges], np.int64)).tolist(), edges, strict=True):
            while self._keys[slot] >= 0:
                slot = (slot + 1) & (len(self._keys) - 1)
            self._keys[slot], self._next[slot] = key, nxt
        self.piece_ids = {p: i for p, _, i in words}
        self._merge_scores = {p: x for p, x, _ in words if len(p) > 1}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _goto(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next state of each; follows fail links until there is an edge or the root is left without."""
        out = np.zeros(len(state), np.int32)
        todo = np.arange(len(state))
        while len(todo):
            keys = state[todo].astype(np.int64) << 21 | char[todo]
            slot = self._slot(keys)
            found = np.full(len(todo), -1, np.int32)
            open_ = np.arange(len(todo))
            while len(open_):
                at = self._keys[slot[open_]]
                hit = at == keys[open_]
                found[open_[hit]] = self._next[slot[open_[hit]]]
                open_ = open_[~hit & (at >= 0)]
                slot[open_] = (slot[open_] + 1) & (len(self._keys) - 1)
            ok = found >= 0
            out[todo[ok]] = found[ok]
            rest = ~ok & (state[todo] > 0)
            todo = todo[rest]
            state = state.copy() if len(todo) else state
            state[todo] = self.fail[state[todo]]
        return out

    def segment(self, strings: list[str]) -> list[bytes]:
        """The ids of each string's best segmentation, as the bytes of int32 numbers."""
        out: list[bytes] = [b""] * len(strings)
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        at = 0
        while at < len(order):
            end, widest = at, 0
            while end < len(order) and (end == at or (end - at + 1) * (len(strings[order[end]]) + 1) <= STEP_CHARS):
                widest, end = len(strings[order[end]]), end + 1
            self._segment([strings[i] for i in order[at:end]], widest, order[at:end], out)
            at = end
        return out

    def _segment(self, strings: list[str], width: int, places: list[int], out: list[bytes]) -> None:
        """``strings`` by length, ascending; a column of ``best`` and ``from_`` per position."""
        n = len(strings)
        lengths = np.array([len(s) for s in strings])
        codes = np.zeros((width, n), np.int64)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[col, row] = flat
        best = np.full((width + 1, n), -np.inf)
        via = np.zeros((width + 1, n), np.int32)  # the state whose piece ends here; 0: an unknown character
        best[0] = 0.0
        state = np.zeros(n, np.int32)
        for t in range(width):
            first = np.searchsorted(lengths, t, "right")
            live = np.arange(first, n)
            now = self._goto(state[first:], codes[t, first:])
            state[first:] = now
            score, back = best[t, first:] + self.unknown_score, np.zeros(len(live), np.int32)
            ends = np.where(self.piece[now] >= 0, now, self.link[now])
            single = np.zeros(len(live), bool)
            todo = np.flatnonzero(ends)
            better = np.full(len(live), -np.inf)
            while len(todo):
                s = ends[todo]
                size = self.length[s]
                single[todo] |= size == 1
                candidate = best[t + 1 - size, first + todo] + self.score[s]
                gain = candidate > better[todo]
                better[todo[gain]], back[todo[gain]] = candidate[gain], s[gain]
                ends[todo] = self.link[s]
                todo = todo[ends[todo] > 0]
            unknown = ~single & (score > better)
            best[t + 1, first:] = np.where(unknown, score, better)
            via[t + 1, first:] = np.where(unknown, 0, back)
        for j, s in enumerate(strings):
            ids, end, path = [], len(s), via[:, j].tolist()
            while end:
                v = path[end]
                if v:
                    ids.append(int(self.piece[v]))
                    end -= int(self.length[v])
                else:
                    ids.extend(reversed(self._bytes(s[end - 1])))
                    end -= 1
            out[places[j]] = np.array(ids[::-1], np.int32).tobytes()

    def merge_segment(self, s: str) -> bytes:
        """The ids of a string by merging: the neighbours whose union is the best-scored piece first, from the left among equal ones."""
        scores = self._merge_scores
        text, after, before = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(s) and (union := text[i] + text[j]) in scores:
                heapq.heappush(heap, (-scores[union], i, union))

        for i in range(len(s)):
            offer(i)
        while heap:
            _, i, union = heapq.heappop(heap)
            j = after[i] if text[i] else len(s)
            if j >= len(s) or text[i] + text[j] != union:  # one of the two has been merged meanwhile
                continue
            text[i], text[j], after[i] = union, "", after[j]
            if after[i] < len(s):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids: list[int] = []
        for x in text:
            if x:
                ids += [self.piece_ids[x]] if x in self.piece_ids else [b for ch in x for b in self._bytes(ch)]
        return np.array(ids, np.int32).tobytes()

    def _bytes(self, ch: str) -> list[int]:
        data = ch.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in data] if all(b in self.byte_ids for b in data) else [self.unknown_id]

    def encode_batch(self, texts: list[str | None], cache: dict[str, bytes], merges: bool = False) -> list[bytes | None]:
        split: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if text is None:
                split.append(None)
                continue
            s = (SPACE + text if self.dummy_prefix and text else text).replace(" ", SPACE)
            own = self.cuts.findall(s) if self.cuts else [s] * bool(s)
            split.append(own)
            new.update(own)
        new.difference_update(cache)
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = {c for own in split if own for c in own}
        todo = list(new)
        cache.update(zip(todo, map(self.merge_segment, todo) if merges else self.segment(todo), strict=True))
        return [None if own is None else b"".join(map(cache.__getitem__, own)) for own in split]

    def encode(self, text: str, merges: bool = False) -> list[int]:
        return np.frombuffer(self.encode_batch([text], {}, merges)[0], np.int32).tolist()

    def decoder(self) -> list[bytes]:
        """What each id stands for, as bytes; control pieces for nothing."""
        table = []
        for p, _, kind in self.pieces:
            if kind == BYTE:
                table.append(bytes([int(p[3:-1], 16)]))
            elif kind == CONTROL:
                table.append(b"")
            elif kind == UNKNOWN:
                table.append(" ⁇ ".encode())
            else:
                table.append(p.replace(SPACE, " ").encode())
        return table

    def decode(self, ids: list[int], table: list[bytes] | None = None) -> str:
        table = table or self.decoder()
        data = b"".join(map(table.__getitem__, ids))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _list_array(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if p is None else len(p) // 4 for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), np.int32))
    mask = pa.array([p is None for p in parts])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", keep: list[str] | None = None, merges: bool = False) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all but the text), then n_pieces long, ids array<int>, round_trip boolean.

    ``merges``: segment as BPE models do by themselves, not by the best score.

    A null text has null ids, 0 pieces and a null round_trip; an empty one no ids. ``round_trip``: decoding gives the text
    back; false where the text itself holds the space mark U+2581, which stands for a space. Rows stay
    as they are, repeated or not. A text of any length is taken whole. A kept column called n_pieces, ids or round_trip
    comes out with ``_in`` behind it.
    """
    plain = Plain(docs, [c for c in docs.columns if c != text_col] if keep is None else keep, ["n_pieces", "ids", "round_trip"])
    rows = plain.rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(plain.kept)], F.col(plain.at(text_col)).alias("_text"))
    schema = plain.schema(T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}
        table = model.decoder()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in _spans(texts):
                own = texts.slice(lo, hi - lo).to_pylist()
                parts = model.encode_batch(own, cache, merges)
                same = [None if t is None else model.decode(np.frombuffer(p, np.int32).tolist(), table) == t for t, p in zip(own, parts, strict=True)]
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                ids = _list_array(parts)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(p or b"") // 4 for p in parts], pa.int64()), ids, pa.array(same, pa.bool_())], names=names)
                del own, parts, same, columns, ids
            del batch, texts
            trim()
        cache.clear()
        trim()

    return rows.mapInArrow(run, schema)


def _spans(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    sizes = np.array([0 if s is None else s for s in pc.binary_length(texts).to_pylist()], np.int64)
    part = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    yield from zip(starts, [*starts[1:], len(sizes)], strict=True)


def decode(rows: DataFrame, model: PieceModel, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give a null text. A column called ``out_col`` comes out with ``_in`` behind it."""
    plain = Plain(rows, rows.columns, [out_col])
    schema = plain.schema(T.StructField(out_col, T.StringType()))
    names, place = schema.names, rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.decoder()
        for batch in batches:
            texts = [None if ids is None else model.decode(ids, table) for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return plain.rows.mapInArrow(run, schema)
