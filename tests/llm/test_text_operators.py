"""Substring dedup, n-gram join, toxicity, SentencePiece: brute force, edge cases, empty tables."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelane.llm import fingerprints, ngram_join, substring_dedup, toxicity
from sievelane.llm.components import connected_components
from sievelane.llm.queries import PIECE_MODEL
from sievelane.llm.sentencepiece_codec import PieceModel, decode, encode

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde\u00e9") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 1, 3, 40, 120]))]
        if i % 4 == 1:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : rng.randint(55, 70)]
        if i % 5 == 2 and docs:
            w = WORD.findall(docs[rng.randrange(len(docs))][1] or "")
            if w and i % 2:
                w[rng.randrange(len(w))] = "CHANGED"
        docs.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(w)))
    docs += [(n, None), (n + 1, ""), (None, docs[1][1]), (3, docs[3][1]), (n + 2, "\u00a0".join(passage)), (n + 3, " ".join(passage * 30))]
    return docs


def brute_substring(docs, k):
    low = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            least = low.get(tuple(w[j : j + k]), math.inf)
            if least < (math.inf if i is None else i):
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 50])
def test_substring_dedup(spark, monkeypatch, window):
    monkeypatch.setattr(substring_dedup, "CHUNK_TEXT", 4 << 10)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 256)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hashes string").repartition(3)
    rows = substring_dedup.remove_repeats(df, window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str) == brute_substring(docs, window)
    for r in rows:
        assert sum(s.past - s.first for s in r.spans) == r.n_removed
        assert all(a.past < b.first for a, b in zip(r.spans, r.spans[1:]))
    assert substring_dedup.remove_repeats(df.limit(0), window).count() == 0


def brute_components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_join(docs, size, t):
    sets = []
    for i, x in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        sets.append((i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if None not in (a, b) and x and y and len(x & y) >= t * len(x | y)]
    comp = brute_components(links, {i for i, _ in sets if i is not None})
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("size, t, block", [(4, "85/100", 2048), (2, "1/2", 4)])
def test_ngram_join(spark, monkeypatch, size, t, block):
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", 64)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "DOCS_SENT", 7)
    docs = corpus(1)
    rng = random.Random(9)
    base = [str(rng.randrange(50)) for _ in range(60)]
    for i in range(100, 125):  # a group of near copies, larger than a block
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"new{i}"
        docs.append((i, " ".join(w)))
    docs += [(200, "Ab cd"), (201, "aB CD"), (202, "ab cd ef"), (203, "É f g h i"), (204, "é f g h i")]
    df = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, n int").repartition(4)
    got = sorted(map(tuple, ngram_join.similar_components(df, size, t).collect()), key=str)
    assert got == brute_join(docs, size, Fraction(t))


def test_ngram_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(df).count() == 0
    one = spark.createDataFrame([(None, "a b"), (5, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_components(one).collect()), key=str) == [(5, 0, 5), (None, 1, None)]


def test_divide_skip_search_finds_every_component():
    rng = random.Random(4)
    for t in (Fraction(1, 2), Fraction(4, 5)):
        sets = [np.unique(np.array([rng.randrange(30) for _ in range(rng.randint(3, 20))], np.uint64)) for _ in range(80)]
        sizes = [len(s) + rng.randint(0, 1) for s in sets]
        links = ngram_join.search(sets, sizes, None, t)
        inter = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        good = [(i, j) for i in range(80) for j in range(i) if inter(i, j) >= t * (sizes[i] + sizes[j] - inter(i, j))]
        assert {frozenset(x) for x in links} <= {frozenset(x) for x in good}
        assert brute_components(links, range(80)) == brute_components(good, range(80))


def test_windows_are_rabin_karp_hashes_of_words():
    import pyarrow as pa

    texts = ["a b c a b c", None, "", "\u00a0x y", "a b c", "x" * 3_000_000 + " a b"]
    seen = {}
    for lo, hi, w in fingerprints.column_words(pa.array(texts)):
        for i in range(lo, hi):
            words = WORD.findall(texts[i] or "")
            a, b = w.first[i - lo], w.first[i - lo + 1]
            assert b - a == len(words)
            for k in (1, 2, 3):
                h = w.windows(k)
                for j in range(len(words) - k + 1):
                    assert seen.setdefault((k, tuple(words[j : j + k])), h[a + j]) == h[a + j]
    assert len(set(seen.values())) == len(seen)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def toxic_table(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(30)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["scum", "Moron,", "idiot"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_table(800)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, None, 0.0), (5, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score(docs.drop("score"), model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == 802 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted != truth[r.doc_id] for r in held) <= 2
    toxic = next(r for r in held if r.predicted)
    assert toxic.evidence and toxic.evidence[0].toxic_share > 0.5
    assert {r.predicted for r in got if r.doc_id is None} == {0}


def test_block_max_search_is_exact():
    rng = random.Random(1)
    entries = list({tuple(sorted({rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}.items())): None for _ in range(900)})
    index = toxicity.BlockMaxIndex([(t, rng.randint(1, 3), rng.randint(0, 1), i) for i, t in enumerate(entries)], np.array([1 + rng.random() for _ in range(40)]), 0.1)
    dense = np.zeros((len(index.terms), 40))
    for e, t in enumerate(index.terms):
        i, w = index.vector(t)
        dense[e, i] = w
    for _ in range(60):
        q = tuple(sorted({rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}.items()))
        i, w = index.vector(q)
        s = dense[:, i] @ w
        near = index.nearest(q, 16)
        kth = sorted(s, reverse=True)[15]
        assert {e for _, e in near} == {e for e in range(len(s)) if s[e] >= kth - 1e-12 and s[e] > 0}
        assert all(abs(c - s[e]) < 1e-9 for c, e in near)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}


def brute_viterbi(model, s):
    scores = {p: x for p, x, kind in model.pieces if kind in (1, 4)}
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 20), e):
            best[e] = max(best[e], best[b] + scores.get(s[b:e], -math.inf))
        if s[e - 1] not in scores:
            best[e] = max(best[e], best[e - 1] + model.unknown_score)
    return best[-1]


@pytest.fixture(scope="module")
def pieces():
    return PieceModel.load(PIECE_MODEL)


SAMPLES = ["Hello  world\n\nfoo\tbar é", "", " ", "日本語 \U0001f600!", "a" * 500, "internationalisation of unbelievable thhaonesea", "\n\n x \n", "ﬁ\u00a0x"]


def test_pieces_have_the_best_score_and_round_trip(pieces):
    for s in SAMPLES:
        ids = pieces.encode(s)
        assert pieces.decode(ids) == s
        marked = ("▁" + s if s else s).replace(" ", "▁")
        score = 0.0
        at = 0
        while at < len(ids):
            p, x, kind = pieces.pieces[ids[at]]
            if kind == 6:
                lead = int(p[3:-1], 16)
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                score += pieces.unknown_score
            else:
                at, score = at + 1, score + x
        assert score == pytest.approx(brute_viterbi(pieces, marked))


def test_pieces_agree_with_the_library_in_unigram_mode(pieces):
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(3)
    words = ["".join(rng.choice("thoneréinshß") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for s in [*SAMPLES, *words, " ".join(words[:20])]:
        assert pieces.encode(s) == library.encode(s)
        assert pieces.decode(library.encode(s)) == library.decode(library.encode(s))


def test_merges_agree_with_the_library(pieces):
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(4)
    words = ["".join(rng.choice("thoneréinshß") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for s in [*SAMPLES, *words, " ".join(words[:40]), "a  b   c"]:
        assert pieces.encode(s, merges=True) == library.encode(s), s


def test_encode_and_decode_tables(spark, pieces):
    df = spark.createDataFrame([(i, s, 7) for i, s in enumerate([*SAMPLES, None, SAMPLES[0], "a▁b"])], "doc_id long, text string, x int").repartition(2)
    got = encode(df, pieces).orderBy("doc_id").collect()
    assert [r.round_trip for r in got] == [True] * len(SAMPLES) + [None, True, False]
    assert got[len(SAMPLES)].ids is None and got[len(SAMPLES)].n_pieces == 0
    assert all(r.n_pieces == len(r.ids) for r in got if r.ids is not None)
    back = {r.doc_id: r.out for r in decode(encode(df, pieces), pieces, out_col="out").collect()}
    assert all(back[i] == s for i, s in enumerate(SAMPLES)) and back[len(SAMPLES)] is None
    assert encode(df.limit(0), pieces).count() == 0
