"""Toxicity: votes and calibration against brute force, the whole vocabulary, clashing names, long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import toxic_table

from sievelane.llm import toxicity


def brute(rows, labelled, k, texts):
    """Scores by the definition: all cosines, the k best entries and their ties, leave-one-out isotonic fit."""
    stems = lambda t: Counter(w[: toxicity.STEM] for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    known = set().union(*(stems(t) for t, _ in labelled))
    df = Counter(x for t in rows for x in set(stems(t)) & known)
    base = 1 + len(rows) * toxicity.SMOOTHING
    idf = {x: math.log((len(rows) + base) / (df[x] + base)) + 0.05 for x in known}

    def unit(t):
        v = {x: n * idf[x] for x, n in stems(t).items() if x in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {x: w / size for x, w in v.items()}

    entries = {}
    for t, y in labelled:
        key = tuple(sorted((x, n) for x, n in stems(t).items()))
        entries.setdefault(key, [unit(t), 0, 0])
        entries[key][1] += 1
        entries[key][2] += y
    empty = entries.pop((), [{}, 0, 0])
    entries = list(entries.values())
    prior = sum(y for _, y in labelled) / len(labelled)
    none = (empty[2] + prior) / (empty[1] + 1)

    def votes(v, gone=None, label=0):
        cos = [(sum(w * e[0].get(x, 0) for x, w in v.items()), j) for j, e in enumerate(entries)]
        cos = sorted(((c, j) for c, j in cos if c > 0 and not (j == gone and entries[j][1] == 1)), reverse=True)
        if not cos:
            return None
        near = [(c, j) for c, j in cos if c >= cos[min(k, len(cos)) - 1][0] - 1e-12]
        total = sum(c * c * (entries[j][1] - (j == gone)) for c, j in near)
        return sum(c * c * (entries[j][2] - (j == gone) * label) for c, j in near) / total if total else prior

    points = [(none, empty[2] / empty[1], empty[1])] if empty[1] else []
    for j, (v, n, y) in enumerate(entries):
        for label, count in ((1, y), (0, n - y)):
            if count:
                own = votes(v, j, label)
                points.append((prior if own is None else own, label, count))
    xs, ys = toxicity.isotonic(points)
    return [float(np.interp(none if (raw := votes(unit(t))) is None else raw, xs, ys)) for t in texts]


def test_scores_are_those_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(i, t, y) for i, t, y in toxic_table(240, 4)]
    rows += [(300 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(20)] + [(400, "", 0), (401, None, 0), (402, "123", 1), (403, "unseen", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = [(i, y) for i, _, y in rows if i != 403 and rng.random() < 0.7 or i in (400, 402)]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    text = {i: t for i, t, _ in rows}
    want = brute(list(text.values()), [(text[i], y) for i, y in labels], toxicity.NEIGHBOURS, list(text.values()))
    assert [got[i].score for i in text] == pytest.approx(want, abs=1e-9)
    stems = lambda t: {w[: toxicity.STEM] for w in re.findall(r"[^\W\d_]+", (t or "").lower())}
    shared = set().union(*(stems(text[i]) for i, _ in labels))
    assert all(bool(r.evidence) == bool(shared & stems(r.text)) for r in got.values())


def test_search_of_many_blocks_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = random.Random(6)
    entries = list({tuple(sorted({min(int(rng.expovariate(0.08)), 199): rng.randint(1, 9) for _ in range(rng.randint(1, 30))}.items())): None for _ in range(1500)})
    index = toxicity.BlockMaxIndex([(t, 1, 0, i) for i, t in enumerate(entries)], np.array([0.05 + rng.random() * 5 for _ in range(200)]), 0.1)
    dense = np.zeros((len(index.terms), 200))
    for e, t in enumerate(index.terms):
        i, w = index.vector(t)
        dense[e, i] = w
    queries = [(), *rng.sample(entries, 90)]
    for q, near in zip(queries, index.nearest_of(queries, 8), strict=True):
        i, w = index.vector(q)
        s = dense[:, i] @ w
        kth = sorted(s, reverse=True)[7]
        assert {e for _, e in near} == {e for e in range(len(s)) if s[e] >= kth - 1e-12 and s[e] > 0}


def test_clashing_names_and_a_long_text(spark):
    rows = toxic_table(200, 2)
    long = " ".join(t for _, t, y in rows if not y) * 60
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t, _ in rows] + [(900, long, "s", 3)], "doc_id long, text string, score string, Predicted int")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score_in", "Predicted_in", "score", "predicted", "evidence"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 201 and {(r.score_in, r.Predicted_in) for r in got.values()} == {("s", 3)} and got[900].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, model, keep=["doc_id"]).filter(F.col("predicted") == 1).count() > 10
