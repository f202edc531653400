"""Substring dedup: any order of a chunk's rows between the passes, hot ids, clashing names, long texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from sievelane.llm import substring_dedup
from sievelane.llm.substring_dedup import NULL_ID, Passes

from test_text_operators import brute_substring, corpus


def shuffled(table, rng):
    return table.take(pa.array(rng.permutation(table.num_rows)))


@pytest.mark.parametrize("window, bits", [(5, 0), (5, 3), (50, 2)])
def test_rows_may_arrive_in_any_order_in_every_pass(window, bits):
    docs, rng, passes = corpus(3), np.random.default_rng(1), Passes(window, bits)
    names = ["_id", "_text", "_chunk"]
    rows = [(NULL_ID if i is None else i, t, random.Random(f"{i}{t}").randrange(4)) for i, t in docs]
    chunks = {c: pa.table(dict(zip(names, map(list, zip(*(r for r in rows if r[2] == c), strict=True)), strict=True)), schema=pa.schema([("_id", pa.int64()), ("_text", pa.string()), ("_chunk", pa.int32())])) for c in range(4)}

    def grouped(tables, key):
        whole = shuffled(pa.concat_tables(tables), rng)
        return {k: whole.filter(pa.compute.equal(whole[key], k)) for k in set(whole[key].to_pylist())}, whole.slice(0, 0)

    sent, _ = grouped([passes.first_pass(shuffled(t, rng)) for t in chunks.values()], "bucket")
    known, none = grouped([passes.first_count(shuffled(t, rng)) for t in sent.values()], "chunk")
    again, _ = grouped([passes.second_pass(shuffled(t, rng), known.get(c, none)) for c, t in chunks.items()], "bucket")
    later, _ = grouped([passes.second_count(shuffled(t, rng)) for t in again.values()], "chunk")
    got = []
    for c, t in chunks.items():
        t = shuffled(t, rng)
        answers = shuffled(pa.concat_tables([known.get(c, none), later.get(c, none)]), rng)
        n_words, n_removed, _, digests, _ = substring_dedup._cut(t["_text"].to_pylist(), *passes.third_pass(t, answers), window)
        ids = [None if i == NULL_ID else i for i in t["_id"].to_pylist()]
        got += zip(ids, n_words.to_pylist(), n_removed.to_pylist(), digests.to_pylist(), strict=True)
    assert sorted(got, key=str) == brute_substring(docs, window)


def test_answers_to_other_windows_are_refused():
    passes = Passes(2, 0)
    table = pa.table({"_id": [1, 2], "_text": ["a b c", "a b d"], "_chunk": pa.array([0, 0], pa.int32())})
    known = passes.first_count(passes.first_pass(table))
    with pytest.raises(RuntimeError, match="other windows"):
        passes.second_pass(table.slice(0, 1), known)


def test_many_rows_of_one_id_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 8)
    monkeypatch.setattr(substring_dedup, "CHUNK_TEXT", 1 << 10)
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(7, f"{passage} tail")] * 60 + [(None, passage)] * 30 + [(None, None)] * 30 + [(3, f"x {passage}"), (9, passage), (10, "short")]
    rows = [(i, t, "mine", "k", 5, "c") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, Spans string, _id int, `a.b` string").repartition(5)
    out = substring_dedup.remove_repeats(df, 6)
    assert out.columns[:5] == ["doc_id", "n_words_in", "Spans_in", "_id", "a.b"]
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substring(docs, 6)
    assert {(r.n_words_in, r.Spans_in, r["_id"], r["a.b"]) for r in got} == {("mine", "k", 5, "c")}
    chunks = substring_dedup._dealt(df.selectExpr("coalesce(doc_id, 9223372036854775807) AS _id", "text AS _text"), df.selectExpr("coalesce(doc_id, 9223372036854775807) AS _id"), 64, 4)
    by = defaultdict(set)
    for r in chunks.collect():
        by[r["_id"]].add(r["_chunk"])
    assert len(by[7]) > 3


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    docs = [(1, " ".join(long.split()[1000:1200])), (2, long), (3, "other words")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[2].n_words, got[2].n_removed, got[1].n_removed) == (400_000, 200, 0)
    words = long.split()
    assert got[2].kept_sha256 == hashlib.sha256(" ".join(words[:1000] + words[1200:]).encode()).hexdigest()
