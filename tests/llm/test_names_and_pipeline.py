"""Clashing names in mixing and pieces, long texts, and the pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_text_operators import WORD, brute_components, brute_substring

from sievelane.llm import mixing, sentencepiece_codec
from sievelane.llm.common import materialise
from sievelane.llm.queries import PIECE_MODEL


def test_mixing_keeps_columns_with_its_names(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i, "s", 7, 8) for i in range(200)], "doc_id long, source string, slot int, Block string, rank int, _mix_source int")
    out = mixing.mix(df, mixing.tempered(df), 8, 50)
    assert out.columns == ["doc_id", "source", "slot_in", "Block_in", "rank", "_mix_source", "block", "slot", "place"]
    got = out.collect()
    assert len(got) == 200 and all(r.slot_in == r.doc_id and (r["Block_in"], r["rank"], r["_mix_source"]) == ("s", 7, 8) for r in got)
    assert len({(r.slot, r.place) for r in got}) == 200


def test_pieces_keep_columns_with_their_names_and_long_texts(spark):
    model = sentencepiece_codec.PieceModel.load(PIECE_MODEL)
    long = "word and another " * 100_000
    df = spark.createDataFrame([(1, long, "mine", 2), (2, None, "mine", 2)], "doc_id long, text string, ids string, N_pieces int")
    out = sentencepiece_codec.encode(df, model)
    assert out.columns == ["doc_id", "ids_in", "N_pieces_in", "n_pieces", "ids", "round_trip"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].round_trip and got[1].n_pieces == len(got[1].ids) > 200_000 and got[1].ids_in == "mine" and got[2].ids is None
    back = sentencepiece_codec.decode(out.withColumn("text", F.lit("old")), model)
    assert {r.doc_id: (r.text_in, r.text) for r in back.select("doc_id", "text_in", "text").collect()} == {1: ("old", long), 2: ("old", None)}


def test_pipeline_is_its_stages_by_brute_force(spark, data):
    """Near duplicates, passages and round trips over the whole small table; the toxic stage has held-out tests of its own."""
    whole = spark.read.parquet(f"{data}/documents.parquet")
    docs = materialise(whole.unionByName(whole.filter("doc_id < 3").withColumn("text", F.concat("text", F.lit(" again")))))
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w := low(t)) >= 5 else {tuple(w)} if w else set()) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and x and y and 5 * len(x & y) >= 4 * len(x | y)]
    component = brute_components(links, {i for i, _ in sets})
    kept = materialise(corpus_pipeline.drop_near_duplicates(spark, docs, data))
    got = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == len(got) and set(got) == {i for i in component if component[i] == i}
    assert all((i, t) in rows for i, t in got.items())
    again = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(7), data).collect()}
    assert got == again
    cut = {r.doc_id: r for r in corpus_pipeline.remove_repeated_passages(spark, kept, data).collect()}
    want = {i: (n, gone) for i, n, gone, _ in brute_substring(list(got.items()), 50)}
    assert set(cut) == {i for i, (n, gone) in want.items() if gone < n or n == 0}
    for i, r in cut.items():
        n, gone = want[i]
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) == n - gone
        assert r.text == got[i] or gone
    pieces = corpus_pipeline.encode_pieces(spark, kept.withColumn("ids", F.lit("x")), data)
    assert pieces.filter("round_trip").count() == len(got) and "ids_in" in pieces.columns
