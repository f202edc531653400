"""Judging by a service that fails, .npy files, answer files, augmented pairs, early stopping."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelane.functions import text as X
from sievelane.operators import gates, judge, labels, learn, sampling
from sievelane.sources import npy


def test_protocols_round_trip():
    replies = {
        "completions": {"choices": [{"message": {"content": "1"}}]}, "messages": {"content": [{"type": "text", "text": "1"}]},
        "contents": {"candidates": [{"content": {"parts": [{"text": "1"}]}}]}, "local": {"message": {"content": "1"}},
    }
    for name, reply in replies.items():
        seen = []
        service = judge.Service(lambda path, body, reply=reply, seen=seen: seen.append((path, json.loads(body))) or (200, json.dumps(reply)), name, "m")
        assert service("is it?", 0) == "1" and "is it?" in json.dumps(seen[0][1]) and "{" not in seen[0][0]
        for status, error in ((429, judge.Transient), (503, judge.Transient), (401, judge.Permanent)):
            with pytest.raises(error):
                judge.Service(lambda path, body, status=status: (status, "{}"), name)("x", 0)
        with pytest.raises(judge.Transient):
            judge.Service(lambda path, body: (200, "not json"), name)("x", 0)

    def broken(path, body):
        raise TimeoutError("late")

    with pytest.raises(judge.Transient):
        judge.Service(broken)("x", 0)


def test_pauses_grow_and_spread():
    waits = [judge.pause("p", i, 0.5, 30) for i in range(9)]
    assert all(0.25 * 2**i <= w <= 0.5 * 2**i for i, w in enumerate(waits[:6])) and max(waits) <= 30
    assert len({judge.pause(str(i), 0, 1, 30) for i in range(50)}) > 20


def test_calls_hold_examples_and_numbered_lines(spark):
    df = spark.createDataFrame([(i, f"line\n{i}") for i in range(7)] + [(7, None)], "k long, t string")
    got = sorted(judge.calls(df, "k", F.col("t"), 3, "Head\n", [("x", 1)]).collect())
    assert [r["keys"] for r in got] == [[0, 1, 2], [3, 4, 5], [6, 7]]
    assert got[2]["prompt"] == "Head\n1. x -> 1\n1. line 6\n2. "


def test_a_failing_service_is_tried_again_and_resumed(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(53)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)

    def bad(prompt, attempt):
        keys = [int(x.rsplit("t", 1)[1]) for x in prompt.split("\n")]
        if keys[0] % 3 == 0 and attempt < 2:
            raise judge.Transient("busy")
        if keys[0] % 4 == 0:
            raise judge.Permanent("no")
        if keys[0] % 5 == 0:
            raise judge.Transient("always")
        return "\n".join(f"{i}) {k % 2}" for i, k in enumerate(keys, 1) if k != 22)

    path = str(tmp_path / "judged")
    done, dead = judge.judge(df, "id", F.col("t"), bad, path, size=5, tries=3, base=0.0)
    verdict, lost = {r["key"]: r["verdict"] for r in done.collect()}, {r["key"]: r["error"] for r in dead.collect()}
    starts = [i - i % 5 for i in range(53)]
    refused = {i for i, s in enumerate(starts) if s % 4 == 0}
    busy = {i for i, s in enumerate(starts) if s % 4 and s % 5 == 0}
    assert {i for i, e in lost.items() if e == "permanent: no"} == refused and {i for i, e in lost.items() if e == "transient: always"} == busy - {22}
    assert verdict == {} or not set(verdict) & set(lost)
    for _ in range(2):
        asked = []
        done, dead = judge.judge(df, "id", F.col("t"), lambda p, a: "\n".join(str(int(x.rsplit("t", 1)[1]) % 2) for x in p.split("\n")), path, size=4, base=0.0)
        assert {r["key"]: r["verdict"] for r in done.collect()} == {i: i % 2 for i in range(53)} and not asked
    assert done.count() == 53


def test_attempts_are_counted_and_bounded(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "call long, prompt string")

    def send(prompt, attempt):
        if attempt < int(prompt[1:]):
            raise judge.Transient("x")
        return prompt

    got = {r["call"]: (r["reply"], r["attempts"], r["error"]) for r in judge.ask(df, send, at_once=3, tries=4, base=0.0).collect()}
    assert got == {i: (f"p{i}", i + 1, None) if i < 4 else (None, 4, "transient: x") for i in range(9)}
    with pytest.raises(Exception, match="ZeroDivision"):
        judge.ask(df, lambda p, a: 1 / 0).collect()


def test_npy_files_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(103, 5)).astype(np.float32), rng.normal(size=(7, 5))
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v/a.npy", a)
    np.save(tmp_path / "v/b.npy", b)
    df = npy.read_npy(spark, str(tmp_path / "v"), range_bytes=400)
    assert df.rdd.getNumPartitions() > 4
    got = {(r["file"], r["row"]): r["value"] for r in df.collect()}
    assert len(got) == 110 and all(np.allclose(got["a.npy", i], a[i]) for i in range(103)) and all(np.allclose(got["b.npy", i], b[i], atol=1e-6) for i in range(7))
    for save, name in ((np.savez, "x.npz"), (np.savez_compressed, "y.npz")):
        save(tmp_path / name, X=a, y=np.arange(103), f=np.linspace(0, 1, 103))
        v = {r["row"]: r["value"] for r in npy.read_npy(spark, str(tmp_path / name), member="X", range_bytes=300).collect()}
        assert all(np.allclose(v[i], a[i]) for i in range(103))
        assert [r["value"] for r in npy.read_npy(spark, str(tmp_path / name), "integers", "y").orderBy("row").collect()] == list(range(103))
        assert [r["value"] for r in npy.read_npy(spark, str(tmp_path / name), "numbers", "f").orderBy("row").collect()] == pytest.approx(np.linspace(0, 1, 103).tolist())
    with pytest.raises(Exception, match="member"):
        npy.read_npy(spark, str(tmp_path / "x.npz")).collect()
    np.save(tmp_path / "none.npy", np.zeros((0, 5), np.float32))
    assert npy.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    (tmp_path / "bad.npy").write_bytes(b"nothing like it")
    with pytest.raises(Exception, match="not an .npy file"):
        npy.read_npy(spark, str(tmp_path / "bad.npy")).collect()


def test_npy_writes_and_appends(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 50, 1, 4).select("id", F.array(F.col("id").cast("float"), F.lit(2.0)).alias("embedding"))
    npy.write_vectors_npy(df, path)
    npy.write_vectors_npy(df.withColumn("id", F.col("id") + 50), path)
    got = {r["id"]: r["embedding"] for r in npy.read_vectors_npy(spark, path).collect()}
    assert got == {i: [float(i % 50), 2.0] for i in range(100)}
    (tmp_path / "out/vectors/stray.npy").write_bytes(b"left by a task that failed")
    assert npy.read_vectors_npy(spark, path).count() == 100
    with pytest.raises(Exception, match="several lengths"):
        npy.write_vectors_npy(df.unionByName(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>").coalesce(1)).coalesce(1), str(tmp_path / "bad"))


def test_answer_files_are_checked_line_by_line(spark, tmp_path):
    texts = {0: "id,label\n1,0\n2,1\n3,0\n", 1: "4,0\n5,1", 2: "id,label\r\n7,1\r\n6,0\r\n\r\n", 3: "id,label\n8,2\n9,1\n10,1"}
    for shard, t in texts.items():
        (tmp_path / f"f/shard={shard}").mkdir(parents=True)
        (tmp_path / f"f/shard={shard}/part-0.txt").write_bytes(t.encode())
    expected = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (2, 0, 6), (2, 1, 7), (3, 0, 8), (3, 1, 9), (4, 0, 11)], "shard int, position int, id long")
    got = {r["shard"]: tuple(r)[1:] for r in gates.file_gate(spark, str(tmp_path / "f"), expected).collect()}
    assert got == {0: (True, 3, 0, None, 0), 1: (False, 2, 0, None, 0), 2: (True, 2, 2, 0, 0), 3: (True, 3, 1, 2, 1), 4: (False, 0, 1, 0, 0)}


def test_augmented_pairs_copy_training_rows_only(spark):
    rng = random.Random(3)
    pairs = [(t, i, rng.randrange(2), t % 5) for t in range(200) for i in range(3)]
    terms = [(t, rng.choice(["kırmızı elbise uzun", "siyah ayakkabı", "tek"])) for t in range(200)]
    p, t = spark.createDataFrame(pairs, "term_id long, item_id long, label int, fold int"), spark.createDataFrame(terms, "term_id long, query string")
    both, all_terms = labels.augmented(p, t, lambda q, k: X.perturb_query(q, k), F.col("fold") != 4)
    rows, queries = [tuple(r) for r in both.collect()], {r["term_id"]: r["query"] for r in all_terms.collect()}
    copies = [r for r in rows if r[0].startswith("SYN_")]
    named = {r[0] for r in copies}
    assert 20 < len(named) < 90 and named == {k for k in queries if k.startswith("SYN_")}
    by_term = {str(t): sorted(x[1:] for x in pairs if x[0] == t) for t in range(200)}
    for name in named:
        own = name.removeprefix("SYN_")
        assert sorted(r[1:] for r in copies if r[0] == name) == by_term[own] and int(own) % 5 != 4 and queries[name] != queries[own] and queries[own] != "tek"
    assert sorted(r for r in rows if not r[0].startswith("SYN_")) == sorted((str(a), *x) for a, *x in pairs)


def test_noise_leaves_its_own_brands_alone(spark):
    df = spark.createDataFrame([(i, "kigili levis") for i in range(60)], "k long, q string")
    assert all(r[0] is None for r in df.select(X.perturb_query(F.col("q"), F.col("k"))).collect())


def test_disputed_tier_is_ordered_and_capped(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(2), round(rng.random(), 2), round(rng.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    got = [tuple(r) for r in labels.disputed_tier(df, F.col("label"), [F.col("a"), F.col("b")], F.col("a"), 20).collect()]
    all_ = sorted((-d, i) for i, y, a, b in rows if 0.03 <= a <= 0.97 and 0.3 <= (d := round(abs(y - (a + b) / 2), 9)) < 0.5)
    assert len(all_) > 20 and got == [(i, -d) for d, i in all_[:20]]


def test_rounds_come_from_validation(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, rng.random(), rng.random(), float(rng.randrange(2))) for i in range(300)]  # nothing to learn, so boosting soon makes it worse
    df = spark.createDataFrame(rows, "id long, fold int, s1 double, s2 double, label double")
    models, rounds = learn.refit_folds(df, ["s1", "s2"], folds=3, most=12, maxDepth=3)
    assert set(rounds) == {0, 1, 2} and all(1 <= n < 12 for n in rounds.values())
    assert {f: len(m[0].stages[-1].trees) for f, m in models.items()} == rounds


def test_three_learners_and_their_weights(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, x := rng.random(), rng.random(), float(x > 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold int, s1 double, s2 double, label double")
    scores, best = learn.three_learners(df, ["s1", "s2"], folds=2)
    b = best.first()
    assert scores.count() == 200 and b["a"] + b["b"] + b["c"] == pytest.approx(1) and b["f_fine"] > 0.9
    hit = [(round(b["a"] * r["boosted"] + b["b"] * r["forest"] + b["c"] * r["linear"], 9) >= b["t_fine"], r["label"] == 1) for r in scores.collect()]
    c = Counter(hit)
    f1 = lambda tp, fp, fn: 2 * tp / max(1, 2 * tp + fp + fn)
    assert b["f_fine"] == pytest.approx((f1(c[True, True], c[True, False], c[False, True]) + f1(c[False, False], c[False, True], c[True, False])) / 2)


def test_stacker_features_of_texts(spark):
    df = spark.createDataFrame([(1, 0.5, "kırmızı elbise", "kırmızı uzun elbise"), (1, 0.2, None, "x")], "term_id long, s double, q string, t string")
    got, names = learn.stacker_features(df, ["s"], query=F.col("q"), title=F.col("t"))
    assert names[-4:] == ["shared", "token_jaccard", "query_tokens", "title_tokens"]
    assert [tuple(r) for r in got.orderBy(F.desc("s")).select(names[-4:]).collect()] == [(2.0, pytest.approx(2 / 3), 2.0, 3.0), (0.0, 0.0, 0.0, 1.0)]


def test_clean_negatives_lie_below_the_mark(spark):
    ranked = spark.createDataFrame([(1, i, i / 20) for i in range(20)], "term_id long, item_id long, p double")
    pos, items = spark.createDataFrame([(1, 0)], "term_id long, item_id long"), spark.range(20).withColumnRenamed("id", "item_id")
    got = {tuple(r) for r in sampling.remined_negatives(ranked, pos, items, "p", hard=6, rand=0, below=0.2).filter("label = 0").collect()}
    assert got == {(1, i, 0) for i in (1, 2, 3)}
