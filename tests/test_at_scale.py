"""What must hold at any size: ranges of ranks, counted quantiles, samples and folds, sweeps in one pass, indexes, the dictionary, commits."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelane.functions import text as X
from sievelane.operators import metrics, retrieval, sampling, windows
from sievelane.operators.normalise import brand_dictionary, normalise_texts
from sievelane.sources import writers


@pytest.mark.parametrize("ids", ["TRN_SAMPLED_%07d", "%d"])
def test_ranges_cut_ties_by_the_whole_key(spark, ids):
    rng = random.Random(1)
    rows = [(ids % i, float(rng.random() < 0.9)) for i in rng.sample(range(100_000), 20_000)]
    df = spark.createDataFrame(rows, "id string, x double").repartition(5)
    sizes = [r["count"] for r in windows._ranged(df, ["x", "id"], 16).groupBy("_p").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 16
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    got = windows.global_rank(df, "x", "id", buckets=16)
    assert got.columns == ["id", "x", "n", "rank"] and {r["id"]: r["rank"] for r in got.collect()} == want


def test_ranks_in_groups_with_nulls(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(4)
    got = {r["id"]: (r["rank"], r["n"]) for r in windows.global_rank(df, "x", "id", by=["g"], buckets=7).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
        assert all(got[r[0]] == (i, len(own)) for i, r in enumerate(own))
    assert windows.global_rank(df.limit(0), "x", "id").count() == 0


@pytest.mark.parametrize("kind", ["ties", "constant", "tails", "plain", "infinite"])
def test_order_statistics_by_counted_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(windows, "FETCHED", 40)
    monkeypatch.setattr(windows, "SAMPLE", 300)
    monkeypatch.setattr(windows, "CUTS", 32)
    rng = np.random.default_rng(4)
    v = {"ties": rng.integers(0, 5, 5000) / 3, "constant": np.full(3000, 0.25), "tails": 10.0 ** rng.uniform(-200, 200, 5000), "plain": rng.normal(size=5000), "infinite": np.concatenate([rng.normal(size=2000), [np.inf] * 900, [-np.inf] * 5])}[kind]
    places = [0, 1, 17, len(v) // 3, len(v) // 2, len(v) - 2, len(v) - 1]
    got = windows.order_statistics(spark.createDataFrame([(float(x),) for x in v], "x double").repartition(3), places)
    assert got == {p: np.sort(v)[p] for p in places}


def test_contingency_counts_each_row_once(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 2)), round(float(rng.random()), 2), float(rng.random()), float(rng.random())) for _ in range(700)] + [(None, 0.5, 0.5, 0.5), (1, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(3)
    weights, cuts = metrics.weight_triples(4), [0.25, 0.5, 0.5000001, 0.75]
    assert weights == [tuple(r) for r in spark.range(1).select(F.explode(metrics.weight_grid(4)).alias("w")).select("w.*").collect()]
    got = {(r["w"], r["t"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.swept(metrics.contingency(df, ["a", "b", "c"], F.col("y"), cuts, weights, 9), cuts, weights).collect()}
    assert len(got) == len(weights) * len(cuts)
    for i, w in enumerate(weights):
        for t in cuts:
            c = Counter((y, round(w[0] * a + w[1] * b + w[2] * c, 9) >= t) for y, a, b, c in rows if y is not None and a is not None)
            assert got[i, t] == (c[1, True], c[0, True], c[1, False], c[0, False])
    assert metrics.contingency(df.limit(0), ["a"], F.col("y"), cuts).count() == 0
    plan = metrics.contingency(df, ["a", "b", "c"], F.col("y"), cuts, weights, 9)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_rates_in_one_pass(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0.5, rng.random()]), rng.randrange(2)) for _ in range(900)]
    df = spark.createDataFrame(rows, "s double, y int")
    s = np.array([r[0] for r in rows])
    for r in metrics.sweep_rates(df, "s", F.col("y"), [0.2, 0.3, 0.31, 0.9]).collect():
        t = np.quantile(s, 1 - r["rate"])
        assert r["threshold"] == pytest.approx(t, abs=1e-12)
        assert (r["tp"], r["fp"]) == (sum(y == 1 and x >= r["threshold"] for x, y in rows), sum(y == 0 and x >= r["threshold"] for x, y in rows))


@pytest.mark.parametrize("n", [0, 1, 10, 999, 4999, 5000, 9000])
def test_samples_are_the_first_by_hash(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "PASS_BITS", 4)
    df = spark.range(0, 5000, 1, 3)
    hashed = sorted((r["h"], r["id"]) for r in df.select("id", X.hash_number(F.col("id"), F.lit(42)).alias("h")).collect())
    got = [r["id"] for r in sampling.sample_rows(df, n, "id").collect()]
    assert sorted(got) == sorted(i for _, i in hashed[:n]) and got == sorted(got)


def test_equal_hashes_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(sampling, "hash_number", lambda *c: (c[0] % 3).cast("bigint") * 1_000_000_007)
    for n in (1, 30, 34, 50, 99):
        got = sorted(r["id"] for r in sampling.sample_rows(spark.range(100), n, "id").collect())
        assert got == sorted(i for _, i in sorted((i % 3, i) for i in range(100))[:n])


def greedy(sizes, folds):
    load, out = [0] * folds, []
    for n in sizes:
        f = min(range(folds), key=lambda f: (load[f], f))
        load[f] += n
        out.append(f)
    return out


def test_fold_segments_are_the_greedy_loop():
    rng = random.Random(5)
    for _ in range(300):
        folds = rng.randrange(1, 7)
        sizes = sorted((rng.choice([1, 1, 2, 3, 7, 50, rng.randrange(1, 400)]) for _ in range(rng.randrange(0, 300))), reverse=True)
        segments = sampling.fold_segments(sorted(Counter(sizes).items(), reverse=True), folds)
        flat = [order[(i - lo) % len(order)] for _, lo, hi, order in segments for i in range(lo, hi)]
        assert flat == greedy(sizes, folds)
        assert max(Counter(s[0] for s in segments).values(), default=0) <= folds


def test_balanced_folds_equal_the_greedy_loop(spark):
    rng = random.Random(6)
    sizes = {k: rng.choice([1, 1, 1, 2, 3, 40]) for k in range(6000)} | {6001: 5000}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "k long, n int").select("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    assert {r["k"]: r["fold"] for r in sampling.balanced_folds(df, "k").collect()} == dict(zip(order, greedy([sizes[k] for k in order], 5), strict=True))
    assert sampling.balanced_folds(df.limit(0), "k").count() == 0


def unit(rows):
    norm = Counter()
    for k, _, w in rows:
        norm[k] += w * w
    return [(k, t, w / norm[k] ** 0.5) for k, t, w in rows]


def sparse_world(n_items, n_queries, seed=0):
    """Topics of rare words, and two words that nearly everything has."""
    rng = random.Random(seed)

    def row(i):
        topic = rng.randrange(40)
        own = {f"t{topic}_{rng.randrange(8)}": rng.uniform(2, 4) for _ in range(3)} | {f"t{rng.randrange(40)}_0": 0.3}
        return [(i, t, w) for t, w in (own | {w: rng.uniform(0.05, 0.2) for w in ("the", "of") if rng.random() < 0.95}).items()]

    return unit([x for i in range(n_items) for x in row(i)]), unit([x for i in range(n_queries) for x in row(i)])


def test_inverted_index_is_exact_and_leaves_blocks_shut(spark):
    items, queries = sparse_world(1500, 80)
    d, q = spark.createDataFrame(items, "d long, token string, w double"), spark.createDataFrame([*queries, (999, "nowhere", 1.0), (998, "the", 1.0)], "q long, token string, w double")
    index = retrieval.SparseIndex(d, "d", 32)
    part, opened = index.search(q, "q", 8)
    blocks = index.blocks()
    assert blocks == -(-1500 // 32)
    per_query = Counter(r["q"] for r in opened.collect())
    assert opened.count() == opened.distinct().count() and sum(per_query[i] for i in range(80)) <= 80 * blocks / 2
    by_item = {}
    for k, t, w in items:
        by_item.setdefault(t, []).append((k, w))
    got = {(r["q"], r["rank"]): (r["d"], r["score"]) for r in retrieval.sparse_top_k(q, d, "q", "d", 6, skip=2, size=32).collect()}
    for i in [*range(80), 998, 999]:
        score = Counter()
        for k, t, w in [*queries, (999, "nowhere", 1.0), (998, "the", 1.0)]:
            if k == i:
                for item, v in by_item.get(t, []):
                    score[item] += w * v
        best = sorted(((-round(s, 9), k) for k, s in score.items() if round(s, 9) > 0))[2:8]
        mine = [got[i, r] for r in range(3, 9) if (i, r) in got]
        assert len(mine) == len(best)
        for (item, s), (t, _) in zip(mine, best, strict=True):
            assert s == pytest.approx(-t, abs=2e-9)
    assert part.count() and retrieval.sparse_top_k(q.limit(0), d, "q", "d", 3).count() == retrieval.sparse_top_k(q, d.limit(0), "q", "d", 3).count() == 0


def test_a_block_that_many_queries_open_is_split(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    items, queries = sparse_world(64, 60, 1)
    d, q = spark.createDataFrame(items, "d long, token string, w double"), spark.createDataFrame(queries, "q long, token string, w double")
    one, all_ = (sorted(map(tuple, retrieval.sparse_top_k(q, d, "q", "d", 5, size=s).collect())) for s in (8, 1024))
    assert one == all_ and one


def test_items_of_one_vector_are_indexed_once(spark, monkeypatch):
    blocks, search = [], retrieval.SparseIndex.search
    monkeypatch.setattr(retrieval.SparseIndex, "search", lambda self, *a, **b: (blocks.append(self.blocks()), search(self, *a, **b))[1])
    vectors = [{"a": 0.8, "b": 0.6}, {"a": 0.6, "c": 0.8}, {"a": 0.8, "d": 0.6}]
    d = spark.createDataFrame([(i, t, w) for i in range(300) for t, w in vectors[i * i % 3 if i < 290 else 2].items()], "d long, token string, w double")
    q = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.5), (3, "a", 0.5), (4, "none", 1.0)], "q long, token string, w double")
    got = sorted((r.q, r["rank"], r.d, r.score) for r in retrieval.sparse_top_k(q, d, "q", "d", 150, skip=3, size=32).collect())
    of = {i: vectors[i * i % 3 if i < 290 else 2] for i in range(300)}
    want = []
    for k, words in {1: {"a": 1.0}, 2: {"b": 1.0}, 3: {"c": 0.5, "a": 0.5}}.items():
        order = sorted((-round(sum(w * v.get(t, 0.0) for t, w in words.items()), 9), i) for i, v in of.items())
        want += [(k, n, i, -s) for n, (s, i) in enumerate([x for x in order if x[0] < 0], 1) if 3 < n <= 153]
    assert got == want and blocks == [1]


def clustered(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(24, dims))
    v = centres[np.where(rng.random(n) < 0.34, 0, rng.integers(0, 24, n))] + rng.normal(size=(n, dims)) * 0.25
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_cells_find_nine_of_ten_and_hold_every_item(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELL_ROWS", 200)  # the largest cluster fills several parts
    v = clustered(3000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    index = retrieval.CellIndex(df, 48)
    assert index.items.count() == index.items.select("id").distinct().count() == 3000
    queries = df.filter("id % 20 = 0")
    exact, near = retrieval.dense_top_k(queries, df, 10), index.search(queries, 10, 8)
    assert retrieval.recall(near, exact) >= 0.9
    scores = {(r["query_id"], r["item_id"]): r["score"] for r in exact.collect()}
    assert all(scores.get((r["query_id"], r["item_id"]), r["score"]) == r["score"] for r in near.collect())
    every = sorted(map(tuple, index.search(queries, 10, 48).collect()))
    assert every == sorted(map(tuple, exact.collect()))


def test_cells_of_the_table_and_of_nothing(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = retrieval.CellIndex(e)
    probes = index.probes(e, 15, 0.95, 200)  # these vectors lie in no clusters, so it takes many
    assert 1 < probes <= index.cells and retrieval.recall(index.search(e, 15, probes), retrieval.dense_top_k(e, e, 15)) >= 0.9
    assert index.probes(e.limit(0), 15) == index.cells
    assert retrieval.CellIndex(e.limit(0)).search(e.limit(0), 5, 2).count() == 0


def test_dictionary_gives_what_each_row_would(spark):
    rng = random.Random(9)
    words = [*X.BRANDS, *X.CORRECTIONS, "nikee", "adidaz", "pumaa", "kadınlar", "evlerde", "masa", "ma", "10", "kg", "elbiseler", "reebk", "slazengerr", "Ğİış"]

    def noisy(w):
        at = rng.randrange(len(w))
        return rng.choice([w, w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "q" + w[at + 1 :]])

    rows = [(i, " ".join(noisy(rng.choice(words)) for _ in range(rng.randrange(6)))) for i in range(400)] + [(400, None), (401, ""), (402, "!?")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    for stemming in (True, False):
        want = {r["id"]: r["x"] for r in df.select("id", X.normalise(F.col("t"), stemming).alias("x")).collect()}
        for size in (10_000, 0):
            got = normalise_texts(df, "t", "x", stemming, dictionary=size)
            assert got.columns == ["id", "t", "x"] and {r["id"]: r["x"] for r in got.collect()} == want
    plan = normalise_texts(df, "t", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan
    assert {tuple(r) for r in brand_dictionary(spark.createDataFrame([("nik",), ("nikke",), ("addidas",), ("kotonn",)], "token string")).collect()} == {("nik", "nike"), ("nikke", "nike"), ("kotonn", "koton")}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "_put", "_publish"])
def test_a_writer_that_stops_leaves_the_table_as_it_was(spark, tmp_path, step):
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(3), path)

    class Broken(writers.Versions):
        pass

    def stop(self, *args):
        getattr(writers.Versions, step)(self, *args) if step != "_publish" else None
        raise Stopped

    setattr(Broken, step, stop)
    with pytest.raises(Stopped):
        Broken(spark, path).replace(spark.range(9))
    table = writers.Versions(spark, path)
    assert table.latest() == 1 and table.read().count() == 3
    assert writers.append_new(spark.range(1, 5), path) == 2 and sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4]
    table.vacuum(1)
    assert table.read().count() == 5 and len(list((tmp_path / "t").iterdir())) == 3


def test_two_writers_never_double_or_lose_rows(spark, tmp_path):
    path = str(tmp_path / "t")

    class Late(writers.Versions):
        """Another writer commits between its reading and its commit, once."""

        done = False

        def commit(self, folders, after):
            if not Late.done:
                Late.done = True
                writers.append_new(spark.range(2, 6), path)
            return super().commit(folders, after)

    assert Late(spark, path).append(spark.range(4), "id") == 2
    table = writers.Versions(spark, path)
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4, 5] and table.latest() == 2
    with pytest.raises(writers.Conflict):
        table.commit(["x"], 1)
    with pytest.raises(FileNotFoundError):
        writers.Versions(spark, str(tmp_path / "none")).read()


def test_crc_folds_are_zlibs(spark):
    got = spark.range(50).select("id", sampling.crc32_fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
