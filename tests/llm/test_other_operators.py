"""HTML, mixing, embeddings, sharding, top-k, urls, the pipeline: brute force, edge cases, empty tables."""

import heapq
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sievelane.llm import embedding_dedup, html_extract, mixing, sharding, topk_search, url_filter

PAGE = """<html><head><title>T</title><script>var t="</p><p>no";</script><style>p{{}}</style></head><body class="has-sidebar"><header><div>Site</div></header>
<nav><ul><li><a href="/x">menu {n}</a><li>second</ul></nav><div class="ad">buy {n}</div><div id="cookie-notice">cookies {n}</div>
<div class="wrap sidebar-right"><article><header><h1>Title &amp; {n}</h1></header><p>One <b>two</b>
  three<span class="ad">ad<b>x</b></span> {n}<p>Constant line.</p><aside>side {n}</aside><form><p>name {n}</p></form>
<ul><li>a{n}<li>b &lt; c{n}</ul><section class="comments"><p>nice {n}</p></section></article></div><div class="sidebar"><p>S {n}</p></div><footer>f {n}</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"http://A.example.com/{i}", PAGE.format(n=f"n{i}")) for i in range(12)]
    rows += [(20, "http://one.example.org/", "<div><div class='menu'>m</div><div class='content'><p>hello world, this is</p><p>text&nbsp;here</p></div></div>")]
    rows += [(21, None, "just text <"), (22, "http://x.org", None), (23, "http://x.org", ""), (0, rows[0][1], rows[0][2]), (None, "nohost", "<p>open <b class='q")]
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, host int").repartition(3)
    got = defaultdict(list)
    for r in html_extract.extract(df, keep=["page_id", "url", "host"]).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    for i in range(12):
        # the line that all pages of the host have at the same place is template
        assert got[i][0] == f"Title & n{i}\nOne two three n{i}\nan{i}\nb < cn{i}"
    assert len(got[0]) == 2 and got[0][0] == got[0][1]
    assert got[20] == ["hello world, this is\ntext here"] and got[21] == ["just text <"]
    assert got[22] == got[23] == [""] and got[None] == ["open"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_stay_whole(spark):
    df = spark.createDataFrame([(i, "http://h.org/a", "<body><article><p>same text</p><p>more</p></article></body>") for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"same text\nmore"}
    near = df.withColumn("html", F.concat(F.lit("<body><article><h1>"), "page_id", F.lit("</h1><p>a text that most of the page shares</p></article></body>")))
    assert {r.text for r in html_extract.extract(near).collect()} == {f"{i}\na text that most of the page shares" for i in range(30)}


def test_simple_tree_matching():
    parse = lambda s: html_extract.fold(html_extract.parse(s))
    a, b = parse("<div><h1>x</h1><p>y</p><ul><li>1</ul></div>"), parse("<div><p>y</p><table><tr><td>2</table><ul><li>3</ul></div>")
    # the page, the div, p, ul and li pair up; h1, table, tr and td don't
    assert html_extract.match(a, b, {}) == 5
    merged = html_extract.merge(a, b)
    assert [c[0] for c in merged[5][0][5]] == ["h1", "p", "table", "ul"] and merged[5][0][5][1][1] == 2


def brute_edf(shares):
    w, names = sum(shares.values()), sorted(shares)
    done, out = dict.fromkeys(names, 0), []
    for t in range(w):
        ready = [(-(-(done[s] + 1) * w // shares[s]), s) for s in names if done[s] < shares[s] and done[s] * w // shares[s] <= t]
        _, s = heapq.nsmallest(1, ready)[0]
        out.append(s)
        done[s] += 1
    return out


def test_period_is_earliest_deadline_first(spark):
    shares = {"a": 37, "b": 11, "c": 1, "d": 5, "": 3}
    df = spark.createDataFrame(list(shares.items()), "source string, share int")
    got = [r.source for r in mixing.period(df).orderBy("slot").collect()]
    assert got == brute_edf(shares)
    w = sum(shares.values())
    for s, c in shares.items():
        for t in range(1, w + 1):
            assert abs(got[:t].count(s) - c * t / w) < 1


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None) for i in range(500)] + [(None, "hot"), (7, "s2"), (7, "s2")]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, source string, share string").repartition(5)
    weights = spark.createDataFrame([("hot", 3.0), ("s1", 1.0), ("s2", float("nan")), ("s3", None), (None, 1.0)], "source string, weight double")
    got = mixing.mix(df, weights, 8, 100).collect()
    assert sorted(((r.doc_id, r.source, r.share) for r in got), key=str) == sorted(((i, s, "x") for i, s in rows), key=str)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in by_slot.values())
    again = mixing.mix(df.repartition(2), weights, 8, 100).collect()
    key = lambda r: (str(r.doc_id), r.slot, r.place)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0), weights).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 16))
    m = np.concatenate([base[rng.integers(0, 6, 60)] + rng.normal(scale=0.12, size=(60, 16)), rng.normal(size=(40, 16))])
    m[3] *= 1e-30
    m[4] *= 1e25
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    return rows, [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0] * 15 + [None]), (204, [math.nan] * 16), (205, [math.inf] + [0.0] * 15), (206, [1.0, 0.0]), (207, [2.0, 0.001]), (None, rows[0][1]), (5, rows[5][1])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    good, odd = vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in good + odd], f"vec_id long, embedding array<{kind}>, n int").repartition(3)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(good) + len(odd)
    unit = lambda v: (x := np.array(v) / np.abs(v).max()) / math.sqrt(x @ x)
    u = {i: unit(v) for i, v in good}
    u |= {206: unit([1.0, 0.0]), 207: unit([2.0, 0.001])}
    links = {(a, b) for a in u for b in u if a != b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.95}
    up = {i: i for i in u}
    for _ in u:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert len(links) > 50
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, None)
        else:
            c = up.get(r.vec_id, r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == (sum(a == r.vec_id for a, _ in links), c, c == r.vec_id)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    u = embedding_dedup.unit_rows(rng.normal(size=(200, 24)) * 10.0 ** rng.integers(-3, 4, size=(200, 1)))
    k, s, n, e = embedding_dedup.quantise(u)
    error = np.abs(u @ u.T - (k.astype(float) @ k.T.astype(float)) * s[:, None] * s)
    assert (error <= e[:, None] * n + n[:, None] * e + e[:, None] * e + 1e-12).all()


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk_search, "ANNULUS", 8)
    monkeypatch.setattr(topk_search, "SHARD_ANNULI", 2)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    good, odd = vectors(2)
    good = [(i, [x * scale for x in v]) for i, v in good if i not in (3, 4)]
    df = spark.createDataFrame([(i, v) for i, v in good + odd if i not in (206, 207)], "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, topk_search.top_k(df, F.col("id") % 20 == 0, k=7, n_pivots=9).collect()))
    q = {i: [math.floor(64 * x) for x in v] for i, v in good} | {202: [0] * 16}
    expected = []
    for a in (i for i in q if i % 20 == 0):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:7]
        expected += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert got == sorted(expected)
    assert topk_search.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (20, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("id") % 20 == 0).collect()))
    assert [(a, r, b) for a, r, b, _ in got] == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]


def brute_compaction(shards, target, fanout=4, tiers=3, span=4096):
    state = {(a, s): [(a, s)] for a, s, _ in shards}
    size = {(a, s): b for a, s, b in shards}
    for t in range(tiers):
        low = 0 if t == 0 else target // fanout ** (tiers - t + 1)
        high = target // fanout ** (tiers - t)
        for r in {a // span for a, _ in state}:
            run = sorted(k for k in state if k[0] // span == r and low <= sum(size[x] for x in state[k]) < high)
            for i in range(0, len(run) - fanout + 1, fanout):
                for k in run[i + 1 : i + fanout]:
                    state[run[i]] += state.pop(k)
    return {x: k for k, xs in state.items() for x in xs}


def test_compaction_plan(spark):
    rng = random.Random(0)
    shards = [(a, s, rng.choice([1, 5, 30, 90, 400])) for a in [*range(70), *range(5000, 5030), -1] for s in range(rng.randint(1, 2))]
    df = spark.createDataFrame([(*x, 1) for x in shards], "arrival long, slice long, bytes long, rows long")
    got = {(r.arrival, r.slice): (r.into_arrival, r.into_slice) for r in sharding.plan_compaction(df, 640).collect()}
    assert got == brute_compaction(shards, 640)
    total = defaultdict(int)
    for a, s, b in shards:
        total[got[a, s]] += b
    assert all(b <= 640 for b in total.values()) and len(total) < len(shards)


def test_shards_hold_every_version(spark, tmp_path):
    rows = [(i if i % 50 else None, "x" * (i % 40) if i % 9 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes int").repartition(3)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), small_bytes=256, target_bytes=2048)
    key = lambda d: sorted(((r.doc_id, r.text, r.bytes) for r in d.collect()), key=str)
    first, second = df.filter("bytes < 400"), df.filter("bytes >= 400")
    assert store.append(first, F.floor(F.col("doc_id") / 20)) == 1
    assert store.append(second, F.floor(F.col("doc_id") / 20) + 1000) == 2
    before = store.manifest().count()
    assert store.compact() == 3
    assert store.manifest().count() < before and store.manifest().agg(F.max("bytes")).first()[0] <= 2048
    assert key(store.read().select("doc_id", "text", "bytes")) == sorted(rows, key=str)
    assert key(store.read(1).select("doc_id", "text", "bytes")) == key(first)
    assert store.read().select("gen", "shard").distinct().count() == store.manifest().count()
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), 3)


def test_url_filter(spark):
    urls = ["http://net/", "https://a.example.NET/en/x?q=/", "http://example.net/en", "http://example.com/de/1", "http://x.example.com/fr/", "ftp://org/fr/a#b", "http://a.org/frx", "http://notnet/", "net/", "", None, "http://b.example.com?x=/de/", "http://c.example.net/en/", "x://y.net://z/"]
    rows = [(i, u, "h") for i, u in enumerate([*urls, urls[1]])] + [(None, urls[0], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame([("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
        path = rest[len(host) :]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        return host, path, rule, verdict

    assert got == {(i, *judge(u)) for i, u, _ in rows}
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_loses_nothing_and_lets_little_through(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("key"))
    blocks = url_filter.bloom_blocks(2000)
    bloom = url_filter.build_bloom(keys, "key", blocks)
    assert url_filter.probe_bloom(keys, "key", bloom, blocks).count() == 2000
    assert url_filter.probe_bloom(others, "key", bloom, blocks).count() < 200


def test_pipeline_stages(spark, data):
    from sievelane.llm.common import materialise

    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**9).cast("long")))
    docs = materialise(docs.unionByName(extra).withColumn("score", F.lit("mine")))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mix_sources", "sentencepiece"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = materialise(stage(spark, docs, data))
        assert 0 < docs.count() <= before
        if i < 4:
            assert docs.columns == columns
    assert {"doc_id", "ids", "n_pieces", "score"} <= set(docs.columns) and docs.filter("doc_id = 1000000000").count() == 1
    assert docs.filter("NOT round_trip").count() == 0


def test_mixed_order_is_kept(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, data).collect()]
    slots = mixing.mix(docs.select("doc_id", "source"), mixing.tempered(docs)).orderBy("slot", "place").collect()
    assert got == [r.doc_id for r in slots]


def test_pipeline_stages_on_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
