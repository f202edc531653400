
import random

import numpy as np
import pytest

pytest.importorskip("sievelane.llm")
from pyspark.sql import functions as F  # noqa: E402

from sievelane.llm import html_extract, sharding, toxicity  # noqa: E402


def test_toxicity_sees_mixed_and_clean_terms(spark):
    rng = random.Random(3)
    noise = lambda: " ".join("".join(rng.choice("bcdfghjk") for _ in range(9)) for _ in range(12))
    rows = []
    for i in range(600):
        own = "ugly" if i < 45 else "ugly thanks" if i < 92 else "thanks" if i < 300 else "plain"
        rows.append((i, f"{own} {noise()}", int(i < 45)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "ugly"), (1001, "ugly thanks")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {"ugly", toxicity.stem("thanks")} <= set(model.vocabulary.ids)
    got = {r.doc_id: r for r in toxicity.score(docs, model).filter("doc_id >= 1000").collect()}
    assert got[1000].predicted == 1 and got[1000].evidence
    assert got[1001].predicted == 0 and got[1001].evidence


def test_toxicity_learns_from_few_examples(spark):
    rows = [(i, "scum here" if i < 3 else "fine here", int(i < 3)) for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()} == {0, 1, 2}


def test_block_max_search_at_once_is_exact():
    rng = random.Random(2)
    entries = list({tuple(sorted({rng.randrange(60): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}.items())): None for _ in range(3000)})
    index = toxicity.BlockMaxIndex([(t, 1, 0, i) for i, t in enumerate(entries)], np.array([1 + rng.random() for _ in range(60)]), 0.1)
    assert index.blocks > 4 * toxicity.FIRST_BLOCKS
    dense = np.zeros((len(index.terms), 60))
    for e, t in enumerate(index.terms):
        i, w = index.vector(t)
        dense[e, i] = w
    for _ in range(60):
        q = tuple(sorted({rng.randrange(60): rng.randint(1, 3) for _ in range(rng.randint(1, 9))}.items()))
        i, w = index.vector(q)
        s = dense[:, i] @ w
        for without in (-1, int(np.argmax(s))):
            if without >= 0:
                s[without] = 0
            near = index.nearest(q, 16, without)
            kth = sorted(s, reverse=True)[15]
            assert {e for _, e in near} == {e for e in range(len(s)) if s[e] >= kth - 1e-12 and s[e] > 0}
            assert all(abs(c - s[e]) < 1e-9 for c, e in near)


def test_compaction_keeps_rows_without_bytes(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "shards"))
    rows = [(i, None if i % 2 else "") for i in range(40)]
    store.append(spark.createDataFrame(rows, "doc_id long, text string"), F.floor(F.col("doc_id") / 10))
    store.compact()
    assert store.manifest().count() == 1
    assert sorted(((r.doc_id, r.text) for r in store.read().collect()), key=repr) == sorted(rows, key=repr)


def test_html_template_line_among_varying_paragraphs(spark):
    notice = "Sign up for our letter today"
    page = lambda i: "<article>" + "".join(f"<p>own words {i} {j} of the page</p>" for j in range(12)) + f"<p>{notice}</p></article>"
    df = spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(200)], "page_id long, url string, html string").repartition(3)
    got = html_extract.extract(df).collect()
    assert len(got) == 200 and all(r.text == "\n".join(f"own words {r.page_id} {j} of the page" for j in range(12)) for r in got)
