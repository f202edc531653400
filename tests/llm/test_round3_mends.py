"""Deep nesting of dropped elements, and the mix that survives being written."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from sievelane.llm import html_extract, mixing
from sievelane.llm.common import materialise

ARTICLE = "<article><h1>Head</h1><p>Some prose of the page that is the content.</p></article>"


TAGS = ["<nav>", "<form>", '<div class="ad">', "<div hidden>", "<div>", "<section class='sidebar'>", "<aside>"]


def test_elements_nested_deep(spark):
    def page(tag, depth):
        return f"<html><body>{ARTICLE}{tag * depth}<p>buy now</p>{f'</{re.match("<([a-z]+)", tag)[1]}>' * depth}</body></html>"

    rows = [(f"{tag} {depth}", f"http://h{i}.{depth}/1", page(tag, depth)) for i, tag in enumerate(TAGS) for depth in (79, 81, 300, 10_000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {r[0]: "Head\nSome prose of the page that is the content." for r in rows}


def test_what_is_deep_and_dropped_goes_and_the_rest_stays():
    inside = "<p>before</p><nav>menu<div>of links</div></nav><form>name<p>field</p></form><div class='ad'>spend</div><p>after</p>"
    text = "\n".join(html_extract._all_texts(html_extract.parse("<body>" + "<div>" * 100 + inside + "</div>" * 100 + "</body>")))
    assert text == "before\nafter"
    wrapped = "<div class='sidebar layout'><p>left</p>" + ARTICLE + "</div>"
    text = "\n".join(html_extract._all_texts(html_extract.parse("<body>" + "<div>" * 100 + wrapped + "</div>" * 100 + "</body>")))
    assert "Some prose" in text


def test_the_mix_survives_the_write(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.repeat("text", F.lit(9))).otherwise(F.col("text")))  # files of unlike size
    docs = materialise(docs.withColumn("Mix_Row", F.lit("mine")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mix_sources(spark, docs, data).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(str(tmp_path / "mixed"))
    assert written.columns == docs.columns and len(list((tmp_path / "mixed").glob("part-*"))) > 4
    out = corpus_pipeline.encode_pieces(spark, written, data)
    assert {"mix_file", "mix_row", "mix_row_in"} <= set(out.columns) and "Mix_Row" not in out.columns
    got = [r["doc_id"] for r in out.orderBy("mix_file", "mix_row").select("doc_id").collect()]
    want = [r["doc_id"] for r in mixing.mix(docs.select("doc_id", "source"), mixing.tempered(docs)).orderBy("slot", "place").collect()]
    assert got == want
    assert out.select("mix_file", "mix_row").distinct().count() == docs.count()


def test_rows_of_no_file_have_no_place(spark):
    out = corpus_pipeline.mixed_place(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert [tuple(r) for r in out.collect()] == [(1, "a", None, None)]
