"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``docs``. Nulls, empty texts, repeated rows and extra columns are treated as the docstrings
of the operators say; extra columns come along.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelane.llm import mixing, ngram_join, sentencepiece_codec, substring_dedup, toxicity
from sievelane.llm.common import bounded, materialise, small_batches, table
from sievelane.llm.queries import PIECE_MODEL

#: Stages on word shingles compare shingles of five words at this similarity.
SHINGLE_WORDS, SIMILARITY = 5, "80/100"
WINDOW_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose text is predicted toxic; learn from ``labels``, but not from its held-out fold."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    # the score's columns are dropped again, so extra columns of docs with their names are renamed meanwhile
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    scored = toxicity.score(plain, model, text_col=f"c{columns.index('text')}")
    return scored.filter("predicted = 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest doc_id, and of the rows
    that repeat its id the one with the smallest digest of all columns. Rows without an id or without words stay."""
    small_batches(spark)
    groups = ngram_join.similar_components(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILARITY)
    gone = materialise(groups.filter("component_id < doc_id").select("doc_id").distinct())
    repeated = materialise(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    left = docs.join(bounded(gone, 16), "doc_id", "left_anti")
    once = left.join(bounded(repeated, 16), "doc_id", "left_anti")
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    many = left.join(bounded(repeated, 16), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row")).select("row.*")
    return once.unionByName(many).select(*[f"`{c.replace('`', '``')}`" for c in docs.columns])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that start in a document with a smaller id. Documents without such a passage keep
    their text as it is; others keep their other words, joined by one space, and n_chars follows.
    A document of which nothing is left goes."""
    small_batches(spark)
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    cut = substring_dedup.remove_repeats(plain, WINDOW_WORDS, at["doc_id"], at["text"], keep=plain.columns)
    cut = cut.filter("n_removed < n_words OR n_words = 0")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return cut.select(*[new.get(c, F.col(at[c])).alias(c) for c in columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order in which the sources meet their target weights: files in the order of their names, and the rows in each,
    are the mix. ``mixed_place`` reads it back, whatever order the files are scanned in."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    mixed = mixing.mix(plain, mixing.tempered(docs), id_col=at["doc_id"], source_col=at["source"])
    return mixed.orderBy("slot", "place").select(*[F.col(at[c]).alias(c) for c in columns])  # no input column is called slot or place now


MIX = ["mix_file", "mix_row"]


def mixed_place(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_file and mix_row, long: the number of the Parquet file that a row stands in, from its name, and its place in that file; together they
    order the rows as they were written. Rows that come from no file have nulls. Own columns of these names get ``_in`` behind them."""
    names = {c.lower() for c in docs.columns}
    for new in MIX:
        if new in names:
            docs = docs.withColumnRenamed(new, f"{new}_in")
    number = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS BIGINT)") * 1_000_000 + F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '-c([0-9]+)', 1) AS BIGINT)"), F.lit(0))
    try:
        return docs.select("*", number.alias(MIX[0]), F.col("_metadata.row_index").alias(MIX[1]))
    except AnalysisException:  # not the rows of files
        return docs.withColumns({c: F.lit(None).cast("bigint") for c in MIX})


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but for the text, with mix_file and mix_row, its place in the mix, and n_pieces, ids and round_trip; own columns of
    these names come out with ``_in`` behind them."""
    small_batches(spark)
    return sentencepiece_codec.encode(mixed_place(docs), sentencepiece_codec.PieceModel.load(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The toxicity model, the join of near duplicates and the pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
