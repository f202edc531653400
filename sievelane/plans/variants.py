"""Queries: the smaller variants of text, ranking, labelling and checking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gates, joins, labels, metrics, sampling, windows
from .adapters import ITEMS_SQL, PAIRS_SQL, POSITIVES_SQL, TERMS_SQL, items, pairs, positives, query, table, terms, with_
from .calibration import _F1
from .labelling import _HASH
from .ranking import _RANK
from .texts import _ATTR, _JOINED, joined

_SLASHES = "replace(lower(category), '/', ' ')"
_FOLD_KEY = "term_id || '|42'"
_WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"


@query("word_lengths", with_(TERMS_SQL) + f"SELECT term_id, CAST(len({_WORDS.format('query')}) AS INTEGER) AS n_words, CAST(len(list_distinct({_WORDS.format('query')})) AS INTEGER) AS n_distinct FROM terms")
def word_lengths(spark, sf):
    """Words with repeats, and distinct words."""
    return terms(spark, sf).select("term_id", F.size(X.words(F.col("query"))).alias("n_words"), F.size(X.word_set(F.col("query"))).alias("n_distinct"))


@query(
    "category_overlap",
    with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL, _JOINED)
    + f"SELECT id, CAST(len(list_intersect(list_distinct({_WORDS.format('lower(query)')}), list_distinct({_WORDS.format(_SLASHES)}))) AS INTEGER) AS shared FROM j",
)
def category_overlap(spark, sf):
    """Distinct words that a query shares with its item's category."""
    q, c = X.word_set(F.lower("query")), X.word_set(F.replace(F.lower("category"), F.lit("/"), F.lit(" ")))
    return joined(spark, sf).select("id", X.overlap(q, c).alias("shared"))


@query(
    "short_product_text",
    with_(ITEMS_SQL) + f"SELECT item_id, concat_ws(' ', left(title, 70), '[' || split_part(category, '/', 3) || ']', 'renk:' || {_ATTR.format('renk')}, 'materyal:' || {_ATTR.format('materyal')}) AS product FROM items",
)
def short_product_text(spark, sf):
    c = F.col
    return items(spark, sf).select("item_id", X.product_text(c("title"), c("category"), c("attributes"), cut=70).alias("product"))


@query("truth_and_prediction", with_(PAIRS_SQL) + "SELECT id, label AS label_truth, CAST(s1 >= 0.5 AS INTEGER) AS label_pred FROM pairs WHERE term_id % 2 = 0")
def truth_and_prediction(spark, sf):
    """Two tables with the same column names, joined by id and told apart by suffixes."""
    p = pairs(spark, sf)
    truth, said = p.select("id", "label"), p.filter("term_id % 2 = 0").select("id", (F.col("s1") >= 0.5).cast("int").alias("label"))
    return truth.withColumnRenamed("label", "label_truth").join(said.withColumnRenamed("label", "label_pred"), "id")


@query(
    "strict_lookup",
    with_(PAIRS_SQL, ITEMS_SQL) + "SELECT id, brand FROM pairs JOIN items USING (item_id) WHERE label = 1",
)
def strict_lookup(spark, sf):
    """A lookup that fails if an item is missing."""
    p = pairs(spark, sf).filter("label = 1").select("id", "item_id")
    return joins.strict_lookup(p, items(spark, sf).select("item_id", "brand"), "item_id").select("id", "brand")


@query(
    "term_categories",
    with_(PAIRS_SQL, ITEMS_SQL, POSITIVES_SQL, "c AS (SELECT DISTINCT term_id, split_part(category, '/', 1) AS root, split_part(category, '/', 3) AS leaf FROM positives JOIN items USING (item_id))")
    + "SELECT term_id, string_agg(DISTINCT root, '|' ORDER BY root) AS roots, string_agg(DISTINCT leaf, '|' ORDER BY leaf) AS leaves FROM c GROUP BY term_id",
)
def term_categories(spark, sf):
    """The distinct roots and leaves of a term's positives; there are only as many as there are categories."""
    c = F.col("category")
    p = positives(spark, sf).join(items(spark, sf).select("item_id", X.category_root(c).alias("root"), X.category_leaf(c).alias("leaf")), "item_id")
    listed = lambda name: F.array_join(F.array_sort(F.collect_set(name)), "|")
    return p.groupBy("term_id").agg(listed("root").alias("roots"), listed("leaf").alias("leaves"))


@query("root_items", with_(ITEMS_SQL) + "SELECT split_part(category, '/', 1) AS root, count(*) AS n_items, min(item_id) AS first_item FROM items GROUP BY 1")
def root_items(spark, sf):
    """The items of each root, counted; members stay rows, since a root may hold a third of them."""
    return items(spark, sf).groupBy(X.category_root(F.col("category")).alias("root")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))


@query(
    "top_fractions",
    with_(PAIRS_SQL, f"r AS (SELECT id, {_RANK.format('price', 'DESC')} AS r FROM pairs)") + "SELECT id, CAST(r <= 0.30 AS INTEGER) AS top_30, CAST(r <= 0.33 AS INTEGER) AS top_33, CAST(r <= 0.36 AS INTEGER) AS top_36 FROM r",
)
def top_fractions(spark, sf):
    """Three fractions of each term's rows, over one window."""
    return pairs(spark, sf).select("id", *[windows.top_fraction("price", "term_id", f / 100).alias(f"top_{f}") for f in (30, 33, 36)])


@query(
    "best_rate",
    with_(
        PAIRS_SQL,
        f"q AS (SELECT quantile_cont(s3, [{', '.join(repr(1.0 - r / 100) for r in range(20, 46))}]) AS q FROM pairs)",
        "t AS (SELECT unnest(range(20, 46)) / 100.0::DOUBLE AS rate, unnest(q) AS thr FROM q)",
        "c AS (SELECT rate, any_value(thr) AS thr, count(*) FILTER (label = 1 AND s3 >= thr) AS tp, count(*) FILTER (label = 0 AND s3 >= thr) AS fp, count(*) FILTER (label = 1 AND s3 < thr) AS fn, count(*) FILTER (label = 0 AND s3 < thr) AS tn FROM pairs, t GROUP BY rate)",
        f"f AS (SELECT rate, thr, {_F1} AS f FROM c)",
    )
    + "SELECT round(rate, 2) AS rate, round(thr, 9) AS threshold, round(f, 9) AS macro_f1 FROM f ORDER BY round(f, 12) DESC, rate LIMIT 1",
)
def best_rate(spark, sf):
    """The target rate whose quantile gives the highest macro-F1; of equal ones the smallest."""
    swept = metrics.sweep_rates(pairs(spark, sf).select("s3", "label"), "s3", F.col("label"), [r / 100 for r in range(20, 46)])
    f1 = swept.select(F.round("rate", 2).alias("rate"), F.round("threshold", 9).alias("threshold"), "macro_f1")
    return f1.orderBy(F.desc(F.round("macro_f1", 12)), "rate").limit(1).withColumn("macro_f1", F.round("macro_f1", 9))


@query(
    "positions_without_positives",
    with_(PAIRS_SQL, "r AS (SELECT id, term_id, label, row_number() OVER (PARTITION BY term_id ORDER BY price DESC, item_id) - 1 AS position FROM pairs)")
    + "SELECT id, term_id, CAST(position AS INTEGER) AS position FROM r WHERE position IN (0, 2, 4) AND label = 0",
)
def positions_without_positives(spark, sf):
    """Fixed ranks first, positives removed after, so that a positive leaves its place empty."""
    p = pairs(spark, sf)
    picked = windows.rank_positions(p.select("id", "term_id", "item_id", "price"), ["term_id"], [F.desc("price"), F.asc("item_id")], [0, 2, 4])
    return picked.join(positives(spark, sf), ["term_id", "item_id"], "left_anti").select("id", "term_id", "position")


_LABELS = """l AS (SELECT id, CAST(s1 >= 0.5 AS INTEGER) AS label, 'mini' AS source, 3 AS priority FROM pairs WHERE item_id % 2 = 0 UNION ALL SELECT id, CAST(s2 >= 0.5 AS INTEGER), 'agent', 2 FROM pairs WHERE item_id % 3 = 0
  UNION ALL SELECT id, CAST(s3 >= 0.5 AS INTEGER), 'large', 1 FROM pairs WHERE item_id % 5 = 0)"""


def _labelled(p):
    sources = [("s1", 2, "mini", 3), ("s2", 3, "agent", 2), ("s3", 5, "large", 1)]
    parts = [p.filter(F.col("item_id") % n == 0).select("id", (F.col(s) >= 0.5).cast("int").alias("label"), F.lit(name).alias("source"), F.lit(at).alias("priority")) for s, n, name, at in sources]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_small_first", with_(PAIRS_SQL, _LABELS) + "SELECT id, label, source FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority DESC) = 1")
def label_small_first(spark, sf):
    """The order of sources turned round: the small judge over the agent over the large judge."""
    return labels.by_precedence(_labelled(pairs(spark, sf)), ["id"]).select("id", "label", "source")


_DISTILLED = [
    PAIRS_SQL,
    "a AS (SELECT id, term_id, CAST(s2 >= 0.5 AS INTEGER) AS label, 0 AS o FROM pairs WHERE item_id % 10 = 0)",
    "b AS (SELECT id, term_id, CAST(s1 >= 0.5 AS INTEGER) AS label, 1 AS o FROM pairs WHERE item_id % 10 < 2)",
    "c AS (SELECT id, term_id, CASE WHEN s3 < 0.05 THEN 0 ELSE 1 END AS label, 2 AS o FROM pairs WHERE s3 < 0.05 OR s3 > 0.9)",
    "d AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1)",
]


def _distilled(spark, sf):
    p = pairs(spark, sf)
    a = p.filter("item_id % 10 = 0").select("id", "term_id", (F.col("s2") >= 0.5).cast("int").alias("label"), F.lit(0).alias("o"))
    b = p.filter("item_id % 10 < 2").select("id", "term_id", (F.col("s1") >= 0.5).cast("int").alias("label"), F.lit(1).alias("o"))
    c = p.select("id", "term_id", F.when(F.col("s3") < 0.05, 0).when(F.col("s3") > 0.9, 1).alias("label"), F.lit(2).alias("o")).filter("label IS NOT NULL")
    return labels.keep_first(a.unionByName(b).unionByName(c), ["id"], [F.col("o")])


@query("distill_folds", with_(*_DISTILLED) + f"SELECT id, label, CAST(o AS INTEGER) AS origin, CAST({_HASH.format(_FOLD_KEY)} % 5 AS INTEGER) AS fold FROM d")
def distill_folds(spark, sf):
    """Two label sources and the easy tails, the first to label a row wins, with folds by term."""
    return _distilled(spark, sf).select("id", "label", F.col("o").alias("origin"), sampling.hash_fold(F.col("term_id")).alias("fold"))


@query("clean_set")
def clean_set(spark, sf):
    """The same rows with crc32 folds by term. DuckDB has no crc32, so there is no SQL."""
    return _distilled(spark, sf).select("id", "term_id", "label", sampling.crc32_fold(F.col("term_id").cast("string")).alias("fold"))


@query(
    "train_gate_sized",
    with_(PAIRS_SQL)
    + "SELECT unnest(['row_count', 'positives', 'unique_pairs', 'no_nulls']) AS check_name, unnest([count(*) = 1000000, sum(label) = 250000, count(DISTINCT (term_id, item_id)) = count(*), count(*) FILTER (id IS NULL OR price IS NULL OR label IS NULL) = 0]) AS passed FROM pairs",
)
def train_gate_sized(spark, sf):
    """The gate with the sizes that a full training set must have; smaller tables fail the first two checks."""
    return gates.train_gate(pairs(spark, sf), rows=1_000_000, positives=250_000)


@query(
    "judge_output_gate",
    with_(PAIRS_SQL, "given AS (SELECT id FROM pairs WHERE term_id % 7 <> 0 UNION ALL SELECT id FROM pairs WHERE term_id % 11 = 1 UNION ALL SELECT -l_orderkey FROM lineitem WHERE l_linenumber = 7)")
    + "SELECT (SELECT count(*) FROM pairs WHERE id NOT IN (SELECT id FROM given)) AS missing, (SELECT count(*) FROM given WHERE id NOT IN (SELECT id FROM pairs)) AS extra, (SELECT count(*) - count(DISTINCT id) FROM given) AS repeated",
)
def judge_output_gate(spark, sf):
    """A judge's output with rows missing, repeated and made up."""
    p = pairs(spark, sf).select("id", "term_id")
    made_up = table(spark, sf, "lineitem").filter("l_linenumber = 7").select((-F.col("l_orderkey")).alias("id"))
    given = p.filter("term_id % 7 <> 0").select("id").unionByName(p.filter("term_id % 11 = 1").select("id")).unionByName(made_up)
    return gates.id_gate(p, given)


@query(
    "hard_validation",
    with_(PAIRS_SQL, "r AS (SELECT id, label, row_number() OVER (PARTITION BY term_id ORDER BY s3 DESC, item_id) AS rank FROM pairs WHERE term_id % 5 = 4)")
    + "SELECT id, CAST(label AS INTEGER) AS label FROM r WHERE rank <= 3 OR label = 1",
)
def hard_validation(spark, sf):
    """The best candidates of held-out terms, as a test set would have them, with their known positives."""
    p = pairs(spark, sf).filter("term_id % 5 = 4")
    best = windows.top_k(p.select("term_id", "item_id", "s3"), ["term_id"], [F.desc("s3"), F.asc("item_id")], 3)
    flagged = joins.flag_members(best, p.filter("label = 1").select("term_id", "item_id"), ["term_id", "item_id"])
    return flagged.select((F.col("term_id") * 10000000 + F.col("item_id")).alias("id"), F.col("label").cast("int").alias("label"))
