"""Queries: joins, label precedence, selection of rows to judge, training sets, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import gates, joins, judge, labels, sampling
from ..operators.windows import global_rank
from ..sources.shared import fresh
from .adapters import ITEMS_SQL, PAIRS_SQL, TERMS_SQL, items, pairs, query, table, terms, with_


@query("pairs_enriched", with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL) + "SELECT p.id, t.query, i.title, coalesce(i.brand, '') AS brand FROM pairs p LEFT JOIN terms t USING (term_id) LEFT JOIN items i USING (item_id)")
def pairs_enriched(spark, sf):
    e = joins.enrich(pairs(spark, sf).select("id", "term_id", "item_id"), terms(spark, sf), items(spark, sf).select("item_id", "title"))
    return joins.lookup(e, items(spark, sf), "item_id", "brand").select("id", "query", "title", "brand")


@query("pairs_semi", with_(PAIRS_SQL) + "SELECT id FROM pairs WHERE item_id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def pairs_semi(spark, sf):
    return pairs(spark, sf).join(table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("item_id")), "item_id", "left_semi").select("id")


@query(
    "pair_similarity",
    with_(PAIRS_SQL, "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
    + "SELECT p.id, round(coalesce(list_dot_product(a.e, b.e), 0), 5) AS emb_cos, round(coalesce(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 0), 5) AS cosine FROM pairs p LEFT JOIN v a ON a.vec_id = p.term_id LEFT JOIN v b ON b.vec_id = p.item_id",
)
def pair_similarity(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    p = pairs(spark, sf).select("id", "term_id", "item_id")
    dots = joins.similarity(p, e, e, "term_id", "item_id")
    a, b = e.select(F.col("vec_id").alias("term_id"), F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("b"))
    both = dots.join(a, "term_id", "left").join(b, "item_id", "left")
    return both.select("id", F.round("emb_cos", 5).alias("emb_cos"), F.round(cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


@query("default_prediction", with_(PAIRS_SQL) + "SELECT id, CASE WHEN item_id % 7 = 0 THEN 0 ELSE CAST(s3 >= 0.5 AS INTEGER) END AS prediction FROM pairs")
def default_prediction(spark, sf):
    p = pairs(spark, sf)
    known = p.filter("item_id % 7 <> 0").select("id", (F.col("s3") >= 0.5).cast("int").alias("prediction"))
    return joins.default_prediction(p.select("id"), known)


@query("flag_members", with_(PAIRS_SQL) + "SELECT term_id, item_id, max(label) AS label FROM pairs WHERE s3 >= 0.3 OR label = 1 GROUP BY term_id, item_id")
def flag_members(spark, sf):
    p = pairs(spark, sf)
    return joins.flag_members(p.filter("s3 >= 0.3"), p.filter("label = 1"), ["term_id", "item_id"])


_SOURCES = """src AS (SELECT doc_id AS id, quality AS label, 'mini' AS source, 0 AS priority FROM labels UNION ALL SELECT doc_id, toxic, 'rescue', 1 FROM labels WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, CAST(n_chars > 2000 AS INTEGER), 'rule', 2 FROM documents WHERE doc_id % 5 = 0)"""


def label_sources(spark, sf):
    lab = table(spark, sf, "labels")
    rule = table(spark, sf, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 2000).cast("int").alias("label"))
    return labels.union_sources([("mini", lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))), ("rescue", lab.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))), ("rule", rule)])


@query("label_precedence", with_(_SOURCES) + "SELECT id, arg_max(label, priority) AS label, arg_max(source, priority) AS source FROM src GROUP BY id")
def label_precedence(spark, sf):
    return labels.by_precedence(label_sources(spark, sf), ["id"])


@query("label_first_wins", with_(_SOURCES) + "SELECT id, arg_min(label, priority) AS label, arg_min(source, priority) AS source FROM src GROUP BY id")
def label_first_wins(spark, sf):
    return labels.by_precedence(label_sources(spark, sf), ["id"], first_wins=True)


@query("label_keep_first", with_(_SOURCES) + "SELECT id, label, source FROM src QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority) = 1")
def label_keep_first(spark, sf):
    return labels.keep_first(label_sources(spark, sf), ["id"], [F.asc("priority")]).select("id", "label", "source")


@query("labelled_mask", "SELECT d.doc_id, l.quality AS y, l.quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def labelled_mask(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id", "left")
    return d.withColumn("labelled", F.col("y").isNotNull())


@query("resume_antijoin", with_(PAIRS_SQL) + "SELECT id, s3 FROM pairs WHERE s3 BETWEEN 0.3 AND 0.6 AND id NOT IN (SELECT id FROM pairs WHERE item_id % 4 = 0)")
def resume_antijoin(spark, sf):
    p = pairs(spark, sf).select("id", "item_id", "s3")
    return labels.resume(p.filter(labels.in_band(F.col("s3"), 0.3, 0.6)), p.filter("item_id % 4 = 0")).select("id", "s3")


@query("rescue_candidates", with_(PAIRS_SQL) + "SELECT id FROM pairs WHERE s2 < 0.03 AND (s1 > 0.5 OR s3 > 0.5)")
def rescue_candidates(spark, sf):
    return pairs(spark, sf).filter(labels.rescue(F.col("s2"), [F.col("s1"), F.col("s3")])).select("id")


_CONFLICT = "c AS (SELECT id, CASE WHEN s3 BETWEEN 0.03 AND 0.85 THEN CASE WHEN label = 0 AND s3 >= 0.5 THEN s3 WHEN label = 1 AND s3 <= 0.08 THEN 1.0 - s3 END END AS strength FROM pairs)"


@query("conflict_topk", with_(PAIRS_SQL, _CONFLICT) + "SELECT id, round(strength, 9) AS strength FROM c WHERE strength IS NOT NULL ORDER BY strength DESC, id DESC LIMIT 500")
def conflict_topk(spark, sf):
    c = pairs(spark, sf).select("id", labels.conflict(F.col("s3"), F.col("label")).alias("strength")).filter("strength IS NOT NULL")
    return c.orderBy(F.desc("strength"), F.desc("id")).limit(500).withColumn("strength", F.round("strength", 9))


_DISPUTE = "d AS (SELECT id, label, round(abs(label - (s1 + s2 + s3) / 3.0::DOUBLE), 9) AS dispute FROM pairs)"


def _disputes(spark, sf):
    d = labels.disagreement(F.col("label"), [F.col("s1"), F.col("s2"), F.col("s3")])
    return pairs(spark, sf).select("id", F.round(d, 9).alias("dispute"))


@query("disputed_topk", with_(PAIRS_SQL, _DISPUTE) + "SELECT id, dispute FROM d ORDER BY dispute DESC, id LIMIT 1000")
def disputed_topk(spark, sf):
    return _disputes(spark, sf).orderBy(F.desc("dispute"), "id").limit(1000)


@query("disputed_tier", with_(PAIRS_SQL, _DISPUTE) + "SELECT id, dispute FROM d WHERE dispute >= 0.30 AND dispute < 0.50")
def disputed_tier(spark, sf):
    return _disputes(spark, sf).filter("dispute >= 0.30 AND dispute < 0.50")


_TIER = "SELECT id, round({0}, 9) AS dispute FROM pairs WHERE {1} BETWEEN 0.03 AND 0.97 AND round({0}, 9) >= 0.30 AND round({0}, 9) < 0.50 ORDER BY dispute DESC, id LIMIT 2000"


@query("disputed_tier_top", with_(PAIRS_SQL) + _TIER.format("abs(label - (s1 + s2 + s3) / 3.0::DOUBLE)", "s3"))
def disputed_tier_top(spark, sf):
    """The first 2,000 of the tier, strongest first, within the uncertain band of one model."""
    return labels.disputed_tier(pairs(spark, sf), F.col("label"), [F.col("s1"), F.col("s2"), F.col("s3")], F.col("s3"), 2000)


@query("disputed_tier_pair", with_(PAIRS_SQL) + _TIER.format("abs(label - (s1 + s2) / 2.0::DOUBLE)", "s1"))
def disputed_tier_pair(spark, sf):
    """The same with two models and another base."""
    return labels.disputed_tier(pairs(spark, sf), F.col("label"), [F.col("s1"), F.col("s2")], F.col("s1"), 2000)


_HEAD = "Answer 1 if the title has an even number of letters, else 0.\n"
_EXAMPLES = [("ab", 1), ("abc", 0)]


def _moody(prompt: str, attempt: int) -> str:
    """A stand-in for a service: it is busy, refuses, leaves a line out or answers in bare lines, by the length of the first title."""
    titles = [line.split(". ", 1)[1] for line in prompt.split("\n")[1 + len(_EXAMPLES) :]]
    first = len(titles[0])
    if first % 5 == 0 and attempt < 2:
        raise judge.Transient("busy")
    if first % 7 == 0:
        raise judge.Permanent("refused")
    out = [str(1 - len(t) % 2) for t in titles]
    if first % 3 == 0:
        return "\n".join(out)
    lines = [f"{i}. {v}" for i, v in enumerate(out, 1)]
    return "\n".join(lines[:-1] if first % 11 == 1 else lines)


@query(
    "judged_rows",
    """WITH r AS (SELECT p_partkey AS item_id, length(p_name) AS size, (row_number() OVER (ORDER BY p_partkey) - 1) // 15 AS call FROM part),
c AS (SELECT *, first_value(size) OVER w AS first, row_number() OVER w AS n, count(*) OVER (PARTITION BY call) AS m FROM r WINDOW w AS (PARTITION BY call ORDER BY item_id)),
a AS (SELECT item_id, CASE WHEN first % 5 = 0 THEN 3 ELSE 1 END AS attempts, CASE WHEN first % 7 = 0 THEN 'permanent: refused' WHEN first % 3 <> 0 AND first % 11 = 1 AND n = m THEN 'no verdict in the reply' END AS error, 1 - size % 2 AS v FROM c)
SELECT item_id, CASE WHEN error IS NULL THEN CAST(v AS INTEGER) END AS verdict, CAST(attempts AS INTEGER) AS attempts, error FROM a""",
)
def judged_rows(spark, sf):
    """Every title judged in calls of fifteen by a service that fails now and then: verdicts, and dead letters with their errors."""
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    done, dead = judge.judge(titles, "item_id", F.col("p_name"), _moody, fresh(spark), 15, _HEAD, _EXAMPLES, base=0.0)
    given = done.select(F.col("key").alias("item_id"), "verdict", "attempts", F.lit(None).cast("string").alias("error"))
    return given.unionByName(dead.select(F.col("key").alias("item_id"), F.lit(None).cast("int").alias("verdict"), "attempts", "error"))


@query(
    "judge_file_gate",
    with_(PAIRS_SQL, "r AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 400 AS shard, (row_number() OVER (ORDER BY id) - 1) % 400 AS position FROM pairs)", "k AS (SELECT shard, count(*) AS n, shard % 4 AS kind FROM r GROUP BY shard)")
    + """SELECT CAST(shard AS INTEGER) AS shard, kind <> 1 AS has_header, CASE WHEN kind = 3 AND n > 1 THEN n - 1 ELSE n END AS lines, CASE WHEN kind = 2 THEN n - n % 2 WHEN kind = 3 AND n > 1 THEN 1 ELSE 0 END AS wrong_ids,
  CAST(CASE WHEN kind = 2 AND n > 1 THEN 0 WHEN kind = 3 AND n > 1 THEN n - 1 END AS INTEGER) AS first_wrong, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS bad_labels FROM k""",
)
def judge_file_gate(spark, sf):
    """Answer files of 400 lines: one in four each with a label that is none, without a header, with neighbours swapped, or without its last line."""
    path = fresh(spark)
    r = global_rank(pairs(spark, sf).select("id", "label"), "id", "id", "_r").select("id", "label", F.floor(F.col("_r") / 400).cast("int").alias("shard"), (F.col("_r") % 400).cast("int").alias("position"))
    n, kind = F.count("*").over(Window.partitionBy("shard")), F.col("shard") % 4
    other = F.col("position").bitwiseXOR(F.lit(1))
    rows = r.withColumn("_n", n).withColumn("at", F.when((kind == 2) & (other < F.col("_n")), other).otherwise(F.col("position"))).filter((kind != 3) | (F.col("_n") == 1) | (F.col("position") < F.col("_n") - 1))
    line = F.concat(F.col("id").cast("string"), F.lit(","), F.when((kind == 0) & (F.col("position") == 0), "maybe").otherwise(F.col("label").cast("string")))
    text = rows.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("_l"))  # 400 lines
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    text.select("shard", F.when(kind == 1, body).otherwise(F.concat(F.lit("id,label\n"), body)).alias("value")).write.partitionBy("shard").text(path)
    return gates.file_gate(spark, path, r)


@query(
    "uncertainty_topk",
    with_(PAIRS_SQL) + "SELECT id, round(abs((s1 + s2 + s3) / 3.0::DOUBLE - 0.5), 9) AS uncertainty FROM pairs WHERE item_id % 3 <> 0 ORDER BY uncertainty, id LIMIT 500",
)
def uncertainty_topk(spark, sf):
    p = pairs(spark, sf)
    todo = labels.resume(p, p.filter("item_id % 3 = 0"))
    return todo.select("id", F.round(F.abs(labels.mean_of([F.col("s1"), F.col("s2"), F.col("s3")]) - 0.5), 9).alias("uncertainty")).orderBy("uncertainty", "id").limit(500)


@query("easy_tails", with_(PAIRS_SQL) + "SELECT id, CASE WHEN s1 < 0.03 AND s3 < 0.3 THEN 0 ELSE 1 END AS label FROM pairs WHERE (s1 < 0.03 AND s3 < 0.3) OR (s1 > 0.97 AND s3 > 0.7)")
def easy_tails(spark, sf):
    return pairs(spark, sf).select("id", labels.easy_tails(F.col("s1"), F.col("s3")).alias("label")).filter("label IS NOT NULL")


@query("denoise_band", with_(PAIRS_SQL) + "SELECT count(*) FILTER (s3 > 0.5) AS dropped, count(*) FILTER (s3 < 0.2) AS kept, count(*) FILTER (s3 BETWEEN 0.2 AND 0.5) AS unsure FROM pairs")
def denoise_band(spark, sf):
    s = F.col("s3")
    return pairs(spark, sf).agg(F.count_if(s > 0.5).alias("dropped"), F.count_if(s < 0.2).alias("kept"), F.count_if(s.between(0.2, 0.5)).alias("unsure"))


@query(
    "llm_trainset",
    with_(
        PAIRS_SQL,
        "base AS (SELECT term_id, item_id, label, CAST(term_id % 5 AS INTEGER) AS fold FROM pairs WHERE term_id % 3 <> 0)",
        "fresh AS (SELECT term_id, item_id, CAST(s1 >= 0.5 AS INTEGER) AS label FROM pairs WHERE item_id % 4 = 0)",
        "folds AS (SELECT DISTINCT term_id, fold FROM base)",
        "u AS (SELECT term_id, item_id, label, fold, 0 AS p FROM fresh JOIN folds USING (term_id) UNION ALL SELECT *, 1 FROM base)",
    )
    + "SELECT term_id, item_id, arg_min(label, p) AS label, arg_min(fold, p) AS fold FROM u GROUP BY term_id, item_id",
)
def llm_trainset(spark, sf):
    p = pairs(spark, sf)
    base = p.filter("term_id % 3 <> 0").select("term_id", "item_id", "label", (F.col("term_id") % 5).cast("int").alias("fold"))
    return labels.override_base(base, p.filter("item_id % 4 = 0").select("term_id", "item_id", (F.col("s1") >= 0.5).cast("int").alias("label")))


_HASH = "CAST('0x' || md5({0})[1:8] AS BIGINT)"


@query(
    "distill_set",
    with_(
        PAIRS_SQL,
        "judged AS (SELECT id, CAST(s2 >= 0.5 AS INTEGER) AS label FROM pairs WHERE item_id % 10 = 0)",
        "easy AS (SELECT id, CASE WHEN s3 < 0.05 THEN 0 ELSE 1 END AS label FROM pairs WHERE (s3 < 0.05 OR s3 > 0.9) AND id NOT IN (SELECT id FROM judged))",
        f"picked AS (SELECT id, label FROM easy QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_HASH.format("label || '|' || id || '|42'")}, id) <= 2000)",
    )
    + "SELECT id, label, 'judge' AS source FROM judged UNION ALL SELECT id, label, 'easy' FROM picked",
)
def distill_set(spark, sf):
    p = pairs(spark, sf)
    judged = p.filter("item_id % 10 = 0").select("id", (F.col("s2") >= 0.5).cast("int").alias("label"))
    easy = p.select("id", F.when(F.col("s3") < 0.05, 0).when(F.col("s3") > 0.9, 1).alias("label")).filter("label IS NOT NULL")
    picked = sampling.sample_per_group(labels.resume(easy, judged), ["label"], "id", 2000)
    return judged.withColumn("source", F.lit("judge")).unionByName(picked.withColumn("source", F.lit("easy")))


@query("term_union", with_(TERMS_SQL) + "SELECT CAST(term_id AS VARCHAR) AS term_id, query FROM terms UNION ALL SELECT 'SYN_' || term_id, query || ' x' FROM terms WHERE term_id % 10 = 0")
def term_union(spark, sf):
    t = terms(spark, sf)
    return labels.merge_synthetic(t, t.filter("term_id % 10 = 0").select("term_id", F.concat("query", F.lit(" x")).alias("query")))


@query("term_difference", with_(PAIRS_SQL) + "SELECT DISTINCT term_id FROM pairs EXCEPT SELECT term_id FROM pairs WHERE label = 1")
def term_difference(spark, sf):
    p = pairs(spark, sf)
    return p.select("term_id").distinct().join(p.filter("label = 1").select("term_id"), "term_id", "left_anti")


@query("positives_index", with_(PAIRS_SQL) + "SELECT term_id, list_sort(list(item_id)) AS item_ids, count(*) AS n FROM pairs WHERE label = 1 GROUP BY term_id")
def positives_index(spark, sf):
    return pairs(spark, sf).filter("label = 1").groupBy("term_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n"))


@query("labels_by_position", "SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) < 6 THEN ([1, 0, 0, 1, 1, 0])[row_number() OVER (ORDER BY doc_id)] END AS label FROM labels")
def labels_by_position(spark, sf):
    """A hand-made list of labels zipped with ids in order."""
    given = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (1, 0, 0, 1, 1, 0)])).alias("_r", "label"))
    from ..operators.windows import global_rank

    ids = global_rank(table(spark, sf, "labels").select("doc_id"), "doc_id", "doc_id", "_r")
    return ids.join(F.broadcast(given), "_r", "left").select("doc_id", "label")


@query(
    "train_gate",
    with_(PAIRS_SQL) + "SELECT unnest(['row_count', 'positives', 'unique_pairs', 'no_nulls']) AS check_name, unnest([TRUE, TRUE, count(DISTINCT (term_id, item_id)) = count(*), count(*) FILTER (id IS NULL OR price IS NULL OR label IS NULL) = 0]) AS passed FROM pairs",
)
def train_gate(spark, sf):
    return gates.train_gate(pairs(spark, sf))


@query(
    "submission_gate",
    with_(PAIRS_SQL)
    + "SELECT unnest(['row_count', 'no_nulls', 'binary', 'two_classes']) AS check_name, unnest([count(*) = (SELECT count(*) FROM lineitem), TRUE, TRUE, count(DISTINCT label) = 2]) AS passed FROM pairs",
)
def submission_gate(spark, sf):
    return gates.submission_gate(pairs(spark, sf).select("id", F.col("label").alias("prediction")), table(spark, sf, "lineitem").count())


@query(
    "id_gate",
    "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, 0::BIGINT AS extra, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS repeated",
)
def id_gate(spark, sf):
    return gates.id_gate(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("exam_gate", with_(PAIRS_SQL, "e AS (SELECT avg(CASE WHEN label = 1 THEN CAST(s1 >= 0.5 AS INTEGER) END) AS recall, avg(CASE WHEN label = 0 THEN CAST(s1 >= 0.5 AS INTEGER) END) AS fpr FROM pairs)") + "SELECT round(recall, 9) AS recall, round(fpr, 9) AS fpr, recall >= 0.9 AND fpr <= 0.1 AS passed FROM e")
def exam_gate(spark, sf):
    from ..operators.metrics import exam

    r = gates.exam_gate(exam(pairs(spark, sf), F.col("label"), (F.col("s1") >= 0.5).cast("int")))
    return r.select(F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"), "passed")


@query("null_counts", 'SELECT unnest([\'doc_id\', \'text\', \'lang\', \'source\', \'n_chars\']) AS "column", unnest([count(*) FILTER (doc_id IS NULL), count(*) FILTER (text IS NULL), count(*) FILTER (lang IS NULL), count(*) FILTER (source IS NULL), count(*) FILTER (n_chars IS NULL)]) AS nulls FROM documents')
def null_counts(spark, sf):
    return gates.null_counts(table(spark, sf, "documents"))


@query("aligned_scores", with_(PAIRS_SQL) + "SELECT TRUE AS aligned, count(*) AS n_keys FROM pairs")
def aligned_scores(spark, sf):
    p = pairs(spark, sf)
    return gates.aligned(p.select("id", "s1"), p.select("id", "s2"))
