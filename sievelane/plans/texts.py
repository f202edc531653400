"""Queries: cleaning, lexical and structural features, product texts, parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import verdicts as V
from ..functions.vectors import softmax1
from ..operators.normalise import normalise_texts
from ..sources import readers
from .adapters import ITEMS_SQL, PAIRS_SQL, TERMS_SQL, items, pairs, query, table, terms, with_



def _lower(c: str) -> str:
    return f"lower(replace(replace({c}, 'İ', 'i'), 'I', 'ı'))"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _basic(c: str) -> str:
    return _clean(_lower(c))


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


_JOINED = "j AS (SELECT p.id, p.term_id, p.item_id, t.query, i.* EXCLUDE (item_id) FROM pairs p JOIN terms t USING (term_id) JOIN items i USING (item_id))"


def joined(spark, sf):
    """Pairs with their texts. What depends on one side alone is computed before the join by the callers that matter."""
    return pairs(spark, sf).select("id", "term_id", "item_id").join(terms(spark, sf), "term_id").join(items(spark, sf), "item_id")


@query("normalize_basic", with_(TERMS_SQL) + f"SELECT term_id, {_basic('query')} AS qn, len({_words(_basic('query'))}) AS n_words FROM terms")
def normalize_basic(spark, sf):
    q = terms(spark, sf).withColumn("qn", X.normalise_basic(F.col("query")))
    return q.select("term_id", "qn", F.size(X.words(F.col("qn"))).cast("bigint").alias("n_words"))


def _strip(word: str, suffixes: list[str]) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{s}') AND length({word}) >= {len(s) + 3} THEN left({word}, length({word}) - {len(s)})" for s in suffixes)
    return f"CASE {cases} ELSE {word} END"


def _normalise_sql(c: str) -> str:
    out = _lower(c)
    for a, b in X.ABBREVIATIONS.items():
        if a.isascii():
            out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    brands = ", ".join(f"'{b}'" for b in X.BRANDS)
    near = ", ".join(f"'{b}'" for b in X.BRANDS if len(b) > 3 and b.isascii())
    fixed = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in X.CORRECTIONS.items())
    correct = f"list_transform({_words(_clean(out))}, lambda w: CASE {fixed} ELSE coalesce(list_min(list_filter([{near}], lambda b: levenshtein(w, b) = 1)), w) END)"
    stem1 = f"list_transform({correct}, lambda w: CASE WHEN w IN ({brands}) OR length(w) <= 3 THEN w ELSE {_strip('w', X.CASE_SUFFIXES)} END)"
    return f"array_to_string(list_transform({stem1}, lambda w: CASE WHEN w IN ({brands}) OR length(w) <= 2 THEN w ELSE {_strip('w', X.PLURAL_SUFFIXES)} END), ' ')"


@query("normalize_full", with_(TERMS_SQL) + f"SELECT term_id, {_normalise_sql('query')} AS qn FROM terms")
def normalize_full(spark, sf):
    # queries repeat: each distinct text is normalised once
    t = terms(spark, sf)
    return t.join(normalise_texts(t.select("query").distinct(), "query", "qn"), "query").select("term_id", "qn")


_SETS = f"s AS (SELECT *, list_distinct({_words(_basic('query'))}) AS q, list_distinct({_words(_basic('title'))}) AS t, {_basic('query')} AS qn, {_basic('title')} AS tn FROM j)"


def token_sides(spark, sf):
    """Pairs with both sides' normalised texts and word sets, made once per term and per item."""
    t = terms(spark, sf).withColumn("qn", X.normalise_basic(F.col("query"))).withColumn("q", X.word_set(F.col("qn")))
    i = items(spark, sf).withColumn("tn", X.normalise_basic(F.col("title"))).withColumn("t", X.word_set(F.col("tn")))
    return pairs(spark, sf).select("id", "term_id", "item_id").join(t, "term_id").join(i, "item_id")


@query(
    "lexical_features",
    with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL, _JOINED, _SETS)
    + """SELECT id, round(len(list_intersect(q, t)) / greatest(1, len(q))::DOUBLE, 6) AS coverage,
  round(len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t)))::DOUBLE, 6) AS jaccard, CAST(len(list_intersect(q, t)) AS INTEGER) AS overlap,
  CAST(greatest(1, len(q)) AS INTEGER) AS q_len, CAST(len(t) AS INTEGER) AS t_len, round(greatest(1, len(q)) / greatest(1, len(t))::DOUBLE, 6) AS len_ratio,
  CAST(length(qn) AS INTEGER) AS char_len_query, round(length(qn) / greatest(1, length(tn))::DOUBLE, 6) AS char_count_ratio FROM s""",
)
def lexical_features(spark, sf):
    q, t = F.col("q"), F.col("t")
    qlen = F.greatest(F.lit(1), F.size(q))
    return token_sides(spark, sf).select(
        "id",
        F.round(X.coverage(q, t), 6).alias("coverage"),
        F.round(X.jaccard(q, t), 6).alias("jaccard"),
        X.overlap(q, t).alias("overlap"),
        qlen.alias("q_len"),
        F.size(t).alias("t_len"),
        F.round(X.ratio(qlen, F.size(t)), 6).alias("len_ratio"),
        F.length("qn").alias("char_len_query"),
        F.round(X.ratio(F.length("qn"), F.length("tn")), 6).alias("char_count_ratio"),
    )


@query(
    "char3_jaccard",
    with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL, _JOINED, _SETS, "g AS (SELECT id, list_distinct(list_transform(range(1, length(qn) - 1), lambda i: substr(qn, i, 3))) AS a, list_distinct(list_transform(range(1, length(tn) - 1), lambda i: substr(tn, i, 3))) AS b FROM s)")
    + "SELECT id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS jaccard_char_3gram FROM g",
)
def char3_jaccard(spark, sf):
    t = terms(spark, sf).select("term_id", X.trigrams(X.normalise_basic(F.col("query"))).alias("a"))
    i = items(spark, sf).select("item_id", X.trigrams(X.normalise_basic(F.col("title"))).alias("b"))
    p = pairs(spark, sf).select("id", "term_id", "item_id").join(t, "term_id").join(i, "item_id")
    return p.select("id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard_char_3gram"))


_FEMALE, _CHILD = "(contains(qn, 'kadın') OR contains(qn, 'kız') OR contains(qn, 'bayan'))", "(contains(qn, 'bebek') OR contains(qn, 'çocuk') OR contains(qn, 'baby') OR contains(qn, 'kid'))"


@query(
    "structural_features",
    with_(
        PAIRS_SQL,
        TERMS_SQL,
        ITEMS_SQL,
        _JOINED,
        _SETS,
        "k AS (SELECT *, list_filter([" + ", ".join(f"'{c}'" for c in X.COLOURS) + "], lambda c: contains(qn, c)) AS asked, trim(regexp_extract(lower(coalesce(attributes, '')), 'renk:\\s*([^,]+)', 1)) AS own FROM s)",
    )
    + f"""SELECT id, CASE WHEN contains(query, brand) THEN 1.0::DOUBLE ELSE 0 END AS brand_in_query,
  CASE WHEN {_FEMALE} AND gender = 'erkek' THEN 1.0::DOUBLE WHEN (contains(qn, 'erkek') OR contains(qn, 'bay')) AND gender = 'kadın' THEN 1 ELSE 0 END AS gender_contra,
  CASE WHEN {_FEMALE} AND gender = 'erkek' THEN 1.0::DOUBLE WHEN (contains(qn, 'erkek') OR regexp_matches(qn, '\\bbay\\b')) AND gender = 'kadın' THEN 1 ELSE 0 END AS gender_contra_bounded,
  CASE WHEN {_CHILD} AND age_group = 'yetişkin' THEN 1.0::DOUBLE ELSE 0 END AS age_contra,
  CASE WHEN len(asked) = 0 THEN 0.0::DOUBLE WHEN own <> '' AND len(list_filter(asked, lambda c: contains(own, c))) > 0 THEN 1 WHEN own = '' AND len(list_filter(asked, lambda c: contains(tn, c))) > 0 THEN 1 ELSE 0 END AS color_match,
  CASE WHEN len(asked) > 0 AND own <> '' AND len(list_filter(asked, lambda c: contains(own, c))) = 0 THEN 1.0::DOUBLE ELSE 0 END AS color_mismatch FROM k""",
)
def structural_features(spark, sf):
    j = token_sides(spark, sf)
    match, mismatch = X.colour_match(F.col("qn"), F.col("tn"), F.col("attributes"))
    return j.select(
        "id",
        X.brand_in_query(F.col("brand"), F.col("query")).alias("brand_in_query"),
        X.gender_contradiction(F.col("qn"), F.col("gender")).alias("gender_contra"),
        X.gender_contradiction(F.col("qn"), F.col("gender"), bounded=True).alias("gender_contra_bounded"),
        X.age_contradiction(F.col("qn"), F.col("age_group")).alias("age_contra"),
        match.alias("color_match"),
        mismatch.alias("color_mismatch"),
    )


@query(
    "category_depth",
    with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL, _JOINED, _SETS, f"l AS (SELECT id, q, list_transform(string_split(category, '/'), lambda x: {_words(_basic('x'))}) AS levels FROM s)", "h AS (SELECT id, list_filter(list_transform(levels, lambda x, i: CASE WHEN len(list_intersect(x, q)) > 0 THEN i - 1 END), lambda i: i IS NOT NULL) AS hits FROM l)")
    + "SELECT id, CAST(coalesce(list_max(hits), -1) AS DOUBLE) AS max_depth, CAST(len(hits) AS DOUBLE) AS n_levels FROM h",
)
def category_depth(spark, sf):
    depth, count = X.category_depth(F.col("category"), F.col("q"))
    return token_sides(spark, sf).select("id", depth.alias("max_depth"), count.alias("n_levels"))


@query("category_parts", with_(ITEMS_SQL) + "SELECT item_id, split_part(category, '/', 1) AS root, split_part(category, '/', 3) AS leaf, coalesce(gender, 'unknown') AS gender, coalesce(attributes, '') AS attributes FROM items")
def category_parts(spark, sf):
    return items(spark, sf).select("item_id", X.category_root(F.col("category")).alias("root"), X.category_leaf(F.col("category")).alias("leaf"), F.coalesce("gender", F.lit("unknown")).alias("gender"), X.text("attributes").alias("attributes"))


_ATTR = "nullif(trim(regexp_extract(lower(coalesce(attributes, '')), '{0}:\\s*([^,]+)', 1)), '')"


@query(
    "product_text",
    with_(ITEMS_SQL)
    + f"""SELECT item_id, concat_ws(' ', left(title, 90), '[' || split_part(category, '/', 3) || ']', 'marka:' || brand, gender, 'renk:' || {_ATTR.format('renk')}, 'materyal:' || {_ATTR.format('materyal')}) AS product,
  title || ' . marka ' || brand || ' kategori ' || split_part(category, '/', 3) || ' renk ' || coalesce({_ATTR.format('renk')}, '') || ' materyal ' || coalesce({_ATTR.format('materyal')}, '') AS document,
  concat_ws(' . ', title, 'marka ' || brand, 'kategori ' || replace(category, '/', ' > '), coalesce(gender, '') || ' ' || age_group, 'renk ' || {_ATTR.format('renk')}, 'materyal ' || {_ATTR.format('materyal')}, 'boy ' || {_ATTR.format('boy')}) AS rich,
  'passage: ' || title AS passage FROM items""",
)
def product_text(spark, sf):
    c = F.col
    args = (c("title"), c("brand"), c("category"), c("gender"), c("age_group"), c("attributes"))
    return items(spark, sf).select(
        "item_id",
        X.product_text(c("title"), c("category"), c("attributes"), c("brand"), c("gender")).alias("product"),
        X.document_text(*args, rich=False).alias("document"),
        X.document_text(*args).alias("rich"),
        X.with_prefix(c("title"), "passage").alias("passage"),
    )


@query(
    "stacker_lexical",
    with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL, _JOINED, "s AS (SELECT id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9çğıöşü]+')) AS q, list_distinct(regexp_extract_all(lower(title), '[a-z0-9çğıöşü]+')) AS t FROM j)")
    + "SELECT id, CAST(len(list_intersect(q, t)) AS INTEGER) AS tok_overlap, round(len(list_intersect(q, t)) / greatest(1, len(q) + len(t) - len(list_intersect(q, t)))::DOUBLE, 6) AS jaccard, CAST(len(q) AS INTEGER) AS q_ntok, CAST(len(t) AS INTEGER) AS t_ntok FROM s",
)
def stacker_lexical(spark, sf):
    shared, j, q, t = X.stacker_lexical(F.col("query"), F.col("title"))
    return joined(spark, sf).select("id", shared.alias("tok_overlap"), F.round(j, 6).alias("jaccard"), q.alias("q_ntok"), t.alias("t_ntok"))


@query("levenshtein", with_(ITEMS_SQL) + "SELECT item_id, CAST(levenshtein(split_part(title, ' ', 1), split_part(title, ' ', 2)) AS INTEGER) AS distance FROM items")
def levenshtein(spark, sf):
    w = F.split("title", " ")
    return items(spark, sf).select("item_id", X.levenshtein(F.get(w, F.lit(0)), F.get(w, F.lit(1))).alias("distance"))


# one reply per event: its number as the verdict in the shapes that judges use
_REPLY_SQL = "r AS (SELECT event_id, '1. ' || (event_id % 3) || chr(10) || '2. ' || (event_id % 2) || CASE event_id % 4 WHEN 0 THEN ' evet' WHEN 1 THEN '' WHEN 2 THEN ' 12' ELSE chr(10) || 'none' END AS reply FROM events)"


def _replies(spark, sf):
    e = F.col("event_id")
    tail = F.when(e % 4 == 0, " evet").when(e % 4 == 1, "").when(e % 4 == 2, " 12").otherwise("\nnone")
    return table(spark, sf, "events").select(e, F.concat(F.lit("1. "), (e % 3).cast("string"), F.lit("\n2. "), (e % 2).cast("string"), tail).alias("reply"))


@query(
    "verdict_parse",
    with_(_REPLY_SQL, "n AS (SELECT *, regexp_extract_all(reply, '\\d+') AS nums, regexp_extract_all(reply, '[01]') AS bits FROM r)")
    + """SELECT event_id, coalesce(CAST(nullif(regexp_extract(reverse(reply), '([01])\\b', 1), '') AS INTEGER), 1) AS last_one, CAST(regexp_extract(reply, '[01]') AS INTEGER) AS first_one,
  CAST(CASE WHEN nums[-1] IN ('0', '1') THEN nums[-1] ELSE bits[-1] END AS INTEGER) AS last_number,
  CAST(nullif(regexp_extract(reply, '(?m)^\\s*1\\s*[.):\\-]\\s*([01])', 1), '') AS INTEGER) AS line_1, CAST(nullif(regexp_extract(reply, '(?m)^\\s*2\\s*[.):\\-]\\s*([01])', 1), '') AS INTEGER) AS line_2 FROM n""",
)
def verdict_parse(spark, sf):
    r = F.col("reply")
    return _replies(spark, sf).select("event_id", V.last_verdict(r, 1).alias("last_one"), V.first_verdict(r).alias("first_one"), V.last_number_verdict(r).alias("last_number"), V.numbered_verdict(r, 1).alias("line_1"), V.numbered_verdict(r, 2).alias("line_2"))


@query(
    "verdict_rows",
    with_(_REPLY_SQL, "l AS (SELECT event_id, unnest(string_split(reply, chr(10))) AS line FROM r)") + "SELECT event_id, CAST(regexp_extract(line, '^(\\d+)\\.', 1) AS INTEGER) AS n, CAST(nullif(regexp_extract(line, '^\\d+\\. ([01])', 1), '') AS INTEGER) AS label FROM l WHERE regexp_matches(line, '^\\d+\\.')",
)
def verdict_rows(spark, sf):
    """A reply to its labels, a row each."""
    rows = _replies(spark, sf).select("event_id", F.explode(F.split("reply", "\n")).alias("line")).filter(F.col("line").rlike(r"^\d+\."))
    return rows.select("event_id", F.regexp_extract("line", r"^(\d+)\.", 1).cast("int").alias("n"), F.nullif(F.regexp_extract("line", r"^\d+\. ([01])", 1), F.lit("")).cast("int").alias("label"))


@query(
    "judge_lines",
    with_(PAIRS_SQL, TERMS_SQL, ITEMS_SQL, _JOINED) + "SELECT CAST(id AS VARCHAR) AS id, query, title || CASE WHEN item_id % 2 = 0 THEN ' | ' || brand ELSE '' END AS product, title || CASE WHEN item_id % 2 = 0 THEN '|' || brand ELSE '' END AS bare FROM j",
)
def judge_lines(spark, sf):
    j = joined(spark, sf)
    line = F.concat(F.col("id").cast("string"), F.lit(" | "), F.col("query"), F.lit(" | "), F.col("title"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" | "), F.col("brand"))).otherwise(""))
    rows = j.select(line.alias("value"))
    i, q, p = readers.split_line(F.col("value"))
    return rows.select(i.alias("id"), q.alias("query"), p.alias("product"), readers.split_bare(F.col("value"))[2].alias("bare"))


@query(
    "reply_json",
    """SELECT CAST(event_id AS VARCHAR) AS custom_id, CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status_code, CASE WHEN event_type <> 'error' THEN event_type END AS content,
  user_id AS prompt_tokens, 1::BIGINT AS completion_tokens, event_type = 'error' AS failed FROM events""",
)
def reply_json(spark, sf):
    e = table(spark, sf, "events")
    message = F.struct(F.struct(F.col("event_type").alias("content")).alias("message"))
    usage = F.struct(F.col("user_id").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"))
    response = F.struct(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.struct(F.array(message).alias("choices"), usage.alias("usage")).alias("body"))
    return readers.reply_fields(e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), response.alias("response"))).alias("value")))


@query(
    "reply_cost",
    """SELECT count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors, round(sum(user_id) * 0.15::DOUBLE / 1000000 + count(*) * 0.6::DOUBLE / 1000000, 9) AS cost,
  count(*) FILTER (event_type <> 'error') < 0.8 * count(*) AS unreliable FROM events""",
)
def reply_cost(spark, sf):
    r = reply_json(spark, sf)
    ok = F.count_if(~F.col("failed"))
    return r.agg(ok.alias("ok"), F.count_if("failed").alias("errors"), F.round(F.sum("prompt_tokens") * 0.15 / 1000000 + F.sum("completion_tokens") * 0.6 / 1000000, 9).alias("cost"), (ok < F.count("*") * 0.8).alias("unreliable"))


@query("request_json", with_(ITEMS_SQL) + """SELECT item_id, '{"custom_id":"' || item_id || '","method":"POST","url":"/v1/chat/completions","body":{"model":"judge","messages":[{"role":"user","content":"' || title || '"}],"temperature":0,"max_tokens":4}}' AS line FROM items""")
def request_json(spark, sf):
    return items(spark, sf).select("item_id", readers.request_line(F.col("item_id"), "judge", F.col("title")).alias("line"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("softmax", with_(PAIRS_SQL) + "SELECT id, round(1.0 / (1.0 + exp(s1 - s3)), 9) AS p FROM pairs")
def softmax(spark, sf):
    return pairs(spark, sf).select("id", F.round(softmax1(F.col("s1"), F.col("s3")), 9).alias("p"))


@query("numbered_text", with_(ITEMS_SQL) + "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN title ELSE title || ' x' END AS expanded FROM items")
def numbered_text(spark, sf):
    line = F.when(F.col("item_id") % 3 == 0, F.lit("7. ")).otherwise(F.concat(F.lit("7. "), F.col("title"), F.lit(" x")))
    return items(spark, sf).select("item_id", V.numbered_text(line, F.col("title")).alias("expanded"))
