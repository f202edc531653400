"""The thin queries over the operators, each with production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, filter_audit, html_extract, mixing, ngram_join, phrase_mining, sentencepiece_codec, sharding, substring_dedup, topk_search, toxicity, url_filter
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ARRIVAL_IDS = 1024
PIECE_MODEL = os.environ.get("SIEVELANE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered(docs))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, 50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, scratch(spark))
    store.append(table(spark, sf_dir, "documents"), F.floor(F.col("doc_id") / ARRIVAL_IDS))
    version = store.compact()
    return store.read(version).select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(version).alias("version"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode(docs, sentencepiece_codec.PieceModel.load(PIECE_MODEL), keep=["doc_id"])


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, "85/100")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS t(host, path, verdict)")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents").select("lang", "text"), 100, 2000)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"), "toxic")
    return filter_audit.audit(filter_audit.with_labels(failed, labels, ["good", "toxic"]), "ABCDE", ["good", "toxic"])


PLANTED_CHAT = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit(PLANTED_CHAT)
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    done = chat_format.format_chats(chats.unionByName(planted))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat_format.learned_text(F.col("formatted"), F.col("mask"))
    return done.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_MIX_SQL = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
weights AS (SELECT source, n, round(sqrt(n), 6) AS w FROM counts),
shares AS (
  SELECT source, n, greatest(1, CAST(round(sqrt(n) * 1000 / sum(CAST(w AS DECIMAL(30, 6))) OVER ()::DOUBLE) AS BIGINT)) AS share,
    row_number() OVER (ORDER BY source) AS i
  FROM weights),
listed AS (SELECT list(share ORDER BY i) AS shares, CAST(sum(share) AS BIGINT) AS w FROM shares),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(shares, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, shares, w FROM listed
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, shares, w
  FROM (
    SELECT *, list_min(list_transform(done, lambda d, i: CASE WHEN d < shares[i] AND (d * w) // shares[i] <= t
      THEN (((d + 1) * w + shares[i] - 1) // shares[i]) * 1000000 + i END)) % 1000000 AS p
    FROM edf WHERE t < w)),
slots AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t > 0),
ranked AS (
  SELECT doc_id, coalesce(source, '') AS s, source,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank
  FROM documents)
SELECT r.doc_id, r.source, r.rank // 64 AS block, (r.rank // 64) // h.share * l.w + s.slot AS slot, CAST(r.rank % 64 AS INTEGER) AS place
FROM ranked r JOIN shares h ON h.source = r.s JOIN slots s ON s.i = h.i AND s.nth = (r.rank // 64) % h.share, listed l
"""


def _compaction_sql() -> str:
    small, target, fanout, tiers = 4 << 20, 128 << 20, 4, 3
    bounds = [0] + [target // fanout ** (tiers - t) for t in range(tiers)]
    ctes = [
        f"""sized AS (SELECT doc_id, coalesce(doc_id // {ARRIVAL_IDS}, -1) AS arrival, coalesce(strlen(text), 0) AS size,
  CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) / 4294967296.0 AS share FROM documents)""",
        f"slices AS (SELECT arrival, greatest(1, CAST(ceil(sum(size) / {small}) AS BIGINT)) AS k FROM sized GROUP BY 1)",
        "placed AS (SELECT doc_id, s.arrival, CAST(floor(s.share * l.k) AS BIGINT) AS slice, size FROM sized s JOIN slices l ON l.arrival = s.arrival)",
        "state0 AS (SELECT arrival, slice, arrival AS ia, slice AS isl, CAST(floor(arrival / 4096) AS BIGINT) AS rng, sum(size) AS bytes, count(*) AS n FROM placed GROUP BY 1, 2)",
    ]
    for t in range(1, tiers + 1):
        ctes += [
            f"runs{t} AS (SELECT rng, ia, isl, sum(bytes) AS b FROM state{t - 1} GROUP BY 1, 2, 3)",
            f"tier{t} AS (SELECT *, (row_number() OVER (PARTITION BY rng ORDER BY ia, isl) - 1) // {fanout} AS g FROM runs{t} WHERE b >= {bounds[t - 1]} AND b < {bounds[t]})",
            f"first{t} AS (SELECT *, count(*) OVER (PARTITION BY rng, g) AS c, first_value(ia) OVER (PARTITION BY rng, g ORDER BY ia, isl) AS fa, first_value(isl) OVER (PARTITION BY rng, g ORDER BY ia, isl) AS fs FROM tier{t})",
            f"state{t} AS (SELECT s.arrival, s.slice, coalesce(f.fa, s.ia) AS ia, coalesce(f.fs, s.isl) AS isl, s.rng, s.bytes, s.n FROM state{t - 1} s LEFT JOIN first{t} f ON f.c = {fanout} AND f.rng = s.rng AND f.ia = s.ia AND f.isl = s.isl)",
        ]
    return f"""WITH {", ".join(ctes)}, total AS (SELECT ia, isl, sum(n) AS rows, sum(bytes) AS bytes FROM state{tiers} GROUP BY 1, 2)
SELECT p.doc_id, CAST(s.ia AS VARCHAR) || '-' || CAST(s.isl AS VARCHAR) AS shard, CAST(t.rows AS BIGINT) AS shard_rows, CAST(t.bytes AS BIGINT) AS shard_bytes, 2 AS version
FROM placed p JOIN state{tiers} s ON s.arrival = p.arrival AND s.slice = p.slice JOIN total t ON t.ia = s.ia AND t.isl = s.isl"""


_GOOD_VECTORS = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

_DEDUP_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND {_GOOD_VECTORS} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.c, e.vec_id) AS component_id, coalesce(l.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN low l ON l.x = e.vec_id
"""

_JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingles),
lists AS (SELECT doc_id, unnest(s) AS g FROM shingles),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM lists a JOIN lists b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = p.x JOIN sizes b ON b.doc_id = p.y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(l.c, s.doc_id) AS component_id FROM sizes s LEFT JOIN low l ON l.x = s.doc_id
"""

_TOPK_SQL = f"""
WITH good AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND {_GOOD_VECTORS} GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_URL_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {_RULE_ROWS}),
p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS i FROM p),
best AS (
  SELECT i, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY i)
SELECT q.page_id, q.host, q.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM q LEFT JOIN best b ON b.i = q.i
"""

_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM words)),
counts AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(k) AS k, count(*) AS f FROM runs GROUP BY 1, 2 HAVING count(*) >= 100),
candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f FROM counts WHERE k > 1),
inner_runs AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
  SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, f, w, k, unnest(range(2, k)) AS m FROM candidates))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_runs GROUP BY 1, 2),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer l USING (lang, phrase) WHERE l.f IS NULL OR 100 * l.f < 100 * c.f),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
scored AS (
  SELECT x.lang, x.phrase, x.f AS a, x.c, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * x.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN totals t ON t.lang = x.lang
  JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.c], ' ')
  JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.c + 1:x.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000
"""

_AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
failed AS (
  SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)} AS f FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
groups AS (
  SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, o[s] AS x, o[1:s - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS s)),
met AS (
  SELECT part, o, s, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS alone,
    len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone FROM groups, steps),
sums AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, x, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums
"""

_CHAT_SQL = r"""
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
safe AS (
  SELECT *, regexp_replace(regexp_replace(text, '(\\*)### ', '\\\1### ', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g') AS t,
    regexp_replace(regexp_replace(regexp_replace(role, '(\\*)### ', '\\\1### ', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g'), ':(\\*)\n', ':\\\1' || chr(10), 'g') AS r FROM chats),
sums AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
    sum(length('### ' || r || ':' || t || '</turn>') + 2) AS formatted_chars FROM safe GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM sums
"""

QUERIES: dict[str, Query] = {
    "op1_html_extract": op1_html_extract,
    "op2_mix_sources": op2_mix_sources,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_shard_compaction": op5_shard_compaction,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_exact_topk": op9_exact_topk,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_format": op13_chat_format,
}

ORACLE: dict[str, str] = {
    "op2_mix_sources": _MIX_SQL,
    "op4_embedding_dedup": _DEDUP_SQL,
    "op5_shard_compaction": _compaction_sql(),
    "op7_ngram_jaccard": _JACCARD_SQL,
    "op9_exact_topk": _TOPK_SQL,
    "op10_url_filter": _URL_SQL,
    "op11_collocations": _PHRASE_SQL,
    "op12_filter_audit": _AUDIT_SQL,
    "op13_chat_format": _CHAT_SQL,
}
