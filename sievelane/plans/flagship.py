"""The flagship query: candidate features, a target-rate decision and its report, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics, windows
from .adapters import ITEMS_SQL, PAIRS_SQL, items, pairs, query, with_

_RANK = "(rank() OVER (PARTITION BY term_id ORDER BY s1) + (count(*) OVER (PARTITION BY term_id, s1) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY term_id)::DOUBLE"


@query(
    "flagship",
    with_(
        PAIRS_SQL,
        ITEMS_SQL,
        f"""f AS (SELECT id, term_id, item_id, label, s3, {_RANK} AS pct, (price - avg(price) OVER w) / (stddev_samp(price) OVER w + 1e-6) AS z, count(*) OVER w AS n_cand
  FROM pairs WINDOW w AS (PARTITION BY term_id))""",
        "t AS (SELECT quantile_cont(s3, 0.67) AS threshold FROM pairs)",
    )
    + """SELECT id, round(pct, 6) AS pct, round(z, 5) AS z, n_cand, brand, CAST(length(title) AS INTEGER) AS title_chars, CAST(s3 >= threshold AS INTEGER) AS prediction, label
FROM f JOIN items USING (item_id), t""",
)
def flagship(spark, sf):
    p = pairs(spark, sf)
    threshold = metrics.rate_threshold(p.select("s3"), "s3", [0.33]).select("threshold")
    scored = p.select(
        "id", "item_id", "label", "s3",
        F.round(windows.percent_rank_averaged("s1", "term_id"), 6).alias("pct"),
        F.round(windows.zscore("price", "term_id"), 5).alias("z"),
        windows.group_size("term_id").alias("n_cand"),
    )
    texts = items(spark, sf).select("item_id", "brand", F.length(X.text("title")).alias("title_chars"))
    decided = scored.join(F.broadcast(threshold)).withColumn("prediction", (F.col("s3") >= F.col("threshold")).cast("int"))  # one row
    return decided.join(texts, "item_id").select("id", "pct", "z", "n_cand", "brand", "title_chars", "prediction", "label")
