"""Queries: macro-F1, sweeps, prevalence, exams, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, metrics
from .adapters import PAIRS_SQL, pairs, query, table, with_

_F1 = """CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END / 2 + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tn / (2 * tn + fp + fn) END / 2"""


def _sweep_sql(low: int, high: int, scale: int, score: str = "s3", wneg: str = "1.0::DOUBLE", extra: str = "") -> str:
    return with_(
        PAIRS_SQL,
        f"grid AS (SELECT g / {float(scale)}::DOUBLE AS t FROM range({low}, {high + 1}) r(g))",
        *([extra] if extra else []),
        f"""c AS (SELECT t, sum(CASE WHEN label = 1 AND {score} >= t THEN 1.0::DOUBLE ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND {score} >= t THEN {wneg} ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND {score} < t THEN 1.0::DOUBLE ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND {score} < t THEN {wneg} ELSE 0 END) AS tn FROM pairs, grid{', w' if extra else ''} GROUP BY t)""",
        f"s AS (SELECT t, {_F1} AS f FROM c)",
    )


@query(
    "macro_f1_at",
    with_(PAIRS_SQL, "c AS (SELECT count(*) FILTER (label = 1 AND s3 >= 0.5) AS tp, count(*) FILTER (label = 0 AND s3 >= 0.5) AS fp, count(*) FILTER (label = 1 AND s3 < 0.5) AS fn, count(*) FILTER (label = 0 AND s3 < 0.5) AS tn FROM pairs)")
    + f"""SELECT round(tp / (tp + fp)::DOUBLE, 6) AS precision_1, round(tp / (tp + fn)::DOUBLE, 6) AS recall_1, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1_1,
  round(tn / (tn + fn)::DOUBLE, 6) AS precision_0, round(tn / (tn + fp)::DOUBLE, 6) AS recall_0, round(2.0::DOUBLE * tn / (2 * tn + fp + fn), 6) AS f1_0, round({_F1}, 6) AS macro_f1 FROM c""",
)
def macro_f1_at(spark, sf):
    r = metrics.class_report(pairs(spark, sf), F.col("label"), (F.col("s3") >= 0.5).cast("int"))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def _sweeps(name: str, low: int, high: int, scale: int, score: str, largest: bool = False) -> None:
    @query(f"sweep_{name}", _sweep_sql(low, high, scale, score) + "SELECT round(t, 9) AS t, round(f, 9) AS macro_f1 FROM s")
    def run(spark, sf):
        s = metrics.sweep(pairs(spark, sf), F.col(score), F.col("label"), low, high, scale)
        return s.select(F.round("t", 9).alias("t"), F.round("macro_f1", 9).alias("macro_f1"))

    @query(f"best_{name}", _sweep_sql(low, high, scale, score) + f"SELECT t, round(f, 9) AS macro_f1 FROM s ORDER BY round(f, 12) DESC, t {'DESC' if largest else ''} LIMIT 1")
    def pick(spark, sf):
        s = metrics.sweep(pairs(spark, sf), F.col(score), F.col("label"), low, high, scale)
        return metrics.best(s, largest=largest).select("t", F.round("macro_f1", 9).alias("macro_f1"))


_sweeps("threshold", 10, 90, 100, "s3")
_sweeps("fine", 10, 189, 200, "s3")
_sweeps("coarse", 15, 35, 50, "s1", largest=True)
_sweeps("wide", 5, 94, 100, "s2")
_sweeps("training", 10, 89, 100, "s3")
_sweeps("hard_rows", 10, 94, 100, "s2")
_sweeps("sparse", 6, 14, 20, "s1", largest=True)


@query(
    "weighted_f1_prevalence",
    _sweep_sql(4, 195, 200, "s3", "w.v", "w AS (SELECT sum(label) * (1.0::DOUBLE - 0.3) / ((count(*) - sum(label)) * 0.3::DOUBLE) AS v FROM pairs)") + "SELECT round(t, 9) AS t, round(f, 7) AS macro_f1 FROM s",
)
def weighted_f1_prevalence(spark, sf):
    p = pairs(spark, sf)
    w = p.agg(metrics.negative_weight(F.sum("label").cast("double"), F.sum(1 - F.col("label")).cast("double"), 0.3).alias("_wn"))
    p = p.join(F.broadcast(w))  # one row
    s = metrics.sweep(p, F.col("s3"), F.col("label"), 4, 195, 200, F.when(F.col("label") == 0, F.col("_wn")).otherwise(1.0))
    return s.select(F.round("t", 9).alias("t"), F.round("macro_f1", 7).alias("macro_f1"))


@query("all_zeros_score", with_(PAIRS_SQL) + "SELECT round(1.0::DOUBLE - avg(label), 9) AS negatives, round((1 - avg(label)) / (2 - avg(label)), 9) AS macro_f1 FROM pairs")
def all_zeros(spark, sf):
    return pairs(spark, sf).agg(F.avg("label").alias("p")).select(F.round(1.0 - F.col("p"), 9).alias("negatives"), F.round(metrics.all_zeros_score(F.col("p")), 9).alias("macro_f1"))


@query(
    "sweep_ppr",
    with_(
        PAIRS_SQL,
        "q AS (SELECT quantile_cont(s3, [" + ", ".join(f"(1.0::DOUBLE - {r}::DOUBLE / 100)" for r in range(20, 46)) + "]) AS q FROM pairs)".replace("(1.0::DOUBLE - ", "("),
        "t AS (SELECT unnest(range(20, 46)) / 100.0::DOUBLE AS rate, unnest(q) AS thr FROM q)",
        "c AS (SELECT rate, count(*) FILTER (label = 1 AND s3 >= thr) AS tp, count(*) FILTER (label = 0 AND s3 >= thr) AS fp, count(*) FILTER (label = 1 AND s3 < thr) AS fn, count(*) FILTER (label = 0 AND s3 < thr) AS tn FROM pairs, t GROUP BY rate)",
    )
    + f"SELECT round(rate, 2) AS rate, round({_F1}, 6) AS macro_f1 FROM c",
)
def sweep_ppr(spark, sf):
    c = metrics.sweep_rates(pairs(spark, sf).select("s3", "label"), "s3", F.col("label"), [r / 100 for r in range(20, 46)])
    return c.select(F.round("rate", 2).alias("rate"), F.round("macro_f1", 6).alias("macro_f1"))


_WEIGHTS = "w AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, (10 - a - b) / 10.0::DOUBLE AS c FROM range(0, 11) x(a), range(0, 11) y(b) WHERE a + b <= 10)"


@query(
    "weight_grid",
    with_(
        PAIRS_SQL,
        _WEIGHTS,
        """g AS (SELECT a, b, c, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn
  FROM (SELECT a, b, c, label, round(a * s1 + b * s2 + c * s3, 9) >= 0.45 AS p FROM pairs, w) GROUP BY a, b, c)""",
    )
    + f"SELECT a, b, c, round({_F1}, 6) AS macro_f1 FROM g",
)
def weight_grid(spark, sf):
    weights = metrics.weight_triples()
    c = metrics.swept(metrics.contingency(pairs(spark, sf), ["s1", "s2", "s3"], F.col("label"), [0.45], weights, 9), [0.45], weights)
    named = [F.get(F.array(*[F.lit(w[i]) for w in weights]), F.col("w")).alias(n) for i, n in enumerate("abc")]
    return c.select(*named, F.round("macro_f1", 6).alias("macro_f1"))


@query("judge_exam", with_(PAIRS_SQL) + "SELECT round(avg(CASE WHEN label = 1 THEN CAST(s1 >= 0.5 AS INTEGER) END), 9) AS recall, round(avg(CASE WHEN label = 0 THEN CAST(s1 >= 0.5 AS INTEGER) END), 9) AS fpr, count(*) AS n FROM pairs")
def judge_exam(spark, sf):
    return metrics.exam(pairs(spark, sf), F.col("label"), (F.col("s1") >= 0.5).cast("int")).select(F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"), "n")


@query("fold_summary", with_(PAIRS_SQL) + "SELECT CAST(term_id % 5 AS INTEGER) AS fold, count(*) AS n, round(avg(label), 9) AS positive_rate FROM pairs GROUP BY 1")
def fold_summary(spark, sf):
    p = pairs(spark, sf).withColumn("fold", (F.col("term_id") % 5).cast("int"))
    return labels.fold_summary(p).withColumn("positive_rate", F.round("positive_rate", 9))


@query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("candidates_per_term", with_(PAIRS_SQL) + "SELECT round(avg(label), 9) AS positive_rate, round(count(*) / count(DISTINCT term_id)::DOUBLE, 9) AS per_term, count(DISTINCT (term_id, item_id)) AS n_pairs FROM pairs")
def candidates_per_term(spark, sf):
    return pairs(spark, sf).agg(
        F.round(F.avg("label"), 9).alias("positive_rate"), F.round(F.count("*").cast("double") / F.count_distinct("term_id"), 9).alias("per_term"), F.count_distinct("term_id", "item_id").alias("n_pairs")
    )


@query(
    "best_model",
    with_(
        PAIRS_SQL,
        "m AS (SELECT term_id % 2 AS half, 's1' AS model, s1 AS s, label FROM pairs UNION ALL SELECT term_id % 2, 's2', s2, label FROM pairs UNION ALL SELECT term_id % 2, 's3', s3, label FROM pairs)",
        "grid AS (SELECT g / 200.0::DOUBLE AS t FROM range(10, 190) r(g))",
        "c AS (SELECT half, model, t, count(*) FILTER (label = 1 AND s >= t) AS tp, count(*) FILTER (label = 0 AND s >= t) AS fp, count(*) FILTER (label = 1 AND s < t) AS fn, count(*) FILTER (label = 0 AND s < t) AS tn FROM m, grid GROUP BY ALL)",
        f"f AS (SELECT half, model, t, {_F1} AS f FROM c)",
        "a AS (SELECT model, t FROM f WHERE half = 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f, 12) DESC, t) = 1)",
    )
    + "SELECT f.model, f.t, round(f.f, 9) AS macro_f1 FROM f JOIN a ON a.model = f.model AND a.t = f.t AND f.half = 1 ORDER BY round(f.f, 12) DESC, f.model LIMIT 1",
)
def best_model(spark, sf):
    """Each model's threshold comes from half of the terms; the best model is chosen on the other half."""
    p = pairs(spark, sf).select((F.col("term_id") % 2).alias("half"), "label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("s")) for m in ("s1", "s2", "s3")])).alias("m")).select("half", "label", "m.*")
    s = metrics.sweep(p, F.col("s"), F.col("label"), 10, 189, 200, by=["half", "model"])
    chosen = metrics.best(s.filter("half = 0"), by=["model"]).select("model", "t")
    report = s.filter("half = 1").join(chosen, ["model", "t"]).select("model", "t", "macro_f1")
    return report.orderBy(F.desc(F.round("macro_f1", 12)), "model").limit(1).withColumn("macro_f1", F.round("macro_f1", 9))


_C8_F1 = "(CASE WHEN 2.0 * tp + fp + fn > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0 END + CASE WHEN 2.0 * tn + fn + fp > 0 THEN 2.0 * tn / (2.0 * tn + fn + fp) ELSE 0 END) / 2.0"
_C8_COUNTS = "count(*) FILTER (label = 1 AND s >= t) AS tp, count(*) FILTER (label = 0 AND s >= t) AS fp, count(*) FILTER (label = 1 AND s < t) AS fn, count(*) FILTER (label = 0 AND s < t) AS tn"


# the same over distinct scores with their numbers
_SUMMED = ", ".join("coalesce(" + x.rsplit(" AS ", 1)[0].replace("count(*)", "sum(n)") + ", 0) AS " + x.rsplit(" AS ", 1)[1] for x in _C8_COUNTS.split(", "))


@query(
    "weight_threshold_grid",
    with_(
        PAIRS_SQL,
        "w AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, (10 - a - b) / 10.0::DOUBLE AS c FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10)",
        "sc AS (SELECT a, b, c, label, round(a * s1 + b * s2 + c * s3, 9) AS s, count(*) AS m FROM pairs, w GROUP BY ALL)",
        "g AS (SELECT g / 100.0::DOUBLE AS t FROM range(30, 71) r(g))",
        f"k AS (SELECT a, b, c, t, {_C8_COUNTS.replace('count(*)', 'sum(m)')} FROM sc, g GROUP BY ALL)".replace("sum(m) FILTER", "sum(m) FILTER"),
        f"f AS (SELECT a, b, c, t, {_C8_F1} AS f FROM (SELECT a, b, c, t, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM k))",
        "best AS (SELECT * FROM f ORDER BY round(f, 12) DESC, a, b, t LIMIT 1)",
        f"fine AS (SELECT t, {_C8_COUNTS.replace('count(*)', 'sum(m)')} FROM sc JOIN best USING (a, b, c), (SELECT g / 500.0::DOUBLE AS t FROM range(150, 355) r(g)) h GROUP BY ALL)".replace("s >= t", "s >= h.t").replace("s < t", "s < h.t").replace("SELECT t, ", "SELECT h.t, "),
        f"last AS (SELECT t, {_C8_F1} AS f FROM (SELECT t, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM fine) ORDER BY round(f, 12) DESC, t LIMIT 1)",
    )
    + "SELECT b.a, b.b, b.c, b.t AS t_coarse, round(b.f, 9) AS f_coarse, l.t AS t_fine, round(l.f, 9) AS f_fine FROM best b, last l",
)
def weight_threshold_grid(spark, sf):
    """The first best of 66 weights and 41 thresholds, and its threshold again on the finer grid."""
    p = pairs(spark, sf).select("label", "s1", "s2", "s3")
    return metrics.weighted_threshold(p, ["s1", "s2", "s3"], F.col("label"))


@query(
    "carried_rate",
    with_(
        PAIRS_SQL,
        "h AS (SELECT label, s3 FROM pairs WHERE term_id % 2 = 0)",
        "q AS (SELECT quantile_cont(s3, [" + ", ".join(f"(1.0::DOUBLE - {r / 100}::DOUBLE)" for r in range(20, 46)) + "]) AS q FROM h)".replace("(1.0::DOUBLE - ", "("),
        "t AS (SELECT unnest([" + ", ".join(f"{r / 100}::DOUBLE" for r in range(20, 46)) + "]) AS rate, unnest(q) AS t FROM q)",
        f"k AS (SELECT rate, t, {_C8_COUNTS.replace('s >=', 's3 >=').replace('s <', 's3 <')} FROM h, t GROUP BY ALL)",
        f"b AS (SELECT rate, t, {_C8_F1} AS f FROM k ORDER BY round(f, 12) DESC, rate LIMIT 1)",
        "x AS (SELECT quantile_cont(s3, [" + ", ".join(f"(1.0::DOUBLE - {r / 100}::DOUBLE)" for r in range(20, 46)) + "]) AS q FROM pairs WHERE term_id % 2 = 1)",
        "n AS (SELECT unnest([" + ", ".join(f"{r / 100}::DOUBLE" for r in range(20, 46)) + "]) AS rate, unnest(q) AS new FROM x)",
    )
    + "SELECT b.rate, round(b.t, 9) AS holdout_threshold, round(b.f, 9) AS macro_f1, round(n.new, 9) AS test_threshold FROM b JOIN n ON n.rate = b.rate",
)
def carried_rate(spark, sf):
    """The positive rate of the highest macro-F1 on the holdout (of equal ones the smallest), as a quantile of the test scores."""
    p = pairs(spark, sf).select((F.col("term_id") % 2).alias("half"), "label", "s3")
    r = metrics.carried_rate(p.filter("half = 0"), p.filter("half = 1"), "s3", F.col("label"), [r / 100 for r in range(20, 46)])
    return r.select("rate", *[F.round(c, 9).alias(c) for c in ("holdout_threshold", "macro_f1", "test_threshold")])


@query(
    "best_model_applied",
    with_(
        PAIRS_SQL,
        "m AS (SELECT id, term_id % 3 AS part, 's1' AS model, s1 AS s, label FROM pairs UNION ALL SELECT id, term_id % 3, 's2', s2, label FROM pairs UNION ALL SELECT id, term_id % 3, 's3', s3, label FROM pairs)",
        "g AS (SELECT g / 200.0::DOUBLE AS t FROM range(10, 190) r(g))",
        "d AS (SELECT part, model, s, label, count(*) AS n FROM m WHERE part < 2 GROUP BY ALL)",
        f"f AS (SELECT part, model, t, {_C8_F1} AS f FROM (SELECT part, model, t, {_SUMMED} FROM d, g GROUP BY ALL))",
        "a AS (SELECT model, t FROM f WHERE part = 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f, 12) DESC, t) = 1)",
        "chosen AS (SELECT f.model FROM f JOIN a ON a.model = f.model AND a.t = f.t AND part = 1 ORDER BY round(f.f, 12) DESC, f.model LIMIT 1)",
        f"whole AS (SELECT model, t, {_C8_F1} AS f FROM (SELECT model, t, {_SUMMED} FROM d JOIN chosen USING (model), g GROUP BY ALL) ORDER BY round(f, 12) DESC, t LIMIT 1)",
    )
    + "SELECT m.id, m.model, w.t, CAST(m.s >= w.t AS INTEGER) AS prediction FROM m JOIN whole w USING (model) WHERE part = 2",
)
def best_model_applied(spark, sf):
    """The best single model, its threshold found again on the whole holdout, decides the test rows."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("s")) for m in ("s1", "s2", "s3")])
    long = pairs(spark, sf).select("id", (F.col("term_id") % 3).alias("part"), "label", F.explode(models).alias("m")).select("id", "part", "label", "m.*")
    s = metrics.sweep(long.filter("part < 2"), F.col("s"), F.col("label"), 10, 189, 200, by=["part", "model"])
    first = metrics.best(s.filter("part = 0"), by=["model"]).select("model", "t")
    chosen = s.filter("part = 1").join(first, ["model", "t"]).orderBy(F.desc(F.round("macro_f1", 12)), "model").limit(1).select("model")
    sums = s.groupBy("model", "t").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    again = metrics.best(sums.withColumn("macro_f1", metrics.macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])).join(chosen, "model"), by=["model"])
    # one model, one threshold
    return long.filter("part = 2").join(F.broadcast(again.select("model", "t")), "model").select("id", "model", "t", (F.col("s") >= F.col("t")).cast("int").alias("prediction"))


@query(
    "pseudo_labels",
    with_(
        PAIRS_SQL,
        "n AS (SELECT count(*) - 1 AS n FROM pairs)",
        "r AS (SELECT id, round((((row_number() OVER (ORDER BY s1, id) - 1)::DOUBLE / n) + ((row_number() OVER (ORDER BY s2, id) - 1)::DOUBLE / n) + ((row_number() OVER (ORDER BY s3, id) - 1)::DOUBLE / n)) / 3, 9) AS score FROM pairs, n)",
        "k AS (SELECT r.id, score, row_number() OVER (ORDER BY score, r.id) - 1 AS k FROM r JOIN pairs p ON p.id = r.id WHERE p.term_id % 2 = 1)",
        "m AS (SELECT count(*) AS m FROM k)",
    )
    + "SELECT id, label, 'labelled' AS origin FROM pairs WHERE term_id % 2 = 0 UNION ALL SELECT id, CASE WHEN k >= m - floor(0.12::DOUBLE * m) THEN 1 ELSE 0 END, 'pseudo' FROM k, m WHERE k >= m - floor(0.12::DOUBLE * m) OR k < floor(0.25::DOUBLE * m)",
)
def pseudo_labels(spark, sf):
    """Rows of half of the terms with their labels, and the tails of the rank average of three models among the other rows."""
    from ..operators import learn, windows

    p = pairs(spark, sf)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("s1", "s2", "s3")])
    average = learn.rank_average(p.select("id", F.explode(models).alias("m")).select("id", "m.*"), ["s1", "s2", "s3"]).withColumn("score", F.round("score", 9))
    fresh = windows.tails(average.join(p.filter("term_id % 2 = 1").select("id"), "id"), "score", "id")
    return p.filter("term_id % 2 = 0").select("id", "label", F.lit("labelled").alias("origin")).unionByName(fresh.select("id", "label", F.lit("pseudo").alias("origin")))
