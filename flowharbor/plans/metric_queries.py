"""Queries of detection metrics over the derived score rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.operators import metrics as M

from .binding import SCORES, scores
from .registry import query


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


RATES = """round(fp / greatest(fp + tn, 1), 6) AS fpr, round(tp / greatest(tp + fn, 1), 6) AS recall, round(tp / greatest(tp + fp, 1), 6) AS precision,
 round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1_attack, round(2 * tn / greatest(2 * tn + fp + fn, 1), 6) AS f1_benign,
 round((2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) / 2, 6) AS macro_f1"""
COUNTS = "count(*) FILTER (score >= {t} AND y = 1) AS tp, count(*) FILTER (score >= {t} AND y = 0) AS fp, count(*) FILTER (score < {t} AND y = 0) AS tn, count(*) FILTER (score < {t} AND y = 1) AS fn"
CURVE = f"""{SCORES}, s AS (SELECT score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM scores GROUP BY score), t AS (SELECT sum(p)::BIGINT AS p_, sum(n)::BIGINT AS n_, max(score) AS top FROM s),
 r AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS fp FROM s UNION ALL SELECT top + 1e-12, 0, 0 FROM t),
 c AS (SELECT threshold, tp, fp, n_ - fp AS tn, p_ - tp AS fn FROM r, t)"""


@query(f"WITH {SCORES}, c AS (SELECT service, {COUNTS.format(t=8)} FROM scores GROUP BY service) SELECT *, {RATES} FROM c")
def agg23_binary_metrics(spark, sf):
    return rounded(M.binary_metrics(scores(spark, sf), 8.0, ["service"]))


@query(f"WITH {CURVE} SELECT *, {RATES} FROM c")
def win12_threshold_curve(spark, sf):
    return rounded(M.curve(scores(spark, sf)))


@query(f"WITH {CURVE} SELECT *, {RATES} FROM c ORDER BY (2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) DESC, threshold DESC LIMIT 1")
def win12_best_macro_f1(spark, sf):
    return rounded(M.best_macro_f1(M.curve(scores(spark, sf))))


@query(f"""WITH {CURVE}, k AS (SELECT b::DOUBLE AS max_fpr, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr, threshold, row_number() OVER (PARTITION BY b ORDER BY tp / (tp + fn) DESC, threshold) AS i
 FROM c, (VALUES (0.05), (0.2), (0.5)) v(b) WHERE fp / (fp + tn) <= b) SELECT max_fpr, round(recall, 6) AS recall, round(fpr, 6) AS fpr, threshold FROM k WHERE i = 1""")
def win12_recall_under_fpr(spark, sf):
    return rounded(M.recall_under_fpr(M.curve(scores(spark, sf)), [0.05, 0.2, 0.5]))


@query(f"""WITH {CURVE}, x AS (SELECT *, tp - lag(tp, 1, 0) OVER (ORDER BY threshold DESC) AS p, fp - lag(fp, 1, 0) OVER (ORDER BY threshold DESC) AS n FROM c)
 SELECT round(sum(n * (tp - p / 2)) / (max(tp) * max(fp)), 6) AS auroc, round(sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / max(tp), 6) AS auprc, round(min(CASE WHEN tp >= 0.95 * (tp + fn) THEN fp END) / max(fp), 6) AS fpr95 FROM x""")
def agg25_rank_metrics(spark, sf):
    return rounded(M.rank_metrics(scores(spark, sf)))


@query(f"""WITH {SCORES}, t AS (SELECT p::DOUBLE AS percentile, (SELECT quantile_cont(score, [0.5, 0.9, 0.99]) FROM scores WHERE split = 'val' AND y = 0)[i] AS threshold FROM (VALUES (50, 1), (90, 2), (99, 3)) v(p, i)),
 c AS (SELECT percentile, threshold, {COUNTS.format(t="threshold")} FROM scores, t WHERE split = 'test' GROUP BY percentile, threshold) SELECT *, {RATES} FROM c""")
def cal02_percentile_thresholds(spark, sf):
    s = scores(spark, sf)
    return rounded(M.percentile_thresholds(s.where("split = 'val'"), s.where("split = 'test'"), [50, 90, 99]))


@query(f"""WITH {SCORES}, v AS (SELECT service, quantile_cont(score, 0.99) AS threshold FROM scores WHERE split = 'val' AND y = 0 GROUP BY service),
 c AS (SELECT service, threshold, {COUNTS.format(t="threshold")} FROM scores JOIN v USING (service) WHERE split = 'test' GROUP BY service, threshold) SELECT *, {RATES} FROM c""")
def cal03_stratified_thresholds(spark, sf):
    s = scores(spark, sf)
    return rounded(M.stratified_thresholds(s.where("split = 'val'"), s.where("split = 'test'"), "service"))


@query(f"""WITH {SCORES}, b AS (SELECT score FROM scores WHERE split = 'val' AND y = 0), q AS (SELECT quantile_cont(score, 0.9) AS u, quantile_cont(score, 0.99) AS plain, count(*) AS n FROM b),
 k AS (SELECT count(*) AS k, avg(score - u) AS m, var_samp(score - u) AS v FROM b, q WHERE score > u), z AS (SELECT *, 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (m * m / v + 1) AS sg FROM q, k)
 SELECT u, plain, round(CASE WHEN k >= 10 AND v > 0 THEN u + sg / xi * (pow(0.01 * n / k, -xi) - 1) ELSE plain END, 6) AS threshold, k FROM z""")
def cal04_evt_threshold(spark, sf):
    return rounded(M.evt_threshold(scores(spark, sf).where("split = 'val'")))


@query()
def cal04_evt_likelihood(spark, sf):
    return rounded(M.evt_threshold_likelihood(scores(spark, sf).where("split = 'val'")))


@query(f"""WITH {SCORES}, v AS (SELECT score FROM scores WHERE split = 'val' AND y = 0), p AS (SELECT y, (1 + (SELECT count(*) FROM v WHERE v.score >= d.score)) / ((SELECT count(*) FROM v) + 1) AS p, n FROM (SELECT y, score, count(*) AS n FROM scores WHERE split = 'test' GROUP BY ALL) d)
 SELECT a::DOUBLE AS alpha, coalesce(sum(n) FILTER (y = 1 AND p <= a), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (y = 0 AND p <= a), 0)::BIGINT AS fp FROM p, (VALUES (0.05), (0.2), (0.01)) x(a) GROUP BY a""")
def cal05_conformal(spark, sf):
    s = scores(spark, sf)
    return M.conformal(s.where("split = 'val'"), s.where("split = 'test'"), [0.05, 0.2, 0.01])


@query(f"""WITH {SCORES}, c AS (SELECT service, {COUNTS.format(t=9)} FROM scores GROUP BY service) SELECT service, round(10000 * fp / (fp + tn), 4) AS fa_per_10k, round(10000 * (tp + fp) / (tp + fp + tn + fn), 4) AS alerts_per_10k, round(10000 * tp / (tp + fn), 4) AS detected_per_10k FROM c""")
def agg27_alert_budget(spark, sf):
    return rounded(M.alert_budget(M.binary_metrics(scores(spark, sf), 9.0, ["service"])).select("service", "fa_per_10k", "alerts_per_10k", "detected_per_10k"), 4)


@query(f"""WITH {SCORES}, c AS (SELECT {COUNTS.format(t=9)} FROM scores), r AS (SELECT tp / (tp + fn) AS rec, fp / (fp + tn) AS fpr FROM c), z AS (SELECT q::DOUBLE AS prevalence, 10000 * q * rec AS a, 10000 * (1 - q) * fpr AS b FROM r, (VALUES (0.001), (0.01), (0.05)) v(q))
 SELECT prevalence, round(a, 4) AS true_alerts, round(b, 4) AS false_alerts, round(a / (a + b), 4) AS alert_precision FROM z""")
def agg28_prevalence_budget(spark, sf):
    return rounded(M.prevalence_budget(M.binary_metrics(scores(spark, sf), 9.0), [0.001, 0.01, 0.05]), 4)


@query(f"WITH {SCORES} SELECT service, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.01), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.99), 6) AS q99 FROM scores GROUP BY service")
def agg31_score_distribution(spark, sf):
    return rounded(M.score_distribution(scores(spark, sf), "service", [0.01, 0.5, 0.99]))


@query("WITH s AS (SELECT l_suppkey AS service, l_returnflag = 'R' AS a, l_quantity AS score FROM lineitem) SELECT service, count(*) AS benign, count(*) FILTER (score >= 30) AS fp, round(count(*) FILTER (score >= 30) / count(*), 6) AS fpr FROM s WHERE NOT a GROUP BY service ORDER BY fp DESC, service LIMIT 10")
def agg30_per_service_fpr(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("service"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("score"))
    return rounded(M.per_service_fpr(li, 30.0))


@query(f"WITH {SCORES} SELECT service, count(*) AS total, count(*) FILTER (score >= 9) AS alerts, round(avg(CAST(score >= 9 AS DOUBLE)), 6) AS rate, min(score) AS least, round(avg(score), 6) AS mean, max(score) AS most FROM scores GROUP BY service")
def agg45_attack_breakdown(spark, sf):
    return rounded(M.attack_breakdown(scores(spark, sf), "service", 9.0))


@query("SELECT l_returnflag AS family, l_linestatus AS view, count(*) AS runs, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std, min(l_discount) AS least, max(l_discount) AS most FROM lineitem GROUP BY ALL")
def agg26_summarize_runs(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("view"), "l_discount")
    return rounded(M.summarize_runs(li, ["family", "view"], "l_discount", True))


@query("SELECT coalesce(l_returnflag, 'Aggregate') AS attack, l_linestatus AS view, count(*) AS runs, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))")
def agg49_run_summary(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("v"), "l_discount")
    return rounded(M.run_summary(li, "a", "v", "l_discount"))


@query(f"""WITH {SCORES}, s AS (SELECT CAST(floor(score / 20 * 1000 + 1e-9) AS INT) AS b, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM scores GROUP BY b), c AS (SELECT i / 1000 AS threshold, coalesce(sum(p) FILTER (b >= i), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (b >= i), 0)::BIGINT AS fp,
 coalesce(sum(n) FILTER (b < i), 0)::BIGINT AS tn, coalesce(sum(p) FILTER (b < i), 0)::BIGINT AS fn FROM s, range(1, 1000) r(i) GROUP BY i)
 SELECT *, round((2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) / 2, 6) AS macro_f1 FROM c""")
def win13_grid_threshold(spark, sf):
    s = scores(spark, sf).withColumn("score", F.col("score") / 20)
    return M.grid_threshold(s).withColumn("macro_f1", F.round("macro_f1", 6))


@query("WITH b AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, round((1 - 0.999) / (1 - pow(0.999, n)), 6) AS effective, round(n / sum(n) OVER (), 6) AS prior FROM b")
def agg41_class_weights(spark, sf):
    return rounded(M.class_weights(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("label"))))


@query("""WITH p AS (SELECT l_returnflag AS t, CASE WHEN l_linenumber % 3 = 0 THEN 'A' WHEN l_linenumber % 3 = 1 THEN 'N' ELSE 'R' END AS p FROM lineitem), l AS (SELECT DISTINCT t AS label FROM p UNION SELECT DISTINCT p FROM p),
 c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM p WHERE t = label) AS support, (SELECT count(*) FROM p WHERE p.p = label) AS predicted FROM l)
 SELECT *, round(tp / greatest(predicted, 1), 6) AS precision, round(tp / greatest(support, 1), 6) AS recall, round(2 * tp / greatest(predicted + support, 1), 6) AS f1 FROM c""")
def agg24_class_report(spark, sf):
    m = F.col("l_linenumber") % 3
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("true"), F.when(m == 0, "A").when(m == 1, "N").otherwise("R").alias("pred"))
    return rounded(M.class_report(li))
