"""Detection metrics, threshold curves, calibration and alert budgets over scored rows (flow_id, y, score, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, running, staged


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    pos, neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {"fpr": ratio(fp, fp + tn), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "f1_attack": pos, "f1_benign": neg, "macro_f1": (pos + neg) / 2}


def binary_metrics(scores: DataFrame, threshold: float | Column, by: list[str] | None = None) -> DataFrame:
    """AGG23: confusion counts and rates of `score >= threshold`, by group if asked."""
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    counts = scores.groupBy(*(by or [])).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def confusion(preds: DataFrame) -> DataFrame:
    """AGG24: counts of (true, pred)."""
    return preds.groupBy("true", "pred").agg(F.count("*").alias("n"))


def class_report(preds: DataFrame) -> DataFrame:
    """AGG24: precision, recall, F1 and support of each class; from the confusion counts, not the rows."""
    c = confusion(preds)
    each = c.select(F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("tp")))).alias("e"))
    by = each.groupBy("e.label").agg(F.sum("e.tp").alias("tp"), F.sum("e.sup").alias("support"), F.sum("e.said").alias("predicted"))
    return by.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))})


def curve(scores: DataFrame) -> DataFrame:
    """WIN12: for each distinct score as a threshold the counts of what is at or above it, and the point above all.

    Rows are first added up by score; the running sums go over range partitions of the distinct scores.
    """
    by = scores.groupBy("score").agg(F.sum((F.col("y") == 1).cast("bigint")).alias("p"), F.sum((F.col("y") == 0).cast("bigint")).alias("n"))
    totals = by.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.max("score").alias("top"))
    run = running(by, [], [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}).select(F.col("score").alias("threshold"), "tp", "fp")
    zero = F.lit(0).cast("bigint")
    points = run.unionByName(totals.select((F.col("top") + 1e-12).alias("threshold"), zero.alias("tp"), zero.alias("fp")))
    full = points.crossJoin(F.broadcast(totals.select("P", "N"))).select("threshold", "tp", "fp", (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn"))
    return full.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def best_macro_f1(points: DataFrame) -> DataFrame:
    """WIN12: the point of highest macro F1; ties to the higher threshold."""
    return points.orderBy(F.desc("macro_f1"), F.desc("threshold")).limit(1)


def recall_under_fpr(points: DataFrame, budgets: list[float]) -> DataFrame:
    """WIN12: for each budget the highest recall with fpr within it; ties to the lowest threshold."""
    b = F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("max_fpr")
    ok = points.select("*", b).where(F.col("fpr") <= F.col("max_fpr"))
    return ok.groupBy("max_fpr").agg(F.max(F.struct(F.col("recall"), (-F.col("threshold")).alias("low"), "fpr")).alias("m")).select("max_fpr", "m.recall", "m.fpr", (-F.col("m.low")).alias("threshold"))


def rank_metrics(scores: DataFrame) -> DataFrame:
    """AGG25: AUROC (ties count half), average precision, least FPR with recall at 95 % or more; null for one class."""
    by = scores.groupBy("score").agg(F.sum((F.col("y") == 1).cast("double")).alias("p"), F.sum((F.col("y") == 0).cast("double")).alias("n"))
    run = running(by, [], [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})
    tot = by.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    full = run.crossJoin(F.broadcast(tot))
    out = full.agg(
        F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2)), F.max("pos") * F.max("neg")).alias("auroc"),
        F.try_divide(F.sum(F.try_divide(F.col("p") * F.col("tp"), F.col("tp") + F.col("fp"))), F.max("pos")).alias("auprc"),
        F.try_divide(F.min(F.when(F.col("tp") >= 0.95 * F.col("pos"), F.col("fp"))), F.max("neg")).alias("fpr95"), F.max("pos").alias("pos"), F.max("neg").alias("neg"),
    )
    two = (F.col("pos") > 0) & (F.col("neg") > 0)
    return out.select(*[F.when(two, F.col(c)).alias(c) for c in ("auroc", "auprc", "fpr95")])


def percentile_thresholds(val: DataFrame, test: DataFrame, percents: list[float]) -> DataFrame:
    """CAL02: thresholds at exact percentiles of benign validation scores, with the test's realised rates."""
    at = F.array(*[F.lit(p / 100) for p in percents])
    cut = val.where("y = 0").agg(F.percentile("score", at).alias("t")).select(F.posexplode("t").alias("i", "threshold"))
    cut = cut.withColumn("percentile", F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("i") + 1))
    rows = test.crossJoin(F.broadcast(cut))
    return binary_metrics(rows, F.col("threshold"), ["percentile", "threshold"])


def stratified_thresholds(val: DataFrame, test: DataFrame, stratum: str, min_rows: int = 25, conservative: bool = False) -> DataFrame:
    """CAL03: 99th percentile of each stratum's benign validation scores; the global one below min_rows, or, if
    conservative, the larger of both. Returns the test's rates by stratum."""
    benign = val.where("y = 0")
    whole = benign.agg(F.percentile("score", F.lit(0.99)).alias("g"))
    own = benign.groupBy(stratum).agg(F.percentile("score", F.lit(0.99)).alias("t"), F.count("*").alias("n"))
    pick = F.when(F.col("n") >= min_rows, F.greatest("t", "g") if conservative else F.col("t")).otherwise(F.col("g"))
    rows = test.join(own, stratum, "left").crossJoin(F.broadcast(whole)).withColumn("threshold", F.coalesce(pick, F.col("g")))
    return binary_metrics(rows, F.col("threshold"), [stratum, "threshold"])


def evt_threshold(val: DataFrame, u: float = 0.9, p: float = 0.99) -> DataFrame:
    """CAL04: the p-quantile from a generalised Pareto tail above the u-quantile, fitted by moments (not by likelihood);
    the plain quantile where the tail has under 10 rows or no spread."""
    benign = val.where("y = 0")
    base = benign.agg(F.percentile("score", F.lit(u)).alias("u"), F.percentile("score", F.lit(p)).alias("plain"), F.count("*").alias("n"))
    tail = benign.crossJoin(F.broadcast(base)).where("score > u").agg(F.count("*").alias("k"), F.avg(F.col("score") - F.col("u")).alias("m"), F.var_samp(F.col("score") - F.col("u")).alias("v"))
    both = base.crossJoin(tail)
    square = F.try_divide(F.col("m") * F.col("m"), F.col("v"))
    shape, scale = 0.5 * (1 - square), 0.5 * F.col("m") * (square + 1)
    left = F.try_divide((1 - p) * F.col("n"), F.col("k"))
    evt = F.col("u") + F.when(F.abs(shape) < 1e-9, -scale * F.log(left)).otherwise(scale / shape * (F.pow(left, -shape) - 1))
    return both.select("u", "plain", F.when((F.col("k") >= 10) & (F.col("v") > 0), evt).otherwise(F.col("plain")).alias("threshold"), "k")


def _profile(theta: float, mean_log: float, mean: float) -> float:
    """Log-likelihood a row of a generalised Pareto tail at shape / scale = theta, the shape being the mean of log(1 + theta * excess)."""
    if theta == 0:
        return -math.log(mean) - 1
    return -math.log(mean_log / theta) - mean_log - 1 if mean_log >= -1 else -math.inf


def evt_threshold_likelihood(val: DataFrame, u: float = 0.9, p: float = 0.99, grid: int = 64, rounds: int = 9) -> DataFrame:
    """CAL04: as evt_threshold, the tail fitted by maximum likelihood with a shape of at least -1 (below that it has no maximum).

    The shape follows from theta = shape / scale, so the likelihood is searched along theta alone: each round is one aggregation of the
    tail's distinct excesses, a sum for each of `grid` values, and the next round looks between the best one's neighbours. The first grid runs from the
    least value that the largest excess allows to the bound 2 * (mean - least) / least^2 above which no maximum lies. With under 10 rows or no
    spread it falls back to evt_threshold.
    """
    moments = evt_threshold(val, u, p)
    start = moments.first()
    benign = val.where("y = 0")
    cut = F.lit(start["u"])
    tail = staged(benign.where(F.col("score") > cut).groupBy((F.col("score") - cut).alias("e")).agg(F.count("*").alias("c")), "tail")
    k, mean, least, most = tail.agg(F.sum("c"), F.sum(F.col("e") * F.col("c")) / F.sum("c"), F.min("e"), F.max("e")).first()
    if (k or 0) < 10 or least == most:
        return moments.withColumns({"shape": F.lit(None).cast("double"), "scale": F.lit(None).cast("double")})
    low, high = -1 / most, max(2 * (mean - least) / least**2, 1 / mean)
    ratio_ = (high * mean / 1e-6) ** (1 / (grid // 2 - 1))
    points = [low * (1 - 2.0 ** -(i / 2)) for i in range(grid // 2, 0, -1)] + [0.0] + [1e-6 / mean * ratio_**i for i in range(grid // 2)]
    best = (-math.inf, 0.0, mean)
    for _ in range(rounds):
        sums = tail.agg(*[(F.sum(F.log1p(F.col("e") * t) * F.col("c")) / k).alias(f"s{i}") for i, t in enumerate(points)]).first()
        scored = [(_profile(t, m, mean), t, m) for t, m in zip(points, sums, strict=True)]
        at = max(range(len(scored)), key=lambda i: scored[i][0])
        best = max(best, scored[at])
        a, b = points[max(0, at - 1)], points[min(len(points) - 1, at + 1)]
        points = [a + (b - a) * i / (grid - 1) for i in range(grid)]
    discard(tail)
    _, theta, shape = best
    # so near to 0 the quotient of two rounded numbers says nothing: the tail is exponential
    flat = abs(theta) * mean < 1e-9
    shape, scale = (0.0, mean) if flat else (shape, shape / theta)
    left = (1 - p) * benign.count() / k
    got = start["u"] + (-scale * math.log(left) if flat else scale / shape * (left**-shape - 1))
    return moments.select("u", "plain", F.lit(float(got)).alias("threshold"), "k", F.lit(float(shape)).alias("shape"), F.lit(float(scale)).alias("scale"))


def conformal(val: DataFrame, test: DataFrame, alphas: list[float]) -> DataFrame:
    """CAL05: test rows flagged at (1 + benign validation scores at or above) / (n + 1) <= alpha, by class; running counts, no pairs."""
    v = val.where("y = 0").groupBy("score").agg(F.count("*").alias("c"))
    both = v.select("score", "c", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")).unionByName(
        test.groupBy("score").agg(F.sum((F.col("y") == 1).cast("bigint")).alias("pos"), F.sum((F.col("y") == 0).cast("bigint")).alias("neg")).withColumn("c", F.lit(0).cast("bigint")))
    by = both.groupBy("score").agg(F.sum("c").alias("c"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    by = running(by, [], [F.desc("score")], {"above": F.col("c")})
    n = v.agg(F.sum("c").alias("n"))
    p = by.crossJoin(F.broadcast(n)).withColumn("p", (1 + F.col("above")) / (F.col("n") + 1)).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    hit = F.col("p") <= F.col("alpha")
    return p.groupBy("alpha").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"))


def alert_budget(metrics: DataFrame) -> DataFrame:
    """AGG27: false alerts in 10k benign, alerts in 10k flows, detections in 10k attacks."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return metrics.select("*", (10000 * ratio(fp, fp + tn)).alias("fa_per_10k"), (10000 * ratio(tp + fp, tp + fp + tn + fn)).alias("alerts_per_10k"), (10000 * ratio(tp, tp + fn)).alias("detected_per_10k"))


def prevalence_budget(metrics: DataFrame, prevalences: list[float]) -> DataFrame:
    """AGG28: alerts in 10k flows and precision if attacks were so frequent."""
    at = metrics.select("*", F.explode(F.array(*[F.lit(p) for p in prevalences])).alias("prevalence"))
    true, false = 10000 * F.col("prevalence") * F.col("recall"), 10000 * (1 - F.col("prevalence")) * F.col("fpr")
    return at.select("prevalence", true.alias("true_alerts"), false.alias("false_alerts"), ratio(true, true + false).alias("alert_precision"))


def score_distribution(scores: DataFrame, by: str, quantiles: list[float]) -> DataFrame:
    """AGG31: count, mean, std and quantiles by group."""
    q = scores.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.percentile("score", F.array(*[F.lit(x) for x in quantiles])).alias("q"))
    return q.select(by, "n", "mean", "std", *[F.col("q")[i].alias(f"q{round(x * 100)}") for i, x in enumerate(quantiles)])


def per_service_fpr(scores: DataFrame, threshold: float, top: int = 10) -> DataFrame:
    """AGG30: the services of most false alerts."""
    by = scores.where("y = 0").groupBy("service").agg(F.count("*").alias("benign"), F.count_if(F.col("score") >= threshold).alias("fp"))
    return by.withColumn("fpr", F.col("fp") / F.col("benign")).orderBy(F.desc("fp"), "service").limit(top)


def attack_breakdown(scores: DataFrame, by: str, threshold: float) -> DataFrame:
    """AGG45: by label: rows, alerts, their share, least, mean and highest score."""
    return scores.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("score") >= threshold).alias("alerts"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"), F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("most"))


def summarize_runs(rows: DataFrame, keys: list[str], metric: str, sample: bool = False) -> DataFrame:
    """AGG26: mean and population or sample deviation (0 for one run) by keys."""
    sd = F.coalesce(F.nullif(F.stddev_samp(metric), F.lit(float("nan"))), F.lit(0.0)) if sample else F.stddev_pop(metric)
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), sd.alias("std"), F.min(metric).alias("least"), F.max(metric).alias("most"))


def run_summary(rows: DataFrame, attack: str, view: str, metric: str) -> DataFrame:
    """AGG49: the metric's summary by (attack, view), and by view as attack Aggregate, in one grouping-sets pass."""
    agg = rows.groupingSets([[F.col(attack), F.col(view)], [F.col(view)]], F.col(attack), F.col(view)).agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), F.grouping(attack).alias("g"))
    return agg.select(F.when(F.col("g") == 1, "Aggregate").otherwise(F.col(attack)).alias("attack"), F.col(view).alias("view"), "runs", "mean")


def grid_threshold(scores: DataFrame, steps: int = 999) -> DataFrame:
    """WIN13: macro F1 at thresholds i/1000 over scores in 0..1, from counts by bucket; best, ties to the lowest."""
    b = scores.groupBy(F.floor(F.col("score") * 1000 + 1e-9).cast("int").alias("b")).agg(F.sum((F.col("y") == 1).cast("bigint")).alias("p"), F.sum((F.col("y") == 0).cast("bigint")).alias("n"))
    grid = scores.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("i"))
    hit = F.col("b") >= F.col("i")
    at = grid.crossJoin(F.broadcast(b)).groupBy("i").agg(*[F.sum(F.when(h, F.col(c)).otherwise(0)).alias(o) for h, c, o in ((hit, "p", "tp"), (hit, "n", "fp"), (~hit, "n", "tn"), (~hit, "p", "fn"))])
    full = at.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))
    return full.select((F.col("i") / 1000).alias("threshold"), "tp", "fp", "tn", "fn", "macro_f1")


def maximin_threshold(panels: DataFrame) -> DataFrame:
    """WIN13: of grid rows (panel, threshold, macro_f1), the threshold whose worst panel is best; ties to the lowest."""
    return panels.groupBy("threshold").agg(F.min("macro_f1").alias("worst")).orderBy(F.desc("worst"), "threshold").limit(1)


def class_weights(labels: DataFrame, beta: float = 0.999) -> DataFrame:
    """AGG41: inverse-frequency and effective-number weights and priors by label."""
    by = labels.groupBy("label").agg(F.count("*").alias("n"))
    tot = by.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    at = by.crossJoin(F.broadcast(tot))
    return at.select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"), ((1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))).alias("effective"), (F.col("n") / F.col("total")).alias("prior"))
