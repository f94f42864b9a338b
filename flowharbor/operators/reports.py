"""Attachments by flow id, audits, breakdowns and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align_streaming(labels: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOI03: label rows whose key some flow has (semi-join), and the counts scanned and kept."""
    kept = labels.join(flows.select("key").distinct(), "key", "left_semi")
    counts = labels.agg(F.count("*").alias("scanned")).crossJoin(kept.agg(F.count("*").alias("retained")))
    return kept, counts.withColumn("dropped", F.col("scanned") - F.col("retained"))


def attach_split(flows: DataFrame, splits: DataFrame) -> DataFrame:
    """JOI10: flows with their split; those without go."""
    return flows.join(splits.select("flow_id", "split"), "flow_id")


def fill_metadata(rows: DataFrame, meta: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """JOI12: null columns filled from metadata by flow id, and how many rows matched."""
    m = meta.select("flow_id", *[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(1).alias("_hit"))
    joined = rows.join(m, "flow_id", "left")
    stats = joined.agg(F.count("*").alias("rows"), F.count("_hit").alias("matched"))
    filled = joined.select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])
    return filled, stats


def error_analysis(preds: DataFrame, field: str, value: str) -> DataFrame:
    """AGG32: wrong predictions by (true, pred, field): count and interpolated quartiles of a numeric column."""
    wrong = preds.where(F.col("true") != F.col("pred")).groupBy("true", "pred", field)
    q = wrong.agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("true", "pred", field, "n", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


def label_window_audit(flows: DataFrame, top: int) -> DataFrame:
    """AGG34: of flows (family, period, shape), flows, distinct shapes and the `top` shapes with their share."""
    by = flows.groupBy("family", "period", "shape").agg(F.count("*").alias("n"))
    w = Window.partitionBy("family", "period")
    ranked = by.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "shape")), "flows": F.sum("n").over(w), "shapes": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= top).select("family", "period", "flows", "shapes", "rank", "shape", "n", (F.col("n") / F.col("flows")).alias("share"))


def endpoint_features(train: DataFrame, flows: DataFrame) -> DataFrame:
    """AGG36: of flows (flow_id, src, dst, service), train degrees of both ends and the pair, distinct partners, -log prior of
    the service, and whether an end or pair is new. Three aggregations, each joined on its key."""
    s = train.groupBy("src").agg(F.count("*").alias("src_degree"), F.count_distinct("dst").alias("src_partners"))
    d = train.groupBy("dst").agg(F.count("*").alias("dst_degree"), F.count_distinct("src").alias("dst_partners"))
    p = train.groupBy("src", "dst").agg(F.count("*").alias("pair_degree"))
    n = train.agg(F.count("*").alias("total"), F.count_distinct("service").alias("kinds"))
    v = train.groupBy("service").agg(F.count("*").alias("service_n"))
    rows = flows.join(s, "src", "left").join(d, "dst", "left").join(p, ["src", "dst"], "left").join(v, "service", "left").crossJoin(F.broadcast(n))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("src_degree", "src_partners", "dst_degree", "dst_partners", "pair_degree")]
    prior = -F.log((F.coalesce("service_n", F.lit(0)) + 1) / (F.col("total") + F.col("kinds")))
    return rows.select("flow_id", *counts, prior.alias("service_surprise"), F.col("src_degree").isNull().cast("int").alias("new_src"), F.col("pair_degree").isNull().cast("int").alias("new_pair"))


def select_cases(scores: DataFrame, threshold: float) -> DataFrame:
    """AGG44: the highest true alert, the one nearest the threshold, the highest false alert, the lowest benign score."""
    hit = F.col("score") >= threshold
    kinds = {"top_tp": (hit & (F.col("y") == 1), -F.col("score")), "border_tp": (hit & (F.col("y") == 1), F.col("score")), "worst_fp": (hit & (F.col("y") == 0), -F.col("score")), "safest_tn": (~hit & (F.col("y") == 0), F.col("score"))}
    made = scores.agg(*[F.min(F.when(c, F.struct(o.alias("o"), "flow_id", "score"))).alias(k) for k, (c, o) in kinds.items()])
    rows = made.select(F.explode(F.array(*[F.struct(F.lit(k).alias("case"), F.col(f"{k}.flow_id").alias("flow_id"), F.col(f"{k}.score").alias("score")) for k in kinds])).alias("r"))
    return rows.select("r.*").where("flow_id IS NOT NULL")


def audit_label_sources(flows: DataFrame, labels: DataFrame, tolerance: float) -> DataFrame:
    """AGG46: for each source file of labels, flows that it matches in time and key, best rate first."""
    near = flows.join(labels, "key").where((F.col("ts") >= F.col("start_ts") - tolerance) & (F.col("ts") <= F.col("end_ts") + tolerance))
    hits = near.groupBy("source_file").agg(F.count_distinct("flow_id").alias("matched"))
    total = flows.agg(F.count("*").alias("flows"))
    every = labels.select("source_file").distinct().join(hits, "source_file", "left").crossJoin(F.broadcast(total))
    return every.select("source_file", F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) / F.col("flows")).alias("match_rate")).orderBy(F.desc("match_rate"), "source_file")


def extraction_summary(labelled: DataFrame) -> DataFrame:
    """AGG47: by day and in all (day null): flows, matched and the rate."""
    return labelled.rollup("day").agg(F.count("*").alias("flows"), F.count("label").alias("matched"), (F.count("label") / F.count("*")).alias("match_rate"))


def with_without(rows: DataFrame, metric: str, family: str, excluded: str) -> DataFrame:
    """AGG29: the metric's mean over all rows and over those of other families."""
    kept = F.col(family) != excluded
    both = rows.agg(F.avg(metric).alias("a"), F.count("*").alias("na"), F.avg(F.when(kept, F.col(metric))).alias("b"), F.count_if(kept).alias("nb"))
    return both.select(F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.col("na").alias("runs"), F.col("a").alias("mean")), F.struct(F.lit("without").alias("scope"), F.col("nb").alias("runs"), F.col("b").alias("mean")))).alias("r")).select("r.*")


def select_packets(rows: DataFrame, most: int = 96) -> DataFrame:
    """TOP10: of a flow's packets the first half of `most`, the last quarter, then tagged ones in order until it is full."""
    w = Window.partitionBy("flow")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("ts", "seq")), "j": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("seq")))})
    kind = F.when(F.col("i") <= most // 2, 0).when(F.col("j") <= most // 4, 1).when(F.col("tagged") == 1, 2).otherwise(3)
    return rows.withColumn("kind", kind).where("kind < 3").withColumn("nth", F.row_number().over(w.orderBy("kind", "i"))).where(F.col("nth") <= most)


def primitive_scale(triggers: DataFrame, flows: DataFrame) -> DataFrame:
    """AGG21: of triggers (flow_id, family) and flows (flow_id, label), share of flows that fire a family, by label and in
    all (label null), with the mean count in those that fire."""
    n = flows.groupingSets([[F.col("label")], []], F.col("label")).agg(F.count("*").alias("flows"), F.grouping("label").alias("g"))
    by = triggers.groupBy("flow_id", "family").agg(F.count("*").alias("n")).join(flows, "flow_id")
    t = by.groupingSets([[F.col("family"), F.col("label")], [F.col("family")]], F.col("family"), F.col("label")).agg(F.count("*").alias("fired"), F.avg("n").alias("mean_count"), F.grouping("label").alias("g"))
    joined = t.alias("t").join(F.broadcast(n).alias("n"), F.expr("t.g = n.g AND t.label <=> n.label"))
    return joined.select("t.family", "t.label", "t.fired", "t.mean_count", (F.col("t.fired") / F.col("n.flows")).alias("rate"))


def explanation_coverage(alerts: DataFrame, tokens: DataFrame) -> DataFrame:
    """AGG22: of alerts (flow_id), how many have a token at all, and by token family the alerts that it explains."""
    n = alerts.agg(F.count_distinct("flow_id").alias("alerts"))
    by = tokens.join(alerts.select("flow_id").distinct(), "flow_id", "left_semi").select("flow_id", "family").distinct().groupBy("family").agg(F.count("*").alias("explained"))
    return by.crossJoin(F.broadcast(n)).withColumn("coverage", F.col("explained") / F.col("alerts"))


def diversity_windows(flows: DataFrame, size: int) -> DataFrame:
    """AGG37: blocks of `size` flows of a (port, src) in order: flows, distinct destinations over flows and their entropy."""
    w = Window.partitionBy("port", "src").orderBy("ts", "flow_id")
    rows = flows.withColumn("block", F.floor((F.row_number().over(w) - 1) / size))
    by = rows.groupBy("port", "src", "block", "dst").agg(F.count("*").alias("c"))
    tot = by.groupBy("port", "src", "block").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("clog"))
    return tot.select("port", "src", "block", "n", (F.col("kinds") / F.col("n")).alias("distinct_ratio"), (F.log("n") - F.col("clog") / F.col("n")).alias("entropy"))


def standardize(train: DataFrame, rows: DataFrame, columns: list[str], clip: float = 8.0) -> DataFrame:
    """SCA46: columns less the train mean over its deviation (1 where that is under 1e-6), clipped."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    def z(c: str):
        raw = (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}"))
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), raw)).alias(c)

    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in rows.columns if c not in columns], *[z(c) for c in columns])


def spectrum(rows: DataFrame, length: int = 64, bins: int = 24) -> DataFrame:
    """SCA45: magnitudes of the first `bins` Fourier terms of a flow's first `length` packet lengths; the transform is a
    join with a fixed cosine and sine table, summed by (flow, bin)."""
    order = Window.partitionBy("flow").orderBy("ts", "seq")
    head = rows.withColumn("t", F.row_number().over(order) - 1).where(F.col("t") < length)
    spark = rows.sparkSession
    table = spark.range(length).select(F.col("id").cast("int").alias("t")).crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    angle = 2 * 3.141592653589793 * F.col("t") * F.col("bin") / length
    table = table.select("t", "bin", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    by = head.join(F.broadcast(table), "t").groupBy("flow", "bin").agg(F.sum(F.col("len") * F.col("c")).alias("re"), F.sum(F.col("len") * F.col("s")).alias("im"))
    return by.select("flow", "bin", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def k_center(memory: DataFrame, count: int) -> DataFrame:
    """TOP12: greedy farthest-point choice of `count` rows of (mid, v): the first is the smallest id; each round adds the row farthest from
    those chosen (ties to the smaller id). `count` is a small number of rounds, each one aggregation over the memory."""
    from .memory import dot

    rows = memory.select("mid", F.transform("v", lambda x: x.cast("double")).alias("v"))
    chosen: list[tuple] = []
    first = rows.orderBy("mid").limit(1).collect()
    while first and len(chosen) < count:
        pick = first[0]
        if any(pick.mid == c[0] for c in chosen):
            break
        chosen.append((pick.mid, list(pick.v)))
        centers = [F.array(*[F.lit(x) for x in v]) for _, v in chosen]
        away = F.least(*[dot(F.zip_with("v", c, lambda a, b: a - b), F.zip_with("v", c, lambda a, b: a - b)) for c in centers], F.lit(float("inf")))
        first = [r.m for r in rows.agg(F.max(F.struct(F.round(away, 9).alias("d"), (-F.col("mid")).alias("neg"), "mid", "v")).alias("m")).collect()]
    return memory.sparkSession.createDataFrame([(i + 1, m) for i, (m, _) in enumerate(chosen)], "rank int, mid long")


def calibration_stability(val: DataFrame, test: DataFrame, sizes: list[int], repeats: int, seed: int = 42) -> DataFrame:
    """CAL06: 99th-percentile thresholds from hash-drawn samples of benign validation scores: spread of the threshold and of
    the realised false alert rate by sample size."""
    benign = val.where("y = 0")
    draws = benign.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("rep"), F.col("flow_id")))
    ranked = draws.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(key, "flow_id", "score"))).where(F.col("r") <= max(sizes))
    at = ranked.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("r"))))
    cut = at.groupBy("size", "rep").agg(F.percentile("score", F.lit(0.99)).alias("threshold"))
    neg = test.where("y = 0").groupBy("score").agg(F.count("*").alias("c"))
    real = cut.crossJoin(neg).groupBy("size", "rep", "threshold").agg((F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("c")).otherwise(0)) / F.sum("c")).alias("fpr"))
    return real.groupBy("size").agg(F.avg("threshold").alias("mean_threshold"), F.stddev_pop("threshold").alias("std_threshold"), F.avg("fpr").alias("mean_fpr"), F.max("fpr").alias("max_fpr"))
