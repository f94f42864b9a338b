"""Replay of flows against a static benign memory, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import memory as K
from . import metrics as M
from . import windows as W


def replay_threshold(memory: DataFrame, val: DataFrame, k: int, mode: str = "p99") -> float:
    """The alert threshold from benign validation flows (id, v): the exact 99th percentile of their scores, or evt_p99, its tail estimate."""
    scores = K.mean_distance(val, memory, k).withColumn("y", F.lit(0))
    if mode == "evt_p99":
        return M.evt_threshold(scores).first()["threshold"]
    if mode != "p99":
        raise ValueError(f"unknown threshold mode {mode}")
    return scores.agg(F.percentile("score", F.lit(0.99))).first()[0]


def replayed(flows: DataFrame, memory: DataFrame, threshold: float, k: int) -> DataFrame:
    """STR10: flows (id, v, y, ts, ...) with score, threshold, hit, false_alert and true_alert; the memory (mid, v) does not change."""
    rows = flows.drop("v").join(K.mean_distance(flows.select("id", "v"), memory, k), "id")
    hit = (F.col("score") >= threshold).cast("int")
    return rows.withColumns({"threshold": F.lit(float(threshold)), "hit": hit, "false_alert": hit * (F.col("y") == 0).cast("int"), "true_alert": hit * (F.col("y") == 1).cast("int")})


def alert_delay(rows: DataFrame) -> DataFrame:
    """STR10: one row: attack_at and alert_at, how many replayed flows (id, ts, y, true_alert) come before the first attack and
    before the first alert on one, and delay_flows and delay_s between these two; null without such a flow.

    Two aggregations over (ts, id); no flow is numbered, so nothing is sorted. Flows without a time come first.
    """
    at = F.struct("ts", "id")
    ends = rows.agg(F.min(F.when(F.col("y") == 1, at)).alias("attack"), F.min(F.when(F.col("true_alert") == 1, at)).alias("alert"))
    before = lambda name: F.when(F.first(name).isNotNull(), F.count_if(at < F.col(name)))
    counts = rows.select("ts", "id").crossJoin(F.broadcast(ends)).agg(before("attack").alias("attack_at"), before("alert").alias("alert_at"), (F.first("alert.ts") - F.first("attack.ts")).alias("delay_s"))
    return counts.select("attack_at", "alert_at", (F.col("alert_at") - F.col("attack_at")).alias("delay_flows"), "delay_s")


def knn_replay(flows: DataFrame, memory: DataFrame, val: DataFrame, k: int, mode: str = "p99", widths: tuple[float, ...] = (3600.0,)) -> tuple[DataFrame, DataFrame]:
    """STR10: the replayed flows, and one row of rates, the first alerts' times, the delay to the first alert on an attack and, for each width, the highest sliding false-positive rate."""
    rows = replayed(flows, memory, replay_threshold(memory, val, k, mode), k)
    y = F.col("y") == 1
    facts = rows.agg(F.max("threshold").alias("threshold"), F.count("*").alias("flows"), F.sum("false_alert").alias("false_alerts"), F.sum("true_alert").alias("true_alerts"), F.sum("hit").alias("alerts"), M.ratio(F.sum("false_alert"), F.count_if(~y)).alias("fpr"), M.ratio(F.sum("true_alert"), F.count_if(y)).alias("recall"))
    facts = facts.withColumn("false_alerts_per_10k", F.col("fpr") * 10_000).crossJoin(W.first_events(rows)).crossJoin(alert_delay(rows))
    sliding = W.max_sliding_fpr(rows, list(widths))
    return rows, facts.crossJoin(sliding.groupBy().pivot("window_s", [float(w) for w in widths]).agg(F.first("max_fpr")).toDF(*[f"max_fpr_{w:g}" for w in widths]))


def knn_replay_stream(stream: DataFrame, memory: DataFrame, threshold: float, k: int, sink: str, checkpoint: str) -> StreamingQuery:
    """STR10 as a stream: each micro-batch of flows is scored against the same memory and appended to Parquet in `sink`. A batch
    that is run again after a failure overwrites its own folder, so no alert is told twice."""
    def score(batch: DataFrame, number: int) -> None:
        replayed(batch, memory, threshold, k).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
