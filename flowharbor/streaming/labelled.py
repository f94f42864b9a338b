"""Streams of closed flows labelled by schedule or indicator list, with caps by label that hold over restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowharbor.operators.labels import label_by_ip, label_by_schedule
from flowharbor.operators.staging import running


def capped(labelled: DataFrame, cap: int | None, order: list[str], before: DataFrame | None = None) -> DataFrame:
    """STR04: labelled flows (label, ...) of which each label keeps the first `cap` along `order`, less what `before` (label, kept) holds already.

    Ranks are running counts over range partitions of (label, order), so a label of most rows spreads over tasks. Without a
    cap all stay; a null label is a label. `before` has one row a label.
    """
    if cap is None:
        return labelled
    open_ = labelled.withColumn("_kept", F.lit(0).cast("bigint"))
    if before is not None:
        held = before.select(F.col("label").alias("_label"), F.col("kept").alias("_had"))
        open_ = labelled.join(held, F.col("label").eqNullSafe(F.col("_label")), "left").withColumn("_kept", F.coalesce("_had", F.lit(0))).drop("_label", "_had")
    ranked = running(open_.where(F.col("_kept") < cap), ["label"], order, {"_i": F.lit(1)})
    return ranked.where(F.col("_i") + F.col("_kept") <= cap).drop("_i", "_kept")


def schedule_labels(windows: DataFrame, tolerance: float = 0.0, ambiguous: str = "quarantine") -> Callable[[DataFrame], DataFrame]:
    """STR03: flows (flow_id, src, dst, start_ts, end_ts) labelled by a schedule as JOI05 does."""

    def label(flows: DataFrame) -> DataFrame:
        found = label_by_schedule(flows, windows, tolerance, ambiguous).withColumnRenamed("family", "label")
        return flows.join(found, "flow_id")

    return label


def indicator_labels(ips: DataFrame, attack: str = "Botnet") -> Callable[[DataFrame], DataFrame]:
    """STR04: flows (flow_id, src, dst, ...) labelled by a list of addresses as JOI06 does, with the ends that matched."""

    def label(flows: DataFrame) -> DataFrame:
        return flows.join(label_by_ip(flows, ips, attack), "flow_id")

    return label


def _counters(spark, path: str, batch: int) -> DataFrame | None:
    """(label, candidates, kept) after the last batch before this one; None at the first."""
    try:
        rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") < batch)
    except AnalysisException:
        return None
    last = rows.agg(F.max("batch")).first()[0]
    return None if last is None else rows.where(F.col("batch") == last).drop("batch")


def label_to(flows: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, cap: int | None = None, order: tuple[str, ...] = ("start_ts", "flow_id"), trigger: dict | None = None) -> StreamingQuery:
    """STR03/STR04: a stream of closed flows, each with its own flow_id, labelled batch by batch into `path`/flows, at most `cap` flows of each label.

    A batch writes its flows and the counters up to it (`path`/counts: label, candidates, kept) to folders named by its
    number and starts from the counters of the batch before, so a batch that runs again after a failure replaces what it wrote:
    each flow counts exactly once. Batches come in order of arrival, and inside one `order` decides; one row a label is kept
    between batches. `label` is schedule_labels or indicator_labels.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _counters(spark, f"{path}/counts", number)
        rows = label(batch)
        capped(rows, cap, list(order), before).write.mode("overwrite").parquet(f"{path}/flows/batch={number}")
        zero = F.lit(0).cast("bigint")
        kept = spark.read.schema(rows.schema).parquet(f"{path}/flows/batch={number}").groupBy("label").agg(zero.alias("candidates"), F.count("*").alias("kept"))
        parts = rows.groupBy("label").agg(F.count("*").alias("candidates"), zero.alias("kept")).unionByName(kept)
        if before is not None:
            parts = parts.unionByName(before.select("label", "candidates", "kept"))
        parts.groupBy("label").agg(F.sum("candidates").alias("candidates"), F.sum("kept").alias("kept")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def label_counts(spark, path: str) -> DataFrame:
    """STR04: (label, candidates, kept, capped) of all batches that `label_to` has finished."""
    found = _counters(spark, f"{path}/counts", 1 << 62)
    return found.withColumn("capped", F.col("candidates") - F.col("kept")) if found is not None else spark.createDataFrame([], "label string, candidates long, kept long, capped long")
