"""Streams: packets to flows by session windows, bounded sketches as keyed state, alert counts, per-service memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators.staging import discard, staged

from .states import MemoryRule, ServiceMemory


def stream_flows(packets: DataFrame, gap: str = "60 seconds", watermark: str = "10 minutes") -> DataFrame:
    """STR01: packets (event_time, addresses, length) to closed flows: a flow ends after `gap` without packets. Late
    packets beyond the watermark are dropped; it also bounds the open state. The same code serves batch frames."""
    key = S.canonical_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"))["key"]
    rows = packets.withWatermark("event_time", watermark) if packets.isStreaming else packets
    by = rows.withColumn("key", key).groupBy(F.session_window("event_time", gap).alias("w"), "key")
    made = by.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min("event_time").alias("start"), F.max("event_time").alias("end"))
    return made.select(F.concat_ws("|", "key.a", "key.ap", "key.b", "key.bp", "key.proto").alias("flow"), "packets", "bytes", "start", "end")


def alert_counts(alerts: DataFrame, size: str, slide: str, watermark: str = "10 minutes") -> DataFrame:
    """STR13: alerts by sliding window and service."""
    rows = alerts.withWatermark("event_time", watermark) if alerts.isStreaming else alerts
    return rows.groupBy(F.window("event_time", size, slide).alias("w"), "service").agg(F.count("*").alias("flows"), F.sum(F.col("hit").cast("bigint")).alias("alerts")).select(F.col("w.start").alias("start"), "service", "flows", "alerts")


def label_stream(flows: DataFrame, ips: DataFrame, attack: str = "ATTACK") -> DataFrame:
    """STR04: closed flows (src, dst) joined with a static indicator list; schedules and caps are in `labelled`."""
    from flowharbor.operators.labels import small

    known = small(ips.select("ip").distinct())
    a = flows.join(known.withColumnRenamed("ip", "src").withColumn("s", F.lit(1)), "src", "left")
    b = a.join(known.withColumnRenamed("ip", "dst").withColumn("d", F.lit(1)), "dst", "left")
    return b.withColumn("label", F.when(F.col("s").isNotNull() | F.col("d").isNotNull(), attack).otherwise("BENIGN")).drop("s", "d")


_SKETCH = "flow string, packets long, bytes long, lens array<int>"


def sketch_stream(rows: DataFrame, most: int = 12, timeout_ms: int = 60_000) -> DataFrame:
    """STR02: exact counters and the first two thirds and last third of `most` lengths of each flow, as keyed state
    that is emitted and dropped when the flow has been silent past the timeout. Memory a flow: `most` numbers."""
    head, tail = most * 2 // 3, most - most * 2 // 3

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, size, first, last = state.get
            state.remove()
            yield pd.DataFrame({"flow": [key[0]], "packets": [n], "bytes": [size], "lens": [[*first, *last]]})
            return
        n, size, first, last = state.get if state.exists else (0, 0, [], [])
        first, last, latest = list(first), list(last), 0
        for pdf in batches:
            pdf = pdf.sort_values(["event_time", "seq"])
            latest = max(latest, int(pdf["event_time"].max().timestamp() * 1000))
            for x in pdf["len"]:
                n, size = n + 1, size + int(x)
                (first if len(first) < head else last).append(int(x))
            last = last[-tail:]
        state.update((n, size, first, last))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + timeout_ms)
        yield pd.DataFrame({"flow": [], "packets": [], "bytes": [], "lens": []})

    return rows.withWatermark("event_time", "1 minute").groupBy("flow").applyInPandasWithState(step, _SKETCH, "n long, size long, first array<int>, last array<int>", "append", "EventTimeTimeout")


#: Rows of services that one task of the memory fold sorts, about, and range partitions of so many rows in the table that it is cut from.
SLICE, PARTS = 4_000_000, 4


def service_slices(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows of services, staged in range partitions of (service, *order), and its slices: read one after the other they give each service's
    rows in `order`, and of each slice one task of a shuffle by service gets SLICE rows about, whatever the size of a service."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_b", F.pmod(F.hash("service"), F.lit(tasks)))
    sizes = [r["count"] for r in dealt.groupBy("_b").count().collect()]
    if max(sizes, default=0) <= SLICE:
        return rows, [rows]
    parts = staged(dealt.repartitionByRange(max(tasks, -(-sum(sizes) * PARTS // SLICE)), "_b", "service", *order).withColumn("_part", F.spark_partition_id()), "service-rows")
    places, so_far = [], {}
    for b, part, n in sorted(parts.groupBy("_b", "_part").count().collect()):
        number, held = so_far.get(b, (0, 0))
        number, held = (number + 1, n) if held and held + n > SLICE else (number, held + n)
        so_far[b] = number, held
        places.append((b, part, number))
    at = F.broadcast(spark.createDataFrame(places, "_b int, _part int, _slice int"))
    slices = []
    for k in range(max(number for *_, number in places) + 1):
        some = parts.where(F.col("_part").isin(*{part for _, part, number in places if number == k}))
        slices.append(some.join(at.where(F.col("_slice") == k), ["_b", "_part"], "left_semi").select(*rows.columns))
    return parts, slices


def dynamic_memory(scored: DataFrame, threshold: float, size: int = 128, least: float = 0.7, alpha: float = 0.95, top: int = 5, poison: str | None = None) -> DataFrame:
    """STR08: per service an ordered fold: a flow's score is the mean distance of its value to the `top` nearest remembered ones (the
    model's score while the memory is short); flows under the threshold are remembered if the service's reputation, decayed by alpha at every
    alert and recovering otherwise, is at least `least`. Rows whose column `poison` is true are remembered whatever they score. Sequential inside a service by nature; a service streams through
    one task in time order without being gathered. Where that is more than SLICE rows, one slice of time after the other is sorted and folded, and a
    service's memory and reputation go from slice to slice."""
    schema = "flow_id long, service string, memory_score double, admitted int, reputation double, memory binary"  # as bytes: a column of null arrays takes Arrow's writer most of the time
    names = ["flow_id", "service", "memory_score", "admitted", "reputation"]
    rule, order = MemoryRule(threshold, size, least, alpha, top), ["ts", "flow_id", "value", "score", "forced"]
    forced = F.coalesce(F.col(poison), F.lit(False)) if poison else F.lit(False)
    rows = scored.select("flow_id", "service", "ts", F.col("value").cast("double").alias("value"), F.col("score").cast("double").alias("score"), forced.alias("forced"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, memory, met, ends = None, ServiceMemory(rule), False, []
        for pdf in batches:
            got, admitted, trust, real = [], [], [], pdf["memory"].isna().to_numpy()
            for s, value, score, forced, held, known in zip(*(pdf[c].tolist() for c in ("service", "value", "score", "forced", "memory", "reputation"))):
                if s != service:
                    if met:
                        ends.append((service, memory.trust, [*memory.values]))
                    service, memory, met = s, ServiceMemory(rule), False
                if held is not None:
                    memory = ServiceMemory(rule, np.frombuffer(held).tolist(), known)
                    continue
                near, admit = memory.step(value, score, forced)
                met = True
                got.append(near)
                admitted.append(admit)
                trust.append(memory.trust)
            rows = pdf.loc[real, ["flow_id", "service"]]
            yield rows.assign(memory_score=np.array(got, float), admitted=np.array(admitted, int), reputation=np.array(trust, float), memory=None)
            if ends:
                yield kept(ends)
                ends = []
        if met:
            yield kept([(service, memory.trust, [*memory.values])])

    def kept(ends: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(s, trust, np.array(memory, float).tobytes()) for s, trust, memory in ends], columns=["service", "reputation", "memory"]).assign(flow_id=None, memory_score=None, admitted=None)[[*names, "memory"]]

    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source, slices = service_slices(rows, order)
    if len(slices) == 1:
        slices, deal = [rows], lambda df: df.repartition("service")
    else:
        deal = lambda df: df.repartition(tasks, "service")
    out, before = None, None
    for part in slices:
        part = part.withColumns({"memory": F.lit(None).cast("binary"), "reputation": F.lit(None).cast("double")})
        if before is not None:
            part = part.unionByName(before.where("memory IS NOT NULL").select("service", "memory", "reputation"), allowMissingColumns=True)
        part = deal(part).sortWithinPartitions("service", F.col("memory").isNull(), *order).select("flow_id", "service", "value", "score", "forced", "memory", "reputation")
        before = part.mapInPandas(run, schema)
        before = staged(before, "memory-slice") if len(slices) > 1 else before
        one = before.where("memory IS NULL").select(*names)
        out = one if out is None else out.unionByName(one)
    discard(source)
    return out
