"""Packets to bidirectional flows, their sketches, bursts, profiles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S


def aggregate_packets(packets: DataFrame) -> DataFrame:
    """AGG01: one row a bidirectional flow (and uid, if the packets have one), packets ordered by (timestamp, seq).

    `dirs` is 1 for the canonical direction, or, where the packets say `is_orig`, for the originator: the flag as it is on
    the canonical tuple, negated on its reverse. One shuffle on the key; a flow's packets form arrays as the output has them.
    """
    uid = F.col("uid") if "uid" in packets.columns else F.lit("")
    key = S.canonical_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"))
    rows = packets.select(key.alias("k"), uid.alias("uid"), F.struct(F.col("timestamp").alias("ts"), F.col("seq").alias("seq"), F.col("length").alias("len"), direction(packets, key["is_fwd"]).alias("dir")).alias("p"))
    flows = rows.groupBy(F.col("k.key").alias("key"), "uid").agg(F.sort_array(F.collect_list("p")).alias("p"))
    tss = F.transform("p", lambda x: x["ts"])
    return flows.select(
        S.stable_id(F.col("key.a"), F.col("key.ap"), F.col("key.b"), F.col("key.bp"), F.col("key.proto"), F.col("uid"), F.format_string("%.6f", tss[0])).alias("flow_id"),
        "key", "uid", F.transform("p", lambda x: x["len"]).alias("lens"), F.transform("p", lambda x: x["dir"]).alias("dirs"), tss.alias("tss"), S.iats(tss).alias("iats"),
        F.size("p").cast("bigint").alias("packet_count"), tss[0].alias("start_ts"), F.element_at(tss, -1).alias("end_ts"), (F.element_at(tss, -1) - tss[0]).alias("duration"),
    )


def direction(packets: DataFrame, forward: Column) -> Column:
    """1 or 0 by the originator flag of packets that have one, else by the canonical tuple."""
    if "is_orig" not in packets.columns:
        return forward.cast("int")
    return F.coalesce(F.when(forward, F.col("is_orig")).otherwise(~F.col("is_orig")), forward).cast("int")


def trace_flows(packets: DataFrame, cap: int = 128) -> DataFrame:
    """AGG03: exact counters of packets and bytes by direction, arrays of the first `cap` packets only: a packet's rank is known before
    arrays are made, and later packets go into sums."""
    key = S.canonical_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"))
    rows = packets.select(key["key"].alias("key"), F.col("timestamp").alias("ts"), "seq", F.col("length").alias("len"), direction(packets, key["is_fwd"]).alias("dir"))
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("ts", "seq")))
    head = F.sort_array(F.collect_list(F.when(F.col("i") <= cap, F.struct("i", "len", "dir"))))
    up, bytes_ = F.col("dir") == 1, F.col("len").cast("bigint")
    flows = ranked.groupBy("key").agg(F.min("ts").alias("start_ts"), F.count("*").alias("packet_count"), F.count_if(up).alias("orig_packets"), F.count_if(~up).alias("resp_packets"), F.sum(F.when(up, bytes_).otherwise(0)).alias("orig_bytes"), F.sum(F.when(up, 0).otherwise(bytes_)).alias("resp_bytes"), head.alias("p"))
    return flows.select(*[c for c in flows.columns if c != "p"], F.transform("p", lambda x: x["len"]).alias("lens"), F.transform("p", lambda x: x["dir"]).alias("dirs"))


def packet_rows(packets: DataFrame) -> DataFrame:
    """Packets with their flow key and direction, unassembled: what per-packet windows work on."""
    key = S.canonical_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"))
    rows = packets.withColumn("k", key)
    return rows.select(F.concat_ws("|", "k.key.a", "k.key.ap", "k.key.b", "k.key.bp", "k.key.proto").alias("flow"), F.col("timestamp").alias("ts"), "seq", F.col("length").alias("len"), F.col("k.is_fwd").cast("int").alias("dir"))


def sketch(rows: DataFrame, most: int = 12) -> DataFrame:
    """AGG04: of packet_rows, each flow's first two thirds of `most` packets and last third, beside exact totals."""
    head = most * 2 // 3
    order = Window.partitionBy("flow").orderBy("ts", "seq")
    back = Window.partitionBy("flow").orderBy(F.desc("ts"), F.desc("seq"))
    whole = Window.partitionBy("flow")
    marked = rows.withColumns({"first": F.row_number().over(order), "last": F.row_number().over(back), "n": F.count("*").over(whole), "bytes": F.sum("len").over(whole)})
    kept = marked.where((F.col("first") <= head) | (F.col("last") <= most - head))
    return kept.groupBy("flow").agg(F.max("n").alias("packets"), F.max("bytes").alias("bytes"), F.count("*").alias("kept"), F.sum("len").alias("kept_bytes"))


def bursts(rows: DataFrame, gap: float = 0.1) -> DataFrame:
    """SCA23: runs of packets of one direction with gaps up to `gap` seconds: one row a burst."""
    order = Window.partitionBy("flow").orderBy("ts", "seq")
    new = (F.lag("dir").over(order).isNull() | (F.lag("dir").over(order) != F.col("dir")) | (F.col("ts") - F.lag("ts").over(order) > gap)).cast("int")
    runs = rows.withColumn("new", new).withColumn("burst", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("flow", "burst").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("dir").alias("dir"), F.count("*").alias("n"), F.sum("len").alias("bytes"))


def burst_tags(rows: DataFrame, gap: float = 0.1) -> DataFrame:
    """SCA23: START, MID, END or SINGLE for each packet."""
    order = Window.partitionBy("flow").orderBy("ts", "seq")
    starts = F.lag("dir").over(order).isNull() | (F.lag("dir").over(order) != F.col("dir")) | (F.col("ts") - F.lag("ts").over(order) > gap)
    ends = F.lead("dir").over(order).isNull() | (F.lead("dir").over(order) != F.col("dir")) | (F.lead("ts").over(order) - F.col("ts") > gap)
    tagged = rows.withColumns({"s": starts, "e": ends})
    return tagged.withColumn("tag", F.when(F.col("s") & F.col("e"), "SINGLE").when(F.col("s"), "START").when(F.col("e"), "END").otherwise("MID")).drop("s", "e")


def segments(rows: DataFrame) -> DataFrame:
    """SCA22: runs of one direction whatever the gap."""
    return bursts(rows, float("inf"))


def simple_profile(rows: DataFrame, short: int = 6, zero_repeat: int = 6, repeat: int = 2) -> DataFrame:
    """TOK01: SHORT, SAME and REPEAT of each flow: (flow, kind, length, count)."""
    by = rows.groupBy("flow").agg(F.count("*").alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    none = F.lit(None).cast("bigint")
    shorts = by.where(F.col("n") < short).select("flow", F.lit("SHORT").alias("kind"), none.alias("length"), F.col("n").alias("count"))
    same = by.where("lo = hi").select("flow", F.lit("SAME").alias("kind"), F.col("lo").cast("bigint").alias("length"), F.col("n").alias("count"))
    order = Window.partitionBy("flow").orderBy("ts", "seq")
    runs = rows.withColumn("new", (F.coalesce(F.lag("dir").over(order), F.lit(-1)) != F.col("dir")).cast("int")).withColumn("seg", F.sum("new").over(order))
    segs = runs.groupBy("flow", "seg").agg(F.count("*").alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi")).where("n > 1 AND lo = hi")
    repeats = segs.groupBy("flow", F.col("lo").cast("bigint").alias("length")).agg(F.sum("n").alias("count")).where(F.col("count") >= F.when(F.col("length") == 0, zero_repeat).otherwise(repeat))
    return shorts.unionByName(same).unionByName(repeats.select("flow", F.lit("REPEAT").alias("kind"), "length", "count"))


def flow_stats(rows: DataFrame) -> DataFrame:
    """SCA43: moments and percentiles of lengths, by flow, overall and by direction."""
    up = F.when(F.col("dir") == 1, F.col("len"))
    return rows.groupBy("flow").agg(
        F.count("*").alias("n"), F.avg("len").alias("mean"), F.stddev_pop("len").alias("std"), F.min("len").alias("least"), F.max("len").alias("most"),
        F.percentile("len", F.lit(0.5)).alias("median"), F.percentile("len", F.lit(0.9)).alias("p90"), F.count(up).alias("up_n"), F.coalesce(F.avg(up), F.lit(0.0)).alias("up_mean"),
    )


def dataset_report(flows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG05: for each key column and value: flows, and average, median and most packets; one grouping-sets pass."""
    kinds = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("string") for k in keys]))
    long = flows.select("packet_count", F.explode(kinds).alias("field", "value"))
    return long.groupBy("field", "value").agg(F.count("*").alias("flows"), F.avg("packet_count").alias("avg_packets"), F.percentile("packet_count", F.lit(0.5)).alias("median_packets"), F.max("packet_count").alias("max_packets"))


def drop_degenerate(flows: DataFrame, family: str, packets: str, size: str) -> tuple[DataFrame, DataFrame]:
    """SCA35: flows without those of up to 2 packets and no bytes, and the kept and removed counts by family."""
    bad = (F.col(packets) <= 2) & (F.col(size) == 0)
    report = flows.groupBy(family).agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("removed"))
    return flows.where(~bad), report


def expand_conn(conns: DataFrame) -> DataFrame:
    """UDT01: connection rows to packets: orig_pkts, then resp_pkts, spaced evenly over the duration, of mean length."""
    total = F.col("orig_pkts") + F.col("resp_pkts")
    at = conns.withColumn("total", total).where("total > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    fwd = F.col("i") < F.col("orig_pkts")
    step = F.when(F.col("total") > 1, F.col("duration") / (F.col("total") - 1)).otherwise(0.0)
    size = F.when(fwd, F.bround(F.col("orig_bytes") / F.col("orig_pkts"))).otherwise(F.bround(F.col("resp_bytes") / F.col("resp_pkts")))
    return at.select("uid", (F.col("ts") + F.col("i") * step).alias("timestamp"), F.col("i").alias("seq"), fwd.alias("is_orig"), F.greatest(F.coalesce(size, F.lit(0.0)), F.lit(0.0)).cast("int").alias("length"), "service")
