"""Joins of flows with label feeds, schedules and indicator lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import running, staged

#: Rows of a schedule or an indicator list up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a bounded count shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bucket_width(rows: DataFrame, lo: Column, hi: Column, least: float) -> float:
    """The width of time buckets to which intervals are dealt: their mean length, `least` at least, so that on average
    an interval, however many and long they are, goes to two buckets at most."""
    return max(least, rows.agg(F.avg(hi - lo)).first()[0] or 0.0)


def label_flows(flows: DataFrame, labels: DataFrame, tolerance: float, bucket: float) -> DataFrame:
    """JOI01/02: each flow's label row that is nearest in time, within the tolerance, on the same canonical key.

    flows (flow_id, key, ts), labels (label_id, key, start_ts, end_ts, label; both times null: matches at distance 0, unless
    a column timestamp_parse_status calls the time invalid, not missing: then the row matches nothing).
    Intervals are dealt to time buckets, so the band is an equi-join on (key, bucket) and a hot key spreads over buckets. Ties go to the smaller
    (distance, start, end, label_id). Returns every flow with label (null: unmatched), delta and n_candidates.
    """
    lo, hi = F.col("start_ts") - tolerance, F.col("end_ts") + tolerance
    if "timestamp_parse_status" in labels.columns:
        labels = labels.where("timestamp_parse_status IS NULL OR timestamp_parse_status <> 'invalid'")
    timed = labels.where("start_ts IS NOT NULL")
    bucket = bucket_width(timed, lo, hi, bucket)
    timed = timed.withColumn("b", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    keyed = flows.withColumn("b", F.floor(F.col("ts") / bucket))
    near = keyed.join(timed, ["key", "b"]).where((F.col("ts") >= lo) & (F.col("ts") <= hi)).drop("b")
    gap = F.greatest(F.col("start_ts") - F.col("ts"), F.col("ts") - F.col("end_ts"), F.lit(0.0))
    near = near.select("flow_id", "label_id", "label", gap.alias("delta"), "start_ts", "end_ts")
    untimed = flows.join(labels.where("start_ts IS NULL"), "key").select("flow_id", "label_id", "label", F.lit(0.0).alias("delta"), "start_ts", "end_ts")
    best = near.unionByName(untimed).groupBy("flow_id").agg(F.min(F.struct("delta", "start_ts", "end_ts", "label_id", "label")).alias("m"), F.count("*").alias("n_candidates"))
    found = best.select("flow_id", F.col("m.label").alias("label"), F.col("m.delta").alias("delta"), F.col("m.label_id").alias("label_id"), "n_candidates")
    return flows.select("flow_id").join(found, "flow_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def alignment_report(labelled: DataFrame) -> DataFrame:
    """AGG06: flows, matched, ambiguous, rates, mean distance and its nearest-rank 95th percentile."""
    hit = F.col("label").isNotNull()
    labelled = staged(labelled.select("label", "delta", "n_candidates"), "labelled")  # read three times
    made = labelled.agg(F.count("*").alias("flows"), F.count_if(hit).alias("matched"), F.count_if(F.col("n_candidates") > 1).alias("ambiguous"), F.avg("delta").alias("mean_delta"))
    p95 = labelled.where(hit).groupBy("delta").agg(F.count("*").alias("c"))
    p95 = running(p95, [], ["delta"], {"upto": F.col("c")})
    rank = F.bround(0.95 * (F.col("matched") - 1)) + 1
    p95 = p95.crossJoin(made.select("matched")).where(F.col("upto") >= rank).agg(F.min("delta").alias("p95_delta"))
    return made.crossJoin(p95).withColumn("match_rate", F.when(F.col("flows") > 0, F.col("matched") / F.col("flows")))


def clock_offset(flows: DataFrame, labels: DataFrame, most: float = 36 * 3600.0, ends: int = 4) -> DataFrame:
    """JOI04: the offset between two clocks: differences on shared keys, of each key's first and last `ends` rows, the
    commonest hour, then in it the commonest minute; ties to the smaller offset."""
    def edge(df: DataFrame, ts: str) -> DataFrame:
        w = Window.partitionBy("key")
        return df.withColumns({"i": F.row_number().over(w.orderBy(ts)), "j": F.row_number().over(w.orderBy(F.desc(ts)))}).where((F.col("i") <= ends) | (F.col("j") <= ends)).select("key", F.col(ts).alias("t"))

    pairs = edge(flows, "ts").join(edge(labels.where("start_ts IS NOT NULL"), "start_ts").withColumnRenamed("t", "s"), "key")
    deltas = pairs.select((F.col("t") - F.col("s")).alias("d")).where(F.abs("d") <= most).withColumns({"h": F.bround(F.col("d") / 3600) * 3600, "m": F.bround(F.col("d") / 60) * 60})
    by = deltas.groupBy("h", "m").agg(F.count("*").alias("n"))
    hour = by.groupBy("h").agg(F.sum("n").alias("hn")).orderBy(F.desc("hn"), F.abs("h"), "h").limit(1)
    return by.join(F.broadcast(hour), "h").orderBy(F.desc("n"), F.abs("m"), "m").limit(1).select(F.col("m").alias("offset"), F.col("n").alias("votes"), F.col("hn").alias("hour_votes"))


def overlapping(rows: DataFrame, windows: DataFrame, bucket: float) -> DataFrame:
    """Rows (start_ts, end_ts) with each window (w_start, w_end) that they overlap: both are dealt to the time buckets that they
    touch, and a pair counts in its first common bucket only, so the range join is an equi-join at any size."""
    place = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    r = rows.where("start_ts <= end_ts").withColumn("__b", place("start_ts", "end_ts"))
    w = windows.where("w_start <= w_end").withColumn("__b", place("w_start", "w_end"))
    met = r.join(w, "__b").where("start_ts <= w_end AND end_ts >= w_start")
    return met.where(F.col("__b") == F.floor(F.greatest("start_ts", "w_start") / bucket)).drop("__b")


def label_by_schedule(flows: DataFrame, windows: DataFrame, tolerance: float = 0.0, ambiguous: str = "quarantine", bucket: float = 86400.0) -> DataFrame:
    """JOI05: flows (flow_id, src, dst, start_ts, end_ts) against windows (window_id, family, start_ts, end_ts, attackers,
    victims): overlap in time and the two end sets met in either orientation. No window: BENIGN. Windows of several
    families: quarantine, drop, first (window) or benign."""
    w = windows.select("window_id", "family", "attackers", "victims", (F.col("start_ts") - tolerance).alias("w_start"), (F.col("end_ts") + tolerance).alias("w_end"))
    met = (F.array_contains("attackers", F.col("src")) & F.array_contains("victims", F.col("dst"))) | (F.array_contains("attackers", F.col("dst")) & F.array_contains("victims", F.col("src")))
    hits = overlapping(flows, w, bucket).where(met).select("flow_id", "window_id", "family")
    hit = flows.select("flow_id").join(hits, "flow_id", "left")
    by = hit.groupBy("flow_id").agg(F.count("window_id").alias("n"), F.size(F.collect_set("family")).alias("families"), F.min(F.struct("window_id", "family")).alias("first"))
    several = {"quarantine": "QUARANTINE", "benign": "BENIGN"}.get(ambiguous)
    label = F.when(F.col("n") == 0, "BENIGN").when(F.col("families") > 1, F.lit(several) if several else F.col("first.family")).otherwise(F.col("first.family"))
    out = by.select("flow_id", label.alias("family"), F.col("n").alias("n_windows"), (F.col("families") > 1).alias("ambiguous"))
    return out.where(~F.col("ambiguous")) if ambiguous == "drop" else out


def label_by_ip(flows: DataFrame, ips: DataFrame, attack: str = "ATTACK") -> DataFrame:
    """JOI06: ATTACK where an end of the flow is in the list `ip`, with the ends that are."""
    ends = flows.select("flow_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("ip"))
    hits = ends.join(small(ips.select("ip").distinct()), "ip").groupBy("flow_id").agg(F.array_join(F.array_sort(F.collect_list("ip")), ",").alias("matched"))
    return flows.join(hits, "flow_id", "left").select("flow_id", F.when(F.col("matched").isNotNull(), attack).otherwise("BENIGN").alias("label"), F.coalesce("matched", F.lit("")).alias("matched"))


def enrich_by_uid(packets: DataFrame, conns: DataFrame) -> DataFrame:
    """JOI07: empty protocol and service filled from the uid's last connection row (uid, seq, proto, service)."""
    last = conns.groupBy("uid").agg(F.max(F.struct("seq", "proto", "service")).alias("c"))
    fill = lambda have, got: F.coalesce(F.nullif(F.col(have), F.lit("")), F.col(got))
    return packets.join(last, "uid", "left").withColumns({"protocol": fill("protocol", "c.proto"), "service": fill("service", "c.service")}).drop("c")


def match_interval(flows: DataFrame, labels: DataFrame, tolerance: float, bucket: float = 86400.0) -> DataFrame:
    """JOI08: status of each flow against label intervals: matched (one family), ambiguous, unmatched_time, unmatched_key.
    Intervals are dealt to time buckets, so a hot key's flows meet only the labels of their time."""
    lo, hi = F.col("start_ts") - tolerance, F.col("end_ts") + tolerance
    timed = labels.where("start_ts IS NOT NULL AND end_ts >= start_ts")
    bucket = bucket_width(timed, lo, hi, bucket)
    timed = timed.select("key", "label", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))).alias("b"))
    hits = flows.select("flow_id", "key", "ts", F.floor(F.col("ts") / bucket).alias("b")).join(timed, ["key", "b"]).where("ts >= lo AND ts <= hi")
    found = hits.groupBy("flow_id").agg(F.count("*").alias("hits"), F.count_distinct("label").alias("families"), F.min("label").alias("family"))
    keys = labels.where("label IS NOT NULL").select("key").distinct().withColumn("keyed", F.lit(1))
    by = flows.select("flow_id", "key").join(keys, "key", "left").join(found, "flow_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("keyed", "hits", "families")})
    status = F.when(F.col("keyed") == 0, "unmatched_key").when(F.col("hits") == 0, "unmatched_time").when(F.col("families") > 1, "ambiguous").otherwise("matched")
    return by.select("flow_id", status.alias("status"), F.when(status == "matched", F.col("family")).alias("family"))


def periods(flows: DataFrame, windows: DataFrame, pad: float, bucket: float = 86400.0) -> DataFrame:
    """JOI09: in, pre, post or outside of the first window (by id) whose padded span holds the flow's ts."""
    w = windows.select("window_id", F.col("start_ts").alias("s"), F.col("end_ts").alias("e"), (F.col("start_ts") - pad).alias("w_start"), (F.col("end_ts") + pad).alias("w_end"))
    points = flows.select("flow_id", "ts", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"))
    hits = overlapping(points, w, bucket).select("flow_id", "window_id", F.col("s").alias("start_ts"), F.col("e").alias("end_ts"))
    hit = flows.select("flow_id", "ts").join(hits, "flow_id", "left")
    where = F.when(F.col("window_id").isNull(), "outside").when(F.col("ts") < F.col("start_ts"), "pre").when(F.col("ts") > F.col("end_ts"), "post").otherwise("in")
    return hit.groupBy("flow_id").agg(F.min(F.struct(F.col("window_id"), where.alias("period"))).alias("m")).select("flow_id", "m.window_id", "m.period")


def merge_windows(rows: DataFrame, padding: float = 5.0, gap: float = 60.0, min_rows: int = 1) -> DataFrame:
    """AGG35: label rows (label, start_ts, end_ts) of one label within `gap` of what came before, as padded windows."""
    order = Window.partitionBy("label").orderBy("start_ts", "end_ts")
    ended = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", (ended.isNull() | (F.col("start_ts") > ended + gap)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = islands.groupBy("label", "island").agg((F.min("start_ts") - padding).alias("start"), (F.max("end_ts") + padding).alias("end"), F.count("*").alias("rows"))
    return made.where(F.col("rows") >= min_rows)
