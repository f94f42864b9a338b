"""Batch twins of the streams, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.streaming import flows as T
from flowharbor.streaming import labelled as LB

from .binding import PACKETS, epoch, packets, read
from .registry import query
from .window_queries import EV, events


@query(f"""WITH {PACKETS}, n AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY flow ORDER BY ts) >= 3600, true) AS INT) AS new FROM rows),
 i AS (SELECT *, sum(new) OVER (PARTITION BY flow ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM n) SELECT flow, count(*) AS packets, sum(len)::BIGINT AS bytes, min(ts) AS "start", max(ts) AS "end" FROM i GROUP BY flow, s""")
def str01_session_flows(spark, sf):
    p = packets(spark, sf).withColumn("event_time", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("bigint")))
    return T.stream_flows(p, "3600 seconds").withColumns({c: F.unix_micros(c) / 1e6 for c in ("start", "end")})


@query(f"WITH {EV}, s AS (SELECT *, unnest([floor(ts / 21600) * 21600, floor(ts / 21600) * 21600 - 21600]) AS \"start\" FROM ev) SELECT \"start\", service, count(*) AS flows, sum(hit)::BIGINT AS alerts FROM s GROUP BY ALL")
def str13_alert_counts(spark, sf):
    e = events(spark, sf).withColumn("event_time", F.timestamp_seconds("ts"))
    return T.alert_counts(e, "12 hours", "6 hours").withColumn("start", F.unix_micros("start") / 1e6)


@query()
def str08_dynamic_memory(spark, sf):
    e = events(spark, sf).select("flow_id", "service", "ts", (F.col("bytes") / 500).alias("value"), "score")
    return T.dynamic_memory(e, 0.1)


@query("SELECT event_id AS flow_id, CASE WHEN 'u' || (user_id % 50) IN ('u3', 'u7', 'u11') OR 's' || (user_id % 9) = 's4' THEN 'ATTACK' ELSE 'BENIGN' END AS label FROM events")
def str03_label_stream(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("flow_id"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("src"), F.concat(F.lit("s"), F.col("user_id") % 9).alias("dst"))
    ips = read(spark, sf, "region").select(F.explode(F.array(*[F.lit(x) for x in ("u3", "u7", "u11", "s4")])).alias("ip"))
    return T.label_stream(e, ips).select("flow_id", "label")


@query("""WITH l AS (SELECT event_id AS flow_id, CASE WHEN 'u' || (user_id % 50) IN ('u3', 'u7', 'u11') OR 's' || (user_id % 9) = 's4' THEN 'Botnet' ELSE 'BENIGN' END AS label, epoch(ts) AS start_ts FROM events)
 SELECT flow_id, label FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY start_ts, flow_id) <= 700""")
def str04_capped_labels(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("flow_id"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("src"), F.concat(F.lit("s"), F.col("user_id") % 9).alias("dst"), epoch("ts").alias("start_ts"))
    ips = read(spark, sf, "region").select(F.explode(F.array(*[F.lit(x) for x in ("u3", "u7", "u11", "s4")])).alias("ip"))
    return LB.capped(LB.indicator_labels(ips)(e), 700, ["start_ts", "flow_id"]).select("flow_id", "label")
