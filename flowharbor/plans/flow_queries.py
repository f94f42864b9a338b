"""Queries of packets, flows, bursts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators import flows as O

from .binding import PACKETS, packets, read, rows
from .registry import query

def flow_key():
    return F.concat_ws("|", "key.a", "key.ap", "key.b", "key.bp", "key.proto")


@query(f"""WITH {PACKETS} SELECT flow, string_agg(len::VARCHAR, ',' ORDER BY ts, seq) AS lens, string_agg(dir::VARCHAR, ',' ORDER BY ts, seq) AS dirs,
 count(*) AS packet_count, min(ts) AS start_ts, max(ts) - min(ts) AS duration FROM rows GROUP BY flow""")
def agg01_flows(spark, sf):
    return O.aggregate_packets(packets(spark, sf)).select(flow_key().alias("flow"), F.concat_ws(",", F.col("lens").cast("array<string>")).alias("lens"), F.concat_ws(",", F.col("dirs").cast("array<string>")).alias("dirs"), "packet_count", "start_ts", "duration")


@query(f"""WITH {PACKETS} SELECT flow, count(*) AS packet_count, count(*) FILTER (dir = 1) AS orig_packets, count(*) FILTER (dir = 0) AS resp_packets,
 coalesce(sum(len) FILTER (dir = 1), 0)::BIGINT AS orig_bytes, coalesce(sum(len) FILTER (dir = 0), 0)::BIGINT AS resp_bytes FROM rows GROUP BY flow""")
def agg03_trace_flows(spark, sf):
    return O.trace_flows(packets(spark, sf), 128).select(flow_key().alias("flow"), "packet_count", *[F.col(c).cast("bigint") for c in ("orig_packets", "resp_packets", "orig_bytes", "resp_bytes")])


@query(f"""WITH {PACKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts, seq) AS i, row_number() OVER (PARTITION BY flow ORDER BY ts DESC, seq DESC) AS j FROM rows)
 SELECT flow, count(*) AS packets, sum(len)::BIGINT AS bytes, count(*) FILTER (i <= 2 OR j <= 1) AS kept, sum(len) FILTER (i <= 2 OR j <= 1)::BIGINT AS kept_bytes FROM r GROUP BY flow""")
def agg04_sketch(spark, sf):
    return O.sketch(rows(spark, sf), 3)


@query(f"""WITH {PACKETS}, f AS (SELECT flow, count(*) AS n, any_value(protocol) AS proto, string_split(flow, '|')[1] AS a FROM rows GROUP BY flow),
 l AS (SELECT 'protocol' AS field, proto AS value, n FROM f UNION ALL SELECT 'endpoint', a, n FROM f)
 SELECT field, value, count(*) AS flows, round(avg(n), 6) AS avg_packets, quantile_cont(n, 0.5)::DOUBLE AS median_packets, max(n) AS max_packets FROM l GROUP BY field, value""")
def agg05_dataset_report(spark, sf):
    f = O.aggregate_packets(packets(spark, sf)).withColumns({"protocol": F.col("key.proto"), "endpoint": F.col("key.a")})
    return O.dataset_report(f, ["protocol", "endpoint"]).withColumn("avg_packets", F.round("avg_packets", 6))


BURSTS = f"""WITH {PACKETS}, n AS (SELECT *, CAST(coalesce(lag(dir) OVER w <> dir OR ts - lag(ts) OVER w > 7200, true) AS INTEGER) AS new FROM rows WINDOW w AS (PARTITION BY flow ORDER BY ts, seq)),
 b AS (SELECT *, sum(new) OVER (PARTITION BY flow ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM n)"""


@query(f'{BURSTS} SELECT flow, burst, min(ts) AS start, max(ts) AS "end", max(dir) AS dir, count(*) AS n, sum(len)::BIGINT AS bytes FROM b GROUP BY flow, burst')
def sca23_bursts(spark, sf):
    return O.bursts(rows(spark, sf), 7200)


@query(f"""{BURSTS} SELECT flow, seq, CASE WHEN i = 1 AND j = 1 THEN 'SINGLE' WHEN i = 1 THEN 'START' WHEN j = 1 THEN 'END' ELSE 'MID' END AS tag FROM (SELECT *,
 row_number() OVER (PARTITION BY flow, burst ORDER BY ts, seq) AS i, row_number() OVER (PARTITION BY flow, burst ORDER BY ts DESC, seq DESC) AS j FROM b)""")
def sca23_burst_tags(spark, sf):
    return O.burst_tags(rows(spark, sf), 7200).select("flow", "seq", "tag")


@query(f"""WITH {PACKETS}, n AS (SELECT *, CAST(coalesce(lag(dir) OVER (PARTITION BY flow ORDER BY ts, seq) <> dir, true) AS INTEGER) AS new FROM rows),
 b AS (SELECT *, sum(new) OVER (PARTITION BY flow ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS seg FROM n) SELECT flow, seg::BIGINT AS burst, max(dir) AS dir, count(*) AS n, sum(len)::BIGINT AS bytes FROM b GROUP BY flow, seg""")
def sca22_segments(spark, sf):
    return O.segments(rows(spark, sf)).select("flow", "burst", "dir", "n", "bytes")


@query(f"""WITH {PACKETS}, f AS (SELECT flow, count(*) AS n, min(len) AS lo, max(len) AS hi FROM rows GROUP BY flow),
 s AS (SELECT *, CAST(coalesce(lag(dir) OVER (PARTITION BY flow ORDER BY ts, seq), -1) <> dir AS INTEGER) AS new FROM rows),
 g AS (SELECT *, sum(new) OVER (PARTITION BY flow ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS seg FROM s),
 r AS (SELECT flow, lo AS length, sum(n) AS count FROM (SELECT flow, seg, count(*) AS n, min(len) AS lo, max(len) AS hi FROM g GROUP BY flow, seg) WHERE n > 1 AND lo = hi GROUP BY flow, lo)
 SELECT flow, 'SHORT' AS kind, NULL::BIGINT AS length, n AS count FROM f WHERE n < 6 UNION ALL SELECT flow, 'SAME', lo::BIGINT, n FROM f WHERE lo = hi
 UNION ALL SELECT flow, 'REPEAT', length::BIGINT, count::BIGINT FROM r WHERE count >= CASE WHEN length = 0 THEN 6 ELSE 2 END""")
def tok01_simple_profile(spark, sf):
    return O.simple_profile(rows(spark, sf))


@query(f"""WITH {PACKETS} SELECT flow, count(*) AS n, round(avg(len), 6) AS mean, round(stddev_pop(len), 6) AS std, min(len) AS least, max(len) AS most, quantile_cont(len, 0.5)::DOUBLE AS median,
 round(quantile_cont(len, 0.9), 6)::DOUBLE AS p90, count(*) FILTER (dir = 1) AS up_n, round(coalesce(avg(len) FILTER (dir = 1), 0), 6) AS up_mean FROM rows GROUP BY flow""")
def sca43_flow_stats(spark, sf):
    return O.flow_stats(rows(spark, sf)).select("flow", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most", "median", F.round("p90", 6).alias("p90"), "up_n", F.round("up_mean", 6).alias("up_mean"))


@query("""SELECT event_id, CASE WHEN value <= 0 THEN 0 ELSE least(floor(log2(value + 1)), 15) END::INTEGER AS log_bin, CASE WHEN value <= 0 THEN 0 ELSE least(floor(log2(value / 1000 * 1000.0 + 1)), 15) END::INTEGER AS iat_bin,
 least(CAST(trunc(least(1.0, value / 400) * 10) AS INTEGER), 10) AS ratio_bin, ((value > 10)::INT + (value > 50)::INT + (value > 100)::INT) AS edge_bin FROM events""")
def sca19_bins(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", S.log_bin(v).alias("log_bin"), S.iat_bin(v / 1000).alias("iat_bin"), S.ratio_bin(v / 400).alias("ratio_bin"), S.edge_bin(v, [10, 50, 100]).alias("edge_bin"))


@query("SELECT event_id, substr(sha1(event_id || '|' || event_type || '|' || user_id), 1, 20) AS id FROM events")
def sca11_stable_id(spark, sf):
    return read(spark, sf, "events").select("event_id", S.stable_id(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("id"))


@query(f"""WITH {PACKETS} SELECT seq, CASE WHEN p > 65535 THEN 'PORT_OTHER' WHEN p = 0 THEN 'PORT_ZERO' WHEN p < 1024 THEN 'PORT_SYSTEM' WHEN p < 49152 THEN 'PORT_REGISTERED' ELSE 'PORT_DYNAMIC' END AS class,
 CASE WHEN p <= 0 THEN 'none' WHEN p IN (20, 21) THEN 'ftp' WHEN p = 22 THEN 'ssh' WHEN p IN (25, 465, 587) THEN 'smtp' WHEN p = 53 THEN 'dns' WHEN p IN (80, 8080) THEN 'http' WHEN p = 161 THEN 'snmp' WHEN p IN (443, 8443) THEN 'ssl' ELSE 'other' END AS service FROM (SELECT seq, CASE seq % 5 WHEN 0 THEN [0, 465, 587, 161, 8080, 8443, 22, 25, 20, 65536][seq % 10 + 1] ELSE dst_port::INT END AS p FROM packets)""")
def sca24_port_maps(spark, sf):
    some = F.element_at(F.array(*[F.lit(p) for p in (0, 465, 587, 161, 8080, 8443, 22, 25, 20, 65536)]), (F.col("seq") % 10 + 1).cast("int")).cast("string")
    p = packets(spark, sf).withColumn("dst_port", F.when(F.col("seq") % 5 == 0, some).otherwise(F.col("dst_port")))
    return p.select("seq", S.port_class(F.col("dst_port")).alias("class"), S.service_from_port(F.col("dst_port")).alias("service"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey % 4 AS p, o_custkey % 3 AS q FROM orders) SELECT uid, count(*) AS n, sum(len)::BIGINT AS bytes, sum(o)::BIGINT AS orig FROM (
 SELECT o_orderkey AS uid, CASE WHEN i < p THEN 100 ELSE 300 END AS len, CAST(i < p AS INT) AS o FROM c, range(0, 7) r(i) WHERE i < p + q) GROUP BY uid""")
def udt01_expand_conn(spark, sf):
    p, q = F.col("o_custkey") % 4, F.col("o_custkey") % 3
    conns = read(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.lit(0.0).alias("ts"), F.lit(1.0).alias("duration"), p.alias("orig_pkts"), q.alias("resp_pkts"), (p * 100).alias("orig_bytes"), (q * 300).alias("resp_bytes"), F.lit("http").alias("service"))
    return O.expand_conn(conns).groupBy("uid").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(F.col("is_orig").cast("bigint")).alias("orig"))


@query("""SELECT l_returnflag AS family, count(*) FILTER (NOT b) AS kept, count(*) FILTER (b) AS removed FROM (SELECT *, l_quantity <= 2 AND floor(l_discount * 100 + 0.5) = 0 AS b FROM lineitem) GROUP BY l_returnflag""")
def sca35_degenerate(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("n"), F.floor(F.col("l_discount") * 100 + 0.5).alias("bytes"))
    return O.drop_degenerate(li, "family", "n", "bytes")[1]
