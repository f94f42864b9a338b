"""Queries of label joins: orders are flows, line items label rows of 30 days on the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators import labels as O

from .binding import epoch, read
from .registry import query

DAY = 86400.0
FLOWS = "flows AS (SELECT o_orderkey AS flow_id, o_orderkey AS key, epoch(o_orderdate) AS ts, 'c' || (o_custkey % 50) AS src, 'd' || (o_orderkey % 40) AS dst FROM orders)"
LABELS = "lab AS (SELECT l_orderkey * 10 + l_linenumber AS label_id, l_orderkey AS key, CASE WHEN l_linenumber = 7 THEN NULL ELSE epoch(l_shipdate) END AS start_ts, CASE WHEN l_linenumber = 7 THEN NULL ELSE epoch(l_shipdate) + 2592000.0 END AS end_ts, l_returnflag AS label, l_linenumber = 7 AND l_orderkey % 2 = 0 AS invalid FROM lineitem)"
WINDOWS = "win(window_id, family, d0, d1, a, v) AS (VALUES (1, 'DoS', 300, 700, 0, 0), (2, 'Probe', 600, 1200, 1, 1), (3, 'Botnet', 1000, 2000, 0, 2), (4, 'DoS', 1100, 1300, 0, 0))"


def flows(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("flow_id"), F.col("o_orderkey").alias("key"), epoch("o_orderdate").alias("ts"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("src"), F.concat(F.lit("d"), F.col("o_orderkey") % 40).alias("dst"))


def label_rows(spark, sf):
    li = read(spark, sf, "lineitem")
    start = F.when(F.col("l_linenumber") != 7, epoch("l_shipdate"))
    status = F.when(F.col("l_linenumber") != 7, "parsed").when(F.col("l_orderkey") % 2 == 0, "invalid").otherwise("missing")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label_id"), F.col("l_orderkey").alias("key"), start.alias("start_ts"), (start + 30 * DAY).alias("end_ts"), F.col("l_returnflag").alias("label"), status.alias("timestamp_parse_status"))


def windows(spark, sf):
    first = flows(spark, sf).agg(F.min("ts").alias("t0"))
    made = spark.createDataFrame([(1, "DoS", 300, 700, 0, 0), (2, "Probe", 600, 1200, 1, 1), (3, "Botnet", 1000, 2000, 0, 2), (4, "DoS", 1100, 1300, 0, 0)], "window_id int, family string, d0 int, d1 int, a int, v int")
    ends = lambda c, n, k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit(c), (i * 3 + k).cast("string")))
    return made.crossJoin(first).select("window_id", "family", (F.col("t0") + F.col("d0") * DAY).alias("start_ts"), (F.col("t0") + F.col("d1") * DAY).alias("end_ts"), ends("c", 16, F.col("a")).alias("attackers"), ends("d", 13, F.col("v")).alias("victims"))


NEAR = f"""{FLOWS}, {LABELS}, near AS (SELECT f.flow_id, label_id, label, start_ts, end_ts, CASE WHEN start_ts IS NULL THEN 0.0 ELSE greatest(start_ts - ts, ts - end_ts, 0.0) END AS delta
 FROM flows f JOIN lab l ON f.key = l.key WHERE (start_ts IS NULL AND NOT invalid) OR (ts >= start_ts - 17280000.0 AND ts <= end_ts + 17280000.0)),
 best AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY delta, start_ts NULLS FIRST, end_ts NULLS FIRST, label_id, label) AS r, count(*) OVER (PARTITION BY flow_id) AS n FROM near)"""


@query(f"WITH {NEAR} SELECT f.flow_id, b.label, b.delta, b.label_id, coalesce(b.n, 0) AS n_candidates FROM flows f LEFT JOIN best b ON f.flow_id = b.flow_id AND b.r = 1")
def joi01_label_flows(spark, sf):
    return O.label_flows(flows(spark, sf), label_rows(spark, sf), 200 * DAY, 100 * DAY)


@query(f"""WITH {NEAR}, m AS (SELECT f.flow_id, b.label, b.delta, coalesce(b.n, 0) AS n FROM flows f LEFT JOIN best b ON f.flow_id = b.flow_id AND b.r = 1),
 s AS (SELECT count(*) AS flows, count(label) AS matched, count(*) FILTER (n > 1) AS ambiguous, round(avg(delta), 3) AS mean_delta FROM m),
 d AS (SELECT delta, row_number() OVER (ORDER BY delta) AS i FROM m WHERE label IS NOT NULL)
 SELECT s.*, (SELECT delta FROM d WHERE i = CAST(round_even(0.95 * (s.matched - 1), 0) AS BIGINT) + 1) AS p95_delta, matched / flows AS match_rate FROM s""")
def agg06_alignment_report(spark, sf):
    return O.alignment_report(joi01_label_flows(spark, sf)).withColumn("mean_delta", F.round("mean_delta", 3))


@query(f"""WITH {FLOWS}, {LABELS}, e AS (SELECT key, start_ts AS s FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_ts) AS i, row_number() OVER (PARTITION BY key ORDER BY start_ts DESC) AS j FROM lab WHERE start_ts IS NOT NULL) WHERE i <= 4 OR j <= 4),
 d AS (SELECT ts - s AS d FROM flows JOIN e USING (key) WHERE abs(ts - s) <= 8640000), b AS (SELECT round_even(d / 3600, 0) * 3600 AS h, round_even(d / 60, 0) * 60 AS m, count(*) AS n FROM d GROUP BY ALL),
 h AS (SELECT h, sum(n)::BIGINT AS hn FROM b GROUP BY h ORDER BY hn DESC, abs(h), h LIMIT 1) SELECT m AS "offset", n AS votes, hn AS hour_votes FROM b JOIN h USING (h) ORDER BY n DESC, abs(m), m LIMIT 1""")
def joi04_clock_offset(spark, sf):
    return O.clock_offset(flows(spark, sf), label_rows(spark, sf), 100 * DAY)


@query(f"""WITH {FLOWS}, t AS (SELECT min(ts) AS t0 FROM flows), {WINDOWS}, w AS (SELECT window_id, family, t0 + d0 * 86400.0 AS s, t0 + d1 * 86400.0 AS e, list_transform(range(0, 16), lambda i: 'c' || (i * 3 + a)) AS att, list_transform(range(0, 13), lambda i: 'd' || (i * 3 + v)) AS vic FROM win, t),
 h AS (SELECT f.flow_id, window_id, family FROM flows f LEFT JOIN w ON ts <= e + 86400 AND ts >= s - 86400 AND ((list_contains(att, src) AND list_contains(vic, dst)) OR (list_contains(att, dst) AND list_contains(vic, src))))
 SELECT flow_id, CASE WHEN count(window_id) = 0 THEN 'BENIGN' WHEN count(DISTINCT family) > 1 THEN 'QUARANTINE' ELSE arg_min(family, window_id) END AS family, count(window_id) AS n_windows, count(DISTINCT family) > 1 AS ambiguous FROM h GROUP BY flow_id""")
def joi05_schedule(spark, sf):
    f = flows(spark, sf).select("flow_id", "src", "dst", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"))
    return O.label_by_schedule(f, windows(spark, sf), DAY)


@query(f"""WITH {FLOWS}, ips AS (SELECT DISTINCT 'c' || (c_custkey % 9) AS ip FROM customer UNION SELECT DISTINCT 'd' || (s_suppkey % 5) FROM supplier)
 SELECT flow_id, CASE WHEN src IN (SELECT ip FROM ips) OR dst IN (SELECT ip FROM ips) THEN 'ATTACK' ELSE 'BENIGN' END AS label,
 concat_ws(',', CASE WHEN src IN (SELECT ip FROM ips) THEN src END, CASE WHEN dst IN (SELECT ip FROM ips) THEN dst END) AS matched FROM flows""")
def joi06_indicator(spark, sf):
    a = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 9).alias("ip"))
    b = read(spark, sf, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey") % 5).alias("ip"))
    return O.label_by_ip(flows(spark, sf), a.union(b))


@query(f"""WITH {FLOWS}, {LABELS} SELECT f.flow_id, CASE WHEN count(label) = 0 THEN 'unmatched_key' WHEN count(*) FILTER (o) = 0 THEN 'unmatched_time' WHEN count(DISTINCT CASE WHEN o THEN label END) > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
 CASE WHEN count(DISTINCT CASE WHEN o THEN label END) = 1 THEN min(CASE WHEN o THEN label END) END AS family FROM (SELECT f.flow_id, l.label, coalesce(ts >= start_ts - 17280000.0 AND ts <= end_ts + 17280000.0, false) AS o FROM flows f LEFT JOIN lab l ON f.key = l.key) f GROUP BY f.flow_id""")
def joi08_match_interval(spark, sf):
    return O.match_interval(flows(spark, sf), label_rows(spark, sf), 200 * DAY)


@query(f"""WITH {FLOWS}, t AS (SELECT min(ts) AS t0 FROM flows), {WINDOWS}, w AS (SELECT window_id, t0 + d0 * 86400.0 AS s, t0 + d1 * 86400.0 AS e FROM win, t),
 h AS (SELECT f.flow_id, ts, window_id, s, e FROM flows f LEFT JOIN w ON ts >= s - 8640000 AND ts <= e + 8640000)
 SELECT flow_id, min(window_id) AS window_id, CASE WHEN min(window_id) IS NULL THEN 'outside' WHEN any_value(ts) < arg_min(s, window_id) THEN 'pre' WHEN any_value(ts) > arg_min(e, window_id) THEN 'post' ELSE 'in' END AS period FROM h GROUP BY flow_id""")
def joi09_periods(spark, sf):
    return O.periods(flows(spark, sf), windows(spark, sf), 100 * DAY)


@query("""WITH l AS (SELECT l_returnflag || l_suppkey AS label, epoch(l_shipdate) AS s, epoch(l_shipdate) + 86400.0 AS e FROM lineitem),
 n AS (SELECT *, CAST(coalesce(s > max(e) OVER (PARTITION BY label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 864000, true) AS INT) AS new FROM l),
 i AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
 SELECT label, island::BIGINT AS island, min(s) - 5 AS start, max(e) + 5 AS "end", count(*) AS rows FROM i GROUP BY label, island""")
def agg35_merge_windows(spark, sf):
    li = read(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_suppkey").alias("label"), epoch("l_shipdate").alias("start_ts"), (epoch("l_shipdate") + DAY).alias("end_ts"))
    return O.merge_windows(li, 5.0, 10 * DAY)


@query("""WITH c AS (SELECT l_orderkey AS uid, p, l_returnflag AS s FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, p DESC, l_returnflag DESC) AS i FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS p FROM lineitem)) WHERE i = 1)
 SELECT o_orderkey AS uid, CASE WHEN o_custkey % 3 = 0 THEN 'icmp' ELSE p END AS protocol, CASE WHEN o_custkey % 4 = 0 THEN 'x' ELSE s END AS service FROM orders LEFT JOIN c ON o_orderkey = uid""")
def joi07_enrich_uid(spark, sf):
    p = read(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_custkey") % 3 == 0, "icmp").otherwise("").alias("protocol"), F.when(F.col("o_custkey") % 4 == 0, "x").otherwise("").alias("service"))
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_suppkey") % 2 == 0, "tcp").otherwise("udp").alias("proto"), F.col("l_returnflag").alias("service"))
    return O.enrich_by_uid(p, c)


@query("""SELECT o_orderkey AS id, CASE o_orderpriority_ WHEN 0 THEN 'DDoS' WHEN 1 THEN 'BENIGN' WHEN 2 THEN 'Probe' WHEN 3 THEN 'BruteForce' WHEN 4 THEN 'WebAttack' WHEN 5 THEN 'OtherAttack' WHEN 6 THEN 'Botnet' ELSE 'DoS' END AS family,
 CASE WHEN o_orderpriority_ = 1 THEN 'BENIGN' ELSE 'ATTACK' END AS binary FROM (SELECT *, o_orderkey % 8 AS o_orderpriority_ FROM orders)""")
def sca15_attack_family(spark, sf):
    names = ["DDoS attack-HOIC", " Benign ", "PortScan", "FTP-Patator", "Web Attack - XSS", "Something  new", "Bot", "DoS Hulk"]
    raw = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.attack_family(raw).alias("family"), S.binary_label(raw).alias("binary"))
