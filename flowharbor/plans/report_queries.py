"""Queries of attachments, audits and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.operators import reports as R

from .binding import DOCS, PACKETS, SCORES, read, rows, scores, token_rows
from .label_queries import DAY, FLOWS, LABELS, flows, label_rows
from .metric_queries import rounded
from .registry import query


@query(f"WITH {FLOWS}, {LABELS} SELECT count(*) AS scanned, count(*) FILTER (key IN (SELECT key FROM flows WHERE key % 3 = 0)) AS retained, count(*) FILTER (key NOT IN (SELECT key FROM flows WHERE key % 3 = 0)) AS dropped FROM lab")
def joi03_align_streaming(spark, sf):
    return R.align_streaming(label_rows(spark, sf), flows(spark, sf).where("key % 3 = 0"))[1]


@query("SELECT o_orderkey AS flow_id, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END, c_mktsegment) AS status FROM orders LEFT JOIN (SELECT c_custkey, 'seg' || (c_custkey % 5) AS c_mktsegment FROM customer) ON o_orderkey = c_custkey")
def joi12_fill_metadata(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("flow_id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("flow_id"), F.concat(F.lit("seg"), F.col("c_custkey") % 5).alias("status"))
    return R.fill_metadata(o, c, ["status"])[0]


@query("""WITH p AS (SELECT l_returnflag AS t, CASE WHEN l_linenumber % 3 = 0 THEN 'A' WHEN l_linenumber % 3 = 1 THEN 'N' ELSE 'R' END AS p, l_linestatus, l_quantity FROM lineitem)
 SELECT t AS "true", p AS pred, l_linestatus, count(*) AS n, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM p WHERE t <> p GROUP BY ALL""")
def agg32_error_analysis(spark, sf):
    m = F.col("l_linenumber") % 3
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("true"), F.when(m == 0, "A").when(m == 1, "N").otherwise("R").alias("pred"), "l_linestatus", "l_quantity")
    return R.error_analysis(li, "l_linestatus", "l_quantity")


@query("""WITH b AS (SELECT l_returnflag AS family, l_linestatus AS period, 'q' || CAST(floor(l_quantity) AS BIGINT) % 13 AS shape, count(*) AS n FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY family, period ORDER BY n DESC, shape) AS rank, sum(n) OVER (PARTITION BY family, period)::BIGINT AS flows, count(*) OVER (PARTITION BY family, period) AS shapes FROM b)
 SELECT family, period, flows, shapes, rank::INTEGER AS rank, shape, n, round(n / flows, 6) AS share FROM r WHERE rank <= 3""")
def agg34_label_window_audit(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("period"), F.concat(F.lit("q"), F.floor("l_quantity") % 13).alias("shape"))
    return rounded(R.label_window_audit(li, 3))


EP = "ep AS (SELECT o_orderkey AS flow_id, o_custkey % 97 AS src, o_orderkey % 89 AS dst, o_orderpriority AS service FROM orders), tr AS (SELECT * FROM ep WHERE flow_id % 3 = 0)"


@query(f"""WITH {EP}, s AS (SELECT src, count(*) AS a, count(DISTINCT dst) AS b FROM tr GROUP BY src), d AS (SELECT dst, count(*) AS a, count(DISTINCT src) AS b FROM tr GROUP BY dst), p AS (SELECT src, dst, count(*) AS a FROM tr GROUP BY ALL),
 v AS (SELECT service, count(*) AS a FROM tr GROUP BY service), n AS (SELECT count(*) AS t, count(DISTINCT service) AS k FROM tr)
 SELECT flow_id, coalesce(s.a, 0) AS src_degree, coalesce(s.b, 0) AS src_partners, coalesce(d.a, 0) AS dst_degree, coalesce(d.b, 0) AS dst_partners, coalesce(p.a, 0) AS pair_degree, round(-ln((coalesce(v.a, 0) + 1) / (t + k)), 6) AS service_surprise,
 CAST(s.a IS NULL AS INTEGER) AS new_src, CAST(p.a IS NULL AS INTEGER) AS new_pair FROM ep LEFT JOIN s USING (src) LEFT JOIN d USING (dst) LEFT JOIN p ON ep.src = p.src AND ep.dst = p.dst LEFT JOIN v ON ep.service = v.service, n""")
def agg36_endpoint_features(spark, sf):
    e = read(spark, sf, "orders").select(F.col("o_orderkey").alias("flow_id"), (F.col("o_custkey") % 97).alias("src"), (F.col("o_orderkey") % 89).alias("dst"), F.col("o_orderpriority").alias("service"))
    return rounded(R.endpoint_features(e.where("flow_id % 3 = 0"), e))


@query(f"""WITH {SCORES}, u AS (SELECT flow_id, y, l_extendedprice AS score FROM (SELECT l_orderkey * 10 + l_linenumber AS flow_id, CAST(l_returnflag = 'R' AS INT) AS y, l_extendedprice FROM lineitem))
 SELECT 'top_tp' AS "case", flow_id, score FROM (SELECT * FROM u WHERE score >= 30000 AND y = 1 ORDER BY score DESC, flow_id LIMIT 1) UNION ALL SELECT 'border_tp', flow_id, score FROM (SELECT * FROM u WHERE score >= 30000 AND y = 1 ORDER BY score, flow_id LIMIT 1)
 UNION ALL SELECT 'worst_fp', flow_id, score FROM (SELECT * FROM u WHERE score >= 30000 AND y = 0 ORDER BY score DESC, flow_id LIMIT 1) UNION ALL SELECT 'safest_tn', flow_id, score FROM (SELECT * FROM u WHERE score < 30000 AND y = 0 ORDER BY score, flow_id LIMIT 1)""")
def agg44_select_cases(spark, sf):
    u = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flow_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("score"))
    return R.select_cases(u, 30000.0)


@query(f"""WITH {FLOWS}, {LABELS}, n AS (SELECT count(*) AS n FROM flows) SELECT 'f' || (label_id % 10) AS source_file, count(DISTINCT CASE WHEN ts >= start_ts - 17280000 AND ts <= end_ts + 17280000 THEN flow_id END) AS matched,
 count(DISTINCT CASE WHEN ts >= start_ts - 17280000 AND ts <= end_ts + 17280000 THEN flow_id END) / any_value(n) AS match_rate FROM lab LEFT JOIN flows USING (key), n GROUP BY 1""")
def agg46_audit_label_sources(spark, sf):
    lab = label_rows(spark, sf).withColumn("source_file", F.concat(F.lit("f"), F.col("label_id") % 10))
    return R.audit_label_sources(flows(spark, sf), lab, 200 * DAY)


@query("SELECT o_orderpriority AS day, count(*) AS flows, count(*) FILTER (o_orderstatus <> 'P') AS matched, round(count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS match_rate FROM orders GROUP BY ROLLUP (o_orderpriority)")
def agg47_extraction_summary(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("day"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"))
    return rounded(R.extraction_summary(o))


@query("SELECT 'all' AS scope, count(*) AS runs, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'without', count(*), round(avg(l_quantity), 6) FROM lineitem WHERE l_returnflag <> 'R'")
def agg29_with_without(spark, sf):
    return rounded(R.with_without(read(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "R"))


@query(f"""WITH {PACKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts, seq) AS i, row_number() OVER (PARTITION BY flow ORDER BY ts DESC, seq DESC) AS j FROM rows), k AS (SELECT *, CASE WHEN i <= 2 THEN 0 WHEN j <= 1 THEN 1 WHEN len > 1000 THEN 2 ELSE 3 END AS kind FROM r)
 SELECT flow, seq, kind FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY kind, i) AS nth FROM k WHERE kind < 3) WHERE nth <= 4""")
def top10_select_packets(spark, sf):
    return R.select_packets(rows(spark, sf).withColumn("tagged", (F.col("len") > 1000).cast("int")), 4).select("flow", "seq", "kind")


TRIG = f"{DOCS}, tr AS (SELECT flow_id, substr(token, 1, 1) AS family FROM tok), fl AS (SELECT DISTINCT flow_id, label FROM tok)"


@query(f"""WITH {TRIG}, b AS (SELECT t.flow_id, family, label, count(*) AS n FROM tr t JOIN fl USING (flow_id) GROUP BY ALL), n AS (SELECT label, count(*) AS flows FROM fl GROUP BY label UNION ALL SELECT NULL, count(*) FROM fl),
 s AS (SELECT family, label, count(*) AS fired, avg(n) AS mean_count FROM b GROUP BY GROUPING SETS ((family, label), (family))) SELECT family, s.label, fired, round(mean_count, 6) AS mean_count, round(fired / flows, 6) AS rate FROM s JOIN n ON s.label IS NOT DISTINCT FROM n.label""")
def agg21_primitive_scale(spark, sf):
    t = token_rows(spark, sf)
    return rounded(R.primitive_scale(t.select("flow_id", F.substring("token", 1, 1).alias("family")), t.select("flow_id", "label").distinct()))


@query(f"WITH {TRIG}, a AS (SELECT flow_id FROM fl WHERE label = 'ATTACK') SELECT family, count(DISTINCT flow_id) AS explained, (SELECT count(*) FROM a) AS alerts, round(count(DISTINCT flow_id) / (SELECT count(*) FROM a), 6) AS coverage FROM tr WHERE flow_id IN (SELECT flow_id FROM a) GROUP BY family")
def agg22_explanation_coverage(spark, sf):
    t = token_rows(spark, sf)
    return rounded(R.explanation_coverage(t.where("label = 'ATTACK'").select("flow_id").distinct(), t.select("flow_id", F.substring("token", 1, 1).alias("family"))))


@query("""WITH f AS (SELECT event_id, event_type AS port, user_id % 10 AS src, user_id % 37 AS dst, (row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) - 1) // 16 AS block FROM events), b AS (SELECT port, src, block, dst, count(*) AS c FROM f GROUP BY ALL)
 SELECT port, src, block, sum(c)::BIGINT AS n, round(count(*) / sum(c), 6) AS distinct_ratio, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy FROM b GROUP BY port, src, block""")
def agg37_diversity_windows(spark, sf):
    u = F.col("user_id")
    e = read(spark, sf, "events").select(F.col("event_id").alias("flow_id"), "ts", F.col("event_type").alias("port"), (u % 10).alias("src"), (u % 37).alias("dst"))
    return rounded(R.diversity_windows(e, 16))


@query("""WITH t AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS d FROM lineitem WHERE l_orderkey % 2 = 0)
 SELECT l_orderkey, l_linenumber, round(greatest(-1.5, least(1.5, (l_quantity - a) / b)), 6) AS l_quantity, round(greatest(-1.5, least(1.5, (l_extendedprice - c) / d)), 6) AS l_extendedprice FROM lineitem, t""")
def sca46_standardize(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(R.standardize(li.where("l_orderkey % 2 = 0"), li, ["l_quantity", "l_extendedprice"], 1.5))


@query(f"""WITH {PACKETS}, h AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts, seq) - 1 AS t FROM rows), a AS (SELECT flow, bin, sum(len * cos(2 * pi() * t * bin / 16)) AS re, sum(len * sin(2 * pi() * t * bin / 16)) AS im FROM h, range(0, 5) b(bin) WHERE t < 16 GROUP BY flow, bin)
 SELECT flow, bin::INTEGER AS bin, round(sqrt(re * re + im * im), 4) AS magnitude FROM a""")
def sca45_spectrum(spark, sf):
    return rounded(R.spectrum(rows(spark, sf), 16, 5), 4)


@query()
def top12_k_center(spark, sf):
    return R.k_center(read(spark, sf, "embeddings").select(F.col("vec_id").alias("mid"), F.col("embedding").alias("v")), 6)


@query(f"""WITH {SCORES}, d AS (SELECT rep, score, row_number() OVER (PARTITION BY rep ORDER BY sha1('42|' || rep || '|' || flow_id), flow_id, score) AS r FROM scores, range(1, 6) x(rep) WHERE split = 'val' AND y = 0),
 c AS (SELECT size, rep, quantile_cont(score, 0.99) AS threshold FROM d, (VALUES (25), (400)) v(size) WHERE r <= size GROUP BY size, rep), f AS (SELECT size, rep, threshold, (SELECT count(*) FILTER (score >= threshold) / count(*) FROM scores WHERE split = 'test' AND y = 0) AS fpr FROM c)
 SELECT size, round(avg(threshold), 6) AS mean_threshold, round(stddev_pop(threshold), 6) AS std_threshold, round(avg(fpr), 6) AS mean_fpr, round(max(fpr), 6) AS max_fpr FROM f GROUP BY size""")
def cal06_calibration_stability(spark, sf):
    s = scores(spark, sf)
    return rounded(R.calibration_stability(s.where("split = 'val'"), s.where("split = 'test'"), [25, 400], 5))
