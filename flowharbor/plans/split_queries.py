"""Queries of splits, samples, caps and perturbations: orders are flows labelled by status."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.operators import splits as X

from .binding import PACKETS, epoch, read, rows
from .registry import query

FL = """fl AS (SELECT o_orderkey AS flow_id, CASE o_orderstatus WHEN 'O' THEN 'BENIGN' ELSE o_orderpriority END AS label, CASE o_orderstatus WHEN 'O' THEN 'BENIGN' ELSE 'ATTACK' END AS "binary", epoch(o_orderdate) AS start_ts FROM orders)"""


def flows(spark, sf):
    b = F.col("o_orderstatus") == "O"
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("flow_id"), F.when(b, "BENIGN").otherwise(F.col("o_orderpriority")).alias("label"), F.when(b, "BENIGN").otherwise("ATTACK").alias("binary"), epoch("o_orderdate").alias("start_ts"))


def cut_sql(order: str, by: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER ({by} ORDER BY {order}) AS r, count(*) OVER ({by}) AS n FROM fl), t AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.2, 0), n - 2)) ELSE 0 END AS t FROM r),
 v AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.1, 0), n - t - 1)) ELSE 0 END AS v FROM t) SELECT flow_id, label, CASE WHEN r <= n - v - t THEN 'train' WHEN r <= n - t THEN 'val' ELSE 'test' END AS split FROM v"""


@query(f"WITH {FL}, r AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY sha1('7|pick|' || flow_id), flow_id) AS rank FROM fl) SELECT flow_id, label, rank::INTEGER AS rank FROM r WHERE rank <= 100")
def top01_lowest_hash(spark, sf):
    return X.lowest_hash(flows(spark, sf), 100, 7, "pick", ["label"]).select("flow_id", "label", "rank")


@query(f"WITH {FL}, r AS (SELECT flow_id, row_number() OVER (ORDER BY sha1('42|loo|' || flow_id), flow_id) AS r FROM fl WHERE label = 'BENIGN') SELECT flow_id, CASE WHEN r <= 2000 THEN 'train' WHEN r <= 2500 THEN 'val' ELSE 'test' END AS split FROM r WHERE r <= 3000 UNION ALL SELECT flow_id, 'test' FROM fl WHERE label = '1-URGENT'")
def top02_leave_one_out(spark, sf):
    return X.leave_one_out(flows(spark, sf), "1-URGENT", 42, 2000, 500, 500)


@query(f"WITH {FL}, {cut_sql('''sha1('42||' || flow_id), flow_id''', 'PARTITION BY label')}")
def top03_stratified_split(spark, sf):
    return X.make_split(flows(spark, sf), "stratified")


@query(f"WITH {FL}, {cut_sql('start_ts, flow_id', '')}")
def top03_temporal_split(spark, sf):
    return X.make_split(flows(spark, sf), "temporal")


@query(f"WITH {FL}, {cut_sql('start_ts, flow_id', 'PARTITION BY label')}")
def top03_temporal_stratified_split(spark, sf):
    return X.make_split(flows(spark, sf), "temporal_stratified")


@query("SELECT o_custkey AS flow_id, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def top05_validate_split(spark, sf):
    return X.validate_split(read(spark, sf, "orders").select(F.col("o_custkey").alias("flow_id"), F.col("o_orderstatus").alias("split")))


@query("SELECT split, label, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus AS split FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority || (o_custkey % 300) AS label FROM orders) b LEFT JOIN orders ON o_orderstatus = split AND o_orderpriority || (o_custkey % 300) = label GROUP BY split, label")
def agg07_split_coverage(spark, sf):
    return X.split_coverage(read(spark, sf, "orders").select(F.col("o_orderstatus").alias("split"), F.concat("o_orderpriority", F.col("o_custkey") % 300).alias("label")))


@query(f"""WITH {FL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42|cap|' || flow_id), flow_id) AS r FROM fl), t AS (SELECT *, row_number() OVER (PARTITION BY "binary" ORDER BY r, label) AS turn FROM r WHERE r <= 400)
 SELECT flow_id, label, "binary" FROM t WHERE turn <= 900""")
def top06_cap_flows(spark, sf):
    return X.cap_flows(flows(spark, sf), 400, 900).select("flow_id", "label", "binary")


@query(f"WITH {FL} SELECT flow_id, label, start_ts FROM (SELECT *, row_number() OVER (PARTITION BY label, start_ts ORDER BY flow_id) AS i FROM fl) WHERE i = 1")
def top07_dedupe(spark, sf):
    return X.dedupe(flows(spark, sf), ["label", "start_ts"], ["flow_id"]).select("flow_id", "label", "start_ts")


@query(f"WITH {FL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42|fraction|' || flow_id), flow_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM fl) SELECT flow_id, label FROM r WHERE r <= ceil(n * 0.15)")
def top09_sample_fraction(spark, sf):
    return X.sample_fraction(flows(spark, sf), 0.15, ["label"]).select("flow_id", "label")


SUMS = "s AS (SELECT 'p' || (l_suppkey % 30) AS policy, l_linenumber AS panel, round(avg(l_discount), 9) AS fpr, round(avg(l_quantity) / 50, 9) AS recall FROM lineitem GROUP BY ALL)"


def summaries(spark, sf):
    li = read(spark, sf, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_suppkey") % 30).alias("policy"), F.col("l_linenumber").alias("panel"))
    return li.agg(F.round(F.avg("l_discount"), 9).alias("fpr"), F.round(F.avg("l_quantity") / 50, 9).alias("recall"))


@query(f"WITH {SUMS}, w AS (SELECT policy, min(recall) AS recall, max(fpr) AS fpr, count(*) AS panels FROM s GROUP BY policy) SELECT * FROM w WHERE fpr <= 0.053 AND recall >= 0.4 ORDER BY recall DESC, fpr, policy LIMIT 1")
def top14_select_policy(spark, sf):
    return X.select_policy(X.worst_panel(summaries(spark, sf)), 0.053, 0.4)


@query("SELECT flow_id, service, rank::INTEGER AS rank FROM (SELECT l_orderkey * 10 + l_linenumber AS flow_id, l_suppkey AS service, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem WHERE l_returnflag = 'R') WHERE rank <= 5")
def top15_lowest_attacks(spark, sf):
    li = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flow_id"), F.col("l_suppkey").alias("service"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("score"))
    return X.lowest_attacks(li, 5, ["service"]).select("flow_id", "service", "rank")


@query(f"WITH {PACKETS} SELECT flow, seq, CAST((len + 127) // 128 * 128 AS INTEGER) AS len FROM rows")
def aug02_length_align(spark, sf):
    return X.perturb(rows(spark, sf), "length_align", 0.5).select("flow", "seq", "len")


GAPS = f"{PACKETS}, g AS (SELECT *, greatest(ts - lag(ts) OVER w, 1e-6) AS gap, min(ts) OVER (PARTITION BY flow) AS f, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY flow) AS n FROM rows WINDOW w AS (PARTITION BY flow ORDER BY ts, seq))"


@query(f"""WITH {GAPS}, m AS (SELECT flow, any_value(n) AS n, any_value(f) AS f, greatest(coalesce(quantile_cont(gap, 0.5), 1.0), 1e-3) * 11.0 AS pace, greatest(2.0, round_even(any_value(n) * 0.5, 0)) AS want FROM g GROUP BY flow),
 k AS (SELECT flow, unnest(range(0, CAST(want AS BIGINT))) AS j, n, f, pace, want FROM m WHERE want < n AND length(flow) % 2 = 0) SELECT g.flow, seq, round(k.f + j * pace, 3) AS ts FROM k JOIN g ON g.flow = k.flow AND g.i = floor(j * (k.n - 1) / (want - 1))
 UNION ALL SELECT g.flow, seq, round(ts, 3) FROM g JOIN m ON g.flow = m.flow WHERE want >= m.n OR length(g.flow) % 2 = 1""")
def aug04_low_rate(spark, sf):
    r = rows(spark, sf).withColumn("attack", F.length("flow") % 2 == 0)
    return X.perturb(r, "low_rate_c2", 0.5).select("flow", "seq", F.round("ts", 3).alias("ts"))


@query(f"""WITH {GAPS}, c AS (SELECT flow, quantile_cont(gap, 0.25) AS lo, quantile_cont(gap, 0.75) AS hi FROM g GROUP BY flow), t AS (SELECT g.flow, g.seq, g.ts, g.f, CASE WHEN gap <= lo THEN gap * 4.0 ELSE gap END AS s, CASE WHEN gap >= hi THEN greatest(gap * 0.7, 1e-6) ELSE gap END AS m FROM g JOIN c ON g.flow = c.flow)
 SELECT 'burst_split' AS mode, flow, seq, round(f + sum(coalesce(s, 0.0)) OVER w, 3) AS ts FROM t WINDOW w AS (PARTITION BY flow ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 'burst_merge', flow, seq, round(f + sum(coalesce(m, 0.0)) OVER w, 3) FROM t WINDOW w AS (PARTITION BY flow ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""")
def aug03_bursts(spark, sf):
    one = lambda mode: X.perturb(rows(spark, sf), mode, 0.3).select(F.lit(mode).alias("mode"), "flow", "seq", F.round("ts", 3).alias("ts"))
    return one("burst_split").unionByName(one("burst_merge"))


@query()
def aug05_short_flow_delete(spark, sf):
    r = X.perturb(rows(spark, sf), "short_flow_delete", 0.4)
    return r.groupBy("flow").agg(F.count("*").alias("n"))


@query()
def aug06_perturb_panel(spark, sf):
    p = X.perturb_panel(rows(spark, sf), ["packet_delete", "packet_insert", "direction_flip", "length_padding", "delay_stretch", "iat_jitter"], [0.1, 0.3])
    return p.groupBy("mode", "strength").agg(F.count("*").alias("packets"), F.count_distinct("flow").alias("flows"), F.sum("len").alias("bytes"), F.sum("dir").alias("up"))
