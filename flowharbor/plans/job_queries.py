"""Queries of jobs and of the smaller operators that they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.operators import flows as O
from flowharbor.operators import jobs as J
from flowharbor.operators import memory as K
from flowharbor.operators import tokens as T

from .binding import DOCS, PACKETS, flow_rows, packets, pair_counts, read, rows, token_counts, token_rows
from .flow_queries import flow_key
from .memory_queries import KNOWN, query_ids, sparse
from .metric_queries import COUNTS, RATES, rounded
from .registry import query
from .split_queries import FL, flows
from .window_queries import EV, events


@query("""SELECT p_partkey, p_type FROM (SELECT p_partkey, 'T' || (p_partkey % 7) || '_' || p_partkey % 3 AS p_type FROM part) WHERE (p_type LIKE 'T1%' OR p_type LIKE 'T_@_0' ESCAPE '@') AND NOT p_type LIKE '%@_1' ESCAPE '@'""")
def sca34_glob_filter(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("T"), F.col("p_partkey") % 7, F.lit("_"), F.col("p_partkey") % 3).alias("p_type"))
    return J.glob_filter(p, "p_type", ["T1*", "T?_0"], ["*_1"])


@query(f"""WITH {PACKETS}, f AS (SELECT flow, count(*) AS n, max(ts) - min(ts) AS d, max(dir) <> min(dir) AS b FROM rows GROUP BY flow) SELECT CASE WHEN n <= 2 THEN 'tiny' WHEN NOT b THEN 'one_way' WHEN n < 6 AND d < 1 THEN 'short' WHEN n >= 100 THEN 'bulk' ELSE 'regular' END AS stratum,
 count(*) AS flows, count(*) FILTER (n >= 3) AS min3, count(*) FILTER (b) AS two_way, count(*) FILTER (n >= 6 AND b) AS strict FROM f GROUP BY 1""")
def sca36_strata(spark, sf):
    f = rows(spark, sf).groupBy("flow").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("d"), (F.max("dir") != F.min("dir")).alias("b"))
    n, b = F.col("n"), F.col("b")
    return f.groupBy(J.stratum(n, F.col("d"), b).alias("stratum")).agg(F.count("*").alias("flows"), *[F.count_if(J.gate_keep(n, b, g)).alias(g) for g in ("min3", "two_way", "strict")])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 'BENIGN' WHEN l_quantity > 25 THEN 'A' WHEN l_quantity = 25 THEN 'A' ELSE 'B' END AS label FROM lineitem")
def sca39_gated_class(spark, sf):
    m = F.create_map(F.lit("BENIGN"), F.lit(9.0), F.lit("B"), 50 - F.col("l_quantity"), F.lit("A"), F.col("l_quantity"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", J.gated_class(m, F.col("l_discount"), 0.05).alias("label"))


@query()
def sca41_flow_fingerprint(spark, sf):
    f = O.aggregate_packets(packets(spark, sf))
    return f.select(flow_key().alias("flow"), J.flow_fingerprint(F.col("start_ts"), F.col("lens"), F.col("dirs"), 4).alias("print"))


@query(f"WITH {PACKETS} SELECT flow, round(list_sum(list_transform(list(len ORDER BY ts, seq)[1:6], lambda x: least(1.0, x / 1500.0))), 6) AS total, 6 AS size FROM rows GROUP BY flow")
def sca44_length_vector(spark, sf):
    f = O.aggregate_packets(packets(spark, sf)).select(flow_key().alias("flow"), J.length_vector(F.col("flow_id"), F.col("lens"), 6).alias("v"))
    return rounded(f.select("flow", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("v").alias("size")))


@query(f"""WITH {PACKETS}, p AS (SELECT protocol AS label, flow, seq FROM rows), f AS (SELECT label, flow, row_number() OVER (PARTITION BY label ORDER BY min(seq)) AS r FROM p GROUP BY label, flow)
 SELECT label, flow, seq FROM (SELECT p.*, row_number() OVER (PARTITION BY p.label, p.flow ORDER BY seq) AS i FROM p JOIN f USING (label, flow) WHERE r <= 50) WHERE i <= 2""")
def agg02_capped_flows(spark, sf):
    return J.capped_flows(rows(spark, sf).select(F.element_at(F.split("flow", r"\|"), -1).alias("label"), "flow", "seq"), 50, 2)


@query(f"""WITH {DOCS}, g AS (SELECT flow_id, split, token || '+' || lead(token) OVER (PARTITION BY flow_id ORDER BY pos) AS gram FROM tok), b AS (SELECT flow_id, split, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL), k AS (SELECT gram FROM b WHERE split = 'train' GROUP BY gram HAVING count(*) >= 10)
 SELECT flow_id, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY n DESC, gram) AS r FROM b WHERE gram IN (SELECT gram FROM k)) WHERE r <= 8""")
def agg18_augment_sequences(spark, sf):
    return J.augment_sequences(token_rows(spark, sf, True), 10, 8, pair_counts(spark, sf)).select("flow_id", "gram", "n")


@query(f"WITH {FL}, r AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY sha1('42|reservoir|' || flow_id), flow_id) AS r FROM fl) SELECT flow_id, label FROM r WHERE (label = 'BENIGN' AND r <= 70) OR (label = '1-URGENT' AND r <= 30)")
def top08_reservoir(spark, sf):
    return J.reservoir(flows(spark, sf), "label", {"BENIGN": 70, "1-URGENT": 30}).select("flow_id", "label")


@query(f"WITH {FL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY start_ts, flow_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM fl) SELECT flow_id, CASE WHEN r <= n - floor(n * 0.25) - floor(n * 0.15) THEN 'train' WHEN r <= n - floor(n * 0.25) THEN 'val' ELSE 'test' END AS split FROM r")
def top04_trainer_split(spark, sf):
    return J.trainer_split(flows(spark, sf), ["label"], 0.15, 0.25)


@query("""WITH g AS (SELECT o_orderkey AS id, o_orderpriority AS pool, o_orderdate AS ts FROM orders WHERE o_totalprice < 200000), r AS (SELECT id, percent_rank() OVER (PARTITION BY pool ORDER BY ts, id) AS r FROM g) SELECT id, CASE WHEN r < 0.6 THEN 'memory' WHEN r < 0.8 THEN 'calibration' ELSE 'tail' END AS part FROM r""")
def top13_pool_split(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pool"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_totalprice") < 200000, "admit").otherwise("x").alias("admission"))
    return J.pool_split(o, 0.6, 0.2)


@query(f"""WITH {DOCS}, d AS (SELECT DISTINCT flow_id, split, token FROM tok), w AS (SELECT flow_id, token, CASE WHEN token LIKE 't%' THEN 0.5 ELSE 1 END AS w FROM d WHERE token IN (SELECT token FROM d WHERE split = 'train')) SELECT flow_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY flow_id)), 6) AS w FROM w""")
def cal07_token_weight_scheme(spark, sf):
    w = T.token_weights(token_rows(spark, sf, True), "binary", "none").select("flow_id", "token", "w")
    return rounded(J.token_weight_scheme(w, "groups", {"t": 0.5}))


ALLQ = KNOWN.replace("qq AS (SELECT flow_id AS id, token, w FROM w WHERE split = 'test')", "qq AS (SELECT flow_id AS id, token, w FROM w WHERE split <> 'train')")


@query(f"""WITH {ALLQ}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, mid) AS i FROM dots), b AS (SELECT id, sum(1 - dot) AS d, count(*) AS met FROM r WHERE i <= 3 GROUP BY id),
 s AS (SELECT id, round((coalesce(b.d, 0) + 3 - coalesce(met, 0)) / 3, 9) AS score, CAST(label = 'ATTACK' AS INT) AS y, split FROM (SELECT flow_id AS id, label, split FROM docs WHERE split <> 'train' AND label <> 'UNLABELLED') x LEFT JOIN b USING (id)),
 t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM s WHERE split = 'val' AND y = 0), c AS (SELECT 99.0::DOUBLE AS percentile, threshold, {COUNTS.format(t="threshold")} FROM s, t WHERE split = 'test' GROUP BY threshold)
 SELECT percentile, round(threshold, 6) AS threshold, tp, fp, tn, fn, {RATES} FROM c""")
def cal15_leave_one_job(spark, sf):
    return rounded(J.leave_one_job(token_rows(spark, sf), 3, flows=flow_rows(spark, sf).where("label <> 'UNLABELLED'"), counts=token_counts(spark, sf)))


@query()
def cal10_memory_scaling(spark, sf):
    return rounded(J.memory_scaling(*sparse(spark, sf), [20, 100], 3, query_ids(spark, sf)))


@query()
def cal11_sweep(spark, sf):
    return rounded(J.sweep(token_rows(spark, sf), ["binary", "tfidf"], [1, 3], flow_rows(spark, sf), token_counts(spark, sf)))


@query(f"WITH {EV} SELECT label, count(*) AS flows, count(*) FILTER (hit = 1) AS alerts, count(*) FILTER (hit = 1 AND y = 0) AS false_alerts, count(*) FILTER (hit = 1 AND y = 1) AS true_alerts, min(ts) AS first, max(ts) AS last FROM ev GROUP BY ROLLUP (label)")
def str11_replay_summary(spark, sf):
    return J.replay_summary(events(spark, sf))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY ts, flow_id) AS pos FROM ev), s AS (SELECT score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM r WHERE pos <= 2000 GROUP BY score), t AS (SELECT sum(p)::BIGINT AS p_, sum(n)::BIGINT AS n_, max(score) AS top FROM s),
 q AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS fp FROM s UNION ALL SELECT top + 1e-12, 0, 0 FROM t), c AS (SELECT threshold, tp, fp, n_ - fp AS tn, p_ - tp AS fn FROM q, t)
 SELECT *, {RATES} FROM c ORDER BY (2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) DESC, threshold DESC LIMIT 1""")
def str12_calibrate(spark, sf):
    return rounded(J.calibrate(events(spark, sf), 2000)[0])


@query("WITH n AS (SELECT ceil(count(*) * 0.05) AS want FROM orders WHERE o_orderstatus = 'O'), a AS (SELECT o_orderkey AS mid, row_number() OVER (ORDER BY sha1('43|pollution|' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey AS mid, 0 AS polluted FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT mid, 1 FROM a, n WHERE r <= want")
def str09_pollution(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("mid"), "o_orderstatus")
    return J.pollution(o.where("o_orderstatus = 'O'").select("mid"), o.where("o_orderstatus = 'F'").select("mid"), 0.05)


@query()
def aug05_insert_benign(spark, sf):
    e = events(spark, sf).select("flow_id", "ts", "y")
    return J.insert_benign(e.where("y = 1"), e.where("y = 0"), 0.2, 60.0).groupBy("inserted").agg(F.count("*").alias("n"))


@query(f"""WITH {KNOWN}, nb AS (SELECT id, mid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, mid) AS r FROM dots) WHERE r <= 2), s AS (SELECT DISTINCT flow_id, token FROM d)
 SELECT id, mid, (SELECT count(*) FROM s WHERE flow_id = id AND token NOT IN (SELECT token FROM s z WHERE z.flow_id = mid))::INTEGER AS alert_only, (SELECT count(*) FROM s WHERE flow_id = mid AND token NOT IN (SELECT token FROM s z WHERE z.flow_id = id))::INTEGER AS neighbour_only,
 (SELECT count(*) FROM s WHERE flow_id = id AND token IN (SELECT token FROM s z WHERE z.flow_id = mid))::INTEGER AS shared FROM nb""")
def joi18_motif_contrast(spark, sf):
    q, m = sparse(spark, sf)
    near = K.nearest_sparse(q, m, 2).select("id", "mid")
    return J.motif_contrast(q.select("id"), near, token_rows(spark, sf))
