"""Queries of labels and services by source, flow schemas, corpora, tabular features and memory replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators import jobs as J
from flowharbor.operators import models as M
from flowharbor.operators import profiles as P
from flowharbor.operators import replay as R
from flowharbor.operators import schema as X
from flowharbor.operators.port_clusters import entropy_rule

from .binding import SCORES, read, scores
from .metric_queries import rounded
from .profile_queries import CHUNK, GAP, TOKENS, user_rows, user_splits, user_tokens
from .registry import query


def pick(names: list, key: str):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(key) % len(names) + 1).cast("int"))


def case(names: list, key: str) -> str:
    return f"[{', '.join('NULL' if x is None else repr(x) for x in names)}][{key} % {len(names)} + 1]"


LABELS = ["SSH Brute Force", "Brute Force -Web", "xss", "Sql  Injection", "DDOS attack-HOIC", "Infiltration - Portscan", " Web Attack", "PortScan", "ssh-patator", "bruteforce", "Normal", "Heartbleed", "DoS_Hulk", "botnet ARES", "odd one"]
MERGED = ["SSH Brute Force", "WebAttack", "WebAttack", "WebAttack", "DDoS", "Infiltration", "WebAttack", "PortScan", "BruteForce", "WebAttack", "BENIGN", "Heartbleed", "DoS", "Bot", "odd one"]


@query(f"SELECT o_orderkey AS id, {case(MERGED, 'o_orderkey')} AS merged FROM orders")
def sca14_merged_label(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.merged_label(pick(LABELS, "o_orderkey")).alias("merged"))


FEEDS = ["Benign", "Bot", "DoS attacks-Hulk", "SSH-Bruteforce", "Brute Force -XSS", "Infilteration", "Other X", "DDOS attack-HOIC", ""]
METER = ["BENIGN", "Botnet", "DoS", "BruteForce", "BruteForce", "Infiltration", "Other X", "DDoS", "UNKNOWN"]
REBUILD = ["BENIGN", "Botnet", "DoS", "BruteForce", "WebAttack", "Infilteration", "Other X", "DDoS", "UNKNOWN"]
SCHEDULE = ["BENIGN", "Botnet", "DoS", "BruteForce", "WebAttack", "Infiltration", "Other X", "DDoS", "UNKNOWN"]
KINDS, FAMILIES = ["Normal", "Exploits", " Fuzzers ", "DoS", "Reconnaissance", "weird", "Worms", "Backdoor"], ["BENIGN", "Exploit", "Fuzzers", "DoS", "Probe", "OtherAttack", "Worms", "Backdoor"]


@query(f"SELECT o_orderkey AS id, {case(METER, 'o_orderkey')} AS meter, {case(REBUILD, 'o_orderkey')} AS rebuild, {case(SCHEDULE, 'o_orderkey')} AS schedule, {case(FAMILIES, 'o_orderkey')} AS categories FROM orders")
def sca16_source_family(spark, sf):
    raw = pick(FEEDS, "o_orderkey")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.source_family(raw, "flowmeter").alias("meter"), S.source_family(raw, "rebuild").alias("rebuild"), S.source_family(raw, "schedule").alias("schedule"), S.source_family(pick(KINDS, "o_orderkey"), "categories").alias("categories"))


PROTOCOLS = ["6", "17", "1", "tcp", "", "gre", "0"]


@query(f"""SELECT o_orderkey AS id, {case(['TCP', 'UDP', 'ICMP', 'TCP', 'TCP', 'GRE', '0'], 'o_orderkey')} AS log, {case(['TCP', 'UDP', '1', 'TCP', 'TCP', 'GRE', '0'], 'o_orderkey')} AS flowmeter, {case(['TCP', 'UDP', 'ICMP', 'TCP', 'OTHER', 'OTHER', 'OTHER'], 'o_orderkey')} AS token,
 {case(['tcp', 'udp', 'icmp', 'tcp', 'unknown', 'gre', '0'], 'o_orderkey')} AS lower_case FROM orders""")
def sca03_protocols(spark, sf):
    raw = pick(PROTOCOLS, "o_orderkey")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.norm_protocol(raw, "log").alias("log"), S.norm_protocol(raw, "flowmeter").alias("flowmeter"), S.norm_protocol(raw, "token").alias("token"), S.norm_protocol(raw, "lower").alias("lower_case"))


@query("SELECT o_orderkey AS id, epoch(date_trunc('day', o_orderdate)) + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + 14400.0 AS at FROM orders")
def sca08_schedule_epoch(spark, sf):
    o = read(spark, sf, "orders")
    day = F.concat(pick(["Wed-", "Thursday-", ""], "o_orderkey"), F.date_format("o_orderdate", "dd-MM-yyyy"))
    clock = F.concat_ws(":", (F.col("o_orderkey") % 24).cast("string"), (F.col("o_orderkey") % 60).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), S.schedule_epoch(day, clock).alias("at"))


@query(f"SELECT p_partkey AS id, {case(['APP_NONE', 'APP_DNS', 'APP_TLS', 'APP_OTHER', 'APP_SSH'], 'p_partkey')} AS app, {case(['STATE_NONE', 'STATE_SF', 'STATE_OTHER', 'STATE_S0', 'STATE_NONE', 'STATE_RSTR'], 'p_partkey')} AS state FROM part")
def sca25_service_tokens(spark, sf):
    apps = F.split(pick(["", "HTTP ,dns,DNS", "ssl,tls", "weird", ",ssh"], "p_partkey"), ",")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.app_token(apps).alias("app"), S.state_token(pick(["", "sf", "xx", " S0 ", None, "rstr"], "p_partkey")).alias("state"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n, l_partkey % (l_quantity::BIGINT + 1) AS c, l_quantity < 4 AS s, l_discount >= 0.09 AS p FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN s THEN 'RHY_SHORT' WHEN p THEN 'RHY_PERIODIC' WHEN c / n > 0.85 THEN 'RHY_CLIENT_BURST' WHEN n - c > 3 * c AND c <= 3 THEN 'RHY_REQ_LONGRESP' WHEN n <= 8 AND c >= n - c THEN 'RHY_SCAN_LIKE' WHEN n > 3 AND abs(2 * c - n) <= greatest(2.0, 0.2 * n) THEN 'RHY_INTERACTIVE' ELSE 'RHY_GENERIC' END AS rhythm FROM l""")
def sca26_rhythm(spark, sf):
    n = F.col("l_quantity").cast("bigint")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.rhythm(n, F.col("l_partkey") % (n + 1), F.col("l_quantity") < 4, F.col("l_discount") >= 0.09).alias("rhythm"))


@query(f"""WITH {TOKENS}, t AS (SELECT unnest(tokens) AS t FROM tk) SELECT CASE WHEN t IN ('[CLS]', '[SEP]') THEN 'special' WHEN t = 'PRIM_PROFILE_NONE' THEN 'none' WHEN starts_with(t, 'PRIM_PROFILE_') THEN 'profile' WHEN regexp_matches(t, '^PKT_(DIR|LEN|IAT)_') THEN 'packet' WHEN starts_with(t, 'FLOW_') THEN 'flow'
 WHEN starts_with(t, 'BURST_') THEN 'burst' WHEN starts_with(t, 'RHY_') THEN 'rhythm' WHEN starts_with(t, 'MATCH_') THEN 'match' ELSE 'other' END AS class, count(*) AS n FROM t GROUP BY 1""")
def sca27_token_classes(spark, sf):
    return user_tokens(spark, sf).select(F.explode("tokens").alias("t")).select(S.token_class(F.col("t")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


FLOW_LABELS, FLOW_MERGED = ["DoS Hulk", " Benign ", None, "PortScan"], ["DoS", "BENIGN", "OtherAttack", "Probe"]


@query(f"""SELECT o_orderkey::VARCHAR AS flow_id, 'mine' AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE (o_custkey % 5)::VARCHAR END AS dst_port, CASE WHEN o_orderkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto, {case(['DoS Hulk', 'Benign', 'UNKNOWN', 'PortScan'], 'o_orderkey')} AS label,
 {case(['ATTACK', 'BENIGN', 'ATTACK', 'ATTACK'], 'o_orderkey')} AS binary_label, {case(FLOW_MERGED, 'o_orderkey')} AS attack_family, {case(['Monday', 'Friday', 'unknown'], 'o_orderkey')} AS day, 3 AS packet_count, '1,0,1' AS dirs, '0.0,0.5,0.0' AS iats, concat_ws('|', '10.0.0.1', CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE (o_custkey % 5)::VARCHAR END, CASE WHEN o_orderkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END) AS service FROM orders""")
def sca18_normalize_flows(spark, sf):
    o = read(spark, sf, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("flow_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 5).alias("dst_port"), F.lit("10.0.0.1").alias("dst_ip"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("UDP").alias("protocol"), pick(FLOW_LABELS, "o_orderkey").alias("label"),
        pick(["monday-1", None, ""], "o_orderkey").alias("day"), pick(["x", "a/Friday.csv", "y"], "o_orderkey").alias("source_file"), F.expr("array('60', '70.0', '80')").alias("lens"), F.expr("array(1, 0, 2)").alias("dirs"), F.expr("array(5.0D, 5.5D, 5.25D)").alias("tss"),
    )
    out = X.normalize_flows(raw, "mine")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("flow_id", "dataset", "dst_port", "proto", "label", "binary_label", "attack_family", "day", "packet_count", joined("dirs"), joined("iats"), F.array_join("service_key", "|").alias("service"))


PORTS, STATES = ["80", "0", "443", "53", "9999"], ["con", "FIN", "weird"]
METER_SQL = f"""m AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS d, l_quantity AS f, (l_linenumber - 1)::DOUBLE AS b, l_extendedprice / 3 AS fb, l_discount * 1000 AS bb, l_tax * 1e6 AS im, l_quantity * 2 AS ps, {case(PORTS, 'l_partkey')} AS port, CASE l_suppkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'other' END AS proto,
 l_linenumber % 2 AS fin, CAST(l_linenumber = 4 AS INT) AS rst, CAST(l_quantity > 25 AS INT) AS ack, CAST(l_quantity > 10 AS INT) AS syn FROM lineitem)"""
RATE = "CASE WHEN d > 0 THEN {a} / (d / 1e6) ELSE 0 END"


@query(f"""WITH {METER_SQL} SELECT l_orderkey, l_linenumber, round(ln(1 + d / 1e6), 6) AS log_duration, round(ln(1 + fb + bb), 6) AS log_total_bytes, round(ln(1 + {RATE.format(a='(f + b)')}), 6) AS log_packet_rate, round(ln(1 + {RATE.format(a='fb')}), 6) AS log_fwd_byte_rate, round(ln(1 + im / 1e6), 6) AS log_flow_iat_mean, round(ln(1 + ps), 6) AS log_packet_length_std,
 round(CASE WHEN f > 0 THEN least(b / f, 1000) ELSE 0 END, 6) AS down_up_ratio, round(CASE WHEN fb + bb > 0 THEN fb / (fb + bb) ELSE 0 END, 6) AS fwd_byte_fraction, CAST(f + b <= 4 AS DOUBLE) AS short_flow_flag, CAST(proto = 'tcp' AS DOUBLE) AS proto_tcp, CAST(proto = 'other' AS DOUBLE) AS proto_other,
 CAST(port = '80' AS DOUBLE) AS service_http, CAST(port = '0' AS DOUBLE) AS service_none, CAST(port = '9999' AS DOUBLE) AS service_other, CAST(proto = 'tcp' AND fin > 0 AS DOUBLE) AS state_fin, CAST(proto = 'tcp' AND fin = 0 AND rst = 0 AND ack > 0 AS DOUBLE) AS state_con, CAST(proto = 'tcp' AND fin = 0 AND rst = 0 AND ack = 0 AND syn > 0 AS DOUBLE) AS state_req, CAST(proto <> 'tcp' AS DOUBLE) AS state_none FROM m""")
def sca31_meter_features(spark, sf):
    li = read(spark, sf, "lineitem")
    raw = li.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("Flow Duration"), F.col("l_quantity").alias("Total Fwd Packet"), (F.col("l_linenumber") - 1).alias("Total Bwd packets"), (F.col("l_extendedprice") / 3).alias("Total Length of Fwd Packet"), (F.col("l_discount") * 1000).alias("Total Length of Bwd Packet"),
        (F.col("l_tax") * 1e6).alias("Flow IAT Mean"), (F.col("l_quantity") * 2).alias("Packet Length Std"), pick(PORTS, "l_partkey").alias("Dst Port"), pick([6, 17, 99], "l_suppkey").alias("Protocol"), (F.col("l_linenumber") % 2).alias("FIN Flag Count"), (F.col("l_linenumber") == 4).cast("int").alias("RST Flag Count"),
        (F.col("l_quantity") > 25).cast("int").alias("ACK Flag Count"), (F.col("l_quantity") > 10).cast("int").alias("SYN Flag Count"),
    )
    out = X.shared_features(raw, "meter2017", ("l_orderkey", "l_linenumber"))
    names = "log_duration log_total_bytes log_packet_rate log_fwd_byte_rate log_flow_iat_mean log_packet_length_std down_up_ratio fwd_byte_fraction short_flow_flag proto_tcp proto_other service_http service_none service_other state_fin state_con state_req state_none".split()
    return rounded(out.select("l_orderkey", "l_linenumber", *names))


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, (l_linenumber - 1)::DOUBLE AS d, l_extendedprice / 100 AS sm, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS dm, l_tax AS took, lower({case(STATES, 'l_partkey')}) AS st, l_suppkey % 2 AS l_suppkey_ FROM lineitem), b AS (SELECT *, (sm * s + dm * d) / (s + d) AS mean FROM a)
 SELECT l_orderkey, l_linenumber, round(ln(1 + mean), 6) AS log_packet_length_mean, round(ln(1 + sqrt(greatest(0, (s * (sm - mean) ** 2 + d * (dm - mean) ** 2) / (s + d)))), 6) AS log_packet_length_std, round(ln(1 + coalesce(least(nullif(sm, 0), nullif(dm, 0)), 0)), 6) AS log_packet_length_min, round(ln(1 + greatest(sm, dm)), 6) AS log_packet_length_max,
 round(ln(1 + took / greatest(s + d - 1, 1)), 6) AS log_flow_iat_mean, CAST(l_suppkey_ = 0 AS DOUBLE) AS service_none, CAST(l_suppkey_ = 1 AS DOUBLE) AS service_ftp, CAST(st = 'fin' AS DOUBLE) AS state_fin, CAST(st = 'weird' AS DOUBLE) AS state_other FROM b""")
def sca32_argus_features(spark, sf):
    li = read(spark, sf, "lineitem")
    raw = li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("spkts"), (F.col("l_linenumber") - 1).alias("dpkts"), (F.col("l_extendedprice") / 100).alias("smean"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity")).alias("dmean"), F.col("l_tax").alias("dur"), pick(["-", "ftp-data"], "l_suppkey").alias("service"), pick(STATES, "l_partkey").alias("state"),
    )
    names = "log_packet_length_mean log_packet_length_std log_packet_length_min log_packet_length_max log_flow_iat_mean service_none service_ftp state_fin state_other".split()
    return rounded(X.shared_features(raw, "argus", ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", *names))


SEQUENCES = "sq AS (SELECT user_id, event_id, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


def sequences(spark, sf, *cols):
    e = read(spark, sf, "events").withColumn("v", F.floor("value"))
    ordered = lambda c, name: F.transform(F.sort_array(F.collect_list(F.struct("event_id", c.alias("x")))), lambda s: s["x"]).alias(name)
    return e.groupBy("user_id").agg(*[ordered(c, n) for c, n in cols])


@query(f"WITH {SEQUENCES} SELECT user_id::VARCHAR AS flow_id, coalesce(string_agg(CASE v % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '[UNK]' END, ' ' ORDER BY event_id) FILTER (event_id % 4 <> 0), '') AS tokens FROM sq GROUP BY user_id")
def src13_load_token_corpus(spark, sf):
    v = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id long")
    rows = sequences(spark, sf, (F.col("v") % 5, "input_ids"), ((F.col("event_id") % 4 != 0).cast("int"), "attention_mask")).withColumnRenamed("user_id", "flow_id")
    return X.load_token_corpus(rows, v).select("flow_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {SEQUENCES}, k AS (SELECT *, sum(v / 4.0) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM sq WHERE event_id % 3 <> 0) SELECT user_id, string_agg(v::VARCHAR, ',' ORDER BY event_id) AS lens, string_agg((CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END)::VARCHAR, ',' ORDER BY event_id) AS dirs, max(t)::DOUBLE AS last FROM k GROUP BY user_id")
def src14_array_records(spark, sf):
    v = F.col("v")
    rows = sequences(spark, sf, (F.when(v % 3 == 0, -v).otherwise(v), "packet_sizes"), (F.when(v % 2 == 0, 1).otherwise(-1), "packet_directions"), (v / 4.0, "packet_iats"), ((F.col("event_id") % 3 != 0).cast("int"), "packet_mask"))
    out = X.adapt_array_records(rows).where(F.size("lens") > 0)
    return out.select("user_id", F.array_join(F.col("lens").cast("array<string>"), ",").alias("lens"), F.array_join(F.col("dirs").cast("array<string>"), ",").alias("dirs"), F.element_at("tss", -1).alias("last"))


@query("SELECT doc_id AS flow_id, lang AS label FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40")
def src19_filter_corpus(spark, sf):
    return X.filter_corpus(read(spark, sf, "documents").select(F.col("doc_id").alias("flow_id"), F.col("lang").alias("label")), label="EN", max_rows=40)


@query("""SELECT 'customer' AS source_name, count(*) AS rows, count(c_nationkey) AS nations, 0::BIGINT AS balances FROM customer UNION ALL SELECT 'supplier', count(*), 0, count(s_acctbal) FROM supplier""")
def set01_union_sources(spark, sf):
    u = X.union_sources(customer=read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), supplier=read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))
    return u.groupBy("source_name").agg(F.count("*").alias("rows"), F.count("nation").alias("nations"), F.count("balance").alias("balances"))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IN (SELECT l_suppkey FROM lineitem)")
def set04_common_keys(spark, sf):
    return X.common_keys(read(spark, sf, "orders").select(F.col("o_custkey").alias("key")), read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key")))


@query(f"WITH {SEQUENCES} SELECT user_id AS flow_id, string_agg(v::VARCHAR, ',' ORDER BY event_id) AS lens FROM sq WHERE i <= 5 AND user_id % 3 = 0 GROUP BY user_id")
def joi19_flow_heads(spark, sf):
    flows = sequences(spark, sf, (F.col("v"), "lens")).withColumnRenamed("user_id", "flow_id")
    return X.flow_heads(flows, flows.where("flow_id % 3 = 0"), ("lens",), 5).select("flow_id", F.array_join(F.col("lens").cast("array<string>"), ",").alias("lens"))


@query("SELECT o_orderkey AS flow, coalesce(n, 0) AS n, coalesce(top, 0.0) AS top, n IS NOT NULL AS known FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS top FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def joi11_attach_profile(spark, sf):
    p = read(spark, sf, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("flow")).agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"), F.lit(True).alias("known"))
    return P.attach_profile(read(spark, sf, "orders").select(F.col("o_orderkey").alias("flow")), p)


REPLAY = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), d AS (SELECT a.vec_id AS id, a.label, b.vec_id AS mid, round(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS distance FROM e a, e b WHERE b.label < 5 AND b.vec_id % 4 <> 0 AND (a.label >= 5 OR a.vec_id % 4 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, mid) AS i FROM d), s AS (SELECT id, any_value(label) AS label, round(avg(distance), 9) AS score FROM r WHERE i <= 3 GROUP BY id), t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM s WHERE label < 5),
f AS (SELECT id, CAST(label >= 8 AS INT) AS y, CAST(id * 60.0 AS DOUBLE) AS ts, CAST(score >= threshold AS INT) AS hit, threshold FROM s, t WHERE label >= 5)"""


def replay(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    memory = e.where("label < 5 AND id % 4 <> 0").select(F.col("id").alias("mid"), "v")
    flows = e.where("label >= 5").select("id", "v", (F.col("label") >= 8).cast("int").alias("y"), (F.col("id") * 60.0).cast("double").alias("ts"))
    return R.knn_replay(flows, memory, e.where("label < 5 AND id % 4 = 0").select("id", "v"), 3, widths=(1800.0, 7200.0))


@query(f"WITH {REPLAY} SELECT id, y, hit, hit * (1 - y) AS false_alert, hit * y AS true_alert FROM f")
def str10_knn_replay(spark, sf):
    return replay(spark, sf)[0].select("id", "y", "hit", "false_alert", "true_alert")


@query(f"""WITH {REPLAY}, b AS (SELECT ts, sum(hit) OVER w1 / count(*) OVER w1 AS a, sum(hit) OVER w2 / count(*) OVER w2 AS b FROM f WHERE y = 0 WINDOW w1 AS (ORDER BY ts RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW), w2 AS (ORDER BY ts RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))
 SELECT round(max(threshold), 6) AS threshold, count(*) AS flows, sum(hit)::BIGINT AS alerts, sum(hit * (1 - y))::BIGINT AS false_alerts, sum(hit * y)::BIGINT AS true_alerts, round(coalesce(sum(hit * (1 - y)) / nullif(sum(1 - y), 0), 0), 6) AS fpr, round(coalesce(sum(hit * y) / nullif(sum(y), 0), 0), 6) AS recall, min(ts) FILTER (hit = 1) AS first_alert,
 round((SELECT max(a) FROM b), 6) AS max_fpr_1800, round((SELECT max(b) FROM b), 6) AS max_fpr_7200 FROM f""")
def str10_replay_summary(spark, sf):
    return rounded(replay(spark, sf)[1].select("threshold", "flows", "alerts", "false_alerts", "true_alerts", "fpr", "recall", "first_alert", "max_fpr_1800", "max_fpr_7200"))


@query(f"""WITH {REPLAY}, n AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS i FROM f) SELECT min(i) FILTER (y = 1) AS attack_at, min(i) FILTER (y = 1 AND hit = 1) AS alert_at, min(i) FILTER (y = 1 AND hit = 1) - min(i) FILTER (y = 1) AS delay_flows,
 min(ts) FILTER (y = 1 AND hit = 1) - min(ts) FILTER (y = 1) AS delay_s FROM n""")
def str10_alert_delay(spark, sf):
    return R.alert_delay(replay(spark, sf)[0])


@query()
def str09_memory_pollution(spark, sf):
    s = scores(spark, sf).where("split = 'test'").withColumn("value", F.col("score"))
    return rounded(J.memory_pollution(s, 7.0, 0.1, size=64, least=0.5))


@query()
def cal13_window_centroids(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return rounded(M.window_centroid_scores(e, M.window_centroids(e.where("label < 5"), 4)))


@query()
def cal13_entropy_rule(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 6).alias("port"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    return entropy_rule(e, 3).groupBy("port").agg(F.count("*").alias("rows"), F.sum("prediction").alias("suspected"))


@query()
def cal16_primitive_sensitivity(spark, sf):
    return rounded(J.primitive_sensitivity(user_rows(spark, sf), user_splits(spark, sf), [{"short": 6}, {"short": 40}], 3, max_packets=24, max_len=120, gap=GAP, chunk=CHUNK))
