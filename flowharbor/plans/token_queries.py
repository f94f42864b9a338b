"""Queries of token corpora: document words, train/val/test by id, quality labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators import tokens as T
from flowharbor.operators.staging import staged

from .binding import DOCS, flow_rows, read, token_rows
from .metric_queries import rounded
from .registry import query

COUNTS = f"{DOCS}, cnt AS (SELECT flow_id, split, label, token, count(*) AS n FROM tok GROUP BY ALL), nt AS (SELECT count(DISTINCT flow_id) AS n_ FROM cnt WHERE split = 'train')"
SUPPORT = f"{COUNTS}, sup AS (SELECT token, count(*) AS flows, sum(n)::BIGINT AS occurrences, count(*) / any_value(n_) AS support FROM cnt, nt WHERE split = 'train' GROUP BY token)"


@query(f"""WITH {COUNTS}, idf AS (SELECT token, ln((1 + any_value(n_)) / (1 + count(*))) + 1 AS idf FROM cnt, nt WHERE split = 'train' GROUP BY token), r AS (SELECT flow_id, token, n * idf AS w FROM cnt JOIN idf USING (token))
 SELECT flow_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY flow_id)), 6) AS w FROM r""")
def agg08_token_weights(spark, sf):
    return rounded(T.token_weights(token_rows(spark, sf, True)).select("flow_id", "token", "w"))


@query(f"""WITH {DOCS}, f AS (SELECT token, min((flow_id, pos)) AS at_ FROM tok WHERE split = 'train' GROUP BY token) SELECT token, row_number() OVER (ORDER BY at_) + 3 AS id FROM f
 UNION ALL SELECT * FROM (VALUES ('[PAD]', 0::BIGINT), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3))""")
def agg09_fit_vocab(spark, sf):
    return T.fit_vocab(token_rows(spark, sf))


@query(f"WITH {DOCS} SELECT split, count(*) AS tokens, round(avg(CAST(token NOT IN (SELECT token FROM tok WHERE split = 'train') AS DOUBLE)), 6) AS unk_rate FROM tok GROUP BY split")
def agg09_unk_rate(spark, sf):
    t = token_rows(spark, sf)
    return rounded(T.unk_rate(t, T.fit_vocab(t)))


@query(f"""WITH {DOCS}, b AS (SELECT split, flow_id, count(*) AS n FROM tok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n, flow_id) AS i, count(*) OVER (PARTITION BY split) AS m FROM b)
 SELECT split, count(*) AS flows, round(avg(n), 6) AS mean, max(n) FILTER (i = round_even(0.5 * (m - 1), 0) + 1) AS p50, max(n) FILTER (i = round_even(0.95 * (m - 1), 0) + 1) AS p95, round(avg(CAST(n > 500 AS DOUBLE)), 6) AS truncated FROM r GROUP BY split""")
def agg11_token_stats(spark, sf):
    return rounded(T.token_stats(token_rows(spark, sf), 500))


@query(f"WITH {SUPPORT} SELECT token, flows, occurrences, round(support, 6) AS support, round(ln(1 + occurrences) / ln(1 + max(occurrences) OVER ()), 6) AS coverage FROM sup")
def agg12_agg14_motif_support(spark, sf):
    return rounded(T.motif_support(token_rows(spark, sf)))


@query()
def agg13_motif_stability(spark, sf):
    return rounded(T.motif_stability(token_rows(spark, sf)))


@query(f"""WITH {DOCS}, sc AS (SELECT flow_id, length(text)::DOUBLE AS score FROM docs WHERE split = 'val' AND label = 'BENIGN'), q AS (SELECT quantile_cont(score, 0.5) AS c, quantile_cont(score, 0.95) AS t FROM sc),
 p AS (SELECT flow_id, CAST(score <= c AS INT) AS co, CAST(score >= t AS INT) AS ta FROM sc, q), n AS (SELECT sum(co) AS nc, sum(ta) AS nt FROM p)
 SELECT token, round(abs(sum(ta) / any_value(nt) - sum(co) / any_value(nc)), 6) AS sensitivity FROM (SELECT DISTINCT flow_id, token FROM tok) x JOIN p USING (flow_id), n GROUP BY token""")
def agg15_tail_sensitivity(spark, sf):
    t = token_rows(spark, sf)
    val = t.where("split = 'val' AND label = 'BENIGN'").select("flow_id").distinct()
    s = read(spark, sf, "documents").select(F.col("doc_id").alias("flow_id"), F.length("text").cast("double").alias("score"))
    return rounded(T.tail_sensitivity(t, s.join(read(spark, sf, "labels").where("quality = 1 AND doc_id % 5 = 3").select(F.col("doc_id").alias("flow_id")), "flow_id")))


@query(f"""WITH {DOCS}, g AS (SELECT flow_id, split, token || '+' || lead(token) OVER (PARTITION BY flow_id ORDER BY pos) AS gram FROM tok), b AS (SELECT flow_id, split, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL)
 SELECT * FROM b WHERE gram IN (SELECT gram FROM b WHERE split = 'train' GROUP BY gram HAVING count(*) >= 20)""")
def agg17_ngram_motifs(spark, sf):
    return T.ngrams(token_rows(spark, sf), 2, 20)


@query(f"""WITH {DOCS}, f AS (SELECT count(DISTINCT flow_id) FILTER (label = 'ATTACK') AS a_, count(DISTINCT flow_id) FILTER (label = 'BENIGN') AS b_ FROM tok), d AS (SELECT DISTINCT flow_id, label, token FROM tok)
 SELECT token, count(*) FILTER (label = 'ATTACK') AS in_attack, count(*) FILTER (label = 'BENIGN') AS in_benign, round((count(*) FILTER (label = 'ATTACK') / any_value(a_) + 1e-6) / (count(*) FILTER (label = 'BENIGN') / any_value(b_) + 1e-6), 6) AS lift FROM d, f GROUP BY token HAVING count(*) FILTER (label IN ('ATTACK', 'BENIGN')) >= 10""")
def agg20_token_lift(spark, sf):
    return rounded(T.token_lift(token_rows(spark, sf), 10))


@query()
def agg16_select_motifs(spark, sf):
    c = staged(T.token_counts(token_rows(spark, sf)), "token-counts")
    s = staged(T.counted_support(c).where(F.col("support") >= 0.01).join(T.motif_stability(c), "token"), "motif-stats")
    return T.select_motifs(T.motif_utility(s.withColumn("sensitivity", F.lit(0.0))), c, 40, 0.05, 0.9, 0.5, 200)


@query(f"""WITH {DOCS}, a AS (SELECT 0 AS source, flow_id, pos, token FROM tok WHERE split = 'test' UNION ALL SELECT 1, flow_id, pos, token FROM tok WHERE split = 'train'), f AS (SELECT token, min((source, flow_id, pos)) AS at_, count(*) AS n FROM a GROUP BY token)
 SELECT token, row_number() OVER (ORDER BY at_) - 1 AS id, at_[1]::INTEGER AS source, n FROM f""")
def agg10_merge_corpora(spark, sf):
    t = token_rows(spark, sf)
    return T.merge_corpora([t.where("split = 'test'"), t.where("split = 'train'")])


@query(f"""WITH {DOCS}, c AS (SELECT DISTINCT token FROM tok) SELECT 'split_overlap' AS "check", count(*) FILTER (s > 1) AS bad FROM (SELECT count(DISTINCT split) AS s FROM tok GROUP BY flow_id)
 UNION ALL SELECT 'ip_token', count(*) FILTER (regexp_matches(token, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}')) FROM c UNION ALL SELECT 'port_token', count(*) FILTER (regexp_matches(token, '^(SRC|DST)?_?PORT_[0-9]+$')) FROM c UNION ALL SELECT 'time_token', count(*) FILTER (regexp_matches(token, '^(TS|TIME)_[0-9]{{9,}}')) FROM c""")
def agg40_leakage_report(spark, sf):
    return T.leakage_report(token_rows(spark, sf))


def _parts(names: tuple) -> str:
    return f"len(list_intersect(string_split_regex(upper(token), '[_=]'), [{', '.join(repr(n) for n in names)}])) > 0"


_IP = r"(regexp_matches(token, '(^|[^0-9])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9])') OR regexp_matches(token, '(?i)\b([0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}\b'))"


@query(f"""WITH {DOCS}, v AS (SELECT DISTINCT token FROM tok WHERE split = 'train'), n AS (SELECT count(*) FILTER ({_IP}) AS ip, count(*) FILTER ({_parts(S.TIME_PARTS)}) AS time, count(*) FILTER ({_parts(S.PORT_PARTS)}) AS port FROM v),
 m AS (SELECT count(*) AS bad FROM (SELECT flow_id FROM tok GROUP BY flow_id HAVING bool_or({_IP} OR {_parts(S.TIME_PARTS)} OR {_parts(S.PORT_PARTS)}))), s AS (SELECT count(*) - count(DISTINCT flow_id) AS bad FROM docs)
 SELECT 'L1_flow_id_disjoint' AS "check", bad = 0 AS ok, bad FROM s UNION ALL SELECT 'L4_vocab_no_raw_ip', ip + time + port = 0, ip FROM n UNION ALL SELECT 'L5_vocab_no_abs_time', ip + time + port = 0, time FROM n UNION ALL SELECT 'L6_vocab_no_raw_port', port = 0, port FROM n
 UNION ALL SELECT 'L4_L5_L6_token_meta_flags', bad = 0, bad FROM m UNION ALL SELECT unnest(['L2_profile_primitives_train_only', 'L3_vocab_train_only', 'L7_val_test_not_used_for_training_stats', 'L8_test_not_used_for_threshold_tuning']), unnest([false, true, true, true]), unnest([1, 0, 0, 0])""")
def agg40_leakage_checks(spark, sf):
    """All eight checks over every document's tokens; the profile manifest lacks its splits, so that L2 fails."""
    tokens = token_rows(spark, sf)
    t = F.col("token")
    meta = tokens.groupBy("flow_id").agg(F.max(S.looks_like_ip(t)).alias("has_ip_token"), F.max(S.is_time_token(t)).alias("has_abs_time_token"), F.max(S.is_port_token(t)).alias("has_port_token"))
    manifest = {"train_only": True, "splits": "documents", "threshold_tuning_split": "val"}
    return T.leakage_checks(flow_rows(spark, sf).select("flow_id", "split"), tokens.where("split = 'train'").select("token").distinct(), meta, {"train_only": True}, manifest)


@query("""WITH t AS (SELECT quantile_cont(ln(1 + l_quantity), [0.25, 0.5, 0.75]) AS q, quantile_cont(ln(1 + l_extendedprice), [0.25, 0.5, 0.75]) AS p FROM lineitem WHERE l_orderkey % 5 < 3)
 SELECT l_orderkey * 10 + l_linenumber AS flow_id, unnest(['L_QUANTITY_' || len(list_filter(q, lambda e: e <= ln(1 + l_quantity))), 'L_EXTENDEDPRICE_' || len(list_filter(p, lambda e: e <= ln(1 + l_extendedprice)))]) AS token FROM lineitem, t""")
def tok06_edge_tokens(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("flow_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return T.edge_tokens(li.where("l_orderkey % 5 < 3"), li, ["l_quantity", "l_extendedprice"], 4)
