"""Queries of context, rolling, session and replay windows: events as flows of a service (event type and user mod 20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.operators import windows as W

from .binding import epoch, read
from .metric_queries import rounded
from .registry import query

EV = """ev AS (SELECT event_id AS flow_id, event_type || (user_id % 20) AS service, event_type AS label, floor(epoch(ts) / 60) * 60 AS ts, event_id % 11 AS packets, CAST(floor(value) AS BIGINT) AS bytes,
 floor(value) / 500 AS score, CAST(value > 250 AS INTEGER) AS hit, CAST(user_id % 4 = 0 AS INTEGER) AS y, CASE WHEN user_id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol, user_id % 5 AS port FROM events)"""


def events(spark, sf):
    v, u = F.col("value"), F.col("user_id")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("flow_id"), F.concat("event_type", u % 20).alias("service"), F.col("event_type").alias("label"), (F.floor(epoch("ts") / 60) * 60.0).alias("ts"), (F.col("event_id") % 11).alias("packets"), F.floor(v).alias("bytes"),
        (F.floor(v) / 500).alias("score"), (v > 250).cast("int").alias("hit"), (u % 4 == 0).cast("int").alias("y"), F.when(u % 2 == 0, "TCP").otherwise("UDP").alias("protocol"), (u % 5).alias("port"),
    )


CTX = """ctx AS (SELECT a.flow_id, a.service, a.ts, count(b.flow_id) AS recent_count, count(*) FILTER (b.packets < {s}) AS recent_short, coalesce(sum(b.packets), 0)::BIGINT AS recent_packets, coalesce(sum(b.bytes), 0)::BIGINT AS recent_bytes,
 a.ts - max(b.ts) AS last_gap FROM ev a LEFT JOIN ev b ON a.service = b.service AND b.ts >= a.ts - {w} AND (b.ts < a.ts OR (b.ts = a.ts AND b.flow_id < a.flow_id)) GROUP BY a.flow_id, a.service, a.ts)"""


@query(f"WITH {EV}, {CTX.format(w=36000, s=6)} SELECT *, CASE WHEN recent_count > 0 THEN round(recent_short / recent_count, 6) ELSE 0 END AS short_ratio FROM ctx")
def win01_service_context(spark, sf):
    return rounded(W.service_context(events(spark, sf), 36000.0, 6))


@query(f"""WITH {EV}, {CTX.format(w=36000, s=6)}, l AS (SELECT flow_id, count(*) OVER w AS lifetime, round(coalesce(avg(packets) OVER w, 0), 6) AS lifetime_packets FROM ev WINDOW w AS (PARTITION BY service ORDER BY ts, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT l.*, recent_count AS count_36000, CASE WHEN recent_count > 0 THEN round(recent_short / recent_count, 6) ELSE 0 END AS short_36000 FROM l JOIN ctx USING (flow_id)""")
def win03_service_state(spark, sf):
    return rounded(W.service_state(events(spark, sf), [36000.0]))


@query(f"WITH {EV} SELECT flow_id, service, round(avg(score) OVER w, 6) AS smoothed, count(*) OVER w AS rows_used FROM ev WINDOW w AS (PARTITION BY service ORDER BY ts, flow_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win04_rolling_scores(spark, sf):
    return rounded(W.rolling_scores(events(spark, sf), ["service"], 5))


@query(f"""WITH {EV}, b AS (SELECT *, (row_number() OVER (PARTITION BY service ORDER BY ts, flow_id) - 1) // 8 AS block FROM ev)
 SELECT service, block, count(*) AS n, round(avg(score), 6) AS mean, max(score) AS most, sum(hit)::BIGINT AS hits, CAST(2 * sum(hit) >= count(*) AS INTEGER) AS majority FROM b GROUP BY service, block""")
def win05_tumbling_rows(spark, sf):
    return rounded(W.tumbling_rows(events(spark, sf), ["service"], 8))


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT service, 0 AS "window", min(ts) AS start FROM ev GROUP BY service UNION ALL SELECT s.service, s."window" + 1, (SELECT min(ts) FROM ev WHERE ev.service = s.service AND ev.ts > s.start + 200000) FROM s WHERE EXISTS (SELECT 1 FROM ev WHERE ev.service = s.service AND ev.ts > s.start + 200000))
 SELECT service, "window"::INTEGER AS "window", start, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT s.*, lead(start) OVER (PARTITION BY service ORDER BY "window") AS stop FROM s) x JOIN ev USING (service) WHERE ev.ts >= start AND (stop IS NULL OR ev.ts < stop) GROUP BY ALL""")
def win05_anchored_windows(spark, sf):
    return rounded(W.anchored_windows(events(spark, sf), ["service"], 200000.0))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, flow_id) - 1 AS i FROM ev), p AS (SELECT service, w, label_ AS label, count(*) AS c FROM (SELECT service, i, CASE WHEN packets < 7 THEN 'short' ELSE 'long' END AS label_, unnest(range(CAST(greatest(0, floor((i - 10 + 5) / 5)) AS BIGINT), i // 5 + 1)) AS w FROM r) GROUP BY ALL),
 b AS (SELECT service, w, sum(c)::BIGINT AS rows, max(c) AS m FROM p GROUP BY service, w) SELECT service, w AS "window", rows, (SELECT min(label) FROM p WHERE p.service = b.service AND p.w = b.w AND c = m) AS label, round(m / rows, 6) AS purity FROM b WHERE rows >= 4 AND m >= 0.7 * rows""")
def win06_session_windows(spark, sf):
    e = events(spark, sf).withColumn("label", F.when(F.col("packets") < 7, "short").otherwise("long"))
    return rounded(W.session_windows(e, ["service"], 10, 5, 4, 0.7))


@query(f"""WITH {EV}, b AS (SELECT ts, count(*) AS n, sum(hit) AS h FROM ev WHERE y = 0 GROUP BY ts) SELECT 3600.0::DOUBLE AS window_s, round(max(f), 6) AS max_fpr FROM (SELECT sum(h) OVER w / sum(n) OVER w AS f FROM b WINDOW w AS (ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
 UNION ALL SELECT 360000.0, round(max(f), 6) FROM (SELECT sum(h) OVER w / sum(n) OVER w AS f FROM b WINDOW w AS (ORDER BY ts RANGE BETWEEN 360000 PRECEDING AND CURRENT ROW))""")
def win08_max_sliding_fpr(spark, sf):
    return rounded(W.max_sliding_fpr(events(spark, sf), [3600.0, 360000.0]))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER w AS i, sum(hit) OVER (PARTITION BY label ORDER BY ts, flow_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM (SELECT flow_id, label, ts, CAST(score >= 0.5 AS INT) AS hit FROM ev) WINDOW w AS (PARTITION BY label ORDER BY ts, flow_id))
 SELECT label, count(*) AS rows, min(ts) FILTER (s = 4 AND i >= 4) - min(ts) AS delay_s, min(i) FILTER (s = 4 AND i >= 4) AS delay_rows FROM r GROUP BY label""")
def win09_detection_delay(spark, sf):
    return W.detection_delay(events(spark, sf), 0.5, 4)


@query(f"WITH {EV} SELECT min(ts) AS first, min(ts) FILTER (y = 1) AS first_attack, min(ts) FILTER (hit = 1) AS first_alert, min(ts) FILTER (hit = 1 AND y = 0) AS first_fp, round(avg(hit) FILTER (y = 1), 6) AS coverage FROM ev")
def win10_first_events(spark, sf):
    return rounded(W.first_events(events(spark, sf)))


@query(f"""WITH {EV}, {CTX.format(w=100000, s=5)}, x AS (SELECT e.*, recent_count + 1 AS n, recent_short + CAST(packets <= 4 AS INT) AS s FROM ev e JOIN ctx USING (flow_id)),
 a AS (SELECT *, CAST(score >= 0.9 AS INTEGER) AS model_alert, CAST(packets <= 4 AND n >= 5 AND s / n >= 0.6 AS INTEGER) AS episode_alert FROM x) SELECT flow_id, service, ts, model_alert, episode_alert, greatest(model_alert, episode_alert) AS hit, n AS window_count FROM a""")
def str05_service_monitor(spark, sf):
    return W.service_monitor(events(spark, sf), 0.9, 100000.0, 5, 4, 0.6)


@query(f"""WITH {EV}, t AS (SELECT ts, sum(n) OVER (ORDER BY ts RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS c FROM (SELECT ts, count(*) AS n FROM ev WHERE packets <= 4 GROUP BY ts))
 SELECT flow_id, CAST(score >= 0.9 OR (packets <= 4 AND coalesce(c, 0) >= 15) AS INTEGER) AS hit, CAST(packets <= 4 AND coalesce(c, 0) >= 15 AS INTEGER) AS burst_alert FROM ev LEFT JOIN t USING (ts)""")
def str06_hybrid_alerts(spark, sf):
    return W.hybrid_alerts(events(spark, sf), 0.9, 7200.0, 15, 4)


@query(f"""WITH {EV} SELECT service, count(*) FILTER (y = 1) AS blocked_tp, count(*) FILTER (y = 0) AS blocked_fp FROM ev WHERE hit = 1 AND (protocol <> 'TCP' OR port = 3) GROUP BY service ORDER BY count(*) DESC, service LIMIT 20""")
def str07_agg33_guard_audit(spark, sf):
    return W.guard_audit(W.alert_guard(events(spark, sf), ["TCP"], None, [3]))


@query(f"""WITH {EV}, w AS (SELECT flow_id, ts, lag(ts) OVER o AS pt, lag(flow_id) OVER o AS pf, lead(ts) OVER o AS nt, lead(flow_id) OVER o AS nf FROM ev WINDOW o AS (PARTITION BY service ORDER BY ts, flow_id))
 SELECT flow_id, CASE WHEN pf IS NULL THEN nf WHEN nf IS NULL OR ts - pt <= nt - ts THEN pf ELSE nf END AS partner FROM w WHERE pf IS NOT NULL OR nf IS NOT NULL""")
def joi17_context_pairs(spark, sf):
    return W.context_pairs(events(spark, sf))
