"""Queries of profiles, behaviour tokens and structural primitives: a user's events are a flow, an hour stands for a tenth of a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowharbor.operators import jobs as J
from flowharbor.operators import profiles as P
from flowharbor.operators import structure as T
from flowharbor.operators.staging import staged

from .binding import epoch, read
from .metric_queries import rounded
from .primitive_queries import LB
from .registry import query

CHUNK, GAP = 64, 0.5


def lb(c: str) -> str:
    return LB.format(c=f"({c})")


def user_rows(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("flow"), (epoch("ts") / 36000.0).alias("ts"), F.col("event_id").alias("seq"), (F.floor(F.col("value") / 50) * 50).cast("int").alias("len"), F.col("event_type").isin("click", "purchase").cast("int").alias("dir"))


def user_splits(spark, sf):
    """Split and label of a user's flow by id, as SQL can make them too."""
    u = read(spark, sf, "events").select("user_id").distinct()
    part = F.col("user_id") % 5
    return u.select(F.concat(F.lit("u"), "user_id").alias("flow"), F.when(part < 3, "train").when(part == 3, "val").otherwise("test").alias("split"), F.when(F.col("user_id") % 3 == 0, "ATTACK").otherwise("BENIGN").alias("label"))


SPLITS = "sp AS (SELECT DISTINCT 'u' || user_id AS flow, CASE WHEN user_id % 5 < 3 THEN 'train' WHEN user_id % 5 = 3 THEN 'val' ELSE 'test' END AS split, CASE WHEN user_id % 3 = 0 THEN 'ATTACK' ELSE 'BENIGN' END AS label FROM events)"
UROWS = """urows AS (SELECT 'u' || user_id AS flow, epoch(ts) / 36000.0 AS ts, event_id AS seq, CAST(floor(value / 50) * 50 AS INTEGER) AS l, CAST(event_type IN ('click', 'purchase') AS INTEGER) AS dir FROM events),
s0 AS (SELECT *, CAST(coalesce(lag(dir) OVER w, -1) <> dir AS INT) AS nw, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY flow) AS n, coalesce(ts - lag(ts) OVER w, 0.0) AS gap, CAST(coalesce(lag(dir) OVER w <> dir OR ts - lag(ts) OVER w > 0.5, true) AS INT) AS nb FROM urows WINDOW w AS (PARTITION BY flow ORDER BY ts, seq)),
s1 AS (SELECT *, sum(nw) OVER w - 1 AS seg, sum(nb) OVER w - 1 AS b FROM s0 WINDOW w AS (PARTITION BY flow ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
fl AS (SELECT flow, count(*) AS n, min(l) AS lo, max(l) AS hi, sum(dir)::BIGINT AS up, max(ts) - min(ts) AS took, (max(b) + 1)::BIGINT AS bursts FROM s1 GROUP BY flow)"""
SEGS = f"""{UROWS}, segs AS (SELECT flow, seg::BIGINT AS seg, max(dir) AS dir, list(l ORDER BY ts, seq) AS lens FROM s1 GROUP BY flow, seg),
rep AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY c DESC, f) - 1 AS idx, length, c FROM (SELECT flow, lens[1] AS length, sum(len(lens))::BIGINT AS c, min(seg) AS f FROM segs WHERE len(lens) > 1 AND list_min(lens) = list_max(lens) GROUP BY ALL) WHERE c >= CASE WHEN length = 0 THEN 6 ELSE 2 END),
sets AS (SELECT flow, seg, list_sort(list_distinct(lens)) AS x FROM segs), pairs AS (SELECT flow, seg, x, lag(x) OVER (PARTITION BY flow ORDER BY seg) AS y FROM sets),
dup AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY c DESC, f) - 1 AS idx, x, y, c FROM (SELECT flow, x, y, count(*) AS c, min(seg) AS f FROM pairs WHERE y IS NOT NULL GROUP BY flow, x, y) WHERE c >= 2 AND NOT (x = [0] AND y = [0]))"""
PEERS = f"""{SEGS}, pl AS (SELECT flow, pos, pos // {CHUNK} AS chunk, count(*) OVER (PARTITION BY pos // {CHUNK}) AS peers FROM (SELECT flow, row_number() OVER (ORDER BY floor(t / 86400), t, flow) - 1 AS pos FROM (SELECT flow, min(ts) AS t FROM urows GROUP BY flow))),
h AS (SELECT flow, dir, l, count(*) AS c, min(i) AS f, any_value(pos) AS pos, any_value(chunk) AS chunk, any_value(peers) AS peers FROM s1 JOIN pl USING (flow) GROUP BY flow, dir, l),
sh AS (SELECT a.flow, a.dir, a.l, a.f, b.flow AS peer, b.pos, least(a.c, b.c) AS c FROM h a JOIN h b ON a.chunk = b.chunk AND a.dir = b.dir AND a.l = b.l AND a.flow <> b.flow),
sb AS (SELECT flow, dir, peer FROM (SELECT flow, dir, peer, row_number() OVER (PARTITION BY flow, dir ORDER BY sum(c) DESC, pos) AS r FROM sh GROUP BY flow, dir, peer, pos) WHERE r = 1),
it AS (SELECT sh.flow, sh.dir, l, f, c FROM sh JOIN sb ON sh.flow = sb.flow AND sh.dir = sb.dir AND sh.peer = sb.peer UNION ALL SELECT flow, dir, l, f, c FROM h WHERE peers = 1),
pk AS (SELECT * FROM (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY dir DESC, r) - 1 AS idx, CASE dir WHEN 1 THEN 'C2S' ELSE 'S2C' END AS dir, l AS length, c FROM (SELECT *, row_number() OVER (PARTITION BY flow, dir ORDER BY c DESC, f) AS r FROM it) WHERE r <= 12) WHERE idx < 12),
sl AS (SELECT segs.*, coalesce(lead(lens, 2) OVER (PARTITION BY segs.flow ORDER BY seg), CAST([] AS INTEGER[])) AS later, pos, chunk, peers FROM segs JOIN pl ON segs.flow = pl.flow),
lj AS (SELECT a.flow, a.seg, a.dir, a.lens, b.flow AS peer, b.pos, b.lens AS t, b.later AS q FROM sl a JOIN sl b ON a.chunk = b.chunk AND a.seg = b.seg AND a.flow <> b.flow),
lm AS (SELECT *, CASE WHEN lens = t THEN 'EXACT' WHEN abs(list_sum(lens) - list_sum(t)) <= 1 THEN 'SUM' END AS m, list_filter(lens, lambda x: list_contains(t, x) OR list_contains(q, x)) AS hh, len(list_filter(lens, lambda x: NOT list_contains(t, x) AND list_contains(q, x))) > 0 AS sf FROM lj),
lf AS (SELECT flow, seg, dir, peer, pos, coalesce(m, CASE WHEN sf THEN 'SHIFT2' ELSE 'FUZZY' END) AS match, CASE WHEN m IS NULL THEN hh ELSE lens END AS hits FROM lm),
lk AS (SELECT flow, peer FROM (SELECT flow, peer, row_number() OVER (PARTITION BY flow ORDER BY sum(len(hits)) DESC, pos) AS r FROM lf GROUP BY flow, peer, pos) WHERE r = 1),
lo AS (SELECT lf.flow, seg, dir, match, hits FROM lf JOIN lk ON lf.flow = lk.flow AND lf.peer = lk.peer UNION ALL SELECT flow, seg, dir, 'SINGLE', lens FROM sl WHERE peers = 1),
lc AS (SELECT * FROM (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY seg) - 1 AS idx, seg, CASE dir WHEN 1 THEN 'C2S' ELSE 'S2C' END AS dir, match, hits[1:6] AS lens FROM lo WHERE len(hits) > 0) WHERE idx < 8)"""


@query(f"WITH {SEGS} SELECT flow, 'REPEAT' AS kind, idx::INTEGER AS idx, length::VARCHAR AS what, c AS \"count\" FROM rep UNION ALL SELECT flow, 'DUP', idx::INTEGER, array_to_string(x, ',') || '|' || array_to_string(y, ','), c FROM dup")
def tok01_repeat_dup(spark, sf):
    r = user_rows(spark, sf)
    a = P.repeat_items(r).select("flow", F.lit("REPEAT").alias("kind"), "idx", F.col("length").cast("string").alias("what"), "count")
    sets = F.concat_ws("|", F.array_join(F.col("left").cast("array<string>"), ","), F.array_join(F.col("right").cast("array<string>"), ","))
    return a.unionByName(P.duplicate_items(r).select("flow", F.lit("DUP").alias("kind"), "idx", sets.alias("what"), "count"))


@query(f'WITH {PEERS} SELECT flow, idx::INTEGER AS idx, dir, length, c AS "count" FROM pk')
def tok02_packet_items(spark, sf):
    return P.packet_items(user_rows(spark, sf), CHUNK)


@query(f"WITH {PEERS} SELECT flow, idx::INTEGER AS idx, seg, dir, match, array_to_string(lens, ',') AS lens FROM lc")
def tok03_local_profile(spark, sf):
    return P.local_items(user_rows(spark, sf), CHUNK).withColumn("lens", F.array_join(F.col("lens").cast("array<string>"), ","))


def bins(lens: str) -> str:
    return f"array_to_string(list_transform({lens}, lambda x: ' PKT_LEN_' || {lb('x')}), '')"


TOKENS = f"""{PEERS}, pt AS (SELECT flow, 0 AS s, 0 AS idx, 'PRIM_PROFILE_SHORT_FLOW FLOW_COUNT_' || {lb('n')} AS t FROM fl WHERE n < 6 UNION ALL SELECT flow, 1, 0, 'PRIM_PROFILE_SAME_LEN PKT_LEN_' || {lb('lo')} || ' FLOW_COUNT_' || {lb('n')} FROM fl WHERE lo = hi
 UNION ALL SELECT flow, 2, idx, 'PRIM_PROFILE_PKT_DIST PKT_DIR_' || dir || ' PKT_LEN_' || {lb('length')} || ' FLOW_COUNT_' || {lb('c')} FROM pk WHERE idx < 8 UNION ALL SELECT flow, 3, idx, 'PRIM_PROFILE_LOCAL_SIM PKT_DIR_' || dir || ' MATCH_' || match || {bins('lens[1:4]')} FROM lc WHERE idx < 4
 UNION ALL SELECT flow, 4, idx, 'PRIM_PROFILE_REPEAT_SEG PKT_LEN_' || {lb('length')} || ' FLOW_COUNT_' || {lb('c')} FROM rep WHERE idx < 4 UNION ALL SELECT flow, 5, idx, 'PRIM_PROFILE_DUP_SEG FLOW_COUNT_' || {lb('c')} || {bins('x[1:2]')} || {bins('y[1:2]')} FROM dup WHERE idx < 4),
ps AS (SELECT flow, string_agg(t, ' ' ORDER BY s, idx) AS t FROM pt GROUP BY flow), rl AS (SELECT DISTINCT flow, length AS l FROM rep), kl AS (SELECT DISTINCT flow, length AS l FROM pk), du AS (SELECT DISTINCT flow FROM dup), lu AS (SELECT DISTINCT flow FROM lc),
t0 AS (SELECT s1.*, CASE WHEN s1.n < 6 THEN 'SHORT' WHEN rl.l IS NOT NULL THEN 'REPEAT' WHEN lo = hi THEN 'SAME' WHEN kl.l IS NOT NULL THEN 'PKT' ELSE 'NONE' END AS base, lu.flow IS NOT NULL AS has_l, du.flow IS NOT NULL AS has_d FROM s1 JOIN fl ON s1.flow = fl.flow LEFT JOIN rl ON s1.flow = rl.flow AND s1.l = rl.l LEFT JOIN kl ON s1.flow = kl.flow AND s1.l = kl.l LEFT JOIN du ON s1.flow = du.flow LEFT JOIN lu ON s1.flow = lu.flow),
t1 AS (SELECT *, row_number() OVER (PARTITION BY flow, base ORDER BY i) AS u, row_number() OVER (PARTITION BY flow, base ORDER BY i DESC) AS d, row_number() OVER (PARTITION BY flow, b ORDER BY i) AS j, row_number() OVER (PARTITION BY flow, b ORDER BY i DESC) AS k FROM t0),
t2 AS (SELECT *, CASE WHEN base = 'NONE' AND has_l AND u = 1 THEN 'LOCAL' WHEN base = 'NONE' AND has_d AND d = 1 THEN 'DUP' ELSE base END AS tag, n <= 48 OR i < 24 OR i >= greatest(24, n - 12) AS core FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY flow, NOT core AND tag <> 'NONE' ORDER BY i) AS r FROM t2),
t4 AS (SELECT * FROM t3 WHERE core OR (tag <> 'NONE' AND r <= 48 - 24 - least(12, n - 24))),
pa AS (SELECT flow, string_agg('PKT_DIR_' || CASE dir WHEN 1 THEN 'C2S' ELSE 'S2C' END || ' PKT_LEN_' || {lb('l')} || ' PKT_IAT_' || {lb('gap * 1000.0')} || ' BURST_' || CASE WHEN j = 1 AND k = 1 THEN 'SINGLE' WHEN j = 1 THEN 'START' WHEN k = 1 THEN 'END' ELSE 'MID' END || ' ' ||
 CASE tag WHEN 'SHORT' THEN 'PRIM_PROFILE_SHORT_FLOW' WHEN 'SAME' THEN 'PRIM_PROFILE_SAME_LEN' WHEN 'PKT' THEN 'PRIM_PROFILE_PKT_DIST' WHEN 'LOCAL' THEN 'PRIM_PROFILE_LOCAL_SIM' WHEN 'REPEAT' THEN 'PRIM_PROFILE_REPEAT_SEG' WHEN 'DUP' THEN 'PRIM_PROFILE_DUP_SEG' ELSE 'PRIM_PROFILE_NONE' END, ' ' ORDER BY i) AS t FROM t4 GROUP BY flow),
hd AS (SELECT flow, '[CLS] FLOW_PKTN_' || {lb('n')} || ' FLOW_DUR_' || {lb('took * 1000.0')} || ' FLOW_BURSTN_' || {lb('bursts')} || ' FLOW_DIR_RATIO_' || least(CAST(trunc(up / n * 10) AS INTEGER), 10) || ' ' || CASE WHEN n < 6 THEN 'RHY_SHORT' WHEN flow IN (SELECT flow FROM rep) OR flow IN (SELECT flow FROM dup) THEN 'RHY_PERIODIC'
 WHEN up / n > 0.85 THEN 'RHY_CLIENT_BURST' WHEN n - up > 3 * up AND up <= 3 THEN 'RHY_REQ_LONGRESP' WHEN n <= 8 AND up >= n - up THEN 'RHY_SCAN_LIKE' WHEN n > 3 AND abs(2 * up - n) <= greatest(2.0, 0.2 * n) THEN 'RHY_INTERACTIVE' ELSE 'RHY_GENERIC' END AS t FROM fl),
rw AS (SELECT hd.flow, string_split(concat_ws(' ', hd.t, ps.t, pa.t, '[SEP]'), ' ') AS raw FROM hd JOIN pa ON hd.flow = pa.flow LEFT JOIN ps ON hd.flow = ps.flow), tk AS (SELECT flow, raw[1:200] AS tokens, len(raw) AS raw_tokens FROM rw)"""


def user_tokens(spark, sf):
    return P.flow_tokens(user_rows(spark, sf), "full", 48, 200, GAP, CHUNK)


@query(f"WITH {TOKENS} SELECT flow, array_to_string(tokens, ' ') AS tokens, raw_tokens::INTEGER AS raw_tokens, raw_tokens > 200 AS truncated FROM tk")
def tok04_flow_tokens(spark, sf):
    return user_tokens(spark, sf).withColumn("tokens", F.array_join("tokens", " "))


def _view_sql(view: str) -> str:
    """A view's condition, from its fixed values."""
    if view in J.VIEWS:
        return f"kind IN ({', '.join(repr(k) for k in J.VIEWS[view].split())})"
    if view in J.VIEWS_WITHOUT or view == "no_unk":
        out = J.VIEWS_WITHOUT.get(view, "special").split()
        return f"kind NOT IN ({', '.join(repr(k) for k in out)})" if out else "true"
    parts = [f"contains(token, '{p}')" for p in J.PARTS_WITHOUT.get(view, ())] + [f"starts_with(token, '{p}')" for p in J.BEGIN_WITHOUT.get(view, ())]
    return f"kind <> 'special' AND NOT ({' OR '.join(parts)})"


@query(f"""WITH {TOKENS}, lt AS (SELECT flow, unnest(tokens) AS token FROM tk), k AS (SELECT *, CASE WHEN token IN ('[PAD]', '[CLS]', '[SEP]', '[MASK]', '[UNK]') THEN 'special' WHEN token = 'PRIM_PROFILE_NONE' THEN 'none' WHEN starts_with(token, 'PRIM_PROFILE_') THEN 'profile' WHEN starts_with(token, 'PRIM_STRUCT_') THEN 'structural'
 WHEN regexp_matches(token, '^PKT_(DIR|LEN|IAT)_') THEN 'packet' WHEN regexp_matches(token, '^FLOW_(PKTN|DUR|BURSTN|DIR_RATIO|COUNT)_') THEN 'flow' WHEN starts_with(token, 'BURST_') THEN 'burst' WHEN starts_with(token, 'RHY_') THEN 'rhythm' ELSE 'other' END AS kind FROM lt)
 {' UNION ALL '.join(f"SELECT '{v}' AS view, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, count(DISTINCT flow) AS flows FROM k WHERE {_view_sql(v)} HAVING count(*) > 0" for v in J.VIEW_NAMES)}""")
def sca28_feature_views(spark, sf):
    """What each named view keeps of all flows' tokens."""
    rows = user_tokens(spark, sf).select("flow", F.explode("tokens").alias("token"))
    kept = F.array_compact(F.array(*[F.when(J.view_filter(F.col("token"), v), v) for v in J.VIEW_NAMES]))
    return rows.select("flow", "token", F.explode(kept).alias("view")).groupBy("view").agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("distinct_tokens"), F.count_distinct("flow").alias("flows"))


@query(f"""WITH {TOKENS}, {SPLITS}, co AS (SELECT tk.flow, split, tokens, raw_tokens FROM tk JOIN sp ON tk.flow = sp.flow), lg AS (SELECT flow, split, unnest(tokens) AS token FROM co), v AS (SELECT DISTINCT token FROM lg WHERE split = 'train' UNION SELECT unnest(['[PAD]', '[CLS]', '[SEP]', '[MASK]', '[UNK]'])),
 b AS (SELECT *, len(tokens) AS n, row_number() OVER (PARTITION BY split ORDER BY len(tokens), flow) AS i, count(*) OVER (PARTITION BY split) AS m FROM co), u AS (SELECT split, count(*) AS tokens, round(avg(CAST(v.token IS NULL AS DOUBLE)), 6) AS unk_rate FROM lg LEFT JOIN v ON lg.token = v.token GROUP BY split)
 SELECT b.split, count(*) AS flows, round(avg(n), 6) AS mean, max(n) FILTER (i = round_even(0.5 * (m - 1), 0) + 1) AS p50, max(n) FILTER (i = round_even(0.95 * (m - 1), 0) + 1) AS p95, any_value(u.tokens) AS tokens, any_value(unk_rate) AS unk_rate, round(avg(CAST(raw_tokens > 200 AS DOUBLE)), 6) AS cut, max(raw_tokens)::INTEGER AS longest FROM b JOIN u ON b.split = u.split GROUP BY b.split""")
def tok05_behaviour_corpus(spark, sf):
    return rounded(P.behaviour_corpus(user_tokens(spark, sf), user_splits(spark, sf), 200)[2])


@query(f"""WITH {TOKENS}, a AS (SELECT tk.flow, fl.n, tokens, list_filter(tokens, lambda t: t NOT IN ('[CLS]', '[SEP]')) AS x FROM tk JOIN fl ON tk.flow = fl.flow)
 SELECT flow, n::DOUBLE AS packet_count, len(tokens)::DOUBLE AS token_count, len(x)::DOUBLE AS active_token_count, len(list_filter(x, lambda t: starts_with(t, 'BURST_START') OR starts_with(t, 'BURST_SINGLE')))::DOUBLE AS burst_count, CAST(n < 6 AS DOUBLE) AS short_flow_flag,
 len(list_filter(x, lambda t: starts_with(t, 'PRIM_PROFILE_REPEAT_SEG') OR starts_with(t, 'RHY_PERIODIC')))::DOUBLE AS repeat_count, len(list_filter(x, lambda t: starts_with(t, 'PRIM_PROFILE_DUP_SEG')))::DOUBLE AS duplicate_count FROM a""")
def tok08_token_statistics(spark, sf):
    n = user_rows(spark, sf).groupBy("flow").agg(F.count("*").alias("packet_count"))
    return P.token_statistics(user_tokens(spark, sf).join(n, "flow")).select("flow", "packet_count", "token_count", "active_token_count", "burst_count", "short_flow_flag", "repeat_count", "duplicate_count")


BLOCKS = f"""{UROWS}, bu AS (SELECT flow, b, count(*) AS n, min(ts) AS st, max(ts) AS en, sum(CASE dir WHEN 1 THEN l ELSE 0 END)::BIGINT AS c, sum(CASE dir WHEN 0 THEN l ELSE 0 END)::BIGINT AS s, coalesce(median(gap) FILTER (nb = 0), 0.0) AS med, avg(l) AS mean, stddev_pop(l) AS sd FROM s1 GROUP BY flow, b),
bn AS (SELECT *, count(*) OVER (PARTITION BY flow) AS m, coalesce(lead(st) OVER (PARTITION BY flow ORDER BY b) - en, 0.0) AS nx FROM bu),
shp AS (SELECT flow, string_agg('BURST_PKTN_' || {lb('n')} || ' BURST_DUR_' || {lb('(en - st) * 1000.0')} || ' BURST_BYTES_C2S_' || {lb('c')} || ' BURST_BYTES_S2C_' || {lb('s')} || CASE WHEN c >= s THEN ' BURST_DIR_C2S' ELSE ' BURST_DIR_S2C' END || ' BURST_IAT_MED_' || {lb('greatest(med, 0.0) * 1000.0')} ||
 ' BURST_GAP_NEXT_' || {lb('greatest(nx, 0.0) * 1000.0')} || ' BURST_LEN_MEAN_' || {lb('mean')} || ' BURST_LEN_STD_' || {lb('sd')}, ' ' ORDER BY b) AS t FROM bn WHERE b < 3 OR b = m - 1 GROUP BY flow),
sg AS (SELECT flow, 'FIRST_DIR_PATTERN_' || string_agg(CASE dir WHEN 1 THEN 'C' ELSE 'S' END, '' ORDER BY i) || ' ' || string_agg('FIRST_LEN_BIN_' || (i + 1) || '_' || {lb('l')}, ' ' ORDER BY i) || ' FIRST_IAT_PATTERN_' || coalesce(string_agg(CASE WHEN q = 0 THEN 'Z' WHEN q <= 4 THEN 'S' WHEN q <= 8 THEN 'M' ELSE 'L' END, '' ORDER BY i) FILTER (i > 0), 'EMPTY') AS t
 FROM (SELECT *, {lb('gap * 1000.0')} AS q FROM s1 WHERE i < 3) GROUP BY flow)"""


@query(f"WITH {BLOCKS} SELECT shp.flow, shp.t || ' ' || sg.t AS tokens FROM shp JOIN sg ON shp.flow = sg.flow")
def tok04_optional_blocks(spark, sf):
    r = user_rows(spark, sf)
    return P.shape_block(r, GAP).alias("a").join(P.signature_block(r).alias("b"), "flow").select("flow", F.concat_ws(" ", F.array_join("a.tokens", " "), F.array_join("b.tokens", " ")).alias("tokens"))


MADE_EVENTS = f"""{UROWS}, pe AS (SELECT flow, i, 4 * i AS pos, CASE dir WHEN 1 THEN 'C2S' ELSE 'S2C' END AS dir, {lb('l')} AS l, {lb('gap * 1000.0')} AS q FROM s1),
b0 AS (SELECT flow, b, max(dir) AS d, count(*) AS n, avg(l) AS mean, sum(l) AS bytes, min(ts) AS st, max(ts) AS en FROM s1 GROUP BY flow, b),
be AS (SELECT flow, b, 9 * b AS pos, CASE d WHEN 1 THEN 'C2S' ELSE 'S2C' END AS dir, {lb('n')} AS pktn, {lb('mean')} AS lm, {lb('greatest(coalesce(lead(st) OVER (PARTITION BY flow ORDER BY b) - en, 0.0), 0.0) * 1000.0')} AS gn, CASE d WHEN 1 THEN {lb('bytes')} ELSE 0 END AS c, CASE d WHEN 1 THEN 0 ELSE {lb('bytes')} END AS s FROM b0)"""
#: Tokens with the burst blocks before the packets, and the events that a reader of the tokens finds in them.
READ_EVENTS = f"""{TOKENS}, {BLOCKS.removeprefix(UROWS + ', ')}, bt AS (SELECT hd.flow, string_split(concat_ws(' ', hd.t, shp.t, ps.t, pa.t, '[SEP]'), ' ')[1:256] AS tokens FROM hd JOIN pa ON hd.flow = pa.flow JOIN shp ON hd.flow = shp.flow LEFT JOIN ps ON hd.flow = ps.flow),
tp AS (SELECT flow, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM bt), tn AS (SELECT *, lead(token) OVER w AS t1, lead(token, 2) OVER w AS t2, lag(token) OVER w AS t0 FROM tp WINDOW w AS (PARTITION BY flow ORDER BY pos)),
pe AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY pos) - 1 AS i, pos, token[9:] AS dir, CAST(t1[9:] AS INT) AS l, CAST(t2[9:] AS INT) AS q FROM tn WHERE token IN ('PKT_DIR_C2S', 'PKT_DIR_S2C') AND starts_with(t1, 'PKT_LEN_') AND starts_with(t2, 'PKT_IAT_')),
be AS (SELECT a.flow, a.pos AS b, a.pos, max(f.token[11:]) FILTER (starts_with(f.token, 'BURST_DIR_')) AS dir, CAST(any_value(a.token[12:]) AS INT) AS pktn, max(TRY_CAST(f.token[16:] AS INT)) FILTER (starts_with(f.token, 'BURST_LEN_MEAN_')) AS lm, max(TRY_CAST(f.token[16:] AS INT)) FILTER (starts_with(f.token, 'BURST_GAP_NEXT_')) AS gn,
 max(TRY_CAST(f.token[17:] AS INT)) FILTER (starts_with(f.token, 'BURST_BYTES_C2S_')) AS c, max(TRY_CAST(f.token[17:] AS INT)) FILTER (starts_with(f.token, 'BURST_BYTES_S2C_')) AS s FROM tn a JOIN tn f ON a.flow = f.flow AND f.pos BETWEEN a.pos AND a.pos + 8 WHERE starts_with(a.token, 'BURST_PKTN_') GROUP BY a.flow, a.pos)"""
FACTS = """p1 AS (SELECT *, lag(dir) OVER w AS dp, lag(l) OVER w AS lp, lead(dir) OVER w AS d1, lead(dir, 2) OVER w AS d2, lead(l) OVER w AS l1, lead(l, 2) OVER w AS l2, lead(q) OVER w AS q1, lead(q, 2) OVER w AS q2, lead(q, 3) OVER w AS q3 FROM pe WINDOW w AS (PARTITION BY flow ORDER BY i)),
p2 AS (SELECT *, sum(CAST(dp IS NULL OR dp <> dir OR l > 6 AS INT)) OVER w AS r1, sum(CAST(dp IS NULL OR dp <> dir OR lp <> l AS INT)) OVER w AS r2 FROM p1 WINDOW w AS (PARTITION BY flow ORDER BY i ROWS UNBOUNDED PRECEDING)),
ru AS (SELECT *, max(CAST(l > 6 AS INT)) OVER (PARTITION BY flow ORDER BY r1 ROWS UNBOUNDED PRECEDING) AS blocked FROM (SELECT flow, r1, min(pos) AS pos, arg_min(l, i) AS l, any_value(dir) AS dir, count(*) AS n FROM p2 GROUP BY flow, r1)),
sm AS (SELECT * FROM ru WHERE l <= 6 AND n >= 2), se AS (SELECT flow, r2, min(pos) AS pos, any_value(dir) AS dir, any_value(l) AS l, count(*) AS n FROM p2 GROUP BY flow, r2 HAVING count(*) >= 2),
md AS (SELECT flow, q, c FROM (SELECT flow, q, count(*) AS c, row_number() OVER (PARTITION BY flow ORDER BY count(*) DESC, min(i)) AS r FROM pe GROUP BY flow, q) WHERE r = 1),
pf AS (SELECT flow, count(*) AS n, count(*) FILTER (dir = 'C2S') AS up, count(*) FILTER (dp <> dir) AS turns, arg_min(dir, i) AS fd, min(i) FILTER (dp <> dir) AS ft, min(q) AS qlo, max(q) AS qhi, count(*) FILTER (q >= 10) AS high, avg(q) AS qm, stddev_pop(q) AS qs, max(pos) AS pm FROM p1 GROUP BY flow),
b1 AS (SELECT *, lag(dir) OVER w AS dp, lag(pktn) OVER w AS kp, lag(lm) OVER w AS mp FROM be WINDOW w AS (PARTITION BY flow ORDER BY b)),
bf AS (SELECT flow, count(*) AS bs, count(*) FILTER (dir = 'C2S') AS bc, count(*) FILTER (dp = 'C2S' AND dir = 'S2C') AS prs, count(*) FILTER (dp <> dir) AS bt, count(*) FILTER (gn <= 2) AS lg, count(*) FILTER (dp = dir AND kp = pktn AND mp = lm) AS du, sum(c)::BIGINT AS sc, sum(s)::BIGINT AS ss, count(*) FILTER (pktn <= 1) AS sb, max(pos) AS bm FROM b1 GROUP BY flow),
gm AS (SELECT flow, max(c) AS g FROM (SELECT flow, gn, count(*) AS c FROM be GROUP BY flow, gn) GROUP BY flow),
x AS (SELECT pf.*, bf.* EXCLUDE (flow), md.q AS mq, md.c AS mc, gm.g AS g, greatest(pm, bm, 1) AS most, pf.flow IN (SELECT flow FROM sm WHERE blocked = 0) AS anys, pf.flow IN (SELECT flow FROM sm WHERE blocked = 0 AND dir = 'C2S') AS cs, pf.flow IN (SELECT flow FROM se WHERE dir = 'C2S') AS csame,
 pf.flow IN (SELECT flow FROM p1 WHERE greatest(q, q1, q2) <= 2 AND q2 IS NOT NULL AND q3 >= 10) AS idle FROM pf JOIN bf ON pf.flow = bf.flow JOIN md ON pf.flow = md.flow JOIN gm ON pf.flow = gm.flow)"""


def bucket(n: str) -> str:
    return f"CASE WHEN {n} <= 2 THEN 2 WHEN {n} = 3 THEN 3 WHEN {n} <= 5 THEN 4 WHEN {n} <= 8 THEN 8 ELSE 16 END"


def ge(n: str, small: int, medium: int) -> str:
    return f"CASE WHEN {n} <= {small} THEN 'LE_{small}' WHEN {n} <= {medium} THEN '{small + 1}_{medium}' ELSE 'GE_{medium + 1}' END"


STEADY, PERIODIC = "(n >= 4 AND mc / n >= 0.7)", "(bs >= 3 AND g >= greatest(2, bs - 1))"
#: Name (SQL), family and condition of the triggers that tell of a flow as a whole.
WHOLE = (
    ("'BURST_SINGLE_DIR_DOMINANT_C2S'", "burst_shape", "bc / bs >= 0.8"), ("'BURST_SINGLE_DIR_DOMINANT_S2C'", "burst_shape", "(bs - bc) / bs >= 0.8"), ("'BURST_ASYM_BYTES_C2S'", "burst_shape", "sc >= ss + 4"), ("'BURST_ASYM_BYTES_S2C'", "burst_shape", "ss >= sc + 4"),
    ("'BURST_REQ_RESP_PAIR'", "burst_shape", "prs >= 1"), (f"'BURST_REQ_RESP_REPEAT_' || {bucket('prs')}", "burst_shape", "prs >= 2"), ("'BURST_ALT_FAST'", "burst_shape", "bs >= 4 AND bt >= bs - 2 AND lg >= greatest(1, bs // 2)"), ("'BURST_TEMPLATE_DUP'", "burst_shape", "du > 0"), ("'BURST_SHORT_MANY'", "burst_shape", "sb >= 4"),
    ("'IAT_LOW_VARIANCE'", "timing_rhythm", STEADY), ("'IAT_REGULAR_BEACON'", "timing_rhythm", f"{STEADY} AND mq > 0"), ("'IAT_HEAVY_TAIL'", "timing_rhythm", "n >= 4 AND qlo <= 2 AND qhi >= 10"), ("'FLOW_SLOW_DRIP'", "timing_rhythm", "n <= 8 AND high >= 2"), ("'BURST_INTERVAL_PERIODIC'", "timing_rhythm", PERIODIC),
    ("'DIR_MONO_C2S'", "direction_transition", "up = n"), ("'DIR_SERVER_RESPONSE_ABSENT'", "direction_transition", "up = n"), ("'DIR_MONO_S2C'", "direction_transition", "up = 0"), ("'DIR_ALTERNATING'", "direction_transition", "n >= 4 AND turns >= n - 2"),
    ("'DIR_TWO_PHASE_C2S_THEN_S2C'", "direction_transition", "turns = 1 AND fd = 'C2S'"), ("'DIR_TWO_PHASE_S2C_THEN_C2S'", "direction_transition", "turns = 1 AND fd = 'S2C'"),
    ("'COMP_FAST_C2S_SMALL_REPEAT'", "composite", f"cs AND {STEADY}"), ("'COMP_DUP_BURST_LOW_IAT'", "composite", f"du > 0 AND ({STEADY} OR {PERIODIC})"), ("'COMP_SHORT_FLOW_SAME_LEN_C2S'", "composite", "up = n AND csame AND n <= 6"), ("'COMP_REQ_RESP_TEMPLATE_REPEAT'", "composite", "prs >= 1 AND (du > 0 OR prs >= 2)"),
    ("'COMP_LONG_IDLE_THEN_DUP'", "composite", "idle AND du > 0"), ("'COMP_LOW_RATE_PERIODIC_SMALL_PKT'", "composite", f"{STEADY} AND mq > 0 AND anys"),
    (f"'PARAM_BURST_ASYM_RATIO_' || {ge('(greatest(sc, ss) // greatest(least(sc, ss), 1))', 3, 7)}", "parameterized", "greatest(sc, ss) >= greatest(least(sc, ss), 1) + 4"), (f"'PARAM_REQ_RESP_REPEAT_' || {ge('prs', 2, 3)}", "parameterized", "prs >= 2"), (f"'PARAM_BURST_COUNT_' || {ge('bs', 3, 8)}", "parameterized", "bs > 0"),
    ("'PARAM_IAT_CV_' || CASE WHEN qm <= 0 OR qs / qm < 0.25 THEN 'LOW' WHEN qs / qm < 1.0 THEN 'MID' ELSE 'HIGH' END", "parameterized", "n >= 4"), (f"'PARAM_LONG_IDLE_BIN_' || {ge('qhi', 10, 13)}", "parameterized", "n >= 4 AND qhi >= 10"),
)
FIRING = f"""{FACTS}, fi AS (SELECT flow, 'PKT_DIR_LEN_NGRAM_' || dir || '_L' || l || '_' || d1 || '_L' || l1 AS name, 'packet_shape' AS family, pos FROM p1 WHERE d1 IS NOT NULL UNION ALL SELECT flow, 'PKT_DIR_LEN_NGRAM_' || dir || '_L' || l || '_' || d1 || '_L' || l1 || '_' || d2 || '_L' || l2, 'packet_shape', pos FROM p1 WHERE d2 IS NOT NULL
 UNION ALL SELECT flow, 'PKT_' || dir || '_SMALL_RUN_' || {bucket('n')}, 'packet_shape', pos FROM sm WHERE blocked = 0 UNION ALL SELECT flow, 'PARAM_' || dir || '_SMALL_RUN_LEN_' || {ge('n', 3, 5)}, 'parameterized', NULL FROM (SELECT flow, dir, max(n) AS n FROM sm GROUP BY flow, dir)
 UNION ALL SELECT flow, 'PKT_SAME_LEN_RUN_' || dir || '_' || {bucket('n')} || '_L' || l, 'packet_shape', pos FROM se UNION ALL SELECT flow, 'PKT_LEN_SPIKE', 'packet_shape', pos FROM p1 WHERE abs(l - lp) >= 4 UNION ALL SELECT flow, 'PKT_LEN_RAMP_UP', 'packet_shape', pos FROM p1 WHERE l < l1 AND l1 < l2
 UNION ALL SELECT flow, 'PKT_LEN_RAMP_DOWN', 'packet_shape', pos FROM p1 WHERE l > l1 AND l1 > l2 UNION ALL SELECT flow, 'IAT_BURSTY_THEN_IDLE', 'timing_rhythm', pos FROM p1 WHERE greatest(q, q1, q2) <= 2 AND q2 IS NOT NULL AND q3 >= 10
 {' '.join(f"UNION ALL SELECT flow, {name}, '{family}', {'ft' if 'TWO_PHASE' in name else 'NULL'} FROM x WHERE {when}" for name, family, when in WHOLE)}),
co AS (SELECT flow, family, 'PRIM_STRUCT_' || name AS name, count(*) AS c, min(pos)::BIGINT AS first_pos FROM fi GROUP BY ALL),
aw AS (SELECT flow, 'position_aware' AS family, 'PRIM_STRUCT_POS_' || CASE WHEN first_pos / most < 1 / 3 THEN 'PREFIX' WHEN first_pos / most < 2 / 3 THEN 'MIDDLE' ELSE 'TAIL' END || '_' || CASE {' '.join(f"WHEN starts_with(name, 'PRIM_STRUCT_{a}') THEN '{b}'" for a, b in T.POSITION_NAMES)} END AS name, count(*) AS c, min(first_pos)::BIGINT AS first_pos FROM co JOIN x USING (flow) WHERE first_pos IS NOT NULL AND family <> 'direction_transition' GROUP BY ALL),
tr AS (SELECT flow, family, name, c AS "count", first_pos FROM (SELECT *, row_number() OVER (PARTITION BY flow, family ORDER BY c DESC, name) AS r FROM (SELECT * FROM co UNION ALL SELECT * FROM aw)) WHERE r <= 24)"""
FIRED = f"{MADE_EVENTS}, {FIRING}"


@query(f'WITH {FIRED} SELECT flow, family, name, "count", first_pos FROM tr')
def win17_structural_primitives(spark, sf):
    return T.triggers(*T.events(user_rows(spark, sf), GAP))


@query(f'WITH {READ_EVENTS}, {FIRING} SELECT flow, family, name, "count", first_pos FROM tr')
def win17_token_primitives(spark, sf):
    """The primitives that a reader of whole token sequences finds, burst blocks, profile tokens and truncation included."""
    r = user_rows(spark, sf)
    made = P.flow_tokens(r, "full", 48, 256, GAP, CHUNK, blocks=(P.shape_block(r, GAP),))
    return T.triggers(*[staged(e, "events") for e in T.token_events(made.select("flow", F.posexplode("tokens").alias("pos", "token")))])  # a dozen rules read each


@query(f"WITH {FIRED}, {SPLITS} SELECT name, count(DISTINCT tr.flow) AS flows FROM tr JOIN sp ON tr.flow = sp.flow WHERE split = 'train' GROUP BY name HAVING count(DISTINCT tr.flow) >= 5")
def agg19_structural_vocab(spark, sf):
    from flowharbor.operators.primitives import struct_vocab

    return struct_vocab(T.triggers(*T.events(user_rows(spark, sf), GAP)), user_splits(spark, sf).where("split = 'train'"), 5)
