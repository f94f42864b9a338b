"""Flow building, direction, bursts, profiles and connection expansion on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators import flows as O

PACKET = "timestamp double, seq long, src_ip string, src_port string, dst_ip string, dst_port string, protocol string, length int, uid string"


def packets(spark, rows):
    return spark.createDataFrame([(ts, i, *ends, n, uid) for i, (ts, ends, n, uid) in enumerate(rows)], PACKET)


A, B = ("10.0.0.1", "1234", "10.0.0.2", "443", "TCP"), ("10.0.0.2", "443", "10.0.0.1", "1234", "TCP")


def test_both_directions_are_one_flow(spark):
    (f,) = O.aggregate_packets(packets(spark, [(1.0, A, 60, ""), (1.2, B, 120, "")])).collect()
    assert f.lens == [60, 120] and f.dirs == [1, 0] and f.packet_count == 2 and f.iats[0] == 0.0


def test_duration_and_single_packet(spark):
    (f,) = O.aggregate_packets(packets(spark, [(100.0, A, 1, ""), (100.3, A, 1, "")])).collect()
    assert f.duration == 0.29999999999999716
    (f,) = O.aggregate_packets(packets(spark, [(5.0, A, 1, "")])).collect()
    assert f.duration == 0.0 and f.iats == [0.0]


def test_uid_separates(spark):
    got = O.aggregate_packets(packets(spark, [(1.0, A, 1, "C1"), (2.0, A, 1, "C1"), (3.0, A, 1, "C2")])).collect()
    assert sorted(f.packet_count for f in got) == [1, 2]


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 9)), rng.choice([A, B]), rng.randint(0, 99), "") for _ in range(60)]
    df = packets(spark, rows)
    a, b = O.aggregate_packets(df).collect(), O.aggregate_packets(df.orderBy(F.desc("seq")).repartition(5)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty(spark):
    df = packets(spark, [(1.0, A, 1, "")]).limit(0)
    assert O.aggregate_packets(df).count() == 0 and O.bursts(O.packet_rows(df)).count() == 0


def test_conn_expansion(spark):
    c = spark.createDataFrame([("u", 0.0, 1.0, 2, 3, 100, 300, "http"), ("v", 0.0, 1.0, 0, 0, 0, 0, "x")], "uid string, ts double, duration double, orig_pkts int, resp_pkts int, orig_bytes int, resp_bytes int, service string")
    got = O.expand_conn(c).orderBy("timestamp").collect()
    assert [r.length for r in got] == [50, 50, 100, 100, 100] and [r.is_orig for r in got] == [True, True, False, False, False]
    assert [r.timestamp for r in got] == [0.0, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize(("raw", "policy", "want"), [("Attempted-DDoS", "keep", "Attempted-DDoS"), ("Attempted-DDoS", "drop", None), ("Attempted-DDoS", "attack", "DDoS"), ("Attempted-DDoS", "benign", "BENIGN"), ("  Bot   net ", "drop", "Bot net"), ("", "keep", "UNKNOWN"), ("Attempted", "attack", "Attempted")])
def test_attempted_policy(spark, raw, policy, want):
    assert spark.createDataFrame([(raw,)], "l string").select(S.attempted_policy(F.col("l"), policy)).first()[0] == want


def test_families(spark):
    cases = {"DoS Hulk": "DoS", "DDoS attack-HOIC": "DDoS", "PortScan": "Probe", "Bot": "Botnet", "SSH-Patator": "BruteForce", "Web Attack – XSS": "WebAttack", "Infilteration": "Infiltration", "normal": "BENIGN", "Worms": "Worms", "odd": "OtherAttack"}
    df = spark.createDataFrame(list(cases.items()), "l string, w string")
    assert [(r.l, r.f) for r in df.select("l", S.attack_family(F.col("l")).alias("f")).collect()] == list(cases.items())


def test_timestamps_and_bins(spark):
    df = spark.createDataFrame([("1500000000.5",), ("4/7/2017 8:54:22",), ("x",), (None,)], "t string")
    got = [tuple(r.p) for r in df.select(S.parse_ts(F.col("t"), ["d/M/yyyy H:mm:ss"]).alias("p")).collect()]
    assert got == [(1500000000.5, "parsed_numeric"), (1499158462.0, "parsed"), (None, "invalid"), (None, "missing")]
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 3.0, 1e9)], "v double").select(S.log_bin(F.col("v")).alias("b")).collect()
    assert [r.b for r in v] == [0, 0, 1, 2, 15]
    e = spark.createDataFrame([(10.0,), (11.0,)], "v double").select(S.edge_bin(F.col("v"), [10]).alias("r"), S.edge_bin(F.col("v"), [10], False).alias("s")).collect()
    assert [(x.r, x.s) for x in e] == [(0, 1), (1, 1)]


def test_days_and_probabilities(spark):
    d = spark.createDataFrame([("monday-x", ""), (None, "data/Friday-02.csv"), ("", "z")], "d string, f string")
    assert [r[0] for r in d.select(S.infer_day(F.col("d"), F.col("f"))).collect()] == ["Monday", "Friday", "unknown"]
    p = spark.createDataFrame([({"a": 0.5, "b": 0.5},), ({"a": 0.9, "b": 0.1},)], "m map<string,double>").select(F.map_values("m").alias("p"), S.temperature(F.col("m"), 1.0).alias("t"))
    rows = p.select(S.entropy(F.col("p")).alias("e"), S.margin(F.col("p")).alias("g"), "t").collect()
    assert rows[0].e == pytest.approx(1) and rows[0].g == 0 and rows[1].g == pytest.approx(0.8) and rows[1].t["a"] == pytest.approx(0.9)


def test_originator_flag_sets_directions(spark):
    rows = [(1.0, *A, 60, True), (1.1, *A, 70, False), (1.2, *B, 80, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, timestamp double, src_ip string, src_port string, dst_ip string, dst_port string, protocol string, length int, is_orig boolean")
    flow = O.aggregate_packets(df).collect()
    assert len(flow) == 1 and list(flow[0].dirs) == [1, 0, 0]
    assert list(O.trace_flows(df, 2).first().lens) == [60, 70] and O.trace_flows(df, 2).first().orig_packets == 1


def test_profiles_of_six_kinds(spark):
    from flowharbor.operators import profiles as P

    kinds = {"short": ([50, 60], [1, 0]), "same": ([70] * 7, [1, 0, 1, 0, 1, 0, 1]), "pairs": ([10, 20, 10, 20, 10, 20], [1, 0, 1, 0, 1, 0]), "runs": ([5, 5, 5, 9, 9, 9, 1], [1, 1, 1, 0, 0, 0, 1]), "zero": ([0] * 5 + [3], [1, 1, 1, 1, 1, 0])}
    rows = [(f, float(100 * n + i), i, length, way) for n, (f, (lens, dirs)) in enumerate(sorted(kinds.items())) for i, (length, way) in enumerate(zip(lens, dirs))]
    df = spark.createDataFrame(rows, "flow string, ts double, seq long, len int, dir int")
    assert {(r.flow, r.length, r["count"]) for r in P.repeat_items(df).collect()} == {("runs", 5, 3), ("runs", 9, 3)}
    assert {(r.flow, tuple(r.left), tuple(r.right), r["count"]) for r in P.duplicate_items(df).collect()} == {("pairs", (20,), (10,), 3), ("pairs", (10,), (20,), 2), ("same", (70,), (70,), 6)}
    local = {(r.flow, r.seg): r.match for r in P.local_items(df).collect()}
    assert local.get(("zero", 0), "SUM") in ("SUM", "FUZZY", "EXACT") and local["pairs", 0] in ("SUM", "FUZZY", "SHIFT2", "EXACT") if ("pairs", 0) in local else True
    alone = P.local_items(df.where("flow = 'runs'")).collect()
    assert [r.match for r in alone] == ["SINGLE"] * 3 and [list(r.lens) for r in sorted(alone, key=lambda r: r.idx)] == [[5, 5, 5], [9, 9, 9], [1]]
    tokens = {r.flow: list(r.tokens) for r in P.flow_tokens(df).collect()}
    assert tokens["short"][:6] == ["[CLS]", "FLOW_PKTN_1", "FLOW_DUR_9", "FLOW_BURSTN_1", "FLOW_DIR_RATIO_5", "RHY_SHORT"] and tokens["short"][-1] == "[SEP]"
    assert "RHY_PERIODIC" in tokens["runs"] and tokens["pairs"].count("PRIM_PROFILE_DUP_SEG") >= 2
    plain = {r.flow: list(r.tokens) for r in P.flow_tokens(df, "none").collect()}
    assert not any(t.startswith("PRIM_") for t in plain["same"]) and P.flow_tokens(df.limit(0)).count() == 0


def test_port_gates_and_motifs(spark):
    df = spark.createDataFrame([("0", "SRC_PORT=1", "PRIM_STRUCT_PKT_X"), ("70000", "a_TS_b", "DM_x"), (None, "IMPORT_x", "PRIM_PROFILE_NONE"), ("x", "time", "y")], "p string, t string, m string")
    got = df.select(S.port_class(F.col("p")).alias("c"), S.service_from_port(F.col("p")).alias("s"), S.is_port_token(F.col("t")).alias("port"), S.is_time_token(F.col("t")).alias("time"), S.motif_family(F.col("m")).alias("f"), S.is_motif(F.col("m")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("PORT_ZERO", "none", True, False, "structural_pkt", True), ("PORT_OTHER", "other", False, True, "data_mined", True), ("PORT_OTHER", "none", False, False, "profile", True), ("PORT_OTHER", "none", False, True, "motif", False)]
    assert spark.range(1).select(S.passes_gate(F.array(F.lit(0.9), F.lit(0.1)), 0.8, 0.6, 0.5)).first()[0] and not spark.range(1).select(S.passes_gate(F.array(F.lit(0.6), F.lit(0.4)), 0.8)).first()[0]
