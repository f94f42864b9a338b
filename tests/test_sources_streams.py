"""Readers on small files, streams against their batch twins."""

from pyspark.sql import functions as F

from flowharbor.sources import readers as R
from flowharbor.streaming import flows as T


def test_packet_csv(spark, tmp_path):
    d = tmp_path / "BENIGN"
    d.mkdir()
    (d / "a.csv").write_text("frame.time_epoch,frame.len,ip.src,ip.dst,tcp.srcport,tcp.dstport,udp.srcport,udp.dstport\n1.5,60,1.1.1.1,2.2.2.2,5,80,,\nx,60,1.1.1.1,2.2.2.2,5,80,,\n2.5,70,,2.2.2.2,,,53,5\n3,70,3.3.3.3,2.2.2.2,,,53,5\n")
    got = R.read_packet_csv(spark, str(tmp_path / "*" / "*.csv")).orderBy("timestamp").collect()
    assert [(r.timestamp, r.length, r.src_port, r.protocol, r.label) for r in got] == [(1.5, 60, "5", "TCP", "BENIGN"), (3.0, 70, "53", "UDP", "BENIGN")]


def test_sensor_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('# c\n\n{"uid":"C1","srcip":"a","srcport":1,"dstip":"b","dstport":2,"is_orig":true,"applayerlength":7,"timestamp":1.5,"appinfo":"http"}\n{"uid":"C1","srcip":"a","srcport":1,"dstip":"b","dstport":2,"is_orig":false,"applayerlength":9,"timestamp":1.6}\n')
    got = R.read_sensor_json(spark, str(tmp_path / "p.json")).orderBy("timestamp").collect()
    assert [(r.is_orig, r.length, r.src_port, r.appinfo) for r in got] == [(True, 7, "1", "http"), (False, 9, "1", "")]


def test_sensor_tsv_headers_differ_by_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("#separator \\x09\n#empty_field\t(empty)\n#unset_field\t-\n#fields\tts\tuid\tid.orig_h\n1.0\tC1\t-\n2.0\t(empty)\t9.9.9.9\n")
    (tmp_path / "b.log").write_text("#unset_field\tNA\n#fields\tuid\tts\nC9\t3.0\nNA\t-\n")
    got = R.read_sensor_tsv(spark, str(tmp_path / "*.log")).collect()
    assert sorted((r.ts, r.uid, r["id.orig_h"]) for r in got) == [("-", "", ""), ("1.0", "C1", ""), ("2.0", "", "9.9.9.9"), ("3.0", "C9", "")]


def test_labels_windows_and_lists(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Label\n1.1.1.1,5,2.2.2.2,80,6,4/7/2017 8:54:22,2000000,Attempted-DDoS\n1.1.1.1,5,2.2.2.2,80,6,bad,3,BENIGN\n")
    got = R.read_labels(spark, str(tmp_path / "l.csv"), "attack").orderBy("label").collect()
    assert [(r.label, r.timestamp_parse_status) for r in got] == [("BENIGN", "invalid"), ("DDoS", "parsed")] and got[1].end_ts - got[1].start_ts == 2.0
    (tmp_path / "w.csv").write_text('window_id,attack_family,iso_date,start_time,finish_time,attacker_ips,victim_ips\nw1,Botnet,2018-03-02,23:50,0:10,"[""1.1.1.1""]","2.2.2.2 3.3.3.3"\nw1,Botnet,2018-03-02,23:50,0:10,"[""1.1.1.1""]","2.2.2.2 3.3.3.3"\n')
    (w,) = R.read_attack_windows(spark, str(tmp_path / "w.csv")).collect()
    assert w.end_ts - w.start_ts == 1200 and w.attackers == ["1.1.1.1"] and w.victims == ["2.2.2.2", "3.3.3.3"]
    (tmp_path / "ips.txt").write_text("bad 1.2.3.4, 300.1.1.1; 1.2.3.4 and 10.0.0.9\n")
    assert sorted(r.ip for r in R.read_ip_list(spark, str(tmp_path / "ips.txt")).collect()) == ["1.2.3.4", "10.0.0.9"]


def stream_of(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def packets(spark):
    rows = [(i, f"2024-01-01 00:{i % 50:02d}:{i % 7:02d}", "a" if i % 2 else "b", "1", "b" if i % 2 else "a", "1", "TCP", i) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, t string, src_ip string, src_port string, dst_ip string, dst_port string, protocol string, length int")
    return df.withColumn("event_time", F.to_timestamp("t")).drop("t")


def test_stream_flows_equal_batch(spark, tmp_path):
    df = packets(spark)
    run(T.stream_flows(stream_of(spark, df, tmp_path), "90 seconds", "0 seconds"), "flows_out", "complete")
    batch = T.stream_flows(df, "90 seconds")
    assert sorted(map(str, spark.table("flows_out").collect())) == sorted(map(str, batch.collect()))


def test_alert_counts_equal_batch(spark, tmp_path):
    df = packets(spark).select("event_time", F.col("src_ip").alias("service"), (F.col("length") % 3 == 0).cast("int").alias("hit"))
    run(T.alert_counts(stream_of(spark, df, tmp_path), "10 minutes", "5 minutes"), "alerts_out", "complete")
    assert sorted(map(str, spark.table("alerts_out").collect())) == sorted(map(str, T.alert_counts(df, "10 minutes", "5 minutes").collect()))


def test_dynamic_memory_matches_plain_python(spark):
    rows = [(i, "ab"[i % 2], float(i // 2), (i * 37 % 11) / 10.0, 0.2 if i % 5 else 0.9) for i in range(60)]
    df = spark.createDataFrame(rows, "flow_id long, service string, ts double, value double, score double")
    got = {r.flow_id: (round(r.memory_score, 9), r.admitted) for r in T.dynamic_memory(df, 0.5, 8, 0.6, 0.9, 3).collect()}
    for s in "ab":
        memory, trust = [], 1.0
        for i, _, _, v, score in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            near = sorted(abs(v - m) for m in memory)[:3]
            d = sum(near) / 3 if len(near) == 3 else score
            trust = 0.9 * trust if d >= 0.5 else min(1.0, 0.9 * trust + 0.1)
            ok = d < 0.5 and trust >= 0.6
            memory = [*memory, v][-8:] if ok else memory
            assert got[i] == (round(d, 9), int(ok))


def test_mixed_sensor_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text('\n{"ts": "1.5", "uid": "u1", "id.orig_h": "10.0.0.1", "id.orig_p": "5", "id.resp_h": "10.0.0.2", "id.resp_p": "80", "length": "60", "is_orig": "T"}\n# note\n')
    (tmp_path / "b.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tresp_bytes\torig_pkts\tresp_pkts\tservice\n1.0\tu1\t10.0.0.1\t5\t10.0.0.2\t80\tudp\t1.0\t100\t300\t2\t3\thttp\n")
    kinds = R.log_formats(spark, str(tmp_path))
    assert sorted(kinds.values()) == ["json", "tsv"]
    got = R.read_sensor_packets(spark, str(tmp_path)).collect()
    assert [(r.length, r.protocol, r.appinfo, r.is_orig) for r in got] == [(60, "TCP", "http", True)]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "c.log").write_text((tmp_path / "b.log").read_text())
    made = R.read_sensor_packets(spark, str(tmp_path / "only")).orderBy("seq").collect()
    assert [r.length for r in made] == [50, 50, 100, 100, 100] and {r.protocol for r in made} == {"UDP"}


def test_result_sinks_and_profiles(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, a string"), spark.createDataFrame([(2, 0.5)], "id int, b double")
    R.write_result([a, b], str(tmp_path / "r"), "json")
    assert R.read_jsonl(spark, str(tmp_path / "r"), "id int, a string, b double").orderBy("id").collect() == [(1, "x", None), (2, None, 0.5)]
    long = spark.createDataFrame([("s", 1, "f", 1.0), ("s", 2, "g", 2.0)], "feature_set string, flow_id int, feature string, value double")
    R.write_feature_matrix(long, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m_schema")).first().features == ["f", "g"]
    (tmp_path / "p.csv").write_text("Label , Time\nA,3\nB,1\nA,2\n")
    got = {(r.column, r.value): r.n for r in R.profile_values(spark, str(tmp_path / "p.csv"), ["label"], "time").collect()}
    assert got == {("label", "A"): 2, ("label", "B"): 1, ("time", "1"): 3, ("time", "3"): 3}
    (tmp_path / "w.json").write_text('{"windows": [{"window_id": "w", "attack_family": "DoS", "iso_date": "2018-02-20", "start_time": "23:00", "finish_time": "1:00", "attacker_ips": ["1.2.3.4"], "victim_ips": ["5.6.7.8", "9.9.9.9"]}]}')
    w = R.read_attack_windows(spark, str(tmp_path / "w.json")).first()
    assert w.end_ts - w.start_ts == 7200 and w.victims == ["5.6.7.8", "9.9.9.9"]


def test_replay_stream_scores_like_the_batch(spark, tmp_path):
    from flowharbor.operators import replay

    memory = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(6)], "mid long, v array<double>")
    flows = spark.createDataFrame([(100 + i, [float(i % 2), 1.0], i % 2, float(i)) for i in range(8)], "id long, v array<double>, y int, ts double")
    flows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))
    replay.knn_replay_stream(stream, memory, 0.2, 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.hit for r in replay.replayed(flows, memory, 0.2, 3).collect()} and set(got.values()) == {0, 1}
