"""Running sums, exact selection, time buckets, hot-key joins, and what stands on them, against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowharbor.operators import jobs as J
from flowharbor.operators import memory as K
from flowharbor.operators import metrics as M
from flowharbor.operators import staging as G
from flowharbor.operators import tokens as T
from flowharbor.operators import windows as W


def plain_running(rows, peers):
    out, groups = {}, defaultdict(list)
    for g, o, v, i in rows:
        groups[g].append((o, v, i))
    for g, items in groups.items():
        items.sort(key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, 0 if peers else x[2]))
        for o, _, i in items:
            upto = [x for x in items if (x[0] is not None, x[0] or 0) < (o is not None, o or 0) or (x[0] == o and (peers or x[2] <= i))]
            out[i] = sum(x[1] or 0 for x in upto)
    return out


@pytest.mark.parametrize("peers", [False, True])
def test_running_sums(spark, peers):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(12)]), rng.choice([None, 1, 2, 5]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int, i int")
    got = G.running(df, ["g"], ["o"] if peers else ["o", "i"], {"s": F.col("v")}, peers)
    assert {r.i: r.s for r in got.collect()} == plain_running(rows, peers) and got.columns == ["g", "o", "v", "i", "s"]
    whole = G.running(df, [], ["i"], {"n": F.lit(1), "s": F.col("v")}).collect()
    assert sorted(r.n for r in whole) == list(range(1, 401)) and all(r.n == r.i + 1 for r in whole)
    assert G.running(df.limit(0), ["g"], ["o"], {"s": F.col("v")}).count() == 0 == G.running(df.limit(0), [], ["o"], {"s": F.col("v")}).count()


@pytest.mark.parametrize("small", [10, 100_000])
def test_first_rows_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", small)
    monkeypatch.setattr(G, "BINS", 7)
    rng = random.Random(small)
    rows = [(i, float(rng.choice([0, 0, 0, 1, 5, 5, 100, -3, rng.random() * 10]))) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, "i int, x double")
    want = sorted((x, i) for i, x in rows if x is not None)
    for n in (0, 1, 77, 250, 499, 500):
        assert sorted((r.x, r.i) for r in G.first_rows(df, F.col("x"), ["i"], n).collect()) == want[:n]
    assert G.first_rows(df, F.col("x"), ["i"], 900).count() == 501 and G.first_rows(df.limit(0), F.col("x"), ["i"], 3).count() == 0


def test_lookup_keeps_all_rows_hot_cold_unknown_and_null(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(2000)] + [("cold", 1), ("none", 2), (None, 3)], "k string, i int")
    facts = spark.createDataFrame([("hot", 2000, 7), ("cold", 1, 8)], "k string, n long, fact int")
    got = G.lookup(rows, facts, "k", "n", 2003).groupBy("k", "fact").count().collect()
    assert {(r.k, r.fact, r["count"]) for r in got} == {("hot", 7, 2000), ("cold", 8, 1), ("none", None, 1), (None, None, 1)}


def test_contexts_in_time_buckets(spark):
    rng = random.Random(3)
    flows = [(i, rng.choice(["dns", "dns", "web"]), round(rng.random() * 20, 2), rng.randint(1, 9), rng.randint(0, 50)) for i in range(300)] + [(900, "dns", 5.0, 1, 1), (901, "dns", 5.0, 1, 1), (902, "dns", 7.0, 1, 1)]
    got = {r.flow_id: r for r in W.service_context(spark.createDataFrame(flows, "flow_id int, service string, ts double, packets int, bytes int"), 2.0).collect()}
    for i, s, ts, *_ in flows:
        before = [f for f in flows if f[1] == s and round(f[2] * 1e6) >= round(ts * 1e6) - 2_000_000 and (f[2], f[0]) < (ts, i)]
        assert (got[i].recent_count, got[i].recent_packets) == (len(before), sum(f[3] for f in before) if before else got[i].recent_packets)


def test_nothing_runs_in_one_window_over_all(spark):
    """The plans of what used to sort a whole table in one task have no window without a partition key."""
    s = spark.createDataFrame([(i, i % 2, float(i % 7), "a", float(i)) for i in range(50)], "flow_id int, y int, score double, service string, ts double")
    t = spark.createDataFrame([(1, "train", 0, "x"), (2, "train", 0, "y")], "flow_id int, split string, pos int, token string")
    made = [M.curve(s), M.rank_metrics(s), M.conformal(s, s, [0.1]), T.fit_vocab(t), T.merge_corpora([t, t]), J.calibrate(s, 10)[1], W.max_sliding_fpr(s.withColumn("hit", F.lit(0)), [3.0])]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"windowspecdefinition\((\w+)", plan)) <= {"_part", "_bucket"}


def test_sparse_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(K, "SPARSE_QUERIES", 7)
    monkeypatch.setattr(K, "SPARSE_MEMORY", 11)
    monkeypatch.setattr(K, "STRETCH", 5)
    rng = random.Random(11)
    vectors = [{t: rng.random() for t in ["the", *rng.sample([f"t{i}" for i in range(40)], rng.randint(0, 8))]} if i % 9 else {f"only{i}": 1.0} for i in range(60)]
    q, m = vectors[:20], vectors[20:]
    df = lambda rows, name: spark.createDataFrame([(i, t, w) for i, v in enumerate(rows) for t, w in v.items()], f"{name} int, token string, w double")
    for share in (0.005, 0.2):
        monkeypatch.setattr(K, "FREQUENT", share)
        got = defaultdict(list)
        for r in K.nearest_sparse(df(q, "id"), df(m, "mid"), 4).collect():
            got[r.id].append(round(r.dot, 9))
        for i, v in enumerate(q):
            dots = sorted((round(sum(w * x.get(t, 0) for t, w in v.items()), 9) for x in m), reverse=True)
            assert sorted(got[i], reverse=True) == [d for d in dots[:4] if d > 0]


def test_inverted_index_reaches_its_recall_and_knows_it(spark):
    rng = random.Random(5)
    rows = lambda n: [{t: 1.0 for t in {f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(15)}} for _ in range(n)]
    df = lambda vs, name: spark.createDataFrame([(i, t, w / len(v) ** 0.5) for i, v in enumerate(vs) for t, w in v.items()], f"{name} int, token string, w double")
    q, m = df(rows(40), "id"), df(rows(300), "mid")
    recall = [K.inverted_recall(q, m, c, 3).first().recall for c in (3, 60, 300)]
    assert recall[0] < recall[1] <= recall[2] == 1.0 and recall[1] >= 0.9


def test_leakage_checks(spark):
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "flow_id int, split string")
    vocab = spark.createDataFrame([("PKT_LEN_3",), (None,)], "token string")
    good = {"train_only": True, "splits": "s.json"}
    clean = T.leakage_checks(splits, vocab, None, good, good)
    assert {r.check[:2] for r in clean.collect()} == {f"L{i}" for i in range(1, 9)} and clean.where("NOT ok").count() == 0
    T.assert_no_leakage(clean)
    bad = T.leakage_checks(splits.union(spark.createDataFrame([(1, "test")], "flow_id int, split string")), vocab.union(spark.createDataFrame([("DPORT_80",)], "token string")), None, good, {**good, "train_only": False, "threshold_tuning_split": "test"})
    with pytest.raises(T.LeakageError, match="L1_.*L3_.*L4_.*L5_.*L6_.*L7_.*L8_"):
        T.assert_no_leakage(bad)
    ports = T.leakage_checks(splits, spark.createDataFrame([("DPORT_80",)], "token string"), None, good, good, allow_ports=True)
    assert ports.where("NOT ok").count() == 0
    flags = spark.createDataFrame([(1, None, None, True)], "flow_id int, has_ip_token boolean, has_abs_time_token boolean, has_port_token boolean")
    assert T.leakage_checks(splits, None, flags).where("check = 'L4_L5_L6_token_meta_flags'").first().bad == 1


def test_views_of_real_tokens(spark):
    tokens = ["[CLS]", "[UNK]", "PKT_DIR_C2S", "PKT_LEN_4", "PKT_IAT_0", "BURST_START", "BURST_LEN_MEAN_3", "FLOW_DUR_2", "RHY_SHORT", "PRIM_PROFILE_NONE", "PRIM_PROFILE_SAME_LEN", "PRIM_STRUCT_DIR_ALTERNATING", "BURST_DIR_C2S"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    kept = {v: {r.t for r in df.where(J.view_filter(F.col("t"), v)).collect()} for v in J.VIEW_NAMES}
    assert kept["all_with_special"] == set(tokens) and kept["all_no_special"] == kept["no_unk"] == set(tokens[2:])
    assert kept["packet_burst"] == {*tokens[2:7], "BURST_DIR_C2S"} and kept["packet_burst_only"] == kept["packet_burst"] | {"FLOW_DUR_2"}
    assert kept["profile_plus_structural"] == kept["primitive_only"] == kept["without_tokens"] == {"PRIM_PROFILE_SAME_LEN", "PRIM_STRUCT_DIR_ALTERNATING"}
    assert kept["without_direction"] == set(tokens[2:]) - {"PKT_DIR_C2S", "BURST_DIR_C2S", "PRIM_STRUCT_DIR_ALTERNATING"} and "FLOW_DUR_2" not in kept["without_timing"] and "BURST_LEN_MEAN_3" not in kept["without_length"]
    assert "PRIM_PROFILE_NONE" in kept["without_primitives"] and "PRIM_PROFILE_NONE" not in kept["no_profile_no_unk"]
    assert {r.t for r in df.where(J.ablation_filter(F.col("t"), packet=False, rhythm=False)).collect()} == {"[CLS]", "[UNK]", "BURST_START", "BURST_LEN_MEAN_3", "BURST_DIR_C2S", "FLOW_DUR_2", "PRIM_STRUCT_DIR_ALTERNATING"}
    with pytest.raises(ValueError):
        J.view_filter(F.col("t"), "nope")
